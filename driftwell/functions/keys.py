"""Scalar column builders: identity keys, dates, labels, numbers and calendar. No state, no Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_title(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_tokens(c: Column) -> Column:
    return F.filter(F.split(norm_title(c), " "), lambda x: x != "")


def sha_prefix(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def clean_id(c: Column) -> Column:
    """An id without its address, its pdf ending and its version."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^https?://[^/]+/(?:abs|pdf)/", ""), r"(?:\.pdf)?(?:v\d+)?$", "")


def paper_key(key: Column, ident: Column, doi: Column, title: Column) -> Column:
    """A key that is set, else the id (a made-up one yields to the doi), else doi:..., else title:..."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    lower_doi = F.lower(some(doi))
    made_up = some(ident).startswith("s2:") & lower_doi.isNotNull()
    return F.coalesce(some(key), F.when(made_up, F.concat(F.lit("doi:"), lower_doi)), clean_id(some(ident)), F.concat(F.lit("doi:"), lower_doi), F.concat(F.lit("title:"), norm_title(some(title))))


def entity_keys(ident: Column, doi: Column, title: Column) -> Column:
    """Every key an entity may be known by."""
    return F.array_compact(F.array(clean_id(ident), F.concat(F.lit("doi:"), F.lower(doi)), F.concat(F.lit("title:"), norm_title(title))))


def partial_date(c: Column) -> Column:
    """struct(day, precision): precision is day, year, invalid or missing; a year alone has no day."""
    t = F.trim(c)
    day = F.coalesce(F.to_date(F.try_to_timestamp(t)), F.to_date(F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd"))))
    year = t.rlike(r"^\d{4}$")
    return F.struct(
        F.when(~year, day).alias("day"),
        F.when(t.isNull() | (t == ""), "missing").when(year, "year").when(day.isNotNull(), "day").otherwise("invalid").alias("precision"),
    )


def recency(day: Column, as_of: Column, half_life: float = 30.0) -> Column:
    """0.5 ^ (age / half_life), age at least 0; null when the day is unknown."""
    return F.pow(F.lit(0.5), F.greatest(F.datediff(as_of, day), F.lit(0)) / half_life)


def weight_band(w: Column) -> Column:
    return F.round(F.floor(F.coalesce(w, F.lit(1.0)) / 0.1 + 1e-6) * 0.1, 6)


#: Spellings that count as one concept.
CONCEPT_FOLDS = ((r"\brobotic\b", "robot"), (r"\blarge language model\b", "llm"), (r"\bllm-based\b", "llm"))


def concept_key(keyword: Column) -> Column:
    k = F.lower(keyword)
    for pattern, put in CONCEPT_FOLDS:
        k = F.regexp_replace(k, pattern, put)
    return F.trim(F.regexp_replace(k, r"[\s\-‐-―_/]+", " "))


def concept_breadth(hits: Column) -> Column:
    """Different concepts among the hits, 2 at most."""
    return F.least(F.size(F.array_distinct(F.transform(hits, concept_key))), F.lit(2))


def venue_hit(venue: Column, venues: Column) -> Column:
    """True, false, or null when either side is unknown."""
    v = F.lower(F.trim(venue))
    known = (F.size(venues) > 0) & (v != "")
    return F.when(known, F.exists(venues, lambda x: v.contains(F.lower(x)) | F.lower(x).contains(v)))


def explanation_score(top_weight: Column, n_hits: Column, domain: Column, venue: Column, recent: Column) -> Column:
    """Terms that are unknown drop out."""
    s = top_weight * (0.8 + 0.2 * F.least(n_hits - 1, F.lit(1))) + F.coalesce(domain, F.lit(0)) * 0.1
    return F.round(s + F.coalesce(venue.cast("int"), F.lit(0)) * 0.3 + F.coalesce(recent, F.lit(0.0)) * 0.15, 4)


def title_match(a: Column, b: Column, least: float = 0.8) -> Column:
    """Token Jaccard of two titles is at least ``least``."""
    x, y = F.array_distinct(title_tokens(a)), F.array_distinct(title_tokens(b))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)) >= least, F.lit(False))


def retraction_code(first: Column, second: Column) -> Column:
    """Null unknown, 0 no source says so, 1 one of them, 2 both."""
    return F.when(first.isNull() & second.isNull(), None).otherwise(F.coalesce(first, F.lit(False)).cast("int") + F.coalesce(second, F.lit(False)).cast("int"))


def quote_found(text: Column, quote: Column, least: int = 12) -> Column:
    norm = lambda c: collapse(F.lower(c))
    return (F.length(norm(quote)) >= least) & norm(text).contains(norm(quote))


SECRET = r"(?i)(?:api[_-]?key|secret|token|password)\s*[:=]\s*\S{8,}|\bsk-[A-Za-z0-9]{20,}|\bghp_[A-Za-z0-9]{30,}|\bAKIA[0-9A-Z]{16}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----"


def secret_like(c: Column) -> Column:
    return F.coalesce(c.rlike(SECRET), F.lit(False))


def secret_free(c: Column) -> Column:
    return F.regexp_replace(c, SECRET, "[secret]")


def cell_number(c: Column) -> Column:
    """The first finite number of a cell; fractions give null, a unicode minus is a minus; commas may part thousands.

    A number inside a name (``ResNet50``, ``12M``) is none.
    """
    t = F.when(c.contains("−") | c.contains("–"), F.translate(c, "−–", "--")).otherwise(c)  # plain searches, by which most cells pass
    whole = F.when(c.contains(","), F.regexp_replace(t, r",(?<=\d,)(?=\d{3})", "")).otherwise(t)
    n = F.regexp_extract(whole, r"(?=[-+.\d])(?<![\w.])([-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?)(?![\w.])", 1)
    finite = F.filter(F.array(n.try_cast("double")), lambda v: F.abs(v) < float("inf"))  # the number is read once
    return F.when(~(c.contains("/") & c.rlike(r"\d\s*/\s*\d")), F.get(finite, F.lit(0)))


LOWER_IS_BETTER = r"(?i)\b(?:error|loss|rmse|mae|mse|fid|latency|time|perplexity|wer|cer|collision)\b"
HIGHER_IS_BETTER = r"(?i)\b(?:accuracy|acc|f1|auc|auroc|map|ap|miou|iou|bleu|rouge|recall|precision|success|score|psnr|ssim)\b"


def direction(label: Column) -> Column:
    """higher, lower, or null when the metric's name does not tell; arrows win over names."""
    return F.when(label.rlike("↑"), "higher").when(label.rlike("↓"), "lower").when(label.rlike(LOWER_IS_BETTER), "lower").when(label.rlike(HIGHER_IS_BETTER), "higher")


def metric_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(label, "[↑↓]", "")), "[^a-z0-9]+", "")


def comparable(a: Column, b: Column, ratio_metric: Column) -> Column:
    """struct(a, b) on one scale; null when one is a ratio, the other a percentage and the metric is not known as a ratio."""
    same = (F.abs(a) <= 1) == (F.abs(b) <= 1)
    up = lambda x: F.when(F.abs(x) <= 1, x * 100).otherwise(x)
    return F.when(same, F.struct(a.alias("a"), b.alias("b"))).when(ratio_metric, F.struct(up(a).alias("a"), up(b).alias("b")))


def local_day(ts: Column, zone: str = "Asia/Seoul") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def operating_day(ts: Column, zone: str = "Asia/Seoul", starts_at_hour: int = 5) -> Column:
    """The day that a time belongs to when days begin at ``starts_at_hour`` local time."""
    return F.to_date(F.from_utc_timestamp(ts, zone) - F.make_interval(hours=F.lit(starts_at_hour)))


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def is_work_day(day: Column, holiday: Column) -> Column:
    return (F.weekday(day) < 5) & holiday.isNull()


def status_code(pairs: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first status whose condition holds."""
    out = None
    for cond, name in pairs:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(otherwise)


def coverage_code(measured: Column, planned: Column) -> Column:
    return status_code([(measured >= 0.999, "full"), (measured.isNotNull(), "measured_partial"), (planned.isNotNull(), "planned")], "unknown")


def verification_code(total: Column, matched: Column) -> Column:
    return status_code([(total.isNull(), "unmeasured"), (total == 0, "no_numbers"), (matched == total, "all_matched")], "some_unmatched")


def conditions_verified(matched: Column, differences: Column, required: tuple[str, ...] = ("dataset", "split", "metric", "protocol")) -> Column:
    return (F.size(F.array_intersect(matched, F.array(*map(F.lit, required)))) == len(required)) & (F.coalesce(F.size(differences), F.lit(0)) == 0)


def full_text_route(ident: Column, pdf: Column) -> Column:
    return F.coalesce((F.trim(ident) != "") | pdf.startswith("https://"), F.lit(False))
