r"""Personal data (operator 10), in DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs), and words near a span move
its score. Patterns are possessive and anchored at the start of a run of their characters, which finds the same leftmost
matches without backtracking through long runs.

A span's place comes from splitting the text at the pattern: the lengths of the pieces and of the matches, summed up,
are its code point offsets. Sums are run over pieces of the array, and words near a span are taken from the block of text
that it lies in, so the work grows with a text and not with its square. Spans are (kind, start, end, score, text), end
exclusive.

Defined cases: null text is empty and has no spans; texts of any length are scanned whole; repeated rows are scanned
each; an empty table gives no rows; other columns pass through. Spans of different kinds may overlap and all stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.tokens import unused

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
SSN = r"(?<![0-9])[0-9]++(?:-[0-9]++)++"
SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
#: Words within ``CONTEXT_CHARS`` before or after a span that make the kind likelier, and those that make it less likely.
CONTEXT = {"email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|payment", "phone": "phone|call|tel|mobile", "iban": "iban|bank|account", "ssn": "ssn|social|security", "secret": "token|secret|key|password|passwd|bearer|credential"}
AGAINST = "version|example|sample|test|isbn|order"
CONTEXT_CHARS = 40
START_SCORE = {"email": 0.8, "ip": 0.7, "card": 0.9, "phone": 0.6, "iban": 0.95, "ssn": 0.4, "secret": 0.4}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """True if the digits of the match pass Luhn."""
    d = F.reverse(_digits(match))
    at = F.sequence(F.lit(1), F.length(d))

    def step(acc, i):
        v = F.substr(d, i, F.lit(1)).cast("int")
        v = F.when(i % 2 == 0, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)
        return acc + v

    return F.aggregate(at, F.lit(0), step) % 10 == 0


def mod97(match: Column) -> Column:
    """True if the match, moved round and with letters as numbers, leaves 1 when divided by 97."""
    s = F.replace(match, F.lit(" "), F.lit(""))
    s = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def step(acc, i):
        c = F.ascii(F.substr(s, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step) == 1


def _valid(kind: Column, m: Column) -> Column:
    """True if the match passes the check of its kind."""
    n = F.length(_digits(m))
    return (
        F.when(kind == "ip", m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")).when(kind == "card", F.when(n.between(14, 19), luhn(m)).otherwise(False)).when(kind == "phone", n.between(10, 15))
        .when(kind == "iban", mod97(m)).when(kind == "ssn", m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")).when(kind == "secret", m.rlike("[0-9]") & m.rlike("[A-Za-z]")).otherwise(True)
    )


#: Elements of a running total that are added up at a time, and characters of a block of text.
RUN, BLOCK = 512, 1000


def _running(values: Column, combine, zero: int) -> Column:
    """Running totals of an array of integers, each element included, in time that grows with its length.

    The array is cut into runs; a run's own totals begin with the total of the runs before it, so no array is built
    element by element that is longer than a run or than the number of runs.
    """
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    part = lambda at: F.slice(values, at, F.lit(RUN))
    grow = lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x)))
    before = F.aggregate(F.transform(starts, lambda at: F.aggregate(part(at), F.lit(zero), combine)), F.array(F.lit(zero)), grow)
    runs = F.zip_with(starts, F.slice(before, F.lit(1), F.size(starts)), lambda at, b: F.aggregate(part(at), F.array(b), grow))
    return F.flatten(F.transform(runs, lambda r: F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))))


def _blocks(text: Column) -> Column:
    """A text as blocks of BLOCK characters, of which any part can be had without going through the whole."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _part(blocks: Column, lo: Column, hi: Column) -> Column:
    """The characters from ``lo`` to before ``hi``; both at least 0, ``hi`` may lie behind the end."""
    first = F.floor(lo / BLOCK).cast("int")
    few = F.array_join(F.slice(blocks, first + 1, F.greatest(F.floor((hi - 1) / BLOCK).cast("int") - first + 1, F.lit(0))), "")
    return F.when(hi > lo, F.substr(few, lo - first * BLOCK + 1, hi - lo)).otherwise("")


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` refers to it."""
    return F.transform(F.array(value), f)[0]


def _found(text: Column, order: int, kind: str, keep_score: float) -> Column:
    """What a kind proposes in a text: its texts, and the lengths of the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda p: F.length(p))
    none = F.struct(F.array().cast("array<string>").alias("m"), F.array().cast("array<int>").alias("gaps"))
    return F.struct(
        F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), F.lit(START_SCORE[kind]).alias("score"), F.lit(_word(CONTEXT[kind])).alias("near"), F.lit(0.0 if kind in BASE else keep_score).alias("least"),
        F.when(GATES[kind](text), F.struct(found.alias("m"), gaps.alias("gaps"))).otherwise(none).alias("f"),
    )


def _confirmed(f: Column) -> Column:
    """Array of (start, end, text, and the kind's own values) for the matches that their checks confirm."""
    m = f["f"]["m"]
    steps = F.zip_with(F.slice(f["f"]["gaps"], F.lit(1), F.size(m)), m, lambda g, x: g + F.length(x))
    ends = _let(steps, lambda v: _running(v, lambda a, x: a + x, 0))
    kept = [f[c].alias(c) for c in ("kind_order", "kind", "score", "near", "least")]
    spans = F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("text"), *kept))
    return F.filter(spans, lambda x: _valid(x["kind"], x["text"]))


def _word(names: str) -> str:
    return rf"(?:^|[^a-z0-9])(?:{names})(?:[^a-z0-9]|$)"


def _scored(blocks: Column, x: Column) -> Column:
    """A confirmed span with its score, moved by the words around it."""
    near = F.lower(F.concat(_part(blocks, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)), x["start"]), F.lit(" "), _part(blocks, x["end"], x["end"] + CONTEXT_CHARS)))
    moved = _let(near, lambda t: x["score"] + F.when(F.regexp_like(t, x["near"]), 0.2).otherwise(0.0) - F.when(t.rlike(_word(AGAINST)), 0.2).otherwise(0.0))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved))
    return F.struct(x["start"].alias("start"), x["kind_order"].alias("kind_order"), x["kind"].alias("kind"), x["end"].alias("end"), score.alias("score"), x["text"].alias("text"), x["least"].alias("least"))


#: A cheap test that every text with a match passes; texts that fail it skip the scan for places.
GATES = {
    "email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]"), "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"), "secret": lambda t: t.rlike(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20}"),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "secret": SECRET}


def find_spans(docs: DataFrame, kinds: tuple = BASE + ADDED, text_col: str = "text", keep_score: float = 0.5, name: str = "spans") -> DataFrame:
    """Adds ``name``: array of (kind, start, end, score, text) by start, then kind in the order of ``kinds``.

    A span's score starts at its kind's value and moves by 0.2 for a context word of its kind nearby and by -0.2 for a
    word that speaks against it. Base kinds stay whatever their score; added kinds need ``keep_score``. A column that has
    this name already is replaced; all others pass through.
    """
    shape = "array<struct<start:int,kind_order:int,kind:string,end:int,score:double,text:string>>"
    work = unused(docs, "work")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # each step is a column that the next one refers to, so that nothing is worked out once an element
    raw = docs.withColumn(work, F.array(*[_found(text, i, k, keep_score) for i, k in enumerate(kinds)]))
    raw = raw.withColumn(work, F.flatten(F.transform(work, _confirmed)))
    raw = raw.withColumn(work, F.struct(F.col(work).alias("spans"), F.when(F.size(work) > 0, _blocks(text)).alias("blocks")))
    w = F.col(work)
    scored = F.filter(F.transform(w["spans"], lambda x: _scored(w["blocks"], x)), lambda x: x["score"] >= x["least"])
    plain = F.transform(scored, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "kind_order", "kind", "end", "score", "text")]))
    return raw.withColumn(name, F.array_sort(plain).cast(shape)).drop(work)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text, per document."""
    found = find_spans(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(id_col, *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every found span replaced by [KIND]; overlapping spans go as one, named by the first that starts."""
    name, work = unused(docs, "spans"), unused(docs, "cuts")
    found = find_spans(docs, text_col=text_col, name=name)
    t = F.col(text_col)
    found = found.withColumn(work, F.transform(name, lambda x: x["end"]))
    found = found.withColumn(work, F.struct(_running(F.col(work), lambda a, x: F.greatest(a, x), 0).alias("reach"), F.when(F.size(name) > 0, _blocks(t)).alias("blocks")))
    # a span that begins behind all before it is named; the text between its start and their reach stays
    reach = F.col(work)["reach"]
    heads = F.filter(F.transform(name, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get(reach, i - 1)).alias("at"), x["start"].alias("start"), x["kind"].alias("kind"))), lambda h: h["start"] >= h["at"])
    found = found.withColumn(work, F.struct(heads.alias("heads"), F.element_at(F.concat(F.array(F.lit(0)), reach), -1).alias("last"), F.col(work)["blocks"].alias("blocks")))
    w = F.col(work)
    said = F.transform(w["heads"], lambda h: F.concat(_part(w["blocks"], h["at"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
    clean = F.when(F.size(name) == 0, t).otherwise(F.concat(F.array_join(said, ""), _part(w["blocks"], w["last"], F.length(t))))
    return found.withColumn(text_col, clean).select(*docs.columns)


def _sql_spans(order: int, kind: str, pattern: str, valid: str) -> str:
    return rf"""
  SELECT k, {order} AS ord, '{kind}' AS kind, s, s + length(m) AS e, t FROM (
    SELECT k, t, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS g, reverse(regexp_replace(ms[i], '[^0-9]', '', 'g')) AS r,
           coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT k, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d)))
  WHERE {valid}"""


_LUHN = "length(g) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(r, i, 1)::INT WHEN substr(r, i, 1)::INT > 4 THEN substr(r, i, 1)::INT * 2 - 9 ELSE substr(r, i, 1)::INT * 2 END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END::BIGINT)), lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"
_NEAR = "(lower(substr(t, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || ' ' || substr(t, s + length(m) + 1, 40)),"


def _sql_context(kind: str) -> str:
    """For a kind whose start score is under the threshold: a word for it nearby, and none against it."""
    word = lambda names: f"'(?:^|[^a-z0-9])(?:{names})(?:[^a-z0-9]|$)')"
    return f"regexp_matches{_NEAR} {word(CONTEXT[kind])} AND NOT regexp_matches{_NEAR} {word(AGAINST)}"


_SSN = "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND " + _sql_context("ssn")
_SECRET = "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND " + _sql_context("secret")
ORACLE = (
    "WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join([
        _sql_spans(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _sql_spans(1, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))"),
        _sql_spans(2, "card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
        _sql_spans(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(g) BETWEEN 10 AND 15"),
        _sql_spans(4, "iban", IBAN, _MOD97),
        _sql_spans(5, "ssn", r"[0-9]+(?:-[0-9]+)+", _SSN),
        _sql_spans(6, "secret", r"[A-Za-z0-9_+/=-]{20,}", _SECRET),
    ])
    + r""")
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN (SELECT k, count(*) FILTER (ord = 0) AS n_email, count(*) FILTER (ord = 1) AS n_ip, count(*) FILTER (ord = 2) AS n_card, count(*) FILTER (ord = 3) AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM f GROUP BY k) USING (k)
"""
)
