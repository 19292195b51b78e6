"""Numbers as tables and formulas write them: cells, formatted mathematics, metrics and their values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwell.functions.keys import cell_number, collapse  # noqa: F401  cells are numbers too

NUMBER = r"[+\-−]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+\-−]?[0-9]+)?"
MISSING = ("n/a", "na", "-", "–", "—", "−")
#: Marks around the source of a formula inside a cell's text, private characters that no text uses.
MATH, END_MATH = "\ue000", "\ue001"
#: Marks around what a search has found, private characters too.
FOUND, END_FOUND = "\ue002", "\ue003"

# Names of metrics, of averages and of a paper's own rows. Abbreviations mind their case, phrases do not.
# A pattern begins with the letters its matches begin with, so that a search passes all others by at once.
METRIC_ABBR = (
    r"(?=[ABCDEFHILMNPRSWmn])(?<!\w)(AUROC|AUPRO|AUPR|mAP(?:@[\d.:]+)?|AP(?:50|75)?|mIoU|FB-IoU|IoU|F1|PSNR|SSIM|LPIPS|FID|BLEU|ROUGE(?:-[L12])?|EM|"
    r"SR|DS|RC|WER|CER|MRR|nDCG(?:@\d+)?|Dice|PCK|ADE|FDE|EPE|MAE|RMSE|NDS|HOTA|MOTA)(?![\w-])"
)
METRIC_WORDS = (
    r"accuracy|solve rates?|success(?: rates?)?|driving score|route completion|error rates?|collision rates?|top-1|top-5|recall@\d+|pass@\d+|"
    r"precision|recall|f1[- ]score|exact match|win rate|(?:any[- ])?medal rates?"
)
METRIC_PHRASE = rf"(?=[ACDEFMPRSTWacdefmprstw])(?i)\b({METRIC_WORDS})\b"
LOWER_BETTER = r"(?i)(?<![\w-])(?:FID|LPIPS|WER|CER|ADE|FDE|EPE|MAE|RMSE|MSE|CD|error|err|collision|latency|miss rate|chamfer|infraction|violation)(?![\w-])"
METRIC_ALIASES = {
    "drivingscore": "ds", "successrate": "sr", "successrates": "sr", "routecompletion": "rc", "accuracy": "acc", "top1accuracy": "top1", "average": "mean", "avg": "mean", "overall": "mean",
}
#: Values that can be results: percentages and decimals; whole numbers may be years or references.
VALUE = r"(?=\d)(?<![\w.])(?:\d+(?:\.\d+)?\s?%|\d+\.\d+(?![\w.%]))"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it: inside lambdas Spark would compute it each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_missing(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*MISSING)


def is_numeric(c: Column) -> Column:
    """The text begins with a number that ends there: a value, not a name or a year in a citation."""
    return F.trim(c).rlike(rf"^{NUMBER}(?![\w.])")


def math_number(alt: Column) -> Column:
    r"""A formula that is one number, with or without an error, as plain text; null for any other formula.

    Fonts, sizes, colours, thin spaces and braces go; ``\pm`` stays as ±; ``3\times 10^{-4}`` is 3e-4. A number below a
    number is its error if it is a decimal or set small or in colour, else it stays as subscript digits (a footnote).
    """
    style = r"\\(?:scriptscriptstyle|scriptstyle|displaystyle|textstyle)(?![A-Za-z])"
    styled = alt.rlike(style) | alt.rlike(r"\\(?:text)?color(?![A-Za-z])")
    t = F.regexp_replace(F.regexp_replace(alt, style, " "), r"\\[,;:! ]|~", " ")
    t = F.regexp_replace(t, r"\\textcolor\s*(?:\[[^\]]*\])?\s*\{[^{}]*\}\s*\{([^{}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\color\s*(?:\[[^\]]*\])?\s*\{[^{}]*\}", " ")
    for _ in range(4):  # fonts inside fonts
        t = F.regexp_replace(t, r"\\(?:mathbf|boldsymbol|bm|textbf|underline|uline|mathit|mathrm|textit|textrm|text)\s*\{([^{}]*)\}", "$1")
    t = F.regexp_replace(t, rf"({NUMBER})\s*(?:\\times|\\cdot|×|·)\s*10\s*\^\s*\{{?\s*([+\-−]?[0-9]+)\s*\}}?", "$1e$2")
    t = F.regexp_replace(t, r"(?<![\w.])([+\-−]?)10\s*\^\s*\{?\s*([+\-−]?[0-9]+)\s*\}?", "$11e$2")
    for old, new in ((r"\\pm(?![A-Za-z])", "±"), (r"\\mp(?![A-Za-z])", "∓"), (r"\\%", "%"), (r"[{}]", " ")):
        t = F.regexp_replace(t, old, new)
    one, below = rf"{NUMBER}\s*%?", r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*%?"
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    sub, whole = rf"^({one}) ?_ ?({below})$", rf"^({one})(?:\s*([±∓])\s*({below}))?$"

    def lowered(t: Column) -> Column:
        digits = lambda low: F.when(low.contains(".") | styled, F.concat(F.lit(" ± "), low)).otherwise(F.concat(F.lit(" "), F.translate(low, "0123456789", "₀₁₂₃₄₅₆₇₈₉")))
        return F.concat(bare(F.regexp_extract(t, sub, 1)), _let(bare(F.regexp_extract(t, sub, 2)), digits))

    def plain(t: Column) -> Column:
        with_error = lambda e: F.when(e != "", F.concat(F.lit(" "), F.regexp_extract(t, whole, 2), F.lit(" "), e)).otherwise("")
        return F.concat(bare(F.regexp_extract(t, whole, 1)), _let(bare(F.regexp_extract(t, whole, 3)), with_error))

    return _let(collapse(t), lambda t: F.when(t.rlike(sub), lowered(t)).when(t.rlike(whole), plain(t)))


def math_text(cell: Column, numbers: bool = True) -> Column:
    """A cell's text with its marked formulas as plain numbers where they are numbers, else (or without ``numbers``) as written."""
    parts = F.split(cell, f"[{MATH}{END_MATH}]")
    said = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.coalesce(math_number(x), x) if numbers else x).otherwise(x))
    return F.when(cell.contains(MATH), collapse(F.array_join(said, ""))).otherwise(cell)


def clean_label(c: Column) -> Column:
    """A label without marks of direction, empty brackets and fonts of formulas."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\(?:text|mathrm|textbf|mathbf|textit)\{([^{}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\(?:uparrow|downarrow|Uparrow|Downarrow)|[↑↓]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\(\s*\)", ""), r"\s+", " "), "^[ /]+|[ /]+$", "")


def label_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(clean_label(c)), "[^0-9a-z]+", "")


def metric_path_key(label: Column) -> Column:
    """The key of a metric's path (``1-shot / Average``), its parts by their short names."""
    names = F.create_map(*[F.lit(x) for kv in METRIC_ALIASES.items() for x in kv])
    parts = F.transform(F.split(clean_label(label), r"\s*/\s*"), label_key)
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(names, p), p)), "")


def metric_direction(label: Column) -> Column:
    """higher or lower: by arrows, else by the metric's name; null for unknown names."""
    known = label.rlike(METRIC_ABBR) | label.rlike(METRIC_PHRASE)
    return F.when(label.rlike(r"↓|\\[dD]ownarrow"), "lower").when(label.rlike(r"↑|\\[uU]parrow"), "higher").when(label.rlike(LOWER_BETTER), "lower").when(known, "higher")


def metric_names(text: Column) -> Column:
    """All names of metrics in a text, abbreviations first."""
    return F.concat(F.regexp_extract_all(text, F.lit(METRIC_ABBR), F.lit(1)), F.regexp_extract_all(text, F.lit(METRIC_PHRASE), F.lit(1)))


def only_metric(text: Column) -> Column:
    """The metric that a text speaks of, null if it names none or several."""
    names = metric_names(F.coalesce(text, F.lit("")))
    return F.when(F.size(F.array_distinct(F.transform(names, metric_path_key))) == 1, names[0])


#: Letters that begin the name of a metric, which no letter or digit precedes.
_METRIC_FIRST = "A-FHILMNPRSTWacdefmnprstw"
#: What follows a value that is a share of data, and what stands before the number of a section.
NOT_SCORE = r"(?i)^\s*%?\s*(?:of|for)\s+(?:the\s+)?(?:training|train|labeled|labelled|annotated|data|dataset|samples?|images?|labels?|parameters?|budget|compute|time|runtime)\b"
SECTION_MARK = r"(?=[§Ss])((?i:§|\bsection|\bsec\.?)\s*)"


def _spans(text: Column, pattern: str) -> Column:
    """array of (start, end, before, after) of a pattern's matches; before and after are the neighbouring pieces of text."""
    kind = "array<struct<lo:int,hi:int,before:string,after:string>>"
    parts = F.split(F.regexp_replace(text, pattern, f"{FOUND}$0{END_FOUND}"), f"[{FOUND}{END_FOUND}]", -1)  # one search; every second part is a match

    def one(p: Column, m: Column, at: Column, i: Column) -> Column:
        return F.struct(at.alias("lo"), (at + F.length(m)).alias("hi"), F.get(p, i - 1).alias("before"), F.get(p, i + 1).alias("after"))

    def spans(p: Column) -> Column:
        lone = F.array(one(p, F.get(p, F.lit(1)), F.length(F.get(p, F.lit(0))), F.lit(1)))
        step = lambda ends, x: F.concat(ends, F.array(F.element_at(ends, -1) + F.length(x)))
        many = lambda ends: F.filter(F.transform(p, lambda m, i: F.when(i % 2 == 1, one(p, m, F.get(ends, i), i))), lambda x: x.isNotNull())
        several = _let(F.aggregate(p, F.array(F.lit(0)), step), many)
        return F.when(F.size(p) == 1, F.array().cast(kind)).when(F.size(p) == 3, lone).otherwise(several)

    return _let(parts, spans)


def _scored(reach: int) -> str:
    """A metric's name and a value within ``reach`` characters of each other, as one search that holds the names once.

    A value that stands before sets the empty group ``met``, else one has to follow. Groups are atomic, so spans are those
    that a search for each pattern alone finds; the number of a section is marked by FOUND and none.
    """
    value = VALUE.replace(r"(?<![\w.])", rf"(?<![\w.{FOUND}])")
    value, gap = rf"(?>{value})(?!{NOT_SCORE.replace('^', '')})", rf"(?s:.{{0,{reach}}})"
    name = rf"(?=[{_METRIC_FIRST}])(?<!\w)(?:(?>{METRIC_ABBR})|(?>{METRIC_PHRASE}))"
    return rf"(?=[\d{_METRIC_FIRST}])(?<!\w)(?:{value}{gap}(?<met>))?{name}(?:\k<met>|(?={gap}{value}))"


def scored_value(sentence: Column, reach: int = 40) -> Column:
    """True if a value stands within ``reach`` characters of a metric's name and is neither a section's number nor a share of data.

    The distance is that between two spans, so a value may stand on either side; numbers that are left out are left out
    one by one. Sentences are short; a text of any length should be cut into sentences first.
    """
    may = F.lit(False)
    for mark in ("§", "ec", "EC", "Ec", "eC"):  # a plain search, by which most sentences pass
        may |= F.contains(sentence, F.lit(mark))
    marked = F.regexp_replace(sentence, rf"{SECTION_MARK}(?={VALUE})\d", f"$1{FOUND}")
    return F.coalesce(F.when(may, marked).otherwise(sentence).rlike(_scored(reach)), F.lit(False))
