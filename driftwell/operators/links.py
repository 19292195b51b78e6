"""Link safety and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

URL = r"https?://[^\s<>\"')\]]+"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_verdict(url: Column, allowed: list[str], longest: int = 2048) -> Column:
    """ok, or the first rule a link breaks: missing, too_long, not_https, userinfo, ip_literal, local, host_not_allowed."""
    h = host(url)
    good = F.lit(False)
    for s in allowed:
        good = good | (h == s) | h.endswith(f".{s}")
    return (
        F.when(url.isNull() | (F.trim(url) == ""), "missing").when(F.length(url) > longest, "too_long").when(~F.lower(url).startswith("https://"), "not_https")
        .when(url.rlike(r"^[a-zA-Z]+://[^/?#]*@"), "userinfo").when(h.rlike(r"^[0-9.]+$|^\[|^0x"), "ip_literal")
        .when((h == "localhost") | h.endswith(".local") | ~h.contains("."), "local").when(~good, "host_not_allowed").otherwise("ok")
    )


def hrefs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, href, n): links of a page with how often it has them."""
    found = F.regexp_extract_all(html_col, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select(id_col, F.explode(found).alias("href")).groupBy(id_col, "href").agg(F.count("*").alias("n"))


def repository_links(docs: DataFrame, cues: str = r"(?i)(?:code|repository|implementation|available|released|project)", deny: tuple[str, ...] = ("github.com/features", "github.com/about"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, url): repository links with a cue word in the 60 characters before; a url that only begins another goes."""
    hosts = r"(?:github\.com|gitlab\.com|bitbucket\.org|huggingface\.co)/[\w.-]+/[\w.-]+"
    pairs = F.regexp_extract_all(F.regexp_replace(text_col, r"(https?://\S*[/-])\n(?=\S)", "$1"), F.lit(rf"(?s)(.{{0,60}}?https?://{hosts})"), F.lit(1))
    l = docs.select(id_col, F.explode(pairs).alias("ctx")).select(id_col, "ctx", F.lower(F.regexp_replace(F.regexp_extract("ctx", rf"(https?://{hosts})$", 1), r"(?:\.git)?[.,;]*$", "")).alias("url"))
    l = l.where(F.col("ctx").rlike(cues)).select(id_col, "url").distinct()
    for d in deny:
        l = l.where(~F.col("url").contains(d))
    w = Window.partitionBy(id_col).orderBy("url")
    return l.withColumn("_next", F.lead("url").over(w)).where(~F.coalesce(F.col("_next").startswith(F.col("url")), F.lit(False))).drop("_next")


def corroborates(repo_text: Column, title: Column, authors: Column) -> Column:
    """A repository's words hold two distinctive title words or an author's surname."""
    w = F.split(F.lower(repo_text), "[^a-z0-9]+")
    long_words = F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda x: F.length(x) >= 6)
    names = F.transform(authors, lambda a: F.lower(F.element_at(F.split(F.trim(a), r"\s+"), -1)))
    return (F.size(F.array_intersect(w, long_words)) >= 2) | F.arrays_overlap(w, names)


LIST_REPO = r"(?i)\b(?:awesome|curated|paper[- ]?list|reading[- ]?list)\b"


def repo_kind(name: Column) -> Column:
    return F.when(name.rlike(LIST_REPO), "list").when(name.rlike(r"(?i)(?:\.github\.io|dataset|slides|homepage)$"), "not_code").otherwise("code")


def names_in_titles(names: DataFrame, titles: DataFrame, longest: int = 4) -> DataFrame:
    """(name, ref_id): names equal to a run of up to four title words joined, no version number following."""
    t = titles.select("ref_id", F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda x: x != "").alias("w"))
    runs = t.select("ref_id", "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where("size(w) >= n").select("ref_id", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
    runs = runs.select("ref_id", F.array_join(F.slice("w", F.col("i"), F.col("n")), "").alias("joined"), F.get("w", F.col("i") + F.col("n") - 1).alias("after"))
    n = names.select("name", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "").alias("joined"))
    return n.join(runs.where("after is null or not regexp_like(after, '^v?[0-9]+$')"), "joined").select("name", "ref_id").distinct()


def bibliography_links(mentions: DataFrame, bib: DataFrame) -> DataFrame:
    """(doc, name, ref_id): names always followed by one and the same citation, whose title holds the name."""
    one = mentions.groupBy("doc_id", "name").agg(F.countDistinct("ref_id").alias("n"), F.min("ref_id").alias("ref_id")).where("n = 1").drop("n")
    return one.join(names_in_titles(mentions.select("name").distinct(), bib), ["name", "ref_id"])
