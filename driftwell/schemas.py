"""Target schemas of the library's tables and the check that an input has the columns an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PAPERS = "paper_key string, title string, abstract string, published string, venue string, citation_count long, source string, seeds array<string>, sources array<string>"
KEYWORDS = "profile_id string, keyword string, kind string, weight double, position int, guard string"
OBSERVATIONS = "scan_id string, profile_id string, paper_key string, text_sha string, text string, text_ref string, sources array<string>, seeds array<string>, published string, outcome string, filter_reason string, core_hits array<string>, observed_at timestamp"
REACTION_TOKENS = "tid string, issue_id string, profile_id string, paper_key string, recipient string, position int, delivered_at timestamp, expires_at timestamp"
REACTION_EVENTS = "event_id string, tid string, action string, received_at timestamp, status string"
REVISIONS = "profile_id string, revision int, created_at timestamp, origin string, keywords array<struct<keyword:string,kind:string,weight:double>>"
RESULTS = "reported_in string, locator string, bench_key string, metric_key string, direction string, value double, model string, own boolean"
CELLS = "doc_id long, table_id int, row int, col int, text string, is_header boolean, value double"


def assert_schema(df: DataFrame, expected: str) -> DataFrame:
    """Raises if a column is missing or of another type; more columns are fine. Returns ``df``."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for f in StructType.fromDDL(expected).fields:
        if have.get(f.name) != f.dataType.simpleString():
            raise ValueError(f"column {f.name}: expected {f.dataType.simpleString()}, found {have.get(f.name)}")
    return df


def missing_in(df: DataFrame, expected: str) -> list[str]:
    """Names of expected columns that ``df`` lacks."""
    return [f.name for f in StructType.fromDDL(expected).fields if f.name not in df.columns]
