"""Filters of search hits: dates, file types, metadata, and the fallback when a date range leaves nothing."""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: file types -> further words in title, content or category that stand for them
SYNONYMS = {
    ("pdf",): (["pdf"], ["portable document"], ["pdf"]),
    ("docx", "doc"): (["word"], ["microsoft word"], ["word"]),
    ("xlsx", "xls"): (["excel"], ["microsoft excel", "spreadsheet"], ["excel"]),
    ("pptx", "ppt"): (["powerpoint"], ["microsoft powerpoint", "presentation"], ["powerpoint"]),
}
ENTITY = "content_manager_record"


def in_range(ts: Column, start: datetime | None, end: datetime | None) -> Column:
    """Whether a timestamp lies in a range; a bound at midnight is compared by day, others exactly; null timestamps do not."""
    ok = ts.isNotNull()
    if start is not None:
        ok = ok & (F.to_date(ts) >= F.lit(start.date()) if start.time() == time(0) else ts >= F.lit(start))
    if end is not None:
        ok = ok & (F.to_date(ts) <= F.lit(end.date()) if end.time() == time(0) else ts <= F.lit(end))
    return ok


def date_filter(hits: DataFrame, column: str, start: datetime | None, end: datetime | None, fallback: bool = False) -> DataFrame:
    """Hits in the range; with ``fallback`` all hits when none is, found by one aggregate beside the hits."""
    if start is None and end is None:
        return hits
    ok = in_range(F.col(column), start, end)
    if not fallback:
        return hits.where(ok)
    marked = hits.withColumn("_in", ok)
    some = marked.agg(F.coalesce(F.max("_in"), F.lit(False)).alias("_some"))  # one row
    return marked.join(F.broadcast(some)).where(F.col("_in") | ~F.col("_some")).drop("_in", "_some")


def metadata_filter(hits: DataFrame, wanted: dict[str, str], bag: str | None = None) -> DataFrame:
    """Hits whose columns, or keys of the map ``bag``, equal the wanted values whatever the case; a missing key drops the hit."""
    for k, v in wanted.items():
        have = F.try_element_at(F.col(bag), F.lit(k)) if bag else F.col(k)
        hits = hits.where(F.lower(have.cast("string")) == v.lower())
    return hits


def _has(c: Column, word: str) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word.lower()))


def file_type_filter(hits: DataFrame, types: list[str], content: str = "chunk_content") -> DataFrame:
    """Documents of the types, by extension, type, category, title, mention in the content, or words that stand for them; containers never."""
    if not types:
        return hits
    ok = F.lit(False)
    title, text, cat = F.col("record_title"), F.col(content), F.col("document_category")
    for t in types:
        ext = "." + t.lower()
        ok = ok | (F.lower(F.coalesce("file_extension", F.lit(""))) == ext) | (F.lower(F.coalesce("file_type", F.lit(""))) == t.lower()) | _has(cat, t)
        ok = ok | F.lower(F.coalesce(title, F.lit(""))).endswith(ext) | _has(text, t)
        for names, (in_title, in_text, in_cat) in SYNONYMS.items():
            if t in names:
                for where, words in ((title, in_title), (text, in_text), (cat, in_cat)):
                    for w in words:
                        ok = ok | _has(where, w)
    return hits.where((F.lower(F.coalesce("record_type", F.lit(""))) != "container") & ok)


def entity_filter(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("entity_type") == ENTITY)


def record_filter(df: DataFrame, uris: list[int] | DataFrame, column: str = "record_uri") -> DataFrame:
    """Rows of the given records: an IN list that reaches the scan, or a semi join with a table of records."""
    return df.where(F.col(column).isin(uris)) if isinstance(uris, list) else df.join(uris, column, "left_semi")


def clamp_request(query: str | None, top_k: int, min_score: float, advanced: bool = False) -> tuple[int, float]:
    """Request limits: 1 to 100 hits, scores from 0 to 1; a blank query needs an advanced filter."""
    if not advanced and not (query or "").strip():
        raise ValueError("Query cannot be empty")
    return max(1, min(100, top_k)), max(0.0, min(1.0, min_score))
