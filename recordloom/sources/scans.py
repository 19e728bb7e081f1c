"""Scans of records and chunks: filters that reach Parquet, pages, search conditions of the two search forms."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.dates import parse_date


def scan_records(records: DataFrame, search: str | None = None) -> DataFrame:
    """Records whose title holds the words of ``search`` (all for blank or ``*``), typed dates, a container flag, by date then uri."""
    df = records.withColumn("created", parse_date("date_created")).withColumn("modified", parse_date("date_modified"))
    if search and search.strip() not in ("", "*"):
        for w in search.split():
            df = df.where(F.contains(F.lower("title"), F.lit(w.lower())))
    return df.withColumn("container_flag", F.lower(F.coalesce("is_container", F.lit(""))) == "container")


def latest_export(records: DataFrame) -> DataFrame:
    """One row per record: the export with the latest modification."""
    df = records.withColumn("_m", parse_date("date_modified"))
    best = df.groupBy("record_uri").agg(F.max_by(F.struct(*records.columns), F.struct(F.coalesce("_m", F.lit(datetime(1900, 1, 1))), F.coalesce("title", F.lit("")))).alias("b"))
    return best.select([F.col(f"b.{c}") for c in records.columns])


def changed_since(records: DataFrame, since: date | datetime | None) -> DataFrame:
    """Records modified on the day ``since`` or later; all without a day."""
    df = records.withColumn("modified", parse_date("date_modified"))
    return df.where(F.to_date("modified") >= F.lit(since if not isinstance(since, datetime) else since.date())) if since else df


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number`` from 0 in the given order; past the end it is empty. Planned as one bounded top-n."""
    return df.orderBy(*order).offset(number * size).limit(size)


def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == value)


def record_by_any_key(records: DataFrame, key: str) -> DataFrame:
    """One record by the first form of the key that finds one: uri, record number, bare title, number at the end of the title.

    A prefix ``uri:``, ``recnum:`` or ``number:`` asks for that form alone. The uri is compared as a number, so the
    condition reaches the scan.
    """
    form, _, rest = key.partition(":") if re.match(r"(uri|recnum|number):", key) else ("", "", key)
    rest = rest.strip()
    whole = int(rest) if re.fullmatch(r"\d{1,18}", rest) else None
    stem = F.regexp_replace("title", r"\.[^./\\]+$", "")
    forms = [("uri", F.lit(False) if whole is None else F.col("record_uri") == whole), ("recnum", stem == rest), ("", F.col("title") == rest), ("number", stem.endswith(F.lit(rest)) & F.lit(rest != ""))]
    place = F.lit(None).cast("int")
    for n, (name, found) in reversed(list(enumerate(forms))):
        if form in ("", name):
            place = F.when(found, n).otherwise(place)
    hits = records.withColumn("_p", place).where("_p is not null")
    return hits.orderBy("_p", "record_uri", "date_modified").limit(1).drop("_p")


def sequence_range(chunks: DataFrame, uri: int, low: int, high: int) -> DataFrame:
    return chunks.where((F.col("record_uri") == uri) & F.col("chunk_sequence").between(low, high)).orderBy("chunk_sequence", "id")


def first_rows(chunks: DataFrame, n: int = 100) -> DataFrame:
    return chunks.orderBy("id").limit(n)


def search_predicate(uri: int | None = None, start: datetime | None = None, end: datetime | None = None, phrases: list[str] | None = None, extensions: list[str] | None = None, content: str = "chunk_content", created: str = "date_created") -> Column:
    """The one condition of highest priority that is given: uri, dates, words of the content, first extension, else all."""
    if uri is not None:
        return F.col("record_uri") == uri
    if start is not None or end is not None:
        return F.col(created).between(F.lit(start or datetime(1900, 1, 1)), F.lit(end or datetime(9999, 12, 31)))
    kept = [p for p in phrases or [] if len(p) > 2]
    if kept:
        out = F.lit(False)
        for p in kept:
            out = out | F.contains(F.lower(F.col(content)), F.lit(p.lower()))
        return out
    if extensions:
        return F.lower("file_extension") == "." + extensions[0].lstrip(".").lower()
    return F.lit(True)


def advanced_filter(chunks: DataFrame, uri: int | None = None, container: str | None = None, title: str | None = None, start: date | None = None, end: date | None = None, content: str | None = None, top_k: int = 20) -> DataFrame:
    """First hits of the condition of highest priority, with score 1; a single date means that day."""
    c = F.lit(True)
    if uri is not None:
        c = F.col("record_uri") == uri
    elif container:
        c = F.startswith("container", F.lit(container))
    elif title:
        c = F.contains(F.lower("record_title"), F.lit(title.lower()))
    elif start or end:
        c = F.to_date("date_created").between(F.lit(start or end), F.lit(end or start))
    elif content:
        c = F.contains(F.lower("chunk_content"), F.lit(content.lower()))
    return chunks.where(c).withColumn("score", F.lit(1.0)).orderBy("id").limit(top_k)


def search_string(query: str | None, start: date | None = None, end: date | None = None, types: list[str] | None = None, most_days: int = 31) -> str:
    """Search text of the source system: content, a list of days (the first alone beyond a month) and extensions."""
    parts = []
    if query and query.strip():
        parts.append(f"content:{query.strip()}")
    if start:
        last = end or start
        days = [start + timedelta(n) for n in range((last - start).days + 1)] if (last - start).days < most_days else [start]
        parts.append("(" + " or ".join(f"createdOn:{d:%m/%d/%Y}" for d in days) + ")")
    if types:
        parts.append("(" + " or ".join(f"extension:{t.lstrip('.')}" for t in types) + ")")
    return " and ".join(parts) or "number:*"


def discover_properties(df: DataFrame, column: str) -> DataFrame:
    """``(property, rows)``: keys of a JSON column and in how many rows they occur."""
    keys = F.explode(F.map_keys(F.from_json(F.col(column), "map<string,string>")))
    return df.select(keys.alias("property")).groupBy("property").agg(F.count("*").alias("rows"))


def dummy_embeddings(spark: SparkSession, count: int, dim: int = 64, seed: int = 1) -> DataFrame:
    """Synthetic chunks with uniform vectors in [-1, 1]."""
    base = spark.range(count).withColumn("record_uri", F.col("id") + 1000)
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), j), F.lit(1_000_003)) / F.lit(500_001.0) - 1).cast("float"))
    return base.select("id", F.concat(F.lit("cm_record_"), F.col("record_uri"), F.lit("_chunk_0")).alias("embedding_id"), "record_uri", vector.alias("vector"), F.lit(0).alias("chunk_index"))
