"""Reports over the chunk store; ``as_of`` takes the place of the current time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS_PER_RECORD = 8.63
TARGET = 86_300_000
# fixed values: rows up to -> name of the size
SCALES = [(100_000, "Small"), (1_000_000, "Medium"), (10_000_000, "Large"), (100_000_000, "Very Large")]


def scale_name(rows: Column) -> Column:
    out = F.when(rows < SCALES[0][0], SCALES[0][1])
    for most, name in SCALES[1:]:
        out = out.when(rows < most, name)
    return out.otherwise("Massive")


def since(ts: Column, as_of: datetime, hours: int) -> Column:
    return F.count_if((ts > F.lit(as_of) - F.expr(f"INTERVAL {hours} HOURS")) & (ts <= F.lit(as_of)))


def growth(df: DataFrame, ts: str, as_of: datetime, target: int = TARGET) -> DataFrame:
    """One row: rows in all, of the last day, hour and week, rate per hour, days until ``target`` at the rate of the day and week."""
    t = F.col(ts)
    g = df.agg(F.count("*").alias("total"), since(t, as_of, 24).alias("last_24h"), since(t, as_of, 1).alias("last_1h"), since(t, as_of, 168).alias("last_7d"))
    return g.select(
        "total", "last_24h", "last_1h", "last_7d", F.round(F.col("last_24h") / 24.0, 4).alias("per_hour"), F.round(F.try_divide(F.lit(float(target)) - F.col("total"), F.col("last_24h")), 4).alias("days_to_target"),
        F.round(F.try_divide((F.lit(float(target)) - F.col("total")) * 7.0, F.col("last_7d")), 4).alias("days_to_target_week"),
    )


def hourly(df: DataFrame, ts: str, low: int, high: int, last: int = 24) -> DataFrame:
    """Rows per hour with a load status, the latest hours first."""
    g = df.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(F.count("*").alias("n"))
    per_batch = F.floor(F.col("n") / 12)
    status = F.when(per_batch > high, "High load").when(per_batch < low, "Below target").otherwise("On track")
    return g.select("hour", "n", per_batch.alias("per_5min"), status.alias("status")).orderBy(F.desc("hour")).limit(last)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """``(record_type, chunks, records, chunks_per_record)``."""
    g = chunks.groupBy("record_type").agg(F.count("*").alias("chunks"), F.count_distinct("record_uri").alias("records"))
    return g.withColumn("chunks_per_record", F.round(F.try_divide(F.col("chunks").cast("double"), F.col("records")), 4))


def share(df: DataFrame, by: str, size: Column) -> DataFrame:
    """Summed size of each group and its share of the total; the total comes from the grouped rows, not from a second scan."""
    g = df.groupBy(by).agg(F.sum(size).alias("size"))
    total = g.agg(F.sum("size").alias("total"))  # one row
    return g.join(F.broadcast(total)).select(by, "size", F.round(100.0 * F.col("size") / F.col("total"), 4).alias("pct"))


def summary(chunks: DataFrame) -> DataFrame:
    """``(metric, value)`` rows from one scan."""
    a = chunks.agg(F.count("*").alias("n"), F.count_distinct("record_uri").alias("r"), F.max("total_chunks").alias("m"), F.count_if(F.col("vector").isNull()).alias("v"))
    names = {"Total Chunks": "n", "Total Records": "r", "Largest Record": "m", "Without Vector": "v"}
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).cast("string").alias("value")) for k, c in names.items()])
    return a.select(F.inline(pairs))


def collection(chunks: DataFrame) -> DataFrame:
    """``(chunks, records, latest)``: size of the store and when it was last indexed."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("record_uri").alias("records"), F.max("indexed_at").alias("latest"))


def sizes(chunks: DataFrame, by: str = "record_type") -> DataFrame:
    """Count, distinct records, mean, smallest and largest size of contents per group."""
    n = F.length(F.coalesce("chunk_content", F.lit("")))
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.count_distinct("record_uri").alias("records"), F.round(F.avg(n), 4).alias("mean"), F.min(n).alias("smallest"), F.max(n).alias("largest"))


# fixed values: rows up to -> advice on the cell index
ADVICE = [(1_000_000, "OK - lists=100"), (10_000_000, "REBUILD RECOMMENDED - Use lists=1000-2000"), (50_000_000, "REBUILD RECOMMENDED - Use lists=2000-3000")]
MOST_ADVICE = "REBUILD RECOMMENDED - Use lists=3000-5000"


def advice(rows: Column) -> Column:
    out = F.when(rows < ADVICE[0][0], ADVICE[0][1])
    for most, text in ADVICE[1:]:
        out = out.when(rows < most, text)
    return out.otherwise(MOST_ADVICE)


def maintenance(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: advice on the cell index, rows without postings (``indexed`` is ``(id)``), and the share of replaced rows.

    A replaced row is one whose ``embedding_id`` a later row holds too.
    """
    there = indexed.select("id").distinct().withColumn("_there", F.lit(True))
    a = chunks.select("id", "embedding_id").join(there, "id", "left").agg(F.count("*").alias("n"), F.count_distinct("embedding_id").alias("live"), F.count_if(F.col("_there").isNull()).alias("unindexed"))
    return a.select("n", "unindexed", advice(F.col("n")).alias("advice"), F.round(F.try_divide((F.col("n") - F.col("live")) * 100.0, F.col("live")), 2).alias("replaced_percent"))


def store_files(spark: SparkSession, path: str) -> DataFrame:
    """``(files, bytes, largest)`` of a stored table, from its listing."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("length")
    return f.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("length").alias("largest"))
