"""The chunk store: upserts, deletes, backfill, archive, checkpoints and change detection as plans over tables.

Parquet has no row updates, so a change makes the next state of a table as a plan. :class:`BucketStore` keeps a table
in buckets of records and writes only buckets that change; a manifest says which files are current and is put in place
by one rename, so readers see the old state or the new one. Keys that repeat in the new rows count once, by the latest
``created_at``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.dates import parse_date

CHECKPOINT = "job_name string, last_sync_date timestamp, last_page int, status string, total long, success long, failed long, error string, created_at timestamp, updated_at timestamp"


def latest_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the one with the largest order columns; an aggregate, so hot keys are reduced before the shuffle."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("b"))
    return best.select([F.col(f"b.{c}") for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, key: str = "embedding_id", keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """The old rows that are not replaced and the new ones; a replaced row keeps its ``id`` and ``created_at``."""
    new = latest_by_key(new, key, ["created_at", "id"])
    kept = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    merged = new.join(kept, key, "left").select([F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new.select(key), key, "left_anti").unionByName(merged)


def delete_by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def delete_records(df: DataFrame, uris: DataFrame, record: str = "record_uri") -> DataFrame:
    """Rows of other records; rows without record stay."""
    return df.join(uris.select(record).distinct(), record, "left_anti")


def delete_report(df: DataFrame, uris: DataFrame, record: str = "record_uri") -> DataFrame:
    """``(record, deleted, status)`` of each requested record: how many rows go, not_found for none."""
    held = df.groupBy(record).agg(F.count("*").alias("deleted"))
    asked = uris.select(record).distinct().join(held, record, "left")
    return asked.select(record, F.coalesce("deleted", F.lit(0)).alias("deleted")).withColumn("status", F.when(F.col("deleted") > 0, "deleted").otherwise("not_found"))


def delete_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("records"), F.sum("deleted").alias("chunks"))


def backfill_modified(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Chunks whose missing ``source_date_modified`` is taken from their record's latest modification."""
    latest = records.select("record_uri", parse_date("date_modified").alias("m")).groupBy("record_uri").agg(F.max("m").alias("_m"))
    return chunks.join(latest, "record_uri", "left").withColumn("source_date_modified", F.coalesce("source_date_modified", "_m")).drop("_m")


def detect_changes(source: DataFrame, stored: DataFrame) -> DataFrame:
    """``(record_uri, status)``: new, updated or unchanged, of the source's latest export of each record.

    Updated means a later modification than any stored one, or one that is missing on either side.
    """
    src = source.select("record_uri", parse_date("date_modified").alias("m")).groupBy("record_uri").agg(F.max("m").alias("src"))
    old = stored.groupBy("record_uri").agg(F.max("source_date_modified").alias("old"), F.lit(True).alias("there"))
    joined = src.join(old, "record_uri", "left")
    status = F.when(F.col("there").isNull(), "new").when(F.col("src").isNull() | F.col("old").isNull() | (F.col("src") > F.col("old")), "updated").otherwise("unchanged")
    return joined.select("record_uri", status.alias("status"))


def split_archive(df: DataFrame, as_of: datetime, years: int = 2, column: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """Hot and cold rows; rows without a date are hot."""
    cold = F.coalesce(F.col(column) < F.add_months(F.lit(as_of), -12 * years).cast("timestamp"), F.lit(False))
    return df.where(~cold), df.where(cold)


def archive(df: DataFrame, as_of: datetime, cold_path: str, years: int = 2, column: str = "created_at") -> DataFrame:
    """Append the cold rows to an archive by month and return the hot ones, the next state of the table.

    A run that is repeated leaves rows out that the archive holds already, by ``id``.
    """
    spark = df.sparkSession
    hot, cold = split_archive(df, as_of, years, column)
    path = spark._jvm.org.apache.hadoop.fs.Path(cold_path)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        cold = cold.join(spark.read.parquet(cold_path).select("id"), "id", "left_anti")
    cold.withColumn("month", F.date_format(column, "yyyy-MM")).repartition("month").write.mode("append").partitionBy("month").parquet(cold_path)
    return hot


def update_checkpoint(state: DataFrame, change: DataFrame) -> DataFrame:
    """The next state of the checkpoints: the latest row of each job by ``updated_at``; the first ``created_at`` stays."""
    both = state.unionByName(change)
    first = both.groupBy("job_name").agg(F.min("created_at").alias("_c"))
    return latest_by_key(both, "job_name", ["updated_at"]).join(first, "job_name").withColumn("created_at", F.col("_c")).select(state.columns)


def checkpoint_or_new(state: DataFrame, job: str, now: datetime) -> DataFrame:
    """The row of a job, or a fresh one that has never run."""
    spark = state.sparkSession
    fresh = spark.createDataFrame([(job, None, 0, "Never Run", 0, 0, 0, None, now, now)], CHECKPOINT)
    found = state.where(F.col("job_name") == job)
    return found.unionByName(fresh.join(found.select("job_name"), "job_name", "left_anti").select(state.columns))


class BucketStore:
    """A table of chunks in buckets by the hash of the record; only touched buckets are rewritten.

    The manifest of a version maps each bucket to the folder that holds it. Two writers cannot both put the same
    version in place: the second one fails.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, record: str = "record_uri"):
        self.spark, self.path, self.buckets, self.record = spark, path.rstrip("/"), buckets, record
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # type: ignore[no-untyped-def]
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, path: str) -> bool:
        """Whether a path exists."""
        return self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(path))

    def list(self, path: str) -> Sequence[str]:
        """Names under a path in order; none where it does not exist."""
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(path))) if self.has(path) else []

    def remove(self, path: str) -> bool:
        return bool(self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.record), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """Number of the current version, 0 before the first."""
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self) -> dict[int, str]:
        """Bucket -> folder of the current version."""
        n = self.version()
        if not n:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{n:012d}", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def read(self, of: Sequence[int] | None = None) -> DataFrame | None:
        """Rows of the given buckets, of all by default; None where there are none."""
        folders = sorted({f"{self.path}/{v}/bucket={k}" for k, v in self.manifest().items() if of is None or k in of})
        return self.spark.read.parquet(*folders) if folders else None

    def put(self, changed: DataFrame, rows: DataFrame) -> int:
        """Replace the records of ``changed`` by ``rows`` (which may hold none of a record); returns the new version."""
        touched = sorted(r[0] for r in changed.select(self.bucket()).union(rows.select(self.bucket())).distinct().collect())  # one row per bucket at most
        now = self.manifest()
        old = self.read(touched)
        state = rows if old is None else old.join(changed.select(self.record).distinct(), self.record, "left_anti").select(rows.columns).unionByName(rows)
        name = f"data/{uuid.uuid4().hex}"
        state.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        there = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(self._path(name)) if f.getPath().getName().startswith("bucket=")}
        nxt = {k: v for k, v in now.items() if k not in touched} | {k: name for k in there}
        return self._commit(nxt)

    def _commit(self, manifest: dict[int, str]) -> int:
        n = self.version() + 1
        self._fs.mkdirs(self._path("manifests"))
        side, final = self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(f"manifests/{n:012d}")
        out = self._fs.create(side, False)
        out.write(bytearray(json.dumps({str(k): v for k, v in sorted(manifest.items())}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(side, final):
            self._fs.delete(side, False)
            raise RuntimeError(f"version {n} was written by another run")
        return n

    def vacuum(self) -> int:
        """Remove buckets that the current version does not use and older manifests; returns how many buckets went."""
        used, n = {(k, v) for k, v in self.manifest().items()}, self.version()
        gone = 0
        for f in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            name = f"data/{f.getPath().getName()}"
            for b in self._fs.listStatus(f.getPath()):
                of = b.getPath().getName().removeprefix("bucket=")
                if of.isdigit() and (int(of), name) not in used:
                    gone += bool(self._fs.delete(b.getPath(), True))
            if name not in {v for _, v in used}:
                self._fs.delete(f.getPath(), True)
        for f in self._fs.listStatus(self._path("manifests")) if n else []:
            if f.getPath().getName() != f"{n:012d}":
                self._fs.delete(f.getPath(), False)
        return gone


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per vector, the layout of the file store."""
    df.write.mode("append").json(path)


def delete_json_document(df: DataFrame, document: str) -> DataFrame:
    """Vectors of the file store without those of a document."""
    return df.where(~F.coalesce(F.try_element_at("metadata", F.lit("document_id")) == document, F.lit(False)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of the file store; malformed lines are skipped."""
    return spark.read.schema("id string, vector array<float>, metadata map<string,string>, created_at timestamp").option("mode", "DROPMALFORMED").json(path)
