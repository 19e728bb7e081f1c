"""Incremental ingest: change detection, record texts, chunks, vectors and upsert, in micro-batches or one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.functions import dates, text
from recordloom.functions.chunk import chunk_documents
from recordloom.models import Embedder, HashingEmbedder, embed_table
from recordloom.operators import store
from recordloom.session import stage
from recordloom.sources.scans import changed_since, latest_export


def record_rows(records: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """``(record_uri, full_text, ...)`` of exported records; ``bodies`` is ``(record_uri, body)``."""
    r = records.withColumn("created", dates.parse_date("date_created")).withColumn("modified", dates.parse_date("date_modified"))
    r = r.join(bodies, "record_uri", "left") if bodies is not None else r.withColumn("body", F.lit(None).cast("string"))
    kind = F.when(F.lower("is_container") == "container", "Container").otherwise("Document")
    full = text.record_text(F.col("title"), F.col("record_uri"), F.date_format("created", "MM/dd/yyyy HH:mm:ss"), dates.alternative_dates("created"), dates.temporal_context("created"), kind, F.col("container"), F.col("assignee"), F.col("all_parts"), F.lit(None).cast("string"), F.col("body"))
    return r.select("record_uri", "title", "container", "assignee", "all_parts", kind.alias("record_type"), "created", "modified", full.alias("full_text"))


def build_chunks(records: DataFrame, bodies: DataFrame | None, now: datetime, embedder: Embedder | None = None, size: int = 1500, overlap: int = 150) -> DataFrame:
    """Rows of the chunk store for the given records; the header goes into the embedded text only."""
    rows = record_rows(records, bodies)
    cut = chunk_documents(rows, "record_uri", "full_text", size, overlap).withColumnRenamed("id", "record_uri")
    total = cut.groupBy("record_uri").agg(F.count("*").cast("int").alias("total_chunks"))
    c = cut.join(total, "record_uri").join(rows.drop("full_text"), "record_uri")
    head = text.chunk_header(F.col("title"), F.col("record_uri"), F.date_format("created", "MM/dd/yyyy HH:mm:ss"), dates.alternative_dates("created"))
    c = c.withColumn("embed_text", F.concat_ws("\n", head, "content"))
    ext = text.extension("title")
    c = c.select(
        F.xxhash64("record_uri", "chunk_sequence").alias("id"), F.format_string("cm_record_%d_chunk_%d", "record_uri", "chunk_sequence").alias("embedding_id"), "record_uri", F.col("title").alias("record_title"),
        F.col("created").alias("date_created"), F.col("modified").alias("source_date_modified"), "record_type", "container", "assignee", "all_parts", F.col("chunk_sequence").alias("chunk_index"), "chunk_sequence", "total_chunks",
        text.token_estimate("content").alias("token_count"), F.col("start_pos").alias("start_position"), F.col("end_pos").alias("end_position"), "page_number", F.col("content").alias("chunk_content"), text.preview("content").alias("content_preview"),
        F.nullif(ext, F.lit("")).alias("file_extension"), F.nullif(text.file_type("title"), F.lit("")).alias("file_type"), F.when(ext != "", text.category(ext)).alias("document_category"),
        F.lit("content_manager_record").alias("entity_type"), F.lit(now).alias("indexed_at"), F.lit(now).alias("created_at"), "embed_text",
    )
    return embed_table(c, "embed_text", embedder or HashingEmbedder()).drop("embed_text")


@dataclass
class Sync:
    """What one run over changed records leads to, as plans.

    ``status`` says of each record whether it is new, updated or unchanged; ``rows`` are the chunks of changed
    records that could be embedded as a whole; ``errors`` names each chunk that could not. A record with an error
    keeps its stored state, so the next run tries it again.
    """

    status: DataFrame
    rows: DataFrame
    errors: DataFrame

    def done(self) -> DataFrame:
        """Changed records without an error."""
        changed = self.status.where("status <> 'unchanged'").select("record_uri")
        return changed.join(self.errors.select("record_uri").distinct(), "record_uri", "left_anti")

    def counters(self) -> DataFrame:
        """``(new, updated, unchanged, processed, success, failed)``, one row."""
        failed = self.errors.select("record_uri").distinct().withColumn("bad", F.lit(True))
        s = self.status.join(failed, "record_uri", "left")
        changed = F.col("status") != "unchanged"
        return s.agg(
            *[F.count_if(F.col("status") == n).alias(n) for n in ("new", "updated", "unchanged")],
            F.count_if(changed).alias("processed"), F.count_if(changed & F.col("bad").isNull()).alias("success"), F.count_if(F.col("bad").isNotNull()).alias("failed"),
        )


def bodies_of(documents: DataFrame) -> DataFrame:
    """``(record_uri, body)`` of records from their documents, joined in order of ``doc_id``."""
    parts = documents.where("record_uri is not null and text is not null").groupBy("record_uri").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    return parts.select("record_uri", F.array_join(F.transform("d", lambda x: x["text"]), "\n\n").alias("body"))


def plan_sync(stored: DataFrame, source: DataFrame, bodies: DataFrame | None, now: datetime, embedder: Embedder | None = None, since: datetime | None = None) -> Sync:
    """The run over records exported since ``since``; what is used more than once is staged."""
    source = changed_since(source, since).select(source.columns) if since else source
    status = stage(store.detect_changes(source, stored), "sync-status")
    todo = status.where("status <> 'unchanged'").select("record_uri")
    made = stage(build_chunks(latest_export(source).join(todo, "record_uri", "left_semi"), bodies, now, embedder), "sync-chunks")
    errors = made.where("embed_error is not null").select("record_uri", "embedding_id", "embed_error", F.lit(now).alias("at"))
    rows = made.join(errors.select("record_uri").distinct(), "record_uri", "left_anti").drop("embed_error")
    return Sync(status, rows, errors)


def sync_once(stored: DataFrame, source: DataFrame, bodies: DataFrame | None, now: datetime, embedder: Embedder | None = None) -> tuple[DataFrame, Sync]:
    """``(next state of the store, the run)``: changed records are replaced as a whole, others stay."""
    run = plan_sync(stored, source, bodies, now, embedder)
    old = stored.join(run.done(), "record_uri", "left_anti")
    columns = [c for c in stored.columns if c in run.rows.columns]
    return old.select(columns).unionByName(run.rows.select(columns)), run


class Cancelled(Exception):
    """Raised inside a run when it was asked to stop."""


@dataclass
class SyncResult:
    """Outcome of a run: status Completed, Cancelled or Failed, and its counters."""

    status: str
    counters: dict[str, int] = field(default_factory=dict)
    chunks: int = 0
    version: int = 0
    error: str | None = None


class SyncJob:
    """A named job over a stored table: checkpoint row, high-water mark, dead-letter rows, result object.

    State lies beside the table: ``checkpoint`` holds the changes of the job's row, the latest of which counts, and
    ``errors`` the dead-letter rows of all runs.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, embedder: Embedder | None = None, buckets: int = 256):
        self.spark, self.name, self.path, self.embedder = spark, name, path.rstrip("/"), embedder
        self.store = store.BucketStore(spark, f"{self.path}/chunks", buckets)

    def checkpoint(self, now: datetime) -> dict[str, object]:
        """The job's latest row; one that has never run where there is none."""
        state = self.spark.createDataFrame([], store.CHECKPOINT)
        if self.store.has(f"{self.path}/checkpoint"):
            state = store.update_checkpoint(state, self.spark.read.schema(store.CHECKPOINT).json(f"{self.path}/checkpoint"))
        return store.checkpoint_or_new(state, self.name, now).first().asDict()

    def _mark(self, row: dict[str, object], **changes: object) -> None:
        new = row | changes
        self.spark.createDataFrame([tuple(new[f.split()[0]] for f in store.CHECKPOINT.split(", "))], store.CHECKPOINT).coalesce(1).write.mode("append").json(f"{self.path}/checkpoint")

    def run(self, source: DataFrame, bodies: DataFrame | None, clock: Callable[[], datetime], stop: Callable[[], bool] = lambda: False, full: bool = False) -> SyncResult:
        """One run; records not modified since the day of the last completed run are not looked at, unless ``full``."""
        began = clock()
        row = self.checkpoint(began)
        self._mark(row, status="Running", updated_at=began)
        try:
            stored = self.store.read()
            none = self.spark.createDataFrame([], "record_uri long, source_date_modified timestamp")
            run = plan_sync(none if stored is None else stored.select("record_uri", "source_date_modified"), source, bodies, began, self.embedder, None if full else row["last_sync_date"])
            counters = run.counters().first().asDict()
            if stop():
                raise Cancelled
            if counters["failed"]:
                run.errors.write.mode("append").parquet(f"{self.path}/errors")
            version = self.store.put(stage(run.done(), "sync-done"), run.rows) if counters["success"] else self.store.version()
            result = SyncResult("Completed", counters, run.rows.count(), version)
        except Cancelled:
            self._mark(row, status="Cancelled", updated_at=clock())
            return SyncResult("Cancelled")
        except Exception as x:
            self._mark(row, status="Failed", error=f"{type(x).__name__}: {x}"[:500], updated_at=clock())
            return SyncResult("Failed", error=f"{type(x).__name__}: {x}"[:500])
        # records that failed lie before the mark and are tried again, so the mark stays where it was
        mark = row["last_sync_date"] if counters["failed"] else began
        self._mark(row, status="Completed", last_sync_date=mark, last_page=0, total=counters["processed"], success=counters["success"], failed=counters["failed"], error=None, updated_at=clock())
        return result

    def failed_records(self, most: int = 20) -> DataFrame:
        """The latest dead-letter rows."""
        if not self.store.has(f"{self.path}/errors"):
            return self.spark.createDataFrame([], "record_uri long, embedding_id string, embed_error string, at timestamp")
        return self.spark.read.parquet(f"{self.path}/errors").orderBy(F.desc("at"), "embedding_id").limit(most)

    def stream(self, source_path: str, schema: str, offsets: str, clock: Callable[[], datetime], bodies: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None) -> StreamingQuery:
        """Runs per micro-batch of exported records; offsets live in ``offsets``.

        A batch that is run again finds its records unchanged. Without ``every`` the stream ends when all files that
        are there have been read.
        """

        def batch(df: DataFrame, epoch: int) -> None:
            result = self.run(df, bodies(df) if bodies else None, clock, full=True)
            if result.status == "Failed":
                raise RuntimeError(result.error)

        writer = self.spark.readStream.schema(schema).parquet(source_path).writeStream.foreachBatch(batch).option("checkpointLocation", offsets)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Scheduler:
    """Status, pause, resume, reschedule and one-off runs of a named stream; two runs never overlap.

    ``start`` gets the interval, or None for a run that ends when everything has been read.
    """

    def __init__(self, start: Callable[[str | None], StreamingQuery], every: str | None = None):
        self._start = start
        self._query: StreamingQuery | None = None
        self.enabled, self.every = True, every

    @property
    def running(self) -> bool:
        return self._query is not None and self._query.isActive

    def trigger(self) -> bool:
        """Start a run unless one is active or the schedule is off."""
        if not self.enabled or self.running:
            return False
        self._query = self._start(self.every)
        return True

    def reschedule(self, every: str | None) -> bool:
        """Change the interval; an active schedule goes on with the new one after its current batch."""
        self.every = every
        if not self.running:
            return False
        self._query.stop()
        self._query = self._start(every) if self.enabled else None
        return self._query is not None

    def pause(self) -> None:
        self.enabled = False
        if self.running:
            self._query.stop()

    def resume(self) -> None:
        self.enabled = True

    def status(self) -> dict[str, object]:
        return {"enabled": self.enabled, "every": self.every, "running": self.running, "last_progress": self._query.lastProgress if self._query else None}

    def wait(self) -> None:
        if self._query is not None:
            self._query.awaitTermination()
