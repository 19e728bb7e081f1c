"""One object over a stored collection: ingest, search, questions, deletes and reports.

The chunks lie in buckets of records, their postings in segments, one for each ingest. A posting counts while its chunk
is the one that was indexed with it, so replaced and deleted chunks are never found; :meth:`Engine.compact` merges the
segments. Access tables are optional; with them a search needs a user and shows only what that user may see.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.models import Embedder, ExtractiveGenerator, Generator, HashingEmbedder
from recordloom.operators import acl, context, filters, lexical, store
from recordloom.plans import monitor, search
from recordloom.session import stage
from recordloom.sources import scans
from recordloom.streaming.sync import SyncJob, SyncResult

# fixed values: column -> field class
FIELDS = {"record_title": "A", "chunk_content": "B", "document_category": "C", "record_type": "C", "container": "D", "assignee": "D", "file_type": "D"}


@dataclass
class Access:
    """Tables of access rules."""

    record_acl: DataFrame
    members: DataFrame
    user_groups: DataFrame


class Engine:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, generator: Generator | None = None, access: Access | None = None, buckets: int = 256):
        self.spark, self.path, self.access = spark, path.rstrip("/"), access
        self.embedder, self.generator = embedder or HashingEmbedder(), generator or ExtractiveGenerator()
        self.job = SyncJob(spark, "ingest", self.path, self.embedder, buckets)

    # ---- content

    def chunks(self) -> DataFrame:
        """All chunks; raises LookupError before the first ingest."""
        got = self.job.store.read()
        if got is None:
            raise LookupError(f"nothing is stored at {self.path}")
        return got

    def ingest(self, source: DataFrame, bodies: DataFrame | None, clock: Callable[[], datetime], full: bool = False) -> SyncResult:
        """Take in changed records and index their chunks."""
        times: list[datetime] = []

        def ticking() -> datetime:
            times.append(clock())
            return times[-1]

        result = self.job.run(source, bodies, ticking, full=full)
        if result.chunks:
            self._add_segment(self.chunks().where(F.col("indexed_at") == F.lit(times[0])), f"{result.version:012d}")
        return result

    def delete(self, uris: DataFrame) -> DataFrame:
        """Delete records; ``(record_uri, deleted, status)`` of each that was asked for."""
        report = stage(store.delete_report(self.chunks().select("record_uri"), uris), "deleted")
        self.job.store.put(report.where("deleted > 0").select("record_uri"), self.chunks().limit(0))
        return report

    def _add_segment(self, rows: DataFrame, name: str) -> None:
        made = lexical.postings(rows, "id", FIELDS, lexical.english_term).join(rows.select("id", "indexed_at"), "id")
        lexical.write_postings(made, f"{self.path}/index/{name}")

    def index(self) -> DataFrame:
        """Postings of the chunks as they are now."""
        schema = "term string, id long, field string, tf int, indexed_at timestamp, bucket int"
        names = self.job.store.list(f"{self.path}/index")
        segments = [self.spark.read.schema(schema).parquet(f"{self.path}/index/{n}") for n in names]
        every = reduce(DataFrame.unionByName, segments) if segments else self.spark.createDataFrame([], schema)
        return every.join(self.chunks().select("id", "indexed_at"), ["id", "indexed_at"], "left_semi").select("term", "id", "field", "tf", "bucket")

    def compact(self) -> int:
        """Merge all segments into one and remove what is no longer used; returns how many segments there were."""
        names = self.job.store.list(f"{self.path}/index")
        made = stage(self.index().drop("bucket").join(self.chunks().select("id", "indexed_at"), "id"), "merged")
        lexical.write_postings(made, f"{self.path}/index/{self.job.store.version():012d}-{uuid.uuid4().hex}")
        for n in names:
            self.job.store.remove(f"{self.path}/index/{n}")
        self.job.store.vacuum()
        return len(names)

    # ---- questions

    def search(self, query: str, now: datetime, top_k: int = 20, min_score: float = 0.3, user: int | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
        """Hits of a query, one per record, best first; without access tables everything is open."""
        a = self.access
        s = search.Store(self.chunks(), self.index(), a.record_acl if a else None, a.members if a else None, a.user_groups if a else None)
        return search.search(s, query, lambda q: self.embedder.embed([q])[0], now, top_k, min_score, user, metadata, filter_first=True)

    def answer(self, hits: DataFrame, question: str) -> str:
        """An answer from the best hits of a search."""
        prompt = context.synthesis_prompt(hits, question, "record_title", "chunk_content").first()
        return self.generator.generate(prompt["prompt"])

    def ask(self, uri: int, question: str) -> DataFrame:
        """``(record_uri, prompt, answer, answer_error)`` of a question about one record."""
        own = filters.record_filter(self.chunks(), [uri])
        return context.record_answer(own, self.index(), question, self.embedder.embed([question])[0], self.generator)

    def summary_context(self, uri: int) -> DataFrame:
        """``(record_uri, context)``: the first chunks of a record in order."""
        return context.record_summary_context(filters.record_filter(self.chunks(), [uri]), "record_uri", "chunk_sequence", "chunk_content")

    # ---- reports

    def records(self, source: DataFrame, text: str | None = None) -> DataFrame:
        """Records of the source system whose title holds the words of ``text``."""
        return scans.scan_records(source, text)

    def statistics(self) -> DataFrame:
        return monitor.collection(self.chunks())

    def access_report(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Figures, frequencies of permissions, and different principals of the access table."""
        if self.access is None:
            raise LookupError("there are no access tables")
        rows = self.access.record_acl
        return acl.acl_statistics(rows), acl.permission_frequencies(rows), acl.unique_principals(rows)
