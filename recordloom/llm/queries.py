"""Queries over the test tables for the operators of this subpackage; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import chunking, leakage, mixing, near_dup, scan_repair, truncation, vector_lists
from recordloom.session import stage, table

DIM = 64


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.scan_damage(table(spark, sf_dir, "record_chunks"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.repair_scans(table(spark, sf_dir, "record_chunks")).select("id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.similar_records(table(spark, sf_dir, "record_chunks"), 0.7, 3)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.similar_groups(table(spark, sf_dir, "record_chunks"), 0.7, 3)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_oversized(table(spark, sf_dir, "record_chunks")).where("piece = 0").select("id")


def p3_rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.rechunk(table(spark, sf_dir, "record_chunks"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(vector_lists.unit_vectors(table(spark, sf_dir, "record_chunks"), "embedding_id", "vector", "id", DIM), "unit-vectors")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    probes = table(spark, sf_dir, "knn_probes").select(F.col("embedding_id").alias("id")).distinct()
    hits = vector_lists.nearest(vectors, vectors.join(probes, "id", "left_semi"), 10, DIM)
    return hits.select(F.least("query", "id").alias("embedding_id_a"), F.greatest("query", "id").alias("embedding_id_b")).distinct()


def p4_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the vectors of every row whose id is divisible by 50, against all vectors."""
    vectors = _vectors(spark, sf_dir)
    asked = table(spark, sf_dir, "record_chunks").where("id % 50 = 0").select(F.col("embedding_id").alias("id")).distinct()
    return vector_lists.nearest(vectors, vectors.join(asked, "id", "left_semi"), 10, DIM).select(F.col("query").alias("embedding_id"), F.col("id").alias("neighbor_id"), "rank", F.round(F.col("sim").cast("double"), 4).alias("similarity"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), spans=True)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p8_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_by_source(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (p1_found, p1_repaired, p2_found, p2_groups, p3_found, p3_rechunked, p4_found, p4_neighbors, p6_found, p6_spans, p7_mix, p7_report, p8_found, p8_by_source)
    return {f.__name__: f for f in names}


_SHINGLES = r"""texts AS (
  SELECT DISTINCT record_uri, record_title AS t FROM record_chunks WHERE record_uri IS NOT NULL
  UNION SELECT record_uri, chunk_content FROM record_chunks WHERE record_uri IS NOT NULL),
w AS (SELECT record_uri, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS ws FROM texts WHERE t IS NOT NULL),
g AS (SELECT DISTINCT record_uri, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) AS s FROM w),
n AS (SELECT record_uri, count(*) AS n FROM g GROUP BY 1),
rare AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT a.record_uri AS x, b.record_uri AS y FROM g a JOIN rare USING (s) JOIN g b USING (s) WHERE a.record_uri < b.record_uri),
o AS (SELECT x, y, count(*) AS o FROM c JOIN g a ON a.record_uri = x JOIN g b ON b.record_uri = y AND b.s = a.s GROUP BY 1, 2),
pairs AS (SELECT x, y, o = a.n AND o = b.n AS same FROM o JOIN n a ON a.record_uri = x JOIN n b ON b.record_uri = y WHERE 10 * o >= 7 * (a.n + b.n - o))"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express on whole tables; the other queries are tested against brute force or round trips."""
    return {
        "p3_found": "SELECT id FROM record_chunks WHERE length(chunk_content) > 6000",
        "p2_found": f"WITH {_SHINGLES} SELECT x AS record_uri_a, y AS record_uri_b FROM pairs",
        "p2_groups": f"""WITH RECURSIVE {_SHINGLES},
links AS (SELECT x AS a, y AS b, same FROM pairs UNION ALL SELECT y, x, same FROM pairs),
reach AS (SELECT record_uri AS a, record_uri AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
groups AS (SELECT a, min(b) AS group_id FROM reach GROUP BY 1),
own AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE same) AS twin FROM links GROUP BY 1)
SELECT record_uri, least(record_uri, coalesce(twin, record_uri)) AS class_id, group_id, coalesce(n_links, 0) AS n_links FROM n JOIN groups ON groups.a = record_uri LEFT JOIN own ON own.a = record_uri""",
    }
