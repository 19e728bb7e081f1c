"""The core's queries over the test tables and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import chunk, dates, intent, text
from recordloom.models import ExtractiveGenerator, HashingEmbedder
from recordloom.operators import acl, context, filters, hybrid, lexical, store, vector
from recordloom.operators.packed import split_packed
from recordloom.plans import golden, monitor
from recordloom.plans import search as pipeline
from recordloom.session import session_path, table
from recordloom.sources import scans
from recordloom.streaming import windows
from recordloom.streaming.sync import Sync, bodies_of, sync_once

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
AS_OF = datetime(2024, 1, 20, 12, 0, 0)
QUESTION = "cost of timber"
TERMS = ["cost", "of", "timber"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return _QUERIES | golden.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | golden.oracle_sql()


# ---- packed values -----------------------------------------------------------------------------------------


_PACKED = r"""WITH r AS (SELECT 'record_acl' AS src, id AS row_id, raw_acl_string AS raw FROM record_acl WHERE raw_acl_string IS NOT NULL UNION ALL SELECT 'record_chunks' AS src, id AS row_id, acl AS raw FROM record_chunks WHERE acl IS NOT NULL),
t AS (SELECT *, regexp_replace(raw, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS s FROM r),
e AS (SELECT src, row_id, regexp_full_match(s, '(?s)\{.*\}|\[.*\]') AS boxed, CASE WHEN regexp_full_match(s, '(?s)\{.*\}|\[.*\]') THEN s[2:-2] ELSE s END AS s FROM t),
p AS (SELECT src, row_id, boxed, regexp_extract_all(',' || s, '[,;|\t\n\r]((?:[^,;|\t\n\r"'':]*:)?[ \x{a0}]*(?:"(?:[^"\\]|""|\\.)*"|''(?:[^''\\]|''''|\\.)*''|[^,;|\t\n\r]*)[ \x{a0}]*)', 1) AS vs FROM e),
q AS (SELECT src, row_id, [x FOR x IN [regexp_replace(CASE WHEN regexp_matches(v, '(?s)^[^"'']*".*"[ \x{a0}]*$') THEN replace(regexp_replace(CASE WHEN boxed THEN regexp_replace(v, '\\(.)', '\1', 'g') ELSE v END, '(?s)^([^"'']*)"(.*)"[ \x{a0}]*$', '\1\2'), '""', '"') WHEN regexp_matches(v, '(?s)^[^"'']*''.*''[ \x{a0}]*$') THEN replace(regexp_replace(CASE WHEN boxed THEN regexp_replace(v, '\\(.)', '\1', 'g') ELSE v END, '(?s)^([^"'']*)''(.*)''[ \x{a0}]*$', '\1\2'), '''''', '''') ELSE v END, '^[ \x{a0}]+|[ \x{a0}]+$', '', 'g') FOR v IN vs] IF x <> ''] AS vs FROM p)
SELECT src, row_id, unnest(range(1, len(vs) + 1))::INTEGER AS pos, unnest(vs) AS val FROM q WHERE len(vs) >= """


def _packed(least: int) -> str:
    """Values of the packed fields by patterns, of fields that hold at least ``least``."""
    return f"{_PACKED}{least}"


@query(_packed(2))
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the fields that hold two or more."""
    a = split_packed(table(spark, sf_dir, "record_acl"), "id", "raw_acl_string", least=2)
    c = split_packed(table(spark, sf_dir, "record_chunks"), "id", "acl", least=2)
    return a.select(F.lit("record_acl").alias("src"), "row_id", "pos", "val").union(c.select(F.lit("record_chunks").alias("src"), "row_id", "pos", "val"))


@query(_packed(1))
def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all fields, single ones too."""
    a = split_packed(table(spark, sf_dir, "record_acl"), "id", "raw_acl_string")
    c = split_packed(table(spark, sf_dir, "record_chunks"), "id", "acl")
    return a.select(F.lit("record_acl").alias("src"), "row_id", "pos", "val").union(c.select(F.lit("record_chunks").alias("src"), "row_id", "pos", "val"))


# ---- vector search -----------------------------------------------------------------------------------------

_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"
_COS = "list_cosine_similarity(embedding::DOUBLE[], q)"


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[str], None]) -> str:
    """Path of an index over tables of a folder, built when first asked for and kept as long as the session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _STORED:
        path = session_path(spark, kind)
        build(path)
        _STORED[key] = path
    return _STORED[key]


def _cells(spark: SparkSession, sf_dir: str) -> vector.Cells:
    path = stored(spark, sf_dir, "cells", lambda p: vector.write_cells(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", p, 20))
    return vector.open_cells(spark, path)


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"])


@query(f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings, {_Q} ORDER BY {_COS} DESC, vec_id LIMIT 20")
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vector.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 20, -2.0)
    return hits.select("id", F.round("score", 6).alias("score"))


@query(f"SELECT * FROM (SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings, {_Q} ORDER BY {_COS} DESC, vec_id LIMIT 50) WHERE score >= 0.25")
def knn_threshold_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vector.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 50, 0.25)
    return hits.select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings, {_Q} WHERE {_COS} >= 0.1 ORDER BY {_COS} DESC, vec_id LIMIT 50")
def knn_threshold_before_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vector.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 50, 0.1, before_limit=True)
    return hits.select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings, {_Q} WHERE label = 3 ORDER BY {_COS} DESC, vec_id LIMIT 5")
def knn_record_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = filters.record_filter(table(spark, sf_dir, "embeddings"), [3], "label")
    return vector.top_k(scoped, "vec_id", "embedding", _query_vector(spark, sf_dir), 5, -2.0).select("id", F.round("score", 6).alias("score"))


@query(
    """SELECT query_id, id, round(s, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (
SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 5"""
)
def knn_batch_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = [(r["vec_id"], r["embedding"]) for r in e.where("vec_id % 50 = 0").collect()]  # the stated query set
    hits = vector.batch_top_k(e, "vec_id", "embedding", asked, 5, exclude_same=True)
    return hits.select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT label, id, round(s, 6) AS score FROM (SELECT label, vec_id AS id, {_COS} AS s, row_number() OVER (PARTITION BY label ORDER BY {_COS} DESC, vec_id) AS r FROM embeddings, {_Q}) WHERE r = 1")
def dedup_best_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    scored = e.select(F.col("vec_id").alias("id"), "label", vector.cosine_to(F.col("embedding"), _query_vector(spark, sf_dir)).alias("score"))
    return hybrid.best_per_record(scored, "label").select("label", "id", F.round("score", 6).alias("score"))


@query()
def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 of as many nearest cells as a measured recall needs."""
    q = _query_vector(spark, sf_dir)
    return vector.top_k(_cells(spark, sf_dir).near(q), "id", "v", q, 20, -2.0)


@query(f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings, {_Q} ORDER BY {_COS} DESC, vec_id LIMIT 20")
def ivf_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 with every cell of the stored index probed, which is exact."""
    q, cells = _query_vector(spark, sf_dir), _cells(spark, sf_dir)
    return vector.top_k(cells.near(q, len(cells.centroids)), "id", "v", q, 20, -2.0).select("id", F.round("score", 6).alias("score"))


@query("SELECT n, CASE WHEN n < 1000000 THEN 100 WHEN n < 5000000 THEN 1000 WHEN n < 10000000 THEN 1500 WHEN n < 25000000 THEN 2000 WHEN n < 50000000 THEN 2500 WHEN n < 100000000 THEN 3000 ELSE 5000 END AS cells FROM (SELECT o_orderkey * 1000 AS n FROM orders)")
def cell_count_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 1000).alias("n"))
    return n.select("n", vector.cell_count(F.col("n")).alias("cells"))


@query(f"SELECT id, round(raw, 6) AS raw, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS rerank_score FROM (SELECT vec_id AS id, {_COS} AS score, {_COS} * 2 - 1 AS raw FROM embeddings, {_Q} ORDER BY score DESC, vec_id LIMIT 50) ORDER BY raw DESC, id LIMIT 10")
def rerank_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    scored = e.select(F.col("vec_id").alias("id"), vector.cosine_to(F.col("embedding"), _query_vector(spark, sf_dir)).alias("score")).withColumn("raw", F.col("score") * 2 - 1)
    return hybrid.rerank(scored, "raw", 10).select("id", F.round("raw", 6).alias("raw"), F.round("rerank_score", 6).alias("rerank_score"))


# ---- lexical and hybrid search -----------------------------------------------------------------------------

_POSTINGS = r"""(SELECT term, id, field, count(*)::INTEGER AS tf FROM (
SELECT doc_id AS id, 'A' AS field, unnest(regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}]+')) AS term FROM documents
UNION ALL SELECT doc_id, 'B', unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) FROM documents
UNION ALL SELECT doc_id, 'C', unnest(regexp_extract_all(lower(coalesce(category, '')), '[\p{L}\p{N}]+')) FROM documents
UNION ALL SELECT doc_id, 'D', unnest(regexp_extract_all(lower(coalesce(container, '')), '[\p{L}\p{N}]+')) FROM documents) GROUP BY ALL)"""
_SCORED = f"""(SELECT id, sum(CASE field WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.4 WHEN 'C' THEN 0.2 ELSE 0.1 END::DOUBLE * tf / (tf + 1)) AS score, count(DISTINCT term) AS matched
FROM {_POSTINGS} WHERE term IN ('cost', 'of', 'timber') GROUP BY id)"""


_FIELDS = {"title": "A", "text": "B", "category": "C", "container": "D"}
_CHUNK_FIELDS = {"record_title": "A", "chunk_content": "B", "document_category": "C", "record_type": "C", "container": "D", "assignee": "D", "file_type": "D"}


def _index_path(spark: SparkSession, sf_dir: str) -> str:
    return stored(spark, sf_dir, "postings", lambda p: lexical.write_index(table(spark, sf_dir, "documents"), "doc_id", _FIELDS, p))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.open_index(spark, _index_path(spark, sf_dir))


def _english(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored(spark, sf_dir, "english", lambda p: lexical.write_index(table(spark, sf_dir, "documents"), "doc_id", _FIELDS, p, lexical.english_term))
    return lexical.open_index(spark, path)


def _chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored(spark, sf_dir, "chunk-index", lambda p: lexical.write_index(table(spark, sf_dir, "record_chunks"), "id", _CHUNK_FIELDS, p, lexical.english_term))
    return lexical.open_index(spark, path)


# what builds the stored indexes, by name
BUILDS: dict[str, Callable[[SparkSession, str], object]] = {"postings": _index_path, "english": _english, "chunk-index": _chunk_index, "cells": _cells}


@query(f"SELECT term, id, field, tf FROM {_POSTINGS}")
def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(table(spark, sf_dir, "documents"), "doc_id", _FIELDS)


@query(f"SELECT term, id, field, tf FROM {_POSTINGS}")
def postings_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index, as searches read it."""
    return _index(spark, sf_dir).select("term", "id", "field", "tf")


@query(f"SELECT id, round(score, 6) AS score FROM {_SCORED} WHERE matched = 3 ORDER BY score DESC, id LIMIT 20")
def lexical_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lexical.search(_index(spark, sf_dir), QUESTION, "all", None))


@query(f"SELECT id, round(score, 6) AS score FROM {_SCORED} ORDER BY round(score, 6) DESC, id LIMIT 20")
def lexical_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lexical.search(_index(spark, sf_dir), QUESTION, "any", None))


_SQL["lexical_and_topk"] = _SQL["lexical_and_topk"].replace("ORDER BY score", "ORDER BY round(score, 6)")


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(
    f"""WITH p AS (SELECT term, id, sum(tf) AS tf FROM {_POSTINGS} WHERE term IN ('cost', 'timber') GROUP BY 1, 2), l AS (SELECT id, sum(tf) AS n_terms FROM {_POSTINGS} GROUP BY 1), s AS (SELECT count(*) AS n, avg(n_terms) AS mean FROM l), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))), 4) AS score FROM p JOIN d USING (term) JOIN l USING (id), s GROUP BY id"""
)
def lexical_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _index_path(spark, sf_dir)
    return lexical.bm25(lexical.open_index(spark, path), lexical.open_lengths(spark, path), "cost timber").select("id", F.round("score", 4).alias("score"))


# the words of the documents' language that have the stems of "costs" and "timber"
_STEMMED = "(SELECT CASE WHEN term IN ('cost', 'costs', 'costing', 'costed') THEN 'cost' ELSE 'timber' END AS term, id, field, sum(tf) AS tf FROM {p} WHERE term IN ('cost', 'costs', 'costing', 'costed', 'timber', 'timbers', 'timbering', 'timbered') GROUP BY ALL)"


@query(
    f"""SELECT id, round(score, 6) AS score FROM (SELECT id, sum(CASE field WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.4 WHEN 'C' THEN 0.2 ELSE 0.1 END::DOUBLE * tf / (tf + 1)) AS score, count(DISTINCT term) AS matched
FROM {_STEMMED.format(p=_POSTINGS)} GROUP BY id) WHERE matched = 2 ORDER BY round(score, 6) DESC, id LIMIT 20"""
)
def stemmed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text rank with stems and without stop words: all words of the question that carry meaning are needed."""
    return _rounded(lexical.search(_english(spark, sf_dir), "what are the costs of the timber", "all", None, lexical.english_term))


@query(
    r"""SELECT container, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY container ORDER BY score DESC, id) AS r FROM (
SELECT container, doc_id AS id, 0.4::DOUBLE * (tf1 / (tf1 + 1.0::DOUBLE) + tf2 / (tf2 + 1.0::DOUBLE)) AS score FROM (SELECT *, len([x FOR x IN regexp_extract_all(lower(text), '[\p{L}\p{N}]+') IF x = 'timber']) AS tf1, len([x FOR x IN regexp_extract_all(lower(text), '[\p{L}\p{N}]+') IF x = 'kilowatts']) AS tf2 FROM documents)
WHERE (tf1 > 0 AND NOT regexp_matches(text, '(?i)\bgranite\b')) OR tf2 > 0)) WHERE r <= 5"""
)
def web_top_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five documents of each container for a search-box query."""
    hits = lexical.web_top_per_record(table(spark, sf_dir, "documents"), "doc_id", "container", "text", "timber -granite or kilowatts", 5)
    return hits.select("container", "id", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bcost[^\\p{L}\\p{N}]+of[^\\p{L}\\p{N}]+timber\\b') AND NOT regexp_matches(text, '(?i)\\bgranite\\b') OR regexp_matches(text, '(?i)\\bkilowatts\\b')")
def web_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(lexical.web_query(F.col("text"), '"cost of timber" -granite or kilowatts')).select("doc_id")


@query("SELECT doc_id AS id, 0.8::DOUBLE AS score FROM documents WHERE contains(lower(text), 'timber') OR contains(lower(text), 'wexoley') ORDER BY doc_id LIMIT 100")
def ilike_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.like_fallback(table(spark, sf_dir, "documents"), "doc_id", "text", ["timber", "Wexoley"])


@query("SELECT doc_id AS id, first_token FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'kilowatts') THEN 0 WHEN contains(lower(text), 'granite') THEN 1 WHEN contains(lower(text), 'easel') THEN 2 END AS first_token FROM documents) WHERE first_token IS NOT NULL ORDER BY first_token, id LIMIT 25")
def ilike_token_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.like_in_token_order(table(spark, sf_dir, "documents"), "doc_id", "text", ["kilowatts", "granite", "easel"], 25)


_SEM = f"(SELECT vec_id AS id, {_COS} AS s FROM embeddings, {_Q} ORDER BY s DESC, id LIMIT 100)"


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 100, -2.0)


@query(
    f"""WITH a AS (SELECT * FROM {_SEM}), b AS (SELECT id, score AS f FROM {_SCORED} WHERE matched = 3 ORDER BY round(score, 6) DESC, id LIMIT 100)
SELECT id, round(score, 6) AS score FROM (SELECT coalesce(a.id, b.id) AS id, 0.7 * coalesce(s, 0) + 0.3 * coalesce(f / (SELECT max(f) FROM b), 0) AS score FROM a FULL JOIN b ON a.id = b.id ORDER BY score DESC, 1 LIMIT 20) WHERE score >= 0.1"""
)
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexical.search(_index(spark, sf_dir), QUESTION, "all", None).orderBy(F.desc(F.round("score", 6)), "id").limit(100)
    return hybrid.fuse(_semantic(spark, sf_dir), lex, 20, 0.1).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH a AS (SELECT * FROM {_SEM}), b AS (SELECT doc_id AS id, 0.8 AS f FROM documents WHERE contains(lower(text), 'kilowatts') ORDER BY id LIMIT 100)
SELECT id, round(score, 6) AS score FROM (SELECT coalesce(a.id, b.id) AS id, 0.1 * coalesce(s, 0) + 0.9 * coalesce(f / 0.8, 0) AS score FROM a FULL JOIN b ON a.id = b.id ORDER BY round(score, 9) DESC, 1 LIMIT 20)"""
)
def hybrid_like_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = lexical.like_fallback(table(spark, sf_dir, "documents"), "doc_id", "text", ["kilowatts"])
    return hybrid.fuse_like(_semantic(spark, sf_dir), like, 20).select("id", F.round("score", 6).alias("score"))


_KS = "(CASE WHEN contains(lower(coalesce({c}, '')), 'timber') THEN 1.0 WHEN contains(lower(coalesce({c}, '')), 'timbe') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(coalesce({c}, '')), 'warehouses') THEN 1.0 WHEN contains(lower(coalesce({c}, '')), 'wareh') THEN 0.3 ELSE 0 END) / 2"


@query(f"SELECT doc_id, round(({_KS.format(c='text')})::DOUBLE, 6) AS score FROM documents")
def keyword_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(lexical.keyword_score(F.col("text"), ["Timber", "warehouses"]), 6).alias("score"))


@query(f"SELECT doc_id, round(((0.35 * {_KS.format(c='text')} + 0.2 * {_KS.format(c='title')} + CASE WHEN trim(coalesce(container, '')) <> '' THEN 0.05 * {_KS.format(c='container')} ELSE 0 END) / (0.55 + CASE WHEN trim(coalesce(container, '')) <> '' THEN 0.05 ELSE 0 END))::DOUBLE, 6) AS score FROM documents")
def keyword_match_multifield(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"chunk_content": F.col("text"), "record_title": F.col("title"), "container": F.col("container")}
    return table(spark, sf_dir, "documents").select("doc_id", F.round(lexical.keyword_score_fields(cols, ["Timber", "warehouses"]), 6).alias("score"))


# ---- filters, order, paging --------------------------------------------------------------------------------


@query("SELECT id FROM record_chunks WHERE date_created::DATE >= DATE '2022-01-01' AND date_created <= TIMESTAMP '2023-06-30 12:00:00'")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.date_filter(table(spark, sf_dir, "record_chunks"), "date_created", datetime(2022, 1, 1), datetime(2023, 6, 30, 12)).select("id")


@query("SELECT id FROM record_chunks")
def date_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.date_filter(table(spark, sf_dir, "record_chunks"), "date_created", datetime(1950, 1, 1), datetime(1950, 2, 1), fallback=True).select("id")


@query(
    """SELECT id FROM record_chunks WHERE lower(coalesce(record_type, '')) <> 'container' AND (lower(coalesce(file_extension, '')) = '.docx' OR lower(coalesce(file_type, '')) = 'docx' OR contains(lower(coalesce(document_category, '')), 'docx')
OR lower(coalesce(record_title, '')) LIKE '%.docx' OR contains(lower(coalesce(chunk_content, '')), 'docx') OR contains(lower(coalesce(record_title, '')), 'word') OR contains(lower(coalesce(chunk_content, '')), 'microsoft word') OR contains(lower(coalesce(document_category, '')), 'word'))"""
)
def filetype_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.file_type_filter(table(spark, sf_dir, "record_chunks"), ["docx"]).select("id")


@query("SELECT id FROM record_chunks WHERE lower(record_type) = 'document' AND lower(file_type) = 'pdf'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.metadata_filter(table(spark, sf_dir, "record_chunks"), {"record_type": "DOCUMENT", "file_type": "PDF"}).select("id")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def date_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.page(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 0, 25)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1998-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 300")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.page(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").where("o_orderdate >= '1998-01-01'"), ["o_orderdate", "o_orderkey"], 3, 100)


@query("SELECT id, 1.0::DOUBLE AS score FROM record_chunks WHERE contains(lower(record_title), 'valve') ORDER BY id LIMIT 20")
def advanced_filter_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.advanced_filter(table(spark, sf_dir, "record_chunks"), title="Valve", content="not used").select("id", "score")


@query("SELECT id FROM record_chunks WHERE contains(lower(chunk_content), 'cost of timber') OR contains(lower(chunk_content), 'kilowatts')")
def search_dsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "record_chunks").where(scans.search_predicate(phrases=["cost of timber", "kilowatts", "of"], extensions=["pdf"])).select("id")


@query("SELECT 'content:lease and (createdOn:01/30/2024 or createdOn:01/31/2024 or createdOn:02/01/2024) and (extension:pdf or extension:docx)' AS s")
def search_string_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scans.search_string("lease", datetime(2024, 1, 30), datetime(2024, 2, 1), ["pdf", "docx"])
    return spark.range(1).select(F.lit(s).alias("s"))


_DATE = "coalesce(" + ", ".join(f"try_strptime(trim({{c}}), '{f}')" for f in ["%m/%d/%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y", "%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d %B %Y", "%B %d, %Y", "%b %d, %Y", "%d %b %Y"]) + ")"


@query(f"SELECT record_uri, {_DATE.format(c='date_created')} AS created, {_DATE.format(c='date_modified')} AS modified FROM records")
def parse_record_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_records(table(spark, sf_dir, "records")).select("record_uri", "created", "modified")


@query(f"SELECT record_uri, title FROM records WHERE {_DATE.format(c='date_modified')}::DATE >= DATE '2025-01-01'")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.changed_since(table(spark, sf_dir, "records"), datetime(2025, 1, 1)).select("record_uri", "title")


@query("SELECT id, chunk_sequence FROM record_chunks WHERE record_uri = (SELECT min(record_uri) FROM record_chunks WHERE chunk_sequence = 4) AND chunk_sequence BETWEEN 1 AND 3")
def sequence_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "record_chunks", "id", "record_uri", "chunk_sequence")
    uri = c.where("chunk_sequence = 4").agg(F.min("record_uri")).first()[0]
    return scans.sequence_range(c, uri, 1, 3).select("id", "chunk_sequence")


# ---- text projections --------------------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, coalesce(list_sum([CASE WHEN length(w) > 10 THEN ceil(length(w) / 4.0)::INTEGER ELSE 1 END + length(regexp_replace(w, '[\p{L}\p{N}\p{M}_]', '', 'g'))::INTEGER FOR w IN string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') IF w <> '']), 0)::INTEGER AS n
FROM documents"""
)
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate("text").alias("n"))


@query(r"SELECT doc_id, len([w FOR w IN string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') IF w <> ''])::INTEGER AS words, regexp_matches(text, '(?i)\[(heading\]|table|row|sheet|slide|comments\]|footnotes\])') AS structured FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count("text").alias("words"), text.has_structure("text").alias("structured"))


_COMMON = ", ".join(f"'{w}'" for w in text.COMMON_WORDS)


@query(
    rf"""SELECT doc_id, greatest(0, coalesce(list_sum([1 + CASE WHEN regexp_full_match(w, '\p{{Lu}}\p{{Ll}}+') THEN 2 ELSE 0 END + CASE WHEN lower(w) IN ({_COMMON}) THEN 3 ELSE 0 END
- CASE WHEN length(regexp_replace(w, '[\p{{L}}\p{{Nd}}.\-]', '', 'g')) > length(w) // 2 THEN 5 ELSE 0 END FOR w IN string_split(text, ' ') IF w <> '']), 0))::INTEGER AS q FROM documents"""
)
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.quality("text").alias("q"))


@query(
    r"""SELECT doc_id, length(text) >= 100 AND len(ws) >= 10 AND len([w FOR w IN ws[1:50] IF length(w) > 2 AND (regexp_matches(w, '[0-9][a-zA-Z]|[a-zA-Z][0-9]|rn') OR length(regexp_replace(w, '[^\p{Nd}]', '', 'g')) > length(w) // 3)]) > 0.4 * len(ws[1:50]) AS bad
FROM (SELECT doc_id, text, [w FOR w IN string_split(text, ' ') IF w <> ''] AS ws FROM documents)"""
)
def ocr_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.severely_corrupted("text").alias("bad"))


@query("SELECT id, CASE WHEN length(chunk_content) > 100 THEN left(chunk_content, 100) || '...' ELSE chunk_content END AS p FROM record_chunks")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "record_chunks").select("id", text.preview("chunk_content").alias("p"))


@query(r"SELECT record_uri, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{Nd}]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS k FROM records")
def safe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").select("record_uri", text.safe_key("title").alias("k"))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.CATEGORIES.items())


@query(rf"SELECT record_uri, e AS ext, CASE e {_CASES} ELSE 'Other Document' END AS category FROM (SELECT record_uri, regexp_extract(lower(title), '(\.[^./\\]+)$', 1) AS e FROM records)")
def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = text.extension("title")
    return table(spark, sf_dir, "records").select("record_uri", e.alias("ext"), text.category(e).alias("category"))


@query("SELECT event_id, concat_ws(', ', strftime(ts, '%d/%m/%Y'), strftime(ts, '%Y-%m-%d'), strftime(ts, '%B %d, %Y'), strftime(ts, '%b %d, %Y'), strftime(ts, '%d %B %Y')) AS a FROM events")
def alt_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.alternative_dates("ts").alias("a"))


_TOD = """array_to_string([x FOR x IN [CASE WHEN h = 12 AND m <= 15 THEN 'noon' END, CASE WHEN h = 12 AND m <= 15 THEN 'midday' END, CASE WHEN h = 0 AND m <= 15 THEN 'midnight' END, CASE WHEN h = 23 AND m >= 45 THEN 'near midnight' END,
CASE WHEN h BETWEEN 5 AND 11 THEN 'morning' END, CASE WHEN h BETWEEN 5 AND 7 THEN 'early morning' END, CASE WHEN h BETWEEN 10 AND 11 THEN 'late morning' END, CASE WHEN h BETWEEN 12 AND 16 THEN 'afternoon' END,
CASE WHEN h BETWEEN 12 AND 13 THEN 'early afternoon' END, CASE WHEN h BETWEEN 15 AND 16 THEN 'late afternoon' END, CASE WHEN h BETWEEN 17 AND 20 THEN 'evening' END, CASE WHEN h BETWEEN 17 AND 18 THEN 'early evening' END,
CASE WHEN h >= 21 OR h < 5 THEN 'night' END, CASE WHEN h >= 21 THEN 'late night' END, CASE WHEN h < 5 THEN 'early night' END] IF x IS NOT NULL], ', ')"""
_HM = "(SELECT *, hour(ts) AS h, minute(ts) AS m FROM events)"


@query(f"SELECT event_id, {_TOD} AS t FROM {_HM}")
def time_of_day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.time_of_day("ts").alias("t"))


@query(
    f"""SELECT event_id, 'Time of Day: ' || {_TOD} || chr(10) || 'Month: ' || strftime(ts, '%B %Y') || chr(10) || 'Quarter: Q' || quarter(ts) || ' ' || year(ts) || chr(10) || 'Day of Week: ' || dayname(ts) || chr(10) || 'Year: ' || year(ts)
|| chr(10) || 'Week of Year: Week ' || ((dayofyear(ts) - 1 + dayofweek(date_trunc('year', ts))) // 7 + 1) || ' of ' || year(ts) AS c FROM {_HM}"""
)
def temporal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.temporal_context("ts").alias("c"))


@query("SELECT doc_id, (i)::INTEGER AS seq, (i * 900)::INTEGER AS start_pos, substr(text, (i * 900 + 1)::BIGINT, 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 100) / 900.0)::BIGINT))) AS i FROM documents)")
def fixed_stride_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunk.fixed_stride(F.col("text"), 1000, 100)).alias("c"))
    return rows.select("doc_id", "c.seq", "c.start_pos", "c.content")


@query()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text", 1500, 150)


_LINE = "trim(line)"
for _ in range(6):  # as often as single letters may follow each other
    _LINE = rf"regexp_replace({_LINE}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])[a-zA-Z]\s+([A-Z])', '\1 \2', 'g')"
for _a, _b in ((r"\s+([,.!?;:])", r"\1"), (r"([,.!?;:])\s*([A-Z])", r"\1 \2"), (r"[.]{3,}", "..."), (r"[-]{3,}", "---"), (r"\s{2,}", " ")):
    _LINE = f"regexp_replace({_LINE}, '{_a}', '{_b}', 'g')"
_BOX = "(starts_with(trim(line), '[') AND ends_with(trim(line), ']'))"


@query(
    rf"""SELECT id, CASE WHEN chunk_content IS NOT NULL THEN array_to_string([v FOR v IN [CASE WHEN {_BOX} THEN line ELSE trim({_LINE}) END FOR line IN string_split(chunk_content, chr(10)) IF {_BOX} OR (length(trim(line)) >= 3 AND length(regexp_replace(trim(line), '[\p{{L}}\p{{Nd}}\s.,!?;:()\-"'']', '', 'g')) <= length(trim(line)) // 3)] IF trim(v) <> ''], chr(10)) END AS t FROM record_chunks"""
)
def clean_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "record_chunks").select("id", text.clean_lines("chunk_content").alias("t"))


@query()
def ocr_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "record_chunks").select("id", text.clean_ocr("chunk_content").alias("t"))


@query()
def universal_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "record_chunks").select("id", text.universal_clean("chunk_content").alias("t"))


@query("SELECT doc_id, unnest(range(0, len(ps)))::INTEGER AS piece, unnest(ps) AS t FROM (SELECT doc_id, string_split(list_reduce(string_split(text, chr(10)), lambda a, x: CASE WHEN length(split_part(a, chr(1), -1)) + length(x) + 1 > 2000 THEN a || chr(1) || x ELSE a || chr(10) || x END), chr(1)) AS ps FROM documents WHERE text IS NOT NULL)")
def packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into pieces of whole lines."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.pack_lines("text", 2000)).alias("piece", "t"))


@query(
    r"""SELECT doc_id, coalesce(list_sum([length(w) FOR w IN string_split(text, ' ') IF CASE WHEN length(w) = 0 THEN false WHEN length(w) = 1 THEN regexp_full_match(w, '[\p{L}\p{Nd}]') WHEN d(w) = length(w) THEN length(w) <= 10 WHEN d(w) > 0 THEN NOT (length(w) > 15 AND d(w) > l(w) * 3) ELSE l(w) > 0 AND length(w) <= 50 END]), 0)::INTEGER AS s FROM documents""".replace(
        "d(w)", r"length(regexp_replace(w, '[^\p{Nd}]', '', 'g'))"
    ).replace("l(w)", r"length(regexp_replace(w, '[^\p{L}]', '', 'g'))")
)
def meaningful_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.meaningful_score("text").alias("s"))


@query(
    """SELECT id, concat_ws(chr(10), 'Title: ' || nullif(record_title, ''), 'Created: ' || strftime(date_created, '%m/%d/%Y %H:%M:%S'), 'Type: ' || nullif(record_type, ''), 'Container: ' || nullif(container, ''), 'Assignee: ' || nullif(assignee, '')) AS p FROM record_chunks"""
)
def content_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "record_chunks")
    return c.select("id", text.content_preview(F.col("record_title"), F.date_format("date_created", "MM/dd/yyyy HH:mm:ss"), F.col("record_type"), F.col("container"), F.col("assignee")).alias("p"))


@query(
    """SELECT id, concat_ws(chr(10), '[Record: ' || record_title || ' | URI: ' || record_uri || ']', '[Created: ' || strftime(date_created, '%m/%d/%Y %H:%M:%S') || ']') AS h FROM record_chunks"""
)
def chunk_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "record_chunks")
    return c.select("id", text.chunk_header(F.col("record_title"), F.col("record_uri"), F.date_format("date_created", "MM/dd/yyyy HH:mm:ss"), F.lit(None).cast("string")).alias("h"))


@query("SELECT doc_id, regexp_replace(title, '(?i)(valve|lift)', '<span>\\1</span>', 'g') AS t FROM documents")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.highlight("title", ["valve", "lift"]).alias("t"))


# ---- queries as rows ---------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in intent.QUERY_STOP_WORDS)
_FUNC = ", ".join(f"'{w}'" for w in sorted(set(intent.FUNCTION_WORDS)))


@query(f"SELECT item_id, array_to_string([w FOR w IN string_split(lower(text), ' ') IF w <> '' AND w NOT IN ({_STOP})], ' ') AS q FROM eval_items")
def query_stopword_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", intent.strip_query_words_col(F.col("text")).alias("q"))


@query(
    f"""SELECT item_id, CASE WHEN length(o) > 2 THEN o ELSE text END AS q FROM (SELECT item_id, text, array_to_string([w FOR w IN string_split(trim(text), ' ') IF w <> '' AND (length(regexp_replace(w, '[^a-zA-Z]', '', 'g')) < 0.5 * length(w) OR lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')) NOT IN ({_FUNC}))], ' ') AS o FROM eval_items)"""
)
def function_word_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", intent.strip_function_words_col(F.col("text")).alias("q"))


@query(r"""SELECT item_id, replace(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' & ', ' and '), ' + ', ' and ') AS q, regexp_matches(lower(text), 'earliest|oldest|first created') AS earliest, regexp_matches(lower(text), 'latest|newest|most recent|recently created') AS latest FROM eval_items""")
def query_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, la = intent.sort_intent_col(F.col("text"))
    return table(spark, sf_dir, "eval_items").select("item_id", intent.clean_query_col(F.col("text")).alias("q"), e.alias("earliest"), la.alias("latest"))


@query("SELECT event_id, user_id, CASE WHEN user_id IS NOT NULL THEN '[\"' || event_type || '\",\"u' || user_id || '\"]' END AS raw, array_to_string([event_type, 'u' || user_id], '/') AS k FROM events")
def keyword_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('["'), "event_type", F.lit('","u'), F.col("user_id").cast("string"), F.lit('"]'))
    return table(spark, sf_dir, "events").select("event_id", "user_id", raw.alias("raw"), F.array_join(intent.keyword_reply_col(raw), "/").alias("k"))


@query("SELECT o_orderkey, least(k * (greatest(CASE WHEN s THEN 20 ELSE 5 END, CASE WHEN d THEN 10 ELSE 5 END) + CASE WHEN s THEN 5 ELSE 0 END), 1000)::INTEGER AS n FROM (SELECT o_orderkey, (o_orderkey % 60)::INTEGER AS k, o_orderstatus = 'F' AS s, o_orderkey % 2 = 0 AS d FROM orders)")
def dynamic_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus") == "F"
    return o.select("o_orderkey", intent.dynamic_limit_col((F.col("o_orderkey") % 60).cast("int"), s, F.col("o_orderkey") % 2 == 0, s.cast("int"), F.lit(0)).alias("n"))


@query()
def date_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of the dates that titles of records name, each distinct title once.

    The rules are made for queries, one string at a time; over a table they run row by row in Python.
    """
    now = datetime(2026, 1, 28)

    @F.pandas_udf("start timestamp, end timestamp")
    def ranges(q):  # type: ignore[no-untyped-def]
        import pandas as pd

        got = [intent.date_range(x or "", now) for x in q]
        cap = lambda d: pd.Timestamp(min(d, datetime(2262, 1, 1))) if d else None
        return pd.DataFrame({"start": [cap(a) for a, _ in got], "end": [cap(b) for _, b in got]})

    t = table(spark, sf_dir, "records", "title").distinct().withColumn("r", ranges("title"))
    return t.select("title", "r.start", "r.end").where("start is not null")


@query()
def smart_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of queries, row by row in Python: for tables of queries, not of documents."""

    @F.pandas_udf("array<string>")
    def words(q):  # type: ignore[no-untyped-def]
        return q.map(lambda x: intent.smart_keywords(x or ""))

    return table(spark, sf_dir, "eval_items").select("item_id", words("text").alias("keywords"))


# ---- store -------------------------------------------------------------------------------------------------

_SRC = f"(SELECT record_uri, max({_DATE.format(c='date_modified')}) AS src FROM records GROUP BY 1)"


@query(f"SELECT record_uri, CASE WHEN there IS NULL THEN 'new' WHEN src IS NULL OR old IS NULL OR src > old THEN 'updated' ELSE 'unchanged' END AS status FROM {_SRC} LEFT JOIN (SELECT record_uri, max(source_date_modified) AS old, true AS there FROM record_chunks GROUP BY 1) USING (record_uri)")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.detect_changes(table(spark, sf_dir, "records"), table(spark, sf_dir, "record_chunks", "record_uri", "source_date_modified"))


@query(
    """WITH o AS (SELECT id, embedding_id, token_count, created_at FROM record_chunks WHERE indexed_at < TIMESTAMP '2023-01-01'), n AS (SELECT id, embedding_id, token_count, created_at, row_number() OVER (PARTITION BY embedding_id ORDER BY created_at DESC, id DESC) AS r FROM record_chunks WHERE indexed_at >= TIMESTAMP '2023-01-01')
SELECT id, embedding_id, token_count, created_at FROM o WHERE embedding_id NOT IN (SELECT embedding_id FROM n) UNION ALL SELECT coalesce(o.id, n.id), n.embedding_id, n.token_count, coalesce(o.created_at, n.created_at) FROM n LEFT JOIN o USING (embedding_id) WHERE r = 1"""
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "record_chunks", "id", "embedding_id", "token_count", "created_at", "indexed_at")
    old, new = c.where("indexed_at < '2023-01-01'").drop("indexed_at"), c.where("indexed_at >= '2023-01-01'").drop("indexed_at")
    return store.upsert(old, new)


@query("SELECT id FROM record_chunks WHERE record_uri NOT IN (SELECT record_uri FROM record_acl WHERE acl_group = 7 AND record_uri IS NOT NULL)")
def delete_by_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_records(table(spark, sf_dir, "record_chunks", "id", "record_uri"), table(spark, sf_dir, "record_acl").where("acl_group = 7 and record_uri is not null")).select("id")


@query("SELECT record_uri, coalesce(n, 0) AS deleted, CASE WHEN coalesce(n, 0) > 0 THEN 'deleted' ELSE 'not_found' END AS status FROM (SELECT DISTINCT record_uri FROM records) LEFT JOIN (SELECT record_uri, count(*) AS n FROM record_chunks WHERE page_number > 0 GROUP BY 1) USING (record_uri)")
def delete_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_report(table(spark, sf_dir, "record_chunks", "record_uri", "page_number").where("page_number > 0"), table(spark, sf_dir, "records"))


@query("SELECT status, count(*) AS records, sum(n)::BIGINT AS chunks FROM (SELECT record_uri, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 0 THEN 'deleted' ELSE 'not_found' END AS status FROM (SELECT DISTINCT record_uri FROM records) LEFT JOIN (SELECT record_uri, count(*) AS n FROM record_chunks WHERE page_number > 0 GROUP BY 1) USING (record_uri)) GROUP BY 1")
def delete_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_totals(delete_report(spark, sf_dir))


@query(f"SELECT id, coalesce(source_date_modified, src) AS source_date_modified FROM record_chunks LEFT JOIN {_SRC} USING (record_uri)")
def backfill_null_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.backfill_modified(table(spark, sf_dir, "record_chunks", "id", "record_uri", "source_date_modified"), table(spark, sf_dir, "records")).select("id", "source_date_modified")


@query("SELECT id, created_at < TIMESTAMP '2022-01-20 00:00:00' AS cold FROM record_chunks")
def archive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot, cold = store.split_archive(table(spark, sf_dir, "record_chunks", "id", "created_at"), datetime(2024, 1, 20))
    return hot.select("id", F.lit(False).alias("cold")).union(cold.select("id", F.lit(True).alias("cold")))


@query("SELECT record_uri, max(source_date_modified) AS latest, count(*) AS chunks FROM record_chunks GROUP BY 1")
def latest_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "record_chunks").groupBy("record_uri").agg(F.max("source_date_modified").alias("latest"), F.count("*").alias("chunks"))


# ---- access ------------------------------------------------------------------------------------------------

_USER = "(SELECT min(user_id) FROM user_groups)"


@query(
    f"""SELECT DISTINCT record_uri FROM record_acl a WHERE permission_type = 'ViewDocument' AND record_uri IS NOT NULL AND (acl_group IS NULL OR acl_group IN (SELECT acl_group FROM acl_group_members WHERE location_id = {_USER} OR location_id IN (SELECT group_id FROM user_groups WHERE user_id = {_USER})))"""
)
def acl_visible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "user_groups")
    user = groups.agg(F.min("user_id")).first()[0]
    return acl.visible_records(table(spark, sf_dir, "record_acl"), table(spark, sf_dir, "acl_group_members"), groups, user)


@query(
    """WITH reach AS (SELECT DISTINCT user_id, acl_group FROM (SELECT user_id, group_id AS location_id FROM user_groups UNION SELECT user_id, user_id FROM user_groups) JOIN acl_group_members USING (location_id))
SELECT user_id, count(DISTINCT record_uri) AS records FROM reach JOIN record_acl USING (acl_group) WHERE permission_type = 'ViewDocument' GROUP BY 1"""
)
def acl_records_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acl.visible_to_each(table(spark, sf_dir, "record_acl"), table(spark, sf_dir, "acl_group_members"), table(spark, sf_dir, "user_groups"))


_ACL_VALUES = f"(SELECT row_id, pos, CASE WHEN lower(val) LIKE 'group:%' THEN 'group' WHEN lower(val) LIKE 'location:%' THEN 'location' ELSE 'user' END AS kind, trim(regexp_replace(val, '(?i)^(group|location):\\s*', '')) AS name FROM ({_packed(1)}) WHERE src = 'record_acl' AND val <> '<Unrestricted>')"


@query(f"SELECT row_id, pos, kind, name FROM {_ACL_VALUES}")
def acl_permission_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acl.parse_permissions(table(spark, sf_dir, "record_acl"), "id", "raw_acl_string")


@query(f"SELECT kind, count(DISTINCT name) AS principals FROM {_ACL_VALUES} GROUP BY 1")
def acl_unique_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acl.unique_principals(table(spark, sf_dir, "record_acl"))


@query(f"SELECT permission_type, kind, name, count(DISTINCT record_uri) AS records FROM record_acl JOIN {_ACL_VALUES} ON id = row_id GROUP BY 1, 2, 3")
def acl_permission_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acl.permission_frequencies(table(spark, sf_dir, "record_acl"))


@query("SELECT count(*) AS acl_rows, count(DISTINCT record_uri) AS records, count(DISTINCT CASE WHEN acl_group IS NOT NULL THEN record_uri END) AS restricted_records, count(DISTINCT acl_group) AS groups, count(*) FILTER (WHERE raw_acl_string IS NULL) AS null_strings, count(*) FILTER (WHERE trim(raw_acl_string) = '') AS blank_strings FROM record_acl")
def acl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acl.acl_statistics(table(spark, sf_dir, "record_acl"))


@query("SELECT id, acl IS NULL OR trim(acl) = '' OR contains(acl, '<Unrestricted>') AS open FROM record_chunks")
def acl_unrestricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "record_chunks").select("id", acl.is_unrestricted(F.col("acl")).alias("open"))


# ---- context -----------------------------------------------------------------------------------------------

_ANCHORS = "(SELECT DISTINCT record_uri, chunk_sequence AS a FROM record_chunks WHERE contains(lower(chunk_content), 'kilowatts'))"
_NEAR = f"(SELECT c.*, is_anchor FROM record_chunks c JOIN (SELECT record_uri, s, bool_or(s = a) AS is_anchor FROM (SELECT record_uri, a, unnest(range(a - 2, a + 3)) AS s FROM {_ANCHORS}) GROUP BY 1, 2) w ON c.record_uri = w.record_uri AND c.chunk_sequence = w.s)"


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "record_chunks").where("contains(lower(chunk_content), 'kilowatts')").select("record_uri", "chunk_sequence")


@query(f"SELECT id, chunk_sequence, is_anchor FROM {_NEAR}")
def qa_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.neighbours(_anchors(spark, sf_dir), table(spark, sf_dir, "record_chunks"), "record_uri", "chunk_sequence").select("id", "chunk_sequence", "is_anchor")


@query("SELECT id, running_chars FROM (SELECT id, sum(length(chunk_content)) OVER (PARTITION BY record_uri ORDER BY chunk_sequence, id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_chars FROM record_chunks) WHERE running_chars <= 5000")
def qa_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.budget_prefix(table(spark, sf_dir, "record_chunks"), ["record_uri"], ["chunk_sequence", "id"], "chunk_content", 5000).select("id", "running_chars")


@query(
    f"""WITH t AS (SELECT id, record_uri, chunk_sequence, '[Sequence ' || chunk_sequence || ', Page ' || page_number || ', Index ' || chunk_index || ']' || CASE WHEN is_anchor THEN ' RELEVANT' ELSE '' END || chr(10) || chunk_content AS t, sum(length(chunk_content)) OVER (PARTITION BY record_uri ORDER BY chunk_sequence, id ROWS UNBOUNDED PRECEDING) AS r FROM {_NEAR})
SELECT record_uri, string_agg(t, chr(10) || chr(10) ORDER BY chunk_sequence, id) AS context FROM t WHERE r <= 120272 GROUP BY 1"""
)
def qa_prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.qa_context(_anchors(spark, sf_dir), table(spark, sf_dir, "record_chunks"))


@query(
    """WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE contains(lower(text), 'easel') ORDER BY doc_id LIMIT 3), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 5)
SELECT id, source, rank, row_number() OVER (ORDER BY source, rank, id) AS place FROM (SELECT id, rank, 1 AS source FROM a UNION ALL SELECT id, rank, 2 FROM b WHERE id NOT IN (SELECT id FROM a)) ORDER BY source, rank, id LIMIT 5"""
)
def anchor_priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")

    def first(word: str, n: int) -> DataFrame:
        hits = d.where(F.contains(F.lower("text"), F.lit(word))).select(F.col("doc_id").alias("id")).orderBy("id").limit(n)
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("id")).cast("long"))

    out = context.priority_union(first("easel", 3), first("the", 5), "id", "rank", 5)
    return out.select("id", "source", "rank", F.col("place").cast("long").alias("place"))


@query("SELECT 'Records:' || chr(10) || string_agg('[' || n || '] ' || coalesce(title, '') || chr(10) || left(text, 24326), chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || 'Question: What does timber cost?' AS prompt FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5)")
def synthesis_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "title", "text", F.col("n_chars").alias("score"))
    return context.synthesis_prompt(d, "What does timber cost?", "title", "text")


@query("SELECT record_uri, left(string_agg(chunk_content, chr(10) || chr(10) ORDER BY n), 50000) AS context FROM (SELECT record_uri, chunk_content, row_number() OVER (PARTITION BY record_uri ORDER BY chunk_sequence, id) AS n FROM record_chunks) WHERE n <= 50 GROUP BY 1")
def record_summary_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.record_summary_context(table(spark, sf_dir, "record_chunks"), "record_uri", "chunk_sequence", "chunk_content")


# ---- reports -----------------------------------------------------------------------------------------------

_T = "TIMESTAMP '2024-01-20 12:00:00'"


@query(
    f"""SELECT total, last_24h, last_1h, last_7d, round(last_24h / 24.0::DOUBLE, 4) AS per_hour, round((86300000.0::DOUBLE - total) / nullif(last_24h, 0), 4) AS days_to_target, round((86300000.0::DOUBLE - total) * 7 / nullif(last_7d, 0), 4) AS days_to_target_week FROM (
SELECT count(*) AS total, count(*) FILTER (WHERE ts > {_T} - INTERVAL 24 HOURS AND ts <= {_T}) AS last_24h, count(*) FILTER (WHERE ts > {_T} - INTERVAL 1 HOUR AND ts <= {_T}) AS last_1h, count(*) FILTER (WHERE ts > {_T} - INTERVAL 168 HOURS AND ts <= {_T}) AS last_7d FROM events)"""
)
def monitor_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.growth(table(spark, sf_dir, "events"), "ts", AS_OF)


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, (count(*) // 12)::BIGINT AS per_5min, CASE WHEN count(*) // 12 > 12 THEN 'High load' WHEN count(*) // 12 < 1 THEN 'Below target' ELSE 'On track' END AS status FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def monitor_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.hourly(table(spark, sf_dir, "events"), "ts", 1, 12)


@query("SELECT container, sum(length(chunk_content))::BIGINT AS size, round(100.0::DOUBLE * sum(length(chunk_content)) / sum(sum(length(chunk_content))) OVER (), 4) AS pct FROM record_chunks GROUP BY 1")
def monitor_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.share(table(spark, sf_dir, "record_chunks"), "container", F.length("chunk_content"))


@query("SELECT record_type, count(*) AS chunks, count(DISTINCT record_uri) AS records, round(count(*)::DOUBLE / nullif(count(DISTINCT record_uri), 0), 4) AS chunks_per_record FROM record_chunks GROUP BY 1")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.chunk_statistics(table(spark, sf_dir, "record_chunks"))


@query("SELECT unnest(['Total Chunks', 'Total Records', 'Largest Record', 'Without Vector']) AS metric, unnest([count(*)::VARCHAR, count(DISTINCT record_uri)::VARCHAR, max(total_chunks)::VARCHAR, count(*) FILTER (WHERE vector IS NULL)::VARCHAR]) AS value FROM record_chunks")
def monitor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.summary(table(spark, sf_dir, "record_chunks"))


@query("SELECT n, CASE WHEN n < 100000 THEN 'Small' WHEN n < 1000000 THEN 'Medium' WHEN n < 10000000 THEN 'Large' WHEN n < 100000000 THEN 'Very Large' ELSE 'Massive' END AS scale FROM (SELECT o_orderkey * 5000 AS n FROM orders)")
def scale_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 5000).alias("n"))
    return n.select("n", monitor.scale_name(F.col("n")).alias("scale"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS w FROM events) GROUP BY ALL")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(table(spark, sf_dir, "events"))


@query(
    """SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""
)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"))


@query("SELECT k AS property, count(*) AS rows FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def discover_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.discover_properties(table(spark, sf_dir, "events"), "props")


# ---- lookups, sets and further projections -----------------------------------------------------------------


@query("SELECT id, embedding_id FROM record_chunks ORDER BY id LIMIT 100")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.first_rows(table(spark, sf_dir, "record_chunks", "id", "embedding_id"))


@query("SELECT id, chunk_index FROM record_chunks WHERE embedding_id = (SELECT min(embedding_id) FROM record_chunks)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "record_chunks", "id", "embedding_id", "chunk_index")
    return scans.lookup(c, "embedding_id", c.agg(F.min("embedding_id")).first()[0]).select("id", "chunk_index")


@query("SELECT embedding_id FROM record_chunks WHERE record_uri = (SELECT min(record_uri) FROM record_chunks)")
def ids_of_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "record_chunks", "embedding_id", "record_uri")
    return scans.lookup(c, "record_uri", c.agg(F.min("record_uri")).first()[0]).select("embedding_id")


@query("SELECT record_uri, title FROM records WHERE record_uri::VARCHAR = (SELECT max(record_uri)::VARCHAR FROM records) ORDER BY date_modified NULLS FIRST LIMIT 1")
def record_by_any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "records")
    return scans.record_by_any_key(r, str(r.agg(F.max("record_uri")).first()[0])).select("record_uri", "title")


@query("SELECT record_uri FROM record_acl WHERE record_uri IS NOT NULL INTERSECT SELECT record_uri FROM documents WHERE record_uri IS NOT NULL")
def records_with_acl_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "record_acl").where("record_uri is not null").select("record_uri")
    return a.intersect(table(spark, sf_dir, "documents").where("record_uri is not null").select("record_uri"))


@query("SELECT DISTINCT record_uri FROM records EXCEPT SELECT record_uri FROM documents")
def records_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "records").select("record_uri").distinct()
    return r.join(table(spark, sf_dir, "documents").select("record_uri"), "record_uri", "left_anti")


@query(
    """SELECT id, concat_ws(chr(10), 'Record Title: ' || nullif(record_title, ''), 'Record URI: ' || record_uri, 'Date Created: ' || strftime(date_created, '%m/%d/%Y %H:%M:%S'), 'Record Type: ' || nullif(record_type, ''), 'Container: ' || nullif(container, ''),
'Assignee: ' || nullif(assignee, ''), 'All Parts: ' || nullif(all_parts, ''), 'Access Control: ' || nullif(regexp_replace(acl, '\\.\\s+', '.', 'g'), '')) || chr(10) || chr(10) || '--- Document Content ---' || chr(10) || chunk_content AS t FROM record_chunks"""
)
def record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    made = text.record_text(
        F.col("record_title"), F.col("record_uri"), F.date_format("date_created", "MM/dd/yyyy HH:mm:ss"), none, none, F.col("record_type"), F.col("container"), F.col("assignee"), F.col("all_parts"), F.col("acl"), F.col("chunk_content")
    )
    return table(spark, sf_dir, "record_chunks").select("id", made.alias("t"))


@query(r"""SELECT doc_id, array_to_string([w FOR w IN string_split_regex(text, '[^\p{L}\p{Nd}.,!?;:()"''\-]+') IF CASE WHEN length(w) = 0 THEN false WHEN length(w) = 1 THEN regexp_full_match(w, '[\p{L}\p{Nd}]') WHEN d(w) = length(w) THEN length(w) <= 10 WHEN d(w) > 0 THEN NOT (length(w) > 15 AND d(w) > l(w) * 3) ELSE l(w) > 0 AND length(w) <= 50 END], ' ') AS t FROM documents""".replace("d(w)", r"length(regexp_replace(w, '[^\p{Nd}]', '', 'g'))").replace("l(w)", r"length(regexp_replace(w, '[^\p{L}]', '', 'g'))"))
def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.readable("text").alias("t"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 >= 60 THEN 3 WHEN o_orderkey % 100 >= 20 THEN 2 ELSE 0 END AS page FROM orders")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(F.struct(F.lit(20).alias("pos"), F.lit(2).alias("page")), F.struct(F.lit(60).alias("pos"), F.lit(3).alias("page")))
    return table(spark, sf_dir, "orders").select("o_orderkey", chunk.page_of(marks, F.col("o_orderkey") % 100).alias("page"))


@query("SELECT event_type AS job_name, max(ts) AS updated_at, min(ts) AS created_at, arg_max(event_id, ts)::INTEGER AS last_page FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1")
def checkpoint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each job, from its changes."""
    e = table(spark, sf_dir, "events").groupBy("event_type", "ts").agg(F.max("event_id").alias("event_id"))
    changes = e.select(F.col("event_type").alias("job_name"), F.col("event_id").cast("int").alias("last_page"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return store.update_checkpoint(changes.limit(0), changes).select("job_name", "updated_at", "created_at", "last_page")


@query("SELECT name, letters, col::INTEGER AS col FROM (SELECT s_name AS name, chr(65 + (s_suppkey % 26)::INTEGER) || chr(65 + (s_suppkey % 7)::INTEGER) AS letters, (1 + s_suppkey % 26) * 26 + 1 + s_suppkey % 7 AS col FROM supplier)")
def cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    letters = F.concat(F.char((65 + F.col("s_suppkey") % 26).cast("int")), F.char((65 + F.col("s_suppkey") % 7).cast("int")))
    s = s.select(F.col("s_name").alias("name"), letters.alias("letters"))
    return s.select("name", "letters", text.cell_reference(F.concat("letters", F.lit("7")))[1].alias("col"))


@query("SELECT i AS id, 'cm_record_' || (i + 1000) || '_chunk_0' AS embedding_id, i + 1000 AS record_uri FROM range(500) t(i)")
def dummy_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.dummy_embeddings(spark, 500).select("id", "embedding_id", "record_uri")


# ---- pipelines ---------------------------------------------------------------------------------------------


_PIPE_FILES = """lower(coalesce(record_type, '')) <> 'container' AND (lower(coalesce(file_extension, '')) = '.pdf' OR lower(coalesce(file_type, '')) = 'pdf' OR contains(lower(coalesce(document_category, '')), 'pdf') OR lower(coalesce(record_title, '')) LIKE '%.pdf'
OR contains(lower(coalesce(chunk_content, '')), 'pdf') OR contains(lower(coalesce(record_title, '')), 'pdf') OR contains(lower(coalesce(chunk_content, '')), 'portable document'))"""
_PIPE_TERMS = " UNION ALL ".join(f"SELECT id, '{k}' AS field, unnest(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')) AS term FROM f" for c, k in _CHUNK_FIELDS.items())


@query(
    f"""WITH seen AS (SELECT DISTINCT record_uri FROM record_acl WHERE permission_type = 'ViewDocument' AND record_uri IS NOT NULL AND (acl_group IS NULL OR acl_group IN (SELECT acl_group FROM acl_group_members WHERE location_id = {_USER} OR location_id IN (SELECT group_id FROM user_groups WHERE user_id = {_USER})))),
f AS (SELECT * FROM record_chunks WHERE entity_type = 'content_manager_record' AND record_uri IN (SELECT record_uri FROM seen) AND {_PIPE_FILES}),
q AS (SELECT vector::DOUBLE[] AS q FROM record_chunks WHERE len(vector) = 64 ORDER BY id LIMIT 1),
v AS (SELECT id, list_cosine_similarity(vector::DOUBLE[], q) AS s FROM f, q WHERE len(vector) = 64 AND list_sum([x * x FOR x IN vector]) > 0),
sem AS (SELECT * FROM (SELECT * FROM v ORDER BY s DESC, id LIMIT 1000) WHERE s >= 0),
w AS (SELECT id, field, CASE WHEN term IN ('cost', 'costs', 'costing', 'costed') THEN 'cost' WHEN term IN ('pdf', 'pdfs') THEN 'pdf' ELSE 'timber' END AS term FROM ({_PIPE_TERMS}) WHERE term IN ('cost', 'costs', 'costing', 'costed', 'pdf', 'pdfs', 'timber', 'timbers', 'timbering', 'timbered')),
l AS (SELECT id, sum(CASE field WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.4 WHEN 'C' THEN 0.2 ELSE 0.1 END::DOUBLE * tf / (tf + 1)) AS score, count(DISTINCT term) AS matched FROM (SELECT id, field, term, count(*) AS tf FROM w GROUP BY ALL) GROUP BY id),
lex AS (SELECT id, score FROM l WHERE matched = 3 ORDER BY score DESC, id LIMIT 1000),
fused AS (SELECT * FROM (SELECT coalesce(sem.id, lex.id) AS id, 0.7 * coalesce(s, 0) + 0.3 * coalesce(score / (SELECT max(score) FROM lex), 0) AS score FROM sem FULL JOIN lex ON sem.id = lex.id ORDER BY score DESC, 1 LIMIT 200) WHERE score >= 0.1)
SELECT record_uri, embedding_id, round(score, 6) AS score, record_title, date_created FROM (SELECT f.*, score, row_number() OVER (PARTITION BY record_uri ORDER BY score DESC, id) AS r FROM f JOIN fused USING (id)) WHERE r = 1 ORDER BY score DESC, id LIMIT 20"""
)
def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole search: filters and access of one user before both legs are cut, one hit per record."""
    return _search(spark, sf_dir)


@query()
def search_pipeline_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with the semantic leg in a stored index of cells."""
    chunks = table(spark, sf_dir, "record_chunks")
    path = stored(spark, sf_dir, "chunk-cells", lambda p: vector.write_cells(chunks, "id", "vector", p, k=100))
    return _search(spark, sf_dir, vector.open_cells(spark, path))


def _search(spark: SparkSession, sf_dir: str, cells: vector.Cells | None = None) -> DataFrame:
    chunks, groups = table(spark, sf_dir, "record_chunks"), table(spark, sf_dir, "user_groups")
    s = pipeline.Store(chunks, _chunk_index(spark, sf_dir), table(spark, sf_dir, "record_acl"), table(spark, sf_dir, "acl_group_members"), groups, cells)
    q = list(chunks.where("size(vector) = 64").orderBy("id").select("vector").first()[0])
    hits = pipeline.search(s, "pdf about the cost of timber", lambda _: q, datetime(2026, 1, 28), 20, 0.1, user=groups.agg(F.min("user_id")).first()[0], filter_first=True)
    return hits.select("record_uri", "embedding_id", F.round("score", 6).alias("score"), "record_title", "date_created")


NOW = datetime(2026, 1, 28)


class _Refuses(HashingEmbedder):
    """Fails on texts that hold a word, as a model server does on some input."""

    def __init__(self, word: str):
        super().__init__()
        self.word = word

    def embed(self, texts: list[str]) -> list[list[float]]:
        if any(self.word in t.split("]")[0].lower() for t in texts):
            raise ValueError("refused")
        return super().embed(texts)


def _sync(spark: SparkSession, sf_dir: str, embedder: HashingEmbedder | None = None) -> tuple[DataFrame, Sync]:
    bodies = bodies_of(table(spark, sf_dir, "documents", "doc_id", "record_uri", "text"))
    return sync_once(table(spark, sf_dir, "record_chunks"), table(spark, sf_dir, "records"), bodies, NOW, embedder)


@query()
def sync_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, chunks and vectors of all records that changed since they were stored, beside those that did not."""
    state, _ = _sync(spark, sf_dir)
    return state.select("embedding_id", "record_uri", "chunk_sequence", "token_count", "page_number", "chunk_content")


# the latest export of each record, and what a sync finds
_LATEST = f"(SELECT record_uri, m AS src, title FROM (SELECT record_uri, title, {_DATE.format(c='date_modified')} AS m, row_number() OVER (PARTITION BY record_uri ORDER BY coalesce({_DATE.format(c='date_modified')}, TIMESTAMP '1900-01-01') DESC, coalesce(title, '') DESC) AS r FROM records) WHERE r = 1)"
_FOUND = f"(SELECT record_uri, src, title, old, CASE WHEN there IS NULL THEN 'new' WHEN mx IS NULL OR old IS NULL OR mx > old THEN 'updated' ELSE 'unchanged' END AS status, contains(lower(title), 'for ') AS bad FROM {_LATEST} JOIN (SELECT record_uri, max({_DATE.format(c='date_modified')}) AS mx FROM records GROUP BY 1) USING (record_uri) LEFT JOIN (SELECT record_uri, max(source_date_modified) AS old, true AS there FROM record_chunks GROUP BY 1) USING (record_uri))"


@query(
    f"""SELECT count(*) FILTER (WHERE status = 'new') AS "new", count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status <> 'unchanged') AS processed,
count(*) FILTER (WHERE status <> 'unchanged' AND NOT coalesce(bad, false)) AS success, count(*) FILTER (WHERE status <> 'unchanged' AND bad) AS failed FROM {_FOUND}"""
)
def sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run whose model refuses records with a word in their title."""
    return _sync(spark, sf_dir, _Refuses("for "))[1].counters()


@query(f"SELECT record_uri, 'ValueError: refused' AS embed_error, TIMESTAMP '2026-01-28 00:00:00' AS at FROM {_FOUND} WHERE status <> 'unchanged' AND bad")
def sync_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead-letter rows of the same run, one per record."""
    return _sync(spark, sf_dir, _Refuses("for "))[1].errors.select("record_uri", "embed_error", "at").distinct()


@query(f"SELECT record_uri, CASE WHEN status = 'unchanged' OR bad THEN old ELSE src END AS modified FROM {_FOUND} WHERE status = 'unchanged' OR NOT coalesce(bad, false) OR old IS NOT NULL OR status = 'updated'")
def sync_next_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modification date of each record in the store after the same run: that of the source, or the stored one where it was left alone."""
    state, _ = _sync(spark, sf_dir, _Refuses("for "))
    return state.groupBy("record_uri").agg(F.max("source_date_modified").alias("modified"))


# ---- further operators of the inventory --------------------------------------------------------------------


@query(
    """SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER t AS quarter, coalesce(lead(o_orderkey) OVER t, -1) AS following, coalesce(lag(o_orderkey, 2) OVER t, -1) AS before, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, first_value(o_orderkey) OVER t AS first_key,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS smooth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate), t AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def analytic_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, tiles, neighbours and frames over the orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    t = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(t).alias("quarter"), F.coalesce(F.lead("o_orderkey").over(t), F.lit(-1)).alias("following"), F.coalesce(F.lag("o_orderkey", 2).over(t), F.lit(-1)).alias("before"),
        F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.first("o_orderkey").over(t).alias("first_key"), F.round(F.sum("o_totalprice").over(t.rowsBetween(-1, 1)), 2).alias("smooth"),
    )


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("long").alias("g"), F.count("*").alias("n"))


@query("SELECT record_type, file_type, count(*) AS n FROM record_chunks GROUP BY GROUPING SETS ((record_type, file_type), (record_type), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "record_chunks")
    return c.groupingSets([[c.record_type, c.file_type], [c.record_type], []], c.record_type, c.file_type).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS chunks, count(DISTINCT record_uri) AS records, max(indexed_at) AS latest FROM record_chunks")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.collection(table(spark, sf_dir, "record_chunks"))


@query("SELECT record_type, count(*) AS chunks, count(DISTINCT record_uri) AS records, round(avg(length(coalesce(chunk_content, ''))), 4) AS mean, min(length(coalesce(chunk_content, '')))::INTEGER AS smallest, max(length(coalesce(chunk_content, '')))::INTEGER AS largest FROM record_chunks GROUP BY 1")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.sizes(table(spark, sf_dir, "record_chunks"))


@query(
    r"""SELECT count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(coalesce(record_title, '') || ' ' || coalesce(chunk_content, ''), '[\p{L}\p{N}]')) AS unindexed, CASE WHEN count(*) < 1000000 THEN 'OK - lists=100' WHEN count(*) < 10000000 THEN 'REBUILD RECOMMENDED - Use lists=1000-2000' WHEN count(*) < 50000000 THEN 'REBUILD RECOMMENDED - Use lists=2000-3000' ELSE 'REBUILD RECOMMENDED - Use lists=3000-5000' END AS advice,
round((count(*) - count(DISTINCT embedding_id)) * 100.0::DOUBLE / count(DISTINCT embedding_id), 2) AS replaced_percent FROM record_chunks"""
)
def maintenance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice on the cell index, rows without postings, share of replaced rows."""
    c = table(spark, sf_dir, "record_chunks")
    return monitor.maintenance(c, lexical.postings(c, "id", {"record_title": "A", "chunk_content": "B"}))


@query("SELECT files > 0 AS stored, bytes > 0 AS filled, largest <= bytes AS consistent FROM (SELECT 1 AS files, 1 AS bytes, 1 AS largest)")
def store_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of the stored index."""
    f = monitor.store_files(spark, _index_path(spark, sf_dir))
    return f.select((F.col("files") > 0).alias("stored"), (F.col("bytes") > 0).alias("filled"), (F.col("largest") <= F.col("bytes")).alias("consistent"))


@query("SELECT id FROM record_chunks WHERE embedding_id IS DISTINCT FROM (SELECT min(embedding_id) FROM record_chunks)")
def delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "record_chunks", "id", "embedding_id")
    return store.delete_by_id(c, "embedding_id", c.agg(F.min("embedding_id")).first()[0]).select("id")


@query("SELECT count(*) FILTER (WHERE date_created IS NULL) AS undated, count(*) FILTER (WHERE source_date_modified IS NULL) AS unmodified, count(*) FILTER (WHERE date_created IS NOT NULL AND source_date_modified IS NOT NULL) AS both FROM record_chunks")
def null_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m = F.col("date_created"), F.col("source_date_modified")
    return table(spark, sf_dir, "record_chunks").agg(F.count_if(c.isNull()).alias("undated"), F.count_if(m.isNull()).alias("unmodified"), F.count_if(c.isNotNull() & m.isNotNull()).alias("both"))


@query("SELECT id, 'hit' AS arm FROM record_chunks WHERE date_created::DATE >= DATE '2024-01-01' AND date_created::DATE <= DATE '2024-06-30' UNION ALL SELECT id, 'none' FROM record_chunks WHERE page_number > 0")
def date_filter_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback filter where the range holds rows, and where it holds none."""
    c = table(spark, sf_dir, "record_chunks")
    hit = filters.date_filter(c, "date_created", datetime(2024, 1, 1), datetime(2024, 6, 30), fallback=True).select("id", F.lit("hit").alias("arm"))
    return hit.union(filters.date_filter(c.where("page_number > 0"), "date_created", datetime(1950, 1, 1), datetime(1950, 2, 1), fallback=True).select("id", F.lit("none").alias("arm")))


@query(
    """SELECT id, 'uri' AS arm FROM record_chunks WHERE record_uri = 100000 UNION ALL SELECT id, 'dates' FROM record_chunks WHERE date_created BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01' UNION ALL SELECT id, 'extension' FROM record_chunks WHERE lower(file_extension) = '.pdf' UNION ALL SELECT id, 'all' FROM record_chunks"""
)
def search_dsl_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other condition of the search form."""
    c = table(spark, sf_dir, "record_chunks")
    arms = {"uri": {"uri": 100000, "phrases": ["x y z"]}, "dates": {"start": datetime(2024, 1, 1), "end": datetime(2024, 2, 1)}, "extension": {"extensions": ["pdf", "docx"]}, "all": {"phrases": ["ab"]}}
    parts = [c.where(scans.search_predicate(**a)).select("id", F.lit(k).alias("arm")) for k, a in arms.items()]
    return reduce(DataFrame.union, parts)


@query(
    """SELECT * FROM (SELECT id, 'uri' AS arm FROM record_chunks WHERE record_uri = 100000 ORDER BY id LIMIT 20) UNION ALL SELECT * FROM (SELECT id, 'container' FROM record_chunks WHERE starts_with(container, 'D1') ORDER BY id LIMIT 20) UNION ALL SELECT * FROM (SELECT id, 'day' FROM record_chunks WHERE date_created::DATE = (SELECT min(date_created)::DATE FROM record_chunks) ORDER BY id LIMIT 20)
UNION ALL SELECT * FROM (SELECT id, 'content' FROM record_chunks WHERE contains(lower(chunk_content), 'kilowatts') ORDER BY id LIMIT 20)"""
)
def advanced_filter_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other condition of the advanced filter."""
    c = table(spark, sf_dir, "record_chunks")
    day = c.agg(F.min("date_created")).first()[0].date()
    arms = {"uri": {"uri": 100000, "title": "x"}, "container": {"container": "D1", "content": "x"}, "day": {"start": day, "content": "x"}, "content": {"content": "Kilowatts"}}
    return reduce(DataFrame.union, [scans.advanced_filter(c, **a).select("id", F.lit(k).alias("arm")) for k, a in arms.items()])


@query("SELECT record_uri, title, lower(coalesce(is_container, '')) = 'container' AS container_flag FROM records WHERE contains(lower(title), 'harbour') AND contains(lower(title), 'pdf')")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_records(table(spark, sf_dir, "records"), "Harbour PDF").select("record_uri", "title", "container_flag")


@query(
    r"""SELECT 'uri' AS form, record_uri, title FROM (SELECT * FROM records WHERE record_uri = (SELECT min(record_uri) FROM records) ORDER BY date_modified NULLS FIRST LIMIT 1) UNION ALL SELECT 'recnum', record_uri, title FROM (SELECT * FROM records WHERE regexp_replace(title, '\.[^./\\]+$', '') = 'Lease DRW-2013-62809' ORDER BY record_uri, date_modified NULLS FIRST LIMIT 1)
UNION ALL SELECT 'bare', record_uri, title FROM (SELECT * FROM records WHERE title = (SELECT max(title) FROM records) ORDER BY record_uri, date_modified NULLS FIRST LIMIT 1) UNION ALL SELECT 'number', record_uri, title FROM (SELECT * FROM records WHERE ends_with(regexp_replace(title, '\.[^./\\]+$', ''), '-62809') ORDER BY record_uri, date_modified NULLS FIRST LIMIT 1)"""
)
def record_key_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record by each form of its key."""
    r = table(spark, sf_dir, "records")
    low, title = r.agg(F.min("record_uri"), F.max("title")).first()
    keys = {"uri": f"uri:{low}", "recnum": "recnum:Lease DRW-2013-62809", "bare": title, "number": "number:-62809"}
    return reduce(DataFrame.union, [scans.record_by_any_key(r, k).select(F.lit(f).alias("form"), "record_uri", "title") for f, k in keys.items()])


@query("SELECT 500 AS n, 500 AS full_length, 500 AS in_range, true AS varied")
def dummy_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the synthetic chunks: length, range, and that they differ."""
    d = scans.dummy_embeddings(spark, 500)
    inside = F.forall("vector", lambda x: (x >= -1) & (x <= 1))
    return d.agg(F.count("*").cast("int").alias("n"), F.count_if(F.size("vector") == 64).cast("int").alias("full_length"), F.count_if(inside).cast("int").alias("in_range"), (F.count_distinct("vector") == 500).alias("varied"))


@query(f"SELECT vec_id, round(CASE WHEN vec_id % 9 = 0 THEN 0.0 ELSE {_COS} END, 6) AS score FROM embeddings, {_Q}")
def file_store_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the file store, 0 for vectors that are cut short."""
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    return e.select("vec_id", F.round(vector.zero_or_cosine(F.col("embedding"), _query_vector(spark, sf_dir)), 6).alias("score"))


@query("SELECT l.id AS user_id, l.name AS name, array_to_string(coalesce((SELECT list_sort(list(DISTINCT g.name)) FROM user_groups u JOIN locations g ON g.id = u.group_id WHERE u.user_id = l.id), []), '|') AS groups FROM locations l WHERE l.type = 4")
def user_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of users and of their groups."""
    who = acl.identity(table(spark, sf_dir, "locations"), table(spark, sf_dir, "user_groups"))
    return who.select("user_id", "name", F.array_join("groups", "|").alias("groups"))


@query(
    """SELECT id, concat_ws(chr(10), 'Title: ' || nullif(record_title, ''), nullif(concat_ws(chr(10), 'container: ' || nullif(container, ''), 'file_type: ' || nullif(file_type, '')), '')) AS p FROM record_chunks"""
)
def preview_with_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview with further fields of the record."""
    none = F.lit(None).cast("string")
    meta = F.create_map(F.lit("meta_file_type"), F.coalesce("file_type", F.lit("")), F.lit("meta_container"), F.coalesce("container", F.lit("")), F.lit("other"), F.lit("x"))
    return table(spark, sf_dir, "record_chunks").select("id", text.content_preview(F.col("record_title"), none, none, none, none, meta).alias("p"))


@query(f"SELECT id, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS rerank_score FROM (SELECT *, length(t) AS raw FROM (SELECT vec_id AS id, {_COS} AS score, repeat('x', (vec_id % 17)::INTEGER) AS t FROM embeddings, {_Q} ORDER BY score DESC, vec_id LIMIT 50)) ORDER BY rerank_score DESC, score DESC, id LIMIT 10")
def rerank_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits reranked by a scorer of texts, here their length."""
    hits = vector.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 60, -2.0).withColumn("t", F.repeat(F.lit("x"), (F.col("id") % 17).cast("int")))
    return hybrid.rerank_with(hits, "q", "t", lambda _, texts: [float(len(t)) for t in texts], 10).select("id", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"SELECT id, round(score, 6) AS rerank_score FROM (SELECT vec_id AS id, {_COS} AS score FROM embeddings, {_Q} ORDER BY score DESC, vec_id LIMIT 8)")
def rerank_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No more hits than asked for come back as they are."""
    hits = vector.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 8, -2.0).withColumn("t", F.lit("x"))
    return hybrid.rerank_with(hits, "q", "t", lambda _, texts: [1.0] * len(texts), 10).select("id", F.round("rerank_score", 6).alias("rerank_score"))


@query("SELECT e.id, e.score - a.mean AS above FROM (SELECT event_id AS id, value AS score FROM events) e, (SELECT avg(value) AS mean FROM events) a WHERE e.score > a.mean + 3 * (SELECT stddev_samp(value) FROM events)")
def above_the_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against a scalar subquery, joined as one broadcast row."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"))
    stats = e.agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))  # one row
    return e.join(F.broadcast(stats)).where(F.col("score") > F.col("mean") + 3 * F.col("sd")).select("id", (F.col("score") - F.col("mean")).alias("above"))


@query()
def record_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about one record: hybrid anchors, their neighbours, the prompt and the answer."""
    chunks = table(spark, sf_dir, "record_chunks")
    uri = chunks.where("contains(lower(chunk_content), 'kilowatts') and vector is not null").agg(F.min("record_uri")).first()[0]
    own = filters.record_filter(chunks, [uri])
    q = next(iter(r[0] for r in own.where("size(vector) = 64").orderBy("id").select("vector").limit(1).collect()), None)
    return context.record_answer(own, _chunk_index(spark, sf_dir), "how many kilowatts", q, ExtractiveGenerator())
