"""Cosine search: exact top-k, batched top-k for a table of queries, and search in a stored index of cells.

Vectors are float arrays of any one length. A vector that is null, of another length than the query, or without
a finite positive norm has no similarity (null) and is never a hit. Ties are ordered by id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK = 1024
# fixed values: rows up to -> number of cells of a cell index
CELL_TIERS = [(1_000_000, 100), (5_000_000, 1000), (10_000_000, 1500), (25_000_000, 2000), (50_000_000, 2500), (100_000_000, 3000)]
MOST_CELLS = 5000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null when the lengths differ or a norm is zero or not finite."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0) & (n < float("inf")), dot(a, b) / n)


def cosine_to(vector: Column, query: Sequence[float], stored_norm: Column | None = None) -> Column:
    """Cosine similarity to one query vector given as values."""
    q = F.array(*[F.lit(float(x)) for x in query])
    qn = math.sqrt(sum(float(x) ** 2 for x in query))
    n = stored_norm if stored_norm is not None else norm(vector)
    return F.when((F.size(vector) == len(query)) & (n > 0) & (n < float("inf")) & F.lit(qn > 0), dot(vector, q) / (n * F.lit(qn)))


def top_k(df: DataFrame, id_col: str, vector_col: str, query: Sequence[float], k: int = 10, threshold: float = 0.0, before_limit: bool = False) -> DataFrame:
    """``(id, score)`` of the k most similar rows; one matrix product per Arrow batch, k rows per task are shuffled.

    The threshold is applied after the limit, or before it with ``before_limit``.
    """
    hits = batch_top_k(df, id_col, vector_col, [(0, query)], k, ranked=False).select("id", "score")
    if before_limit:
        hits = hits.where(F.col("score") >= threshold)
    return hits.orderBy(F.desc("score"), "id").limit(k).where(F.col("score") >= threshold)


def zero_or_cosine(vector: Column, query: Sequence[float]) -> Column:
    """Similarity of the file store: 0 instead of null for unusable vectors."""
    return F.coalesce(cosine_to(vector, query), F.lit(0.0))


def batch_top_k(df: DataFrame, id_col: str, vector_col: str, queries: list[tuple[object, Sequence[float]]], k: int = 10, exclude_same: bool = False, ranked: bool = True) -> DataFrame:
    """``(query_id, id, score, rank)`` for many query vectors at once, exactly.

    Queries are given as values and go through the table in blocks of ``QUERY_BLOCK``; each task multiplies its
    Arrow batches by the block and keeps k rows per query, so only tasks * queries * k rows are shuffled. Without
    ``ranked`` the best k of each task come as they are, without rank.
    """
    kind = df.schema[id_col].dataType
    qkind = T.LongType() if all(isinstance(q, int) for q, _ in queries) else T.StringType()
    schema = T.StructType([T.StructField("query_id", qkind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    out = None
    for at in range(0, len(queries), QUERY_BLOCK):
        block = queries[at : at + QUERY_BLOCK]
        q = np.array([list(v) for _, v in block], np.float64)
        q /= np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-300)
        names = [i for i, _ in block]
        shared = df.sparkSession.sparkContext.broadcast((names, q))
        part = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
        hits = part.mapInArrow(lambda it, s=shared: _batch_scores(it, s, k, exclude_same), schema)
        out = hits if out is None else out.union(hits)
    if out is None:
        return df.sparkSession.createDataFrame([], schema.add(T.StructField("rank", T.IntegerType())))
    if not ranked:
        return out
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _batch_scores(batches: Iterator[pa.RecordBatch], shared, k: int, exclude_same: bool) -> Iterator[pa.RecordBatch]:
    names, q = shared.value
    dim = q.shape[1]
    ids: pa.Array | None = None
    best_i = np.zeros((len(names), 0), np.int64)
    best_s = np.zeros((len(names), 0))
    for batch in batches:
        lists = batch.column(1)
        off = lists.offsets.to_numpy()
        rows = np.flatnonzero(np.diff(off) == dim)
        if not len(rows):
            continue
        m = lists.values.to_numpy(zero_copy_only=False)[off[rows][:, None] + np.arange(dim)]
        n = np.sqrt((m * m).sum(1))
        ok = np.isfinite(n) & (n > 0)
        m, rows = m[ok] / n[ok, None], rows[ok]
        if not len(rows):
            continue
        new = batch.column(0).take(pa.array(rows))
        base = 0 if ids is None else len(ids)
        ids = new if ids is None else pa.concat_arrays([ids, new])
        s = q @ m.T
        if exclude_same:
            own = {v: j for j, v in enumerate(new.to_pylist())}
            for r, name in enumerate(names):
                if name in own:
                    s[r, own[name]] = -np.inf
        all_s = np.concatenate([best_s, s], 1)
        all_i = np.concatenate([best_i, np.broadcast_to(np.arange(base, base + len(rows)), s.shape)], 1)
        if all_s.shape[1] > k:
            # the k-th score may be shared: of rows as good as it those with the smallest ids stay
            kth = -np.partition(-all_s, k - 1, axis=1)[:, k - 1]
            width = int((all_s >= kth[:, None]).sum(1).max())
            if width < all_s.shape[1]:
                top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
                all_s, all_i = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            place = np.empty(len(ids), np.int64)
            place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
            best = np.lexsort((place[all_i], -all_s))[:, :k]
            all_s, all_i = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
        used, inverse = np.unique(all_i, return_inverse=True)
        ids, best_i, best_s = ids.take(pa.array(used)), inverse.reshape(all_i.shape), all_s
    if ids is None:
        return
    r, c = np.nonzero(np.isfinite(best_s))
    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in r]), ids.take(pa.array(best_i[r, c])), pa.array(best_s[r, c])], names=["query_id", "id", "score"])


def cell_count(rows: Column | int) -> Column | int:
    """Number of cells for a table of this many rows."""
    if isinstance(rows, int):
        return next((c for most, c in CELL_TIERS if rows < most), MOST_CELLS)
    out = F.when(rows < CELL_TIERS[0][0], CELL_TIERS[0][1])
    for most, c in CELL_TIERS[1:]:
        out = out.when(rows < most, c)
    return out.otherwise(MOST_CELLS)


def _unit_sample(df: DataFrame, vector_col: str, sample: int) -> np.ndarray:
    """Unit vectors of at most ``sample`` rows, chosen by hash, of the length most of them have."""
    got = df.select(F.col(vector_col).cast("array<double>").alias("v")).where("v is not null").orderBy(F.xxhash64("v")).limit(sample).toPandas()["v"]
    rows = [np.asarray(v) for v in got]
    if not rows:
        return np.zeros((0, 0))
    dim = Counter(map(len, rows)).most_common(1)[0][0]
    m = np.array([r for r in rows if len(r) == dim and np.isfinite(r).all() and (r * r).sum() > 0]).reshape(-1, dim)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def fit_cells(df: DataFrame, vector_col: str, cells: int, sample: int = 50_000, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centroids of spherical k-means on at most ``sample`` vectors; none for a table without usable vectors."""
    m = _unit_sample(df, vector_col, sample)
    if not len(m):
        return m
    c = m[np.random.default_rng(seed).choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        near = (m @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, m)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def assign_cells(df: DataFrame, id_col: str, vector_col: str, centroids: np.ndarray) -> DataFrame:
    """``(id, v, cell)``: the nearest cell of each vector of the centroids' length; other rows are left out."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            lists = batch.column(1)
            off = lists.offsets.to_numpy()
            rows = np.flatnonzero(np.diff(off) == c.shape[1])
            m = lists.values.to_numpy(zero_copy_only=False)[off[rows][:, None] + np.arange(c.shape[1])]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), lists.take(take), pa.array((m @ c.T).argmax(1) if len(rows) else [], pa.int32())], names=["id", "v", "cell"])

    usable = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    return usable.mapInArrow(run, schema) if len(centroids) else usable.withColumn("cell", F.lit(0)).limit(0)


@dataclass
class Cells:
    """A stored index of cells: its vectors ``(id, v, cell)`` partitioned by cell, its centroids, and how many to probe."""

    vectors: DataFrame
    centroids: np.ndarray
    probes: int

    def near(self, query: Sequence[float], probes: int | None = None) -> DataFrame:
        """Vectors of the cells nearest to the query; the folders of other cells are not read."""
        return self.vectors.where(F.col("cell").isin(probe_cells(self.centroids, query, probes or self.probes)))


def write_cells(df: DataFrame, id_col: str, vector_col: str, path: str, cells: int | None = None, k: int = 20) -> None:
    """Store the vectors of ``df`` by cell, with the centroids and the number of probes a recall of 0.95 for ``k`` needs.

    A cell of very many vectors is written by several tasks, spread by the hash of the vectors.
    """
    spark = df.sparkSession
    centroids = fit_cells(df, vector_col, cells or cell_count(df.count()))
    placed = assign_cells(df, id_col, vector_col, centroids)
    placed.repartition("cell", F.pmod(F.xxhash64("v"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/vectors")
    probes = probes_for(df, vector_col, centroids, k)
    rows = [(i, [float(x) for x in c], probes) for i, c in enumerate(centroids)]  # one row per cell
    spark.createDataFrame(rows, "cell int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{path}/centroids")


def open_cells(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> Cells:
    """A stored index of cells."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
    kind = id_type or T.LongType()
    schema = T.StructType([T.StructField("id", kind), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])
    return Cells(spark.read.schema(schema).parquet(f"{path}/vectors"), np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, 0)), rows[0]["probes"] if rows else 1)


def probe_cells(centroids: np.ndarray, query: Sequence[float], probes: int = 10) -> list[int]:
    """Numbers of the cells nearest to a query; filter ``cell`` by them to prune partitions."""
    return [int(x) for x in np.argsort(-(centroids @ np.asarray(query, np.float64)))[:probes]] if len(centroids) else []


def probes_for(df: DataFrame, vector_col: str, centroids: np.ndarray, k: int, recall: float = 0.95, asked: int = 500, sample: int = 50_000) -> int:
    """How many of the nearest cells hold a share ``recall`` of the true ``k`` nearest, on average.

    Measured by brute force for ``asked`` vectors of a sample; in a sample neighbours lie further apart than in
    the whole table, so it rather asks for too many cells. The default leaves room above the 0.9 that is due.
    """
    m = _unit_sample(df, vector_col, sample)
    if not len(m):
        return len(centroids)
    cell = (m @ centroids.T).argmax(1)
    q = m[:: max(1, len(m) // asked)][:asked]
    k = min(k, len(m))
    true = cell[np.argpartition(-(q @ m.T), k - 1, axis=1)[:, :k]]
    # place of each true neighbour's cell among the cells of the query, nearest first
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
    needed = np.take_along_axis(place, true, 1)
    return next((p for p in range(1, len(centroids) + 1) if (needed < p).mean() >= recall), len(centroids))
