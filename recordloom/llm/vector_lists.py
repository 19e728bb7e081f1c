"""Most similar vectors through balanced posting lists whose centroids are searched in an in-memory graph.

Building: balanced clustering of a bounded sample gives the centroids; each vector of the collection goes to
its nearest list, and a boundary vector also to further lists that are nearly as close, unless a list
already chosen lies nearer to that list than the vector does. A list beyond the length bound is cut into cells by
balanced clustering of a sample of its own, so the number of cells grows with the data. Searching: a best-first walk
over the centroids' neighbour graph finds the nearest lists of a query, their cells are ranked, distance ratio to the
nearest one prunes them, and the vectors of the cells that remain are compared exactly. A long cell is cut once
more, into short lists within its task, of which a query looks at those near enough.

Sizes: the sample has ``SAMPLE`` vectors, the graph ``MAX_LISTS`` centroids, and there are at most ``MAX_CELLS`` cells
beside, so what is broadcast does not grow with the data: the length bound ``SHARD_ROWS`` grows instead once there would
be more. Cells are packed into shards of about that many vectors; a cell longer than that, as copies of one vector
make, is spread over several shards by the hash of its ids. The shards decide the number of tasks. Queries travel to
a shard once, with the cells they want there, and come back with at most k hits per shard.

Defined results: a vector counts when it has ``dim`` finite values that are not all zero; others are nobody's
neighbour and have none. Several rows of one id count once, by the latest row that is valid. Ties in similarity
are ordered by id. Fewer than k others give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.session import bounded_broadcast, stage

SAMPLE = 40_000
MAX_LISTS = 4096
LIST_ROWS = 96
SHARD_ROWS = 16_384
MAX_CELLS = 131_072
MAX_PARTS = 4096  # cells of one list
LOCAL_ROWS = 2048  # a cell of more vectors is cut into lists of LIST_ROWS within its task
LOCAL_RATIO = 1.1
QUERY_BLOCK = 32_768
DEGREE = 24
REPLICAS = 4
CLOSURE = 1.12  # a further list may be this much farther than the nearest, in distance


def unit_rows(raw: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit float32 rows of the valid vectors in an Arrow list column, and which rows they are."""
    raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    offsets = raw.offsets.to_numpy()
    valid = np.diff(offsets) == dim
    if raw.null_count:
        valid &= raw.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(valid)
    flat = raw.values.to_numpy(zero_copy_only=False)
    m = flat[offsets[rows][:, None] + np.arange(dim)].astype(np.float64) if len(rows) else np.zeros((0, dim))
    norm = np.sqrt((m * m).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return (m[ok] / norm[ok, None]).astype(np.float32), rows[ok]


def _unit(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m, rows = unit_rows(batch.column(2), dim)
        data = pa.array([r.tobytes() for r in m], pa.binary())
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), data], names=["id", "version", "v"])


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, version: str, dim: int) -> DataFrame:
    """``(id, v)``: the latest valid vector of each id, scaled to length 1, as packed float32."""
    source = df.select(F.col(id_col).cast("string").alias("id"), F.struct(version).alias("version"), F.col(vector_col).cast("array<float>").alias("raw")).where("id is not null and raw is not null")
    kind = source.schema["version"].dataType
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("version", kind), T.StructField("v", T.BinaryType())])
    return source.mapInArrow(lambda it: _unit(it, dim), schema).groupBy("id").agg(F.max_by("v", "version").alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a column of packed float32 vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, dim), np.float32)
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.float32).reshape(len(column), dim)


@dataclass
class Lists:
    """Centroids in cluster order with their neighbour graph and entry points."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray


def _halve(m: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for the half of the rows that lies nearer to the second of two means; both halves are equally large."""
    a, b = m[rng.choice(len(m), 2, replace=False)]
    for _ in range(6):
        side = m @ (b - a)
        mask = np.zeros(len(m), bool)
        mask[np.argpartition(side, len(m) // 2)[len(m) // 2 :]] = True
        a, b = m[~mask].mean(0), m[mask].mean(0)
    return mask


def balanced_centroids(sample: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """Centroids of ``count`` clusters of nearly equal size, neighbours in the order of the splits."""
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    todo = [(sample, count)]
    while todo:
        m, k = todo.pop()
        if k == 1 or len(m) < 4:
            c = m.mean(0)
            out.append(c / max(float(np.linalg.norm(c)), 1e-12))
            continue
        mask = _halve(m, rng)
        todo.append((m[mask], k // 2))
        todo.append((m[~mask], k - k // 2))
    return np.asarray(out, np.float32)


def centroid_graph(c: np.ndarray, degree: int = DEGREE, seed: int = 7) -> Lists:
    """Neighbour graph: nearest centroids, pruned so that edges point in different directions, and some far ones."""
    n = len(c)
    rng = np.random.default_rng(seed)
    near = min(degree * 2, n - 1)
    graph = np.zeros((n, degree), np.int32)
    for lo in range(0, n, 1024):
        s = c[lo : lo + 1024] @ c.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -9
        part = np.argpartition(-s, near - 1, axis=1)[:, :near] if near else np.zeros((len(s), 0), np.int64)
        order = np.argsort(-np.take_along_axis(s, part, 1), axis=1)
        part = np.take_along_axis(part, order, 1)
        own = np.take_along_axis(s, part, 1)
        for r in range(len(s)):
            cand = part[r]
            between = c[cand] @ c[cand].T
            keep: list[int] = []
            for i in range(len(cand)):
                if len(keep) >= degree - 4:
                    break
                if all(between[i, j] < own[r, i] + 0.12 for j in keep):
                    keep.append(i)
            row = list(cand[keep])
            row += [x for x in cand if x not in row][: degree - 4 - len(row)]
            row += list(rng.integers(0, n, degree - len(row)))
            graph[lo + r] = row
    entries = np.unique(np.linspace(0, n - 1, min(n, 48)).astype(np.int32))
    return Lists(c, graph, entries)


def graph_search(lists: Lists, q: np.ndarray, beam: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest centroids found for each query, nearest first, and their similarities."""
    c, n = lists.centroids, len(lists.centroids)
    beam = min(beam, n)
    ids_out = np.zeros((len(q), beam), np.int32)
    sim_out = np.zeros((len(q), beam), np.float32)
    for lo in range(0, len(q), block):
        x = q[lo : lo + block]
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), n), bool)
        start = lists.entries
        width = max(beam, len(start))
        ids = np.full((len(x), width), -1, np.int32)
        sim = np.full((len(x), width), -9.0, np.float32)
        ids[:, : len(start)] = start
        sim[:, : len(start)] = x @ c[start].T
        seen[:, start] = True
        done = ids < 0
        step = 2 if beam <= 32 else 6
        active = np.arange(len(x))
        while len(active):
            s = np.where(done[active], -9.0, sim[active])
            best = np.argpartition(-s, min(step, width - 1), axis=1)[:, :step]
            score = np.take_along_axis(s, best, 1)
            kth = np.partition(sim[active], width - beam, axis=1)[:, width - beam] if width > beam else sim[active].min(1)
            use = (score > -9) & (score >= kth[:, None])
            live = use.any(1)
            active, best, use = active[live], best[live], use[live]
            if not len(active):
                break
            r = active[:, None]
            done[r, best] |= use
            node = np.where(use, ids[r, best], 0)
            nb = lists.graph[node].reshape(len(active), -1)
            fresh = ~seen[r, nb] & np.repeat(use, lists.graph.shape[1], axis=1)
            rr, cc = np.nonzero(fresh)
            if len(rr) == 0:
                continue
            key = rr.astype(np.int64) * n + nb[rr, cc]
            key = np.unique(key)
            rr, node = (key // n), (key % n).astype(np.int32)
            seen[active[rr], node] = True
            d = np.einsum("ij,ij->i", x[active[rr]], c[node])
            count = np.bincount(rr, minlength=len(active))
            most = int(count.max())
            at = np.arange(len(rr)) - np.repeat(np.cumsum(count) - count, count)
            add_ids = np.full((len(active), most), -1, np.int32)
            add_sim = np.full((len(active), most), -9.0, np.float32)
            add_ids[rr, at] = node
            add_sim[rr, at] = d
            all_ids = np.concatenate([ids[active], add_ids], 1)
            all_sim = np.concatenate([sim[active], add_sim], 1)
            all_done = np.concatenate([done[active], add_ids < 0], 1)
            top = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
            ids[active], sim[active], done[active] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sim, top, 1), np.take_along_axis(all_done, top, 1)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        ids_out[lo : lo + block], sim_out[lo : lo + block] = ids[rows, order], sim[rows, order]
    return ids_out, sim_out


def _distance(sim: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * sim, 0.0))


def choose_lists(lists: Lists, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and lists of all copies of the vectors ``m``: nearest list, then boundary replicas."""
    ids, sim = graph_search(lists, m, 12)
    ok = ids >= 0
    d = _distance(sim)
    chosen = np.zeros(ids.shape, bool)
    chosen[:, 0] = True
    taken = np.ones(len(m), np.int64)
    for j in range(1, ids.shape[1]):
        want = ok[:, j] & (d[:, j] <= CLOSURE * d[:, 0]) & (taken < REPLICAS)
        for i in range(j):  # skip a list that a chosen list covers
            cover = np.einsum("ij,ij->i", lists.centroids[ids[:, i]], lists.centroids[ids[:, j]])
            want &= ~(chosen[:, i] & (_distance(cover) < 0.9 * d[:, j]))
        chosen[:, j] = want
        taken += want
    row, col = np.nonzero(chosen)
    return row, ids[row, col]


@dataclass
class Cells:
    """Cells of each list, numbered in the order of the lists: the first one and how many, and all centroids."""

    first: np.ndarray
    count: np.ndarray
    centroids: np.ndarray

    def of(self, at: int) -> np.ndarray:
        return self.centroids[self.first[at] : self.first[at] + self.count[at]]


def place_in_cells(cells: Cells, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cell of each vector within the list it is in."""
    out = cells.first[at].astype(np.int64)
    for x in np.unique(at[cells.count[at] > 1]):
        rows = np.flatnonzero(at == x)
        for lo in range(0, len(rows), 8192):
            some = rows[lo : lo + 8192]
            out[some] += (m[some] @ cells.of(x).T).argmax(1)
    return out


def probe_cells(lists: Lists, cells: Cells, q: np.ndarray, probes: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, cells to search and their distances: at most ``probes`` cells, none farther than ``ratio`` times the nearest."""
    ids, sim = graph_search(lists, q, probes)
    row, col = np.nonzero(ids >= 0)
    at, s = ids[row, col], sim[row, col]
    whole = cells.count[at] == 1
    rows, which, sims = [row[whole]], [cells.first[at[whole]]], [s[whole]]
    for x in np.unique(at[~whole]):
        who = row[at == x]
        rows.append(np.repeat(who, cells.count[x]))
        which.append(np.tile(cells.first[x] + np.arange(cells.count[x]), len(who)))
        sims.append((q[who] @ cells.of(x).T).ravel())
    row, cell, d = np.concatenate(rows), np.concatenate(which), _distance(np.concatenate(sims))
    order = np.lexsort((cell, d, row))
    row, cell, d = row[order], cell[order], d[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(row)])
    keep = (np.arange(len(row)) - np.repeat(first, size) < probes) & (d <= ratio * np.repeat(d[first], size) + 1e-6)
    return row[keep], cell[keep], d[keep]


def fit_lists(vectors: DataFrame, dim: int, total: int, sample: int = SAMPLE) -> Lists:
    """Centroids and graph from at most ``sample`` vectors, chosen by the hash of their ids."""
    share = max(1, -(-total // sample))
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0) if share > 1 else vectors
    got = picked.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    m = matrix(got.column("v"), dim)
    count = int(np.clip(total // LIST_ROWS, 1, MAX_LISTS))
    return centroid_graph(balanced_centroids(m, max(1, min(count, len(m) // 4))), min(DEGREE, max(4, count)))


def _assign(batches: Iterator[pa.RecordBatch], lists, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, at = choose_lists(lists.value, matrix(batch.column(1), dim))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int32())], names=["id", "v", "list"])


def _part_centroids(of: pa.Table, parts: dict[int, int], dim: int) -> pa.Table:
    """``(list, part, c)``: centroids of the cells of one list, from a sample of its vectors."""
    at = of.column("list")[0].as_py()
    c = balanced_centroids(matrix(of.column("v"), dim), parts[at])
    return pa.table({"list": pa.array([at] * len(c), pa.int32()), "part": pa.array(range(len(c)), pa.int32()), "c": pa.array([r.tobytes() for r in c], pa.binary())})


def cut_long_lists(placed: DataFrame, sizes: dict[int, int], lists: Lists, dim: int, bound: int) -> Cells:
    """Cells of all lists: one for a list within the bound, else as many as keep a cell within half of it, up to ``MAX_PARTS``."""
    parts = {x: min(MAX_PARTS, -(-2 * n // bound)) for x, n in sizes.items() if n > bound}
    found: dict[int, list[np.ndarray]] = {}
    if parts:
        # about 64 vectors for each cell, chosen by hash
        some = placed.where(F.col("list").isin(list(parts))).where(F.pmod(F.xxhash64("id"), F.lit(max(1, bound // 128))) == 0)
        got = some.groupBy("list").applyInArrow(lambda t: _part_centroids(t, parts, dim), "list int, part int, c binary").orderBy("list", "part").collect()  # MAX_CELLS rows
        for r in got:
            found.setdefault(r["list"], []).append(np.frombuffer(r["c"], np.float32))
    each = [np.stack(found[x]) if x in found else lists.centroids[x : x + 1] for x in range(len(lists.centroids))]
    count = np.array([len(e) for e in each], np.int64)
    return Cells(np.cumsum(count) - count, count, np.concatenate(each))


def _to_cells(batches: Iterator[pa.RecordBatch], cells, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = place_in_cells(cells.value, matrix(batch.column(1), dim), batch.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32())], names=["id", "v", "cell"])


def _probe(batches: Iterator[pa.RecordBatch], shared, dim: int, probes: int, ratio: float) -> Iterator[pa.RecordBatch]:
    lists, cells = shared.value
    for batch in batches:
        row, at, d = probe_cells(lists, cells, matrix(batch.column(1), dim), probes, ratio)
        count = np.bincount(row, minlength=batch.num_rows)
        near = np.zeros(batch.num_rows, np.float32)
        near[row[::-1]] = d[::-1]  # the nearest of each query comes first
        wanted = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(at, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), wanted], names=["id", "v", "near", "cells"])


def _compared(q: np.ndarray, qs: np.ndarray, near: np.ndarray, m: np.ndarray, first: int, more: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Best ``more`` rows of ``m`` for each of the queries ``qs``, as (query, row, similarity); rows are numbered from ``first``."""
    todo = [(qs, np.arange(len(m)))]
    if len(m) > LOCAL_ROWS:
        # balanced lists within the cell; a query looks at those about as near as its nearest cell, and at some in any case
        count = -(-len(m) // LIST_ROWS)
        c = balanced_centroids(m[:: max(1, len(m) // (8 * count))], count)
        own = np.concatenate([(m[lo : lo + 8192] @ c.T).argmax(1) for lo in range(0, len(m), 8192)])
        by = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[by], np.arange(len(c) + 1))
        d = _distance(q[qs] @ c.T)
        some = min(7, d.shape[1] - 1)
        use = d <= np.maximum(LOCAL_RATIO * near[qs], np.partition(d, some, axis=1)[:, some])[:, None]
        todo = [(qs[use[:, j]], by[cut[j] : cut[j + 1]]) for j in range(len(c)) if cut[j + 1] > cut[j] and use[:, j].any()]
    for who, which in todo:
        for lo in range(0, len(which), 8192):
            s = q[who] @ m[which[lo : lo + 8192]].T
            if s.shape[1] > more:
                top = np.argpartition(-s, more - 1, axis=1)[:, :more]
                s = np.take_along_axis(s, top, 1)
            else:
                top = np.broadcast_to(np.arange(s.shape[1]), s.shape)
            yield np.repeat(who, s.shape[1]), first + which[lo + top].ravel(), s.ravel()


def _search(left: pa.Table, right: pa.Table, dim: int, k: int) -> pa.Table:
    """Exact comparison of the queries of a shard with the vectors in the cells they want."""
    m, cell = matrix(left.column("v"), dim), left.column("cell").to_numpy()
    q, near = matrix(right.column("v"), dim), right.column("near").to_numpy()
    empty = pa.table({"query": pa.array([], pa.string()), "id": pa.array([], pa.string()), "sim": pa.array([], pa.float32())})
    if not len(m) or not len(q):
        return empty
    own, qid = left.column("id").combine_chunks(), right.column("id").combine_chunks()
    order = np.argsort(cell, kind="stable")
    m, cell = m[order], cell[order]
    names, begin = np.unique(cell, return_index=True)
    end = np.r_[begin[1:], len(cell)]
    wants = right.column("cells").combine_chunks()
    off = wants.offsets.to_numpy() - wants.offsets.to_numpy()[0]
    w = wants.values.to_numpy(zero_copy_only=False)
    who = np.repeat(np.arange(len(q)), np.diff(off))
    by = np.argsort(w, kind="stable")
    w, who = w[by], who[by]
    lo, hi = np.searchsorted(w, names), np.searchsorted(w, names, "right")
    keep: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    more = k + 1  # one of them may be the query itself
    for x in range(len(names)):
        qs = who[lo[x] : hi[x]]
        if len(qs):
            keep += _compared(q, qs, near, m[begin[x] : end[x]], int(begin[x]), more)
    if not keep:
        return empty
    a, b, s = (np.concatenate(c) for c in zip(*keep))
    b = order[b]
    by = np.lexsort((b, -s, a))
    a, b, s = a[by], b[by], s[by]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    a, b, s = a[new], b[new], s[new]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    # replicas of one vector may stand in several cells of a shard: keep enough that k different ids remain
    use = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < more * REPLICAS
    return pa.table({"query": qid.take(pa.array(a[use])), "id": own.take(pa.array(b[use])), "sim": pa.array(s[use], pa.float32())})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64, probes: int = 192, ratio: float = 1.5) -> DataFrame:
    """``(query, id, sim, rank)``: the k most similar other ids of each query.

    ``vectors(id, v)`` is the collection, ``queries(id, v)`` what to search for, both as of
    :func:`unit_vectors` and staged.
    """
    spark = vectors.sparkSession
    total = vectors.count()
    schema = "query string, id string, sim float"
    if total == 0:
        return spark.createDataFrame([], schema + ", rank int")
    lists = spark.sparkContext.broadcast(fit_lists(vectors, dim, total))
    placed = stage(vectors.select("id", "v").mapInArrow(lambda it: _assign(it, lists, dim), "id string, v binary, list int"), "posting-lists")
    # list sizes: one row per list, MAX_LISTS at most
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    bound = max(SHARD_ROWS, -(-2 * sum(sizes.values()) // MAX_CELLS))
    cells = cut_long_lists(placed, sizes, lists.value, dim, bound)
    shared = spark.sparkContext.broadcast((lists.value, cells))
    if len(cells.centroids) > len(lists.value.centroids):
        only = spark.sparkContext.broadcast(cells)
        placed = stage(placed.mapInArrow(lambda it: _to_cells(it, only, dim), "id string, v binary, cell int"), "cells")
        sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MAX_LISTS + MAX_CELLS rows at most
    else:
        placed = placed.withColumnRenamed("list", "cell")
    first_shard, splits, shard, load = {}, {}, 0, 0
    for x in sorted(sizes):
        parts = -(-sizes[x] // bound)
        if load and (load + sizes[x] > bound or parts > 1):
            shard, load = shard + 1, 0
        first_shard[x], splits[x] = shard, parts
        if parts > 1:
            shard += parts
        else:
            load += sizes[x]
    plan = spark.createDataFrame([(int(x), int(first_shard[x]), int(splits[x])) for x in sizes], "cell int, first int, splits int")
    plan = F.broadcast(plan)  # MAX_LISTS + MAX_CELLS rows at most
    rows = placed.join(plan, "cell").select("id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("splits")).cast("int")).alias("shard"))
    asked = queries.select("id", "v").mapInArrow(lambda it: _probe(it, shared, dim, probes, ratio), "id string, v binary, near float, cells array<int>")
    asked = asked.select("id", "v", "near", F.explode("cells").alias("cell")).join(plan, "cell")
    asked = asked.select("id", "v", "near", "cell", F.explode(F.sequence("first", F.col("first") + F.col("splits") - 1)).alias("shard"))
    asked = stage(asked.groupBy("id", "shard").agg(F.first("v").alias("v"), F.first("near").alias("near"), F.collect_list("cell").alias("cells")), "probes")
    # many queries for one shard are cut into blocks, each of which meets all of the shard
    blocks = stage(asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("blocks")), "blocks")
    tasks = min(MAX_PARTS, max(1, 2 * (blocks.agg(F.sum("blocks")).first()[0] or 0)))
    blocks = bounded_broadcast(blocks, 100_000)
    left = rows.join(blocks, "shard").select("id", "v", "cell", F.col("shard").alias("ls"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("lb"))
    right = asked.join(blocks, "shard").select("id", "v", "near", "cells", F.col("shard").alias("rs"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("rb"))
    # adaptive execution does not split cogroups, so their number follows from the shards
    left, right = left.repartition(tasks, "ls", "lb"), right.repartition(tasks, "rs", "rb")
    hits = left.groupBy("ls", "lb").cogroup(right.groupBy("rs", "rb")).applyInArrow(lambda a, b: _search(a, b, dim, k), schema)
    best = hits.where("query <> id").groupBy("query", "id").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
