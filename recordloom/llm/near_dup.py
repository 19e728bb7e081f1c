"""Near-duplicate records: T-occurrence search with the DivideSkip division of inverted lists.

The content of a record is the set of word shingles of its title and of each of its chunks. Two records
match when their sets have at least ``threshold`` of their union in common. A record of n shingles needs
T = ceil(threshold * n) common shingles with any match. Its shingles are ordered from rare to frequent. The
L = T - l most frequent ones form the long lists, which are never merged but probed by binary search during
verification; the lists of the others are short and are merged, and a match must occur at least l times
there (``l = 1 + n // MERGE_SHARE``). Seen from the smaller record of a pair the bound is tighter, so a list
entry says whether it may serve as the smaller side.

Short lists are merged as sorted runs: a task holds whole lists, sorts the pairs that meet in them and counts each
run, so a pair leaves a task as one row with its count, however many lists it shares there.

Scale: the order only steers cost, any fixed order gives the same result, so it comes from lossy counting over all
records, and the table of frequent shingles holds at most ``FREQUENT_LIMIT`` entries by construction. Lists are
spread by shingle. Their lengths are counted exactly, after the order has chosen which entries they hold, and every
list longer than ``HOT_LIST`` is cut into blocks that meet pairwise in separate groups. Records with equal sets (by
two 64-bit hashes and the size) travel as one class; a class of more than ``HOT_LIST`` records is cut into blocks
too where its pairs are asked for.

Defined results: a record without any shingle (empty or very short texts) has no pairs; null contents count
as empty; rows without ``record_uri`` are left out; repeated rows change nothing, since contents are sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.words import list_array, list_parts, shingles, word_hashes, words
from recordloom.session import bounded_broadcast, stage

FREQUENT_LIMIT = 1 << 22
MERGE_SHARE = 20
HOT_LIST = 4096
COPIES = 1 << 20  # rows of a broadcast of ids; beyond it the join is a shuffle
_FLUSH = 2_000_000


def _content(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shingle sets per record, united over a stretch of rows, so repeated rows of one record leave a task once."""

    def give(of: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        sets = [np.unique(np.concatenate(p)) if p else np.zeros(0, np.uint64) for p in of.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(of), pa.int64()), list_array(sets, pa.int64())], names=["uri", "toks"])

    of: dict[int, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        uri = batch.column(0).to_numpy(zero_copy_only=False)
        titles: dict[str, np.ndarray] = {}
        for u, title, text in zip(uri, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            parts = of.setdefault(u, [])
            if title and title not in titles:
                titles[title] = shingles(word_hashes(words(title)), k)
            if title:
                parts.append(titles[title])
            if text:
                parts.append(shingles(word_hashes(words(text)), k))
                size += len(parts[-1])
            if size > _FLUSH:
                yield give(of)
                of, size = {}, 0
    if of:
        yield give(of)


def record_sets(chunks: DataFrame, k: int = 3) -> DataFrame:
    """``(uri, toks, n, sig, sig2)``: the shingle set of each record, its size and two hashes."""
    part = chunks.select("record_uri", "record_title", "chunk_content").where("record_uri is not null").mapInArrow(lambda it: _content(it, k), "uri long, toks array<long>")
    sets = part.groupBy("uri").agg(F.flatten(F.collect_list("toks")).alias("toks"))
    sets = sets.select("uri", F.sort_array(F.array_distinct("toks")).alias("toks")).where(F.size("toks") > 0)
    return sets.select("uri", "toks", F.size("toks").alias("n"), F.xxhash64("toks").alias("sig"), F.xxhash64(F.lit(1), "toks").alias("sig2"))


def equal_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members(uri, rep, m)`` with the smallest uri of an equal set and how many are equal, and the sets of these alone."""
    key = ["sig", "sig2", "n"]
    several = sets.groupBy(*key).agg(F.min("uri").alias("rep"), F.count("*").alias("m")).where("m > 1")
    copies = stage(sets.select("uri", *key).join(several, key).select("uri", "rep", "m"), "copies")
    members = sets.select("uri").join(copies, "uri", "left").select("uri", F.coalesce("rep", "uri").alias("rep"), F.coalesce("m", F.lit(1)).alias("m"))
    return members, sets.join(bounded_broadcast(copies.where("uri <> rep").select("uri"), COPIES), "uri", "left_anti").select("uri", "toks", "n")


def _blocks(rows: DataFrame, of: list[str], ident: str) -> DataFrame:
    """``rows`` with a count ``size`` of their group cut into blocks: a row goes to each pair of blocks its own is part of.

    ``block`` names the pair within the group; ``side`` is 0 where a block meets itself, else 1 or 2.
    """
    rows = rows.withColumn("_b", F.ceil(F.col("size") / HOT_LIST).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(ident), F.col("_b")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(low == high, 0).when(F.col("_own") == high, 2).otherwise(1).cast("byte")
    return rows.select(*of, (low.cast("long") * F.col("_b") + high).alias("block"), side.alias("side"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lossy counts of a partition: shingles met at least twice in a stretch of records."""

    def give(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        m = c > 1
        return pa.RecordBatch.from_arrays([pa.array(h[m], pa.int64()), pa.array(c[m], pa.int64())], names=["h", "c"])

    held, size = [], 0
    for batch in batches:
        _, t = list_parts(batch.column(0))
        held.append(t)
        size += len(t)
        if size > 2 * _FLUSH:
            yield give(held)
            held, size = [], 0
    if size:
        yield give(held)


def _frequent(sets: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their counts, at most FREQUENT_LIMIT of them since their counts sum to ``total`` at most."""
    least = max(4, -(-total // FREQUENT_LIMIT))
    found = sets.select("toks").mapInArrow(_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    got = found.toArrow()
    h, c = got.column("h").to_numpy(), np.minimum(got.column("c").to_numpy(), 2**31 - 1).astype(np.int32)
    order = np.argsort(h)
    return h[order], c[order]


def _routes(batches: Iterator[pa.RecordBatch], frequent, num: int, den: int) -> Iterator[pa.RecordBatch]:
    fh, fc = frequent.value
    for batch in batches:
        off, toks = list_parts(batch.column(0))
        uri = batch.column(1).to_numpy()
        n = np.diff(off)
        if len(toks) == 0:
            continue
        own = np.repeat(np.arange(len(n)), n)
        if len(fh):
            at = np.minimum(np.searchsorted(fh, toks), len(fh) - 1)
            df = np.where(fh[at] == toks, fc[at], 0)
        else:
            df = np.zeros(len(toks), np.int32)
        order = np.lexsort((toks, df, own))
        toks, df = toks[order], df[order]
        rank = np.arange(len(toks)) - off[:-1][own]
        need = np.minimum(1 + n // MERGE_SHARE, -(-num * n // den))
        probe = n - -(-num * n // den) + need
        index = n - -(-2 * num * n // (den + num)) + need
        take = rank < np.minimum(probe, n)[own]
        small = (rank < index[own])[take]
        h, o = toks[take], own[take]
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n[o], pa.int32()), pa.array(uri[o], pa.int64()), pa.array(small)], names=["h", "n", "uri", "small"])


def _merge(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Merge sorted lists: how often each pair of sets occurs together in the lists of this task."""
    pend_a: list[np.ndarray] = []
    pend_b: list[np.ndarray] = []
    pend_n: list[np.ndarray] = []
    size = 0

    def give() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if size:
            a, b, n = np.concatenate(pend_a), np.concatenate(pend_b), np.concatenate(pend_n)
            order = np.lexsort((b, a))
            a, b, n = a[order], b[order], n[order]
            head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            count = np.diff(np.r_[head, len(a)])
            yield pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(n[head], pa.int32()), pa.array(count, pa.int32())], names=["a", "b", "need", "c"])
        pend_a.clear(), pend_b.clear(), pend_n.clear()
        size = 0

    def pairs(h, block, n, uri, small, side) -> Iterator[pa.RecordBatch]:
        nonlocal size
        group = np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (block[1:] != block[:-1])])
        at, d = np.arange(len(h)), 1
        while len(at):
            at = at[at + d < len(h)]
            # sorted by size: once the partner is too large, or the list ends, later partners are too
            at = at[(group[at + d] == group[at]) & (den * n[at] >= num * n[at + d])] if len(at) else at
            hit = at[small[at] & ((side[at] == 0) | (side[at] != side[at + d]))]
            if len(hit):
                pend_a.append(uri[hit]), pend_b.append(uri[hit + d])
                pend_n.append(np.minimum(1 + n[hit] // MERGE_SHARE, -(-num * n[hit] // den)))
                size += len(hit)
                if size > _FLUSH:
                    yield from give()
            d += 1

    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        if len(cols[0]) == 0:
            continue
        h, block = cols[0], cols[1]
        cut = len(h) - int(np.argmax((h[::-1] != h[-1]) | (block[::-1] != block[-1])))  # the last list may go on in the next batch
        cut = 0 if cut == len(h) else cut
        rest = [c[cut:] for c in cols]
        if cut:
            yield from pairs(*[c[:cut] for c in cols])
    if rest is not None and len(rest[0]):
        yield from pairs(*rest)
    yield from give()


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        oa, ta = list_parts(batch.column(2))
        ob, tb = list_parts(batch.column(3))
        common = np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            x, y = ta[oa[i] : oa[i + 1]], tb[ob[i] : ob[i + 1]]
            if len(y):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common[i] = np.count_nonzero(y[at] == x)
        union = np.diff(oa) + np.diff(ob) - common
        keep = pa.array(den * common >= num * union)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(common / np.maximum(union, 1)).filter(keep)], names=["a", "b", "similarity"])


def _lists(routes: DataFrame) -> DataFrame:
    """``(h, block, n, uri, small, side)``: staged ``routes`` with every list longer than ``HOT_LIST`` cut into blocks."""
    plain = ["h", "block", "n", "uri", "small", "side"]
    hot = stage(routes.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > HOT_LIST), "hot-lists")
    lists = routes.withColumns({"block": F.lit(0).cast("long"), "side": F.lit(0).cast("byte")}).select(plain)
    if hot.isEmpty():
        return lists
    few = bounded_broadcast(hot, COPIES)
    return lists.join(few, "h", "left_anti").union(_blocks(routes.join(few, "h"), ["h", "n", "uri", "small"], "uri").select(plain))


def class_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` between uris; ``sets(uri, toks, n)`` holds no set twice."""
    spark = sets.sparkSession
    t = Fraction(str(threshold))
    num, den = t.numerator, t.denominator
    total = sets.agg(F.sum("n")).first()[0] or 0
    frequent = spark.sparkContext.broadcast(_frequent(sets, total))
    routes = stage(sets.select("toks", "uri").mapInArrow(lambda it: _routes(it, frequent, num, den), "h long, n int, uri long, small boolean"), "routes")
    lists = _lists(routes).repartition("h", "block").sortWithinPartitions("h", "block", "n", "uri")
    counted = lists.mapInArrow(lambda it: _merge(it, num, den), "a long, b long, need int, c int")
    wanted = counted.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")
    wanted = stage(wanted, "candidates")
    ids = wanted.select(F.col("a").alias("uri")).union(wanted.select(F.col("b").alias("uri"))).distinct()
    of = stage(sets.join(ids, "uri", "left_semi").select("uri", "toks"), "candidate-sets")
    both = wanted.join(of.select(F.col("uri").alias("a"), F.col("toks").alias("ta")), "a").join(of.select(F.col("uri").alias("b"), F.col("toks").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(lambda it: _verify(it, num, den), "a long, b long, similarity double")


def similar_classes(chunks: DataFrame, threshold: float = 0.7, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """``members(uri, rep, m)`` and staged ``pairs(a, b, similarity)`` between the representatives of equal sets."""
    members, once = equal_sets(stage(record_sets(chunks, k), "record-sets"))
    return members, stage(class_pairs(once, threshold), "class-pairs")


def similar_records(chunks: DataFrame, threshold: float = 0.7, k: int = 3) -> DataFrame:
    """All pairs ``(record_uri_a, record_uri_b)`` of different records that match, smaller first, each once."""
    members, pairs = similar_classes(chunks, threshold, k)
    left = members.select(F.col("uri").alias("u"), F.col("rep").alias("a"))
    right = members.select(F.col("uri").alias("v"), F.col("rep").alias("b"))
    between = pairs.join(left, "a").join(right, "b").select("u", "v")
    equal = _blocks(members.where("m > 1").withColumn("size", F.col("m")), ["rep", "uri"], "uri")
    one = equal.select("rep", "block", F.col("uri").alias("u"), F.col("side").alias("su"))
    two = equal.select("rep", "block", F.col("uri").alias("v"), F.col("side").alias("sv"))
    within = one.join(two, ["rep", "block"]).where("u < v and (su = 0 or su <> sv)").select("u", "v")
    return between.union(within).select(F.least("u", "v").alias("record_uri_a"), F.greatest("u", "v").alias("record_uri_b"))


def similar_groups(chunks: DataFrame, threshold: float = 0.7, k: int = 3) -> DataFrame:
    """``(record_uri, class_id, group_id, n_links)``: one row per record.

    ``class_id`` is the smallest uri with an equal set, ``group_id`` the smallest uri reachable over links
    (its own where it has none) and ``n_links`` the number of other records it matches. Groups are found by
    label spreading with pointer jumping over class links only, each round a staged table, so neither links
    nor labels reach the driver.
    """
    members, pairs = similar_classes(chunks, threshold, k)
    members = stage(members, "members")
    classes = members.where("uri = rep").select(F.col("rep").alias("class_id"), "m")
    ends = pairs.select(F.col("a").alias("own"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("own"), F.col("a").alias("other")))
    edges = stage(ends.join(classes.select(F.col("class_id").alias("other"), F.col("m").alias("mo")), "other").select("own", "other", "mo"), "links")
    links = edges.groupBy(F.col("own").alias("class_id")).agg(F.sum("mo").alias("links"))
    label = stage(edges.select(F.col("own").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        near = edges.join(label.select(F.col("node").alias("other"), "label"), "other").groupBy(F.col("own").alias("node")).agg(F.min("label").alias("near"))
        nxt = label.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = nxt.select(F.col("node").alias("label"), F.col("label").alias("up"))
        nxt = stage(nxt.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        label = nxt.select("node", "label")
        if nxt.where("label <> old").isEmpty():
            break
    out = classes.join(links, "class_id", "left").join(label.select(F.col("node").alias("class_id"), F.col("label").alias("g")), "class_id", "left")
    out = out.select("class_id", F.coalesce("g", "class_id").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    return members.select(F.col("uri").alias("record_uri"), F.col("rep").alias("class_id")).join(out, "class_id").select("record_uri", "class_id", "group_id", "n_links")
