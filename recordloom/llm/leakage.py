"""Find evaluation passages inside a corpus with an FM-index per training shard.

A task collects documents until it holds ``SHARD_WORDS`` words, numbers the words that evaluation items use
(every other word is a separator of its own), and indexes the sequence. All phrases of ``SEED`` words of the
items are searched backwards at once; a passage of ``least`` words with at most one in ``1 / CHANGED`` changed always
holds such a phrase unchanged. Every occurrence is located, however frequent the phrase, by sampled suffix
positions, and chained: hits of one item in one document on
nearly the same diagonal, with gaps of a few changed words, form a passage. A passage counts when it holds at
least ``least`` words of the item outside its shared lines, of which no more than one in ``1 / CHANGED`` are
changed; a chain with more changed words is trimmed to the parts of it that count. A line that stands in more than ``SHARED`` different items, of all items, is an instruction and counts nothing.

Scale: documents are never shuffled, and are scanned and indexed once for each ``PASS_WORDS`` words of items, so the
items that are broadcast at a time are bounded whatever their number. Within a pass they are searched in blocks of
``BLOCK`` items, and occurrences are located for as many items at a time as have ``HITS`` together, so what each
task holds is bounded by pass and shard. Lines are counted before items are cut into passes, so results do not
depend on passes and blocks.

Defined results: null and empty texts and items have no passages; repeated documents and repeated items are
reported each on its own, a null ``item_id`` too; a document may hold several items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.fm_index import FMIndex
from recordloom.llm.words import WORD, words
from recordloom.session import bounded_broadcast, stage

SHARD_WORDS = 1_000_000
SEED = 4
HITS = 1_000_000
BLOCK = 4000
PASS_WORDS = 4_000_000
SHARED = 2
CHANGED = 0.2
DRIFT, GAP = 3, 9


class Items:
    """Words of the items of a pass, given as lines and whether they are instructions: numbers, offsets, and which words count."""

    def __init__(self, rows: list[tuple[int | None, list[tuple[str, bool]]]]):
        self.ids = [r[0] for r in rows]
        seqs = [[(w, shared) for line, shared in lines for w in line.split()] for _, lines in rows]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for s in seqs for w, _ in s}))}
        self.offsets = np.r_[0, np.cumsum([len(s) for s in seqs])].astype(np.int64)
        self.text = np.array([self.number[w] for s in seqs for w, _ in s], np.int64)
        self.counts = np.array([not x for s in seqs for _, x in s], bool)
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(self.offsets))


def _seeds(index: FMIndex, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text positions and item word positions of all phrases found, whole items at a time, of ``HITS`` together."""
    for first in range(0, len(items.ids), BLOCK):
        yield from _block_seeds(index, items, int(items.offsets[first]), int(items.offsets[min(first + BLOCK, len(items.ids))]))


def _block_seeds(index: FMIndex, items: Items, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = np.arange(lo, hi)
    last = at[at - items.offsets[:-1][items.owner[lo:hi]] >= SEED - 1]
    low = np.zeros(len(last), np.int64)
    high = np.full(len(last), index.n, np.int64)
    for length in range(1, SEED + 1):
        if not len(last):
            return
        low, high = index.extend(low, high, items.text[last - length + 1])
        live = high > low
        last, low, high = last[live], low[live], high[live]
    at, count = last - SEED + 1, high - low
    owner = items.owner[at]
    cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    start, total = 0, np.r_[0, np.cumsum(count)]
    for stop, after in zip(cuts, np.r_[cuts[1:], len(at)]):
        if total[after] - total[start] > HITS:
            yield _located(index, low[start:stop], count[start:stop], at[start:stop])
            start = stop
    if start < len(at):
        yield _located(index, low[start:], count[start:], at[start:])


def _located(index: FMIndex, low: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rep = np.repeat(np.arange(len(count)), count)
    return index.locate(low[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)), at[rep]


def _passages(text: np.ndarray, doc_off: np.ndarray, pos: np.ndarray, item_at: np.ndarray, items: Items, least: int) -> list[tuple[int, int, int, int, int]]:
    """``(doc number, item number, first word, past the last word, words held)`` of the passages behind the hits."""
    doc = np.searchsorted(doc_off, pos, "right") - 1
    item = items.owner[item_at]
    diag = pos - item_at
    order = np.lexsort((diag, doc * len(items.ids) + item))
    doc, item = doc[order], item[order]
    head = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])][: len(doc)]
    # a pair with a passage has this many phrases unchanged near one diagonal, as each changed word spoils SEED of them
    fewest = max(1, math.ceil(least * (1 - (SEED - 1) * CHANGED / (1 - CHANGED)) - SEED + 1 - 1e-9))
    place = (np.cumsum(head) - 1) * (4 * (len(text) + len(items.text))) + diag[order]
    near = np.searchsorted(place, place + DRIFT, "right") - np.searchsorted(place, place - DRIFT) >= fewest
    use = np.repeat(np.logical_or.reduceat(near, np.flatnonzero(head)), np.diff(np.r_[np.flatnonzero(head), len(doc)])) if len(doc) else near
    order, doc, item = order[use], doc[use], item[use]
    pos, item_at, diag = pos[order], item_at[order], diag[order]
    order = np.lexsort((pos, item, doc))
    pos, item_at, doc, item, diag = pos[order], item_at[order], doc[order], item[order], diag[order]
    new_pair = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])][: len(doc)]
    starts = np.flatnonzero(new_pair)
    stops = np.r_[starts[1:], len(pos)]
    room = _room(text, doc_off, np.cumsum(new_pair) - 1, doc[starts], item[starts], diag, items) >= least - 1e-6
    some = np.logical_or.reduceat(room, starts) if len(starts) else np.zeros(0, bool)
    out = []
    for s, e in zip(starts[some], stops[some]):
        d, it = int(doc[s]), int(item[s])
        dlo, dhi = int(doc_off[d]), int(doc_off[d + 1])
        ilo, ihi = int(items.offsets[it]), int(items.offsets[it + 1])
        # each diagonal near which hits gather is aligned once
        used: set[int] = set()
        found: list[tuple[int, int, int]] = []
        for g, _ in Counter(diag[s:e][room[s:e]].tolist()).most_common():
            if any(abs(g - u) <= DRIFT for u in used):
                continue
            used.add(g)
            near = np.abs(diag[s:e] - g) <= DRIFT
            found += _align(text[dlo:dhi], items.text[ilo:ihi], items.counts[ilo:ihi], pos[s:e][near] - dlo, item_at[s:e][near] - ilo)
        best = [f for f in found if f[2] >= least]
        out += [(d, it, f[0], f[1], f[2]) for f in best]
    return out


def _room(text: np.ndarray, doc_off: np.ndarray, pair: np.ndarray, doc: np.ndarray, item: np.ndarray, diag: np.ndarray, items: Items) -> np.ndarray:
    """For each hit the most words that a passage near its diagonal can hold.

    A hit is extended along its diagonal only, so the words that match are among those equal on the diagonals of
    the pair's hits; a passage has no more changed words beside them than ``CHANGED`` allows. No passage is lost.
    """
    order = np.lexsort((diag, pair))
    pair, diag = pair[order], diag[order]
    first = np.r_[True, (pair[1:] != pair[:-1]) | (diag[1:] != diag[:-1])][: len(pair)]
    line = np.cumsum(first) - 1
    pair, diag = pair[first], diag[first]
    begin, stop = items.offsets[item[pair]], items.offsets[item[pair] + 1]
    # item words that stand beside words of the document on this diagonal
    begin, stop = np.maximum(begin, doc_off[doc[pair]] - diag), np.minimum(stop, doc_off[doc[pair] + 1] - diag)
    size = stop - begin
    most = np.zeros(len(pair))
    ends = np.cumsum(size)
    at = 0
    while at < len(pair):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
        n = size[at:to]
        rep = np.repeat(np.arange(to - at), n)
        q = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n) + begin[at:to][rep]
        same = text[q + diag[at:to][rep]] == items.text[q]
        most[at:to] = np.bincount(rep[same], items.counts[q[same]] + CHANGED / (1 - CHANGED), to - at)
        at = to
    # diagonals within DRIFT are aligned together
    place, total = pair * 4 * (len(text) + len(items.text)) + diag, np.r_[0, np.cumsum(most)]
    near = total[np.searchsorted(place, place + DRIFT, "right")] - total[np.searchsorted(place, place - DRIFT)]
    out = np.empty(len(order))
    out[order] = near[line]
    return out


def _align(doc: np.ndarray, item: np.ndarray, counts: np.ndarray, dpos: np.ndarray, ipos: np.ndarray) -> list[tuple[int, int, int]]:
    """Chains of matching stretches around the hits, as (first word, past the last word, item words held)."""
    order = np.lexsort((dpos, ipos))
    matched: dict[int, int] = {}  # item word -> document word
    for p, q in zip(dpos[order], ipos[order]):
        if matched.get(int(q)) == int(p):
            continue
        a, b = int(p), int(q)
        while a > 0 and b > 0 and doc[a - 1] == item[b - 1] and (b - 1) not in matched:
            a, b = a - 1, b - 1
        while a < len(doc) and b < len(item) and doc[a] == item[b]:
            matched.setdefault(b, a)
            a, b = a + 1, b + 1
        # single changed words: step over one or two and go on while matches follow
        while True:
            for skip in (1, 2):
                if a + skip + 1 < len(doc) and b + skip + 1 < len(item) and (doc[a + skip : a + skip + 2] == item[b + skip : b + skip + 2]).all():
                    break
            else:
                break
            a, b = a + skip, b + skip
            while a < len(doc) and b < len(item) and doc[a] == item[b]:
                matched.setdefault(b, a)
                a, b = a + 1, b + 1
    if not matched:
        return []
    ks = sorted(matched)
    chains: list[list[int]] = [[ks[0]]]
    for x, y in zip(ks, ks[1:]):
        gap_i, gap_d = y - x - 1, matched[y] - matched[x] - 1
        if 0 <= gap_d <= GAP and gap_i <= GAP and abs(gap_i - gap_d) <= DRIFT:
            chains[-1].append(y)
        else:
            chains.append([y])
    out = []
    held = np.r_[0, np.cumsum(counts)]
    while chains:
        c = np.array(chains.pop(), np.int64)
        i, j = _fullest(c, held)
        lo, hi = int(c[i]), int(c[j])
        out.append((matched[lo], matched[hi] + 1, int(held[hi + 1] - held[lo])))
        # what is left on both sides may hold passages of its own
        chains += [x.tolist() for x in (c[:i], c[j + 1 :]) if len(x) >= SEED]
    return out


def _fullest(chain: np.ndarray, held: np.ndarray) -> tuple[int, int]:
    """First and last place of the part of a chain with few enough changed words that holds most words."""
    k = np.arange(len(chain))
    # a part from i to j is good enough when end[j] >= begin[i]; the last such j of each i
    end, begin = k + 1 - (1 - CHANGED) * (chain + 1), k - (1 - CHANGED) * chain
    best = np.maximum.accumulate(end[::-1])[::-1]
    last = np.searchsorted(-best, -(begin - 1e-6), "right") - 1
    i = int(np.argmax(held[chain[last] + 1] - held[chain]))
    return i, int(last[i])


def _scan(batches: Iterator[pa.RecordBatch], shared, least: int, spans: bool) -> Iterator[pa.RecordBatch]:
    items: Items = shared.value
    number, top = items.number.get, len(items.number)
    names = ["doc_id", "item_id", "start_char", "end_char", "words"] if spans else ["doc_id", "item_id"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()][: len(names)]

    longest = int(np.diff(items.offsets).max(initial=0))
    room = max(SHARD_WORDS, 4 * longest)

    def give(ids: list, texts: list, seqs: list, bases: list) -> pa.RecordBatch:
        doc_off = np.r_[0, np.cumsum([len(s) + 1 for s in seqs])].astype(np.int64)
        text = np.zeros(int(doc_off[-1]), np.int64)
        for o, s in zip(doc_off, seqs):
            text[o : o + len(s)] = s
        other = text == 0
        text[other] = top + 1 + np.arange(int(other.sum()))
        index = FMIndex(text, top)
        found = [f for pos, at in _seeds(index, items) for f in _passages(text, doc_off, pos, at, items, least)]
        rows = {}
        for d, i, a, b, w in found:
            rows.setdefault((ids[d], i), []).append((a + bases[d], b + bases[d], w, d))
        out = []
        for (doc, i), ps in rows.items():
            if not spans:
                out.append((doc, items.ids[i]))
                continue
            at_char = [m.span() for m in WORD.finditer(texts[ps[0][3]].lower())]
            merged: list[list[int]] = []
            for a, b, w, _ in sorted(ps):
                if merged and a <= merged[-1][1]:
                    merged[-1][1], merged[-1][2] = max(b, merged[-1][1]), max(w, merged[-1][2])
                else:
                    merged.append([a, b, w])
            out += [(doc, items.ids[i], at_char[a][0], at_char[b - 1][1], w) for a, b, w in merged]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    ids, texts, seqs, bases, size = [], [], [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seq = [number(w, 0) for w in words(t)]
            if len(seq) < SEED:
                continue
            # a text beyond half a shard is searched in parts that overlap by more than an item's length
            half, lap = room // 2, longest + GAP
            for base in range(0, max(1, len(seq) - lap), half):
                part = seq[base : base + half + lap] if len(seq) > half + lap else seq
                if size and size + len(part) + 1 > room:
                    yield give(ids, texts, seqs, bases)
                    ids, texts, seqs, bases, size = [], [], [], [], 0
                ids.append(i), seqs.append(part), texts.append(t if spans else None), bases.append(base)
                size += len(part) + 1
                if part is seq:
                    break
    if ids:
        yield give(ids, texts, seqs, bases)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(uid, n, line, item)``: the words of each line of each item, and of the whole item, as one string each."""
    for batch in batches:
        out = [(u, n, line, " ".join(words(t))) for u, t in zip(*(c.to_pylist() for c in batch.columns)) for n, x in enumerate(t.split("\n")) if (line := " ".join(words(x)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["uid", "n", "line", "item"])


def _marked_items(evals: DataFrame) -> DataFrame:
    """``(item_id, lines)`` of each item with words, its lines in order with whether they are instructions."""
    rows = stage(evals.select("item_id", "text").where("text is not null").withColumn("uid", F.monotonically_increasing_id()), "items")
    lines = rows.select("uid", "text").mapInArrow(_lines, "uid long, n int, line string, item string").select("uid", "n", "line", F.sha2("item", 256).alias("item"))
    # copies of an item count once, so that they do not make its passage an instruction
    shared = lines.select("line", "item").distinct().groupBy("line").count().where(F.col("count") > SHARED).select("line", F.lit(True).alias("shared"))
    marked = lines.join(bounded_broadcast(shared, BLOCK), "line", "left").select("uid", F.struct("n", "line", F.coalesce("shared", F.lit(False)).alias("shared")).alias("x"))
    return rows.select("uid", "item_id").join(marked.groupBy("uid").agg(F.sort_array(F.collect_list("x")).alias("lines")), "uid").select("item_id", "uid", "lines")


def _passes(marked: DataFrame) -> Iterator[Items]:
    """Items of ``PASS_WORDS`` words at a time, brought to the driver one partition after the other."""
    held, size = [], 0
    for r in marked.orderBy("item_id", "uid").toLocalIterator():
        n = sum(x["line"].count(" ") + 1 for x in r["lines"])
        if held and size + n > PASS_WORDS:
            yield Items(held)
            held, size = [], 0
        held.append((r["item_id"], [(x["line"], x["shared"]) for x in r["lines"]]))
        size += n
    if held:
        yield Items(held)


def find_leaks(docs: DataFrame, evals: DataFrame, least: int = 25, spans: bool = False) -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds a passage of at least ``least`` words of an item.

    With ``spans`` the merged removal spans come too, as ``start_char``, ``end_char`` and the words held. A text
    of more words than a shard holds is searched in overlapping parts, so the same pair may come from two
    shards; such repeats are removed.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long" + (", start_char int, end_char int, words int" if spans else "")
    key = ["doc_id", "item_id"] + (["start_char"] if spans else [])
    out, last = None, None
    for items in _passes(_marked_items(evals)):
        if last is not None:  # an earlier pass is carried out before the next one is broadcast
            out = stage(hits, "leaks") if out is None else out.union(stage(hits, "leaks"))
            last.unpersist()
        last = spark.sparkContext.broadcast(items)
        hits = docs.select("doc_id", "text").where("text is not null").mapInArrow(lambda it, s=last: _scan(it, s, least, spans), schema)
    if last is None:
        return spark.createDataFrame([], schema)
    return (hits if out is None else out.union(hits)).dropDuplicates(key)
