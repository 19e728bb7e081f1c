"""Cut oversized texts into overlapping pieces at content-defined, natural boundaries.

A rolling hash over the last ``WINDOW`` characters marks landmarks, places whose hash has its ``mask_bits``
low bits clear, so where they fall depends on nearby characters only. The next cut is the first landmark
between the smallest and the largest size of a piece, snapped to the best natural boundary near it:
paragraph, sentence, line, then word end. Where no landmark falls into the range, the last boundary of the
best kind in the upper half of the range is used, and where there is no boundary at all, as inside encoded
data, the landmark itself or the largest size. An edit therefore moves only the cuts near it; later cuts
fall on the same landmarks again.

Each piece after the first starts with up to ``overlap`` characters of the piece before, from a sentence or
word start if there is one. No piece is longer than ``limit`` code points, overlap included. A cut never
separates a base character from combining marks that follow it.

Defined results: null and empty texts, and texts within the limit, are one piece as they are.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.ranks import rank_within
from recordloom.session import stage

LIMIT, OVERLAP = 6000, 600
WINDOW = 32
MASK_BITS = 9
SNAP = 350
PAGE_MARK = re.compile(r"^\[PAGE (\d+)\]", re.M)
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_SENTENCE = re.compile(r"(?<![.!?…。！？])[.!?…。！？]++[\"'”’)\]]*\s+(?=[^\sa-z])")
_LINE = re.compile(r"\n")
_BLANK = re.compile(r"\s+")
_GEAR = np.random.default_rng(20240901).integers(1, 2**63, 4096, dtype=np.uint64)


def landmarks(text: str, mask_bits: int = MASK_BITS) -> np.ndarray:
    """Offsets after which the rolling hash of the last WINDOW characters has its low bits clear."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _GEAR[code & np.uint32(4095)] ^ (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    width = 1
    while width < WINDOW:  # the hash of 2w characters from those of w: Horner's rule in steps of two
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] if width < len(h) else 0
        h = h + (shifted << np.uint64(width)) * np.uint64(0x2545F4914F6CDD1D)
        width *= 2
    h ^= h >> np.uint64(32)
    at = np.flatnonzero((h & np.uint64((1 << mask_bits) - 1)) == 0) + 1
    return at[at >= WINDOW]


def boundaries(text: str) -> list[list[int]]:
    """Offsets at which a piece may end, by kind: paragraph, sentence, line, word."""
    return [[m.end() for m in pattern.finditer(text)] for pattern in (_PARAGRAPH, _SENTENCE, _LINE, _BLANK)]


def _nearest(places: list[int], at: int, low: int, high: int) -> int | None:
    i = bisect_left(places, low)
    j = bisect_right(places, high)
    if i >= j:
        return None
    k = bisect_left(places, at, i, j)
    return min(places[max(i, k - 1) : min(j, k + 1)], key=lambda p: (abs(p - at), p))


def _whole(text: str, at: int, low: int) -> int:
    """Move a forced cut left so that no combining mark starts a piece."""
    k = at
    while k > low and k < len(text) and unicodedata.combining(text[k]):
        k -= 1
    return k if k > low else at


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the new parts of the pieces; the last is the length of the text."""
    n = len(text)
    if n <= limit:
        return [n]
    marks = landmarks(text, mask_bits)
    kinds = boundaries(text)
    largest = limit - overlap
    smallest = largest // 2
    cuts, start = [], 0
    while n - start > (limit if start == 0 else largest):
        low, high = start + smallest, start + largest
        i = int(np.searchsorted(marks, low))
        mark = int(marks[i]) if i < len(marks) and marks[i] <= high else None
        cut = None
        if mark is not None:
            for places in kinds:
                cut = _nearest(places, mark, max(low, mark - SNAP), min(high, mark + SNAP))
                if cut is not None:
                    break
        if cut is None:
            for places in kinds:
                k = bisect_right(places, high) - 1
                if k >= 0 and places[k] >= (low + high) // 2:
                    cut = places[k]
                    break
        if cut is None:
            cut = _whole(text, mark if mark is not None else high, low)
        cuts.append(cut)
        start = cut
    return [*cuts, n]


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, mask_bits: int = MASK_BITS) -> list[tuple[int, int]]:
    """``(start, end)`` of each piece of ``text``, overlap included."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    text = text or ""
    ends = cut_points(text, limit, overlap, mask_bits)
    out, before = [], 0
    for i, end in enumerate(ends):
        start = before
        if i and overlap:
            low = before - overlap
            start = low
            sentence = _SENTENCE.search(text, low, before)
            blank = _BLANK.search(text, low, before)
            if sentence and sentence.end() < before:
                start = sentence.end()
            elif blank and blank.end() < before:
                start = blank.end()
            while start < before and unicodedata.combining(text[start]):
                start += 1
        out.append((start, end))
        before = end
    return out


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the texts in ``chunk_content``; all other columns but ``page_number`` come along as they are."""
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("chunk_content", "page_number")]

        def give(owner: list[int], cols: list[list], batch=batch, names=names) -> pa.RecordBatch:
            take = pa.array(owner, pa.int64())
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), *(pa.array(c, t) for c, t in zip(cols, _KINDS))], names=[*names, *_NAMES])

        owner: list[int] = []
        cols: list[list] = [[], [], [], [], []]
        held = 0
        for row, (text, page) in enumerate(zip(batch.column("chunk_content").to_pylist(), batch.column("page_number").to_pylist())):
            spans = pieces(text, limit, overlap)
            page_at = [(m.start(), int(m[1])) for m in PAGE_MARK.finditer(text or "")] if page else []
            for k, (a, b) in enumerate(spans):
                fresh = spans[k - 1][1] if k else 0  # a piece lies on the page where its new part starts
                passed = [p for at, p in page_at if at <= fresh]
                owner.append(row)
                for c, v in zip(cols, (k, a, b, passed[-1] if passed else page, text[a:b] if text is not None else None)):
                    c.append(v)
                held += b - a
                if held > 32_000_000:
                    yield give(owner, cols)
                    owner, cols, held = [], [[], [], [], [], []], 0
        yield give(owner, cols)


_NAMES = ["piece", "piece_start", "piece_end", "page_number", "piece_text"]
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
_PIECES = "piece int, piece_start int, piece_end int, page_number int, piece_text string"


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(id, piece, piece_start, piece_end, page_number, piece_text)`` of every row longer than ``limit``.

    Lengths are code points. The page of a piece is that of its row, moved on by the page marks its text holds
    before the piece's new part; 0 stays 0.
    """
    long = chunks.where(F.length("chunk_content") > limit).select("id", "chunk_content", "page_number")
    return long.mapInArrow(lambda it: _split(it, limit, overlap), f"id long, {_PIECES}")


def rechunk(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Every chunk with oversized ones replaced by their pieces, numbered anew within the record.

    ``chunk_sequence`` counts from 0 in the order of the old sequence and the piece; rows that were ingested
    again under the same ``embedding_id`` share their numbers, and ``total_chunks`` counts distinct numbers of
    the record. Rows that are no longer than the limit keep their text and page. Rows without ``record_uri`` belong to
    no common record and are numbered by ``embedding_id``, or each by itself where that is missing too.
    """
    base = chunks.select("id", "record_uri", "embedding_id", "chunk_sequence", "start_position", "page_number", "chunk_content")
    base = base.withColumn("own", F.coalesce(F.col("record_uri").cast("string"), F.concat(F.lit("e:"), "embedding_id"), F.concat(F.lit("i:"), F.col("id").cast("string")), F.lit("none")))
    fits = base.where(F.coalesce(F.length("chunk_content") <= limit, F.lit(True)))
    same = ["id", "record_uri", "embedding_id", "own", F.col("chunk_sequence").alias("old_sequence")]
    whole = fits.select(*same, F.lit(0).alias("piece"), "start_position", (F.col("start_position") + F.coalesce(F.length("chunk_content"), F.lit(0))).cast("int").alias("end_position"), "page_number", "chunk_content")
    long = base.where(F.length("chunk_content") > limit)
    kept = [f"{c} {t}" for c, t in long.dtypes if c not in ("chunk_content", "page_number")]
    cut = stage(long.mapInArrow(lambda it: _split(it, limit, overlap), f"{', '.join(kept)}, {_PIECES}"), "pieces").select(
        *same, "piece", (F.col("start_position") + F.col("piece_start")).cast("int").alias("start_position"), (F.col("start_position") + F.col("piece_end")).cast("int").alias("end_position"), "page_number", F.col("piece_text").alias("chunk_content")
    )
    # numbers are found on narrow rows, so texts are shuffled once, by the join that brings the numbers back; nulls get values of their own there
    order = [F.coalesce("old_sequence", F.lit(2**31 - 1)).alias("_s"), F.coalesce(F.concat(F.lit("0"), "embedding_id"), F.lit("1")).alias("_e")]
    keys = stage(whole.select("own", *order, "piece").union(cut.select("own", *order, "piece")).distinct(), "numbers")
    totals = keys.groupBy("own").agg(F.count("*").cast("int").alias("total_chunks"))
    numbered = rank_within(keys, "own", ["_s", "_e", "piece"]).join(totals, "own").select("own", "_s", "_e", "piece", (F.col("k") - 1).cast("int").alias("chunk_sequence"), "total_chunks")
    rows = whole.unionByName(cut).withColumns({"_s": order[0], "_e": order[1]})
    joined = rows.join(numbered, ["own", "_s", "_e", "piece"])
    return joined.select("id", "record_uri", "embedding_id", "piece", "chunk_sequence", "total_chunks", "page_number", "start_position", "end_position", "chunk_content")
