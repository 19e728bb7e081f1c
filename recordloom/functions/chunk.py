"""Overlapping chunks of long texts at sentence ends, with page numbers, as one Arrow-batched pass."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARS_PER_TOKEN = 4
MIN_SIZE, MAX_SIZE = 100, 4000
_SENTENCE_END = re.compile(r"[.!?]+\s+")
_PAGE = re.compile(r"\[PAGE (\d+)\]", re.I)
_WORD_EDGE = re.compile(r"\b")


def validate(size: int, overlap: int) -> None:
    """Sizes in tokens: 100 to 4000, overlap from 0 to less than the size."""
    if not MIN_SIZE <= size <= MAX_SIZE:
        raise ValueError(f"chunk size must lie between {MIN_SIZE} and {MAX_SIZE}")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the chunk size")


def break_point(text: str, start: int, end: int) -> int:
    """Where to end a chunk: after the last sentence of the window before ``end``, else at a word edge near it."""
    window = max(start, end - int(MAX_SIZE * CHARS_PER_TOKEN * 0.3))
    last = None
    for last in _SENTENCE_END.finditer(text, window, end):
        pass
    if last is not None:
        return last.end()
    low = max(0, end - 50)
    edges = [m.start() for m in _WORD_EDGE.finditer(text, low, end)]
    return edges[len(edges) // 2] if len(edges) > 1 else end


def chunk_text(text: str | None, size: int = 1000, overlap: int = 200) -> list[tuple[int, str, int, int, int]]:
    """``(sequence, content, start, end, page)`` of each chunk; none for a blank text.

    A chunk is cut back to its break point when that lies beyond half of it. Page marks are taken out first,
    and a chunk is on the page of the last mark before its start: 1 without marks, 0 before the first.
    """
    validate(size, overlap)
    if not text or not text.strip():
        return []
    plain, marks, pages, at = [], [], [], 0
    for m in _PAGE.finditer(text):
        plain.append(text[at : m.start()])
        marks.append(sum(map(len, plain)))
        pages.append(int(m[1]))
        at = m.end()
    plain.append(text[at:])
    body = "".join(plain)
    most, step_back = size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN
    out, start = [], 0
    while start < len(body):
        end = min(start + most, len(body))
        if end < len(body):
            cut = break_point(body, start, end)
            if cut > start + most // 2:
                end = cut
        content = body[start:end].strip()
        if content:
            k = bisect_right(marks, start) - 1
            out.append((len(out), content, start, end, 1 if not marks else pages[k] if k >= 0 else 0))
        if end >= len(body):
            break
        start = max(start + 1, end - step_back)
    return out


def chunk_documents(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``(id, chunk_sequence, content, start_pos, end_pos, page_number)`` of every document."""
    validate(size, overlap)
    kind = df.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = chunk_text(text, size, overlap)
                owner += [i] * len(got)
                rows += got
            cols = list(zip(*rows)) if rows else [[]] * 5
            arrays = [pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *arrays], names=["id", "chunk_sequence", "content", "start_pos", "end_pos", "page_number"])

    number = T.IntegerType()
    schema = T.StructType([T.StructField("id", kind), T.StructField("chunk_sequence", number), T.StructField("content", T.StringType()), T.StructField("start_pos", number), T.StructField("end_pos", number), T.StructField("page_number", number)])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(cut, schema)


def fixed_stride(text: Column, size: int, overlap: int) -> Column:
    """Chunks of ``size`` characters every ``size - overlap``, as an array of structs, without leaving the JVM."""
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / F.lit(float(stride))).cast("int") - 1)
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)
    return F.transform(starts, lambda s, i: F.struct(i.alias("seq"), s.alias("start_pos"), F.substr(text, s + 1, F.lit(size)).alias("content")))


def page_of(marks: Column, position: Column) -> Column:
    """Page of the last ``(pos, page)`` struct of a sorted array at or before a position: 1 without marks, 0 before the first."""
    before = F.filter(marks, lambda m: m["pos"] <= position)
    return F.when(F.size(marks) == 0, F.lit(1)).when(F.size(before) == 0, F.lit(0)).otherwise(F.element_at(before, -1)["page"])
