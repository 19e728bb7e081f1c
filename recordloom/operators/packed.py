"""Split fields that pack several values into one value per row, position kept.

The Arrow string buffers of a whole batch are scanned at once: byte masks mark quotes, delimiters and
enclosing brackets, quote parity (a running count of quoting signs) tells which delimiters stand inside
quotes, and child offsets follow from the remaining delimiters. Strings in which both kinds of quotes open
values, or which hold backslash escapes inside brackets, need state the masks cannot carry and take an
exact character scan.

Defined results: a null, empty or blank field, and a field of delimiters only, has no values; empty values
take no position; repeated values are kept in order; an unclosed quote is an ordinary sign.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = b",;|\t\n\r"
_DELIM = np.zeros(256, bool)
_DELIM[list(DELIMITERS)] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \x0b\x0c")] = True
_DQ, _SQ, _COLON, _BACKSLASH = 34, 39, 58, 92


def _blank_mask(b: np.ndarray) -> np.ndarray:
    """Blanks, with the two UTF-8 bytes of the no-break space."""
    m = _BLANK[b]
    nb = np.flatnonzero((b[:-1] == 0xC2) & (b[1:] == 0xA0)) if len(b) > 1 else np.zeros(0, np.int64)
    m[nb] = True
    m[nb + 1] = True
    return m


def _scan_exact(s: str) -> list[str]:
    """Character scan of one string, for the cases parity cannot decide."""
    blanks = "  \x0b\x0c"
    delims = DELIMITERS.decode()
    t = s.strip(blanks + "\r\n\t")
    enclosed = len(t) >= 2 and (t[0], t[-1]) in {("{", "}"), ("[", "]")}
    if enclosed:
        t = t[1:-1]
    out: list[str] = []
    n, i = len(t), 0
    while i <= n:
        buf: list[str] = []
        at_start = True  # only blanks or a prefix's colon so far
        while i < n and t[i] not in delims:
            c = t[i]
            if c in "\"'" and at_start:
                j, piece, closed = i + 1, [], False
                while j < n:
                    if enclosed and t[j] == "\\" and j + 1 < n:
                        piece.append(t[j + 1])
                        j += 2
                        continue
                    if t[j] == c:
                        if j + 1 < n and t[j + 1] == c and not (len(piece) == 0 and (j + 2 >= n or t[j + 2] in delims)):
                            piece.append(c)
                            j += 2
                            continue
                        k = j + 1
                        while k < n and t[k] in blanks:
                            k += 1
                        if k >= n or t[k] in delims:
                            closed = True
                            break
                    piece.append(t[j])
                    j += 1
                if closed:
                    buf.extend(piece)
                    i = j + 1
                    at_start = False
                    continue
            buf.append(c)
            if c == ":":
                at_start = True
            elif c not in blanks:
                at_start = False
            i += 1
        v = "".join(buf).strip(blanks)
        if v:
            out.append(v)
        i += 1
    return out


def split_buffers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Child offsets per parent and the child strings of the strings in ``data[offsets[i]:offsets[i+1]]``."""
    n = len(offsets) - 1
    lo, hi = int(offsets[0]), int(offsets[-1])
    b = data[lo:hi]
    off = (offsets - lo).astype(np.int64)
    size = len(b)
    if size == 0:
        return np.zeros(n + 1, np.int64), pa.array([], pa.string())
    lens = np.diff(off)
    owner = np.repeat(np.arange(n), lens)
    idx = np.arange(size)
    blank = _blank_mask(b)
    delim = _DELIM[b]
    begin, end = off[:-1][owner], off[1:][owner]

    # nearest sign that is no blank, to the left and to the right, inside the same string
    solid = ~blank
    left = np.maximum.accumulate(np.where(solid, idx, -1))
    prev = np.r_[-1, left[:-1]]
    right = np.minimum.accumulate(np.where(solid, idx, size)[::-1])[::-1]
    nxt = np.r_[right[1:], size]
    prev_in, nxt_in = prev >= begin, nxt < end

    # one pair of brackets that encloses the whole string
    white = blank | np.isin(b, np.frombuffer(b"\t\n\r", np.uint8))
    firm = np.flatnonzero(~white)
    first = np.searchsorted(firm, off[:-1])
    last = np.searchsorted(firm, off[1:]) - 1
    has = last > first
    fi = firm[np.minimum(first, max(len(firm) - 1, 0))] if len(firm) else np.zeros(n, np.int64)
    la = firm[np.maximum(last, 0)] if len(firm) else np.zeros(n, np.int64)
    braces = has & (((b[fi] == 123) & (b[la] == 125)) | ((b[fi] == 91) & (b[la] == 93)))
    enclosing = np.zeros(size, bool)
    enclosing[fi[braces]] = True
    enclosing[la[braces]] = True

    edge_left = ~prev_in | delim[np.maximum(prev, 0)] | enclosing[np.maximum(prev, 0)]
    edge_right = ~nxt_in | delim[np.minimum(nxt, size - 1)] | enclosing[np.minimum(nxt, size - 1)]
    opens = edge_left | (b[np.maximum(prev, 0)] == _COLON)

    dq, sq = b == _DQ, b == _SQ
    sq_open = sq & opens
    dq_open = dq & opens
    any_sq = np.zeros(n, bool)
    any_sq[owner[sq_open]] = True
    any_dq = np.zeros(n, bool)
    any_dq[owner[dq]] = True
    slash = np.zeros(n, bool)
    slash[owner[(b == _BACKSLASH) & braces[owner]]] = True
    scalar = (any_sq & any_dq) | slash
    # runs of one quote sign: "" inside a quoted value is one sign of its own
    quote = np.where(any_sq[owner], sq, dq)
    run_start = quote & ~np.r_[False, quote[:-1] & (owner[:-1] == owner[1:])]
    starts = np.flatnonzero(run_start)
    stops = np.flatnonzero(quote & ~np.r_[quote[1:] & (owner[:-1] == owner[1:]), False]) + 1
    quoting = np.zeros(size, bool)
    dropped = np.zeros(size, bool)
    if len(starts):
        runs = stops - starts
        op, cl = opens[starts], edge_right[stops - 1]
        whole = op & cl & (runs % 2 == 0) & (runs == 2)  # an empty quoted value
        one_open = op & ~whole
        one_close = cl & ~op & (runs % 2 == 1)
        quoting[starts[one_open]] = True
        quoting[(stops - 1)[one_close]] = True
        quoting[starts[whole]] = True
        quoting[(stops - 1)[whole]] = True
        inner_from = starts + one_open
        inner_to = stops - one_close
        pairs = np.maximum(inner_to - inner_from, 0) // 2
        rep = np.repeat(np.arange(len(starts)), pairs)
        if len(rep):
            nth = np.arange(len(rep)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            dropped[inner_from[rep] + 2 * nth] = True
    parity = np.cumsum(quoting)
    base = np.r_[0, parity][off[:-1]]
    total = np.r_[0, parity][off[1:]] - base
    scalar |= total % 2 == 1
    # a pair must open on the left and close on the right
    inside = (parity - base[owner]) % 2 == 1
    wrong = quoting & ((inside & ~opens) | (~inside & ~edge_right))
    scalar[owner[wrong]] = True
    # doubled signs count as one only inside a quoted value
    dropped &= inside
    cut = delim & ~inside

    drop = cut | enclosing | quoting | dropped
    # values are the stretches between cuts; trim their blanks
    value_of = np.cumsum(cut) + owner  # a new value after each cut and at each new string
    firm2 = ~drop & ~blank
    if firm2.any():
        pos = np.flatnonzero(firm2)
        v = value_of[pos]
        head = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        tail = np.r_[head[1:], len(pos)] - 1
        inner = np.zeros(size + 1, np.int64)
        inner[pos[head]] += 1
        np.add.at(inner, pos[tail] + 1, -1)
        keep = (np.cumsum(inner[:-1]) > 0) & ~drop & ~scalar[owner]
        ok = ~scalar[owner[pos[head]]]
        first_pos, last_pos = pos[head][ok], pos[tail][ok]
        kept = np.r_[0, np.cumsum(keep)]
        child_off = np.r_[kept[first_pos], kept[-1]].astype(np.int32)
        child_parent = owner[first_pos]
        children = pa.StringArray.from_buffers(len(first_pos), pa.py_buffer(child_off), pa.py_buffer(np.ascontiguousarray(b[keep])))
    else:
        child_parent, children = np.zeros(0, np.int64), pa.array([], pa.string())
    counts = np.bincount(child_parent, minlength=n)
    rows = np.flatnonzero(scalar)
    if len(rows) == 0:
        return np.r_[0, np.cumsum(counts)], children
    exact = [_scan_exact(b[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")) for r in rows]
    counts[rows] = [len(x) for x in exact]
    extra = pa.array([x for vs in exact for x in vs], pa.string())
    parents = np.r_[child_parent, np.repeat(rows, [len(x) for x in exact])]
    order = np.argsort(parents, kind="stable")
    return np.r_[0, np.cumsum(counts)], pa.concat_arrays([children, extra]).take(pa.array(order))


def split_array(column: pa.Array) -> pa.ListArray:
    """List array of the values in each string; null strings give empty lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    child, values = split_buffers(data, offsets)
    return pa.ListArray.from_arrays(pa.array(child, pa.int32()), values)


def _flatten(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = split_array(batch.column(1))
        off = lists.offsets.to_numpy()
        counts = np.diff(off)
        keep = np.repeat(counts >= least, counts)
        parent = np.repeat(np.arange(len(counts)), counts)[keep]
        position = (np.arange(off[-1]) - np.repeat(off[:-1], counts) + 1)[keep]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(parent)), pa.array(position, pa.int32()), lists.values.filter(pa.array(keep))], names=["row_id", "pos", "val"]
        )


def split_packed(df: DataFrame, id_col: str, packed_col: str, least: int = 1) -> DataFrame:
    """One row ``(row_id, pos, val)`` per value of ``packed_col``; rows with fewer than ``least`` values give none.

    ``pos`` counts from 1. ``val`` keeps prefix and inner punctuation as written, without outer blanks and
    without signs that only quote or enclose. The work is a single scan without shuffle; no other column of
    ``df`` is read, so extra columns of any name are harmless.
    """
    schema = T.StructType([T.StructField("row_id", df.schema[id_col].dataType), T.StructField("pos", T.IntegerType()), T.StructField("val", T.StringType())])
    source = df.select(F.col(id_col).alias("row_id"), F.col(packed_col).cast("string").alias("packed")).where(F.length(F.trim("packed")) > 0)
    return source.mapInArrow(lambda it: _flatten(it, least), schema)
