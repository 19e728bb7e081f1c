"""Find documents whose text was cut off, and how often each source cuts.

Near-copies: a cut text is near a prefix of its whole copy, however much was cut. So texts are signed with min-hashes
(one permutation) of the word shingles of their prefixes, of 4, 16, 64, ... shingles. Bands of the signatures meet in
buckets, where the longest prefix of each text is compared with prefixes of every longer text. Pairs in which at least
``SIMILARITY`` of the shorter text's shingles stand in the longer are aligned from the end of the shorter. Where the
longer copy goes on in the middle of a word or sentence, the shorter one was cut; where it goes on after a sentence,
the shorter one is whole.

All other texts are scored by their closing words. Over all documents it is counted how often each word form
(digits as one sign) ends a line or text, how often a word with a full stop ends a sentence, how often a closing
line of that shape and a closing phrase before dots ends a text. Boosted trees turn these figures into a score;
they are trained on about ``TRAIN_DOCS`` documents, chosen by the hash of their ids, and artificial cuts of the same
documents. Where a half of these holds fewer than ``LEAST`` cut or uncut texts, as in very small tables, no trees are
fitted and a text is whole when it ends with an end mark or in a list item. A text of exactly a length at which its
source piles up needs less evidence.

Scale: one document per distinct text is read, and its closing, counts and signature come from one pass, so copies of
one text never meet all pairs. Buckets without a text that ends in them and a longer one are dropped before anything
is joined; a bucket of more than ``BUCKET`` texts is cut into blocks that meet pairwise. Pairs grow with the square of
a group of near-copies, and each carries its two texts. Statistics are summed per task before the shuffle.

Defined results: rows without ``doc_id`` are left out; null, empty and blank texts are whole; repeated texts get the same verdict; a null source is
reported as a source of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.boost import Boosted, fit_boosted
from recordloom.llm.words import WORD, mix, shingles, word_hashes, words
from recordloom.session import bounded_broadcast, stage

K, SIMILARITY = 5, 0.8
BANDS, ROWS = 8, 4
PREFIXES = 4 ** np.arange(1, 15)  # shingles of the prefixes that are signed
TRAIN_DOCS = 4000
LEAST = 20
MAX_BUCKETS = 200_000
BUCKET = 1000
THRESHOLD = 0.35  # below one half, since the documents taken as whole in training hold unknown cut ones
LIMIT_ODDS = 3.0  # log-odds that a pile of texts of exactly this length adds
_DIGITS = re.compile(r"\d+")
_RUN = re.compile(r"[^\W_]+")
_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")
_STOP = re.compile(r"[.!?…][\"'”’»)\]]*$")
_MARKS = frozenset(".!?…")
_ENDING = frozenset(".!?…\"'”’»)]")
_TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]]*$")
_CLOSERS = "\"'”’»)]"
_MARKED = re.compile(r"^\s*([-*•·–]|\d+[.)]|\|)\s?")
_KEYS = 6


def _codes(s: str) -> str:
    """Runs of letters and digits that hold both as one sign."""
    return _RUN.sub(lambda m: "#" if not m[0].isalpha() and _DIGIT.search(m[0]) and _LETTER.search(m[0]) else m[0], s)


def _without_dots(tail: str) -> str | None:
    """A text without the dots it ends in and what closes them, or None when it does not end in dots."""
    t = tail.rstrip(_CLOSERS)
    if t.endswith("…"):
        return t[:-1]
    body = t.rstrip(".")
    return body if len(t) - len(body) >= 2 else None


def form(token: str) -> str:
    """A word form for counting: digits become one sign, runs of them kept up to three; letters with digits are a code."""
    return _DIGITS.sub(lambda m: "9" * min(len(m[0]), 3), _codes(token))[:40]


class _Forms(dict):
    def __missing__(self, token: str) -> str:
        value = self[token] = token[:40] if token.isalpha() else form(token)
        return value


def line_shape(line: str) -> str:
    """Shape of a line: the letters of each word by case, digits as one sign, punctuation kept."""
    s = _DIGITS.sub("9", _codes(line.strip()))
    s = re.sub(r"[^\W\d_]+", lambda m: ("U" if len(m[0]) > 1 and m[0].isupper() else "X") if m[0][0].isupper() else (m[0] if len(m[0]) <= 2 else "x"), s)
    return s[:80]


def _phrase(text: str) -> str:
    return " ".join(words(text[-80:])[-3:])


def closing(text: str) -> tuple[list[float], list[str]]:
    """Plain features of a text's end and the keys of the counts it needs, '' for none."""
    tail = text.rstrip()
    lines = tail.rsplit("\n", 2)
    last, before = lines[-1], lines[-2] if len(lines) > 1 else ""
    tokens = last.split()
    token = tokens[-1] if tokens else ""
    prev = tokens[-2] if len(tokens) > 1 else ""
    undotted = _without_dots(tail)
    dots = undotted is not None
    terminal = bool(_TERMINAL.search(tail)) and not dots
    bare = undotted.rstrip() if dots else tail
    para = tail[tail.rfind("\n\n") + 1 :]
    marked = bool(_MARKED.match(last))
    end = bare[-1:] if bare else ""
    sentence_before = bool(re.search(r"[.!?]\s+[^\Wa-z_][^.!?]*$", bare[-120:])) if dots else False
    plain = [
        float(terminal), float(dots), float(dots and tail != bare and bare[-1:].isspace() is False and tail[len(bare) : len(bare) + 1] == " "), float(marked), float(bool(_MARKED.match(before))),
        float(last.count("|") >= 2 and last.endswith("|")), float(last.startswith("|")), float(min(len(last), 400)), float(len(tokens)), float(len(token)),
        float(end.isalpha()), float(end.isdigit()), float(end in ",;:-–(/'\"&"), float(para.count("(") - para.count(")")), float(not before.strip()), float(sentence_before), float(text[-1:].isspace()), float(token[:1].isupper()),
        float("�" in tail[-2:]),
    ]
    core = (token if (cut := _without_dots(token)) is None else cut) if dots else token
    keys = [
        "w " + form(core) if core else "",
        f"s {form(prev)} {form(token)}" if terminal else "",
        "t " + form(token) if terminal else "",
        "f " + line_shape(last) if not terminal and not dots and len(last) <= 80 else "",
        "e " + _phrase(bare) if dots else "",
        "p " + form(prev) + " " + form(core) if not terminal and core else "",
    ]
    return plain, keys


class _Statistics:
    """How often keys occur and how often they close a line, sentence or text, over a stretch of texts."""

    def __init__(self) -> None:
        self.total: Counter = Counter()
        self.good: Counter = Counter()
        self.single: Counter = Counter()
        self.single_end: Counter = Counter()

    def add(self, tail: str) -> None:
        total, good = self.total, self.good
        for toks in map(str.split, tail.split("\n")):
            if not toks:
                continue
            self.single.update(toks)
            last_at = len(toks) - 1
            end = toks[last_at]
            self.single_end[end] += 1
            for i in [i for i, t in enumerate(toks) if t[-1] in _ENDING]:
                t = toks[i]
                if t[-1] in _MARKS or _STOP.search(t):
                    a = toks[i - 1] if i else ""
                    total[("s", a, t)] += 1
                    total[("t", t, None)] += 1
                    if i == last_at or not (toks[i + 1][0].islower() or toks[i + 1][0].isdigit()):
                        good[("s", a, t)] += 1
                        good[("t", t, None)] += 1
            if end[-1].isalnum() or not _TERMINAL.search(end):
                key = ("p", toks[last_at - 1] if last_at else "", end)
                good[key] += 1
                total[key] += 1
        undotted = _without_dots(tail)
        if undotted is not None:
            total[("e", _phrase(undotted.rstrip()), None)] += 1
        elif not _TERMINAL.search(tail[-10:]) and len(last := tail.rsplit("\n", 1)[-1]) <= 80:
            total[("f", line_shape(last), None)] += 1

    def full(self) -> bool:
        return len(self.total) + len(self.single) > 400_000

    def take(self) -> tuple[list[str], list[int], list[int]]:
        """Keys, occurrences and closings so far, which start anew."""
        for w, c in self.single.items():
            self.total[("w", w, None)] += c
        for w, c in self.single_end.items():
            self.good[("w", w, None)] += c
        n: Counter = Counter()
        g: Counter = Counter()
        forms = _Forms()
        for source, into in ((self.total, n), (self.good, g)):
            for (kind, a, b), c in source.items():
                into[f"{kind} {forms[a]} {forms[b]}" if b is not None else f"{kind} {a if kind in 'fe' else forms[a]}"] += c
        self.__init__()
        keys = list(n)
        return keys, [n[k] for k in keys], [g[k] for k in keys]


def signatures(texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
    """Band hashes of the prefixes of each text, shortest prefix first, and how many of them are of its longest prefix."""
    parts = [shingles(word_hashes(words(t)), K) for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    levels = max(1, int(np.searchsorted(PREFIXES, size.max(initial=0), "right")))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    level = np.searchsorted(PREFIXES, at, "right")
    inside = level < levels
    bins = BANDS * ROWS
    place = ((np.repeat(np.arange(len(parts)), size) * levels + level) * bins + (flat >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64))[inside]
    none = np.uint64(2**64 - 1)
    low = np.full(len(parts) * levels * bins, none)
    np.minimum.at(low, place, mix(flat[inside] + np.uint64(1)))
    low = np.minimum.accumulate(low.reshape(len(parts), levels, bins), axis=1)
    filled, missing = low.copy(), low == none
    for d in range(1, bins):  # an empty place takes the next one that is not, moved by their distance
        if not missing.any():
            break
        beside = np.roll(low, -d, axis=2)
        use = missing & (beside != none)
        filled[use] = beside[use] + np.uint64(d)
        missing &= ~use
    band = np.zeros((len(parts), levels, BANDS), np.uint64)
    for j in range(bins):
        band[:, :, j // ROWS] = mix((band[:, :, j // ROWS] ^ filled[:, :, j]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
    band += np.arange(levels, dtype=np.uint64)[None, :, None]
    # short prefixes have few shingles and need few bands
    used = [2, 4] + [BANDS] * levels
    out, top = [], []
    for row, n in zip(band, np.searchsorted(PREFIXES, size, "right")):
        out.append(np.concatenate([row[j, : used[j]] for j in range(n)]) if n else np.zeros(0, np.uint64))
        top.append(used[n - 1] if n else 0)
    return out, top


_ROW = "doc_id long, variant int, label byte, plain array<float>, keys array<string>, chars int, bands array<long>, top int, key string, n long, good long"
_TYPES = (pa.int64(), pa.int32(), pa.int8(), pa.list_(pa.float32()), pa.list_(pa.string()), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.int64(), pa.int64())


def _read(batches: Iterator[pa.RecordBatch], share: int, seed: int = 5) -> Iterator[pa.RecordBatch]:
    """One pass over distinct texts: closing and signature of each, artificial cuts of the picked ones, and summed counts."""
    names = [x.split()[0] for x in _ROW.split(", ")]

    def counts() -> pa.RecordBatch:
        keys, n, good = stats.take()
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(keys), t) for t in _TYPES[:8]), pa.array(keys, pa.string()), pa.array(n, pa.int64()), pa.array(good, pa.int64())], names=names)

    stats = _Statistics()
    for batch in batches:
        kept = [(doc, text, pick) for doc, text, pick in zip(*(c.to_pylist() for c in batch.columns)) if text.strip()]
        bands, top = signatures([text for _, text, _ in kept])
        out: list[list] = [[], [], [], [], []]
        signed: list[list] = [[], [], []]
        for (doc, text, pick), b, t in zip(kept, bands, top):
            stats.add(text.rstrip())
            cases = [(text, 0)]
            if pick % share == 0:
                rng = np.random.default_rng([seed, pick & 0x7FFFFFFF])
                for k in range(2):
                    # one cut anywhere, one near the end, where signatures and lists stand
                    at = int(rng.integers(len(text) // 4, len(text))) if k == 0 else len(text) - int(rng.integers(1, max(2, min(90, len(text) // 2))))
                    cut = text[:at]
                    rest = text[at:]
                    inside = not _TERMINAL.search(cut.rstrip()) and not rest.startswith("\n") and cut.strip() and not cut.endswith("\n")
                    if inside and rest.strip():
                        way = rng.integers(0, 10)
                        cases.append((cut + ("..." if way == 0 else "…" if way == 1 else " ..." if way == 2 else "\ufffd" if way == 3 else ""), 1))
            for variant, (case, label) in enumerate(cases):
                plain, keys = closing(case)
                for c, v in zip(out, (doc, variant, 2 if pick % share == 0 and label == 0 else label, plain, keys)):
                    c.append(v)
                for c, v in zip(signed, (len(text), b.view(np.int64), t) if label == 0 else (None, None, None)):
                    c.append(v)
        cols = [*out, *signed]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, _TYPES)), *(pa.nulls(len(out[0]), t) for t in _TYPES[8:])], names=names)
        if stats.full():
            yield counts()
    yield counts()


def _matrix(plain: list, n: list, good: list, label: np.ndarray) -> np.ndarray:
    """Feature rows: plain figures, then for each key its count and the smoothed share of closings without the text itself."""
    rows = np.asarray(plain, np.float64).reshape(len(plain), -1)
    n_, g_ = np.asarray(n, np.float64).reshape(len(n), -1), np.asarray(good, np.float64).reshape(len(good), -1)
    own = (label != 1)[:, None] & ~np.isnan(n_)
    n0 = np.where(own, np.maximum(n_ - 1, 0), np.nan_to_num(n_))
    g0 = np.where(own, np.maximum(g_ - 1, 0), np.nan_to_num(g_))
    missing = np.isnan(n_)
    share = (g0 + 0.02) / (n0 + 1)
    # in coarse steps, so that taking the text itself out of a count cannot give it away
    count, closes = np.round(2 * np.log1p(n0)) / 2, np.round(2 * np.log(share)) / 2
    return np.concatenate([rows, np.where(missing, np.nan, count), np.where(missing, np.nan, closes)], 1)


def _with_counts(rows: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Bring the counts of each row's keys to the row, in the order of the keys; a key without count has 0, no key null."""
    keyed = rows.select(*by, F.posexplode("keys").alias("slot", "key")).where("key <> ''")
    got = keyed.join(stats, "key", "left").select(*by, "slot", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("n", "good")])
    return got.groupBy(*by).agg(*[F.array(*[F.max(F.when(F.col("slot") == i, F.col(c))) for i in range(_KEYS)]).alias(c) for c in ("n", "good")])


def aligned_end(short: str, long: str) -> int:
    """How ``short`` ends against its near-copy ``long``: 1 cut inside a word or sentence, 0 whole, -1 no evidence."""
    a = [(m.group(), m.end()) for m in WORD.finditer(short.lower())]
    b = [(m.group(), m.end()) for m in WORD.finditer(long.lower())]
    if len(a) < 8 or len(b) <= len(a) // 2:
        return -1
    for drop in (0, 1):  # the last word may be cut itself
        key = [w for w, _ in a[len(a) - drop - 6 : len(a) - drop]]
        places = [i + 6 for i in range(len(b) - 5) if [w for w, _ in b[i : i + 6]] == key]
        if not places:
            continue
        end = min(places, key=lambda p: abs(p - (len(a) - drop)))
        if drop and not (end < len(b) and b[end][0].startswith(a[-1][0]) and b[end][0] != a[-1][0]):
            continue
        if drop:
            return 1
        if end >= len(b):
            return -1
        rest = long[b[end - 1][1] :]
        return 0 if re.match(r"[^\w\n]*(\n|$)|[\"'”’)\]]*[.!?][\"'”’)\]]*\s", rest) else 1
    return -1


@lru_cache(maxsize=256)
def _shingle_set(text: str) -> np.ndarray:
    return np.unique(shingles(word_hashes(words(text)), K))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, verdict = [], []
        for doc, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = _shingle_set(a), _shingle_set(b)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= SIMILARITY * len(x) and len(b) > len(a):
                v = aligned_end(a, b)
                if v >= 0:
                    ids.append(doc), verdict.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(verdict, pa.int8())], names=["doc_id", "cut"])


def _aligned(texts: DataFrame, signed: DataFrame) -> DataFrame:
    """``(doc_id, cut)`` of the distinct texts that a longer near-copy decides; cut wins where copies disagree."""
    rows = signed.select("doc_id", "chars", F.posexplode("bands").alias("at", "band"), (F.size("bands") - F.col("top")).alias("first"))
    rows = rows.select("doc_id", "chars", "band", (F.col("at") >= F.col("first")).alias("ends"))
    met = rows.groupBy("band").agg(F.count("*").alias("m"), F.min(F.when(F.col("ends"), F.col("chars"))).alias("low"), F.max("chars").alias("high"))
    buckets = met.where("m > 1 and low < high").select("band", "low", F.ceil(F.col("m") / BUCKET).cast("int").alias("blocks"))
    # buckets without a pair are gone by now; as a rule the others fit into a broadcast of counted size
    rows = stage(rows.join(bounded_broadcast(stage(buckets, "buckets"), MAX_BUCKETS), "band"), "bucket-rows")
    own, other = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    short = rows.where("ends").select("band", own.alias("i"), other.alias("j"), "doc_id", "chars")
    long = rows.where("chars > low").select("band", other.alias("i"), own.alias("j"), F.col("doc_id").alias("longer"), F.col("chars").alias("chars_b"))
    pairs = short.join(long, ["band", "i", "j"]).where("chars < chars_b").select("doc_id", "longer").distinct()
    pairs = stage(pairs, "pairs")
    asked = pairs.select("doc_id").union(pairs.select("longer")).distinct()
    text = texts.select("doc_id", "text").join(bounded_broadcast(asked, MAX_BUCKETS), "doc_id", "left_semi")
    both = pairs.join(text.select("doc_id", F.col("text").alias("a")), "doc_id").join(text.select(F.col("doc_id").alias("longer"), F.col("text").alias("b")), "longer")
    return both.select("doc_id", "a", "b").mapInArrow(_align, "doc_id long, cut byte").groupBy("doc_id").agg(F.max("cut").alias("cut"))


def _limits(docs: DataFrame) -> DataFrame:
    """``(source, unit, len)`` at which the texts of a source pile up, in characters and in UTF-8 bytes."""
    sizes = docs.select("source", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), f("text").alias("len")) for u, f in (("chars", F.length), ("bytes", F.octet_length))])).alias("s"))
    c = sizes.groupBy("source", "s.unit", "s.len").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source", "unit").orderBy("len")
    around = (F.sum("c").over(w.rangeBetween(-25, 25)) - F.sum("c").over(w.rangeBetween(-2, 2))) / F.lit(46.0)
    return c.withColumn("around", around).where("c >= 5 and c >= 8 * (around + 0.3)").select("source", "unit", "len")


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(2)).cast("int")


def _fit(train) -> Boosted | None:
    """Trees that tell artificial cuts from the documents themselves; both weigh the same."""
    label = train["label"].to_numpy()
    if (label == 1).sum() < LEAST or (label == 2).sum() < LEAST:
        return None
    x = _matrix(train["plain"].tolist(), train["n"].tolist(), train["good"].tolist(), label)
    y = (label == 1).astype(float)
    return fit_boosted(x, y, weight=np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))), trees=60, depth=4, rate=0.15, reg=5.0)


def truncated(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, how, score, cut)`` of every document that has a text; ``how`` is aligned or closing."""
    spark = docs.sparkSession
    base = docs.select("doc_id", "source", "text").where("doc_id is not null and length(trim(text)) > 0")
    firsts = stage(base.groupBy(F.xxhash64("text").alias("th"), F.length("text").alias("tl")).agg(F.min("doc_id").alias("doc_id")), "distinct-texts")
    # repeats are few as a rule, so texts are not shuffled to leave them out; a large set of them is joined by shuffle
    keyed = base.select("doc_id", F.xxhash64("text").alias("th"), F.length("text").alias("tl"))
    repeats = keyed.join(firsts.withColumnRenamed("doc_id", "first"), ["th", "tl"]).where("doc_id <> first").select("doc_id")
    texts = base.join(stage(repeats, "repeats"), "doc_id", "left_anti").select("doc_id", "source", "text")
    total = firsts.count()
    share = max(1, -(-total // TRAIN_DOCS))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    read = stage(texts.select("doc_id", "text", pick.alias("pick")).mapInArrow(lambda it: _read(it, share), _ROW), "read")
    stats = stage(read.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "closings")
    rows = read.where("doc_id is not null").select("doc_id", "variant", "label", "plain", "keys")
    none = F.array(*[F.lit(None).cast("double")] * _KEYS)
    counted = rows.drop("keys").join(_with_counts(rows, stats, ["doc_id", "variant"]), ["doc_id", "variant"], "left")
    counted = stage(counted.withColumns({"n": F.coalesce("n", none), "good": F.coalesce("good", none)}), "ends-counted")
    # about 3 * TRAIN_DOCS rows: the picked documents and their artificial cuts
    train = counted.where("label > 0").orderBy(pick, "doc_id", "variant").limit(4 * TRAIN_DOCS).select("plain", "n", "good", "label", _fold().alias("fold")).toPandas()
    # two models, each trained on one half of the documents and used on the other, so none judges what it learnt
    model = [_fit(train[train["fold"] != k]) for k in (0, 1)]
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), np.zeros(b.num_rows))
            fold = b.column(4).to_numpy(zero_copy_only=False)
            m = np.where((x[:, 0] > 0) | (x[:, 3] > 0), -5.0, 5.0)  # too few documents to learn from
            for k in (0, 1):
                if shared.value[k] is not None and (fold == k).any():
                    m[fold == k] = shared.value[k].margin(x[fold == k])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m)], names=["doc_id", "margin"])

    real = counted.where("label <> 1")
    scored = real.select("doc_id", "plain", "n", "good", _fold().alias("fold")).mapInArrow(score, "doc_id long, margin double")
    signed = read.where("label <> 1").select("doc_id", "chars", "bands", "top")
    verdict = scored.join(_aligned(texts, signed), "doc_id", "left")
    same = firsts.join(verdict, "doc_id").select("th", "tl", "margin", F.col("cut").alias("aligned"))
    limits = stage(_limits(base), "limits")
    chars = limits.where("unit = 'chars'").select(F.col("source").alias("cs"), F.col("len").alias("cl"))
    octets = limits.where("unit = 'bytes'").select(F.col("source").alias("os"), F.col("len").alias("ol"))
    all_docs = base.select("doc_id", "source", F.xxhash64("text").alias("th"), F.length("text").alias("tl"), F.octet_length("text").alias("tb")).join(same, ["th", "tl"])
    out = all_docs.join(chars, F.col("source").eqNullSafe(F.col("cs")) & (F.col("tl") == F.col("cl")), "left")
    out = out.join(octets, F.col("source").eqNullSafe(F.col("os")) & (F.col("tb") == F.col("ol")), "left")
    odds = F.col("margin") + F.when(F.col("cl").isNotNull() | F.col("ol").isNotNull(), F.lit(LIMIT_ODDS)).otherwise(F.lit(0.0))
    score_ = F.when(F.col("aligned").isNotNull(), F.col("aligned").cast("double")).otherwise(1 / (1 + F.exp(-odds)))
    out = out.select("doc_id", "source", F.when(F.col("aligned").isNotNull(), "aligned").otherwise("closing").alias("how"), score_.alias("score"))
    return out.withColumn("cut", F.col("score") > THRESHOLD)


def truncation_by_source(docs: DataFrame) -> DataFrame:
    """``(source, documents, cut, share)``, a null source as a row of its own."""
    g = truncated(docs).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"))
    return g.withColumn("share", F.col("cut") / F.col("documents"))
