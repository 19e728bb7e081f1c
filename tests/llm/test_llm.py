"""Operators for training data against brute force, round trips and defined edge cases."""

import random
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.llm import boost, chunking, fm_index, leakage, mixing, near_dup, scan_repair, truncation, vector_lists
from recordloom.llm.words import words

NOUNS = "ledger valve bridge contract roof pump index survey permit culvert depot lease audit boiler sample roster window filter gate tender".split()
VERBS = "approved repaired copied signed measured replaced delivered recorded tested renewed".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} was {rng.choice(VERBS)} with {rng.randint(2, 999)} {rng.choice(NOUNS)}s near the {rng.choice(NOUNS)}."


def document(rng, n=8):
    return " ".join(sentence(rng) for _ in range(n))


# ---- near-duplicates ---------------------------------------------------------------------------------------


def jaccard_pairs(rows, t=0.7):
    sets = {}
    for uri, title, body in rows:
        if uri is None:
            continue
        s = sets.setdefault(uri, set())
        for x in (title, body):
            w = words(x)
            s.update(zip(w, w[1:], w[2:]))
    us = sorted(sets)
    return {(a, b) for i, a in enumerate(us) for b in us[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def near_rows():
    rng = random.Random(3)
    rows = []
    for i in range(40):
        body = document(rng)
        rows.append((i * 10, f"Title {i} of {rng.choice(NOUNS)}", body))
        for k in range(rng.randint(0, 3)):
            w = body.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(NOUNS)
            rows.append((i * 10 + k + 1, f"Title {i} of {rng.choice(NOUNS)}", " ".join(w)))
    rows += [(9001, None, None), (9002, "", ""), (9003, "ab", "c d"), (None, "x y z", "x y z a"), rows[0], (9004, rows[0][1], rows[0][2])]
    return rows


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame(rows, "record_uri long, record_title string, chunk_content string").withColumn("sig", F.lit(1))
    want = jaccard_pairs(rows)
    got = {tuple(r) for r in near_dup.similar_records(df).collect()}
    assert got == want and len(want) > 20
    monkeypatch.setattr(near_dup, "HOT_LIST", 2)  # every list is cut into blocks
    assert {tuple(r) for r in near_dup.similar_records(df).collect()} == want
    groups = {r.record_uri: r for r in near_dup.similar_groups(df).collect()}
    links = Counter(u for p in want for u in p)
    assert all(groups[u].n_links == links[u] for u in groups)
    assert all(groups[a].group_id == groups[b].group_id for a, b in want)
    assert groups[9004].class_id == 0
    assert near_dup.similar_records(df.limit(0)).count() == 0


def test_a_shingle_of_many_records_is_cut_into_blocks(spark, monkeypatch):
    """Every list stays within two blocks, also where each partition holds a single record."""
    monkeypatch.setattr(near_dup, "HOT_LIST", 50)
    routes = spark.range(0, 2000, 1, 400).select(F.lit(7).cast("long").alias("h"), F.lit(9).alias("n"), F.col("id").alias("uri"), F.lit(True).alias("small"))
    routes = routes.union(spark.range(5).select(F.lit(8).cast("long"), F.lit(9), "id", F.lit(True)))
    lists = near_dup._lists(routes)
    sizes = {(r.h, r.block): r["count"] for r in lists.groupBy("h", "block").count().collect()}
    assert sizes.pop((8, 0)) == 5 and len(sizes) == 40 * 41 // 2 and max(sizes.values()) < 4 * 50
    met = near_dup._merge(iter(lists.where("h = 7").repartition("h", "block").sortWithinPartitions("h", "block", "n", "uri").toArrow().combine_chunks().to_batches()), 7, 10)
    pairs = pa.Table.from_batches(list(met)).to_pandas()
    assert len(pairs.drop_duplicates(["a", "b"])) == len(pairs) == 2000 * 1999 // 2


# ---- chunking ----------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \ńé", min_size=0, max_size=3000), st.integers(60, 400))
def test_pieces_cover_the_text(text, limit):
    got = chunking.pieces(text, limit, limit // 10, 4)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert b - limit // 10 <= c <= b < d
    assert text == text[: got[0][1]] + "".join(text[p[1] : q[1]] for p, q in zip(got, got[1:]))


def test_edits_stay_local():
    rng = random.Random(1)
    text = "\n\n".join(document(rng, 6) for _ in range(60))
    at = len(text) // 2
    edited = text[:at] + "some inserted words " + text[at:]
    before, after = ({t[a:b] for a, b in chunking.pieces(t)} for t in (text, edited))
    assert len(after - before) <= 3


def test_rechunk(spark):
    big = "\n\n".join(f"[PAGE {i}]\n" + document(random.Random(i), 20) for i in range(3, 12))
    rows = [(1, 7, "e0", 0, 0, 1, "short"), (2, 7, "e1", 1, 5, 2, big), (3, 7, "e1", 1, 5, 2, big), (4, 7, "e2", 2, 9, 0, None), (5, None, "n", 0, 0, 0, ""), (6, 8, "b", 0, 0, 0, "x" * 15000), (7, None, "n", 3, 0, 0, "again"), (8, None, None, None, 0, 0, "alone"), (9, None, None, None, 0, 0, "alone"), (10, 8, None, None, 0, 0, "last")]
    df = spark.createDataFrame(rows, "id long, record_uri long, embedding_id string, chunk_sequence int, start_position int, page_number int, chunk_content string")
    got = chunking.rechunk(df).collect()
    assert all(len(r.chunk_content or "") <= 6000 for r in got)
    seven = [r for r in got if r.record_uri == 7 and r.id != 3]
    assert sorted(r.chunk_sequence for r in seven) == list(range(len(seven))) and {r.total_chunks for r in seven} == {len(seven)}
    pages = [r.page_number for r in sorted(seven, key=lambda r: r.chunk_sequence) if r.id == 2]
    assert pages == sorted(pages) and pages[0] == 3 and pages[-1] > pages[0]
    assert {(r.chunk_sequence, r.piece) for r in got if r.id == 2} == {(r.chunk_sequence, r.piece) for r in got if r.id == 3}
    lone = {r.id: (r.chunk_sequence, r.total_chunks) for r in got if r.record_uri is None}
    assert lone == {5: (0, 2), 7: (1, 2), 8: (0, 1), 9: (0, 1)}
    last = [r for r in got if r.id == 10][0]
    assert last.chunk_sequence == last.total_chunks - 1 and len(got) == len({(r.id, r.piece) for r in got})
    assert {r.id for r in chunking.split_oversized(df).collect()} == {2, 3, 6}
    assert chunking.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.pieces("x", 10, 9)


# ---- neighbours --------------------------------------------------------------------------------------------


def test_neighbours_recall(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    m = (centres[rng.integers(0, 30, 3000)] + 0.7 * rng.normal(size=(3000, 16))).astype(np.float32)
    m[:400] = m[0]  # a hot group of copies
    rows = [(f"v{i:05d}", i, [float(x) for x in m[i]]) for i in range(3000)] + [("z0", 1, [0.0] * 16), ("z1", 1, None), ("z2", 1, [1.0] * 3), ("v00001", 9000, None), (None, 1, [1.0] * 16)]
    df = spark.createDataFrame(rows, "eid string, id long, vector array<float>")
    monkeypatch.setattr(vector_lists, "SHARD_ROWS", 256)
    monkeypatch.setattr(vector_lists, "QUERY_BLOCK", 16)
    from recordloom.session import stage

    v = stage(vector_lists.unit_vectors(df, "eid", "vector", "id", 16), "t")
    assert v.count() == 3000
    q = v.where("cast(substr(id, 2) as int) % 50 = 0")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)

    def recall():
        got: dict[str, set] = {}
        for r in vector_lists.nearest(v, q, 10, 16).collect():
            got.setdefault(r["query"], set()).add(r["id"])
        hit = total = 0
        for name, ids in got.items():
            i = int(name[1:])
            s = unit @ unit[i]
            s[i] = -9
            kth = np.sort(s)[-10]
            assert len(ids) == 10 and name not in ids
            hit += sum(s[int(x[1:])] >= kth - 1e-5 for x in ids)
            total += 10
        assert len(got) == 60
        return hit / total

    assert recall() >= 0.9
    # few lists: they are cut into cells, spread over shards where copies cannot be told apart, and into lists within a task
    for name, value in (("MAX_LISTS", 4), ("SHARD_ROWS", 128), ("LOCAL_ROWS", 64)):
        monkeypatch.setattr(vector_lists, name, value)
    assert recall() >= 0.95
    monkeypatch.setattr(vector_lists, "MAX_CELLS", 20)  # the length bound grows where there would be too many cells
    assert recall() >= 0.95
    assert vector_lists.nearest(v.limit(0), q, 10, 16).count() == 0


# ---- leaks -------------------------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=200), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index_finds_all(text, phrase):
    f = fm_index.FMIndex(np.array(text, np.int64), 4)
    low, high = np.array([0]), np.array([f.n])
    for s in phrase[::-1]:
        low, high = f.extend(low, high, np.array([s]))
    want = [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]
    assert sorted(f.locate(np.arange(low[0], high[0]))) == want


def test_leaks(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(300)]

    def document(rng, n):
        return " ".join(" ".join(rng.choice(vocabulary) for _ in range(12)) + "." for _ in range(n))

    instruction = "Read the passage below and answer the question that follows it in one short sentence."
    items = [(i, (instruction + "\n\n" if i % 2 else "") + document(rng, 5)) for i in range(12)] + [(50, None), (51, "")]
    docs = [(i, document(rng, 12)) for i in range(60)]
    want = set()

    def passage(i, n, at=0):
        return " ".join(items[i][1].split("\n\n")[-1].split()[at : at + n])

    docs.append((100, docs[0][1] + " " + passage(1, 40).upper().replace(" ", "\n ") + docs[1][1]))
    want.add((100, 1))
    w = passage(2, 45).split()
    for k in (9, 20, 33):
        w[k] = "changed"
    docs.append((101, docs[2][1] + " -- " + ", ".join(w)))
    want.add((101, 2))
    docs.append((102, docs[3][1] + instruction + passage(3, 9)))  # instruction and a short quotation only
    docs.append((103, passage(4, 30) + docs[4][1] + passage(5, 35)))
    want |= {(103, 4), (103, 5)}
    docs += [(104, None), (105, ""), (106, docs[60][1])]
    want.add((106, 1))
    long = " ".join(document(rng, 50) for _ in range(20)) + passage(6, 60) + document(rng, 40)
    docs.append((107, long))
    want.add((107, 6))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    e = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, e).collect()}
    assert found() == want
    monkeypatch.setattr(leakage, "SHARD_WORDS", 2000)
    monkeypatch.setattr(leakage, "BLOCK", 5)
    assert found() == want
    monkeypatch.setattr(leakage, "PASS_WORDS", 300)
    assert found() == want
    span = {r.doc_id: r for r in leakage.find_leaks(d, e, spans=True).collect() if r.item_id == 6}[107]
    assert words(long[span.start_char : span.end_char])[:40] == words(passage(6, 60))[:40]
    assert leakage.find_leaks(d.limit(0), e).count() == 0 and leakage.find_leaks(d, e.limit(0)).count() == 0


def test_leaks_of_a_hot_item(spark, monkeypatch):
    rng = random.Random(12)
    item = [f"w{i}" for i in range(30)]
    # copied cleanly many times, and with words changed so that the clean runs are of 5 to 9 words
    docs = [(i, " ".join(item)) for i in range(60)]
    for i in range(60, 80):
        w, at = list(item), rng.randint(5, 8)
        while at < 30:
            w[at], at = f"x{i}", at + rng.randint(6, 10)
        docs.append((i, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    e = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[::-1]))], "item_id long, text string")
    for hits in (1_000_000, 50):
        monkeypatch.setattr(leakage, "HITS", hits, raising=False)
        assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, e).collect()} == {(i, 1) for i in range(80)}


def test_leaks_of_repeated_items(spark, monkeypatch):
    rule = "Read the passage below and answer the question that follows it in one short sentence " + " ".join(f"r{i}" for i in range(20))
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(i, f"{rule}\n{passage}") for i in range(4)] + [(10 + i, f"{rule}\n" + " ".join(f"v{i}x{k}" for k in range(30))) for i in range(4)]
    e = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(1, passage), (2, rule)], "doc_id long, text string")
    for block, words_at_once in ((4000, 4_000_000), (2, 4_000_000), (4000, 100)):
        monkeypatch.setattr(leakage, "BLOCK", block)
        monkeypatch.setattr(leakage, "PASS_WORDS", words_at_once)
        assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, e).collect()} == {(1, i) for i in range(4)}


def test_leaks_do_not_depend_on_passes(spark, monkeypatch):
    """A quotation that is half instruction, null ids and every fifth word changed, in one pass and in many."""
    rule = " ".join(f"r{i}" for i in range(16))
    items = [(i, rule + "\n" + " ".join(f"v{i}x{k}" for k in range(40))) for i in range(8)] + [(None, " ".join(f"n{k}" for k in range(30))), (None, " ".join(f"m{k}" for k in range(30)))]
    every_fifth = " ".join(f"v5x{k}" if k % 5 < 4 else "other" for k in range(34))
    docs = [(1, rule + " " + " ".join(f"v3x{k}" for k in range(14))), (2, " ".join(f"n{k}" for k in range(30))), (3, every_fifth), (4, " ".join(f"v6x{k}" for k in range(24)))]
    e = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for block, words_at_once in ((4000, 4_000_000), (2, 4_000_000), (3, 120), (4000, 1)):
        monkeypatch.setattr(leakage, "BLOCK", block)
        monkeypatch.setattr(leakage, "PASS_WORDS", words_at_once)
        assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, e).collect()} == {(2, None), (3, 5)}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**30), min_size=1, max_size=60))
def test_suffix_array_of_large_symbols(text):
    got = fm_index.suffix_array(np.array(text, np.int64))
    assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_leaks_with_a_rewritten_clause(spark):
    item = [f"w{i}" for i in range(60)]
    docs = [
        (1, item[:25] + [f"x{i}" for i in range(9)] + item[34:39]),
        (2, item[:5] + [f"x{i}" for i in range(9)] + item[14:39]),
        (3, item[:12] + [f"x{i}" for i in range(9)] + item[21:33]),  # 24 words in two parts
        (4, item[:26] + [f"x{i}" for i in range(9)] + item[35:37] + [f"x{i}" for i in range(10)] + item[30:35]),
    ]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    e = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in leakage.find_leaks(d, e).collect()} == {1, 2, 4}
    span = {r.doc_id: r for r in leakage.find_leaks(d, e, spans=True).collect()}
    text = " ".join(docs[0][1])
    assert text[span[1].start_char : span[1].end_char] == " ".join(item[:25]) and span[1].words == 25


# ---- mixing ------------------------------------------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, s, document(rng, rng.randint(1, 9))) for i, s in enumerate(["big"] * 400 + ["mid"] * 100 + ["small"] * 12 + [None] * 5 + ["other"] * 5)] + [(900, "mid", None), (901, "mid", "")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("k", F.lit(0))
    t = spark.createDataFrame([(1, "big", 0.5, 2), (1, "mid", 0.3, 4), (1, "small", 0.2, 3), (2, "mid", 1.0, 1), (2, "none", 0.5, 1)], "recipe int, source string, target_share double, max_repeats int")
    rows = mixing.mix(d, t).collect()
    copies = Counter((r.recipe, r.doc_id) for r in rows)
    caps = {(1, "big"): 2, (1, "mid"): 4, (1, "small"): 3, (2, "mid"): 1}
    assert all(copies[r.recipe, r.doc_id] <= caps[r.recipe, r.source] and r.copy <= copies[r.recipe, r.doc_id] for r in rows)
    report = {(r.recipe, r.source): r for r in mixing.mix_report(d, t).collect()}
    assert not report[1, "small"].reachable and report[1, "small"].copies == 36 and report[1, "big"].reachable
    got = {s: report[1, s].mix_tokens for s in ("big", "mid")}
    assert got["big"] / got["mid"] == pytest.approx(0.5 / 0.3, rel=0.05)
    assert report[2, "none"].mix_tokens == 0 and not report[2, "none"].reachable
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(d, t).collect()))
    ranks = mixing.ranked(mixing.token_counts(d)).where("source = 'big'").select("k").collect()
    assert sorted(r.k for r in ranks) == list(range(1, 401))
    assert mixing.mix(d.limit(0), t).count() == 0


# ---- cut texts ---------------------------------------------------------------------------------------------


def test_aligned_end():
    rng = random.Random(6)
    whole = document(rng, 9)
    sentences = re.split(r"(?<=\.) ", whole)
    assert truncation.aligned_end(" ".join(sentences[:8]), whole) == 0
    assert truncation.aligned_end(" ".join(sentences[:8]) + " " + " ".join(sentences[8].split()[:4]), whole) == 1
    assert truncation.aligned_end(whole[:-9], whole + " " + sentence(rng)) == 1
    assert truncation.aligned_end("too short", whole) == -1 and truncation.aligned_end(whole, whole) == -1


def test_truncated(spark):
    rng = random.Random(8)
    docs, cut = [], set()
    for i in range(900):
        t = document(rng, rng.randint(3, 9))
        kind = rng.random()
        if kind < 0.15:
            t += f"\n\nSigned,\n{rng.choice(['Ann', 'Bob', 'Eve'])} {rng.choice(['Hill', 'Wood', 'Lake'])}"
        elif kind < 0.25:
            t += "\n\n" + "\n".join(f"- {rng.choice(NOUNS)} {rng.choice(NOUNS)}" for _ in range(3))
        elif kind < 0.3:
            t += " And so on..."
        elif kind < 0.42:
            at = rng.randint(len(t) // 2, len(t) - 5)
            t = t[:at]
            if not t.rstrip().endswith("."):
                cut.add(i)
        docs.append((i, rng.choice(["a", "b", None]), t))
    docs += [(5000, "a", docs[min(cut)][2]), (5001, "a", None), (5002, "a", ""), (5003, "a", "   ")]
    cut.add(5000)
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("score", F.lit(0))
    got = {r.doc_id: r.cut for r in truncation.truncated(d).collect()}
    assert not {5001, 5002, 5003} & set(got)
    flagged = {i for i, c in got.items() if c}
    assert len(flagged & cut) >= 0.95 * len(cut) and len(flagged - cut) <= 0.05 * len(cut) + 2
    assert (5000 in flagged) == (min(cut) in flagged)
    by = {r.source: r for r in truncation.truncation_by_source(d).collect()}
    assert sum(r.cut for r in by.values()) == len(flagged) and None in by
    assert truncation.truncated(d.limit(0)).count() == 0


# ---- scanned pages -----------------------------------------------------------------------------------------


def test_boosted_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    x[:, 3] = rng.random(2000) < 0.01  # a rare flag
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 3] > 0)).astype(float)
    m = boost.fit_boosted(x, y)
    assert ((m.probability(x) > 0.5) == (y > 0.5)).mean() > 0.93
    assert (m.probability(x[x[:, 3] > 0]) > 0.5).all()


def test_misread_cost():
    assert scan_repair.misread_cost("rnajor", "major")[1:] == (1, 0) and scan_repair.misread_cost("v@lve", "valve")[1:] == (1, 0)
    assert scan_repair.misread_cost("vavle", "valve")[2] > 0
    assert scan_repair.fold("Followmg") == scan_repair.fold("following") and scan_repair.core_word('"valve",') == "valve"


def test_held_out_layout():
    """Furniture and hyphens of pages set from texts that were not trained on."""
    rng = random.Random(2)
    texts = [("\n\n".join(document(rng, 5) for _ in range(3)), f"{rng.choice(NOUNS).title()} {i}.pdf") for i in range(160)]
    lexicon = Counter(w for t, _ in texts for w in words(t) if w.isalpha())
    learnt = [(f"Desk copy, {n} registry", False) for n in ("roads", "water", "parks")] + [("Folio 7 recto", True)]
    m = scan_repair.train_layout(texts[:120], [], lexicon, learnt)
    g = np.random.default_rng(77)
    names = [n.title() for n in NOUNS]
    right = wrong = missed = joins = bad_joins = kinds_right = 0
    for text, title in texts[120:]:
        made = scan_repair.synthetic_page(text, title, names, g, [("Folio 31 recto", True), ("Desk copy, tolls registry", False)])
        page = scan_repair.Page.of("\n".join(made.lines), title, m.habit)
        rows = [i for i, x in enumerate(page.lines) if x.strip()]
        p = m.furniture.probability(np.array([page.features(i) for i in rows])) > 0.5
        for i, q in zip(rows, p):
            right += q and made.furniture[i]
            wrong += q and not made.furniture[i]
            missed += made.furniture[i] and not q
        fixed, kinds = scan_repair.lay_out([page], m)[0]
        want = {k for k, on in (("header", any(made.text)), ("pageno", any(made.number)), ("hyphen", any(e[3] for e in made.ends))) if on}
        kinds_right += kinds == want
        paragraphs = [x for x in fixed.split("\n") if x.strip()]
        joins += 1
        bad_joins += abs(len(paragraphs) - sum(b for b, f in zip(made.begins, made.furniture) if not f)) > 1
    assert right >= 0.95 * (right + missed) and wrong <= 0.05 * right
    assert bad_joins <= 0.1 * joins and kinds_right >= 0.9 * joins


def test_repair(spark):
    rng = random.Random(12)
    rows = [(i, f"Report {i}.txt", "\n\n".join(document(rng, 5) for _ in range(2)), 0) for i in range(400)]
    page = (
        "The valve of the bridge was appr-\noved with 12 ledgers near the\nroof. The purnp of the c0ntract was\nHARBOUR DESK — MAY 2014   7\nsigned with 4 boilers near the depot\nand the survey was recorded with 9\n"
        "permits near the window. The audit\nof the tender was measured with 3\nsamples near the gate.\n\n8\n\nThe filter of the roster was tested."
    )
    rows += [(1000, "Scan.pdf", page, 3), (1001, "Scan.pdf", page, 3), (1002, "Plain.pdf", document(rng), 2), (1006, "Short.pdf", "The purnp of the\nroof was signed.", 1), (1003, "Null.pdf", None, 2), (1004, "Empty.pdf", "", 2), (1005, "NoPage.pdf", textwrap.fill(document(rng), 60), None)]
    df = spark.createDataFrame(rows, "id long, record_title string, chunk_content string, page_number int").withColumn("text", F.lit("x"))
    got = {r.id: r for r in scan_repair.repair_scans(df).collect()}
    assert set(got) == {1000, 1001, 1002, 1004, 1006} and got[1000].text == got[1001].text
    assert got[1002].text == rows[402][2] and not got[1002].kinds and got[1004].text == "" and not got[1004].kinds
    assert set(got[1000].kinds) == {"hyphen", "header", "pageno", "misread"}
    t = got[1000].text
    assert "approved with" in t and "pump of the contract was signed" in t and "HARBOUR" not in t and "\n8\n" not in t
    assert got[1006].text == "The pump of the\nroof was signed." and got[1006].kinds == ["misread"]
    assert {(r.id, r.kind) for r in scan_repair.scan_damage(df).collect()} == {(i, k) for i in (1000, 1001) for k in ("hyphen", "header", "pageno", "misread")} | {(1006, "misread")}
    assert scan_repair.repair_scans(df.limit(0)).count() == 0


def test_furniture_is_learnt_from_lines_that_repeat(spark):
    rng = random.Random(16)
    pages = []
    for r in range(30):
        for k in range(4):
            lines = textwrap.wrap(document(rng, 8), 50)
            pages.append((r * 10 + k, r, "S.pdf", "\n".join(lines[:3] + [f"Held by the {NOUNS[r % 5]} keeper  {k + 3}"] + lines[3:]), 2))
    df = spark.createDataFrame(pages, "id long, record long, title string, body string, page long").select("record", F.col("id").alias("page"), "body")
    learnt = scan_repair._repeated_lines(df, 120)
    assert len(learnt) >= 25 and all(line.startswith("Held by") and own for line, own in learnt)
    assert scan_repair._repeated_lines(df.limit(0), 0) == []


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeilmnrtu01", min_size=3, max_size=12), st.text("abcdeilmnrtu", min_size=3, max_size=12), st.randoms())
def test_rare_grams_find_every_pair(read, printed, rng):
    """Words that share enough grams share one of their rarest, whatever the order of grams."""
    if abs(len(read) - len(printed)) > 2:
        return
    a, b = set(scan_repair.grams(read)), set(scan_repair.grams(printed))
    common = {g: rng.randint(0, 3) for g in a | b}
    if len(a & b) >= scan_repair.least_shared(len(read), len(printed)):
        left = scan_repair._rare_grams(read, scan_repair.least_shared(len(read), 0), common)
        least = min(scan_repair.least_shared(n, len(printed)) for n in range(len(printed) - 2, len(printed) + 3))
        assert set(left) & set(scan_repair._rare_grams(printed, least, common))


def test_repair_of_a_page_copied_often(spark):
    rng = random.Random(13)
    rows = [(i, f"Report {i}.txt", "\n\n".join(document(rng, 5) for _ in range(2)), 0) for i in range(400)]
    page = "The valve of the bridge was signed with 12 ledgers\nnear the roof. The purnp of the c0ntract was signed\nwith 4 boilers near the depot and the survey was\nrecorded with 9 permits near the window."
    head = "Record URI: {}\n\n--- Document Content ---\n"
    rows += [(1000 + i, "Scan.pdf", head.format(i) + page, 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, record_title string, chunk_content string, page_number int")
    got = {r.id: r for r in scan_repair.repair_scans(df).collect()}
    assert len(got) == 300 and all("misread" in r.kinds and "pump of the contract" in r.text for r in got.values())


# ---- the registered queries --------------------------------------------------------------------------------


def test_truth_by_brute_force(spark):
    from pathlib import Path

    from recordloom.llm import queries

    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no test tables")
    chunks = spark.read.parquet(f"{d}/record_chunks.parquet").select("record_uri", "record_title", "chunk_content").collect()
    assert {tuple(r) for r in queries.p2_found(spark, d).collect()} == jaccard_pairs(chunks)
    assert {r.id for r in queries.p3_found(spark, d).collect()} == {r.id for r in spark.read.parquet(f"{d}/record_chunks.parquet").where("length(chunk_content) > 6000").collect()}
    vec = {}
    for r in spark.read.parquet(f"{d}/record_chunks.parquet").orderBy("id").collect():
        if r.vector is not None and len(r.vector) == 64 and any(r.vector):
            vec[r.embedding_id] = np.array(r.vector) / np.linalg.norm(r.vector)
    want = set()
    for p in spark.read.parquet(f"{d}/knn_probes.parquet").collect():
        if p.embedding_id in vec:
            best = sorted((x for x in vec if x != p.embedding_id), key=lambda x: -float(vec[x] @ vec[p.embedding_id]))[:10]
            want |= {tuple(sorted((p.embedding_id, x))) for x in best}
    got = {tuple(r) for r in queries.p4_found(spark, d).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_tokens_match_the_vocabulary():
    try:
        enc = mixing.encoder(mixing.VOCABULARY)
    except FileNotFoundError:
        pytest.skip("no vocabulary")
    t = "The valve of the bridge, 12 ledgers."
    assert enc.decode(enc.encode_ordinary(t)) == t
    b = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", None]), pa.array([t, None])], names=["doc_id", "source", "text"])
    assert next(mixing._count(iter([b]), mixing.VOCABULARY)).column(2).to_pylist() == [len(enc.encode_ordinary(t)), 0]


def test_cut_near_copies_are_aligned(spark):
    """Copies that stop inside a sentence are found by alignment; copies that stop after one are whole."""
    rng = random.Random(21)
    docs, cut, whole = [], set(), set()
    for i in range(30):
        sentences = [sentence(rng) for _ in range(16)]
        docs.append((i, "a", " ".join(sentences)))
        if i % 3 == 0:
            docs.append((100 + i, "b", " ".join(sentences[:15]) + " " + " ".join(sentences[15].split()[:5])))
            cut.add(100 + i)
        elif i % 3 == 1:
            docs.append((100 + i, "b", " ".join(sentences[:15])))
            whole.add(100 + i)
        else:
            docs += [(100 + i + k, "b", " ".join(sentences)[:-20]) for k in (0, 100)]  # equal copies, cut inside a word
            cut |= {100 + i, 200 + i}
    got = {r.doc_id: r for r in truncation.truncated(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()}
    assert all(got[i].how == "aligned" and got[i].cut for i in cut)
    assert all(got[i].how == "aligned" and not got[i].cut for i in whole)
    assert all(got[i].how == "closing" for i in range(30))


def test_cut_copies_are_aligned_beside_longer_texts(spark, monkeypatch):
    rng = random.Random(31)
    whole = document(rng, 40)
    short = whole[: int(len(whole) * 0.9)].rsplit(" ", 2)[0]
    # longer versions of the text fill its buckets; the whole text is a part of them that ends with a sentence
    docs = [(1, "a", short), (2, "a", whole)] + [(10 + i, "a", whole + " " + document(rng, 14)) for i in range(80)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    assert short[-1] != "."
    for bucket in (1000, 3):
        monkeypatch.setattr(truncation, "BUCKET", bucket)
        got = {r.doc_id: (r.how, r.cut) for r in truncation.truncated(d).collect()}
        assert got[1] == ("aligned", True) and got[2] == ("aligned", False)


def test_copies_cut_far_from_their_end_are_aligned(spark):
    """However much was cut off, and with words changed, the alignment decides; ends that look whole are found too."""
    rng = random.Random(41)
    docs, cut = [], set()
    for i in range(60):
        w = document(rng, rng.randint(12, 60)).split()
        docs.append((i, "a", " ".join(w)))
        at = rng.randint(len(w) // 8, len(w) - 4)
        while w[at - 1].endswith(".") or at < 12:
            at += 1
        copy = w[:at]
        for k in range(0, at - 10, 60):
            copy[k + rng.randrange(10)] = "altered"
        docs.append((100 + i, "b", " ".join(copy) + ("." if i % 2 else "")))
        cut.add(100 + i)
    rng.shuffle(docs)
    got = {r.doc_id: (r.how, r.cut) for r in truncation.truncated(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()}
    found = {i for i in cut if got[i] == ("aligned", True)}
    assert len(found) >= 0.9 * len(cut) and not [i for i in range(60) if got[i][1]]


def test_signatures_of_prefixes():
    rng = random.Random(43)
    text = document(rng, 60)
    short = " ".join(text.split()[:150])
    (a, b, tiny, none), (ta, tb, _, tn) = truncation.signatures([text, short, " ".join(text.split()[:9]), "only a few words"])
    assert set(b) <= set(a) and ta == tb == truncation.BANDS and set(tiny) <= set(a) and len(none) == tn == 0
    assert truncation.signatures([]) == ([], [])
