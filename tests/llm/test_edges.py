"""Every operator on nulls in any column, empty and very long texts, repeated rows, empty tables and columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.llm import chunking, leakage, mixing, near_dup, scan_repair, truncation, vector_lists
from recordloom.session import stage

CLASHING = ["uri", "rep", "m", "n", "k", "key", "c", "w", "v", "h", "a", "b", "band", "bands", "block", "side", "size", "list", "cell", "shard", "first", "page", "kinds", "odd", "reads", "label", "plain", "keys", "good", "variant", "pick", "row", "slot", "uid", "lines", "line", "own", "piece", "toks", "sig", "th", "tl", "part", "rate", "copies", "rank", "query", "_p", "_part", "_local", "bucket", "term"]


def clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def with_nulls(spark, rows, schema):
    """The rows, and the first one again with a null in each column by itself and in all."""
    first = rows[0]
    holes = [tuple(None if j == i else x for j, x in enumerate(first)) for i in range(len(first))]
    return clash(spark.createDataFrame([*rows, *holes, tuple([None] * len(first)), first], schema))


def words(rng, n):
    return " ".join(rng.choice("ledger valve bridge contract roof pump index survey permit culvert".split()) + rng.choice(["", "s", "ing"]) for _ in range(n))


def lines(rng, n):
    return "\n".join(words(rng, 8) for _ in range(n)) + "."


CHUNKS = "id long, record_uri long, embedding_id string, record_title string, chunk_content string, chunk_sequence int, start_position int, page_number int"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(5)
    rows = [(i, i // 2, f"e{i}", f"Title {i}.pdf", lines(rng, 12) if i % 2 else words(rng, 60), i % 2, 0, i % 3) for i in range(60)]
    rows += [(100, 50, "e100", "", "", 0, 0, 1), (101, 50, "e101", "t", " \n\t", 1, 0, 1), (102, 51, "e102", "t", "x" * 300_000, 0, 0, 2), (103, 52, "e103", "t", lines(rng, 4000), 0, 0, 2), (105, 54, "e105", "t", "." * 300_000, 0, 0, 2), (106, 55, "e106", "t", lines(rng, 60).replace(" ", " " * 2000, 2) + "\n" + " " * 100_000 + "7", 0, 0, 2), (104, 53, "e104", "t", "�́é​" * 50, 0, 0, 2)]
    return with_nulls(spark, rows, CHUNKS)


def test_scan_repair(spark, chunks):
    got = scan_repair.repair_scans(chunks).collect()
    want = chunks.where("page_number > 0 and chunk_content is not null")
    assert len(got) == want.count()
    texts = {r.id: r.text for r in got}
    assert texts[100] == "" and texts[101] == " \n\t" and texts[102] == "x" * 300_000
    assert scan_repair.repair_scans(chunks.where("id is null and chunk_content is null")).count() == 0
    assert set(scan_repair.scan_damage(chunks.where("page_number = 0")).columns) == {"id", "kind"}


def test_near_duplicates(spark, chunks):
    pairs = near_dup.similar_records(chunks)
    assert pairs.columns == ["record_uri_a", "record_uri_b"] and pairs.where("record_uri_a >= record_uri_b or record_uri_a is null or record_uri_b is null").count() == 0
    groups = near_dup.similar_groups(chunks).collect()
    assert len(groups) == len({r.record_uri for r in groups}) and None not in {r.record_uri for r in groups}
    hot = clash(spark.range(300).select(F.col("id").alias("record_uri"), F.lit("the same title of all").alias("record_title"), F.lit("one two three four five six").alias("chunk_content")))
    assert near_dup.similar_records(hot).count() == 300 * 299 // 2 and {r.group_id for r in near_dup.similar_groups(hot).collect()} == {0}
    assert near_dup.similar_groups(hot.limit(0)).count() == 0


def test_chunking(spark, chunks):
    got = chunking.rechunk(chunks).collect()
    assert max(len(r.chunk_content or "") for r in got) <= 6000
    held = {}
    for r in sorted(got, key=lambda r: r.piece):
        held.setdefault(r.id, []).append(r)
    assert len(held[102]) > 50 and set(held) >= {100, 101, 102, 103, 104, None}
    assert chunks.count() == sum(1 for r in got if r.piece == 0)
    assert chunking.rechunk(chunks.limit(0)).count() == 0
    # a repeated row is repeated, not multiplied
    twice = chunks.where("id = 103").union(chunks.where("id = 103"))
    assert chunking.rechunk(twice).count() == 2 * len(held[103])


def test_neighbours(spark):
    rng = random.Random(6)
    rows = [(f"e{i}", i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(40)] + [("e1", 90, [float("nan")] * 8), ("e2", 91, [float("inf")] + [0.0] * 7), ("z", 92, [0.0] * 8), ("s", 93, [1.0]), ("o", 94, [])]
    df = with_nulls(spark, rows, "embedding_id string, id long, vector array<float>")
    v = stage(vector_lists.unit_vectors(df, "embedding_id", "vector", "id", 8), "edges")
    assert {r.id for r in v.collect()} == {f"e{i}" for i in range(40)}
    got = vector_lists.nearest(v, v, 100, 8)
    assert got.count() == 40 * 39 and got.where("query = id").count() == 0  # fewer others than asked for
    assert vector_lists.nearest(v, v.limit(0), 3, 8).count() == 0
    one = v.where("id = 'e3'")
    assert vector_lists.nearest(one, one, 3, 8).count() == 0


def test_leaks(spark):
    rng = random.Random(7)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    docs = with_nulls(spark, [(1, words(rng, 30) + " " + item), (2, ""), (3, " \n"), (4, "x" * 300_000), (5, words(rng, 200_000) + " " + item)], "doc_id long, text string")
    evals = with_nulls(spark, [(7, item), (8, ""), (9, "short one"), (10, "\n\n!!\n")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, evals).collect()}
    assert got == {(d, i) for d in (1, 5, None) for i in (7, None)}
    spans = leakage.find_leaks(docs, evals, spans=True)
    assert spans.columns == ["doc_id", "item_id", "start_char", "end_char", "words"] and spans.where("end_char <= start_char").count() == 0


def test_mixing(spark):
    rng = random.Random(8)
    docs = with_nulls(spark, [(i, "ab"[i % 2], words(rng, 1 + i % 7)) for i in range(50)] + [(60, "a", ""), (61, "b", "x" * 200_000)], "doc_id long, source string, text string")
    targets = with_nulls(spark, [(1, "a", 0.5, 3), (1, "b", 0.5, 3), (2, "c", 1.0, 2), (3, "a", 1.0, 0)], "recipe int, source string, target_share double, max_repeats int")
    rows = mixing.mix(docs, targets.where("recipe is not null and source is not null and target_share is not null and max_repeats is not null")).collect()
    assert rows and {r.recipe for r in rows} == {1}
    mixing.mix(docs, targets).count()
    assert mixing.mix_report(docs, targets).count() >= 4
    assert mixing.mix(docs, targets.limit(0)).count() == 0 and mixing.mix_report(docs.limit(0), targets).where("copies > 0").count() == 0
    with pytest.raises(FileNotFoundError):
        mixing.encoder("/nowhere/at/all.tiktoken")


def test_truncation(spark):
    rng = random.Random(9)
    rows = [(i, "s", words(rng, 40) + ".") for i in range(60)] + [(100, "s", ""), (101, "s", "\n \t"), (102, "s", "x" * 300_000), (103, "s", words(rng, 100_000)), (104, "s", "."), (105, "s", "…"), (106, "s", "a"), (107, "s", "." * 300_000), (108, "s", "a1" * 150_000), (109, "s", "word" + " " * 300_000 + "end"), (110, "s", '."' * 150_000)]
    docs = with_nulls(spark, rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in truncation.truncated(docs).collect()}
    assert set(got) >= set(range(60)) | set(range(102, 111)) and None not in got and not {100, 101} & set(got)
    by = truncation.truncation_by_source(docs)
    assert {r.source for r in by.collect()} == {"s", None}
    assert truncation.truncation_by_source(docs.where("text is null")).count() == 0
