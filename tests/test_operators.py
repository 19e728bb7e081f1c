"""Search, access, store, context and streaming operators on small tables."""

import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom import models
from recordloom.operators import acl, context, filters, hybrid, lexical, store, vector
from recordloom.plans import monitor
from recordloom.sources import extract, scans
from recordloom.streaming import sync, windows


def test_vector_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.0]), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = [(r.id, round(r.score, 3)) for r in vector.top_k(df, "id", "v", [1.0, 0.0], 10, -2).collect()]
    assert [g for g in got if g[0] != 7] == [(1, 1.0), (6, 1.0), (2, 0.0)]
    assert [r.id for r in vector.top_k(df, "id", "v", [1.0, 0.0], 3, 0.5).collect()][:2] == [1, 6]
    batch = vector.batch_top_k(df, "id", "v", [(1, [1.0, 0.0]), (2, [0.0, 1.0])], 1, exclude_same=True).collect()
    assert {(r.query_id, r.id) for r in batch} == {(1, 6), (2, 1)}
    assert vector.top_k(df.limit(0), "id", "v", [1.0, 0.0]).count() == 0
    assert vector.cell_count(5) == 100 and vector.cell_count(10**9) == 5000


def test_probed_cells_against_exact(spark, tmp_path, monkeypatch):
    from recordloom.plans import registry

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(1500)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    shares = []
    for i in range(0, 1500, 150):
        q = rows[i][1]
        monkeypatch.setattr(registry, "_query_vector", lambda *_, q=q: q)
        exact = {r.id for r in vector.top_k(e, "vec_id", "embedding", q, 20, -2.0).collect()}
        shares.append(len(exact & {r[0] for r in registry.queries()["ivf_probe"](spark, str(tmp_path)).collect()}) / 20)
    assert sum(shares) / len(shares) >= 0.9


def test_lexical(spark):
    df = spark.createDataFrame([(1, "Timber cost", "the cost of timber"), (2, "Other", "timber timber"), (3, None, None), (4, "", "")], "id long, title string, body string")
    index = lexical.postings(df, "id", {"title": "A", "body": "B"})
    assert [r.id for r in lexical.search(index, "timber cost").collect()] == [1]
    assert [r.id for r in lexical.search(index, "timber cost", "any").collect()] == [1, 2]
    assert lexical.search(index, "  ").count() == 0
    assert [r.id for r in df.where(lexical.web_query(F.col("body"), '"cost of" -granite or nothing')).collect()] == [1]
    assert [lexical.stem(w) for w in ["caresses", "ponies", "relational", "hopping", "running", "happy", "generalizations"]] == ["caress", "poni", "relat", "hop", "run", "happi", "gener"]


def test_stored_index(spark, tmp_path):
    rows = [(i, f"Valve {i}", "the costs of timber" if i % 3 else "Timber costing", None) for i in range(60)] + [(100, None, "", None), (101, "of the", "and", "x")]
    df = spark.createDataFrame(rows, "id long, title string, body string, term string")
    fields = {"title": "A", "body": "B", "term": "B"}
    for analyzer, q, want in ((lexical.plain_term, "costs timber", 40), (lexical.english_term, "what does the timber cost", 60), (lexical.english_term, "of the", 0), (lexical.plain_term, "valve 7", 1)):
        path = f"{tmp_path}/{analyzer.__name__}-{want}"
        lexical.write_index(df, "id", fields, path, analyzer)
        index = lexical.open_index(spark, path)
        hits = lexical.search(index, q, limit=None, analyzer=analyzer)
        assert hits.count() == want
        fresh = lexical.search(lexical.postings(df, "id", fields, analyzer), q, limit=None, analyzer=analyzer)
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, fresh.collect()))
        if want:
            plan = hits._jdf.queryExecution().toString()
            assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    lexical.write_index(df.limit(0), "id", fields, f"{tmp_path}/none")
    assert lexical.postings(df.limit(0), "id", fields).count() == 0
    assert lexical.open_lengths(spark, f"{tmp_path}/plain_term-40").where("id = 1").first().n_terms == 6


def test_best_per_record_of_a_search_box_query(spark):
    df = spark.createDataFrame([(i, i % 2, "timber " * (i + 1) + ("granite" if i == 5 else "")) for i in range(6)] + [(9, None, None)], "id long, record_uri long, body string")
    got = lexical.web_top_per_record(df, "id", "record_uri", "body", "timber -granite", 2).collect()
    assert {(r.record_uri, r.id) for r in got} == {(0, 4), (0, 2), (1, 3), (1, 1)}
    assert lexical.web_terms('"cost of" -granite or Steel') == ["cost", "of", "steel"]


def test_stored_cells(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(900, None), (901, [1.0]), (902, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    vector.write_cells(df, "id", "v", f"{tmp_path}/c", 10, 5)
    cells = vector.open_cells(spark, f"{tmp_path}/c")
    q = rows[3][1]
    exact = [r.id for r in vector.top_k(df, "id", "v", q, 5).collect()]
    assert [r.id for r in vector.top_k(cells.near(q, 10), "id", "v", q, 5).collect()] == exact
    assert "PartitionFilters: [cell" in cells.near(q)._jdf.queryExecution().toString()
    vector.write_cells(df.limit(0), "id", "v", f"{tmp_path}/none", 10)
    none = vector.open_cells(spark, f"{tmp_path}/none")
    assert vector.top_k(none.near(q), "id", "v", q, 5).count() == 0


def test_ties_are_cut_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500, 0, -1)], "id long, v array<double>")
    assert [r.id for r in vector.top_k(df.coalesce(1), "id", "v", [1.0, 0.0], 3).collect()] == [1, 2, 3]
    batch = next(vector._batch_scores(iter(df.coalesce(1).toArrow().combine_chunks().to_batches()), type("S", (), {"value": ([0], np.array([[1.0, 0.0]]))}), 3, False))
    assert batch.num_rows == 3


def test_staging_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from recordloom import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId, chosen = "yarn", "app", None
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: self.chosen

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    Context.chosen = "hdfs://shared/x/"
    assert session.shared_dir(Session()) == "hdfs://shared/x"


def test_fusion_and_records(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    b = spark.createDataFrame([(2, 4.0), (3, 2.0)], "id long, score double")
    got = {r.id: round(r.score, 4) for r in hybrid.fuse(a, b).collect()}
    assert got == {1: 0.63, 2: 0.65, 3: 0.15} and all(0 <= s <= 1 for s in got.values())
    assert {r.id: round(r.score, 4) for r in hybrid.fuse(a, b.limit(0)).collect()} == {1: 0.63, 2: 0.35}
    h = spark.createDataFrame([(1, 10, 0.5), (2, 10, 0.5), (3, 20, 0.1)], "id long, record_uri long, score double")
    assert {r.id for r in hybrid.best_per_record(h).collect()} == {1, 3}
    one = hybrid.rerank(h.limit(1).withColumn("raw", F.lit(3.0)), "raw", 5).first()
    assert one.rerank_score == 1.0


def test_filters(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 5)), (2, datetime(2024, 1, 2, 9)), (3, None)], "id long, ts timestamp")
    ids = lambda d: {r.id for r in d.collect()}
    assert ids(filters.date_filter(df, "ts", datetime(2024, 1, 1), datetime(2024, 1, 1))) == {1}
    assert ids(filters.date_filter(df, "ts", datetime(2024, 1, 2, 9, 1), None)) == set()
    assert ids(filters.date_filter(df, "ts", datetime(1990, 1, 1), datetime(1990, 1, 2), fallback=True)) == {1, 2, 3}
    bag = spark.createDataFrame([(1, {"k": "V"}), (2, {})], "id long, m map<string,string>")
    assert ids(filters.metadata_filter(bag, {"k": "v"}, "m")) == {1}
    with pytest.raises(ValueError):
        filters.clamp_request(" ", 5, 0.5)
    assert filters.clamp_request("q", 500, -1) == (100, 0.0)


def test_acl_never_leaks(spark):
    rows = spark.createDataFrame([(1, 10, None, "ViewDocument"), (2, 11, 1, "ViewDocument"), (3, 12, 2, "ViewDocument"), (4, 13, 1, "UpdateDocument"), (5, None, None, "ViewDocument")], "id long, record_uri long, acl_group long, permission_type string")
    members = spark.createDataFrame([(1, 100), (2, 200)], "acl_group long, location_id long")
    groups = spark.createDataFrame([(7, 100)], "user_id long, group_id long")
    seen = lambda u: {r.record_uri for r in acl.visible_records(rows, members, groups, u).collect()}
    assert seen(7) == {10, 11} and seen(200) == {10, 12} and seen(999) == {10}
    hits = spark.createDataFrame([(1, 11), (2, 12), (3, 77)], "id long, record_uri long")
    assert {r.record_uri for r in acl.apply_acl(hits, rows, members, groups, 7).collect()} == {11}
    strings = spark.createDataFrame([(1, "Group:A; Location:B,c"), (2, "<Unrestricted>"), (3, None)], "id long, s string")
    assert {(r.kind, r.name) for r in acl.parse_permissions(strings, "id", "s").collect()} == {("group", "A"), ("location", "B"), ("user", "c")}
    assert len(acl.acl_ddl("d")) == 5


def test_search_finds_allowed_hits_below_many_others(spark, tmp_path):
    from recordloom.plans import registry

    q = np.eye(64)[0]
    near, far = (0.99 * q + 0.01 * np.eye(64)[1]).tolist(), (0.6 * q + 0.8 * np.eye(64)[1]).tolist()
    rows = [(i, f"e{i:05}", i, f"cost of timber {i}.pdf", "pdf", q.tolist() if i == 0 else near if i < 1200 else far) for i in range(1205)]
    chunks = spark.createDataFrame(rows, "id long, embedding_id string, record_uri long, record_title string, file_type string, vector array<double>")
    rest = {"chunk_content": "cost of timber", "document_category": "x", "container": "x", "assignee": "x", "entity_type": filters.ENTITY, "record_type": "Document", "file_extension": ".pdf"}
    chunks = chunks.withColumns({k: F.lit(v) for k, v in rest.items()}).withColumn("date_created", F.current_timestamp())
    tables = {
        "record_chunks": chunks,
        "record_acl": spark.range(1205).select(F.col("id").alias("record_uri"), F.when(F.col("id") < 1200, 1).otherwise(2).cast("long").alias("acl_group"), F.lit("ViewDocument").alias("permission_type")),
        "acl_group_members": spark.createDataFrame([(1, 900), (2, 7)], "acl_group long, location_id long"),
        "user_groups": spark.createDataFrame([(5, 7)], "user_id long, group_id long"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = [r.record_uri for r in registry.queries()["search_pipeline"](spark, str(tmp_path)).collect()]
    assert sorted(got) == list(range(1200, 1205))


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1, datetime(2020, 1, 1)), (2, "b", 1, datetime(2020, 1, 1))], "id long, embedding_id string, n int, created_at timestamp")
    new = spark.createDataFrame([(9, "b", 2, datetime(2021, 1, 1)), (10, "c", 2, datetime(2021, 1, 1)), (11, "c", 3, datetime(2022, 1, 1))], old.schema)
    state = store.upsert(old, new)
    got = {r.embedding_id: (r.id, r.n, r.created_at.year) for r in state.collect()}
    assert got == {"a": (1, 1, 2020), "b": (2, 2, 2020), "c": (11, 3, 2022)}
    again = {r.embedding_id: (r.id, r.n) for r in store.upsert(state, new).collect()}
    assert again == {k: v[:2] for k, v in got.items()}
    empty = spark.createDataFrame([], store.CHECKPOINT)
    first = store.checkpoint_or_new(empty, "job", datetime(2024, 1, 1))
    assert first.first().status == "Never Run"
    later = first.withColumn("status", F.lit("Completed")).withColumn("updated_at", F.lit(datetime(2024, 1, 2)))
    assert store.update_checkpoint(first, later).first().status == "Completed"
    store.write_json(spark.createDataFrame([("x", [1.0])], "id string, vector array<float>"), f"file://{tmp_path}/j")
    (tmp_path / "j" / "bad.json").write_text("{not json\n")
    files = spark.createDataFrame([("x", {"document_id": "d1"}), ("y", {"document_id": "d2"}), ("z", {}), ("n", None)], "id string, metadata map<string,string>")
    assert {r.id for r in store.delete_json_document(files, "d1").collect()} == {"y", "z", "n"}
    assert store.read_json(spark, f"file://{tmp_path}/j").where("id is not null").count() == 1


def test_context(spark):
    c = spark.createDataFrame([(i, 1, i, i, 0, "x" * 10) for i in range(10)], "id long, record_uri long, chunk_sequence int, chunk_index int, page_number int, chunk_content string")
    a = c.where("id in (2, 3)")
    near = context.neighbours(a, c, "record_uri", "chunk_sequence")
    assert sorted(r.id for r in near.collect()) == [0, 1, 2, 3, 4, 5] and sorted(r.id for r in near.where("is_anchor").collect()) == [2, 3]
    assert context.budget_prefix(c, ["record_uri"], ["chunk_sequence"], "chunk_content", 35).count() == 3
    assert "RELEVANT" in context.qa_context(a, c).first().context


def test_extract(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿hello".encode("utf-8"))
    (tmp_path / "b.html").write_text("<p>One</p><script>no</script><p>Two</p>")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="s"><si><t>word</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="s"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>41000</v></c><c r="C1" t="b"><v>1</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "e.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Slide text</a:t></a:r></a:p></p:sld>')
    (tmp_path / "f.docx").write_bytes(b"broken")
    (tmp_path / "g.bin").write_bytes(b"1")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in extract.extract_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.txt"][0] == "hello" and got["b.html"][0] == "One\nTwo" and got["c.docx"][0] == "[HEADING] Head\n[TABLE 1]\nx | y"
    assert got["d.xlsx"][0] == "[SHEET 1]\nword | 41000 | TRUE" and got["e.pptx"][0] == "[SLIDE 1]\nSlide text"
    assert got["f.docx"][0] is None and "BadZipFile" in got["f.docx"][1] and "unsupported" in got["g.bin"][1]
    g = spark.createDataFrame([(1, 0.0, 100.0, "He", 10.0, False), (1, 5.0, 100.0, "llo", 10.0, False), (1, 0.0, 80.0, "Big", 20.0, False)], "page int, x double, y double, text string, height double, bold boolean")
    assert [r.text for r in extract.glyph_lines(g).orderBy("line_no").collect()] == ["Hello", "[HEADING] Big"]
    assert extract.blob_metadata(spark, f"file://{tmp_path}").count() == 7


def test_limits_and_types_of_files(spark, tmp_path, monkeypatch):
    def doc(n):
        out = tmp_path / "x.docx"
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body>' + "<w:p><w:r><w:t>p</w:t></w:r></w:p>" * n + "</w:body></w:document>")
        return out.read_bytes()

    assert getattr(extract.read_docx(doc(5)), "cut", None) is None
    monkeypatch.setattr(extract, "MOST_PARAGRAPHS", 3)
    cut = extract.read_docx(doc(5))
    assert cut == "p\np\np" and cut.cut == "cut at the limit of paragraphs"
    (tmp_path / "y.docx").write_bytes(b"%PDF-1.7 no document")
    (tmp_path / "z.doc").write_bytes(b"PK a package named as an old document")
    got = {r.path.rsplit("/", 1)[-1]: r for r in extract.extract_files(spark, f"file://{tmp_path}").collect()}
    assert got["y.docx"].error == "ValueError: content is not of type .docx" and got["z.doc"].error == "ValueError: content is not of type .doc"
    assert "words of an old file" in extract.read_doc("words of an old file, long enough to be read at all, it is hoped".encode("cp1252"))


def test_best_extraction_keeps_headings(spark):
    rows = [
        (1, "simple", "the service of the system is good"), (1, "location", "the service"), (1, "font", "[HEADING] Lost One\nthe\n[HEADING] Service\n[HEADING] Lost Two"), (2, "simple", "a b"), (2, "font", "[HEADING] The Service Of The System"), (3, "simple", None), (3, "font", " "),
        (4, "font", "[HEADING] x"),
    ]
    got = {r.page: r.text for r in extract.best_extraction(spark.createDataFrame(rows, "page int, strategy string, text string"), ["page"]).collect()}
    assert got == {1: "[HEADING] Lost Two\n[HEADING] Lost One\nthe service of the system is good", 2: "[HEADING] The Service Of The System", 3: "", 4: "[HEADING] x"}
    assert extract.wrap_pages(["a", "b"]) == "[PAGE 1]\na\n[END PAGE 1]\n[PAGE 2]\nb\n[END PAGE 2]"


def test_models(spark):
    e = models.HashingEmbedder(8)
    assert e.embed(["a b"]) == e.embed(["a b"])
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: (r.vector is not None, r.embed_error) for r in models.embed_table(df, "t", e).collect()}
    assert got == {1: (True, None), 2: (False, "blank text"), 3: (False, "blank text")}
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert models.with_retry(flaky, sleep=lambda s: None) == "ok"


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.createDataFrame([(i, datetime(2024, 1, 1, i // 10, i % 60), "ab"[i % 2], i % 3, float(i)) for i in range(60)], "event_id long, ts timestamp, event_type string, user_id int, value double")
    ev.write.parquet(f"file://{tmp_path}/ev")
    stream = windows.tumbling(spark.readStream.schema(ev.schema).parquet(f"file://{tmp_path}/ev"), late=None)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumble").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("tumble").collect())) == sorted(map(str, windows.tumbling(ev).collect()))


SOURCE = "record_uri long, title string, container string, assignee string, all_parts string, is_container string, date_created string, date_modified string, file_extension string"


def exported(spark, *rows):
    return spark.createDataFrame([(u, t, "c", "x", "p", "Document File", "01/01/2024 10:00:00", m, ".pdf") for u, t, m in rows], SOURCE)


def fails_on(word):
    class FailsOn(models.HashingEmbedder):
        def embed(self, texts):
            if any(word in t for t in texts):
                raise ValueError("refused")
            return super().embed(texts)

    return FailsOn(8)


def test_sync_job(spark, tmp_path):
    job = sync.SyncJob(spark, "nightly", f"file://{tmp_path}/job", fails_on("bad"), 8)
    bodies = spark.createDataFrame([(1, "one body"), (2, "two body")], "record_uri long, body string")
    clock = iter(datetime(2024, 2, d) for d in range(1, 28)).__next__
    assert job.checkpoint(clock())["status"] == "Never Run" and job.failed_records().count() == 0
    first = exported(spark, (1, "A.pdf", "01/02/2024 10:00:00"), (2, "B.pdf", None), (3, "bad.pdf", "01/02/2024 10:00:00"))
    r = job.run(first, bodies, clock)
    assert r.status == "Completed" and r.counters == {"new": 3, "updated": 0, "unchanged": 0, "processed": 3, "success": 2, "failed": 1} and r.version == 1
    stored = {x.record_uri: x.chunk_content for x in job.store.read().collect()}
    assert set(stored) == {1, 2} and "one body" in stored[1]
    assert [x.record_uri for x in job.failed_records().collect()] == [3] and "refused" in job.failed_records().first().embed_error
    row = job.checkpoint(clock())
    assert (row["status"], row["success"], row["failed"], row["last_sync_date"]) == ("Completed", 2, 1, None)
    # the failed record is tried again, a changed one replaced, an unchanged one left alone
    before = job.store.manifest()
    second = exported(spark, (1, "A new.pdf", "03/02/2024 10:00:00"), (3, "good.pdf", "01/02/2024 10:00:00"))
    r = job.run(second, None, clock)
    assert r.counters["updated"] == 1 and r.counters["new"] == 1 and r.counters["failed"] == 0
    titles = {x.record_uri: x.record_title for x in job.store.read().collect()}
    assert titles == {1: "A new.pdf", 2: "B.pdf", 3: "good.pdf"}
    after = job.store.manifest()
    touched = {x.b for x in spark.createDataFrame([(1,), (3,)], "record_uri long").select(job.store.bucket().alias("b")).collect()}
    assert all(after[k] == before[k] for k in before if k not in touched) and all(after[k] != before.get(k) for k in touched)
    assert job.checkpoint(clock())["last_sync_date"] is not None
    # records modified before the day of the mark are not looked at
    assert job.run(second, None, clock).counters["processed"] == 0
    assert job.run(second, None, clock, stop=lambda: True).status == "Cancelled" and job.checkpoint(clock())["status"] == "Cancelled"
    assert job.run(spark.range(1), None, clock).status == "Failed" and job.checkpoint(clock())["status"] == "Failed"
    version = job.store.version()
    assert job.store.vacuum() > 0 and job.store.read().count() == 3 and job.store.version() == version
    # a second writer of the same version fails
    other = sync.store.BucketStore(spark, f"file://{tmp_path}/job/chunks", 8)
    other.version = lambda n=version: n - 1
    with pytest.raises(RuntimeError):
        other._commit({})
    assert job.run(first.limit(0), None, clock, full=True).counters["processed"] == 0


def test_sync_stream(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    exported(spark, (1, "A.pdf", "01/02/2024 10:00:00"), (2, "B", None)).write.parquet(src)
    job = sync.SyncJob(spark, "stream", f"file://{tmp_path}/job", buckets=4)
    s = sync.Scheduler(lambda every: job.stream(src, SOURCE, f"file://{tmp_path}/cp", lambda: datetime(2024, 2, 1), every=every))
    assert s.trigger()
    s.wait()
    assert job.store.read().select("record_uri").distinct().count() == 2
    exported(spark, (1, "A new.pdf", "03/02/2024 10:00:00")).write.mode("append").parquet(src)
    s.trigger()
    s.wait()
    got = job.store.read()
    assert got.where("record_uri = 1").first().record_title == "A new.pdf" and got.where("record_uri = 2").count() == 1
    assert s.reschedule("1 hour") is False and s.trigger() and s.running and s.reschedule("2 hours") and s.status()["every"] == "2 hours"
    s.pause()
    assert not s.trigger() and s.status()["running"] is False


def test_monitor_and_scans(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 11, 30)), (2, datetime(2023, 12, 31, 13))], "id long, ts timestamp")
    r = monitor.growth(df, "ts", datetime(2024, 1, 1, 12)).first()
    assert (r.total, r.last_24h, r.last_1h) == (2, 2, 1)
    assert monitor.growth(df.limit(0), "ts", datetime(2024, 1, 1)).first().days_to_target is None
    assert scans.search_string(" ") == "number:*"
    assert scans.dummy_embeddings(spark, 3, 4).select(F.size("vector")).first()[0] == 4
    assert scans.page(df, ["id"], 5, 10).count() == 0


def test_registry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_access_by_sets_of_groups(spark):
    """Counts per user equal those of every record by itself, also where one group holds most records."""
    rng = np.random.default_rng(8)
    rows = [(int(u), 1 if rng.random() < 0.4 else int(rng.integers(2, 9)), "ViewDocument") for u in rng.integers(0, 120, 400)] + [(None, 1, "ViewDocument"), (5, None, "ViewDocument"), (6, 1, "Other")]
    members = [(int(g), int(x)) for g, x in zip(rng.integers(1, 9, 30), rng.integers(100, 120, 30))]
    groups = [(int(u), int(x)) for u, x in zip(rng.integers(1, 15, 40), rng.integers(100, 120, 40))]
    reach = {u: {g for g, x in members if x == u or (u, x) in groups} for u, _ in groups}
    want = {u: len({r for r, g, p in rows if r is not None and g in gs and p == "ViewDocument"}) for u, gs in reach.items()}
    got = acl.visible_to_each(spark.createDataFrame(rows, "record_uri long, acl_group long, permission_type string"), spark.createDataFrame(members, "acl_group long, location_id long"), spark.createDataFrame(groups, "user_id long, group_id long"))
    assert {r.user_id: r.records for r in got.collect()} == {u: n for u, n in want.items() if n}
    assert acl.is_in_group(spark.createDataFrame(groups, "user_id long, group_id long"), *groups[0]) and not acl.is_in_group(spark.createDataFrame(groups, "user_id long, group_id long"), 999, 100)


def test_generated_answers_and_corrections(spark):
    class Loud:
        def generate(self, prompt):
            if "boom" in prompt:
                raise ValueError("no")
            return prompt.upper()

    Loud.__module__ = "__main__"  # sent to workers by value
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "boom")], "id long, p string")
    got = {r.id: (r.answer, r.answer_error) for r in models.generate_table(df, "p", Loud()).collect()}
    assert got == {1: ("A", None), 2: (None, "blank prompt"), 3: (None, "blank prompt"), 4: (None, "ValueError: no")}
    bad = "x1y 0a2b " * 20
    texts = spark.createDataFrame([(1, f"{bad}\nboom {bad}"), (2, "good text " * 20), (3, None)], "id long, t string")
    fixed = models.correct_table(texts, "id", "t", Loud(), 200).collect()
    assert [r.id for r in fixed] == [1] and fixed[0].corrected == f"{bad.upper()}\nboom {bad}"
    noise = texts.join(models.correct_table(texts, "id", "t", Loud(), 200), "id", "left")
    from recordloom.functions import text as tx

    assert "X1Y" in noise.where("id = 1").select(tx.clean_noise("t", F.col("corrected"))).first()[0]
    with pytest.raises(KeyError):
        models.LookupEmbedder({"a": [1.0]}, 1).embed(["b"])


def test_rerank_with_a_failing_scorer(spark):
    h = spark.createDataFrame([(i, float(i), "t" * i) for i in range(9)], "id long, score double, t string")

    def fails(q, texts):
        raise OSError

    assert [r.id for r in hybrid.rerank_with(h, "q", "t", fails, 3).collect()] == [8, 7, 6]
    assert [r.id for r in hybrid.rerank_with(h, "q", "t", lambda q, x: [-len(t) for t in x], 3).collect()] == [0, 1, 2]
    assert hybrid.rerank_with(h.limit(0), "q", "t", fails, 3).count() == 0


def test_record_answer(spark):
    rows = [(i, 7, i, i, 0, f"The pump number {i} holds water." if i != 6 else "The boiler makes 40 kilowatts.", [float(i == 3), 1.0]) for i in range(12)] + [(50, 8, 0, 0, 0, "Nothing here.", None)]
    c = spark.createDataFrame(rows, "id long, record_uri long, chunk_sequence int, chunk_index int, page_number int, chunk_content string, vector array<double>")
    index = lexical.postings(c, "id", {"chunk_content": "B"}, lexical.english_term)
    one = context.record_answer(c.where("record_uri = 7"), index, "how many kilowatts", [1.0, 0.0], models.ExtractiveGenerator(), 2).first()
    assert "RELEVANT\nThe boiler" in one.prompt and "Sequence 3" in one.prompt and "kilowatts" in one.answer and one.prompt.endswith("Question: how many kilowatts")
    other = context.record_answer(c.where("record_uri = 8"), index, "how many kilowatts", None, models.ExtractiveGenerator()).first()
    assert "Nothing here" in other.prompt


def test_engine(spark, tmp_path):
    from recordloom.engine import Access, Engine

    tables = Access(
        spark.createDataFrame([(1, None, "ViewDocument", "Group:A"), (2, 1, "ViewDocument", "bob"), (3, None, "ViewDocument", None)], "record_uri long, acl_group long, permission_type string, raw_acl_string string").withColumn("id", F.col("record_uri")),
        spark.createDataFrame([(1, 100)], "acl_group long, location_id long"), spark.createDataFrame([(7, 100)], "user_id long, group_id long"),
    )
    e = Engine(spark, f"file://{tmp_path}/engine", access=tables, buckets=4)
    with pytest.raises(LookupError):
        e.chunks()
    now = datetime(2026, 1, 28)
    clock = iter(datetime(2026, 1, d) for d in range(1, 28)).__next__
    bodies = spark.createDataFrame([(1, "The pump needs 40 kilowatts."), (2, "The secret boiler needs steam."), (3, "A ledger.")], "record_uri long, body string")
    r = e.ingest(exported(spark, (1, "Pump.pdf", "01/02/2024 10:00:00"), (2, "Boiler.pdf", "01/02/2024 10:00:00"), (3, "Ledger.pdf", "01/02/2024 10:00:00")), bodies, clock)
    assert r.status == "Completed" and e.statistics().first().records == 3
    find = lambda q, u=7: [x.record_uri for x in e.search(q, now, min_score=0.0, user=u).collect()]
    assert find("secret boiler")[0] == 2 and 2 not in find("secret boiler", 8) and find("kilowatts of the pump")[0] == 1
    # a replaced chunk is not found by its old words
    e.ingest(exported(spark, (1, "Pump.pdf", "03/02/2024 10:00:00")), spark.createDataFrame([(1, "The pump was sold.")], "record_uri long, body string"), clock, full=True)
    words = lambda q: [x.id for x in lexical.search(e.index(), q, analyzer=lexical.english_term).collect()]
    assert not words("kilowatts") and len(words("sold pump")) == 1 and len(words("boiler")) == 1
    assert e.compact() == 2 and e.compact() == 1 and len(words("sold pump")) == 1 and not words("kilowatts")
    assert "sold" in e.ask(1, "what was sold").first().answer and "sold" in e.summary_context(1).first().context
    assert "sold" in e.answer(e.search("pump sold", now, min_score=0.0, user=7), "what was sold?")
    got = {x.record_uri: (x.deleted > 0, x.status) for x in e.delete(spark.createDataFrame([(2,), (99,)], "record_uri long")).collect()}
    assert got == {2: (True, "deleted"), 99: (False, "not_found")} and not words("boiler") and e.statistics().first().records == 2
    assert e.records(exported(spark, (1, "Pump.pdf", None)), "pump").count() == 1 and e.access_report()[0].first().acl_rows == 3


def test_archive_and_blobs(spark, tmp_path):
    rows = [(1, datetime(2020, 5, 1)), (2, datetime(2023, 5, 1)), (3, None), (4, datetime(2019, 1, 1))]
    df = spark.createDataFrame(rows, "id long, created_at timestamp")
    cold = f"file://{tmp_path}/cold"
    for _ in range(2):
        hot = store.archive(df, datetime(2024, 1, 1), cold)
        assert {r.id for r in hot.collect()} == {2, 3} and {(r.id, str(r.month)) for r in spark.read.parquet(cold).collect()} == {(1, "2020-05"), (4, "2019-01")}
    b = extract.Blobs(spark, f"file://{tmp_path}/blobs")
    assert b.save("a/x.bin", b"\x00\xff1") and b.save("a/x.bin", b"two") and b.read("a/x.bin") == b"two" and b.exists("a/x.bin")
    assert extract.blob_metadata(spark, f"file://{tmp_path}/blobs").count() == 1
    assert b.remove("a/x.bin") and not b.remove("a/x.bin") and not b.exists("a/x.bin")
    with pytest.raises(FileNotFoundError):
        b.read("nothing")
    with pytest.raises(ValueError):
        b.save("../out", b"x")


def test_bundle():
    import io

    z = zipfile.ZipFile(io.BytesIO(extract.bundle([("a.txt", b"1"), ("A.txt", b"2"), ("b/c?.pdf", b"3"), ("..", b"4"), ("noext", b"5"), ("noext", b"6"), ("", b"7")])))
    assert {n: z.read(n) for n in z.namelist()} == {"a.txt": b"1", "A (2).txt": b"2", "b_c_.pdf": b"3", "file": b"4", "noext": b"5", "noext (2)": b"6", "file (2)": b"7"}
