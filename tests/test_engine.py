import json
import math
import os
import sqlite3
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.engine import Engine, concept_embeddings
from tessera.operators import convention, evaluate, filters, fusion, lexical, reading, vector
from tessera.sources import config, files
from tessera.sources.snapshots import SnapshotStore, appended_vectors, write_text
from tessera.streaming import sync


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def project(tmp_path):
    root = str(tmp_path)
    put(root, "docs/guides/backup.md", "---\ntype: guide\ntags: [Ops, ' Disk ']\nstatus: current\n---\n# Backup\n\nHow to copy disks.\n\n## Restore\n\nRestoring a database from tape takes hours.\n")
    put(root, "docs/guides/old.md", "---\ntype: guide\nstatus: draft\n---\n# Old\n\nRestoring nothing.\n")
    put(root, "docs/api.md", "# API\n\nEndpoints and calls.\n\n## Errors\n\nError codes of the database calls.\n")
    put(root, "docs/latin.md", b"# Caf\xe9\n\nUna p\xe1gina sobre bases de datos.\n")
    put(root, "docs/empty.md", "")
    put(root, "docs/.hidden/x.md", "# no")
    put(root, "docs/_draft.MD", "# Under\n\nscore\n")
    put(root, "docs/bad.md", "---\ntags: 3\n---\n# Bad\n\nx\n")
    put(root, config.CONFIG_FILE, json.dumps({"convention": {"excludedStatuses": ["draft"]}, "search": {"k": 0}, "chunk": {"maxTok": 1}}))
    return root


EMBED = concept_embeddings([["databas", "dato"], ["disk", "tape"], ["error"]])


def test_rebuild_search_read(spark, project):
    engine = Engine(spark, project, EMBED)
    assert len(engine.warnings) == 2 and engine.config.k == 5
    report = engine.index()
    assert report.documents == 5 and report.mode == "hybrid"
    assert {p for p, _ in report.skipped} == {"empty.md", "bad.md"} and report.notices == [("latin.md", "windows-1252")]
    found = json.loads(engine.search_docs("restoring database"))
    assert found["mode"] == "hybrid" and found["results"][0]["path"] == "guides/backup.md"
    assert all(r["path"] != "guides/old.md" for r in found["results"])
    everything = json.loads(engine.search_docs("restoring", include_excluded=True, lexical=True))
    assert {r["path"] for r in everything["results"]} == {"guides/backup.md", "guides/old.md"}
    assert json.loads(engine.search_docs("restoring", type="adr", lexical=True))["noMatchReason"].startswith('type: "adr" is not in use')
    assert engine.read_doc("docs/guides/backup.md").count("# Backup") == 1
    assert "tape" in engine.read_doc("guides/backup.md", "réstore")
    assert "Available sections" in engine.read_doc("api.md", "zzz") and "Closest paths" in engine.read_doc("apis.md")
    text = engine.docs_overview()
    assert text.startswith("Indexed documents: 5\nBy type: guide (2)\nBy module: guides (2)") and "Config:" in text
    path, _, wrote = engine.index_md()
    assert wrote and not engine.index_md()[2] and os.path.exists(path)
    quality = engine.evaluate([{"question": "error codes", "expected": "api.md"}, {"question": "zebra", "expected": "api.md"}])
    assert quality["lexical"]["recall_at_k"] == 0.5 and set(quality) == {"lexical", "hybrid"}


def test_sync_is_the_rebuild_of_what_changed(spark, project):
    engine = Engine(spark, project, EMBED)
    engine.index()
    os.remove(os.path.join(project, "docs/api.md"))
    put(project, "docs/new.md", "# New\n\nFresh text on tapes.\n")
    put(project, "docs/guides/old.md", "---\ntags: 7\n---\n# Old\n\nnow rejected\n")
    report = engine.sync()
    assert report.indexed == ["new.md"] and report.deleted == ["api.md"] and report.unchanged == 3
    told = lambda: standing(engine.store)
    after = told()
    assert len(engine.store.current().segments) == 2
    engine.store.compact()
    assert len(engine.store.current().segments) == 1 and after == told()
    engine.index()
    assert after == told()
    engine.store.vacuum()
    assert engine.store.read("documents").count() == 4


def standing(store):
    """Everything an index answers from."""
    inverted = store.inverted()
    frames = {n: store.read(n) for n in ("documents", "chunks", "vectors")} | {"counts": store.counts(), "postings": inverted.postings()}
    frames["df"] = lexical.document_frequency(inverted.blocks).where("df > 0")
    frames["totals"] = inverted.totals.agg(F.sum("n_chunks"), F.sum("n_tokens"))
    return {n: sorted(map(str, f.collect())) for n, f in frames.items()}


def test_cli(spark, project, capsys):
    assert cli.main(["-C", project, "index"]) == 0 and cli.main(["-C", project, "search", "database", "-k", "1"]) == 0
    assert '"mode": "lexical"' in capsys.readouterr().out
    put(project, "gold.yaml", "- pregunta: error codes\n  esperado: api.md\n")
    assert cli.main(["-C", project, "eval", os.path.join(project, "gold.yaml")]) == 0
    put(project, "bad.yaml", "- x: 1\n")
    assert cli.main(["-C", project, "eval", os.path.join(project, "bad.yaml")]) == 2
    put(project, config.CONFIG_FILE, "{")
    assert cli.main(["-C", project, "overview"]) == 1


def test_roots(tmp_path):
    root = str(tmp_path)
    assert [r.alias for r in config.roots(root, ["a"])] == [""] and [r.alias for r in config.roots(root, ["a", "b/c"])] == ["a", "c"]
    for bad in ([], "x", ["a", "a"], ["a", "a/b"], ["x/a", "y/a"], ["/"], [""]):
        with pytest.raises(ValueError):
            config.roots(root, bad)


def test_scan_of_several_roots(spark, tmp_path):
    put(str(tmp_path), "one/x/a.md", "# a")
    put(str(tmp_path), "two/INDEX.md", "# i")
    rows = files.scan(spark, [config.Root(str(tmp_path / "one"), "one"), config.Root(str(tmp_path / "gone"), "gone"), config.Root(str(tmp_path / "two"), "two")], ["INDEX.md"]).collect()
    assert {(r.path, r.error is None) for r in rows} == {("one/x/a.md", True), ("gone", False)}
    with pytest.raises(OSError):
        files.scan(spark, [config.Root(str(tmp_path / "gone"), "gone")])
    assert [r.path for r in files.stored_files(spark, f"file://{tmp_path}/one").collect()] == ["x/a.md"]


def test_listing_is_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """The driver lists the first levels; what lies deeper is listed where it is read, errors included."""
    root = str(tmp_path)
    want = set()
    for i in range(6):
        for path in (f"t{i}.md", f"a{i}/x.MD", f"a{i}/b/c/d/e{i}.md", f"a{i}/b/.h/no.md", f"a{i}/b/_u.md", f"a{i}/b/c/note.txt"):
            put(root, path, f"# {path}")
            want |= {path} if path.lower().endswith(".md") and "/." not in path else set()
    reader = files._Reader(root)
    for folders, depth, listed in ((1, 3, 0), (3, 3, 6), (1000, 1, 6), (1000, 2, 12), (1000, 99, len(want))):
        monkeypatch.setattr(files, "FOLDERS", folders)
        monkeypatch.setattr(files, "DEPTH", depth)
        slices = reader.partitions()
        rows = [r for s in slices for r in reader.read(s)]
        assert sorted(r[0] for r in rows) == sorted(want) and all(r[1] == f"# {r[0]}".encode() and r[2] is None for r in rows)
        assert sum(len(s.files) for s in slices) == listed
    gone = files._Slice(["a0/gone.md"], ["nowhere"], [("bad", "told")])
    assert [(r[0], r[1]) for r in reader.read(gone)] == [("bad", None), ("a0/gone.md", None), ("nowhere", None)]
    monkeypatch.undo()
    assert {r.path for r in files.scan(spark, [config.Root(root, "")]).collect()} == want


def test_bm25_against_fts5(spark):
    texts = ["the cat sat on the mat", "the dog", "cats and dogs and the cat", "Árbol verde", "arbol the the the", "nothing here"]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(content, heading, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    for i, t in enumerate(texts):
        db.execute("insert into f(rowid, content, heading) values (?, ?, ?)", (i, t, f"h{i}"))
    chunks = spark.createDataFrame([(i, f"h{i}", t) for i, t in enumerate(texts)], "chunk_id long, heading string, content string")
    index = lexical.Inverted.of(chunks.withColumn("doc_id", F.col("chunk_id")), 3)
    asked = ["the cat", "the the dog", "arbol", "zzz", "H2 cats"]
    got = lexical.search_lexical(spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), index, 10).collect()
    for q, text in enumerate(asked):
        match = " OR ".join(f'"{t}"' for t in text.split())
        want = db.execute("select rowid, -rank from f where f match ? order by rank, rowid", (match,)).fetchall()
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.chunk_id for r in own] == [w[0] for w in want]
        assert all(math.isclose(r.score, w[1], rel_tol=1e-9, abs_tol=1e-7) for r, w in zip(own, want, strict=True))


def test_fusion_ties_cap_and_limit(spark):
    leg = lambda ids: spark.createDataFrame([(0, c, i + 1) for i, c in enumerate(ids)], "query_id long, chunk_id long, rank int")
    fused = fusion.fuse([leg([1, 2, 3]), leg([3, 4])])
    rows = {r.fused_rank: (r.chunk_id, round(r.score, 6)) for r in fused.collect()}
    assert rows[1] == (3, round(1 / 63 + 1 / 61, 6)) and [rows[i][0] for i in (2, 3, 4)] == [1, 2, 4]
    docs = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8)], "chunk_id long, doc_id long")
    capped = fusion.limited(fusion.cap_per_document(fused.join(docs, "chunk_id")), 2)
    assert [r.chunk_id for r in capped.orderBy("rank").collect()] == [3, 1]


def test_many_equal_vectors_give_k_rows(spark):
    """A vector that very many rows share: no more than k rows a query and block leave the scan, by the smallest ids."""
    vectors = spark.range(5000).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    q = spark.range(3).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    found = vector.knn(q, vectors, 4)
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in found.collect()) == [(i, c, c + 1) for i in range(3) for c in range(4)]
    assert vector.knn(q, vectors.limit(0), 4).count() == vector.knn(q.limit(0), vectors, 4).count() == 0


def test_postfilter_may_underfill(spark):
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)] + [(99, None)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [0.0, 0.0]), (1, None)], "query_id long, embedding array<float>")
    allowed = spark.createDataFrame([(7,), (15,)], "chunk_id long")
    assert [r.chunk_id for r in vector.search_vector(q, vectors, 2, allowed).collect()] == [7]
    assert [r.chunk_id for r in vector.search_vector(q, vectors, 2, allowed, True).orderBy("rank").collect()] == [7, 15]


def test_predicates_and_reasons(spark):
    docs = spark.createDataFrame([(1, "adr", None, None, ["a"]), (2, "api", "m", "draft", []), (3, None, "m", "ok", None)], "doc_id long, type string, module string, status string, tags array<string>")
    ids = lambda f: sorted(r.doc_id for r in docs.where(f.predicate()).collect())
    assert ids(filters.Filters.of(excluded_statuses=["draft"])) == [1, 3] and ids(filters.Filters.of(tags=["A"])) == [1] and ids(filters.Filters.of(type=" ")) == [1, 2, 3]
    known = filters.Facets.of(docs)
    assert known == filters.Facets(("adr", "api"), ("m",), ("a",), ("draft", "ok"))
    f = filters.Filters.of("adr", "m", ["zz"], ["draft"])
    why = filters.explain_empty(f, known)
    assert [(r.field, r.kind, r.asked, r.declared) for r in filters.reasons(f, known)] == [("tags", "unknown", ("zz",), ("a",)), ("status", "denied", ("draft",), ())]
    assert why == 'tags: "zz" is not in use; in use are "a"; status: hidden by the settings are "draft"; include_excluded shows them'
    assert [r.kind for r in filters.reasons(filters.Filters.of("adr", "m"), known)] == ["combined"] and [r.kind for r in filters.reasons(f, filters.Facets())] == ["undeclared"] * 3 and filters.explain_empty(filters.Filters(), known) is None
    relaxed, dropped = filters.without_impossible(f, filters.Facets())
    assert dropped == ["type", "module", "tags"] and not relaxed.any() and filters.dropped_notice(dropped).count("filter left out") == 3
    assert filters.listed(map(str, range(14))).endswith("and 2 more")


def test_strict_convention_collects_all_errors(spark):
    rows = [("a.md", "", "s", {"type": "x"}, None, False), ("b.md", "T", " s ", {"type": "adr", "module": "m", "status": "ok", "owner": " me "}, [" A ", ""], True)]
    df = spark.createDataFrame(rows, "path string, title string, summary string, fields map<string,string>, tags array<string>, tags_ok boolean")
    bad, good = convention.resolved(df, convention.Convention("strict", ("adr",), ("ok",))).orderBy("path").collect()
    assert len(bad.errors) == 5 and bad.errors[0] == "type: x is none of adr"
    assert good.errors == [] and good.owner == "me" and good.tags == ["a"] and good.summary == "s"
    loose = convention.resolved(df, convention.Convention(), ()).orderBy("path").first()
    assert loose.errors == [convention.TAGS_ERROR] and loose.title == "A"
    order = convention.index_order(convention.Convention("strict", ("b", "a")))
    typed = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", None), ("É", "b"), ("f", "b")], "path string, type string")
    assert [r.path for r in typed.orderBy(*order).collect()] == ["z", "É", "f", "y", "x"]


def test_metrics(spark):
    o = spark.createDataFrame([(1,), (3,), (None,), (9,)], "rank int")
    s = evaluate.summary(o, 5).first()
    assert (s.cases, s.recall_at_k, s.failures) == (4, 0.5, 2) and math.isclose(s.mrr, (1 + 1 / 3 + 1 / 9) / 4)
    assert tuple(evaluate.summary(o.limit(0), 5).first()) == (0, 0.0, 0.0, 0)


def test_diff_and_protection(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "3")], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("d/x", "4"), ("e", "5"), ("dd", "6")], "path string, hash string")
    states = sync.diff(new, old)
    assert {r.path: r.state for r in states.collect()} == {"a": "same", "b": "changed", "n": "new", "d/x": "deleted", "e": "deleted", "dd": "deleted"}
    unreadable = spark.createDataFrame([("d",), ("x/y",)], "path string")
    assert sorted(r.path for r in sync.deletable(states, unreadable).collect()) == ["dd", "e"]
    assert sorted(r.path for r in sync.deletable(states, unreadable.limit(0)).collect()) == ["d/x", "dd", "e"]


def test_scheduler_throttles_and_shares_a_pass():
    now, runs, gate = [0.0], [], threading.Event()

    def run():
        runs.append(1)
        gate.wait(5)
        if len(runs) == 2:
            raise RuntimeError("x")
        return sync.SyncReport(unchanged=len(runs))

    s = sync.Scheduler(run, 30, lambda: now[0])
    threads = [s.startup(), *(threading.Thread(target=s.maybe_sync) for _ in range(3))]
    for t in threads[1:]:
        t.start()
    gate.set()
    for t in threads:
        t.join()
    assert len(runs) == 1 and s.maybe_sync().unchanged == 1 and len(runs) == 1
    now[0] = 31
    s.maybe_sync()
    assert len(runs) == 2 and s.error and s.report.unchanged == 1
    now[0] = 40
    s.maybe_sync()
    assert len(runs) == 2  # a failure counts as a pass


def test_store_and_text_sink(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "ix"))
    assert store.current() is None and not store.has_vectors() and store.read("chunks").count() == 0
    v = spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<float>")
    store.write(vectors=v)
    assert store.has_vectors() and store.current().number == 1
    with pytest.raises(ValueError):
        appended_vectors(v, v)
    path = str(tmp_path / "t.md")
    assert write_text(path, "a\nb") and not write_text(path, "a\r\nb") and write_text(path, "c")


def test_odd_taxonomy_keys(spark):
    docs = spark.createDataFrame([("__proto__", "constructor"), ("__proto__", None), ("", " ")], "type string, module string")
    assert {(r.field, r.value, r.n) for r in reading.counts(docs).collect()} == {("type", "__proto__", 2), ("module", "constructor", 1), ("type", "", 1), ("module", " ", 1)}


def test_stream_of_notices_runs_passes(spark, tmp_path):
    src, runs = str(tmp_path / "n"), []
    spark.range(3).write.json(src)
    q = sync.stream_sync(spark.readStream.schema("id long").json(src), lambda: runs.append(1), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert runs == [1]


def test_throttled_passes_keep_the_floor_over_a_restart(spark, tmp_path):
    """One pass at once, one for all that came within the floor, and the clock outlives the stream; failures count."""
    src, ck, at, floor = str(tmp_path / "n"), str(tmp_path / "ck"), [], 6.0
    spark.range(5).write.json(src)

    def run():
        at.append(passes.last / 1000)
        if len(at) == 2:
            raise RuntimeError("no luck")
        return sync.SyncReport(unchanged=len(at))

    def until(n):
        end = time.time() + 60
        while len(at) < n and time.time() < end:
            time.sleep(0.1)
        time.sleep(3)  # its batch is committed before the stream is stopped
        assert len(at) == n

    notices = spark.readStream.schema("id long").json(src)
    passes = sync.ThrottledPasses(notices, run, floor)
    query = passes.start(ck, "200 milliseconds")
    until(1)
    for _ in range(2):
        spark.range(3).write.mode("append").json(src)
    until(2)
    query.stop()
    assert at[1] - at[0] >= floor and isinstance(passes.error, RuntimeError)
    spark.range(3).write.mode("append").json(src)
    passes = sync.ThrottledPasses(notices, run, floor)
    query = passes.start(ck, "200 milliseconds")
    until(3)
    query.stop()
    assert at[2] - at[1] >= floor  # the failed pass counts, and so does the time before the restart
