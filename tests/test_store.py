"""The index on disk, passes over it, and providers of embeddings that fail."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine, concept_embeddings
from tessera.operators import lexical, vector
from tessera.plans import search
from tessera.sources import config
from tessera.sources.embeddings import Model, Remembered, Unavailable
from tessera.sources.snapshots import Conflict, SnapshotStore
from test_engine import put, standing

WORDS = "lake stone river wind cold deep runs under bridge north gate hall iron lamp road field".split()


def text(rng, n=30):
    return f"# {rng.choice(WORDS).title()}\n\n" + " ".join(rng.choice(WORDS) for _ in range(n)) + ".\n\n## More\n\n" + " ".join(rng.choice(WORDS) for _ in range(n)) + ".\n"


def corpus(root, n=12):
    rng = random.Random(1)
    for i in range(n):
        put(root, f"docs/m{i % 3}/d{i}.md", f"---\ntype: {'guide' if i % 2 else 'adr'}\ntags: [T{i % 4}]\n---\n" + text(rng))
    put(root, config.CONFIG_FILE, json.dumps({}))
    return root


# ---------------------------------------------------------------- versions
def test_a_small_pass_writes_little(spark, tmp_path):
    rng = random.Random(2)
    chunk = lambda i, rng: (i, i, f"h{i}", " ".join(rng.choice(WORDS) + str(rng.randint(0, 3000)) for _ in range(400)), 0)
    frames = lambda ids, rng: (
        spark.createDataFrame([(i, f"d/{i}.md", "t", "s", "guide", None, None, None, ["a"], None, "x") for i in ids], "doc_id long, path string, title string, summary string, type string, module string, status string, owner string, tags array<string>, updated string, hash string"),
        spark.createDataFrame([chunk(i, rng) for i in ids], "chunk_id long, doc_id long, heading string, content string, position int"),
    )
    store = SnapshotStore(spark, str(tmp_path / "ix"))
    documents, chunks = frames(range(1000), rng)
    base = store.write(documents=documents, chunks=chunks)
    from tessera.sources.snapshots import counted, of_generation

    ids = rng.sample(range(1000), 10)
    new_documents, new_chunks = frames(ids, rng)
    stale = store.read("chunks").join(new_documents.select("doc_id"), "doc_id", "left_semi")
    minus, less = lexical.withdrawn(stale, base.parts, 2)
    own = {
        "documents": new_documents,
        "chunks": new_chunks,
        "blocks": lexical.blocks(new_chunks, base.parts, 2).unionByName(minus),
        "totals": lexical.totals(new_chunks, base.parts, 2).unionByName(less),
        "gone": stale.select(F.lit(0).alias("part"), "doc_id", "chunk_id"),
        "counts": counted(new_documents).unionByName(counted(store.read("documents").join(new_documents.select("doc_id"), "doc_id", "left_semi"), -1)),
    }
    segment = store.segment(**{k: of_generation(v.coalesce(1), 2) for k, v in own.items()})
    store.append(base, segment)
    assert store.size(segment) < 0.05 * store.size(base.segments[0])
    assert store.read("documents").count() == 1000 and {r.value: r.n for r in store.counts().collect() if r.field != "documents"} == {"guide": 1000, "a": 1000}
    whole = lexical.Inverted.of(store.read("chunks"), 3)
    asked = spark.createDataFrame([(i, chunk(i, random.Random(i))[3]) for i in range(4)], "query_id long, text string")
    got, want = (sorted(map(tuple, lexical.search_lexical(asked, ix, 20).collect())) for ix in (store.inverted(), whole))
    assert got == want and len(got) == 80


def test_of_two_passes_none_is_lost(spark, tmp_path, monkeypatch):
    root = corpus(str(tmp_path))
    one, two = Engine(spark, root), Engine(spark, root)
    one.index()
    put(root, "docs/m0/a.md", text(random.Random(3)))
    first, went = one.store.append, threading.Event()

    def overtaken(base, name):
        if not went.is_set():  # between this pass's reading and its commit the other one comes through
            went.set()
            put(root, "docs/m1/b.md", text(random.Random(4)))
            os.remove(os.path.join(root, "docs/m1/d1.md"))
            two.sync()
        return first(base, name)

    monkeypatch.setattr(one.store, "append", overtaken)
    one.sync()
    paths = {r.path for r in one.store.read("documents").collect()}
    assert {"m0/a.md", "m1/b.md"} <= paths and "m1/d1.md" not in paths
    after = standing(one.store)
    one.index()
    assert standing(one.store) == after


def test_a_version_is_created_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "ix"))
    base = store.append(None, store.segment())
    store.append(base, store.segment())
    with pytest.raises(Conflict):
        store.append(base, store.segment())
    assert store.current().number == 2 and len(store.current().segments) == 2


def test_a_pinned_store_sees_one_version(spark, tmp_path):
    engine = Engine(spark, corpus(str(tmp_path), 4))
    engine.index()
    before = engine.store.pinned()
    os.remove(os.path.join(str(tmp_path), "docs/m0/d0.md"))
    engine.sync()
    assert before.read("documents").count() == 4 and engine.store.read("documents").count() == 3
    assert search.Index.of(before).counts.where("field = 'documents'").first()["n"] == 4


def test_passes_compact_and_a_pass_without_changes_writes_nothing(spark, tmp_path, monkeypatch):
    from tessera.streaming import sync as module

    monkeypatch.setattr(module, "MAX_SEGMENTS", 2)
    engine = Engine(spark, corpus(str(tmp_path), 5))
    engine.index()
    for k in range(2):
        put(str(tmp_path), f"docs/m0/x{k}.md", text(random.Random(k)))
        engine.sync()
    assert len(engine.store.current().segments) == 1
    number = engine.store.current().number
    assert engine.sync().unchanged == 7 and engine.store.current().number == number


# ---------------------------------------------------------------- scores
def test_rounds_of_parts_give_the_same_rows(spark):
    """All parts at once, or the best bounds first and then what can still enter: the same, filtered too."""
    rng = random.Random(5)
    rows = [(i, i, "", " ".join(rng.choice(WORDS) + ("" if rng.random() < 0.7 else str(rng.randint(0, 40))) for _ in range(rng.randint(1, 40))), 0) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, heading string, content string, position int")
    asked = spark.createDataFrame([(i, rows[i][3]) for i in range(0, 300, 20)] + [(999, "zzz"), (998, "")], "query_id long, text string")
    allowed = chunks.where("chunk_id % 3 <> 0").select("chunk_id", "doc_id")
    index = lexical.Inverted.of(chunks, 12)
    for own in (None, allowed):
        rounds = [sorted(map(tuple, lexical.search_lexical(asked, ix, 7, own, single).collect())) for ix, single in ((index, 1), (index, 99), (lexical.Inverted.of(chunks), 1))]
        assert rounds[0] == rounds[1] == rounds[2] and len(rounds[0]) == 15 * 7


@pytest.mark.parametrize("single", [1, 99])
def test_empty_parts_queries_and_filters(spark, single):
    chunks = spark.createDataFrame([(1, 1, "", "a b c", 0), (2, 2, "", "b c d", 0), (3, 3, "h", None, 0)], "chunk_id long, doc_id long, heading string, content string, position int")
    asked = spark.createDataFrame([(1, "b"), (2, None), (3, "h zz")], "query_id long, text string")
    index = lexical.Inverted.of(chunks, 10)
    rows = lambda *a: sorted((r.query_id, r["rank"], r.chunk_id) for r in lexical.search_lexical(*a, single=single).collect())
    assert rows(asked, index, 5) == [(1, 1, 1), (1, 2, 2), (3, 1, 3)]
    assert rows(asked.limit(0), index, 5) == rows(asked, lexical.Inverted.of(chunks.limit(0), 4), 5) == rows(asked, index, 5, chunks.limit(0)) == []


def test_bounds_leave_parts_out(spark):
    """A part without the rare term cannot reach the rows that have it: its blocks are not scored."""
    rows = [(i, i, "", "common words here" + (" rare" if i % 40 == 0 else ""), 0) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, heading string, content string, position int")
    index = lexical.Inverted.of(chunks, 40)
    asked = spark.createDataFrame([(0, "rare common")], "query_id long, text string")
    got = lexical.search_lexical(asked, index, 5, single=1)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [0, 40, 80, 120, 160]


def test_a_task_sends_the_first_rows_of_all_its_parts(spark, monkeypatch):
    """What a search shuffles of its scores does not grow with the number of parts."""
    rows = [(i, i, "", f"common words {i % 7} here", 0) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, heading string, content string, position int")
    sent, top = [], lexical.top
    monkeypatch.setattr(lexical, "top", lambda scores, *a: sent.append(scores.groupBy("query_id").count()) or top(scores, *a))
    asked = spark.createDataFrame([(i, f"common {i}") for i in range(9)], "query_id long, text string")
    assert lexical.search_lexical(asked, lexical.Inverted.of(chunks, 40), 3).count() == 27
    assert max(r["count"] for r in sent[0].collect()) <= 3 * spark.sparkContext.defaultParallelism


def test_a_task_sends_the_nearest_of_all_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 10)
    sent, top = [], vector.top
    monkeypatch.setattr(vector, "top", lambda found, *a: sent.append(found.groupBy("query_id").count()) or top(found, *a))
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(3)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").coalesce(1)
    got = vector.knn(vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), vectors, 7).collect()
    far = lambda a, b: round(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5, 10)
    for q in range(0, 300, 20):
        assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in sorted((far(rows[q][1], v), i) for i, v in rows)[:7]]
    assert {r["count"] for r in sent[0].collect()} == {7}


def test_vector_searches_build_no_lexical_index(spark):
    from tessera.plans import catalog, corpus as C

    C._STORED.clear()
    assert catalog.queries()["vector_postfilter"](spark, "/root/testdata/sf0.001").count() > 0 and not C._STORED


def test_parts_of_a_pass_grow_with_the_listing(spark, monkeypatch):
    from tessera.plans import catalog

    parts, blocks = [], lexical.blocks
    monkeypatch.setattr(lexical, "parts_of", lambda n: n // 10)
    monkeypatch.setattr(lexical, "blocks", lambda chunks, n, gen=0: parts.append(n) or blocks(chunks, n, gen))
    catalog.queries()["incremental_postings"](spark, "/root/testdata/sf0.001")
    assert parts == [20, 20]


def test_totals_come_from_blocks(spark):
    rows = [(i, i, "h" * (i % 2), None if i % 5 == 0 else "a b a " * i, 0) for i in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, heading string, content string, position int")
    for own in (chunks, chunks.limit(0)):
        sums = own.count(), lexical.totals(own, 1).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        assert [tuple(r)[2:] for r in lexical.totals_of(lexical.blocks(own, 3), own.count()).collect()] == [sums]


@pytest.mark.parametrize("partitions", [4, 7, 64])
def test_ranks_do_not_depend_on_partitions_or_threads(spark, partitions):
    import duckdb

    from tessera.plans import catalog, corpus as C

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        C._STORED.clear()
        got = sorted(tuple(r) for r in catalog.queries()["lexical_bm25"](spark, sf).select("query_id", "rank", "chunk_id", "score").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for threads in (1, 3, 8):
        con.execute(f"set threads = {threads}")
        assert got == sorted(con.execute(f"select query_id, rank, chunk_id, score from ({catalog.oracle_sql()['lexical_bm25']})").fetchall())


# ---------------------------------------------------------------- providers
def calls(path):
    return open(path).read().split() if os.path.exists(path) else []


def broken(path):
    def load():
        def encode(texts):
            with open(path, "a") as f:
                f.write(f"{os.getpid()}\n")
            raise OSError("no weights\nat all")

        return encode

    return load


def test_a_broken_provider_is_called_once_a_process(spark, tmp_path):
    root, log = corpus(str(tmp_path / "p")), str(tmp_path / "calls")
    engine = Engine(spark, root, Model("broken", broken(log)))
    report = engine.index()
    assert report.mode == "lexical" and report.warning.endswith("no weights") and report.documents == 12
    made = calls(log)
    assert made and len(made) == len(set(made))  # at most once a process, though there are many batches
    first, second = (json.loads(engine.search_docs("cold river")) for _ in range(2))
    assert first["mode"] == second["mode"] == "lexical" and first["results"] == second["results"] != []
    assert first["embeddingsWarning"] == "no weights" and "embeddingsWarning" not in second
    put(root, "docs/m0/new.md", text(random.Random(1)))
    assert engine.sync().warning.endswith("no weights")
    other = Engine(spark, root, Model("broken", broken(log)))  # of the same application: it finds what is kept beside the index
    assert json.loads(other.search_docs("cold river"))["mode"] == "lexical"
    assert calls(log) == made


def test_a_model_is_loaded_once_a_process_and_vectors_are_checked(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[len(t), 1.0] for t in texts]

    own = Remembered(spark, Model("lengths", load, batch=3), str(tmp_path / "a"))
    frame = spark.range(40).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    got = {r.chunk_id: r.embedding for r in own.vectors(frame).collect()}
    assert len(got) == 40 and all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in got.values())
    loads = calls(log)
    assert loads and len(loads) == len(set(loads))
    short = Remembered(spark, Model("short", lambda: lambda texts: [[1.0]] * (len(texts) - 1)), str(tmp_path / "b"))
    with pytest.raises(Unavailable, match="for"):
        short.vectors(frame)
    assert short.vector("x") is None and short.told() and short.told() is None
    short.reset()
    assert short.failed() is None
    own.sweep()
    assert own.vector("abc") is not None


def test_a_function_that_raises_is_remembered_too(spark, tmp_path):
    made = []

    def embed(frame):
        made.append(1)
        raise ValueError("gone")

    engine = Engine(spark, corpus(str(tmp_path), 3), embed)
    assert engine.index().mode == "lexical"
    assert json.loads(engine.search_docs("river"))["mode"] == "lexical" and json.loads(engine.search_docs("lake"))["mode"] == "lexical"
    assert engine.evaluate([{"question": "river", "expected": "x"}]).keys() == {"lexical"}
    assert made == [1]


def test_vectors_fill_in_once_a_provider_works(spark, tmp_path):
    root = corpus(str(tmp_path), 4)
    assert Engine(spark, root).index().mode == "lexical"
    engine = Engine(spark, root, concept_embeddings([["river"], ["stone"]]))
    put(root, "docs/m0/new.md", text(random.Random(1)))
    report = engine.sync()
    assert report.embedded > 0 and report.indexed == ["m0/new.md"]
    assert engine.store.read("vectors").count() == engine.store.read("chunks").count()
    assert engine.sync().embedded == 0 and json.loads(engine.search_docs("river"))["mode"] == "hybrid"
