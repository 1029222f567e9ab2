"""Conversation repair, filter interactions and toxicity: against brute force, SQL and held-out texts; and on awkward tables."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import conversation_repair as R
from tessera.llm import filter_audit, queries, toxicity

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def duck(sql):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con.execute(sql).fetchdf()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    assert rows(a) == rows(b)


# ---------------------------------------------------------------- 11
def least_edits(rows):
    """(cost, edits) over rows (initial, must go, truncated), letter by letter: every edit string that may be the least."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def grow(best):
        for _ in range(3):  # insertions
            for (state, cost, edits) in list(best):
                for to in "ua":
                    if (state, to) in follow and not edits.endswith("III"):
                        best.add((follow[state, to], cost + 5, edits + "I"))
        return best

    found = {("", 0, "")}
    for initial, gone, cut in rows:
        now = set()
        for state, cost, edits in grow(set(found)):
            now.add((state, cost + 2, edits + "D"))
            if not gone:
                if (state, initial) in follow:
                    now.add((follow[state, initial], cost + 5 * cut, edits + "K"))
                for to in "ua":
                    if (state, to) in follow:
                        now.add((follow[state, to], cost + 1 + 5 * cut, edits + "R"))
        found = {min((x for x in now if x[0] == q), key=lambda x: x[1:]) for q in {x[0] for x in now}}
    return min((cost, edits) for state, cost, edits in grow(set(found)) if state in ("", "a"))


def brute_repair(rows):
    """The contract's columns of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest()))
    seen, faults, plain = set(), [], []
    for _, role, text in rows:
        words = WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        plain.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, edits = least_edits(plain)
    out, turn, at = [], 0, 0
    for e in edits:
        role, text = rows[at][1:] if e != "I" else (None, "")
        at += e != "I"
        if e != "D":
            out.append(f"{role if e == 'K' else ('user', 'assistant')[turn]}:{text}")
            turn ^= not (e == "K" and role[:1] == "s")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (gaps, *(faults.count(f) for f in R.FAULTS), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (x if x is not None else " " for x in (role, text))
        crc = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if crc == 1 else re.sub("[.!?]", "", text) if crc == 2 else text
        yield from [(conv, turn, "user" if crc == 4 else role, text)] * (0 if crc == 0 else 2 if crc == 3 else 1)


def random_turns(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    texts = ["yes.", "no", "what?\n", " \n", "", None, "end! ", "é.", "a b"]
    return [(rng.choice([None, k // 2, k, k, k + rng.randint(0, 3)]), rng.choice(roles if rng.random() < 0.4 else roles[:2]), rng.choice(texts) if rng.random() < 0.5 else f"text {k}.") for k in range(n)]


def test_op11_automaton_and_joined_stretches():
    rng, auto = random.Random(1), R.Automaton()
    for _ in range(3000):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
        symbols = bytes(R.symbol(R.BLANK if g else R.TRUNCATED if t else R.NONE, "suax".index(i)) for i, g, t in rows)
        best = least_edits(rows)
        assert auto.solve(symbols) == best
        if rows:
            cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(3))})
            cost, edits = R.joined([auto.between(symbols[a:b]) for a, b in itertools.pairwise(cuts)])
            assert (cost, "".join(edits)) == best
            assert [sum(e != "I" for e in part) for part in edits] == [b - a for a, b in itertools.pairwise(cuts)]


def test_op11_table_stays_small():
    rng, auto = random.Random(2), R.Automaton()
    for _ in range(40):
        auto.between(bytes(rng.choice([rng.randint(0, 8), 3, 5]) for _ in range(3000)))
    before = len(auto.vectors)
    assert before < 150
    auto.solve(bytes([3, 5] * 50_000))  # a regular conversation: what never starts it falls out of reach
    assert len(auto.vectors) == before


@pytest.mark.parametrize("parts", [1, 6])
def test_op11_rows_equal_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(conv, *t) for conv in [*range(30), None] for t in random_turns(rng, rng.randint(1, 12))]
    rows += [(99, *t) for t in random_turns(rng, 150)]  # over several parts
    rows += [(98, 1, "user", "the same again.")] * 40 + [(98, 2, "user", "the same again.")] * 40
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, TURNS)
    for name in ("k", "pos", "part", "audit", "kind", "first", "sha", "copy", "cost"):
        frame = frame.withColumn(name, F.lit(1))
    got = {r["conv_id"]: tuple(r)[1:] for r in R.audit(frame, parts).collect()}
    spoilt = list(brute_damage(rows))
    want = {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in spoilt if r[0] == conv]
        want[conv] = brute_repair(own) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == want


def test_op11_repaired_turns(spark):
    rows = [(1, 0, "system", "be kind."), (1, 1, "user", "hi."), (1, 2, "user", "hi."), (1, 3, "bot", "hello."), (1, 5, "user", "bye")]
    report, edits = R.repair(spark.createDataFrame(rows, TURNS), 2)
    assert [tuple(r)[1:] for r in edits.collect()] == [("K", "system", "be kind."), ("K", "user", "hi."), ("D", None, None), ("R", "assistant", "hello."), ("D", None, None)]
    r = report.first()
    assert (r["gaps"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (1, 1, 1, 3, 5, "KKDRD")


def test_op11_empty(spark):
    assert R.audit(spark.createDataFrame([], TURNS)).collect() == []


@data
def test_op11_sql(spark):
    same(queries.queries()["op11_conversation_repair"](spark, SF).toPandas(), duck(queries.oracle_sql()["op11_conversation_repair"]))


# ---------------------------------------------------------------- 12
def brute_failures(text, repeated):
    words = WORD.findall(text)
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), repeated)
    return {c for c, f in zip("ABCDE", fails, strict=True) if f}


def brute_audit(docs, labels):
    """docs: doc_id, text, part; labels: doc_id, quality, toxic."""
    first, out = {}, []
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}
    for part in {p or "" for _, _, p in docs}:
        own = [(i, brute_failures(t or "", i is not None and i > first[t or ""])) for i, t, p in docs if (p or "") == part]
        found, shares = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shares[f] += len(gone)
                found.append((f, part, "".join(order), step, len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)))
        out += [(*r[1:], shares[r[0]]) for r in found]
    return sorted(out)


def test_op12_equals_brute_force(spark):
    rng = random.Random(3)
    long = [" ".join(rng.choice(["ab", "Cd", "EF", "g#", "h"]) + str(rng.randint(0, m)) for _ in range(n)) for n, m in ((99, 900), (100, 900), (140, 30), (300, 5), (120, 10**6))]
    texts = [None, "", " \n", "X" * 30, "é É ü" * 40, "a|b", *long]
    docs = [(rng.choice([k, k, k // 3, None]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(120)]
    labels = [(rng.choice([rng.randint(0, 120), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    frame = spark.createDataFrame([(i, t, p, "s", 1) for i, t, p in docs], DOCS)
    for name in ("part", "mask", "digest", "first", "good", "toxic", "n"):
        frame = frame.withColumn(name, F.lit(1))
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)


def test_op12_polynomial():
    rng = random.Random(4)
    for n in (1, 3, 4):
        counts = {m: rng.randint(0, 9) for m in range(1 << n)}
        r = filter_audit.polynomial(counts, n)
        for chosen in range(1 << n):
            assert filter_audit.corner(r, chosen) == sum(c for m, c in counts.items() if m & chosen)
        for i in range(n):
            removed = 0
            for order in itertools.permutations(range(n)):
                before = sum(1 << k for k in order[: order.index(i)])
                removed += filter_audit.corner(r, before | 1 << i) - filter_audit.corner(r, before)
            assert filter_audit.shapley(r, i) * math.factorial(n) == removed


def test_op12_empty(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


@data
def test_op12_sql(spark):
    same(queries.queries()["op12_filter_audit"](spark, SF).toPandas(), duck(queries.oracle_sql()["op12_filter_audit"]))


# ---------------------------------------------------------------- 13
def slots(text):
    buf, off = C.text_block(pa.array([text]))
    return toxicity.once(*toxicity.term_slots(buf, off))[0]


def scores(machine, texts):
    return machine.score(*C.text_block(pa.array(texts)))


def machine(texts, toxic):
    return toxicity.Machine([slots(t) for t in texts], np.array(toxic))


def filler(rng):
    return " ".join(rng.choice(["the", "of", "lake", "stone", "river", "and", "runs", "cold", "deep", "wind"]) + rng.choice(["", "s", "ed", "."]) for _ in range(rng.randint(5, 60)))


def planted(rng, *words):
    text = filler(rng).split()
    for w in words:
        text.insert(rng.randint(0, len(text)), w)
    return " ".join(text)


def test_op13_pairs_say_what_no_sum_can():
    """Either word is harmless beside the wrong partner, and neither partner tells anything alone."""
    rng = random.Random(5)

    def sample(n):
        out = []
        for _ in range(n):
            words, toxic = rng.choice([(("vermin", "people"), 1), (("pests", "crops"), 0), (("vermin", "crops"), 0), (("pests", "people"), 0), ((), 0), ((), 0), (("crushed", "garlic"), 0), (("crushed", "nation"), 1), (("grated", "nation"), 0)])
            out.append((planted(rng, *words), toxic))
        return out

    train, test = sample(1500), sample(300)
    m = machine(*zip(*train, strict=True))
    assert (m.v != 0).any()
    right = (scores(m, [t for t, _ in test]) >= 0.5) == np.array([y for _, y in test])
    assert right.mean() > 0.97


def test_op13_long_texts_and_unseen_forms():
    rng = random.Random(6)
    bad = ["zwackoria", "zwackelt", "zwackung", "zwackisch"]
    train = [(planted(rng, rng.choice(bad)), 1) for _ in range(150)] + [(filler(rng), 0) for _ in range(600)]
    m = machine(*zip(*train, strict=True))
    long = " ".join(filler(rng) for _ in range(400))
    got = scores(m, [planted(rng, "zwackenden"), filler(rng), long, long + " zwackoria " + long, "", None, "ZWACKUNG!"])
    assert (got >= 0.5).tolist() == [True, False, False, True, False, False, True]


def test_op13_score_by_hand():
    rng = random.Random(7)
    texts = [planted(rng, *(["mudhead", "fools"] if k % 3 == 0 else [])) for k in range(200)]
    m = machine(texts, [int(k % 3 == 0) for k in range(200)])
    own = {s: c for s, c in ((s, m.column[s]) for s in slots("fools, you Mudhead")) if c >= 0}
    z = m.b + sum(float(m.w[c]) for c in own.values())
    z += sum(float(np.dot(m.v[a].astype(float), m.v[b])) for a, b in itertools.combinations(own.values(), 2))
    assert own and abs(scores(m, ["fools, you Mudhead"])[0] - 1 / (1 + math.exp(-z))) < 1e-6


def test_op13_terms():
    text = "Idiot! cafés x,4567"
    want = {w for w in ("idiot", "cafés", "x", "4567")}
    n = sum(1 + sum(max(0, len(w.encode()) - k + 1) for k in (4, 5)) for w in want)
    buf, off = C.text_block(pa.array([text, None, "", text]))
    slot, row = toxicity.term_slots(buf, off)
    assert np.bincount(row, minlength=4).tolist() == [n, 0, 0, n]
    assert set(slot[row == 0]) == set(slot[row == 3]) == set(slots("4567 CAFéS; x idiot"))


def test_op13_held_out_and_awkward_rows(spark):
    rng = random.Random(8)
    docs = [(k, planted(rng, *(["idiots", "all"] if k % 4 == 0 else []))) for k in range(800)] + [(None, "idiots all"), (None, None), (5, "another text of one id"), (900, ""), (901, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS)
    for name in ("score", "slots", "chosen", "toxic", "predicted"):
        frame = frame.withColumn(name, F.lit(1))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(800)] + [(None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = toxicity.classify(frame, labels).collect()
    assert len(got) == len(docs) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
        if i is not None and i != 5:
            assert r["predicted"] == int(i < 800 and i % 4 == 0)
    assert sorted(r["predicted"] for r in got if r["doc_id"] is None) == [0, 1]


def test_op13_never_learns_from_the_held_out_fold(spark):
    """A word that only held-out rows call toxic stays harmless."""
    rng = random.Random(9)
    out = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    docs = spark.createDataFrame([(k, planted(rng, *(["gremlin"] if k in out else ["ogres"] if k % 3 == 0 else [])), "en", "s", 1) for k in range(600)], DOCS)
    labels = spark.createDataFrame([(k, 1, int(k in out or k % 3 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, labels).collect()}
    assert not any(got[k] for k in out) and all(got[k] for k in range(0, 600, 3) if k not in out)


def test_op13_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (2, None, None, None, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.classify(docs, none).collect()] == [0.25, 0.25]
    assert toxicity.classify(docs.limit(0), none).collect() == []
