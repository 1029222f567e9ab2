"""Every operator against a brute-force version, SQL, an exact round trip or held-out labels; and on awkward tables."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, components, decontaminate, line_dedup, lm, near_dedup, packing, pipeline, quality_model, quality_rules, queries, suffix_dedup, warc
from tessera.llm import common as C

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def awkward(spark):
    """Nulls, blanks, ties, repeats, a long text, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [None, "", "  \n\n ", "one", "a b c d e f g\nsame line here\nand another one\n", "a b c d e f g\nsame line here\nand another one\n", long, long, "é" * 70, "x y " * 60, "System: hi\nUser: there"]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, None), (5, "other text of one id")]
    df = frame(spark, rows)
    for name in ("row", "t", "k", "c", "words", "lines", "votes", "kept", "keep", "block", "part", "rid", "root", "band", "key", "data", "head", "posterior", "n_words", "score", "bands", "carried"):
        df = df.withColumn(name, F.lit(1))
    return df


def table(spark, name):
    return C.read_table(spark, SF, name)


# ---------------------------------------------------------------- 1
def brute_substrings(docs):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                g = b[p : p + 50]
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [100, 1 << 20])
def test_op1_random_texts(spark, monkeypatch, piece):
    rng = random.Random(piece)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 300))) for _ in range(6)]
    docs = []
    for k in range(50):
        s = "".join(rng.choice(base)[rng.randint(0, 100) :][: rng.randint(20, 200)] for _ in range(rng.randint(0, 5)))
        s = "ab" * rng.randint(10, 100) + s if rng.random() < 0.2 else s
        docs.append((rng.choice([k, k, k % 7, None]), s if rng.random() < 0.95 else None))
    if piece == 100:  # long documents in overlapping pieces, in this process
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        text = (base[0] * 4).encode()
        buf, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        runs = [(x + a, y + a) for a, e, cuts in suffix_dedup.pieces(off) for x, _, y in zip(*suffix_dedup.string_anchors(buf[a:e], cuts), strict=True)]
        assert sorted(x for lo, hi in runs for x in range(lo, hi + 1)) == list(range(len(text) - 49))
        return
    got = sorted((tuple(r) for r in suffix_dedup.dedup_substrings(frame(spark, docs).repartition(3)).collect()), key=str)
    assert got == brute_substrings(docs)


@data
def test_op1_documents(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    assert sorted((tuple(r) for r in queries.op1_suffix_array_dedup(spark, SF).collect()), key=str) == brute_substrings(docs)


def test_op1_one_gram_in_many_contexts(spark, monkeypatch):
    """A hot 20-byte rank in a million contexts, settled in turns, makes no false repeat; real ones behind it are found."""
    monkeypatch.setattr(suffix_dedup, "SETTLED_AT_ONCE", 100_000)
    n = 1_000_000
    ids = np.arange(n) % 1000
    own = suffix_dedup.Round(ids, np.full(n, 7, np.uint64), np.arange(n).astype(np.uint64) // np.uint64(2))
    _, blobs = own.packed(1)
    half = len(blobs[0]) // 48 * 24
    planes = C.unpack(blobs[0], np.uint64, np.uint64, np.int64)
    rows = [C.pack(*(x[: half // 24] for x in planes)), C.pack(*(x[half // 24 :] for x in planes))]
    table = pa.table({"block": pa.array([0, 1]), "part": pa.array([0, 0]), "data": pa.array(rows, pa.binary())})
    out = suffix_dedup.settle(table)
    shared, later = own.answered(1, {0: b"".join(out.column("states").to_pylist())})
    assert shared.all() and (later == (ids % 2 == 1)).all()
    gram = "the same twenty byte"
    docs = [(i, f"{i:030d}{gram}{i * 7919:030d}") for i in range(3000)] + [(5000, "x" * 40 + f"{2999:030d}{gram}{2999 * 7919:030d}")]
    out = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_substrings(frame(spark, docs)).collect()}
    want = {r[0]: r[2] for r in brute_substrings(docs)}
    assert out == want and out[5000] == 80


def test_op1_rounds_thin_out(spark):
    """Every round of the doubling is taken, and ranks that are unique leave before the next."""
    rng = random.Random(2)
    docs = frame(spark, [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))) for i in range(40)])
    blocks, answers, parts = suffix_dedup.dedup_rounds(docs)
    assert {r["round"] for r in answers.select("round").distinct().collect()} >= {0, 2}
    table = blocks.toArrow()
    by_block = {b: answers.where(F.col("block") == b).toArrow() for b in table.column("block").to_pylist()}
    n = []
    for k in range(suffix_dedup.ROUNDS):
        n.append(sum(len(suffix_dedup.Doubling(block, suffix_dedup.answers_of(by_block[b], suffix_dedup.ROUNDS)[:k], parts).round.ids) for b, block in zip(table.column("block").to_pylist(), suffix_dedup.blocks_of(table), strict=True)))
    assert n[0] > n[1] >= n[2] / 2 and sum(map(len, (b.at for b in suffix_dedup.blocks_of(table)))) == n[0]


def test_op1_real_output(spark):
    a = "the same fifty bytes and some more of them, over and over again, quite long "
    rows = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_substrings(frame(spark, [(1, a), (2, "x" + a + "y")]), True).collect()}
    assert rows == {1: a.encode(), 2: b"xy"}


# ---------------------------------------------------------------- 2
@data
def test_op2_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in C.read_table(spark, sf, "labels").collect()}
    held = [d for d in labels if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and got[d].predicted == int(got[d].score >= 0.7) for d in got)
    assert sum(got[d].predicted == labels[d] for d in held) / len(held) > 0.93


def test_op2_prior_and_no_positives(spark):
    rng = np.random.default_rng(0)
    p, u = rng.normal(2, 1, (500, 3)), np.concatenate([rng.normal(2, 1, (700, 3)), rng.normal(-2, 1, (300, 3))])
    assert abs(quality_model.estimated_prior(p, u) - 0.7) < 0.08
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.classify(frame(spark, [(1, "a b"), (2, None)]), none).collect()} == {0.5}


def test_op2_scores_and_risk_by_hand():
    """Slots and scores against word-by-word counting; the gradient against differences of the written-out risk."""
    texts = ["", "One two two.\nThree", "a", "é é é é é b", "x" * 50, "w1 " * 300]
    buf, off = C.text_block(pa.array(texts))
    x = quality_model.features(buf, off)
    assert x.shape == (6, quality_model.N_FEATURES + 3 * quality_model.HASHED) and (x[0] == 0).all()
    for i, t in enumerate(texts):
        b = t.encode()
        n = (len(WORD.findall(t)), max(0, len(WORD.findall(t)) - 1), max(0, len(b) - 3))
        for k in range(3):
            lo = quality_model.N_FEATURES + k * quality_model.HASHED
            assert math.isclose(x[i, lo : lo + quality_model.HASHED].sum(), n[k] / (n[k] + quality_model.SMOOTH), abs_tol=1e-5)
        grams = Counter(zip(*(WORD.findall(t)[k:] for k in range(3))))
        assert math.isclose(x[i, 16], 1 - len(grams) / max(1, sum(grams.values())) if WORD.findall(t) else 0, abs_tol=1e-6)
    rng = np.random.default_rng(5)
    p, u = x[[1, 3, 4]] + rng.normal(0, 0.01, (3, x.shape[1])), x[[0, 1, 2, 5]]
    model = quality_model.Model(p, u, 30)
    want = quality_model.sigmoid(model._inputs(x.astype(np.float32)) @ model.w)
    assert np.allclose(model.score(buf, off), want, atol=1e-4)
    p, u = model._inputs(p.astype(np.float32)).astype(float), model._inputs(u.astype(np.float32)).astype(float)
    soft = lambda z: np.logaddexp(0, z)
    for prior in (0.2, 0.9):
        model.prior = prior
        w = rng.normal(0, 0.05, p.shape[1])
        rest = lambda w: soft(u @ w).mean() - prior * soft(p @ w).mean()  # noqa: B023, E731
        risk = lambda w: prior * soft(-(p @ w)).mean() + (rest(w) if rest(w0) >= 0 else -0.1 * rest(w)) + (model.hold * w * w).sum() / 2  # noqa: B023, E731
        w0 = w
        g = model._gradient(w, p, u)
        for k in (0, 5, 30, 700, len(w) - 1):
            e = np.zeros(len(w))
            e[k] = 1e-5
            assert math.isclose(g[k], (risk(w + e) - risk(w - e)) / 2e-5, rel_tol=1e-3, abs_tol=1e-7)


# ---------------------------------------------------------------- 3
@data
def test_op3_recovers_roles_and_texts(spark):
    own = {(r.conv_id, r.turn): (r.role, r.text) for r in queries.op3_chat_formatting(spark, SF).collect()}
    want = {(r.conv_id, r.turn): (r.role, r.text) for r in table(spark, "conversations").collect()}
    assert sum(own.get(k) == v for k, v in want.items()) / len(want) > 0.95


def test_op3_viterbi_is_the_best_path():
    lines = chat.Lines.of("Q: how\nmore\n\nA: so\n\nand then\n\n### Response: x")
    seen = lines.emissions(5, False, True, True)
    score = lambda path: chat._START[path[0]] + sum(chat._TRANS[a, b] for a, b in itertools.pairwise(path)) + sum(seen[i, s] for i, s in enumerate(path))
    best = max(itertools.product(range(6), repeat=len(seen)), key=score)
    end, pointers = chat.forward([seen], chat._START[None, None])
    assert tuple(chat.backward(pointers[0][:, 0], int(end[0, 0].argmax()))) == best and math.isclose(end[0, 0].max(), score(best))
    assert [r for r, _ in chat.parse("User: a\nb\n\nno marker\n\nUser: c")] == ["user", "assistant", "user"]
    assert chat.parse(None) == chat.parse(" \n") == [] and chat.render("user", "a") == "<|user|>\na\n<|end|>\n"


def test_op3_false_markers_stay_text():
    assert chat.parse("User: pick one\nA: red\nB: blue") == [("user", "pick one\nA: red\nB: blue")]
    assert chat.parse("User: see\n```\nuser: x\nassistant: y\n```\n\nAssistant: ok\n    user: z\nend") == [("user", "see\n```\nuser: x\nassistant: y\n```"), ("assistant", "ok\n    user: z\nend")]
    assert chat.parse("USER: shout\n\nASSISTANT:   back") == [("user", "shout"), ("assistant", "  back")]
    assert chat.parse("<|user|>\nhello\n\n<|assistant|>\nhi\n  there") == [("user", "hello"), ("assistant", "hi\n  there")]
    assert chat.parse("User: a\n\n  \nb\n\nAssistant: c") == [("user", "a\n\n  \nb"), ("assistant", "c")]


def test_op3_stretches_are_one_transcript(spark):
    rng = random.Random(3)
    rows, whole = [], {}
    for c in range(40):
        style = rng.choice(chat.STYLES)
        pieces = []
        for k in range(rng.randint(1, 5)):
            turns = ["".join([rng.choice([style[1] + " ", style[2] + " ", "", "", style[0] + " "]), rng.choice(["one", "two\nlines", "```\nuser: x", "```", "par\n\nagraph", "Q: what\nB: that", "    deep"])]) for _ in range(rng.randint(1, 6))]
            pieces.append("\n\n".join(turns))
            rows.append((c, k, pieces[-1]))
        whole[c] = chat.parse("\n\n".join(pieces))
    out = {}
    for r in chat.format_transcripts(spark.createDataFrame(rows, "conv_id long, stretch long, transcript string")).collect():
        out.setdefault(r.conv_id, {})[r.turn] = (r.role, r.text)
        assert r.rendered == chat.render(r.role, r.text)
    same = sum([t[k] for k in range(len(t))] == whole[c] for c, t in out.items())
    assert len(out) == 40 and same >= 36  # the others have several paths of one score
    for c in range(40):
        pieces = [{"conv": "", "stretch": k, "transcript": t} for i, k, t in rows if i == c]
        known = chat.settings(pa.table(dict(zip(("conv", "stretch", "fences", "styles", "first"), zip(*chat.summaries(pieces), strict=True), strict=True)))).to_pylist()
        score = None
        for _, _, m in chat.transfers([p | k for p, k in zip(pieces, known, strict=True)]):
            m = np.frombuffer(m).reshape(7, 6)
            score = m[6] if score is None else (score[:, None] + m[:6]).max(0)
        lines = chat.Lines.of("\n\n".join(p["transcript"] for p in pieces))
        once = chat.forward([lines.emissions(known[0]["style"], False, known[0]["paired"], True)], chat._START[None, None])[0]
        assert np.allclose(score, once[0, 0])


def test_op3_long_repeated_and_awkward(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"line {i}\n\nmore") for i in range(1030)] + [(1, 0, "user", "line 0\n\nmore")] + [(None, None, None, None), (2, 0, "user", "z " * 200_000), (2, 1, "other", ""), (2, 2, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("stretch", "transcript", "conv", "style", "i", "n", "first", "before"):
        turns = turns.withColumn(name, F.lit("x"))
    out = chat.format_conversations(turns).collect()
    one = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.turn)
    assert [r.turn for r in one] == list(range(len(one))) and len(one) > 900
    assert "\n\n".join(r.text for r in one).count("line") == 1030
    assert any(r.conv_id == 2 and len(r.text) >= 399_999 for r in out)
    assert chat.format_conversations(turns.limit(0)).count() == 0
    assert chat.format_transcripts(spark.createDataFrame([(1, None, None), (1, 0, ""), (None, None, "Human: x")], "conv_id long, stretch long, transcript string")).collect()[0].conv_id is None


# ---------------------------------------------------------------- 4
def best_fit_decreasing(histogram):
    gaps, bins = Counter(), 0
    for s in sorted(histogram, reverse=True):
        for _ in range(histogram[s]):
            g = min((g for g in gaps if g >= s and gaps[g]), default=None)
            if g is None:
                bins, g = bins + 1, 1024
            else:
                gaps[g] -= 1
            gaps[g - s] += 1
    return bins


def packed(histogram):
    """Sequences of the plan, which holds every piece once."""
    kinds, got = packing.plan(histogram), Counter()
    for n, content in kinds:
        assert n > 0 and sum(s * c for s, c in content) <= 1024
        for s, c in content:
            got[s] += n * c
    assert got == Counter(histogram)
    return sum(n for n, _ in kinds)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 300), max_size=80))
def test_op4_plan_packs_every_piece_once(histogram):
    n, bound = packed(histogram), -(-sum(s * c for s, c in histogram.items()) // 1024)
    assert bound <= n <= 2 * bound + 1


def test_op4_against_best_fit_decreasing():
    """Rounding the program down, and gaps that small pieces do not fill, cost up to one sequence in 150 on some histograms;
    on the whole the plan is better than best fit decreasing."""
    rng, ours, plain = random.Random(1), 0, 0
    for _ in range(120):
        histogram = {rng.randint(1, 1024): rng.randint(1, 300) for _ in range(rng.randint(0, 80))}
        n, bins = packed(histogram), best_fit_decreasing(histogram)
        assert n <= bins + 1 + bins // 150
        ours, plain = ours + n, plain + bins
    assert ours < plain


def test_op4_exact_on_small_cases():
    """The fewest sequences of a handful of pieces, by trying all ways, and one more at most."""

    def fewest(pieces, bins=()):
        if not pieces:
            return len(bins)
        own, rest = pieces[0], pieces[1:]
        ways = {b: i for i, b in enumerate(bins) if b >= own}
        return min([fewest(rest, (*bins, 1024 - own))] + [fewest(rest, tuple(sorted((*bins[:i], b - own, *bins[i + 1 :])))) for b, i in ways.items()])

    rng, exact = random.Random(2), 0
    for _ in range(60):
        pieces = sorted((rng.choice([rng.randint(1, 1024), rng.randint(200, 600)]) for _ in range(rng.randint(1, 7))), reverse=True)
        best, n = fewest(pieces), packed(dict(Counter(pieces)))
        assert best <= n <= best + 1
        exact += n == best
    assert exact >= 54


@data
def test_op4_sequences_come_by_the_configurations():
    """Linear grouping places at least 90 % of the pieces above 1/8 of a sequence, within 0.1 % of the bound."""
    own = packing.Tokens(*packing.default_vocabulary())
    column = pa.parquet.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text")
    histogram = Counter(k for t in column.slice(0, 6000).to_pylist() for _, k in packing.cut(len(own.ids(t or "")) + 1, 1024))
    for times in (1, 50):
        kinds, report = packing.plan_and_report({s: n * times for s, n in histogram.items()})
        large = report["configured"] + report["fitted_large"]
        assert large == times * sum(n for s, n in histogram.items() if 128 <= s < 1024) and report["configured"] >= 0.9 * large
        bound = -(-times * sum(s * n for s, n in histogram.items()) // 1024)
        assert sum(n for n, _ in kinds) <= 1.001 * bound


@data
def test_op4_ids_of_all_documents_are_the_tokenizers():
    own = packing.Tokens(*packing.default_vocabulary())
    texts = pa.parquet.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    assert all(own.ids(t or "").tolist() == e.ids for t, e in zip(texts, own.full.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=200))
def test_op4_ids_are_the_tokenizers(text):
    own = packing.Tokens(*packing.default_vocabulary()) if not hasattr(packing, "_kept") else packing._kept
    packing._kept = own
    for t in (text, text + "<|endoftext|> x"):
        assert own.ids(t).tolist() == own.full.encode(t, add_special_tokens=False).ids


@data
def test_op4_round_trip(spark):
    out = packing.pack_documents(table(spark, "documents"), with_ids=True).collect()
    own = packing.Tokens(*packing.default_vocabulary())
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for d, text in texts.items():
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and parts[0].start == 0
        ids = [i for r in parts for i in r.ids]
        assert ids == [*own.ids(text).tolist(), 2] and (len(parts) == 1 or all(r.length == 1024 for r in parts[1:]))
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))] and sum(r.length for r in parts) <= 1024


# ---------------------------------------------------------------- 5
def brute_counts(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_op5_counts(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\n", "a a a a", "a b c a b c a", "x\nx\n\n\nx \n#$ |", "é b\x0bc\x85d", "1 2 3 1 2 3 1 2"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))).replace("a b", "a\nb") for _ in range(60)]
    out = quality_rules.judged(frame(spark, enumerate(texts)), ("doc_id",)).select("row.doc_id", *quality_rules.COUNTS, "base_failed", "kept").collect()
    for r in out:
        n = brute_counts(texts[r.doc_id])
        assert tuple(r)[1:6] == n and r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)


@data
def test_op5_keeps_good_and_rejects_bad(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op5_quality_rules(spark, sf).collect()}
    for r in C.read_table(spark, sf, "labels").collect():
        o = out[r.doc_id]
        assert o.kept == (r.quality == 1 and not o.base_failed), (r, o)


def test_op5_posterior_by_hand():
    """Two rounds of expectation and maximisation, written out over rows instead of patterns."""
    rules = len(quality_rules.RULES)
    rng = random.Random(3)
    rows = ["".join(rng.choice("gb-" if rng.random() < 0.5 else "g") for _ in range(rules)) for _ in range(60)] + ["b" * rules] * 5
    good = [(0.95, 0.5, 0.05)[min(2, r.count("b"))] for r in rows]
    for _ in range(2):
        share = sum(good) / len(rows)

        def seen(j, v, side):
            weight = sum(g if side else 1 - g for g, r in zip(good, rows, strict=True) if r[j] == v)
            own = (v == "g" and side) or (v == "b" and not side)
            return (weight + (1.0 if own else 0.1)) / (len(rows) * (share if side else 1 - share) + 1.2)

        table = {(j, v, side): seen(j, v, side) for j in range(rules) for v in "gb-" for side in (True, False)}
        odds = [share / (1 - share) * math.prod(table[j, v, True] / table[j, v, False] for j, v in enumerate(r)) for r in rows]
        good = [o / (1 + o) for o in odds]
    got = quality_rules.posteriors(Counter(rows), 2)
    assert all(math.isclose(got[r], g, rel_tol=1e-9) for r, g in zip(rows, good, strict=True))
    assert got["g" * rules] > 0.9 > 0.1 > got["b" * rules]


def test_op5_native(spark):
    plan = quality_rules.judged(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- 6
def brute_groups(docs, least=0.8):
    sets = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        sets[i] = Counter(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        both = set(x) & set(y)
        # without repeated shingles this is the plain Jaccard similarity
        plain = len(both) == sum(x[i] for i in both) == sum(y[i] for i in both) and max(x.values(), default=1) == max(y.values(), default=1) == 1
        alike = bool(both) and (x == y or (len(both) / len(set(x) | set(y)) if plain else sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in set(x) | set(y)) for i in both)) >= least)
        if alike:
            parent[find(b)] = find(a)
            root = min(find(a), find(b))
            parent[find(a)] = parent[find(b)] = root
    return {i: min(j for j in sets if find(j) == find(i)) for i in sets}


def near_copies(rng, n, most):
    base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
        out.append(" ".join(w))
    return out


def test_op6_groups_are_the_brute_ones(spark, monkeypatch):
    rng = random.Random(6)
    docs = list(enumerate([*near_copies(rng, 60, 6), *near_copies(rng, 8, 2), "a b c", "a b c", "a  b\nc", "a b d", "", "", None, "z " * 40, "z " * 41]))
    for few in (24, 2):  # also with every larger bucket through the prefix filter
        monkeypatch.setattr(near_dedup, "FEW", few)
        out = near_dedup.near_duplicates(frame(spark, docs)).collect()
        assert {r.doc_id: r.class_id for r in out} == brute_groups(docs)
        assert all(r.keep == (r.doc_id == r.class_id) for r in out)


def test_op6_filter_keeps_pairs_of_exactly_the_threshold(spark):
    sets, c = [], 0
    for x, y, shared in ((13, 14, 12), (26, 28, 24), (130, 140, 120)):
        both = np.arange(shared) + 1_000 * c + 100_000
        for size in (x, y):
            h = np.concatenate([both, np.arange(size - shared) + 1_000 * c]).astype(np.uint64)
            sets += [(c, c, bytearray(np.sort(h).tobytes() + np.ones(size, np.uint32).tobytes()))]
            c += 1
    df = spark.createDataFrame(sets, "c long, root long, set binary")
    pairs = near_dedup.foreign_pairs(df.select("c", "root"), df.select("c", "set"), 0.8).collect()
    assert {(0, 1), (2, 3), (4, 5)} <= {(r.a, r.b) for r in pairs}
    found = near_dedup.verified(spark.createDataFrame([(0, 1), (2, 3), (4, 5)], "a long, b long"), df.select("c", "set")).collect()
    assert [r.similarity for r in found] == [0.8] * 3


@data
def test_op6_bands_lose_no_pair(spark):
    """Recall at table size: every pair of different texts that is 0.8 alike by brute force over shared shingles lies in one group."""
    rows = [(r.doc_id, r.text) for r in C.read_table(spark, "/root/testdata/sf0.01", "documents").collect()]
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = Counter(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    holders = {}
    for i, x in sets.items():
        for g in x:
            holders.setdefault(g, []).append(i)
    shared = Counter(p for h in holders.values() for p in itertools.combinations(h, 2))
    pairs = 0
    group = {r.doc_id: r.class_id for r in queries.op6_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    for (a, b), n in shared.items():
        x, y = sets[a], sets[b]
        if n >= 0.8 * max(len(x), len(y)) * 0.8 and x != y and sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y)) >= 0.8 if len(x) + len(y) < 1200 else False:
            pairs += 1
            assert group[a] == group[b], (a, b)
    assert pairs > 0


def test_op6_classes_of_one_name(spark, monkeypatch):
    """Word sequences whose first hashes agree are different classes all the same."""
    real = near_dedup.shingles

    def clashing(buf, off, n=near_dedup.WORDS):
        row, g, count, whole, words = real(buf, off, n)
        return row, g, count, [whole[0] % np.uint64(2), whole[1]], words

    monkeypatch.setattr(near_dedup, "shingles", clashing)
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdef"]
    docs = [(i, texts[i % 6]) for i in range(12)]
    block = C.text_block(pa.array([t for _, t in docs]))
    assert len(set(clashing(*block)[3][0].tolist())) <= 2  # in this process; workers import the module anew
    out = near_dedup.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: r.class_id for r in out} == {i: i % 6 for i in range(12)}


def test_op6_probability_jaccard_and_registers():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = (np.unique(rng.integers(0, 30, 15)).astype(np.uint64) for _ in range(2))
        a, b = rng.integers(1, 5, len(x)), rng.integers(1, 5, len(y))
        p, q = dict(zip(x.tolist(), a.tolist(), strict=True)), dict(zip(y.tolist(), b.tolist(), strict=True))
        want = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in p.keys() | q.keys()) for i in p.keys() & q.keys())
        assert math.isclose(near_dedup.probability_jaccard(x, a, y, b), want, abs_tol=1e-12)
    row, g = np.repeat([0, 1], 300), np.concatenate([np.arange(300), np.arange(100, 400)]).astype(np.uint64)
    who = near_dedup.prob_min_hash(row, C.mix(g), np.ones(600), 2, 4096)
    assert abs((who[0] == who[1]).mean() - 0.5) < 0.04


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


# ---------------------------------------------------------------- 7
def brute_lines(docs, min_lines=2, long_words=50):
    out, runs, longs = {}, set(), set()
    for i, t in sorted(docs):
        lines = [(p, x) for p, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        gone = set()
        for a, (p, x) in enumerate(lines):
            if len(WORD.findall(x)) >= long_words:
                gone |= {p} if x in longs else set()
                longs.add(x)
            if a + min_lines <= len(lines):
                run = tuple(y for _, y in lines[a : a + min_lines])
                gone |= {q for q, _ in lines[a : a + min_lines]} if run in runs else set()
                runs.add(run)
        out[i] = "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone)
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_op7_runs(spark, min_lines):
    rng = random.Random(min_lines)
    long = "w " * 60
    docs = [(i, "\n".join(rng.choice(["a", "b", "c d", "", " ", long]) for _ in range(rng.randint(0, 14)))) for i in range(40)] + [(50, "a\na\na\na"), (51, None)]
    out = line_dedup.dedup_lines(frame(spark, docs), min_lines)
    assert {r.doc_id: r.text for r in out.select("row.doc_id", "text").collect()} == brute_lines(docs, min_lines)
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


def test_op7_maximal_runs(spark):
    rng = random.Random(70)
    block = [f"line {k}" for k in range(11)]
    docs = [(i, "\n".join(rng.choice([block[a : a + rng.randint(1, 9)], [f"own {i}"], ["x", "x"]])[k] for a in [rng.randint(0, 8)] for _ in range(4) for k in [0])) for i in range(6)]
    docs += [(10, "\n".join(block)), (11, "\n".join(["head", *block[2:9], "tail"])), (12, "\n\n".join(block[3:])), (13, None), (14, "a\na\na\na")]
    lines = {i: [x for x in (t or "").split("\n") if WORD.search(x)] for i, t in docs}
    first, runs = {}, []
    for i, ls in sorted(lines.items()):
        for a in range(len(ls) - 1):
            f = first.setdefault((ls[a], ls[a + 1]), (i, a))
            if f == (i, a):
                continue
            last = runs[-1] if runs else None
            if last and last[0] == i and last[1] + last[2] - 1 == a and (last[3], last[4] + last[2] - 1) == f:
                last[2] += 1
            else:
                runs.append([i, a, 2, *f])
    want = {tuple(r) for r in runs}
    out = line_dedup.repeated_runs(frame(spark, docs))
    assert {tuple(r) for r in out.collect()} == want and max(w[2] for w in want) >= 7
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    assert line_dedup.repeated_runs(frame(spark, docs).limit(0)).count() == 0


# ---------------------------------------------------------------- 8
@data
def test_op8_counts_and_gain(spark):
    out = {r.doc_id: r for r in queries.op8_lm_scoring(spark, SF).collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = {r.doc_id: [*WORD.findall(r.text.translate(lower)), "\n"] for r in table(spark, "documents").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    c = Counter(w for d, ws in docs.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in docs.items():
        r = out[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    assert sum(out[d].score for d in docs if held[d]) > sum(out[d].base_score for d in docs if held[d])


def test_op8_vocabulary_grows_with_the_input(spark):
    words = [f"w{i}" for i in range(2 * lm.SHORTLIST)]
    docs = [(i, " ".join(words[k::4])) for i in range(400) for k in [i % 4] if lm.training([i])[0]]
    docs += [(i, t) for i, t in enumerate([t for _, t in docs[:240]], 1000) if lm.training([i])[0]]
    c = Counter(w for _, t in docs for w in t.split())
    vocabulary = lm.Vocabulary(lm.word_counts(frame(spark, docs), 8).toLocalIterator())
    assert min(c.values()) >= 50 and vocabulary.size == len(words) + 1 and vocabulary.n == sum(c.values()) + len(docs)
    h, bucket, _ = lm.tokens(*C.text_block(pa.array([" ".join(words)])))
    assert len(set(vocabulary.ids(h, bucket).tolist())) == len(words) and vocabulary.ids(h, bucket).max() < vocabulary.size


def test_op8_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    model = lm.LogBilinear(rng.random(130) / 65)
    step = model.trainer()
    for _ in range(30):
        step(rng.integers(0, 131, (64, lm.CONTEXT)), rng.integers(0, 130, 64))
    context = np.repeat(rng.integers(0, 131, (1, lm.CONTEXT)), 130, 0)
    assert abs(np.exp(model.log_prob(context, np.arange(130))).sum() - 1) < 1e-4


def small_stream(rng, words, texts):
    """A vocabulary of all words, and the ids and contexts of random texts, some of them empty."""
    lines = [" ".join(f"w{min(int(x), words - 1)}" for x in rng.pareto(0.4, rng.integers(0, 30))) for _ in range(texts)]
    every = " ".join(f"w{i}" for i in range(words))
    h, bucket, _ = lm.tokens(*C.text_block(pa.array([every])))
    h, bucket, n = np.append(h, lm.END_HASH), np.append(bucket, 0), np.append(np.arange(words, 0, -1) + lm.MIN_COUNT, texts)
    order = np.argsort(h)
    blob = C.pack(h[order], n[order].astype(np.int64), bucket[order].astype(np.uint8))
    vocabulary = lm.Vocabulary([{"n": int(n.sum()), "v": len(h), "sums": [1.0] * lm.BUCKETS, "top": blob}])
    return vocabulary, vocabulary.stream(*lm.tokens(*C.text_block(pa.array(lines))), texts)


def test_op8_ids_by_leading_bits():
    rng = np.random.default_rng(4)
    vocabulary, _ = small_stream(rng, 3000, 1)
    edges = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    h = np.concatenate([vocabulary.h, vocabulary.h + np.uint64(1), vocabulary.h - np.uint64(1), edges, rng.integers(0, 2**64, 5000, np.uint64)])
    own = {int(x): i for i, x in enumerate(vocabulary.h)}
    assert vocabulary.ids(h, np.full(len(h), 7)).tolist() == [own.get(int(x), vocabulary.size + 7) for x in h]


def test_op8_classes_are_scored_together(monkeypatch):
    """Few sums of scores whatever the number of classes, and each token's probability as a slow reading of the tree has it, also for scores out of range."""
    rng = np.random.default_rng(5)
    vocabulary, (target, context, _) = small_stream(rng, 3000, 300)
    model = lm.LogBilinear(vocabulary.unigram)
    calls, log_sum = [], lm.log_sum
    monkeypatch.setattr(lm, "log_sum", lambda *a: calls.append(1) or log_sum(*a))
    for scale in (1, 40):
        for k in "QTSR":
            model.p[k] = rng.normal(0, scale, model.p[k].shape).astype(np.float32)
        calls.clear()
        got = model.log_prob(context, target)
        assert len(calls) < len(model.p["S"]) / 2 and len(model.p["S"]) > 200
        p, per = {k: v.astype(float) for k, v in model.p.items()}, model.per
        q = sum(p["Q"][context[:, j]] * p["P"][j] for j in range(lm.CONTEXT))
        for i in range(0, len(target), 7):
            r, want = int(model.rank[target[i]]), 0.0
            for k, lo, own in (("T", 0, r // per**2), ("S", r // per**2 * per, r // per), ("R", r // per * per, r)):
                z = p[k][lo : lo + (per if k != "T" else len(p["T"]))] @ q[i] + p[k.lower()][lo : lo + (per if k != "T" else len(p["T"]))]
                want += z[own - lo] - z.max() - np.log(np.exp(z - z.max()).sum())
            assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-4), (scale, i)


def test_op8_steps_along_the_line(monkeypatch):
    """Reading and moving a token's input once a step agrees with doing so for every context it is in."""
    rng = np.random.default_rng(6)
    vocabulary, (target, context, _) = small_stream(rng, 400, 60)
    states = []
    for each in (False, True):
        if each:
            monkeypatch.setattr(lm, "running", lambda c, f=lm.running: (f(c)[0], [np.arange(len(c))] * lm.CONTEXT))
        model = lm.LogBilinear(vocabulary.unigram)
        step = model.trainer()
        for lo in range(0, len(target), 100):
            step(context[lo : lo + 100], target[lo : lo + 100])
        states.append(model.p)
    assert all(np.allclose(states[0][k], states[1][k], rtol=1e-4, atol=1e-5) for k in states[0])


def test_op8_layout_has_no_say(spark, monkeypatch):
    rng = random.Random(8)
    docs = frame(spark, [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(200))) for i in range(140)])
    monkeypatch.setattr(lm, "PART_TOKENS", 2_000)
    monkeypatch.setattr(lm, "PART_SHARE", 1)
    assert min(lm.schedule(24_000, 300)) > 1
    most, scores = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(most)
    for rows, files in ((1000, 1), (7, 5)):
        spark.conf.set(most, rows)
        written = C.materialize(docs.repartition(files), "layout")
        scores.append({r.doc_id: r.score for r in lm.score_documents(written).collect()})
    spark.conf.set(most, before)
    assert all(math.isclose(scores[0][d], scores[1][d], rel_tol=1e-5) for d in scores[0]) and len(scores[0]) == 140


def test_op8_score_is_the_models(spark, monkeypatch):
    """The column score against a slow reading of the trained parameters: tree of softmaxes and add-one shares, token by token."""
    rng = random.Random(11)
    texts = [(i, " ".join(f"W{int(rng.paretovariate(0.8)) % 200}" for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs = frame(spark, texts)
    for name, value in (("SHORTLIST", 20), ("MIN_COUNT", 5), ("PART_TOKENS", 300), ("PART_SHARE", 1)):
        monkeypatch.setattr(lm, name, value)
    vocabulary = lm.Vocabulary(lm.word_counts(docs.select("doc_id", "text"), 3).toLocalIterator())
    state = lm.trained(docs.select("doc_id", "text"), vocabulary)
    model = lm.LogBilinear(vocabulary.unigram).load((state[0], {}))
    p, per, m = model.p, model.per, model.m
    c = Counter(w for i, t in texts if lm.training([i])[0] for w in [*t.lower().split(), "\n"])

    def softmax(k, q, lo, hi, own):
        z = [float(p[k][j] @ q + p[k.lower()][j]) for j in range(lo, min(hi, len(p[k])))]
        return math.log(math.exp(z[own - lo]) / sum(map(math.exp, z)))

    got = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    for i, t in texts:
        words = [w.encode() for w in t.lower().split()]
        h, bucket, _ = lm.tokens(*C.text_block(pa.array([t])))
        ids = [*vocabulary.ids(h, bucket).tolist(), vocabulary.end]
        total = 0.0
        for k, x in enumerate(ids):
            before = [ids[k - j] if k >= j else vocabulary.size + lm.BUCKETS for j in range(1, lm.CONTEXT + 1)]
            q = sum(p["Q"][b] * p["P"][j] for j, b in enumerate(before))
            r = int(model.rank[x])
            total += softmax("T", q, 0, m, r // per**2) + softmax("S", q, r // per**2 * per, (r // per**2 + 1) * per, r // per) + softmax("R", q, r // per * per, (r // per + 1) * per, r)
            if x >= vocabulary.size:
                total += math.log((c[words[k].decode()] + 1) / vocabulary.bucket_sums[x - vocabulary.size])
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-4, abs_tol=1e-4), i


def test_op8_texts_of_rounds_are_removed(spark, monkeypatch):
    docs = frame(spark, [(i, f"w{i % 9} w{i % 5}") for i in range(80)]).select("doc_id", "text")
    vocabulary = lm.Vocabulary(lm.word_counts(docs, 3).toLocalIterator())
    paths, left, scratch, averaged = [], [], C.scratch, lm.averaged

    def counted(texts, *rest):
        left.append(sum(x.startswith("round=") for x in os.listdir(paths[0])))
        return averaged(texts, *rest)

    monkeypatch.setattr(lm, "schedule", lambda n, v: (4, 2))
    monkeypatch.setattr(C, "scratch", lambda *a: paths.append(scratch(*a).removeprefix("file:")) or paths[-1])
    monkeypatch.setattr(lm, "averaged", counted)
    assert lm.trained(docs, vocabulary) and left == [4, 3, 2, 1] and not os.path.exists(paths[0])


@data
def test_op8_rounds_of_averaging_keep_what_is_learnt(spark, monkeypatch):
    """Held-out bits a token with 32 parts a round within 2 % of one part."""
    docs = C.materialize(C.read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"), "lm_docs")
    bits = {}
    for parts in (1, 32):
        monkeypatch.setattr(lm, "schedule", lambda n, v, parts=parts: (8, parts))
        r = lm.score_documents(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n"), F.sum("base_score").alias("b")).first()
        bits[parts], base = -r.s / r.n / math.log10(2), -r.b / r.n / math.log10(2)
    print(bits, base)
    assert bits[32] <= 1.02 * bits[1] and bits[32] < base


def test_op8_nothing_to_learn(spark):
    out = lm.score_documents(frame(spark, [(None, "a b"), (None, None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in out) == [(1, 0, 0, 0.0, 0.0, False), (3, 0, 0, 0.0, 0.0, False)]


# ---------------------------------------------------------------- 9
def test_op9_round_trip_and_revisits(spark):
    odd = "WARC/1.1\r\n\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\n1 0 x\n" * 9
    rows = [(5, "u a", "x" * 100), (3, "http://q", "x" * 100), (7, None, None), (8, "b", ""), (None, "c", "x" * 100), (9, "d", "y" * 99), (10, "d", "y" * 99), (3, "q", "x" * 100), (11, "o", odd), (2, "o", odd)]
    out = warc.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    want = Counter({(3, 100, digest("x" * 100), "response", None): 1, (3, 100, digest("x" * 100), "revisit", 3): 1})
    for p, t in ((5, "x" * 100), (None, "x" * 100)):
        want[p, 100, digest(t), "revisit", 3] += 1
    for p, t in ((7, None), (8, ""), (9, "y" * 99), (10, "y" * 99), (2, odd)):
        want[p, len(t or ""), digest(t), "response", None] += 1
    want[11, len(odd), digest(odd), "revisit", 2] += 1
    assert got == want and len({r.record_id for r in out}) == len(rows)


def test_op9_files(spark, monkeypatch):
    """One gzip member a record, files bounded by bytes whatever the pages' sizes, a warcinfo record first."""
    import glob
    import gzip

    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rows = [(i, f"http://{i}", chr(97 + i % 26) * n) for i, n in enumerate([10] * 50 + [20_000] * 40 + [300_000] * 9 + [17_000_000])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = C.scratch(spark, "warc_test")
    warc.write_warc(warc.arc_archives(pages), path)
    seen, files = [], glob.glob(f"{path.removeprefix('file:')}/*.txt")
    for f in files:
        data = open(f, "rb").read()
        own = [warc.parse_record(m) for m in warc.members(memoryview(data))]
        assert gzip.decompress(data) == b"".join(warc.members(memoryview(data)))
        assert sum(len(b) for _, b in own) <= (1 << 20) + 100 or sum(h["warc-type"] != "warcinfo" for h, _ in own) == 1
        assert all(h["warc-type"] != "warcinfo" for h, _ in own[1:])
        seen += own
    assert len(files) > 5 and any(h["warc-type"] == "warcinfo" for h, _ in seen)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = warc.read_warc(spark, path).drop("payload").collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in out) == Counter((i, len(t), digest(t)) for i, _, t in rows)
    with pytest.raises(ValueError):
        list(warc.members(memoryview(warc.zipped(b"x" * 100)[:-5])))


@pytest.mark.parametrize("version", [b"1", b"2"])
def test_op9_arc_versions(version):
    data = warc.arc_archive(version, b"a.arc", [(1, "http://x y", b"one\n\n"), (None, None, b"")])
    rows = list(warc.parse_arc(data))
    assert [r["url"] for r, _ in rows] == [b"http://x%20y", b"urn:unknown"] and [warc.split_http(d)[1] for _, d in rows] == [b"one\n\n", b""]
    assert [warc.http_field(warc.split_http(d)[0], b"x-page-id") for _, d in rows] == [1, None]
    assert len(rows[0][0]) == len(warc.ARC_FIELDS[version])
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-10]))


# ---------------------------------------------------------------- 10
def brute_overlaps(docs, items):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: WORD.findall((t or "").translate(lower))
    out = {}
    for (d, t), (i, x) in itertools.product(docs, items):
        w, b = split(t), split(x)
        n = min(len(b), 12)
        allowed = 2 if len(b) >= 12 else len(b) // 6 if len(b) >= 6 else 0
        covered = {p + k for p in range(len(w) - n + 1) for q in range(len(b) - n + 1) if n and sum(a != c for a, c in zip(w[p : p + n], b[q : q + n], strict=True)) <= allowed for k in range(n)}
        if covered:
            out[d, i] = len(covered)
    return out


def test_op10_masks_leave_nothing_unhit():
    for pair in itertools.combinations(range(12), 2):
        assert any(not {a + i for i, c in enumerate(m) if c == "1"} & set(pair) for m in decontaminate.MASKS for a in range(12 - len(m) + 1))


def test_op10_overlaps(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 2, 4, 5, 6, 7, 9, 11, 12, 13, 20, 40, 0, 30])] + [(99, None)]
    docs = [(100, None)]
    for k in range(60):
        b = rng.choice(items[:14])[1].split()
        a = rng.randint(0, max(0, len(b) - 14))
        b = [x if rng.random() > 0.15 else "zz" for x in b[a : a + rng.randint(5, 16)]]
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        docs.append((k, " ".join(ws + b + ws).upper() if k % 2 else " ".join(ws + b + ws)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered_words for r in decontaminate.overlaps(frame(spark, docs), bench).collect()}
    want = brute_overlaps(docs, items)
    assert got == want and want
    kept = {r.doc_id for r in decontaminate.decontaminate(frame(spark, docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.overlaps(frame(spark, docs), bench.limit(0)).count() == 0


def test_op10_repeated_words_stay_cheap():
    """Long stretches of few words against items of the same: every hash meets every other, and seconds suffice."""
    began = time.time()
    same = np.full(100_000, 5, np.uint64)
    assert decontaminate.covered(same, decontaminate.Item(same[:2000])).all()
    grid = C.mix(np.random.default_rng(3).integers(0, 2, 60_000).astype(np.uint64))
    assert decontaminate.covered(grid, decontaminate.Item(grid[:3000])).mean() > 0.99
    never = np.tile(C.mix(np.r_[np.full(8, 5), 7, 8, 9, 10].astype(np.uint64)), 150)  # hits without a window
    assert not decontaminate.covered(np.full(50_000, C.mix(np.array([5], np.uint64))[0]), decontaminate.Item(never)).any()
    assert time.time() - began < 30


def test_op10_a_benchmark_that_fills_the_filter(spark, monkeypatch):
    """The filter only spares work: with all its bits set the rows are the same."""
    rng = random.Random(4)
    items = [(k, " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 40)))) for k in range(200)]
    docs = [(k, " ".join(f"w{rng.randint(0, 30)}" for _ in range(60))) for k in range(20)] * 2 + [(99, items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((d, i, n) for k, (d, t) in enumerate(docs) for (_, i), n in brute_overlaps([(d, t)], items).items())
    for bits in (1 << 27, 1 << 20):
        monkeypatch.setattr(decontaminate, "SEED_BITS", bits)
        assert Counter(map(tuple, decontaminate.overlaps(frame(spark, docs), bench).collect())) == want


# ---------------------------------------------------------------- all of them on awkward tables
def turns_of(d):
    return d.select("*", F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"))


def pages_of(d):
    return d.select("*", F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit(None).cast("string").alias("url"))


APPLY = {
    "op3": lambda s, d: chat.format_conversations(turns_of(d)),
    "op9": lambda s, d: warc.convert_pages(pages_of(d)),
    "op1": lambda s, d: suffix_dedup.dedup_substrings(d),
    "op2": lambda s, d: quality_model.classify(d, s.createDataFrame([(4, 1, 0), (6, 1, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")),
    "op4": lambda s, d: packing.pack_documents(d),
    "op5": lambda s, d: quality_rules.judged(d),
    "op6": lambda s, d: near_dedup.near_duplicates(d),
    "op7": lambda s, d: line_dedup.dedup_lines(d),
    "op8": lambda s, d: lm.score_documents(d),
    "op10": lambda s, d: decontaminate.overlaps(d, s.createDataFrame([(1, "a b c d e f g"), (None, None)], "item_id long, text string")),
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_awkward_and_empty_tables(spark, name):
    d = awkward(spark)
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    out = APPLY[name](spark, d)
    assert APPLY[name](spark, d.limit(0)).count() == 0
    got = out.collect()
    ids = Counter(i for i, _ in rows)
    if name == "op10":
        assert Counter((r.doc_id, r.item_id) for r in got) == Counter((i, 1) for i, t in rows if t and t.startswith("a b c"))
    elif name == "op3":
        # a null or blank text behind a marker is a turn without text
        assert {i for i, t in rows if (t or "").strip()} <= {r.conv_id for r in got} <= set(ids) and all(r.role in chat.ROLES for r in got)
    elif name == "op4":
        whole = Counter()
        for r in got:
            whole[r.doc_id] += r.length
        assert set(whole) == set(ids) and whole[0] == whole[1] == 1
    else:
        key = {"op5": "row", "op7": "row", "op9": "page_id"}.get(name, "doc_id")
        assert Counter(r[key].doc_id if key == "row" else r[key] for r in got) == ids
    if name == "op1":
        assert sorted(map(tuple, got), key=str) == brute_substrings(rows)
    if name == "op5":
        want = Counter((i, *brute_counts(t)) for i, t in rows)
        assert Counter((r.row.doc_id, *(r[c] for c in quality_rules.COUNTS)) for r in got) == want
    if name == "op6":
        groups = {}
        for r in got:
            groups.setdefault(r.class_id, []).append(r.keep)
        assert all(sum(k) == 1 or i in (0, 1, 2, None) for i, k in groups.items()) and sum(len(k) for k in groups.values()) == len(rows)
    if name == "op7":
        long = [r.text for r in got if r.row.doc_id in (6, 7)]
        assert sorted(map(len, long)) == [0, len(rows[6][1])]
    if name == "op8":
        assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1} and all(r.score <= 0 for r in got)
    if name == "op9":
        assert sorted((r.payload_bytes, r.record_type) for r in got) == sorted((len((t or "").encode()), "revisit" if t and len(t.encode()) >= 100 and k in (7,) else "response") for k, (_, t) in enumerate(rows))


@data
def test_pipeline_stages(spark, tmp_path):
    odd = awkward(spark)
    folder = str(tmp_path)
    spark.createDataFrame([(1, "a b c d e f g"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        assert name == "best_fit_packing" or out.columns == odd.columns
        assert (out.count() > 0 or name == "quality_rules") and stage(spark, odd.limit(0), folder).count() == 0
    docs = table(spark, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = [d for d in texts if d in {r.doc_id for r in quality_rules.quality_filter(docs).collect()}]
    lines = {d: t for d, t in brute_lines([(d, texts[d]) for d in kept]).items() if WORD.search(t) or not WORD.search(texts[d])}
    heads = set(brute_groups(list(lines.items())).values())
    blank = {d for d, t in lines.items() if not WORD.search(t)}
    left = {d: t for d, t in lines.items() if d in heads or d in blank}
    # only pairs that share three tokens in a row, or a short item, can overlap
    runs = lambda t: {tuple(w[k : k + 3]) for w in [WORD.findall((t or "").lower())] for k in range(len(w) - 2)}
    items = [(r.item_id, r.text, runs(r.text)) for r in table(spark, "benchmark").collect()]
    leaks = set()
    for d, t in left.items():
        own = runs(t)
        near = [(i, x) for i, x, g in items if g & own or len(WORD.findall(x or "")) < 6]
        leaks |= {d for d, _ in brute_overlaps([(d, t)], near)} if near else set()
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(left) - leaks
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == [n for n, _ in pipeline.STAGES]


def test_blocks_and_words():
    arr = pa.array(["a b", None, "", " é\tx\n", "y" * 50])
    got = []
    for i, j, buf, off in C.blocks(arr, 10):
        s, e, d = C.word_spans(buf, off)
        got += [(i + k, bytes(buf[a:b]).decode()) for a, b, k in zip(s, e, d, strict=True)]
        assert j > i
    assert got == [(0, "a"), (0, "b"), (3, "é"), (3, "x"), (4, "y" * 50)]
    a = np.arange(5, dtype=np.uint64)
    assert all((x == y).all() for x, y in zip(C.unpack(C.pack(a, a.astype(np.uint16)), np.uint64, np.uint16), (a, a), strict=True))
