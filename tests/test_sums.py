import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical, vector


@pytest.mark.parametrize(("cells", "hits", "shared"), [(1 << 18, 1 << 18, 128), (64, 5, 2), (7, 1, 1), (1000, 30, 1 << 30)])
def test_sums_of_slices_equal_the_plain_ones(monkeypatch, cells, hits, shared):
    """In a matrix product or posting by posting, and however queries and postings are sliced."""
    for name, value in (("CELLS", cells), ("HITS", hits), ("SHARED", shared)):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(5)
    chunks, terms, queries = 37, 60, 90
    held = rng.random((terms, chunks)) < rng.random((terms, 1)) ** 3
    held[np.arange(terms), rng.integers(0, chunks, terms)] = True
    cut, place = np.append(0, np.cumsum(held.sum(1))), np.nonzero(held)[1].astype(np.int32)
    units = rng.integers(0, 10**10, len(place)).astype(np.float64)
    asked = np.where(rng.random((queries, terms)) < 0.3, rng.integers(1, 9, (queries, terms)), 0)
    asked[[3, 50]] = 0
    of, at = np.nonzero(asked)
    table = np.zeros((terms, chunks), np.int64)
    table[np.nonzero(held)] = units
    sums = lexical._Sums(cut, place, chunks, of, at, asked[of, at].astype(np.int32), queries)
    got = list(sums.of(units))
    assert [lo for lo, _ in got] == list(range(0, queries, sums.step))
    assert np.array_equal(np.vstack([s for _, s in got]), asked @ table)
    assert np.array_equal(sums.slice(np.ones(len(units)), 0), (asked @ held)[: sums.step])


def test_many_queries_meet_few_groups():
    """Each group sends on the first rows of every query: their number must not grow with the tasks where queries are many."""
    assert lexical.spread(730, 154_000, 4096, 12) == (1, 24)
    assert lexical.spread(730, 25_000, 4096, 12) == (4, 7)
    assert lexical.spread(13, 2_500, 4096, 8) == (8, 2)
    for stored, queries, cores in itertools.product((0, 1, 5, 100), (0, 1, 3, 10**6), (1, 4, 12)):
        held, asking = lexical.spread(stored, queries, 4096, cores)
        assert 1 <= held <= max(1, min(stored, cores)) and 1 <= asking <= max(1, queries) and (asking - 1) * held < 4 * cores


def test_neighbours_are_the_same_in_any_groups(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i * i % 11)] if i % 5 else None) for i in range(120)]
    own = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = own.select(F.col("chunk_id").alias("query_id"), "embedding").where("query_id % 3 = 0")
    found = {}
    for block in (4096, 2):
        monkeypatch.setattr(vector, "BLOCK", block)
        found[block] = sorted((r.query_id, r["rank"], r.chunk_id) for r in vector.knn(asked, own, 4).collect())
    with_vector = [(i, np.array(v)) for i, v in rows if v]
    plain = [(q, n, c) for q, v in with_vector if q % 3 == 0 for n, (_, c) in enumerate(sorted((round(float(np.sqrt(((v - w) ** 2).sum())), 10), c) for c, w in with_vector)[:4], 1)]
    assert found[4096] == found[2] == sorted(plain)
