"""Nearest neighbours against all distances."""

import itertools
import math

import numpy as np

from tidyward.llm import queries
from tidyward.llm.neighbours import hilbert_keys, nearest

SF = "/root/testdata/sf0.1"


def brute(rows, k, every):
    out = {}
    for q, v in rows:
        if q % every == 0:
            d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in rows if i != q)
            out[q] = d[:k]
    return out


def test_curve_visits_neighbouring_cells():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_all_candidates_of_a_small_table(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).round(1).tolist()) for i in range(80)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(30)]     # equal vectors
    odd = [(500, None), (501, []), (502, [0.0] * 6), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
           (504, [float("nan")] + [1.0] * 5), (510, [float("inf")] + [1.0] * 5), (520, [1.0, 2.0]),
           (None, [1.0] * 6)]
    table = spark.createDataFrame([(*x, "c", 1) for x in rows + odd],
                                  "vec_id bigint, embedding array<float>, class string, nth int")
    got = {}
    for r in nearest(table, k=5, every=10, curves=12, reach=9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    single = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(single, 5, 10)
    assert set(got) == set(want)
    for q, found in want.items():
        assert [i for _, i in got[q]] == [i for _, i in found]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in found], rtol=1e-12)
    few = table.filter("vec_id in (0, 1, 2)")
    assert [(r.rank, r.query_id) for r in nearest(few).orderBy("rank").collect()] == [(1, 0), (2, 0)]
    assert nearest(table.limit(0)).count() == 0 and nearest(table.filter("vec_id = 0")).count() == 0


def test_recall_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in queries.op4_curve_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert len(got[ids[q]]) == 10
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & got[ids[q]])
    assert hits >= 0.95 * 10 * (ids % 100 == 0).sum()


def all_found(spark, x, **how):
    """Whether ``nearest`` gives the ten nearest by all distances, in order, for each query."""
    x = x.astype(np.float32).astype(np.float64)
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<float>")
    got = {}
    for r in nearest(table, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert got[q] == np.lexsort((np.arange(len(x)), d))[:10].tolist()
    assert len(got) == -(-len(x) // 100)


def test_dense_group_of_unequal_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 16))
    x[::2] = x[0] + 1e-4 * r.normal(size=(1500, 16))
    all_found(spark, x, curves=8)


def test_windows_that_see_little(spark):
    """As at large sizes, where windows hold a small share of the table."""
    x = np.random.default_rng(4).normal(size=(4000, 32))
    all_found(spark, x / np.linalg.norm(x, axis=1)[:, None], curves=2)


def test_repeated_ids(spark):
    """Ids on many equal rows, and on several vectors."""
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=8).round(2).tolist()) for i in range(60)]
    rows += [(100, [9.0] * 8)] * 20 + [(i, [9.0] * 8) for i in range(101, 106)] + [(105, [9.0] * 8)] * 3
    rows += [(3, [9.0] * 7 + [8.5]), (101, [8.0] * 8), (101, [8.0] * 8), (2, [0.1] * 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for k in (3, 10):
        got = {}
        for row in nearest(table, k=k, curves=4).orderBy("query_id", "rank").collect():
            got.setdefault(row.query_id, []).append((row.score, row.vec_id))
        want = brute(rows, k, 100)
        assert set(got) == set(want) == {0, 100}
        for q in want:
            assert [i for _, i in got[q]] == [i for _, i in want[q]]
            assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-12)
