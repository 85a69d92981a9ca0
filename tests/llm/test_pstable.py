"""Near duplicates of embeddings against all pairs."""

import numpy as np
import pytest

from tidyward.llm.pstable import hang, hit_rate, near_vectors, table_sizes


def brute(rows, cosine=0.98):
    """(id, vector, label) -> {row: (links, component)} by all pairs."""
    def fine(v, lab):
        return bool(lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v))
    links = {i: set() for i in range(len(rows))}
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and fine(v, a) and fine(w, b) and a == b and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] - seen if not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def found(spark, rows, **how):
    table = spark.createDataFrame([(i, v, lab, 1, 2) for i, v, lab in rows],
                                  "vec_id bigint, embedding array<double>, label int, n int, c int").repartition(3)
    got = near_vectors(table, **how).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def test_rates():
    r = np.random.default_rng(0)
    for d in (0.2, 1.4):
        a = r.normal(size=400_000) * d
        assert abs((np.floor(a / 2 + (u := r.random(400_000))) == np.floor(u)).mean() - hit_rate(2, d)) < 0.003
    k, tables = table_sizes(5000, 0.98, 2, 1e-4, 0.5)
    assert (1 - hit_rate(2, 0.2) ** k) ** tables <= 1e-4 and 5000 * hit_rate(2, 2 ** 0.5) ** k <= 0.5


def test_hang_joins_trees():
    root = np.arange(8)
    hang(root, np.array([1, 7, 5, 3]), np.array([7, 5, 2, 4]))
    assert root.tolist() == [0, 1, 1, 3, 3, 1, 6, 1]


@pytest.mark.parametrize("held", [1 << 17, 600])
def test_groups_of_all_kinds(spark, held):
    """Noise at the threshold, a dense group of unequal vectors and one of equal vectors; small
    blocks, so that buckets are dealt out."""
    r = np.random.default_rng(5)
    rows, base = [], r.normal(size=(8, 16))
    for i in range(300):
        v = base[i % 8] + r.normal(size=16) * (0.12 if i % 8 else 0.08) * np.linalg.norm(base[i % 8]) / 4
        rows.append((i, v.tolist(), i % 8 % 3))
    rows += [(1000 + i, (base[0] + 0.01 * r.normal(size=16)).tolist(), 0) for i in range(200)]
    rows += [(2000 + i, base[1].tolist(), 1) for i in range(150)]
    want = brute(rows)
    assert len({c for _, n, c in want if n}) > 5 and max(n for _, n, _ in want) > 200
    assert found(spark, rows, held=held, miss=1e-9) == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 1), (2, [2.0, 4.0, 6.0], 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [], 1),
            (7, [0.0] * 3, 1), (8, [1.0, None, 3.0], 1), (9, [1.0, nan, 3.0], 1), (10, [inf, 2.0, 3.0], 1),
            (11, [1.0, 2.0], 1), (12, [1.0, 2.0], 1), (None, one, 1), (None, [5.0, -1.0, 0.0], 3),
            (None, [5.0, -1.0, 0.0], 3), (2, one, 1), (13, [1e300, 2e300, 3e300], 1), (14, [-0.0, 1.0, 0.0], 4),
            (15, [0.0, 1.0, 0.0], 4), (16, [-1.0, -2.0, -3.0], 1), (17, [1e-300, 2e-300, 3e-300], 1)]
    got = found(spark, rows, miss=1e-9)
    assert got == brute(rows)
    assert (1, 5, 1) in got and (16, 0, 16) in got
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert near_vectors(table).count() == 0


def test_links_of_many_vectors(spark):
    """The query's parameters on clusters whose links are near the threshold: recall of links."""
    r = np.random.default_rng(6)
    base = r.normal(size=(150, 64))
    x = np.repeat(base, 20, axis=0) + r.normal(size=(3000, 64)) * 0.135
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)],
                                  "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_vectors(table).collect()}
    want = np.zeros(len(x), int)
    for lab in (0, 1):
        at = np.arange(lab, len(x), 2)
        want[at] = (x[at] @ x[at].T >= 0.98).sum(1) - 1
    have = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 5000 and (have <= want).all() and have.sum() >= 0.999 * want.sum()
