"""Near duplicates against all pairs, by brute force."""

import random
import re

import numpy as np
import pytest

from tidyward.llm import queries
from tidyward.llm.near import near_groups, shingle_sets, sketches

SF = "/root/testdata/sf0.001"


def sets_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Component (smallest id) of each (id, text), by comparing all pairs."""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)}


def make_texts(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(40))
    out = []
    for _ in range(30):
        base = [r.choice(vocab) for _ in range(r.randint(3, 120))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):      # chains of near copies
            base = list(base)
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = r.choice(vocab)
            out.append("\t".join(base).upper() if r.random() < .3 else " ".join(base))
    out += [passage + " " + " ".join(r.choice(vocab) for _ in range(r.randint(5, 30)))
            for _ in range(60)]               # a shared passage, similar or not
    out += ["", None, " \n ", "one", "One", "one two", "É é", "é É", "x " * 500]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(docs, seed):
    rows = make_texts(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(docs(rows)).collect()}
    assert got == brute(rows)


def test_few_bands_leave_work_to_the_blocks(docs):
    """With one row per band everything that shares a passage meets in the same buckets."""
    rows = make_texts(3)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in near_groups(docs(rows), bands=12, rows=1).collect()}
    assert got == brute(rows)


def test_blocks_of_a_group_cover_all_its_pairs(docs, monkeypatch):
    import tidyward.llm.near as near
    whole = near._block_links
    monkeypatch.setattr(near, "_block_links", lambda *a: whole(*a, block=4))
    rows = make_texts(5)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in near_groups(docs(rows), bands=12, rows=1).collect()}
    assert got == brute(rows)


def test_one_row_of_each_component_stays(docs):
    long = "a b c d e f g h i j k l m n o p"
    rows = [(5, long), (3, long + " q"), (3, long), (3, long), (None, long), (9, None), (9, ""),
            (None, "other words entirely"), (None, "other words entirely")]
    out = near_groups(docs(rows)).collect()
    assert len(out) == len(rows)
    kept = sorted((r.component_id is None, r.component_id or 0) for r in out if r.kept)
    assert kept == [(False, 3), (False, 9), (False, 9), (True, 0)]
    assert near_groups(docs([])).count() == 0


def test_sketch_agrees_as_often_as_the_sets():
    r = np.random.default_rng(0)
    for share in (0.2, 0.75):
        n = 400
        common = int(n * 2 * share / (1 + share))
        pool = r.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
        a, b = pool[:n], pool[n - common:]
        s = sketches(np.concatenate([a, b]), np.array([n, n]), 4096)
        assert abs((s[0] == s[1]).mean() - share) < 0.04
    s = sketches(r.integers(0, 1 << 63, 2, dtype=np.uint64), np.array([1, 1]), 64)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_hash_sets_have_the_size_of_the_word_sets():
    rows = make_texts(4)
    _, n = shingle_sets([(t or "").encode() for _, t in rows])
    assert n.tolist() == [len(sets_of(t)) for _, t in rows]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_minhash(spark, SF).collect()}
    assert got == brute(rows)


def test_shared_boilerplate_is_not_compared_all_with_all(spark, monkeypatch):
    """Texts that share 60 words but are no near copies: comparisons follow from buckets."""
    import random

    from tidyward.llm import near
    rng = random.Random(5)
    shared = " ".join(f"common{i}" for i in range(60))
    rows = [(i, shared + " " + " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60))) for i in range(1000)]
    rows += [(2000 + i, rows[i][1] + " end") for i in range(20)]
    seen = {}
    real = near._block_links

    def counted(rest, sets, percent, block=512):
        sizes = [r["size"] for r in rest.groupBy("bucket").agg(near.F.count(near.F.lit(1)).alias("size")).collect()]
        seen["pairs"], seen["largest"] = sum(n * (n - 1) // 2 for n in sizes), max(sizes, default=0)
        return real(rest, sets, percent, block)

    monkeypatch.setattr(near, "_block_links", counted)
    got = {r.doc_id: r.component_id for r in near.near_groups(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - 2000 if i >= 2000 else i for i, _ in rows}
    # some bucket's coordinates all come from the shared words; no group reaches beyond a bucket
    assert seen["largest"] < 700 and seen["pairs"] < 1020 * 1019 // 2, seen
