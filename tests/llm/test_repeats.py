"""Repeated strings against a table of all windows, by brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidyward.llm import queries
from tidyward.llm.repeats import SuffixOrder, drop_repeats, previous_factors, previous_smaller, sliding_min

SF = "/root/testdata/sf0.001"


def brute(rows, length, keep_first=False):
    """Kept bytes and maximal removed spans of each row."""
    seen = {}
    for k, (doc, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])):
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i:i + length], []).append((k, i))
    out = []
    for k, (doc, text) in enumerate(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            at = seen[raw[i:i + length]]
            if len(at) > 1 and (not keep_first or at[0] != (k, i)):
                gone[i:i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((bytes(b for b, g in zip(raw, gone) if not g), spans))
    return out


def make_texts(seed, n=40):
    r = random.Random(seed)

    def some(k):
        return "".join(r.choice("abcdeé \n") for _ in range(k))
    shared = [some(r.randint(10, 80)) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [some(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), some(r.randint(0, 30))]
        out.append("".join(parts))
    out += [out[3]] * 5 + ["", None, "a" * 90, "ab" * 60, "a" * 40, "x" * 19, "x" * 20, "x" * 21, "日本" * 30]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [500, 1])
def test_equal_to_brute_force(docs, keep_first, hot):
    rows = make_texts(1)
    got = {r.doc_id: (bytes(r.kept), [(s["from"], s["to"]) for s in r.spans], r.n_bytes) for r in drop_repeats(
        docs(rows), length=20, keep_first=keep_first, whole_characters=False, gram=8, hot=hot).collect()}
    for i, (kept, spans) in enumerate(brute(rows, 20, keep_first)):
        assert got[i] == (kept, spans, len((rows[i][1] or "").encode())), rows[i]


def test_first_occurrence_stays(docs):
    line = "the same passage of text, "
    rows = [(7, "b" + line + "tail"), (2, "a" + line), (None, line), (7, "b" + line + "tail")]
    out = drop_repeats(docs(rows), length=20, gram=8).collect()
    assert sum(bytes(r.kept).decode().count(line) for r in out) == 1
    assert [bytes(r.kept).decode() for r in out if r.doc_id is None] == [line]
    assert drop_repeats(docs([]), length=20, gram=8).count() == 0


def test_whole_characters_can_be_read(docs):
    rows = make_texts(2)
    for r in drop_repeats(docs(rows), length=20, gram=8, keep_first=False).collect():
        bytes(r.kept).decode()


def test_long_texts_go_in_blocks(docs, monkeypatch):
    import tidyward.llm.repeats as R
    rows = make_texts(3, 20)
    rows.append((len(rows), "".join(t or "" for _, t in rows)))
    from tidyward.llm.repeats import find_runs
    whole = find_runs([rows[-1][1].encode()], 20, 8)
    assert sum(whole[2]) == len(rows[-1][1].encode()) - 19
    monkeypatch.setattr(R, "BLOCK", 100)
    got = {r.doc_id: bytes(r.kept) for r in R.drop_repeats(
        docs(rows), length=20, keep_first=False, whole_characters=False, gram=8).collect()}
    assert [got[i] for i in range(len(rows))] == [b[0] for b in brute(rows, 20)]


def test_parts():
    r = np.random.default_rng(0)
    v = r.integers(0, 50, 300)
    assert sliding_min(v, 7).tolist() == [v[i:i + 7].min() for i in range(294)]
    p = r.permutation(200)
    want = [max((j for j in range(i) if p[j] < p[i]), default=-1) for i in range(200)]
    assert previous_smaller(p).tolist() == want
    raw = r.integers(97, 99, 120).astype(np.uint8)
    text, starts = raw.tobytes(), np.arange(100)
    order = SuffixOrder(raw, np.zeros(120, int), 20)
    earlier, beside = previous_factors(order, starts, starts)

    def common(a, b):
        return next((k for k in range(20) if text[a + k] != text[b + k]), 20)
    assert earlier.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(100)]
    assert beside.tolist() == [max(common(i, j) for j in range(100) if j != i) for i in range(100)]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op3_suffix_repeats(spark, SF).collect()}
    removed = 0
    for (doc, text), (kept, spans) in zip(rows, brute(rows, 200)):
        r = got[doc]
        removed += len(spans)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(text.encode()), len(text.encode()) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert removed
