"""Exact groups by brute force, also with a fingerprint that clashes, and against DuckDB."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidyward.llm import queries
from tidyward.llm.exact import chunk_pattern, exact_groups

SF = "/root/testdata/sf0.01"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def make_texts(seed=1):
    r = random.Random(seed)
    parts = ["Some words, ", "ÄÖ É! ", "line\n", "İıſK ", "x" * 30, "", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(80)]
    texts += [t.upper() if t.isascii() else t for t in texts[:40]] + ["", None, "", "ab", "AB", "y" * 500]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("weak", [False, True])
def test_groups_equal_brute_force(docs, weak):
    rows = make_texts()
    options = {"fingerprint": lambda c: F.char_length(c).cast("bigint") % 3} if weak else {}
    out = {r.doc_id: r for r in exact_groups(docs(rows), least=8, most=40, **options).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    for i, t in rows:
        own, r = groups[lower(t)], out[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), i == max(own))
        assert r.text_sha256 == hashlib.sha256(lower(t).encode()).hexdigest()


def test_chunks_cover_the_text():
    for _, t in make_texts(2):
        assert "".join(re.findall(chunk_pattern(8, 40), t or "")) == (t or "")


def test_one_of_repeated_rows_stays(docs):
    rows = [(5, "Same"), (5, "same"), (3, "same"), (None, "same"), (None, "other"), (None, "other")]
    out = exact_groups(docs(rows)).collect()
    assert [(r.doc_id, r.keep_id) for r in out if r.kept and r.group_size == 4] == [(5, 5)]
    assert sum(r.kept for r in out if r.group_size == 2) == 1
    assert exact_groups(docs([])).count() == 0


def test_query(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(queries.EXPECTED["op2_exact_dedup"]).fetchall())
    assert sorted(map(tuple, queries.op2_exact_dedup(spark, SF).collect())) == want
