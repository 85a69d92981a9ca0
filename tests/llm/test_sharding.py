"""The permutation, and shards by brute force."""

import zlib

import numpy as np
import pytest

from tidyward.llm import queries
from tidyward.llm.sharding import Permutation, locate, row_at, shard_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_and_its_inverse(n):
    p = Permutation(n, 5)
    out = p.forward(np.arange(n))
    assert sorted(out) == list(range(n)) and p.backward(out).tolist() == list(range(n))
    if n > 100:
        assert out.tolist() != Permutation(n, 6).forward(np.arange(n)).tolist()


def test_place_is_computable_both_ways():
    shard, slot = locate(np.arange(500), 500, 7, 3)
    assert row_at(shard, slot, 500, 7, 3).tolist() == list(range(500))


def test_shards_of_the_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op1_sharding(spark, SF).collect()
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    sizes = {}
    for r in out:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    by_row = sorted(out, key=lambda r: r.row)
    assert [r.doc_id for r in by_row] == sorted(docs)
    shard, slot = locate([r.row for r in by_row], len(out), 16, 20_250_101)
    assert [(r.shard, r.slot) for r in by_row] == list(zip(shard.tolist(), slot.tolist()))
    again = queries.op1_sharding(spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_odd_rows(docs):
    rows = [(None, "a"), (None, None), (3, "x"), (3, "x"), (3, "x"), (2, "")]
    out = shard_rows(docs(rows), shards=4).collect()
    assert sorted(r.row for r in out) == list(range(6))
    assert sorted((r.size, r.text_crc32) for r in out if r.doc_id is None) == [(1, 0), (2, zlib.crc32(b"a"))]
    assert len({(r.shard, r.slot) for r in out}) == 6
    assert shard_rows(docs([])).count() == 0


def test_one_id_on_all_rows_is_spread(docs):
    out = shard_rows(docs([(7, f"text {i % 3}") for i in range(400)])).collect()
    assert sorted(r.row for r in out) == list(range(400))
