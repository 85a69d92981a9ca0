"""Merkle manifest against a plain version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidyward.llm import queries
from tidyward.llm.manifest import folded, merkle_manifest, proof_text

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """Root of a list of digests, and each one's siblings (before, after) by level."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
    root, above = climb([h(*r) for r in runs], fanout)
    return root, [[("".join(r[:k]), "".join(r[k + 1:]))] + up for r, up in zip(runs, above) for k in range(len(r))]


def brute(rows, fanout=16):
    """(doc_id, source, lang, n_chars, text) -> rows of the query."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        subs[g] = climb([x[2] for x in groups[g]], fanout)
    root, tops = climb([subs[g][0] for g in order], fanout) if order else (None, [])
    out = []
    for g, top in zip(order, tops):
        for (_, _, own, r), path in zip(groups[g], subs[g][1]):
            path = path + top
            node, i = own, r[0]
            if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and r[4] is not None:
                node = leaf(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for before, after in path:
                node = h(before, node, after)
            out.append((i, own, subs[g][0], root, h(*(b + a for b, a in path)), node, node == root))
    return sorted(out, key=str)


def made(df, fanout=16):
    fields = ("doc_id", "source", "lang", "n_chars")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    from tidyward.llm.manifest import leaf_digest
    seen = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(*map(F.col, fields), low))
    got = merkle_manifest(df, fanout=fanout, carry={"seen": seen}).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("siblings")), 256),
        folded(F.coalesce("seen", "leaf"), F.col("siblings")).alias("f"), (F.col("f") == F.col("root")))
    return sorted(map(tuple, got.collect()), key=str)


def test_query_equals_plain_version(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text)
            for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    df = queries.op13_merkle_manifest(spark, SF)
    assert tuple(df.columns) == names
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_hot_group_and_odd_rows(spark, fanout):
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(300)]
    rows += [(i % 7, "ties", None, None, "Same") for i in range(40)]        # repeated ids and rows
    rows += [(None, None, "de", 3, None), (None, None, "de", 3, ""), (5, None, None, None, "ÄÖ-Ü\n" * 9)]
    rows += [(1, "", "en", 1, "A"), (2, "Ä", "en", 1, "-"), (3, "z", None, 0, "x" * 100_000), (4, "1:", "en", 1, "B")]
    rows += [(900 + i, f"s{i}", "en", 1, "Q") for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows],
                               "doc_id bigint, source string, lang string, n_chars bigint, text string, "
                               "leaf string, tree int, at int").repartition(4)
    assert made(df, fanout) == brute(rows, fanout)


def test_small_tables(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    for rows in ([], [(7, None, None, None, "One")], [(1, "a", "en", 1, "A"), (2, "b", "en", 1, "B")]):
        assert made(spark.createDataFrame(rows, schema)) == brute(rows)
    with pytest.raises(ValueError):
        merkle_manifest(spark.createDataFrame([], schema), carry={"root": F.lit(1)})
