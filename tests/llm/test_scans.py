"""Tables whose files are dealt out differently from job to job, as after the loss of an executor."""

import pytest

import corpus_pipeline
from tidyward.llm import bytepair, lines, near, repeats
from tidyward.llm.common import store

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def dealt_anew(spark, monkeypatch):
    """After each stored table the scans have another number of partitions."""
    turns = [0]

    def stored(df):
        out = store(df)
        turns[0] += 1
        spark.conf.set(SPLITS, str(1 + 3 * turns[0]))
        return out

    for module in (bytepair, lines, near, repeats, corpus_pipeline):
        monkeypatch.setattr(module, "store", stored)
    spark.conf.set(SPLITS, "1")
    yield turns
    spark.conf.unset(SPLITS)


@pytest.fixture
def table(spark, docs, tmp_path):
    """40 texts in files of unequal size, with a recurring line, a passage, and near copies."""
    passage = " ".join(f"passage{i}" for i in range(40))
    texts = [f"own{i} " * (5 + 3 * i) + (f"\nall rights reserved here\n{passage} end{i}" if i % 3 == 0 else "")
             for i in range(30)]
    texts += [" ".join(f"w{j}" for j in range(60)) + f" x{i}" for i in range(10)]
    docs(texts).repartition(9, "doc_id").write.parquet(str(tmp_path / "documents"))
    return spark.read.parquet(str(tmp_path / "documents"))


def test_lines(table, dealt_anew):
    out = {r.doc_id: r for r in lines.drop_templates(table).collect()}
    for r in table.collect():
        kept = [x for x in r.text.split("\n") if x != "all rights reserved here"]
        assert out[r.doc_id].text.split("\n") == kept
        assert out[r.doc_id].n_dropped == r.text.count("all rights reserved here")
    assert len(out) == 40 and dealt_anew[0] > 1


def test_repeats(table, dealt_anew):
    out = {r.doc_id: bytes(r.kept).decode() for r in repeats.drop_repeats(table, carry=("lang",)).collect()}
    assert "passage20" in out[0]
    for i in range(3, 30, 3):
        assert "passage20" not in out[i] and out[i].startswith(f"own{i} ") and out[i][-1] == str(i)[-1]
    assert len(out) == 40 and dealt_anew[0] > 1


def test_near(table, dealt_anew):
    groups = {r.doc_id: (r.component_id, r.kept) for r in near.near_groups(table).collect()}
    for i in range(30, 40):
        assert groups[i] == (30, i == 30)
    assert dealt_anew[0] > 1


def test_near_stage(spark, table, dealt_anew):
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, "").collect())
    assert [i for i in kept if i >= 30] == [30] and dealt_anew[0] > 1


def test_bytes_of_long_texts(spark, docs, tmp_path, dealt_anew):
    """Texts of several chunks; some share no border with the next one and are encoded whole."""
    from tidyward.llm.queries import vocabulary
    path = vocabulary("byte_bpe_50k.tiktoken")
    texts = [f"text number {i} " * (3 + 9 * i) if i % 3 else f"{i}" + "x" * (150 + 40 * i) for i in range(24)]
    docs(texts).repartition(7, "doc_id").write.parquet(str(tmp_path / "documents"))
    table = spark.read.parquet(str(tmp_path / "documents"))
    whole = {r.doc_id: bytes(r.ids) for r in bytepair.encode_texts(table, path, chunk=1 << 20).collect()}
    pieces = bytepair.encode_texts(table, path, chunk=100, overlap=20).collect()
    assert {r.doc_id: bytes(r.ids) for r in pieces} == whole and len(pieces) == 24
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in pieces) and dealt_anew[0] > 1
