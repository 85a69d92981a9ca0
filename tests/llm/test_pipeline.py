"""The pipeline's stages against their brute-force versions, each on its own input."""

import test_lines
import test_near
import test_repeats
from test_tokens import packed_right

import corpus_pipeline
from tidyward.llm.common import store

SF = "/root/testdata/sf0.001"


def rows_of(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, types = docs.columns, docs.dtypes
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)

    judged = store(stages["quality classifier"](spark, docs, SF))
    assert judged.dtypes == types
    before, after = dict(rows_of(docs)), dict(rows_of(judged))
    assert all(before[i] == t for i, t in after.items())
    known = [(i in after, q) for i, q in labels.items()]
    assert sum(kept == bool(q) for kept, q in known) >= 0.95 * len(known)

    lined = store(stages["line dedup"](spark, judged, SF))
    rows = rows_of(judged)
    assert [t for _, t in rows_of(lined)] == test_lines.brute(rows, 10, keep_first=True)

    single = store(stages["MinHash near-dedup"](spark, lined, SF))
    found = test_near.brute(rows_of(lined))
    assert [i for i, _ in rows_of(single)] == sorted(i for i, (_, c) in found.items() if i == c)
    assert len(found) > single.count()

    cut = store(stages["suffix-array dedup"](spark, single, SF))
    want = [b.decode("utf-8", "ignore") for b, _ in test_repeats.brute(rows_of(single), 200, keep_first=True)]
    got = [t for _, t in rows_of(cut)]
    # a span drawn in to whole characters keeps up to three bytes more at either end of each
    assert len(got) == len(want)
    for t, w, (_, spans) in zip(got, want, test_repeats.brute(rows_of(single), 200, keep_first=True)):
        assert len(w) <= len(t) <= len(w) + 6 * len(spans) and (spans or t == w)
    assert cut.columns == columns and all(r.n_chars == len(r.text) for r in cut.collect())

    pieces = stages["packing"](spark, cut, SF).collect()
    index = {d: k for k, (d, _) in enumerate(rows_of(cut))}
    renamed = [type(pieces[0])(**{**r.asDict(), "doc_id": index[r.doc_id]}) for r in pieces]
    packed_right(renamed, got, 4096)


def test_odd_rows_go_through(spark, docs, tmp_path):
    rows = [(1, "some words of a text that is long enough to be kept, maybe. " * 5), (1, None), (None, ""),
            (2, "same"), (2, "same"), (3, "y" * 3000)]
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = stored_stages(spark, tmp_path)
    assert {r.doc_id for r in pieces} == {r.doc_id for r in left.collect()}
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, table, str(tmp_path)).count() >= 4
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0


def stored_stages(spark, folder):
    """What the stages before packing leave."""
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, str(folder)))
    return docs


def test_extra_columns_go_through_unchanged(spark, tmp_path):
    """Columns named like those that the operators make."""
    names = ["kept", "row", "score", "predicted", "held_out", "n_lines", "n_dropped", "spans", "n_bytes", "id", "__row",
             "__own0", "Kept2", "a b", "component_id", "line"]
    rows = [(i, f"A text about number {i} " + " ".join(f"word{(i * 7 + j) % 50}" for j in range(30)), i,
             *[f"{n}-{i}" for n in names]) for i in range(12)] + [(90, None, None, *[None] * len(names))]
    kind = "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, kind)
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    before = {r[0]: tuple(r)[3:] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = store(stage(spark, docs, str(tmp_path)))
        assert out.dtypes == docs.dtypes
        got = out.collect()
        assert got and all(tuple(r)[3:] == before[r[0]] for r in got)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 12
