"""Positive-unlabelled learning: held-out accuracy, and what is never learnt from."""

import random
import zlib

import numpy as np

from tidyward.llm import queries
from tidyward.llm.quality import features, fit, score, score_quality

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = queries.op9_quality(spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1
               and r.predicted == int(r.score >= 0.3) for r in out)
    known = [(r.score, r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert sum(p == q for _, p, q in known) >= 0.95 * len(known)
    good, bad = ([s for s, _, q in known if q == x] for x in (1, 0))
    wins = np.mean([a > b for a in good for b in bad])
    assert wins > 0.98


def test_held_out_labels_and_zero_labels_do_not_matter(spark, docs):
    r = random.Random(1)
    texts = [" ".join(r.choice(["one", "two", "three", "of", "the"]) for _ in range(30)) if i % 3
             else "!! ## " * 20 for i in range(60)]
    table = docs(texts)
    made = [(i, 1) for i in range(60) if i % 3 and i % 2] + [(0, 0), (3, 0)]
    flipped = made + [(i, 0) for i in range(60) if held(i) and (i, 1) not in made]
    one, two = (sorted((x.doc_id, x.score) for x in score_quality(
        table, spark.createDataFrame(rows, "doc_id bigint, quality int")).collect())
        for rows in (made, flipped))
    assert one == two


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (6, 0)], "doc_id bigint, quality int")
    rows = [(1, "some text"), (1, "some text"), (None, "x"), (3, None), (4, ""), (5, "w" * 100_000)]
    out = score_quality(docs(rows), labels).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out) and out[0].lang == "en"
    none = labels.limit(0)
    assert {r.score for r in score_quality(docs(rows), none).collect()} == {0.5}
    assert score_quality(docs([]), labels).count() == 0


def test_fit_needs_no_negatives():
    r = np.random.default_rng(2)
    good, bad = r.normal(1, 0.5, (800, 3)), r.normal(-1, 0.5, (200, 3))
    models = [fit(good[:400], np.vstack([good[400:], bad[:100]]), 0.8, rounds=500)]
    assert (score(models, good) > 0.5).mean() > 0.95 and (score(models, bad) < 0.5).mean() > 0.95


def test_features_are_of_each_text_alone():
    texts = [b"", b"a", b"The same, same words.\nAgain | x!", "ñandú ñandú".encode(), b" \n "]
    together = features(texts)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], features([t])[0])
