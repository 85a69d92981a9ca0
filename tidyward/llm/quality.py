"""Text quality by positive-unlabelled learning.

Trusted positives are rows labelled 1; the unlabelled side is a sample of the table.
The model minimises the non-negative unbiased risk
    prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1)),
which needs no negative examples, only the class prior. Inputs are figures of the whole
text: how letters, case, digits, marks, lines and repeated words are shared out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidyward.llm.common import mix, span_hashes, value_table
from tidyward.llm.near import slices

#: Byte classes whose shares are inputs.
CLASSES = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), b" ", b"\n\t\r\x0b\x0c",
           b".,", b"!", b"?", b"|", b"#*%&$@^~+=<>_\\/", b"'\"-:;()[]{}`"]
_CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _i + 1
_VALUES = value_table(21)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of figures per text; those of an empty text are all 0."""
    n = len(texts)
    raw = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, n) + 1
    firsts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(n), sizes)
    real = np.ones(len(raw), bool)
    real[firsts + sizes - 1] = False
    length = np.maximum(sizes - 1, 1)[:, None]
    kinds = np.bincount(doc[real] * (len(CLASSES) + 1) + _CLASS[raw[real]],
                        minlength=n * (len(CLASSES) + 1)).reshape(n, -1)[:, 1:]
    shares = np.sqrt(kinds / length)

    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before = np.append(True, space[:-1])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    owner = doc[starts]
    words = np.bincount(owner, minlength=n)
    per = np.maximum(words, 1)
    hashes = span_hashes(_VALUES[raw], starts, ends)

    def distinct(h, o):
        """Share of different values in each text."""
        with np.errstate(over="ignore"):
            keyed = np.unique(mix(h ^ mix(o.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
        return np.bincount(o[keyed], minlength=n) / np.maximum(np.bincount(o, minlength=n), 1)

    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    with np.errstate(over="ignore"):
        pairs = mix(hashes[1:] * np.uint64(3) + hashes[:-1])
    inner = owner[1:] == owner[:-1]
    last = raw[ends - 1] if len(ends) else raw[:0]
    marks = (_CLASS[last] >= 7)
    lone = (ends - starts) == 1
    figures = np.stack([
        np.log1p(words) / 8, np.bincount(owner, ends - starts, n) / per / 10,
        distinct(hashes, owner), distinct(pairs[inner], owner[1:][inner]),
        np.bincount(owner[1:][same], minlength=n) / per, np.bincount(owner[marks], minlength=n) / per,
        np.bincount(owner[lone], minlength=n) / per,
        np.log1p(np.bincount(doc[real & (raw == 10)], minlength=n)) / 5, words > 0], axis=1)

    return np.hstack([shares, figures]).astype(np.float32)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 1, rounds: int = 2000,
        rate: float = 0.05, hidden: int = 32) -> dict:
    """Weights of a network with one hidden layer that minimise the non-negative risk."""
    r = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    center, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (positive - center) / scale, (unlabelled - center) / scale
    d = p.shape[1]
    w = [r.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden), r.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    batch = 512
    for t in range(1, rounds + 1):
        x = np.vstack([p[r.integers(0, len(p), batch)], u[r.integers(0, len(u), batch)]])
        h = np.maximum(x @ w[0] + w[1], 0)
        z = h @ w[2] + w[3]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        pos, unl = s[:batch], s[batch:]
        negative = -np.log(1 - unl + 1e-7).mean() + prior * np.log(1 - pos + 1e-7).mean()
        g = np.zeros(2 * batch)
        if negative >= 0:
            g[:batch] = prior * ((pos - 1) - pos) / batch
            g[batch:] = unl / batch
        else:   # the estimate went below 0: step back from the over-fit part only
            g[:batch] = prior * pos / batch
            g[batch:] = -unl / batch
        gh = np.outer(g, w[2]) * (h > 0)
        grads = [x.T @ gh, gh.sum(0), h.T @ g, np.array([g.sum()])]
        step = rate * min(1, 3 * (1 - t / (rounds + 1)))
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            w[i] = w[i] - step * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return {"center": center, "scale": scale, "w": w}


def score(models: list[dict], x: np.ndarray) -> np.ndarray:
    """The mean of the models' probabilities."""
    out = np.zeros(len(x))
    for model in models:
        w = model["w"]
        z = np.maximum((x - model["center"]) / model["scale"] @ w[0] + w[1], 0) @ w[2] + w[3]
        out += 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out / max(1, len(models))


def held_out(column: str, folds: int = 5):
    """Rows that nothing is learnt from: crc32 of the id as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, positives: int = 8_000, unlabelled: int = 16_000,
          models: int = 3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> list[dict]:
    """Models of the chance that a text is labelled 1.

    Learns from about ``positives`` rows labelled 1 and ``unlabelled`` rows of the table,
    chosen by a hash of the id (bounds that don't grow with the tables), none of them held
    out. Labels of 0 count for the class prior only. The prior is the share of 1 among
    the labels in use. Without positives or other rows there are no models.
    """
    usable = labels.filter(~held_out(id_col, folds) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    n, ones = usable.agg(F.count(F.lit(1)), F.count(F.when(F.col(label_col) == 1, 1))).first()
    total = docs.count()
    if not ones or not total:
        return []

    def chosen(most: int, of: int):
        return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 30)) < min(1.0, most / of) * (1 << 30)

    trusted = usable.filter((F.col(label_col) == 1) & chosen(positives, ones)).select(
        F.col(id_col).alias("trusted")).distinct()
    rows = docs.filter(~held_out(id_col, folds)).select(
        F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    # at most ``positives`` ids on average, whatever the labels table holds
    rows = rows.join(F.broadcast(trusted), F.col(id_col) == F.col("trusted"), "left").select(
        "text", F.col("trusted").isNotNull().alias("positive"),
        F.coalesce(chosen(unlabelled, total), F.lit(False)).alias("sampled")).filter("positive OR sampled")

    def figures(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("positive")[a:b], batch.column("sampled")[a:b],
                     pa.array(features(texts[a:b]).tolist(), pa.list_(pa.float32()))],
                    ["positive", "sampled", "x"])

    found = rows.mapInArrow(figures, "positive boolean, sampled boolean, x array<float>").toArrow()
    if not found.num_rows:
        return []
    x = np.array(found.column("x").to_pylist(), np.float64)
    # the same rows in whatever order they came give the same models
    order = np.lexsort(x.T)
    x = x[order]
    is_positive, is_sampled = (found.column(c).to_numpy()[order] for c in ("positive", "sampled"))
    if not is_positive.any() or not is_sampled.any():
        return []
    prior = min(max(ones / n, 0.01), 0.99)
    return [fit(x[is_positive], x[is_sampled], prior, seed=s + 1) for s in range(models)]


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= ``threshold``).

    Scores come from the whole text alone. Null counts as the empty text, which is scored
    like any other; with nothing to learn from every score is 0.5. Rows without an id
    are scored, never learnt from. Columns of ``docs`` named like the new ones are replaced.
    No shuffle: the models are a few thousand numbers.
    """
    from pyspark.sql import types as T
    models = learn(docs, labels, id_col=id_col, text_col=text_col, **options)
    new = ["held_out", "score", "predicted"]
    kept = docs.drop(*new)
    rows = kept.withColumn("held_out", held_out(id_col, options.get("folds", 5)))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def judge(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(text_col).cast("string").to_pylist()]
            scores = [score(models, features(texts[a:b])) if models else np.full(b - a, 0.5)
                      for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())],
                [*batch.schema.names, "score"])

    return rows.mapInArrow(judge, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
