"""Near duplicates of embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so a cosine is a Euclidean distance. In each of several tables, rounded-down
random projections put a vector in a bucket; vectors of one label and bucket are compared
in double precision. A pair is judged in the first table in which it shares a bucket, so links
are counted once, and no pair is ever written: a comparison returns, for each vector, how
many others it links to and one of them. Equal vectors form one class, compared once.

A bucket larger than a block is dealt into blocks by a hash, and each two blocks meet in one
small task, so nothing is cut short and a group that holds a third of all rows is spread. Its
comparisons grow with the square of its unequal vectors, as exact link counts need.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidyward.llm.common import ragged, store
from tidyward.llm.graph import components


def hit_rate(width: float, distance: float) -> float:
    """The probability that one projection, cut in steps of ``width``, puts two vectors at ``distance``
    in the same step (Gaussian projections)."""
    t = width / distance
    tail = math.erfc(t / math.sqrt(2))          # both tails of the normal law
    return 1 - tail - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def table_sizes(n: int, cosine: float, width: float, miss: float, strays: float) -> tuple[int, int]:
    """Projections per table and number of tables for ``n`` vectors.

    A vector meets about ``strays`` unrelated (orthogonal) ones per table, whatever n is, and two
    vectors at the threshold share no table with probability ``miss``.
    """
    near, far = hit_rate(width, math.sqrt(2 - 2 * cosine)), hit_rate(width, math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2) / strays) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-near ** k)))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, width: float = 2.0, miss: float = 1e-4,
                 strays: float = 0.5, held: int = 1 << 17, seed: int = 11, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Two rows are linked if their labels are equal and not null, their vectors have the same length and the
    cosine of these in double precision is at least ``cosine``. Vectors that are null, empty, zero, or
    hold null or non-finite components, and rows without a label, link with nothing.
    n_links counts other rows, equal vectors and repeated ids each; component_id is the
    smallest id reachable, null ids count only where there is no other; kept says whether the id
    is that one, so repeated ids are kept or dropped together. Projections per table and tables follow from the
    count of the largest label (``table_sizes``); a pair at the threshold is missed with
    probability ``miss``, closer ones less often. A block of a bucket has about ``held`` components.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    fine = F.coalesce(F.col("label").isNotNull() & F.forall(
        "vec", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
        & F.exists("vec", lambda c: c != 0), F.lit(False))
    classes = store(given.filter(fine).groupBy("label", "vec").agg(
        F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("c", F.monotonically_increasing_id()))
    most, longest = classes.groupBy("label", F.size("vec").alias("long")).count().agg(
        F.max("count"), F.max("long")).first()
    k, tables = table_sizes(most or 0, cosine, width, miss, strays)
    buckets = store(_buckets(classes, k, tables, width, seed))
    found = store(_compare(classes, buckets, cosine, max(32, held // (longest or 1))))
    roots = store(components(found.filter("root <> c").select(F.col("c").alias("a"), F.col("root").alias("b")))
                  .withColumnRenamed("node", "c"))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    named = classes.select("label", "vec", "low", "n", "c").join(counts, "c", "left").join(
        roots, "c", "left").select("label", "vec", "low", F.coalesce("root", "c").alias("root"),
                                   (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = store(named.join(lows, "root").select("label", "vec", "n_links", "component_id"))
    kind = given.schema["id"].dataType
    linked = given.filter(fine).join(groups, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = given.filter(~fine).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("component_id").cast(kind).alias("component_id"),
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of equal length, normalised in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1)[:, None]       # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1))[:, None]


def _by_length(column: pa.Array):
    """Row numbers of each length of the lists of ``column``."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return [np.flatnonzero(sizes == s) for s in np.unique(sizes)]


def _buckets(classes: DataFrame, k: int, tables: int, width: float, seed: int) -> DataFrame:
    """c, label, keys: a class's bucket in each table."""
    def hashed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.zeros((batch.num_rows, tables), np.int64)
            vec = batch.column("vec")
            for rows in _by_length(vec):
                u = unit_rows(vec.take(pa.array(rows)))
                r = np.random.default_rng([seed, u.shape[1]])
                planes, shift = r.normal(size=(u.shape[1], tables * k)), r.random(tables * k)
                for a in range(0, len(rows), 1024):
                    steps = np.floor(u[a:a + 1024] @ planes / width + shift).astype(np.int64)
                    keys[rows[a:a + 1024]] = _folded(steps.reshape(-1, tables, k), u.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), batch.column("label"), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(keys) + 1) * tables, pa.int32()), pa.array(keys.ravel()))],
                ["c", "label", "keys"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("c", "label", "vec").mapInArrow(hashed, f"c bigint, label {label}, keys array<bigint>")


def _folded(steps: np.ndarray, start: int) -> np.ndarray:
    """One 64-bit key for each last axis. A chance equality only costs a comparison."""
    key = np.full(steps.shape[:2], start, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(steps.shape[2]):
            key = (key ^ steps[:, :, i].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _compare(classes: DataFrame, buckets: DataFrame, cosine: float, block: int) -> DataFrame:
    """c, links, root: for a class in a bucket, the rows it is linked to there, and the smallest class
    that it reaches there."""
    spread = buckets.select("c", "label", F.posexplode("keys").alias("t", "bucket"))
    shared = spread.groupBy("label", "t", "bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # only keys move until a bucket is known to hold several classes
    dealt = spread.join(shared, ["label", "t", "bucket"]).withColumn(
        "blocks", F.ceil(F.col("size") / block)).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "c", "t", "own", F.xxhash64("label", "t", "bucket", F.least("own", "other"), F.greatest("own", "other"))
        .alias("meeting"), (F.least("own", "other") == F.greatest("own", "other")).alias("same"))
    # meetings of a few rows share a task; ``parts`` keeps what is at hand at once small
    rows = store(pairs)
    parts = max(1, -(-rows.count() // (2 * block)))
    placed = rows.join(classes.select("c", "vec", "n"), "c").join(buckets, "c").withColumn(
        "part", F.pmod("meeting", F.lit(parts)))

    def compare(table):
        table = table.combine_chunks().sort_by([("meeting", "ascending"), ("c", "ascending")])
        vec = table.column("vec").combine_chunks()
        names, n = table.column("c").to_numpy(), table.column("n").to_numpy()
        t, own, same = (table.column(x).to_numpy() for x in ("t", "own", "same"))
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(names), -1)
        labels, sizes = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy(), \
            vec.value_lengths().to_numpy()
        meeting = table.column("meeting").to_numpy()
        # rows of one meeting by hash, but of two buckets, are told apart as well
        new = np.zeros(len(names), bool)
        new[:1] = True
        new[1:] = meeting[1:] != meeting[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(names))
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        u = np.zeros((len(names), int(sizes.max(initial=0))))
        for rows in _by_length(vec):
            x = unit_rows(vec.take(pa.array(rows)))
            u[rows, :x.shape[1]] = x

        def judge(i, j):
            """Take in pairs of rows that are similar enough."""
            fresh = (labels[i] == labels[j]) & (sizes[i] == sizes[j]) & (t[i] == t[j]) & (same[i] | (own[i] != own[j]))
            i, j = i[fresh], j[fresh]
            fresh = keys[i, t[i]] == keys[j, t[j]]
            for s in range(int(t[i].max(initial=0))):      # judged in an earlier table
                fresh &= (keys[i, s] != keys[j, s]) | (t[i] <= s)
            i, j = i[fresh], j[fresh]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            hang(root, i, j)

        small = ends - starts <= 64
        # few rows: their pairs, gathered; many rows: one product of matrices
        inside = np.repeat(np.where(small, ends, 0), ends - starts)
        count = np.maximum(inside - np.arange(len(names)) - 1, 0)
        upto = np.cumsum(count)
        a = 0
        while a < len(names):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + 32768, "right")))
            i = np.repeat(np.arange(a, b), count[a:b])
            j = ragged(np.arange(a, b) + 1, count[a:b])
            close = np.einsum("ij,ij->i", u[i], u[j]) >= cosine
            judge(i[close], j[close])
            a = b
        for first, last in zip(starts[~small], ends[~small]):
            for a in range(first, last, 256):
                i, j = np.nonzero(u[a:min(a + 256, last)] @ u[a:last].T >= cosine)
                later = j > i
                i, j = i[later] + a, j[later] + a
                for x in range(0, len(i), 65536):
                    judge(i[x:x + 65536], j[x:x + 65536])
        met = np.flatnonzero(links)
        return pa.table({"c": names[met], "links": links[met], "root": names[root[met]]})

    return placed.groupBy("part").applyInArrow(compare, "c bigint, links bigint, root bigint")


def hang(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of rows i and j; ``root`` leads each row to the first of its tree."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
