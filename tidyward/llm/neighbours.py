"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, differently for each curve, and ordered by
their place on a shifted Hilbert curve. Spark range-partitions and numbers each order;
a query's candidates are its neighbours in a window of every order. Windows are searched
in blocks of rows with vectors of one byte per component. The k-th distance of the best
of all windows bounds a query's search; a last pass over the table, in blocks along the
first curve, compares original vectors and leaves out the stretches of a block that the
bound rules out. So the windows decide what the search costs, never what it finds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidyward.llm.common import number_rows, store


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (one row each, ``bits`` bits a coordinate) on the Hilbert curve."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    # undo excess rotations and reflections, from the highest bit down
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):   # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curves:
    """Projections, shifts and scale of the orders."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int):
        r = np.random.default_rng(seed)
        width = sample.shape[1]
        self.bits, dims = bits, min(dims, width)
        self.center = sample.mean(0)
        self.planes = [np.linalg.qr(r.normal(size=(width, width)))[0][:, :dims] for _ in range(curves)]
        spread = ((sample - self.center) @ self.planes[0]).std()
        self.scale = spread if spread > 0 else 1.0
        self.shifts = r.random((curves, dims)) - 0.5

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        y = (vectors - self.center) @ self.planes[curve] / self.scale
        cells = np.floor(((y + self.shifts[curve]) / 8 + 0.5) * (1 << self.bits))
        return hilbert_keys(np.clip(cells, 0, (1 << self.bits) - 1).astype(np.int64), self.bits)


def distance(a: str, b: str) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(F.col(a), F.col(b), lambda x, y: (x.cast("double") - y.cast("double"))
                         * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, curves: int = 64, dims: int = 16,
            bits: int = 3, reach: float = 1.0, sample: int = 4096, seed: int = 1,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score (distance).

    Queries are the rows whose id is divisible by ``every``; candidates are all other rows.
    They are the nearest by all distances, whatever the windows held. Ties go to the smaller id.
    Vectors that are null, zero, or hold null or non-finite
    components, those of another length than the commonest, and rows without an id take no
    part. Equal vectors form one class, searched once, whose smallest ids answer for it. A
    window reaches ``reach`` times the root of the number of classes to either side. Center
    and scale come from about ``sample`` vectors; every vector is indexed. Rows of a
    repeated id are candidates each, but none is a candidate of a query of its own id; queries of one
    id share one list.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter(
        F.col("id").isNotNull() & F.forall(
            "vec", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
        & F.exists("vec", lambda x: x != 0))
    lengths = given.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(
        F.desc("rows"), F.desc("n")).first()
    width = lengths["n"] if lengths else 0
    given = given.filter(F.size("vec") == width)

    # k rows of each of the k + 1 smallest ids of a class are all that any query can need
    order = Window.partitionBy("vec").orderBy("id")
    members = store(given.groupBy("vec", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("rows"))
                    .withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1))
    # classes are numbered by their smallest id, as ties go by it; an id may stand on several vectors
    classes, _ = number_rows(members.filter("nth = 1").select("id", "vec"), ["id", F.xxhash64("vec")], "class")
    classes = store(classes.select("class", "vec"))
    members = members.join(classes, "vec").select("class", "id", "rows")
    n = classes.count()
    queries = store(given.filter(F.col("id") % every == 0).distinct().join(classes, "vec").select(
        F.col("id").alias("query_id"), "class"))
    if n:
        share = min(1.0, sample / n)
        some = classes.filter(F.pmod(F.xxhash64("class"), F.lit(1 << 20)) < share * (1 << 20)).select("vec")
        drawn = some.toArrow().column("vec").to_pylist() or [classes.first()["vec"]]
        exact = _exact(*_search(classes, queries, Curves(np.array(drawn, np.float64), curves, dims, bits, seed),
                                n, max(k, math.ceil(reach * n ** 0.5)), k), classes, queries, n, width, k)
    else:
        exact = spark.createDataFrame([], "q bigint, class bigint, score double")

    own = queries.select(F.col("class").alias("q"), "class", F.lit(0.0).alias("score")).distinct()
    best = Window.partitionBy("q").orderBy("score", "class")
    exact = exact.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).drop("nth").unionByName(own)
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return queries.withColumnRenamed("class", "q").join(exact, "q").join(
        members.select("class", F.explode(F.array_repeat("id", F.col("rows").cast("int"))).alias("vec_id")),
        "class").filter("vec_id <> query_id").withColumn(
        "rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(classes: DataFrame, queries: DataFrame, curves: Curves, n: int, reach: int,
            k: int) -> tuple[DataFrame, DataFrame]:
    """Classes (q, class) that windows of the orders hold nearest to the queries' classes, and
    the places (class, row) of all classes in the first order."""
    asked = queries.select("class").distinct().withColumn("asked", F.lit(True))
    flagged = classes.join(asked, "class", "left").withColumn("asked", F.col("asked").isNotNull())

    def places(batches):
        for batch in batches:
            x = np.array(batch.column("vec").to_pylist(), np.float64)
            if not len(x):
                continue
            x = x.reshape(batch.num_rows, -1)
            size = np.maximum(np.abs(x).max(1), 1e-300)
            code = pa.array([c.tobytes() for c in np.rint(x / size[:, None] * 127).astype(np.int8)], pa.binary())
            for c in range(len(curves.planes)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), pa.array(curves.keys(x, c)),
                     batch.column("class"), batch.column("asked"), pa.array(size), code],
                    ["curve", "key", "class", "asked", "size", "code"])

    index, _ = number_rows(flagged.mapInArrow(
        places, "curve int, key bigint, class bigint, asked boolean, size double, code binary"),
        ["curve", "key", F.xxhash64("class")])
    # every curve numbers each class once, so windows end where the curve does
    block = 8 * reach
    index = index.withColumn("block", F.floor(F.col("row") / block))
    first = F.greatest(F.col("row") - reach, F.col("curve") * F.lit(n).cast("long"))
    last = F.least(F.col("row") + reach, (F.col("curve") + 1) * F.lit(n).cast("long") - 1)
    wanted = index.filter("asked").select(
        F.explode(F.sequence(F.floor(first / block), F.floor(last / block))).alias("block"),
        first.alias("first"), last.alias("last"), F.col("row").alias("own"), F.col("class").alias("q"),
        F.col("size").alias("q_size"), F.col("code").alias("q_code"))
    most = k + 6

    def vectors_of(table, prefix=""):
        code = np.frombuffer(b"".join(table.column(prefix + "code").to_pylist()), np.int8)
        size = (table.column(prefix + "size").to_numpy() / 127).astype(np.float32)
        return code.reshape(table.num_rows, -1).astype(np.float32) * size[:, None]

    def near(left, right):
        empty = pa.table({"q": pa.array([], pa.int64()), "class": pa.array([], pa.int64()),
                          "about": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        right = right.sort_by("row")
        rows, names = right.column("row").to_numpy(), right.column("class").to_numpy()
        x, qs, out = vectors_of(right), vectors_of(left, "q_"), []
        ends = zip(left.column("q").to_pylist(), left.column("own").to_pylist(),
                   left.column("first").to_pylist(), left.column("last").to_pylist(), qs)
        for q, row, a, b, v in ends:
            lo, hi = np.searchsorted(rows, a), np.searchsorted(rows, b, "right")
            d = ((x[lo:hi] - v) ** 2).sum(1)
            d[rows[lo:hi] == row] = np.inf
            best = np.argpartition(d, most)[:most] if len(d) > most else np.arange(len(d))
            best = best[np.isfinite(d[best])]
            out.append((np.full(len(best), q), names[lo:hi][best], d[best].astype(np.float64)))
        return pa.table({name: np.concatenate(v) for name, v in zip(("q", "class", "about"), zip(*out))})

    met = wanted.groupBy("block").cogroup(index.groupBy("block")).applyInArrow(
        near, "q bigint, class bigint, about double")
    order = Window.partitionBy("q").orderBy("about", "class")
    return met.groupBy("q", "class").agg(F.min("about").alias("about")).withColumn(
        "nth", F.row_number().over(order)).filter(F.col("nth") <= 4 * k).select("q", "class"), index.filter(
        "curve = 0").select("class", "row")


def _exact(found: DataFrame, places: DataFrame, classes: DataFrame, queries: DataFrame, n: int, width: int,
           k: int) -> DataFrame:
    """The ``k`` nearest other classes of a query's class and more: q, class, score.

    ``found`` only bounds the search. Blocks hold about 4 million components at most, and
    slices of the queries a quarter of that; each block meets each slice in one small task.
    """
    asked = queries.select(F.col("class").alias("q")).distinct().join(
        classes.select(F.col("class").alias("q"), F.col("vec").alias("q_vec")), "q")
    best = Window.partitionBy("q").orderBy("score")
    bounds = found.join(asked, "q").join(classes, "class").select(
        "q", distance("q_vec", "vec").alias("score")).withColumn("nth", F.row_number().over(best)).filter(
        F.col("nth") == k).select("q", F.col("score").alias("bound"))
    asked = store(asked.join(bounds, "q", "left"))
    blocks = max(1, min(12, n // (4 * k)), -(-n * width // (1 << 22)))
    slices = max(1, -(-asked.count() * width // (1 << 20)))

    def of(count):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))

    table = places.join(classes, "class").select(
        F.floor(F.col("row") * blocks / F.lit(n)).alias("block"), of(slices).alias("slice"), "row", "class", "vec")
    wanted = asked.withColumn("slice", F.pmod(F.xxhash64("q"), F.lit(slices).cast("bigint"))).withColumn(
        "block", of(blocks))

    def matrix(column):
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(
            len(column), -1)

    def compare(left, right):
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            right = right.sort_by("row")
            names, x = right.column("class").to_numpy(), matrix(right.column("vec"))
            q, v = left.column("q").to_numpy(), matrix(left.column("q_vec"))
            limit = left.column("bound").fill_null(float("inf")).to_numpy()
            stretches = []
            for a in range(0, len(x), 1024):
                center = x[a:a + 1024].mean(0)
                moved = x[a:a + 1024] - center
                stretches.append((a, center, moved, (moved * moved).sum(1)))
            for a in range(0, len(q), 256):
                out.append(nearest_of(names, x, stretches, q[a:a + 256], v[a:a + 256], limit[a:a + 256], k))
        return pa.table({name: np.concatenate(v) for name, v in zip(("q", "class", "score"), zip(*out))})

    return wanted.groupBy("block", "slice").cogroup(table.groupBy("block", "slice")).applyInArrow(
        compare, "q bigint, class bigint, score double")


def nearest_of(names: np.ndarray, x: np.ndarray, stretches: list, q: np.ndarray, v: np.ndarray,
               limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For queries ``q`` at ``v``, the ``k`` nearest of the rows ``names`` at ``x`` that are no farther
    than ``limit``: query, row's name, distance. ``stretches`` are (first row, center, rows less
    the center, their squared lengths)."""
    near = limit * (1 + 1e-14)
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)     # query, row, distance
    rounding = 8 * (x.shape[1] + 16) * np.finfo(np.float64).eps
    with np.errstate(over="ignore", invalid="ignore"):
        for first, center, moved, squares in stretches:
            w = v - center
            lengths, radius = (w * w).sum(1), squares.max()
            # no row of the stretch is nearer than the sphere around it
            gap = np.sqrt(lengths) - np.sqrt(radius)
            live = np.flatnonzero(~(gap > near + rounding * np.sqrt(lengths + radius)))
            if not len(live):
                continue
            about = lengths[live, None] + squares - 2 * (w[live] @ moved.T)
            slack = near[live] * near[live] * (1 + 1e-14) + rounding * (lengths[live] + radius)
            # what overflows is compared below
            i, j = np.nonzero(~(about > slack[:, None]))
            i, j = live[i], j + first
            other = names[j] != q[i]
            i, j = i[other], j[other]
            total = np.zeros(len(i))
            for c in range(x.shape[1]):     # in the order of ``distance``, for the same last bit
                d = v[i, c] - x[j, c]
                total += d * d
            score = np.sqrt(total)
            inside = score <= near[i]
            if not inside.any():
                continue
            i, j, score = (np.concatenate([a, b[inside]]) for a, b in zip(held, (i, j, score)))
            order = np.lexsort((names[j], score, i))
            i, j, score = i[order], j[order], score[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            near[i[nth == k - 1]] = np.minimum(near[i[nth == k - 1]], score[nth == k - 1])
            held = i[nth < k], j[nth < k], score[nth < k]
    return q[held[0]], names[held[1]], held[2]
