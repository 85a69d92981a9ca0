"""Near duplicates by fast similarity sketches, banding and exact verification.

A sketch is filled in rounds. In each of the first t rounds every shingle is thrown
into one of the t bins and a bin keeps its smallest value; a bin that stays empty is
filled in a round of its own at the latest. So every coordinate fills, and two sets
agree on a coordinate with the probability of their Jaccard similarity.

Documents with equal shingle sets form one class. Bands of coordinates put classes in
buckets; each class of a bucket is compared with the bucket's first on full sets, and
links are joined to components. What this leaves - classes that share a bucket and are in
different components - is compared bucket by bucket, in blocks, on full sets as well. So no bucket is
cut short, no pairs are written out, and classes that share no bucket are never compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidyward.llm.common import BASE, byte_batches, mix, ragged, span_hashes, store, value_table
from tidyward.llm.graph import components

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
VALUE_BITS = 55
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUES = value_table(7)


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and the count of each.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; a text of
    fewer words than a shingle has the whole sequence as its one shingle.
    """
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    firsts = np.cumsum(sizes) - sizes
    space = _SPACE[raw]
    before = np.append(True, space[:-1])
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    hashes = span_hashes(_VALUES[raw], starts, ends)
    owner = np.searchsorted(firsts, starts, "right") - 1
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    take = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    at = ragged(first, take)
    width = np.minimum(n, words)
    with np.errstate(over="ignore"):
        shingles = np.repeat(width.astype(np.uint64), take) * np.uint64(BASE)
        for k in range(words):
            has = np.repeat(width > k, take)
            word = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else hashes
            shingles = np.where(has, mix(shingles + word), shingles)
    ends = np.cumsum(take)
    sets = [np.unique(shingles[e - c:e]) for e, c in zip(ends, take)]
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), counts


def sketches(elements: np.ndarray, counts: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """One row of ``size`` coordinates per set; a row of an empty set means nothing."""
    n = len(counts)
    out = np.full(n * size, FULL)
    owner = np.repeat(np.arange(n), counts)
    open_sets = counts > 0
    mask = np.uint64((1 << VALUE_BITS) - 1)
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))
        for turn in range(2 * size):
            if not open_sets.any():
                break
            live = open_sets[owner]
            elements, owner = elements[live], owner[live]
            h = mix(elements ^ seeds[turn])
            if turn < size:
                bins = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            else:
                bins = turn - size
            np.minimum.at(out, owner * size + bins,
                          np.uint64(turn << VALUE_BITS) | (h & mask))
            open_sets = open_sets & (out.reshape(n, size) == FULL).any(axis=1)
    return out.reshape(n, size)


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    n, size = sketch.shape
    parts = sketch.reshape(n, bands, size // bands)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(BASE), (n, bands))
        for k in range(size // bands):
            keys = mix(keys + parts[:, :, k])
    return keys.view(np.int64)


def near_groups(docs: DataFrame, percent: int = 75, words: int = 5, bands: int = 36, rows: int = 4,
                id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, row, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle
    sets; component_id is the smallest id reachable. ``kept`` is true for one row of each
    component, one with that id. Null and blank texts have no shingles and stay alone;
    null ids count as larger than all others. A pair at the threshold of 0.75 shares no
    band of the default 36 x 4 with probability 1.1e-6. Rows are numbered
    and stored once, so the frame is read once; ``row_col`` names a stored frame's own row
    numbers instead. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(
        F.col(id_col).alias("id"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        text.cast("binary").alias("text"))
    source = source if row_col else store(source)
    kind = source.schema["id"].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                elements, n = shingle_sets(texts[a:b], words)
                keys = band_keys(sketches(elements, n, bands * rows), bands)
                ends = np.cumsum(n)
                marks = [hashlib.blake2b(elements[e - c:e].tobytes(), digest_size=16).digest()
                         for e, c in zip(ends, n)]
                flat = pa.array(keys.ravel(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[a:b], batch.column("row")[a:b], pa.array(n, pa.int64()),
                     pa.array(marks, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), flat)],
                    ["id", "row", "n_shingles", "mark", "bands"])

    sketched = store(source.mapInArrow(
        sketch, f"id {kind}, row bigint, n_shingles bigint, mark binary, bands array<bigint>"))
    # a class holds the documents of one shingle set; its number is one of its rows
    classes = store(sketched.filter("n_shingles > 0").groupBy("mark", "bands", "n_shingles").agg(
        F.min("row").alias("c"), F.min("id").alias("low"), F.min_by("row", "id").alias("low_row")))

    buckets = classes.select("c", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(
        F.min("c").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = store(buckets.join(shared, "bucket").filter("c <> first").select("bucket", "first", "c"))
    sizes = classes.select("c", F.col("n_shingles").alias("n"))
    wanted = members.select("c").union(members.select("first")).distinct()

    def full_sets(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                elements, n = shingle_sets(texts[a:b], words)
                offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[a:b], pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(elements.view(np.int64)))],
                    ["c", "n", "items"])

    sets = store(source.select("row", "text").join(
        wanted.withColumnRenamed("c", "row").hint("shuffle_hash"), "row", "left_semi").mapInArrow(
        full_sets, "c bigint, n bigint, items array<bigint>"))

    pairs = members.select(F.col("first").alias("a"), F.col("c").alias("b")).distinct()
    for side in "ab":   # sizes alone rule out many pairs before sets move
        pairs = pairs.join(sizes.select(F.col("c").alias(side), F.col("n").alias(f"n_{side}")), side)
    links = store(_linked(pairs.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
                          .select("a", "b"), sets, percent))
    roots = store(components(links))
    rest = _across(members, roots)
    more = store(_block_links(rest, sets, percent))
    if not more.isEmpty():
        roots = store(components(links.union(more)))

    named = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select(
        "mark", "low", "low_row", "c", F.coalesce("root", "c").alias("root"))
    lows = named.groupBy("root").agg(
        F.min("low").alias("component_id"),
        F.coalesce(F.min_by("low_row", "low"), F.min("c")).alias("keep_row"))
    # a class of its own needs no join by root, so only components of several meet in one key
    found = named.join(lows, "root").select("mark", "component_id", "keep_row")
    return sketched.select("id", "row", "n_shingles", F.when(
        F.col("n_shingles") > 0, F.col("mark")).alias("mark")).join(found, "mark", "left").select(
        F.col("id").alias(id_col), "row", "n_shingles",
        F.when(F.col("mark").isNull(), F.col("id")).otherwise(F.col("component_id"))
        .alias("component_id"),
        (F.col("mark").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"))


def slices(texts: list[bytes], most: int = 2_000_000, count: int = 4096):
    """Slices of a bounded number of bytes and texts; a longer text is alone."""
    for a, b in byte_batches(texts, most):
        for c in range(a, b, count):
            yield c, min(b, c + count)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = (sets.select(F.col("c").alias(s), F.col("n").alias(f"n_{s}"),
                               F.col("items").alias(f"items_{s}")) for s in "ab")
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.filter(
        common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).select("a", "b")


def _across(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes (bucket, c, comp) of the buckets that hold more than one component, apart from a
    bucket's first, with which all of them have been compared. Of buckets with the same classes,
    as those of a group that shares many bands, one is kept."""
    placed = members.join(roots.withColumnRenamed("node", "c"), "c", "left").select(
        "bucket", "c", F.coalesce("root", "c").alias("comp"))
    mixed = placed.groupBy("bucket").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"),
        *[F.sum(F.xxhash64("c", F.lit(seed)).cast("decimal(20,0)")).alias(f"mark{seed}") for seed in (1, 2)]
    ).filter("low < high").groupBy("size", "mark1", "mark2").agg(F.min("bucket").alias("bucket"))
    return store(placed.join(mixed.select("bucket", "size"), "bucket"))


def _block_links(rest: DataFrame, sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) between classes of a bucket that are in different components.

    A bucket is dealt into blocks by a hash, and each pair of blocks is compared on full
    sets, in tasks of about four blocks; of the links between two components one is returned.
    So work and rows moved follow from the sizes of buckets, not of what is reached through several.
    """
    dealt = rest.withColumn("blocks", F.ceil(F.col("size") / block)).withColumn(
        "own", F.pmod(F.xxhash64("c"), F.col("blocks")))
    met = store(dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "comp"))
    parts = max(1, -(-met.count() // (4 * block)))
    pairs = met.join(sets, "c").withColumn("part", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(parts)))

    def compare_all(table):
        table = table.combine_chunks().sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending")])
        keys = [table.column(x).to_numpy() for x in ("bucket", "i", "j")]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        found = [compare(table.slice(a, b - a)) for a, b in zip([0, *new], [*new, len(keys[0])])]
        return pa.concat_tables(found)

    def compare(table):
        table = table.sort_by("c")
        c, comp, n = (table.column(x).to_numpy() for x in ("c", "comp", "n"))
        own, j = table.column("own").to_numpy(), table.column("j")[0].as_py()
        items = table.column("items").combine_chunks().flatten().to_numpy()
        names, at = np.unique(items, return_inverse=True)
        common = np.flatnonzero(np.bincount(at) > 1)      # the others are in no intersection
        place = np.full(len(names), -1)
        place[common] = np.arange(len(common))
        doc, col = np.repeat(np.arange(len(c)), n), place[at]
        doc, col = doc[col >= 0], col[col >= 0]
        left = np.flatnonzero(own == table.column("i")[0].as_py())
        right = np.flatnonzero(own == j)
        both = np.zeros((len(left), len(right)), np.float32)
        row = np.full((2, len(c)), -1)
        row[0, left], row[1, right] = np.arange(len(left)), np.arange(len(right))
        # a slice of items at a time keeps the matrices small
        order = np.argsort(col, kind="stable")
        doc, col = doc[order], col[order]
        for x in range(0, len(common), 4096):
            a, b = np.searchsorted(col, [x, x + 4096])
            d, k = doc[a:b], col[a:b] - x
            m = np.zeros((2, max(len(left), len(right)), 4096), np.float32)
            for side in (0, 1):
                inside = row[side][d] >= 0
                m[side, row[side][d[inside]], k[inside]] = 1
            both += m[0, :len(left)] @ m[1, :len(right)].T
        union = n[left][:, None] + n[right][None, :] - both
        linked = (100 * both >= percent * union) & (comp[left][:, None] != comp[right][None, :])
        x, y = np.nonzero(linked)
        x, y = left[x], right[y]
        one = np.unique(np.sort(np.stack([comp[x], comp[y]]), axis=0), axis=1, return_index=True)[1]
        return pa.table({"a": pa.array(c[x[one]], pa.int64()), "b": pa.array(c[y[one]], pa.int64())})

    return pairs.groupBy("part").applyInArrow(compare_all, "a bigint, b bigint")
