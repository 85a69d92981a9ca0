"""Stored intermediate tables, global row numbers and array helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidyward.session import is_local, rule_table

LOWEST = -(1 << 63)
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster
    without it raises, as its machines would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        _FOLDERS[app] = tempfile.mkdtemp(prefix="tidyward-")
    return _FOLDERS[app]


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a cut that survives
    lost executors. The folder's owner clears it, as for checkpoints."""
    path = f"{shared_folder(df.sparkSession)}/tidyward/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list, name: str = "row") -> tuple[DataFrame, int]:
    """``df`` with a gapless number from 0 in the order of ``order``, and the row count.

    Rows are range-partitioned and numbered within partitions; the driver sees one
    count per partition. ``order`` must tell rows apart, so that no tie is hot.
    """
    spark = df.sparkSession
    placed = store(df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")))
    counts = sorted((r["__part"], r["n"]) for r in
                    placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    # a row per partition, whatever the table holds
    offsets = rule_table(spark, ["__part", "__from"], starts or [(0, 0)])
    numbered = placed.join(F.broadcast(offsets), "__part").withColumn(
        name, (F.col("__from") + F.col("__at")).cast("long")).drop("__part", "__at", "__from")
    return numbered, total


def rank_of(column: str) -> Column:
    """An id to order by: null ids come first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LOWEST))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i up to at least n."""
    have = _POWERS.get((base, 0))
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _POWERS[(base, 0)] = have
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], the same wherever the span stands.

    A polynomial over 64-bit values by prefix sums, then mixed with the length.
    """
    up, down = powers(len(values))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts]
                   + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def value_table(seed: int, size: int = 256) -> np.ndarray:
    """A fixed 64-bit number for each byte."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


def byte_batches(items: list, most: int):
    """(first, last) slices of ``items`` (bytes) of about ``most`` bytes; a longer item is alone."""
    first = held = 0
    for i, item in enumerate(items):
        if i > first and held + len(item) > most:
            yield first, i
            first, held = i, 0
        held += len(item)
    if first < len(items):
        yield first, len(items)
