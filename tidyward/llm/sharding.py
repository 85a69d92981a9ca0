"""Sharding by a keyed permutation of global row numbers.

A row's number in (id, text hash) order goes through a Feistel network; results
beyond the row count walk the cycle until they fall inside. The permuted number
gives the shard (remainder) and the slot (quotient), so both can be computed, and
inverted, for any row number without touching the data.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidyward.llm.common import mix, number_rows, rank_of


class Permutation:
    """A permutation of 0 .. n - 1 chosen by ``seed``."""

    def __init__(self, n: int, seed: int, rounds: int = 6):
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        with np.errstate(over="ignore"):
            self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                            + np.uint64(seed % (1 << 64)))

    def _network(self, x: np.ndarray, keys) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for key in keys:
            left, right = right, left ^ (mix(right ^ key) & mask)
        # the halves leave swapped, so the same network with reversed keys undoes it
        return (right << h) | left

    def _walk(self, x, keys) -> np.ndarray:
        x = np.array(x, dtype=np.uint64)
        with np.errstate(over="ignore"):
            out = self._network(x, keys)
            while (outside := np.flatnonzero(out >= np.uint64(self.n))).size:
                out[outside] = self._network(out[outside], keys)
        return out.astype(np.int64)

    def forward(self, rows) -> np.ndarray:
        return self._walk(rows, self.keys)

    def backward(self, places) -> np.ndarray:
        return self._walk(places, self.keys[::-1])


def locate(rows, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers of a table of ``n`` rows."""
    places = Permutation(n, seed).forward(rows)
    return places % shards, places // shards


def row_at(shard, slot, n: int, shards: int, seed: int) -> np.ndarray:
    """The row number that stands at a slot of a shard."""
    return Permutation(n, seed).backward(np.asarray(slot) * shards + np.asarray(shard))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20_250_101, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, row, shard, slot; counts of shards differ by
    one at most.

    size is the UTF-8 length of the text plus 1 (null text: 1), text_crc32 that of the
    text (null: of the empty text). Rows are numbered by id, then text hash; null ids
    come first, equal rows in scan order, so repeated rows get places of their own.
    Only ids and hashes are shuffled, never texts. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("scan"))
    rows, n = number_rows(keyed, [rank_of("id"), "hash", "scan"])

    @F.pandas_udf("struct<shard int, slot long>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        permutation = Permutation(n, seed)
        for numbers in batches:
            places = permutation.forward(numbers.to_numpy())
            yield pd.DataFrame({"shard": (places % shards).astype(np.int32),
                                "slot": places // shards})

    return rows.withColumn("at", place("row")).select(
        F.col("id").alias(id_col), "size", "text_crc32", "row", "at.shard", "at.slot")
