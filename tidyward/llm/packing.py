"""Packing token sequences into windows of a fixed length, in bounded space.

Each partition keeps a fixed number of open windows. A document's full windows leave
at once; its rest goes to the open window that it fits best. If it fits none, the
fullest window is emitted: first filled up with the beginning of the rest, unless its
gap is below ``least`` tokens. Open windows that remain are merged in groups, round by
round, until a single group is left; the very last tokens take windows whose lengths
are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidyward.llm.common import store
from tidyward.llm.words import encoder, text_batches

COLUMNS = {"id": None, "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
           "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint", "open": "int",
           "ids": "binary"}
#: A sequence id holds the round of merging, the partition or group, and a running number.
LEVEL_BITS, PART_BITS, MERGED_BITS = 56, 33, 24
#: So many partitions, then groups, are merged by one task: 2 ** GROUP_BITS.
GROUP_BITS = 6


class Packer:
    """Open windows of one partition; ``emit`` takes finished ones."""

    def __init__(self, emit, size: int, windows: int, least: int):
        self.emit, self.size, self.windows, self.least = emit, size, windows, least
        self.open: list[list] = []   # [tokens used, pieces]

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self.emit([(doc, start, ids[:self.size], total)])
            start, ids = start + self.size, ids[self.size:]
        while len(ids):
            fits = [w for w in self.open if w[0] + len(ids) <= self.size]
            if fits:
                window = max(fits, key=lambda w: w[0])
                room = len(ids)
            elif len(self.open) < self.windows:
                window, room = [0, []], len(ids)
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                room = self.size - window[0]
                if room < self.least:
                    self._close(window)
                    continue
            window[1].append((doc, start, ids[:room], total))
            window[0] += room
            start, ids = start + room, ids[room:]
            if window[0] == self.size:
                self._close(window)

    def _close(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.emit(window[1])

    def finish(self) -> None:
        """The rest in full windows, then in windows of powers of two."""
        pieces = [p for w in self.open for p in w[1]]
        left = sum(len(p[2]) for p in pieces)
        while left:
            room = min(self.size, 1 << (left.bit_length() - 1))
            left -= room
            window = []
            while room:
                doc, start, ids, total = pieces.pop(0)
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], total))
                    ids = ids[:room]
                window.append((doc, start, ids, total))
                room -= len(ids)
            self.emit(window)
        self.open = []


class _Rows:
    """Collects windows as rows; those still open carry their ids along."""

    def __init__(self, kind: pa.DataType, first: int):
        self.kind, self.number = kind, first
        self.columns: dict[str, list] = {c: [] for c in COLUMNS}

    def window(self, pieces: list, still_open: bool = False) -> None:
        offset, add = 0, self.columns
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            for name, value in (("id", doc), ("start", start), ("length", len(ids)),
                                ("ids_crc32", zlib.crc32(raw)), ("doc_tokens", total),
                                ("sequence_id", self.number), ("offset", offset),
                                ("open", int(still_open)), ("ids", raw if still_open else None)):
                add[name].append(value)
            offset += len(ids)
        self.number += 1

    def take(self) -> pa.RecordBatch:
        types = [self.kind, *[pa.int64()] * 6, pa.int32(), pa.binary()]
        out = pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(self.columns.values(), types)], list(COLUMNS))
        self.columns = {c: [] for c in COLUMNS}
        return out


def pack_tokens(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = 4096,
                windows: int = 16, least: int = 32, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then ``end_id``; null counts as the empty text, so
    every row has a piece. Pieces of a document lie in order of start and cover it; a
    window of ``size`` tokens is never over-full, offsets in it are gapless. Repeated
    rows are packed each. Which window a piece gets depends on how the input is split,
    not on chance: a lost task gives the same rows again. A task holds ``windows`` open
    windows and one batch; only what is left open moves between machines. An empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = ", ".join(f"`{c}` {t or kind}" for c, t in COLUMNS.items())

    def pack(batches):
        coder, packer, out = encoder(vocabulary), None, None
        for batch in batches:
            if packer is None:
                out = _Rows(batch.schema.field("id").type, TaskContext.get().partitionId() << PART_BITS)
                packer = Packer(out.window, size, windows, least)
            texts, names = batch.column("text").to_pylist(), batch.column("id").to_pylist()
            for a, b in text_batches(texts):
                ids, n = coder.encode(texts[a:b])
                ends = np.cumsum(n)
                for doc, end, count in zip(names[a:b], ends, n):
                    packer.add(doc, 0, np.append(ids[end - count:end], np.int32(end_id)),
                               int(count) + 1)
                yield out.take()
        if packer is not None:
            for window in packer.open:
                out.window(window[1], still_open=True)
            yield out.take()

    level = 0
    done = store(rows.mapInArrow(pack, schema).withColumn(
        "group", F.shiftright("sequence_id", PART_BITS + GROUP_BITS)))
    parts = [done.filter("open = 0")]
    while True:
        # a row per group, as many as partitions / GROUP
        left = done.filter("open = 1")
        groups = left.select("group").distinct().limit(2).count()
        if not groups:
            break
        level += 1
        merged = left.groupBy("group").applyInArrow(
            _merge(size, windows, least, level, groups == 1), schema)
        done = store(merged.withColumn("group", F.shiftright(F.col("sequence_id").bitwiseAND(
            (1 << LEVEL_BITS) - 1), MERGED_BITS + GROUP_BITS)))
        parts.append(done.filter("open = 0"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                      "sequence_id", "offset")


def _merge(size: int, windows: int, least: int, level: int, last: bool):
    """Packs the open windows of a group of partitions; at most 64 * ``windows`` of them."""

    def merge(key, table):
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        # level in the top bits keeps the numbers of the rounds apart
        out = _Rows(table.schema.field("id").type, (level << LEVEL_BITS) | (key[0].as_py() << MERGED_BITS))
        packer = Packer(out.window, size, windows, least)
        # the pieces of a document follow each other in some order; longest first packs best
        pieces = sorted(table.select(["id", "start", "doc_tokens", "ids"]).to_pylist(),
                        key=lambda p: -len(p["ids"]))
        for p in pieces:
            packer.add(p["id"], p["start"], np.frombuffer(p["ids"], "<u4"), p["doc_tokens"])
        if last:
            packer.finish()
        for window in packer.open:
            out.window(window[1], still_open=True)
        return pa.Table.from_batches([out.take()])

    return merge
