"""Stretches of texts looked up among very many terms: hashes of all stretches, tested against a set of bits.

Workers receive the code itself, not an import, so functions for them are defined inside of others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

#: A set of bits takes two bytes a key, and at most this many: beyond, it lets more keys through that aren't in it.
SET_BYTES = 64 << 20
#: Words of 64 bits that one row of the set's table holds.
SLICE_WORDS = 17


def stretch_hashes():
    """``hashes(data)(at, length, seed)``: Spark's xxhash64 of the bytes from each place ``at`` of ``data``."""

    def hashes(data):
        import numpy as np

        u = np.uint64
        p1, p2, p3, p4, p5 = map(u, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
                                     0x27D4EB2F165667C5))
        wide = np.zeros(len(data) + 8, u)
        wide[:len(data)] = data
        word = wide[:len(data)].copy()
        for i in range(1, 8):
            word |= wide[i:len(data) + i] << u(8 * i)
        turned = lambda x, by: x << u(by) | x >> u(64 - by)                 # noqa: E731

        def of(at, length, seed):
            done = 0
            if length >= 32:
                v = [seed + p1 + p2, seed + p2, seed, seed - p1]
                while done + 32 <= length:
                    v = [turned(x + word[at + done + 8 * i] * p2, 31) * p1 for i, x in enumerate(v)]
                    done += 32
                h = turned(v[0], 1) + turned(v[1], 7) + turned(v[2], 12) + turned(v[3], 18)
                for x in v:
                    h = (h ^ turned(x * p2, 31) * p1) * p1 + p4
            else:
                h = seed + p5
            h = h + u(length)
            while done + 8 <= length:
                h = turned(h ^ turned(word[at + done] * p2, 31) * p1, 27) * p1 + p4
                done += 8
            if done + 4 <= length:
                h = turned(h ^ (word[at + done] & u(0xFFFFFFFF)) * p1, 23) * p2 + p3
                done += 4
            while done < length:
                h = turned(h ^ wide[at + done] * p5, 11) * p1
                done += 1
            h = (h ^ h >> u(33)) * p2
            h = (h ^ h >> u(29)) * p3
            return h ^ h >> u(32)

        return of

    return hashes


def marks():
    """``mark(key, log)``: each key's word in a set of 2 ** log words, and its four bits there."""

    def mark(key, log):
        import numpy as np

        u = np.uint64
        bits = u(1) << (key & u(63))
        for by in (6, 12, 18):
            bits |= u(1) << (key >> u(by) & u(63))
        return (key >> u(64 - log)).astype(np.int64), bits

    return mark


def bits_of(keys: DataFrame, n: int) -> np.ndarray:
    """The set of bits of about ``n`` keys (one bigint column key): made in slices by tasks, put together here."""
    log = max(10, min(math.ceil(math.log2(max(n, 1) / 4)), int(math.log2(SET_BYTES // 8))))
    cuts = max(0, log - SLICE_WORDS)
    mark = marks()

    def gathered(batches):
        import numpy as np
        import pyarrow as pa

        found = {}
        for batch in batches:
            word, bits = mark(batch["key"].to_numpy().view(np.uint64), log)
            part = word >> (log - cuts)
            for s in np.unique(part).tolist():
                own = found.setdefault(s, np.zeros(1 << (log - cuts), np.uint64))
                np.bitwise_or.at(own, word[part == s] & ((1 << (log - cuts)) - 1), bits[part == s])
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([*found], pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["slice", "bits"])

    part = F.shiftrightunsigned("key", 64 - cuts) if cuts else F.lit(0)
    partitions = min(1 << cuts, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = keys.repartition(partitions, part).mapInArrow(gathered, "slice int, bits binary").toArrow()
    out = np.zeros(1 << log, np.uint64)
    for s, bits in zip(table["slice"].to_pylist(), table["bits"]):
        own = np.frombuffer(bits.as_buffer(), np.uint64)
        out[s * len(own):(s + 1) * len(own)] = own
    return out


def among(key: str, bits) -> Column:
    """Whether a key may stand in a broadcast set of bits."""
    mark = marks()

    @pandas_udf(BooleanType())
    def may(key):
        import numpy as np
        import pandas as pd

        word, own = mark(key.to_numpy().view(np.uint64), len(bits.value).bit_length() - 1)
        return pd.Series(bits.value[word] & own == own)

    return may(key)


#: Only a stretch whose first so many bytes begin some term is looked up as a whole, where it is longer.
PREFIXES = (4, 16, 64)


def prefix_keys(category: str, term: str, longest: int) -> Column:
    """The keys of a term's beginnings, apart from those of whole terms."""
    start = lambda w: F.substring(F.col(term).cast("binary"), 1, w)         # noqa: E731
    return F.array_compact(F.array(*[
        F.when(F.octet_length(term) > w, F.bitwise_not(F.xxhash64(category, start(w))))
        for w in PREFIXES if w < longest], F.lit(None).cast("bigint")))


def finder(carried, carried_lengths: list[int], lengths: list[int], bits):
    """What ``texts`` (category, description, seed: the category's xxhash64) hold: for mapInArrow, rows category,
    description, key, seq, term, answer.

    One row without key for each text that holds a term of its category of the Arrow table ``carried`` (category, term,
    key, seq, answer, in the order of their rank): the first of them, compared byte by byte. And one row with key for each
    stretch of a length in ``lengths`` whose key may stand in the broadcast set ``bits``.
    """
    hashes, mark, prefixes = stretch_hashes(), marks(), PREFIXES
    kept = [carried[c].combine_chunks() for c in ("seq", "term", "answer")]
    categories = carried["category"].combine_chunks().unique()

    def by_length():
        import numpy as np
        import pyarrow.compute as pc

        out = {}
        size = pc.binary_length(carried["term"]).to_numpy()
        key = carried["key"].to_numpy().view(np.uint64)
        kind = pc.index_in(carried["category"], categories).to_numpy()
        terms = carried["term"].to_pylist()
        for n in carried_lengths:
            rank = np.flatnonzero(size == n)
            rank = rank[np.argsort(key[rank])]
            out[n] = key[rank], rank, kind[rank], np.frombuffer(
                b"".join(terms[i].encode() for i in rank), np.uint8).reshape(-1, n)
        return out

    short = by_length()

    def found(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held = bits.value
        log = len(held).bit_length() - 1

        def may(key):
            word, own = mark(key, log)
            return held[word] & own == own

        for batch in batches:
            text, n = batch["description"].cast(pa.large_string()), batch.num_rows
            if not n:
                continue
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + n + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0]:ends[-1]]
            ends = ends - ends[0]
            owner = np.repeat(np.arange(n), np.diff(ends))
            end, of = ends[1:][owner], hashes(data)
            seed = batch["seed"].to_numpy().view(np.uint64)
            kind = pc.index_in(batch["category"], categories).fill_null(-1).to_numpy() if len(categories) else None
            # characters begin where no byte of the form 10xxxxxx stands
            alive, to_come = np.flatnonzero(data & 0xC0 != 0x80), list(prefixes)
            first, keys, places = np.full(n, len(kept[0])), [], []
            for length in sorted({*short, *lengths}):
                while to_come and to_come[0] < length:
                    w = to_come.pop(0)
                    alive = alive[alive + w <= end[alive]]
                    alive = alive[may(~of(alive, w, seed[owner[alive]]))]
                alive = alive[alive + length <= end[alive]]
                key = of(alive, length, seed[owner[alive]])
                if length in short:
                    known, rank, own_kind, own = short[length]
                    i = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    hit = np.flatnonzero(known[i] == key)
                    at, i = alive[hit], i[hit]
                    same = (own_kind[i] == kind[owner[at]]) & (data[at[:, None] + np.arange(length)] == own[i]).all(1)
                    np.minimum.at(first, owner[at[same]], rank[i[same]])
                else:
                    hit = may(key)
                    keys.append(key[hit])
                    places.append(owner[alive[hit]])
            whole = np.flatnonzero(first < len(kept[0]))
            rows = np.concatenate([whole, *places])
            blank = np.arange(len(rows)) >= len(whole)
            key = np.concatenate([np.zeros(len(whole), np.uint64), *keys]).view(np.int64)
            rank = pa.array(np.concatenate([first[whole], np.zeros(len(rows) - len(whole), np.int64)]), mask=blank)
            yield pa.RecordBatch.from_arrays(
                [batch["category"].take(pa.array(rows)), batch["description"].take(pa.array(rows)),
                 pa.array(key, mask=~blank), *[c.take(rank) for c in kept]],
                ["category", "description", "key", "seq", "term", "answer"])

    return found
