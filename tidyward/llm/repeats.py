"""Repeated byte strings by suffix order and longest-previous-factor arrays.

Every window of ``length`` bytes is assigned to the smallest gram hash in it, so equal
windows meet in one bucket, and neighbouring windows of a text that share it travel as
one run. A run alone in its bucket repeats nothing, unless its text is periodic. Equal runs
need no further look. For the others, the suffixes that begin in a bucket's distinct runs are sorted;
the previous and next smaller text positions in that order give each suffix its longest
earlier match. Buckets with very many distinct runs are spread by window instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidyward.llm.common import byte_batches, ragged, rank_of, span_hashes, store, value_table

_VALUES, _SECOND = value_table(11), value_table(12)
BLOCK = 1 << 20


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by minima from both ends of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def find_runs(texts: list[bytes], length: int, gram: int):
    """Runs of window starts that share their smallest gram hash: text, first start, starts,
    that hash, a hash of the bytes under the run, and whether the gram stands there twice (else
    the run's own windows all differ)."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.cumsum(sizes) - sizes
    valid = ragged(firsts, np.maximum(sizes - length + 1, 0))
    if not len(valid):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, bool)]
    values = _VALUES[raw]
    starts = np.arange(len(raw) - gram + 1)
    grams = span_hashes(values, starts, starts + gram)
    # the position in the low bits makes the first of equal grams the smallest
    bits = np.uint64(int(len(grams)).bit_length())
    keys = (grams >> bits << bits) | starts.astype(np.uint64)
    place = (sliding_min(keys, length - gram + 1)[valid]
             & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    least = grams[place]
    fresh = np.append(True, (least[1:] != least[:-1]) | (np.diff(valid) > 1))
    fresh[np.searchsorted(valid, firsts[(sizes >= length)])] = True
    at = np.flatnonzero(fresh)
    n = np.diff(np.append(at, len(valid)))
    begin = valid[at]
    owner = np.searchsorted(firsts, begin, "right") - 1
    twice = place[at] != place[at + n - 1]
    return owner, begin - firsts[owner], n, least[at], span_hashes(
        values, begin, begin + n - 1 + length), twice


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each value the index of the nearest smaller one before it, or -1.

    Minima of 1, 2, 4, ... values tell how far one can step back over larger ones.
    """
    n = len(values)
    least = [values]
    while 2 << (len(least) - 1) <= n:
        half, last = 1 << (len(least) - 1), least[-1]
        wider = last.copy()
        wider[half:] = np.minimum(last[half:], last[:-half])
        least.append(wider)
    at = np.arange(n) - 1
    for step in range(len(least) - 1, -1, -1):
        width = 1 << step
        far = np.flatnonzero(at >= width - 1)
        far = far[least[step][at[far]] > values[far]]
        at[far] -= width
    return at


class SuffixOrder:
    """Order of the suffixes of several texts in groups, by their first ``length`` bytes."""

    def __init__(self, raw: np.ndarray, group: np.ndarray, length: int):
        """``group``: the group of each byte; a suffix is compared within its group only. Bytes
        are read up to ``length`` behind a start, so starts closer to an end are not asked for."""
        n, self.length = len(raw), length
        rank = np.unique(group.astype(np.int64) * 256 + raw, return_inverse=True)[1].astype(np.int32)
        self.levels = [(1, rank)]
        width = 1
        while width < length:
            step = min(width, length - width)
            ahead = np.zeros(n, np.int64)
            ahead[:n - step] = rank[step:] + 1
            rank = np.unique(rank.astype(np.int64) * (n + 1) + ahead, return_inverse=True)[1].astype(np.int32)
            width += step
            self.levels.append((width, rank))
        self.rank = rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, ``length`` at most."""
        out = np.where(self.rank[a] == self.rank[b], self.length, 0)
        rest = out == 0
        a, b, got = a[rest], b[rest], np.zeros(int(rest.sum()), np.int64)
        top = len(self.rank) - 1
        for width, rank in reversed(self.levels[:-1]):
            same = rank[np.minimum(a + got, top)] == rank[np.minimum(b + got, top)]
            got += np.where(same, width, 0)
        out[rest] = np.minimum(got, self.length - 1)
        return out


def previous_factors(order: SuffixOrder, starts: np.ndarray, places: np.ndarray):
    """For each start the longest match with a start of smaller place, and with any other.

    The longest earlier match of a suffix is with the nearest suffix of smaller place before
    or behind it in suffix order.
    """
    by = np.lexsort((places, order.rank[starts]))
    ordered, places = starts[by], places[by]
    n = len(by)

    def match(with_at: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        has = np.flatnonzero((with_at >= 0) & (with_at < n))
        out[has] = order.common(ordered[has], ordered[with_at[has]])
        return out

    earlier = np.maximum(match(previous_smaller(places)),
                         match(n - 1 - previous_smaller(places[::-1])[::-1]))
    beside = np.maximum(match(np.arange(n) - 1), match(np.arange(n) + 1))
    out = np.zeros((2, n), np.int64)
    out[0, by], out[1, by] = earlier, beside
    return out


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the stretches of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    begin = np.flatnonzero(edge == 1)
    return begin, np.flatnonzero(edge == -1) - begin


def cut_spans(raw: bytes, spans: list, whole_characters: bool) -> tuple[bytes, list]:
    """``raw`` without the union of (from, to) spans, and that union as maximal spans."""
    if not spans:
        return raw, []
    depth = np.zeros(len(raw) + 1, np.int64)
    np.add.at(depth, [s[0] for s in spans], 1)
    np.subtract.at(depth, [s[1] for s in spans], 1)
    begin, n = spans_of(np.cumsum(depth)[:-1] > 0)
    kept, out, last = [], [], 0
    for a, b in zip(begin.tolist(), (begin + n).tolist()):
        if whole_characters:
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
        if a < b:
            kept.append(raw[last:a])
            out.append((a, b))
            last = b
    return b"".join(kept) + raw[last:], out


def drop_repeats(docs: DataFrame, length: int = 200, keep_first: bool = True,
                 whole_characters: bool = True, gram: int = 64, hot: int = 8000,
                 id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """One row per input row: id, row, n_bytes, kept (bytes), spans (array of from, to), then
    the columns named in ``carry``.

    A byte goes if it lies under a string of ``length`` bytes that also starts elsewhere,
    in the same text or another; strings are judged on the input and may overlap. With
    ``keep_first`` the first occurrence stays: that of the smallest id (null ids first, then
    scan order), then of the smallest position. ``whole_characters`` draws spans in to
    UTF-8 characters, so that what is kept can be read. Null counts as the empty text;
    repeated rows are occurrences of their own. Equality of strings rests on two 64-bit
    hashes for equal runs and for buckets of more than ``hot`` distinct runs (a task sorts some 300
    bytes of each, in about 70 times that memory), else on their bytes. Rows are numbered and stored once, so the frame is read once. Other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    also = [f"__{i}" for i in range(len(carry))]
    whole_rows = store(docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text"),
        *[F.col(c).alias(a) for c, a in zip(carry, also)]))
    source = whole_rows.select("id", "row", "text")
    kind = source.schema["id"].dataType.simpleString()

    def runs_of(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows, order = batch.column("row"), batch.column("place")
            # a long text goes in blocks that share length - 1 bytes
            parts = [(i, x, t[x:x + BLOCK + length - 1]) for i, t in enumerate(texts)
                     for x in range(0, max(1, len(t) - length + 1), BLOCK) if len(t) >= length]
            blocks = [p[2] for p in parts]
            for a, b in byte_batches(blocks, BLOCK):
                owner, at, n, bucket, content, twice = find_runs(blocks[a:b], length, gram)
                if not len(owner):
                    continue
                owner = owner + a
                text_no = np.fromiter((p[0] for p in parts), np.int64, len(parts))[owner]
                shift = np.fromiter((p[1] for p in parts), np.int64, len(parts))[owner]
                take = pa.array(text_no)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(content.view(np.int64)),
                     order.take(take), rows.take(take), pa.array((at + shift).astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(twice)],
                    ["bucket", "content", "place", "row", "at", "n", "twice"])

    place = rank_of("id") if keep_first else F.col("row")
    found = store(source.filter(F.octet_length("text") >= length).select(
        "row", place.alias("place"), "text").mapInArrow(
        runs_of, "bucket bigint, content bigint, place bigint, row bigint, at int, n int, twice boolean"))
    # most runs are alone in their bucket; they go before anything else moves
    meeting = found.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice")).filter("times > 1 OR twice")
    runs = store(found.join(meeting.select("bucket"), "bucket", "left_semi"))

    distinct = store(runs.groupBy("bucket", "content").agg(
        F.min(F.struct("place", "row", "at")).alias("first"), F.max("n").alias("n"),
        F.max("twice").alias("twice"), F.count(F.lit(1)).alias("times")))
    several = distinct.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("any")).filter("kinds > 1 OR any").drop("any")
    # every occurrence but the first is a copy of it, under its whole run
    copies = runs.join(distinct.select("bucket", "content", "first", "times"), ["bucket", "content"])
    first = (F.col("row") == F.col("first.row")) & (F.col("at") == F.col("first.at"))
    copied = ~first if keep_first else ~first | (F.col("times") > 1)
    whole = copies.filter(copied).select(
        "row", F.col("at").alias("from"), (F.col("at") + F.col("n") - 1 + length).alias("to"))

    asked = distinct.join(several, "bucket").select(
        "bucket", "content", "kinds", "times", "n", F.col("first.place").alias("place"),
        F.col("first.row").alias("row"), F.col("first.at").alias("at"))
    lists = asked.groupBy("row").agg(F.collect_list(F.struct(
        "bucket", "content", "kinds", "times", "place", "at", "n")).alias("wanted"))
    one = ("bucket bigint, content bigint, kinds bigint, times bigint, place bigint, row bigint, "
           "at int, n int, bytes binary")

    def clip(batches):
        for batch in batches:
            out = {c.split()[0]: [] for c in one.split(", ")}
            for row, raw, wanted in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "wanted"))):
                for w in wanted:
                    for c in ("bucket", "content", "kinds", "times", "place", "at", "n"):
                        out[c].append(w[c])
                    out["row"].append(row)
                    out["bytes"].append(raw[w["at"]:w["at"] + w["n"] - 1 + length])
            types = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    clips = store(source.select("row", "text").join(lists.hint("shuffle_hash"), "row").mapInArrow(clip, one))
    spans = whole.unionByName(_suffix_spans(clips.filter(F.col("kinds") <= hot), length, keep_first)).unionByName(
        _window_spans(clips.filter(F.col("kinds") > hot), length, keep_first))
    per_text = spans.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))

    def cut(batches):
        for batch in batches:
            texts, lists = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            done = [cut_spans(t, [(s["from"], s["to"]) for s in spans or ()], whole_characters)
                    for t, spans in zip(texts, lists)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(map(len, texts), pa.int64()),
                 pa.array([d[0] for d in done], pa.binary()),
                 pa.array([[{"from": a, "to": b} for a, b in d[1]] for d in done],
                          pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                 *[batch.column(a) for a in also]],
                ["id", "row", "n_bytes", "kept", "spans", *also])

    carried = "".join(f", {a} {whole_rows.schema[a].dataType.simpleString()}" for a in also)
    return whole_rows.join(per_text.hint("shuffle_hash"), "row", "left").mapInArrow(
        cut, f"id {kind}, row bigint, n_bytes bigint, kept binary, "
             f"spans array<struct<from:int,to:int>>{carried}").select(
        F.col("id").alias(id_col), "row", "n_bytes", "kept", "spans",
        *[F.col(a).alias(c) for a, c in zip(also, carry)])


def _suffix_spans(clips: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans (row, from, to) under first occurrences, by longest previous factors of buckets."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        raw = table.column("bytes").to_pylist()
        group, n, at, row, times, place = (table.column(c).to_numpy() for c in (
            "bucket", "n", "at", "row", "times", "place"))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        firsts = np.cumsum(sizes) - sizes
        numbers = np.unique(group, return_inverse=True)[1]
        order = SuffixOrder(np.frombuffer(b"".join(raw), np.uint8), np.repeat(numbers, sizes), length)
        starts = ragged(firsts, n)
        owner = np.repeat(np.arange(len(raw)), n)
        offset = starts - firsts[owner]
        # places in text: by the first occurrence's text, then by position
        rank = np.empty(len(owner), np.int64)
        rank[np.lexsort((at[owner] + offset, row[owner], place[owner]))] = np.arange(len(owner))
        earlier, beside = previous_factors(order, starts, rank)
        flags = (earlier if keep_first else beside) >= length
        if not keep_first:
            flags &= times[owner] == 1   # the others go as a whole
        # stretches within one clip
        edge = np.flatnonzero(flags)
        fresh = np.append(True, (np.diff(edge) > 1) | (owner[edge][1:] != owner[edge][:-1])) if len(edge) else edge
        head = edge[fresh] if len(edge) else edge
        count = np.diff(np.append(np.flatnonzero(fresh), len(edge))) if len(edge) else edge
        begin = at[owner[head]] + offset[head]
        return pa.RecordBatch.from_arrays(
            [pa.array(row[owner[head]], pa.int64()), pa.array(begin, pa.int32()),
             pa.array(begin + count - 1 + length, pa.int32())], ["row", "from", "to"])

    def groups(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < BLOCK:
                continue
            table = pa.Table.from_batches(held)
            buckets = table.column("bucket").to_numpy()
            # the last bucket may go on in the next batch
            whole = int(np.searchsorted(buckets, buckets[-1]))
            for part in _by_size(table.slice(0, whole)):
                yield solve(part)
            held = table.slice(whole).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            for part in _by_size(pa.Table.from_batches(held)):
                yield solve(part)

    return clips.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        groups, "row bigint, from int, to int")


def _by_size(table: pa.Table):
    """Parts of a table sorted by bucket: whole buckets, about BLOCK / 2 bytes."""
    if not table.num_rows:
        return
    buckets = table.column("bucket").to_numpy()
    sizes = np.array([len(b) for b in table.column("bytes").to_pylist()])
    heads = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    ends = np.cumsum(np.add.reduceat(sizes, heads))
    parts = np.flatnonzero(np.append(True, np.diff((ends - 1) // (BLOCK // 2)) > 0))
    for a, b in zip(heads[parts], np.append(heads[parts][1:], table.num_rows)):
        yield table.slice(a, b - a)


def _window_spans(clips: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for buckets of very many distinct runs: one row per window, met by its hash."""

    def windows(batches):
        for batch in batches:
            for i, raw in enumerate(batch.column("bytes").to_pylist()):
                n = batch.column("n")[i].as_py()
                starts = np.arange(n)
                bytes_ = np.frombuffer(raw, np.uint8)
                one, two = (span_hashes(v[bytes_], starts, starts + length) for v in (_VALUES, _SECOND))
                same = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     batch.column("place").take(same), batch.column("row").take(same),
                     pa.array((starts + batch.column("at")[i].as_py()).astype(np.int32)),
                     batch.column("times").take(same)], ["one", "two", "place", "row", "from", "times"])

    rows = clips.mapInArrow(
        windows, "one bigint, two bigint, place bigint, row bigint, from int, times bigint")
    met = rows.groupBy("one", "two").agg(
        F.sum("times").alias("all"), F.min(F.struct("place", "row", "from")).alias("first")).filter("all > 1")
    both = rows.join(met, ["one", "two"])
    if keep_first:
        both = both.filter((F.col("row") != F.col("first.row")) | (F.col("from") != F.col("first.from")))
    return both.select("row", "from", (F.col("from") + length).alias("to"))
