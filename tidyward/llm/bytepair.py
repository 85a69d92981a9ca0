"""Byte-level BPE encoding by overlapping chunks, and decoding.

A long text is cut into chunks that reach over into the next one. Chunks are
pre-tokenised in parallel, from wherever they begin; in the overlap, the first border
that a chunk and its successor share is where they resynchronise, since matching only
looks forward. The piece between two such borders is then encoded, again in parallel,
and the pieces' ids are put together. A text within one chunk has nothing to stitch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidyward.llm.common import store
from tidyward.llm.words import Tokens, encoder, text_batches

#: A border within so many characters of a cut-off end may depend on what follows.
LOOK_AHEAD = 4
_BY_ID = "id {kind}, row bigint, "


def meeting_point(text: str, size: int) -> int | None:
    """The first border from ``size`` on that both a pass over ``text`` and one from ``size`` on
    have; None if there is none."""
    sure = len(text) - LOOK_AHEAD
    here = Tokens([text]).starts
    there = Tokens([text[size:]]).starts + size
    both = np.intersect1d(here[(here >= size) & (here <= sure)], there[there <= sure])
    return int(both[0]) if len(both) else None


def encode_texts(docs: DataFrame, vocabulary: str, chunk: int = 32_768, overlap: int = 1_024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids (little-endian unsigned 32-bit), decoded (bytes).

    ``vocabulary`` is the path of a rank file, the same on every machine; ``chunk`` and
    ``overlap`` are characters. Null counts as the empty text: no ids, no bytes. Should a
    chunk share no border with its successor (a pre-token longer than the overlap), its
    document is encoded whole. Rows of more than one chunk are numbered and stored once, so it doesn't
    matter if a later scan deals them out differently. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                       text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    by_id = _BY_ID.format(kind=kind)
    long = F.char_length("text") > chunk

    whole = _encoded(rows.filter(~long), vocabulary, by_id)

    def cut(batches):
        for batch in batches:
            for i, t in enumerate(batch.column("text").to_pylist()):
                starts = range(0, max(1, len(t) - overlap), chunk)
                out = [t[s:s + chunk + overlap] if s != starts[-1] else t[s:] for s in starts]
                n = len(out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array([i] * n)),
                     batch.column("row").take(pa.array([i] * n)), pa.array(range(n), pa.int32()),
                     pa.array([k == n - 1 for k in range(n)]), pa.array(out, pa.string())],
                    ["id", "row", "k", "last", "text"])

    def meet(batches):
        for batch in batches:
            ends = [len(t) if last else meeting_point(t, chunk) for t, last in
                    zip(batch.column("text").to_pylist(), batch.column("last").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends, pa.int32())], [*batch.schema.names, "end"])

    longs = store(rows.filter(long))
    chunks = longs.mapInArrow(cut, by_id + "k int, last boolean, text string")
    passes = store(chunks.repartition("row", "k").mapInArrow(
        meet, by_id + "k int, last boolean, text string, end int"))
    lost = passes.filter(F.col("end").isNull()).select("row").distinct()
    # a chunk begins where its predecessor's piece ends
    begins = passes.filter(~F.col("last")).select(
        "row", (F.col("k") + 1).alias("k"), (F.col("end") - chunk).alias("begin"))
    stitched = passes.join(lost, "row", "left_anti").join(begins, ["row", "k"], "left").select(
        "id", "row", "k", F.coalesce("begin", F.lit(0)).alias("begin"), "end", "text")

    def encode_pieces(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            ids = []
            for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "begin", "end"))):
                tokens = Tokens([t[a:b + LOOK_AHEAD]])
                inside = tokens.starts < b - a
                tokens.starts, tokens.ends = tokens.starts[inside], tokens.ends[inside]
                tokens.of_text = tokens.of_text[inside]
                ids.append(coder._ids(tokens, np.zeros(1, np.int64), [], 1)[0]
                           .astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), batch.column("k"),
                 pa.array(ids, pa.binary())], ["id", "row", "k", "ids"])

    def join_pieces(pieces):
        pieces = pieces.sort_by("k")
        ids = b"".join(pieces.column("ids").to_pylist())
        return pa.table({
            "id": pieces.column("id")[:1], "n_tokens": pa.array([len(ids) // 4], pa.int64()),
            "ids": pa.array([ids], pa.binary()),
            "decoded": pa.array([decode_ids(ids, vocabulary)], pa.binary())})

    out = f"id {kind}, n_tokens bigint, ids binary, decoded binary"
    joined = stitched.mapInArrow(encode_pieces, by_id + "k int, ids binary").groupBy(
        "row").applyInArrow(join_pieces, out)
    unstitched = _encoded(longs.join(lost, "row", "left_semi"), vocabulary, by_id)
    return whole.unionByName(joined).unionByName(unstitched).withColumnRenamed("id", id_col)


def decode_ids(ids: bytes, vocabulary: str) -> bytes:
    """The bytes that ids (little-endian unsigned 32-bit) stand for."""
    return encoder(vocabulary).vocabulary.decode(np.frombuffer(ids, "<u4").astype(np.int64)).tobytes()


def _encoded(rows: DataFrame, vocabulary: str, by_id: str) -> DataFrame:
    """Each text encoded in its own task."""

    def encode(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_batches(texts):
                ids, n = coder.encode(texts[a:b])
                ends = np.cumsum(n)
                ids = ids.astype("<u4")
                parts = [ids[e - c:e].tobytes() for e, c in zip(ends, n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[a:b], pa.array(n, pa.int64()), pa.array(parts, pa.binary()),
                     pa.array([decode_ids(p, vocabulary) for p in parts], pa.binary())],
                    ["id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(
        encode, by_id.replace("row bigint, ", "") + "n_tokens bigint, ids binary, decoded binary")
