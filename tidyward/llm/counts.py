"""Token counts: pre-tokens held as ragged arrays, merged in step with the ranks.

Distinct pre-tokens of a batch of texts are merged together; a text's count is the
sum of the surviving symbols of its pre-tokens. See :mod:`tidyward.llm.words`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidyward.llm.words import encoder, text_batches


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the path of a byte-pair vocabulary, the same on every machine.
    Special strings in a text are one token each, as the file says. Null counts as the
    empty text (0 tokens); repeated rows are counted each. No shuffle, and a batch holds
    a bounded number of characters besides its longest text. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))

    def count(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_batches(texts):
                n = coder.count(texts[a:b])
                size = [len(t.encode("utf-8", "replace")) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[a:b], pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    ).withColumnRenamed("id", id_col)
