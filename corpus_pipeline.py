"""Text corpus pipeline: quality, lines, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, read
back from Parquet. All but the last return the columns of ``documents``, with n_chars of
the text as it is then. Operators see the other columns under names of this module, so a
column may have any name; it comes out as it went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidyward.llm.common import store
from tidyward.llm.lines import drop_templates
from tidyward.llm.near import near_groups
from tidyward.llm.packing import pack_tokens
from tidyward.llm.quality import score_quality
from tidyward.llm.queries import vocabulary
from tidyward.llm.repeats import drop_repeats

OWN = ("doc_id", "text")


def veiled(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns by their number."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in OWN else f"__own{i}") for i, c in enumerate(docs.columns)])


def unveiled(found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a table that was veiled, n_chars being that of the text."""
    length = F.char_length("text").cast("bigint")
    return found.select(*[length.alias(c) if c == "n_chars" else F.col(c if c in OWN else f"__own{i}").alias(c)
                          for i, c in enumerate(columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1. Learns from labels not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = score_quality(veiled(docs), labels).filter("predicted = 1")
    return judged.select(*[F.col(c if c in OWN else f"__own{i}").alias(c) for i, c in enumerate(docs.columns)])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring template lines. The document of the smallest id keeps them, so
    that no content of near copies is lost before one of them is chosen."""
    return unveiled(drop_templates(veiled(docs), keep_first=True, whole_lines=True), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    numbered = store(veiled(docs).withColumn("__row", F.monotonically_increasing_id()))
    gone = near_groups(numbered, row_col="__row").filter(~F.col("kept")).select(F.col("row").alias("__row"))
    kept = numbered.join(gone.hint("shuffle_hash"), "__row", "left_anti")
    return kept.select(*[F.col(c if c in OWN else f"__own{i}").alias(c) for i, c in enumerate(docs.columns)])


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of 200 bytes or more."""
    hidden = veiled(docs)
    cut = drop_repeats(hidden, carry=tuple(c for c in hidden.columns if c not in OWN))
    return unveiled(cut.withColumn("text", F.col("kept").cast("string")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return pack_tokens(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates),
          ("suffix-array dedup", passages), ("packing", packing)]

#: SQL can neither fit the classifier nor encode texts; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs)
    return docs
