"""Exact deduplication by recipes of content-defined chunks, in DataFrame functions only.

Texts are cut where their content says so. Every distinct chunk is moved once and
gets an identifier; chunks that share a fingerprint are told apart by comparing their
bytes. Documents are then equal exactly if their ordered identifier lists are equal,
and only those lists are grouped and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidyward.llm.common import rank_of, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunk_pattern(least: int, most: int) -> str:
    """From ``least`` characters on to the next mark, or ``most`` characters."""
    return rf"(?s).{{{least},{most - 1}}}?[\n.!?,;]|.{{1,{most}}}"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 least: int = 1024, most: int = 8192, fingerprint=F.xxhash64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; null counts as the
    empty text. Of a group the largest id stays (null ids are lowest); of repeated rows
    with that id exactly one stays. ``fingerprint`` may be any hash: chunks on which it
    clashes get identifiers by their bytes. The frame must read the same in every scan,
    as a table of files does. Other columns are ignored.
    """
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    pattern = F.lit(chunk_pattern(least, most))
    cut = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                      text.alias("text"))
    cut = cut.select("id", "row", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                     F.regexp_extract_all("text", pattern, F.lit(0)).alias("chunks"))
    recipes = store(cut.withColumn("recipe", F.transform("chunks", lambda c: fingerprint(c))))

    # the one movement of text: every distinct chunk once, combined before the shuffle
    chunks = recipes.select(F.explode(F.arrays_zip(
        F.col("recipe").alias("mark"), F.col("chunks").alias("chunk"))).alias("c")).select(
        "c.mark", "c.chunk").distinct()
    clashes = store(chunks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    recipes = recipes if clashes.isEmpty() else _told_apart(recipes, clashes)

    order = rank_of("id")
    groups = recipes.groupBy("recipe").agg(
        F.max_by("row", order).alias("keep_row"), F.max("id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"))
    return recipes.select("id", "row", "recipe", "text_sha256").join(groups, "recipe").select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def _told_apart(recipes: DataFrame, clashes: DataFrame) -> DataFrame:
    """Recipes whose entries also hold the number of the chunk among those of its fingerprint."""
    spread = recipes.select("row", F.posexplode(F.arrays_zip(
        F.col("recipe").alias("mark"), F.col("chunks").alias("chunk"))).alias("at", "c")).select(
        "row", "at", "c.mark", "c.chunk")
    clashing = spread.join(clashes.select("mark"), "mark", "left_semi")
    numbered = clashing.select("mark", "chunk").distinct().withColumn(
        "variant", F.row_number().over(Window.partitionBy("mark").orderBy("chunk")))
    fixed = clashing.join(numbered, ["mark", "chunk"]).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "variant"))).alias("variants"))
    return recipes.join(fixed, "row", "left").withColumn("recipe", F.transform(
        "recipe", lambda mark, at: F.struct(
            mark, F.coalesce(F.try_element_at("variants", at), F.lit(0)).alias("variant")))
    ).drop("variants")
