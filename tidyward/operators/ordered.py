"""Running numbers within groups, safe for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidyward.functions.text import all_of
from tidyward.session import cut


TASK_ROWS = 1_000_000


def sequence_in_group(df: DataFrame, keys: list[str], order: list[str], out: str,
                      hot_rows: int | None = None, slices: int = 256) -> DataFrame:
    """Number the rows of each group 1, 2, 3, ... by ``order``; a null key gives null.

    ``order`` should end with a unique column. Groups are counted first (combined before
    the shuffle, on the key columns only), so a caller stores ``df`` if its keys are costly. A group of
    more than ``hot_rows`` rows (``TASK_ROWS`` by default) never reaches one task: its order is cut into
    slices at sampled bounds, each slice is numbered by itself and starts at the rows counted
    before it. Groups up to that size are sorted in one task each, within its memory or by spilling.
    """
    known = all_of([F.col(k).isNotNull() for k in keys])
    # rows without a key are not numbered, so they spread by their own order columns
    spread = F.when(~known, F.xxhash64(*order)).otherwise(F.lit(0))
    plain = Window.partitionBy(*keys, "__spread").orderBy(*order)

    def numbered(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("__spread", spread)
                .withColumn(out, F.when(known, F.row_number().over(plain)).cast("bigint"))
                .drop("__spread"))

    sizes = df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = cut(sizes.where(F.col("__n") > (TASK_ROWS if hot_rows is None else hot_rows)))
    if hot.isEmpty():
        return numbered(df)

    df = cut(df)
    keyed = df.where(known)
    # keys are never null in `hot`, so rows without a key stay on the cold side
    cold = numbered(df.join(hot, keys, "left_anti"))
    rank = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    rows = keyed.join(hot, keys)
    # the sample only places the bounds; any bounds give the same numbers
    picked = rows.where(F.rand(7) < slices * 20 / F.col("__n")).select(*keys, rank.alias("__r"))
    bounds = cut(
        picked.withColumn("__q", F.ntile(slices).over(Window.partitionBy(*keys).orderBy("__r")))
        .groupBy(*keys, "__q").agg(F.min("__r").alias("__b"))
        .groupBy(*keys).agg(F.array_sort(F.collect_list("__b")).alias("__bounds")))
    placed = (
        rows.drop("__n").join(bounds, keys, "left")
        .withColumn("__r", rank)
        .withColumn("__slice", F.coalesce(
            F.size(F.filter("__bounds", lambda b: b <= F.col("__r"))), F.lit(0)))
        .drop("__bounds", "__r"))
    before = cut(
        placed.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__before", F.sum("__c").over(
            Window.partitionBy(*keys).orderBy("__slice")
            .rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "__slice", F.coalesce("__before", F.lit(0)).alias("__before")))
    sliced = Window.partitionBy(*keys, "__slice").orderBy(*order)
    split = (
        placed.withColumn(out, F.row_number().over(sliced).cast("bigint"))
        .join(before, [*keys, "__slice"])
        .withColumn(out, F.col(out) + F.col("__before"))
        .drop("__slice", "__before"))
    return cold.unionByName(split)


def recurrence(df: DataFrame, keys=("street", "house", "category"),
               order=("date", "opened_at", "ticket"), hot_rows: int | None = None) -> DataFrame:
    """Add ``recurrence_no`` and ``is_recurring`` (1 from the second row of a key on)."""
    out = sequence_in_group(df, list(keys), list(order), "recurrence_no", hot_rows)
    return out.withColumn(
        "is_recurring", F.coalesce((F.col("recurrence_no") > 1).cast("int"), F.lit(0)))
