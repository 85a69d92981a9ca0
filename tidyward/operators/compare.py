"""Comparison of a result with a verified copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidyward.functions import text as T


def _sides(left: DataFrame, right: DataFrame, columns: list[str] | None, key: str,
           check_duplicates: bool) -> tuple[DataFrame, list[str]]:
    for name, df in (("left", left), ("right", right)):
        if key not in df.columns:
            raise ValueError(f"{name} table has no column {key!r}")
    both = [c for c in left.columns if c in right.columns and c != key and not c.startswith("_")]
    columns = sorted(both) if columns is None else [c for c in columns if c in both]
    side = lambda df, tag: df.select(
        F.col(key).cast("string").alias(key), F.lit(True).alias(f"__{tag}"),
        *[F.col(c).alias(f"{c}_{tag}") for c in columns])
    if check_duplicates:
        for name, df in (("left", left), ("right", right)):
            if not df.groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError(f"{name} table has repeated {key!r} values")
    return side(left, "left").join(side(right, "right"), key, "full"), columns


def _norm(c: str) -> Column:
    return F.lower(T.strip(F.col(c).cast("string")))


def compare_tables(left: DataFrame, right: DataFrame, columns: list[str] | None = None,
                   key: str = "ticket", check_duplicates: bool = True) -> dict[str, DataFrame]:
    """Key overlap, agreement per column and the paired rows, from one full join.

    Values are compared as stripped lower-case text; two nulls agree.
    """
    joined, columns = _sides(left, right, columns, key, check_duplicates)
    in_left, in_right = F.col("__left").isNotNull(), F.col("__right").isNotNull()
    paired = in_left & in_right
    keys = joined.agg(
        F.count_if(paired).alias("matched_rows"),
        F.count_if(in_left & ~in_right).alias("only_left"),
        F.count_if(in_right & ~in_left).alias("only_right"))
    counts = joined.where(paired).agg(F.count(F.lit(1)).alias("__n"), *[
        F.struct(F.count_if(_norm(f"{c}_left").eqNullSafe(_norm(f"{c}_right"))).alias("agree"),
                 F.count_if(F.col(f"{c}_left").isNull()).alias("missing")).alias(f"__c{i}")
        for i, c in enumerate(columns)])
    per_column = counts.select("__n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__c{i}.agree").alias("agree"),
                 F.col(f"__c{i}.missing").alias("missing")) for i, c in enumerate(columns)
    ])).alias("c")).select(
        "c.column", "c.agree", (F.col("__n") - F.col("c.agree")).alias("differ"), "c.missing",
        F.when(F.col("__n") > 0, F.round(F.col("c.agree") / F.col("__n") * 100, 1))
        .alias("agree_pct"))
    diff = joined.where(paired).drop("__left", "__right")
    return {"keys": keys, "per_column": per_column, "diff": diff}
