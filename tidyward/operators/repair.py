"""Repair of older files: method labels, collapsed points, precision tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.operators.zones import enrich
from tidyward.session import join_known, pinned


def coerce_coordinates(df: DataFrame) -> DataFrame:
    return T.once(df, {c: T.to_number(c) for c in ("lat", "lon") if c in df.columns})


def located() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull()


def relabel_methods(df: DataFrame) -> DataFrame:
    """Rows that have a point although their method says otherwise were set by hand."""
    return df.withColumn("geocode_method", F.when(
        located() & F.col("geocode_method").isin(R.RELABEL_METHODS), "manual_backfilled")
        .otherwise(F.col("geocode_method")))


def collapsed_points(df: DataFrame, min_rows: int = 5, min_houses: int = 4) -> DataFrame:
    """Points shared by many rows of different houses: lat, lon, rows, houses.

    Counts rows per (point, house) first, so one crowded point spreads over tasks.
    """
    house = T.text("house")
    counted = F.when(~house.isin("", "nan", "None", "0", "NaN")
                     & ~F.coalesce(F.col("loc_type"), F.lit("")).isin(R.LOC_RANGE, R.LOC_LANDMARK),
                     house)
    return (
        df.where(located()).groupBy("lat", "lon", counted.alias("__house"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .groupBy("lat", "lon").agg(F.sum("__n").alias("rows"), F.count("__house").alias("houses"))
        .where((F.col("rows") >= min_rows) & (F.col("houses") >= min_houses)))


def backfill_precision(df: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Precision from the method; geocoder rows by whether their point is collapsed."""
    marked = pinned(collapsed.select("lat", "lon", F.lit(True).alias("__collapsed")))
    method = F.col("geocode_method")
    tier = (F.when(~located(), "none")
            .when(method.isin(R.GEOCODER_METHODS),
                  F.when(F.col("__collapsed"), "street").otherwise("address_unverified"))
            .otherwise(T.lookup(method, R.METHOD_TIER, "none")))
    return (join_known(df, marked, ["lat", "lon"]).withColumn("precision", tier)
            .drop("__collapsed"))


def repair(df: DataFrame, references: DataFrame | None) -> DataFrame:
    """Coerce, relabel, re-tier and re-zone a whole table."""
    df = relabel_methods(coerce_coordinates(df))
    return enrich(backfill_precision(df, collapsed_points(df)), references)
