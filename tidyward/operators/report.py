"""Filters, distributions, headline figures and map rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.functions.geo import in_box

FACETS = ["zone", "category", "responsibility", "status", "month"]


def slice_rows(df: DataFrame, recurrence: str | None = None, **equals) -> DataFrame:
    """Rows matching every given facet; ``recurrence`` is "repeated" or "first"."""
    for column, wanted in equals.items():
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    if recurrence is not None:
        df = df.where(F.col("is_recurring") == {"repeated": 1, "first": 0}[recurrence])
    return df


def facet_values(df: DataFrame, facets: list[str] = FACETS) -> DataFrame:
    """Distinct values per facet: facet, value; one pass over the table."""
    present = [f for f in facets if f in df.columns]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))
        for f in present]))
    return (df.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL")
            .distinct().orderBy("facet", "value"))


def search(df: DataFrame, needle: str, columns: list[str] | None = None,
           pattern: bool = False) -> DataFrame:
    """Rows with ``needle`` in any column, ignoring case; a pattern on request."""
    cells = [F.coalesce(F.lower(F.col(c).cast("string")), F.lit(""))
             for c in (columns or df.columns)]
    hit = (lambda c: c.rlike("(?iu)" + needle)) if pattern \
        else (lambda c: c.contains(needle.lower()))
    return df.where(T.any_of([hit(c) for c in cells]))


def still_missing(df: DataFrame) -> DataFrame:
    return df.where(T.to_number("lat").isNull())


def is_located(df: DataFrame) -> DataFrame:
    """One row, ``geocoded``: whether any row has a numeric latitude."""
    if "lat" not in df.columns:
        return df.agg(F.coalesce(F.max(F.lit(False)), F.lit(False)).alias("geocoded"))
    return df.agg(F.coalesce(F.max(T.to_number("lat").isNotNull()), F.lit(False)).alias("geocoded"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most first."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column))


def monthly(df: DataFrame, column: str = "month") -> DataFrame:
    """Rows per month in calendar order, with the month's name."""
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("int").alias("month"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .select("month", T.month_name("month").alias("name"), "rows").orderBy("month"))


def headline(df: DataFrame) -> DataFrame:
    """One row: top category and street with counts; recurring, municipal and same-day rates."""
    def top(column: str, tag: str) -> DataFrame:
        best = (df.where(F.col(column).isNotNull()).groupBy(column)
                .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1))
        return best.agg(F.coalesce(F.max(column), F.lit("—")).alias(f"top_{tag}"),
                        F.coalesce(F.max("n"), F.lit(0)).alias(f"top_{tag}_rows"))

    pct = lambda c: F.coalesce(F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")) * 100, 1),
                               F.lit(0.0))
    flag = lambda c: F.col(c) == 1 if c in df.columns else F.lit(False)
    municipal = F.col("responsibility").isin("עירייה", "כשל עירוני") \
        if "responsibility" in df.columns else F.lit(False)
    rates = df.agg(F.count(F.lit(1)).alias("rows"), pct(flag("is_recurring")).alias("recurring_pct"),
                   pct(municipal).alias("municipal_pct"), pct(flag("same_day")).alias("same_day_pct"))
    one = lambda d: d.withColumn("__k", F.lit(1))
    return (one(rates).join(one(top("category", "category")), "__k")
            .join(one(top("street", "street")), "__k").drop("__k"))


def hotspots(df: DataFrame, keys=("street", "house", "category"), top: int = 10) -> DataFrame:
    """The keys with most recurring rows."""
    known = T.all_of([F.col(k).isNotNull() for k in keys])
    return (df.where((F.col("is_recurring") == 1) & known).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("repeats"))
            .orderBy(F.desc("repeats"), *keys).limit(top))


def repeated_addresses(df: DataFrame, keys=("street", "house")) -> DataFrame:
    """Unlocated rows whose address occurs more than once: keys, tickets at it, ticket.

    One row per ticket, so an address of any size stays spread out.
    """
    rows = still_missing(df).select(
        *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], "ticket")
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("tickets")).where("tickets > 1")
    return rows.join(many, list(keys)).select(*keys, "tickets", "ticket")


def heat_points(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Located rows as lat, lon (6 places) and weight."""
    heavy = F.coalesce(T.to_number(weight), F.lit(1.0)) \
        if weight is not None and weight in df.columns else F.lit(1.0)
    return (df.select(T.to_number("lat").alias("lat"), T.to_number("lon").alias("lon"),
                      heavy.alias("weight"))
            .where("lat IS NOT NULL AND lon IS NOT NULL")
            .select(F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"), "weight"))


def marker_rows(df: DataFrame, most: int | None = None) -> DataFrame:
    """Located rows for a map layer; with ``most``, the first so many by date and ticket."""
    shown = [c for c in ("street", "house", "category", "zone", "date") if c in df.columns]
    rows = df.withColumns({"lat": T.to_number("lat"), "lon": T.to_number("lon")}) \
        .where("lat IS NOT NULL AND lon IS NOT NULL")
    order = [c for c in ("date", "ticket") if c in df.columns]
    if most is not None:
        rows = rows.orderBy(*order).limit(most)
    return rows.select(
        F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in shown])


def severity_points(flagged: DataFrame, box=R.WIDE_BOX) -> DataFrame:
    """Located rows in the wide box, with severity and labels."""
    return (flagged.withColumns({"lat": T.to_number("lat"), "lon": T.to_number("lon")})
            .where(in_box("lat", "lon", box))
            .select("ticket", "lat", "lon", "street", "house", "flag_severity",
                    F.when(F.col("flag_labels") == "", "תקין").otherwise(F.col("flag_labels"))
                    .alias("flag_labels")))


def map_centre(points: DataFrame, default=R.MAP_CENTRE) -> DataFrame:
    """One row: the mean point, or the default centre without points."""
    return points.agg(F.coalesce(F.avg("lat"), F.lit(default[0])).alias("lat"),
                      F.coalesce(F.avg("lon"), F.lit(default[1])).alias("lon"))
