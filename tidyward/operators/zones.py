"""Zones by nearest reference point, and collection days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.functions.geo import haversine_m
from tidyward.operators.flags import content_fingerprint
from tidyward.session import broadcast_within, cut, join_known, pinned

#: The cell tree: 2 ** FAN_BITS cells a side below each cell, LEVELS levels.
FAN_BITS, LEVELS = 4, 10
#: Cells are not split below so many different places.
LEAF = 64


def _known(c: str) -> Column:
    return F.abs(F.col(c).cast("double")) < float("inf")


def nearest_reference(points: DataFrame, references: DataFrame) -> DataFrame:
    """Nearest reference in degree space of each distinct (lat, lon).

    ``references``: ref_id, lat, lon, zone. Returns lat, lon, zone, ref_id,
    distance_deg, ref_lat, ref_lon. Ties go to the smaller ref_id; coordinates that are
    null or not finite take no part.

    References stand in a tree of square cells over their own extent, split where they are
    dense. Points are grouped by the cells of the deepest level first, and only these groups' boxes go
    down the tree, a join per level: of the cells below a box's cells, those stay that may hold
    something nearer than the farthest corner of the best one. The references that may be
    nearest to something in a box then meet its points in one join, on the cell and a slice of the points.
    Points beyond the extent fall into cells of their own there. Only the extent, a
    count per level and the size of the candidates reach the driver.
    """
    points = points.select("lat", "lon").where(_known("lat") & _known("lon")).distinct()
    refs = references.select(F.col("ref_id").cast("bigint").alias("ref_id"), F.col("lat").cast("double").alias("rlat"),
                             F.col("lon").cast("double").alias("rlon"), "zone") \
        .where(_known("rlat") & _known("rlon")).groupBy("rlat", "rlon") \
        .agg(F.min("ref_id").alias("ref_id"), F.min_by("zone", "ref_id").alias("zone"))
    refs = cut(refs)
    lat0, lat1, lon0, lon1 = refs.agg(F.min("rlat"), F.max("rlat"), F.min("rlon"), F.max("rlon")).first()
    if lat0 is None:
        near = points.select("lat", "lon", F.lit(None).cast(
            "struct<d2:double,ref_id:bigint,zone:string,rlat:double,rlon:double>").alias("__best")).limit(0)
        return _named(near)
    side = 1 << (FAN_BITS * LEVELS)
    width = max(lat1 - lat0, lon1 - lon0) or 1.0
    # far beyond the extent all points share the outermost cells of their side
    fine = lambda c, low: F.floor(F.greatest(F.least((F.col(c) - low) / width, F.lit(2.0 ** 20)),
                                             F.lit(-2.0 ** 20)) * side).cast("bigint")
    inner = lambda c, low: F.least(fine(c, low), F.lit(side - 1))
    refs = refs.withColumns({"fi": inner("rlat", lat0), "fj": inner("rlon", lon0)})
    at = lambda c, level: F.shiftright(c, FAN_BITS * (LEVELS - level))
    levels = refs.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), at("fi", k).alias("i"), at("fj", k).alias("j"))
        for k in range(LEVELS + 1)])).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("c.level").agg(F.max("n")).collect()      # a row per level
    depth = min([k for k, n in levels if n <= LEAF], default=LEVELS)

    points = cut(points.select("lat", "lon", at(fine("lat", lat0), depth).alias("pi"),
                               at(fine("lon", lon0), depth).alias("pj")))
    boxes = points.groupBy("pi", "pj").agg(F.min("lat").alias("lat1"), F.max("lat").alias("lat2"),
                                           F.min("lon").alias("lon1"), F.max("lon").alias("lon2"))
    # the root has one cell, so the way down starts below it without a join
    seen = boxes.withColumns({"i": F.lit(0).cast("bigint"), "j": F.lit(0).cast("bigint")})
    for level in range(1, depth + 1):
        seen = _go_down(seen, refs, at, level)
    leaves = refs.select(at("fi", depth).alias("i"), at("fj", depth).alias("j"), "ref_id", "zone", "rlat", "rlon")
    near = _within_boxes(seen.join(leaves, ["i", "j"]))
    near = broadcast_within(cut(near))
    square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    best = points.join(near, ["pi", "pj"]).groupBy("lat", "lon").agg(F.min(F.struct(
        (square("lat", "rlat") + square("lon", "rlon")).alias("d2"), "ref_id", "zone", "rlat", "rlon"))
        .alias("__best"))
    return _named(best)


def _bounds(lat1: Column, lat2: Column, lon1: Column, lon2: Column) -> tuple[Column, Column]:
    """Squared distances between a row's box and another: that of their nearest points, and the
    largest from any point of the row's box to the farthest corner of the other."""
    gap = lambda low, high, a, b: F.greatest(low - F.col(b), F.col(a) - high, F.lit(0.0))
    far = lambda low, high, a, b: F.greatest(high - F.col(a), F.col(b) - low)
    return tuple(f(lat1, lat2, "lat1", "lat2") * f(lat1, lat2, "lat1", "lat2")
                 + f(lon1, lon2, "lon1", "lon2") * f(lon1, lon2, "lon1", "lon2") for f in (gap, far))


#: A little room, so that rounding never loses the nearest.
ROOM = 1 + 1e-9


def _go_down(seen: DataFrame, refs: DataFrame, at, level: int) -> DataFrame:
    """Replace the cells (i, j) of each box by those of the next level that may hold the nearest of its points."""
    cells = refs.groupBy(at("fi", level).alias("ci"), at("fj", level).alias("cj")).agg(
        F.min("rlat").alias("a1"), F.max("rlat").alias("a2"), F.min("rlon").alias("b1"), F.max("rlon").alias("b2"))
    below = cells.groupBy(F.shiftright("ci", FAN_BITS).alias("i"), F.shiftright("cj", FAN_BITS).alias("j")).agg(
        F.collect_list(F.struct("ci", "cj", "a1", "a2", "b1", "b2")).alias("cells"))   # 256 at most

    def bounds(c):
        least, most = _bounds(c["a1"], c["a2"], c["b1"], c["b2"])
        return F.struct(c["ci"].alias("i"), c["cj"].alias("j"), least.alias("least"), most.alias("most"))

    box = ["pi", "pj", "lat1", "lat2", "lon1", "lon2"]
    both = seen.join(below, ["i", "j"]).select(*box, F.transform("cells", bounds).alias("c")) \
        .withColumn("best", F.array_min(F.transform("c", lambda c: c["most"])))
    kept = both.select(*box, F.explode(F.filter("c", lambda c: c["least"] <= F.col("best") * ROOM)).alias("c"))
    kept = kept.withColumn("best", F.min("c.most").over(Window.partitionBy("pi", "pj")))
    return kept.where(F.col("c.least") <= F.col("best") * ROOM).select(*box, "c.i", "c.j")


def _within_boxes(pairs: DataFrame) -> DataFrame:
    """Of (box, reference) pairs those whose reference may be the nearest of a point of the box."""
    least, most = _bounds(F.col("rlat"), F.col("rlat"), F.col("rlon"), F.col("rlon"))
    pairs = pairs.withColumns({"least": least, "most": most}) \
        .withColumn("best", F.min("most").over(Window.partitionBy("pi", "pj")))
    return pairs.where(F.col("least") <= F.col("best") * ROOM).select("pi", "pj", "ref_id", "zone", "rlat", "rlon")


def _named(near: DataFrame) -> DataFrame:
    return near.select("lat", "lon", "__best.zone", "__best.ref_id",
                       F.sqrt("__best.d2").alias("distance_deg"),
                       F.col("__best.rlat").alias("ref_lat"), F.col("__best.rlon").alias("ref_lon"))


def assign_zones(df: DataFrame, references: DataFrame | None) -> DataFrame:
    """Add ``zone``, ``zone_distance_m``, ``zone_true_m`` and ``zone_uncertain``.

    ``zone_distance_m`` takes the distance in degrees as a latitude offset;
    ``zone_true_m`` is the great-circle distance.
    """
    df = df.withColumns({"lat": T.to_number("lat"), "lon": T.to_number("lon")})
    if references is None:
        return df.withColumns({"zone": F.lit(R.ZONE_UNKNOWN),
                               "zone_distance_m": F.lit(None).cast("double"),
                               "zone_true_m": F.lit(None).cast("double"),
                               "zone_uncertain": F.lit(None).cast("boolean")})
    near = nearest_reference(df, references)
    metres = haversine_m("lat", "lon", F.col("lat") + F.col("distance_deg"), F.col("lon"))
    near = near.select("lat", "lon", F.col("zone").alias("__zone"),
                       F.bround(metres, 1).alias("zone_distance_m"),
                       F.bround(haversine_m("lat", "lon", "ref_lat", "ref_lon"), 1)
                       .alias("zone_true_m"))
    return (join_known(df, pinned(near), ["lat", "lon"])
            .withColumns({"zone": F.coalesce("__zone", F.lit(R.ZONE_UNKNOWN)),
                          "zone_uncertain": F.col("zone_distance_m") > R.ZONE_UNCERTAIN_M})
            .drop("__zone"))


def collection_days(df: DataFrame, days: dict = R.ZONE_DAYS) -> DataFrame:
    """Add ``collection_day`` and ``same_day`` (1/0 when both weekdays are known)."""
    df = df.withColumn("collection_day", T.lookup("zone", days))
    both = F.col("collection_day").isNotNull() & F.col("weekday").isNotNull()
    return df.withColumn("same_day", F.when(
        both, (T.strip("weekday") == T.strip("collection_day")).cast("int")))


def enrich(df: DataFrame, references: DataFrame | None, days: dict = R.ZONE_DAYS) -> DataFrame:
    """Zone, distance, collection day and same-day flag of every row."""
    return collection_days(assign_zones(df, references), days)


def coordinate_fingerprint(df: DataFrame) -> DataFrame:
    """Fingerprint of the coordinates by ticket, to tell when zones must be redone."""
    return content_fingerprint(df, ["ticket", "lat", "lon"])


def enrichment_stats(df: DataFrame) -> DataFrame:
    """One row: rows, rows in town and on the collection day, with rates."""
    in_city = ~F.col("zone").isin(R.ZONE_UNKNOWN, R.ZONE_OUTSIDE)
    same = F.coalesce(F.col("same_day") == 1, F.lit(False))
    rate = lambda c: F.coalesce(F.round(F.avg(c.cast("double")) * 100, 1), F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(in_city).alias("in_city"), rate(in_city).alias("in_city_pct"),
                  F.count_if(same).alias("same_day"), rate(same).alias("same_day_pct"))
