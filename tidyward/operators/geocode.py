"""Geocoding as joins against reference tables, on distinct address keys."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.functions.geo import grid_to_degrees, in_box
from tidyward.operators.streets import (
    resolve_layer_names, resolve_registry, resolve_street_codes,
)
from tidyward.schema import ensure_columns
from tidyward.session import cut, pinned, rule_table

KEY = ["k_street", "k_house", "k_type", "k_cross"]
MISSING = ["", "0", "nan", "None"]

# -- address points -----------------------------------------------------------


def address_index(points: DataFrame) -> DataFrame:
    """(street_code, key) -> point, keyed by raw and by numeric house; the last row wins.

    ``seq`` is where the key first appeared.
    """
    keys = F.array_distinct(F.filter(
        F.array(T.strip("house_raw"), F.col("house_no").cast("string")),
        lambda k: k.isNotNull() & (k != "")))
    return (
        points.where(F.col("street_code").isNotNull())
        .select("street_code", F.explode(keys).alias("key"), "seq",
                F.struct(F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon")).alias("p"))
        .groupBy("street_code", "key")
        .agg(F.max_by("p", "seq").alias("point"), F.min("seq").alias("seq")))


def street_centroids(points: DataFrame) -> DataFrame:
    """Mean point of each street code."""
    return (points.where(F.col("street_code").isNotNull()).groupBy("street_code")
            .agg(F.round(F.avg("lat"), 7).alias("lat"), F.round(F.avg("lon"), 7).alias("lon")))


def code_names(points: DataFrame) -> DataFrame:
    """First name and first neighbourhood of each street code: street_code, name, neighborhood, seq."""
    first = lambda c: F.min_by(T.strip(c), F.when(T.text(c) != "", F.col("seq")))
    return (points.where(F.col("street_code").isNotNull()).groupBy("street_code")
            .agg(first("street_name").alias("name"), first("neighborhood").alias("neighborhood"),
                 F.min(F.when(T.text("street_name") != "", F.col("seq"))).alias("seq")))


def name_codes(points: DataFrame) -> DataFrame:
    """Street name -> code: name, code, seq; a name shared by codes belongs to the last."""
    return (code_names(points).where(F.col("name").isNotNull()).groupBy("name")
            .agg(F.max_by("street_code", "seq").alias("code"), F.min("seq").alias("seq")))


# -- nearest number -----------------------------------------------------------


def nearest_within(wanted: DataFrame, numbered: DataFrame, key: str, cap: int) -> DataFrame:
    """Entry of ``numbered`` (key, n, seq, point) nearest to each (key, n), at most ``cap`` off.

    Numbers fall into blocks wider than the cap, so an entry can only serve its own
    and the two neighbouring blocks: an equi-join of bounded fan-out. Ties go to
    the earlier entry.
    """
    width = cap + 1
    block = F.floor(F.col("n") / width)
    single = numbered.groupBy(key, "n").agg(F.min_by("point", "seq").alias("point"),
                                            F.min("seq").alias("seq"))
    spread = single.select(
        key, F.col("n").alias("__n"), "seq", "point",
        F.explode(F.array(block - 1, block, block + 1)).alias("__block"))
    return (
        wanted.select(key, "n").distinct().withColumn("__block", block)
        .join(spread, [key, "__block"])
        .withColumn("__off", F.abs(F.col("n") - F.col("__n"))).where(F.col("__off") <= cap)
        .groupBy(key, "n").agg(F.min_by("point", F.struct("__off", "seq")).alias("point"),
                               F.min("__off").alias("distance")))


def nearest_any(wanted: DataFrame, numbered: DataFrame, key: str) -> DataFrame:
    """Nearest entry without a cap: the closest below and above, in one ordered pass.

    Groups hold the distinct numbers of one street, and the pass streams over them.
    """
    single = numbered.groupBy(key, "n").agg(F.min_by("point", "seq").alias("point"),
                                            F.min("seq").alias("seq"))
    both = (wanted.select(key, "n").distinct()
            .join(single, [key, "n"], "full")
            .withColumn("__e", F.when(F.col("seq").isNotNull(), F.struct("n", "seq", "point"))))
    asked = wanted.select(key, "n").distinct().withColumn("__asked", F.lit(True))
    up = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    sides = both.withColumns({"__lo": F.last("__e", ignorenulls=True).over(up),
                              "__hi": F.last("__e", ignorenulls=True).over(down)})
    off = lambda e: F.abs(F.col(f"{e}.n") - F.col("n"))
    take_hi = F.col("__lo").isNull() | (off("__hi") < off("__lo")) | (
        (off("__hi") == off("__lo")) & (F.col("__hi.seq") < F.col("__lo.seq")))
    best = F.when(F.coalesce(take_hi, F.lit(False)), F.col("__hi")).otherwise(F.col("__lo"))
    return (sides.withColumn("__best", best).where(F.col("__best").isNotNull())
            .join(asked, [key, "n"], "left_semi")
            .select(key, "n", "__best.point", F.abs(F.col("__best.n") - F.col("n")).alias("distance")))


# -- local address points -----------------------------------------------------


def match_points(requests: DataFrame, points: DataFrame, cap: int = 20) -> DataFrame:
    """Locate distinct (street_code, house): exact, nearest number, street centroid.

    Returns street_code, house, lat, lon, geocode_method, precision for those found.
    """
    index = cut(address_index(points))
    df = requests.select("street_code", "house").distinct()
    raw = T.text("house")
    df = df.withColumns({"__raw": raw, "__num": T.leading_number(raw)})
    df = df.withColumns({
        "n": F.col("__num").try_cast("bigint"),
        "__whole": F.col("__raw").isin(MISSING) | F.col("__raw").rlike(r"(?U)^0+$"),
    })
    entry = lambda key, name: index.select("street_code", F.col("key").alias(key),
                                           F.col("point").alias(name))
    df = (df.join(entry("__raw", "__p1"), ["street_code", "__raw"], "left")
          .join(entry("__num", "__p2"), ["street_code", "__num"], "left")
          .withColumn("__exact", F.when(~F.col("__whole"), F.coalesce("__p1", "__p2")))
          .drop("__p1", "__p2"))
    df = cut(df)
    # both keys of one row share its seq, so the key itself settles their order
    numbered = index.select("street_code", T.leading_number("key").try_cast("bigint").alias("n"),
                            F.struct("seq", "key").alias("seq"), "point").where("n IS NOT NULL")
    wanted = df.where(F.col("__exact").isNull() & ~F.col("__whole") & F.col("n").isNotNull())
    near = nearest_within(wanted, numbered, "street_code", cap).select(
        "street_code", "n", F.col("point").alias("__near"))
    centre = street_centroids(points).select(
        "street_code", F.struct("lat", "lon").alias("__centre"))
    df = df.join(near, ["street_code", "n"], "left").join(centre, "street_code", "left")
    # an exact row also joins `near` when another spelling of its number asked for it
    found = F.coalesce("__exact", F.when(~F.col("__whole"), F.col("__near")), "__centre")
    how = (F.when(F.col("__exact").isNotNull(), "local_exact")
           .when(~F.col("__whole") & F.col("__near").isNotNull(), "local_nearest")
           .otherwise("local_street_centroid"))
    return (df.withColumn("__p", found).where(F.col("__p").isNotNull())
            .select("street_code", "house", "__p.lat", "__p.lon", how.alias("geocode_method"))
            .withColumn("precision", T.lookup("geocode_method", R.METHOD_TIER)))


def locate_locally(requests: DataFrame, points: DataFrame, registry: DataFrame | None,
                   corrections: DataFrame | None = None) -> DataFrame:
    """Locate distinct (k_street, k_house) through street codes and address points.

    A house number inside the street text is tried when the house is missing.
    """
    req = requests.select("k_street", "k_house").where(~T.is_blank("k_street")).distinct()
    inner = r"(?U)^(.+?)\s+(\d+)"
    bare = F.col("k_house").isin(MISSING)
    req = req.withColumns({
        "__in_street": F.when(bare, T.strip(T.match(F.col("k_street"), inner))),
        "__in_house": F.when(bare, T.match(F.col("k_street"), inner, 2)),
    })
    names = req.select(F.col("k_street").alias("name")).union(req.select("__in_street")) \
        .where("name IS NOT NULL").distinct()
    codes = resolve_street_codes(names, name_codes(points), registry, corrections) \
        .select("name", "code")
    tries = req.select("k_street", "k_house", F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.col("k_street").alias("name"),
                 F.col("k_house").alias("house")),
        F.struct(F.lit(1).alias("pos"), F.col("__in_street").alias("name"),
                 F.col("__in_house").alias("house")))).alias("t")) \
        .select("k_street", "k_house", "t.pos", "t.name", "t.house").where("name IS NOT NULL") \
        .join(codes, "name").withColumnRenamed("code", "street_code")
    tries = cut(tries)
    hits = match_points(tries, points)
    areas = code_names(points).select("street_code", "neighborhood")
    return (
        tries.join(hits, ["street_code", "house"]).join(areas, "street_code", "left")
        .groupBy("k_street", "k_house").agg(F.min_by(F.struct(
            "lat", "lon", "geocode_method", "precision",
            F.col("k_street").alias("geocode_query"), "neighborhood"), "pos").alias("hit")))


# -- street centroid lists ----------------------------------------------------


def centroid_table(spark) -> DataFrame:
    return rule_table(spark, ["street", "lat", "lon"], R.STREET_CENTROIDS)


def locate_by_centroid(requests: DataFrame, centroids: DataFrame,
                       method: str = "osm_centroid") -> DataFrame:
    """Exact street name to its listed centroid."""
    listed = centroids.select(F.col("street").alias("k_street"), "lat", "lon")
    return requests.select("k_street").distinct().join(listed, "k_street").select(
        "k_street", F.struct(
            "lat", "lon", F.lit(method).alias("geocode_method"), F.lit("street").alias("precision"),
            F.col("k_street").alias("geocode_query"),
            F.lit(None).cast("string").alias("neighborhood")).alias("hit"))


def is_zero_house(house: Column | str) -> Column:
    return F.coalesce(T.strip(T.col(house).cast("string")).try_cast("double") == 0, F.lit(False))


# -- building layer -----------------------------------------------------------


def locate_in_layer(requests: DataFrame, layer: DataFrame, registry: DataFrame | None,
                    corrections: DataFrame | None = None,
                    project: Callable = grid_to_degrees) -> DataFrame:
    """Locate distinct (k_street, k_house) in a building layer.

    ``layer``: street_name, house_raw, x, y, seq. Exact house, nearest house, mean
    of the street, mean of two crossing streets.
    """
    req = requests.select("k_street", "k_house").where(~T.is_blank("k_street")).distinct()
    layer = layer.where("x IS NOT NULL AND y IS NOT NULL").select(
        T.strip("street_name").alias("layer_name"), T.text("house_raw").alias("house"),
        F.struct("x", "y").alias("point"), "seq")
    names = resolve_layer_names(req.select(F.col("k_street").alias("name")),
                                layer.select(F.col("layer_name").alias("name")),
                                registry, corrections)
    req = cut(req.join(names.withColumnRenamed("name", "k_street"), "k_street"))
    crossing = F.col("layer_name").startswith(R.INTERSECTION_MARK)

    legs = (req.where(crossing).select("layer_name").distinct()
            .withColumn("__parts", F.split("layer_name", "__"))
            .select("layer_name", F.explode(F.slice(
                "__parts", F.lit(3), F.size("__parts"))).alias("__leg")))
    corners = (legs.join(layer.withColumnRenamed("layer_name", "__leg"), "__leg")
               .groupBy("layer_name").agg(F.avg("point.x").alias("x"), F.avg("point.y").alias("y"))
               .select("layer_name", F.struct("x", "y").alias("__corner")))
    centres = (layer.groupBy("layer_name")
               .agg(F.avg("point.x").alias("x"), F.avg("point.y").alias("y"))
               .select("layer_name", F.struct("x", "y").alias("__centre")))
    exact = (layer.groupBy("layer_name", "house").agg(F.min_by("point", "seq").alias("__exact"))
             .withColumnRenamed("house", "__num"))
    num = T.leading_number("k_house")
    req = req.withColumns({"__num": F.when(num != "0", num), "__cross": crossing})
    req = req.withColumn("n", F.col("__num").try_cast("bigint"))
    numbered = layer.select("layer_name", T.leading_number("house").try_cast("bigint").alias("n"),
                            "seq", "point").where("n IS NOT NULL")
    req = req.join(exact, ["layer_name", "__num"], "left")
    near = nearest_any(req.where("__exact IS NULL AND n IS NOT NULL AND NOT __cross"),
                       numbered, "layer_name") \
        .select("layer_name", "n", F.col("point").alias("__near"))
    req = (req.join(near, ["layer_name", "n"], "left").join(centres, "layer_name", "left")
           .join(corners, "layer_name", "left"))
    point = F.when(F.col("__cross"), F.col("__corner")) \
        .otherwise(F.coalesce("__exact", "__near", "__centre"))
    how = (F.when(F.col("__cross"), "gis_intersection")
           .when(F.col("__exact").isNotNull(), "gis_exact")
           .when(F.col("__near").isNotNull(), "gis_nearest")
           .otherwise("gis_centroid"))
    lat, lon = project("__p.x", "__p.y")
    return (
        req.withColumn("__p", point).where(F.col("__p").isNotNull())
        .withColumn("geocode_method", how)
        .select("k_street", "k_house", F.struct(
            lat.alias("lat"), lon.alias("lon"), "geocode_method",
            T.lookup("geocode_method", R.METHOD_TIER).alias("precision"),
            F.col("layer_name").alias("geocode_query"),
            F.lit(None).cast("string").alias("neighborhood")).alias("hit")))


# -- geocoder answers ---------------------------------------------------------


def geocoder_candidates(keys: DataFrame, corrections: DataFrame | None = None,
                        suffix: str = R.QUERY_SUFFIX) -> DataFrame:
    """Ordered query strings per distinct key: the key columns, pos, query."""
    df = keys.select(*KEY).distinct()
    street, house = F.col("k_street"), F.col("k_house")
    num = F.when(house.isin(MISSING), "").otherwise(house)
    df = df.withColumns({
        "__num": num, "__fold": T.strip(F.regexp_replace(street, "[\".׳״']", ""))})
    if corrections is not None:
        fix = corrections.where(F.coalesce("nominatim", F.lit("")) != "")
        df = (df.join(fix.select(T.col("name").alias("__fold"), F.col("nominatim").alias("__c1")),
                      "__fold", "left")
              .join(fix.select(T.col("name").alias("k_street"), F.col("nominatim").alias("__c2")),
                    "k_street", "left")
              .withColumn("__fix", F.coalesce("__c1", "__c2")))
    else:
        df = df.withColumn("__fix", F.lit(None).cast("string"))
    expanded = street
    for pattern, word in R.PREFIX_EXPANSIONS:
        expanded = T.strip(F.regexp_replace(expanded, pattern, word))
    df = df.withColumns({
        "__clean": T.query_house(F.col("__num")),
        "__quote": F.regexp_replace(street, "[\"'״׳]", ""),
        "__dot": F.regexp_replace(T.strip(T.replace(street, ".", " ")), r"(?U)\s+", " "),
        "__long": expanded,
    })
    num, clean, fixed = F.col("__num"), F.col("__clean"), F.col("__fix")
    other = {c: F.when(F.col(c) != street, F.col(c)) for c in ("__quote", "__dot", "__long")}
    fixed = F.when(fixed != street, fixed)
    nothing = F.lit("")
    changed = F.when((clean != num) & (clean != ""), clean)
    pair = lambda s, n: F.struct(s.alias("s"), n.alias("n"))
    general = F.array(
        pair(street, num), pair(street, changed),
        pair(other["__quote"], num),
        pair(other["__quote"], F.when(clean != num, clean).otherwise("")),
        pair(other["__quote"], nothing),
        pair(other["__dot"], num), pair(other["__dot"], nothing),
        pair(other["__long"], num), pair(other["__long"], nothing),
        pair(fixed, num), pair(fixed, nothing),
        pair(street, nothing), pair(other["__quote"], nothing),
        pair(other["__dot"], nothing), pair(other["__long"], nothing))
    crossing = F.array(pair(F.concat_ws(" פינת ", street, F.col("k_cross")), nothing),
                       pair(street, nothing), pair(F.col("k_cross"), nothing))
    ends = F.split(num, "-")
    low, high = (T.strip(F.get(ends, F.lit(i))).try_cast("bigint") for i in (0, 1))
    span = F.array(pair(street, F.floor((low + high) / 2).cast("string")),
                   pair(street, T.strip(F.get(ends, F.lit(0)))), pair(street, nothing))
    chosen = (
        F.when((F.col("k_type") == R.LOC_INTERSECTION) & (F.col("k_cross") != ""), crossing)
        .when((F.col("k_type") == R.LOC_RANGE) & num.contains("-"), span)
        .otherwise(general))
    query = lambda p: T.replace(T.replace(
        F.concat(T.strip(F.concat(p["s"], F.lit(" "), p["n"])), F.lit(suffix)),
        "  ", " "), " ,", ",")
    queries = F.array_distinct(F.array_compact(F.transform(chosen, query)))
    return df.select(*KEY, F.posexplode(queries).alias("pos", "query"))


def locate_by_geocoder(keys: DataFrame, results: DataFrame,
                       corrections: DataFrame | None = None, box=R.BOX) -> DataFrame:
    """First candidate of each key with an answer inside the box."""
    answers = results.where(in_box("lat", "lon", box)).groupBy("query").agg(
        F.min(F.struct("lat", "lon", "place_rank")).alias("__a"))
    precision = F.when(is_zero_house("k_house"), "street") \
        .when(F.col("__a.place_rank") == 30, "address").otherwise("street")
    return (
        geocoder_candidates(keys, corrections).join(answers, "query")
        .withColumn("__precision", precision)
        .groupBy(*KEY).agg(F.min_by(F.struct(
            F.round("__a.lat", 6).alias("lat"), F.round("__a.lon", 6).alias("lon"),
            F.lit("nominatim").alias("geocode_method"), F.col("__precision").alias("precision"),
            F.col("query").alias("geocode_query"),
            F.lit(None).cast("string").alias("neighborhood")), "pos").alias("hit")))


# -- cascade ------------------------------------------------------------------


@dataclass
class Sources:
    """Reference tables of the cascade; an absent one skips its step."""

    points: DataFrame | None = None
    registry: DataFrame | None = None
    corrections: DataFrame | None = None
    centroids: DataFrame | None = None
    layer: DataFrame | None = None
    geocoder: DataFrame | None = None
    project: Callable = grid_to_degrees


RESULT = {"lat": "double", "lon": "double", "geocode_method": "string", "precision": "string",
          "geocode_query": "string", "neighborhood": "string"}


def _with_key(df: DataFrame) -> DataFrame:
    return df.withColumns({"k_street": T.text("street"), "k_house": T.text("house"),
                           "k_type": T.text("loc_type"), "k_cross": T.text("cross_street")})


def _after(keys: DataFrame, hits: DataFrame | None, on: list[str]) -> DataFrame:
    """Fill ``hit`` of the keys still without one."""
    if hits is None:
        return keys
    return (keys.join(hits.withColumnRenamed("hit", "__new"), on, "left")
            .withColumn("hit", F.coalesce("hit", "__new")).drop("__new"))


def geocode(df: DataFrame, sources: Sources, run_id: str | None = None,
            order: str = "ticket") -> DataFrame:
    """Locate the rows without coordinates, most certain source first.

    Rows reduce to distinct (street, house, type, cross street) before any lookup,
    and come back by one join. Every row leaves with a method and a precision.
    """
    spark = df.sparkSession
    df = ensure_columns(df, {**RESULT, "cross_street": "string", "loc_type": "string",
                             "house": "string", "geocode_run_id": "string"})
    if run_id is not None:
        df = df.withColumn("geocode_run_id", F.lit(run_id))
    df = _with_key(df.withColumns({"lat": T.to_number("lat"), "lon": T.to_number("lon")}))
    centroids = sources.centroids if sources.centroids is not None else centroid_table(spark)
    empty_hit = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in RESULT.items()])

    missing = df.where("lat IS NULL")
    # the first row of a key is the one that would have asked; later ones repeat it
    keys = missing.groupBy(*KEY).agg(F.min(order).alias("__first")) \
        .withColumn("hit", F.when(F.lit(False), empty_hit))
    keys = cut(keys.withColumn("__zero", is_zero_house("k_house") & ~T.is_blank("k_street")))
    named = keys.where(~T.is_blank("k_street"))
    keys = _after(keys, locate_by_centroid(named.where("__zero"), centroids,
                                           "street_zero_centroid")
                  .withColumn("__zero", F.lit(True)), ["k_street", "__zero"])
    registry = sources.registry
    open_keys = lambda k: k.where("hit IS NULL").where(~T.is_blank("k_street"))
    if sources.points is not None:
        keys = cut(_after(keys, locate_locally(open_keys(keys), sources.points, registry,
                                               sources.corrections), ["k_street", "k_house"]))
    keys = _after(keys, locate_by_centroid(named, centroids), ["k_street"])
    if sources.layer is not None:
        keys = cut(_after(keys, locate_in_layer(open_keys(keys), sources.layer, registry,
                                                sources.corrections, sources.project),
                          ["k_street", "k_house"]))
    keys = keys.withColumn("__failed", F.lit("unresolved"))
    if sources.geocoder is not None:
        described = F.lit(False)
        if sources.corrections is not None:
            from tidyward.sources.readers import flag_descriptions
            marked = flag_descriptions(sources.corrections).select(
                F.col("name").alias("k_street"), F.lit(True).alias("__described"))
            keys = keys.join(marked, "k_street", "left")
            described = F.coalesce("__described", F.lit(False))
        keys = keys.withColumn("__failed", F.when(T.is_blank("k_street"), "no_street")
                               .when(described, "flagged_description").otherwise("unresolved"))
        keys = _after(keys, locate_by_geocoder(
            open_keys(keys).where(F.col("__failed") == "unresolved"),
            sources.geocoder, sources.corrections), KEY)
    found = keys.select(*KEY, "__first", "__failed", "hit")
    df = df.join(pinned(found), KEY, "left")
    was_missing = F.col("lat").isNull()
    hit = was_missing & F.col("hit").isNotNull()
    method = F.when((F.col("hit.geocode_method") == "nominatim")
                    & (F.col(order) != F.col("__first")), "nominatim_cached") \
        .otherwise(F.col("hit.geocode_method"))
    df = df.withColumns({
        "lat": F.coalesce("lat", "hit.lat"),
        "lon": F.when(hit, F.col("hit.lon")).otherwise(F.col("lon")),
        "geocode_method": F.when(hit, method)
            .when(was_missing, F.coalesce("geocode_method", "__failed", F.lit("unresolved")))
            .otherwise(F.col("geocode_method")),
        "precision": F.when(hit, F.col("hit.precision")).when(was_missing, "none")
            .otherwise(F.coalesce("precision", T.lookup("geocode_method", R.METHOD_TIER, "none"))),
        "geocode_query": F.when(hit, F.col("hit.geocode_query")).otherwise(F.col("geocode_query")),
        "neighborhood": F.coalesce("neighborhood", F.when(hit, F.col("hit.neighborhood"))),
    })
    if registry is not None:
        codes = resolve_registry(df.select(F.col("k_street").alias("name")), registry)
        df = df.join(pinned(codes.select(F.col("name").alias("k_street"),
                                         F.col("code").alias("street_code"))), "k_street", "left")
    return df.drop(*KEY, "__first", "__failed", "hit")


def geocode_stats(df: DataFrame) -> DataFrame:
    """One row: rows, located, unresolved, coverage."""
    ok = F.col("lat").isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(ok).alias("total_geocoded"),
        F.count_if(~ok).alias("total_unresolved"),
        F.coalesce(F.round(F.avg(ok.cast("double")) * 100, 1), F.lit(0.0)).alias("coverage_pct"))


def method_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("geocode_method").agg(F.count(F.lit(1)).alias("rows"))


def retry_layer(df: DataFrame, flagged_blocking: DataFrame, sources: Sources) -> DataFrame:
    """Run the layer step alone on the tickets of ``flagged_blocking``; one row with the gain."""
    only = Sources(registry=sources.registry, corrections=sources.corrections,
                   centroids=rule_table(df.sparkSession, ["street", "lat", "lon"],
                                        [("", 0.0, 0.0)]).where("street <> ''"),
                   layer=sources.layer, project=sources.project)
    rows = df.join(flagged_blocking.select("ticket").distinct(), "ticket", "left_semi")
    return geocode(rows.where("lat IS NULL"), only).agg(
        F.count(F.lit(1)).alias("tried"),
        F.count_if(F.col("lat").isNotNull()).alias("located"))
