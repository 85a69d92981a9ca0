"""Row flags, triage and change fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.functions.geo import in_box

DESCRIPTIVE = [R.LOC_LANDMARK, R.LOC_NONE]


def detect_flags(df: DataFrame, date_min: str | None = None, date_max: str | None = None,
                 stage: str = "clean", categories=None, box=R.BOX, sea_lon: float = R.SEA_LON,
                 labels: dict = R.FLAG_LABELS, duplicates: bool = False) -> DataFrame:
    """Add ``flags``, ``flag_labels`` and ``flag_severity``.

    ``stage``: ``clean`` for structure, address and quality; ``geocode`` or ``all``
    for the position as well. Checks on absent columns do not fire. ``duplicates``
    also flags tickets that occur more than once (one extra shuffle).
    """
    known = list(categories if categories is not None else R.MUNICIPAL.categories)
    located = stage in ("geocode", "all")
    have = set(df.columns)
    value = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    if duplicates:
        repeated = (df.where(~T.is_blank("ticket")).groupBy("ticket").count()
                    .where("count > 1").select("ticket", F.lit(True).alias("__dup")))
        df = df.join(repeated, "ticket", "left")
    df = T.once(df, {
        "__lat": T.to_number(value("lat")), "__lon": T.to_number(value("lon")),
        "__street_blank": T.is_blank(value("street")), "__junk": T.is_junk(value("street")),
        "__type": T.text(value("loc_type")), "__cat": T.text(value("category")),
    })
    lat, lon = F.col("__lat"), F.col("__lon")
    has = lat.isNotNull() & lon.isNotNull()
    kind = F.col("__type")
    no_street = F.col("__street_blank")
    off = F.lit(False)
    date = value("date").try_cast("date") if "date" in have else F.lit(None).cast("date")
    inside = F.coalesce(in_box("__lat", "__lon", box), F.lit(False))
    tested: list[tuple[str, str, Column, bool | Column]] = [
        # code, label key, condition, blocks
        ("no_date", "no_date", T.is_blank("date") if "date" in have else off, True),
        ("no_id", "no_id", T.is_blank("ticket") if "ticket" in have else off, True),
        ("date_early", "date_early", F.coalesce(date < F.lit(date_min).cast("date"), off)
            if date_min else off, False),
        ("date_late", "date_late", F.coalesce(date > F.lit(date_max).cast("date"), off)
            if date_max else off, False),
        ("addr_empty", "addr_none", no_street & (kind == R.LOC_NONE), True),
        ("addr_desc", "addr_desc", no_street & (kind == R.LOC_LANDMARK), False),
        ("addr_empty", "addr_empty", no_street & ~kind.isin(DESCRIPTIVE), ~has if located else True),
        ("addr_junk", "addr_junk", F.col("__junk"), ~has if located else True),
        ("no_house", "no_house", (kind == R.LOC_ADDRESS) & T.is_blank(value("house")), False),
        ("cat_unknown", "cat_unknown", (F.col("__cat") != "") & ~F.col("__cat").isin(known), False),
        ("no_status", "no_status", T.is_blank("status") if "status" in have else off, False),
    ]
    if located:
        tested += [
            ("geo_fail", "geo_fail", ~has & ~kind.isin(DESCRIPTIVE)
                & (T.text(value("geocode_method")) != "flagged_description"), True),
            ("geo_outside", "geo_outside", has & ~inside, False),
            ("geo_sea", "geo_sea", has & inside & (lon < sea_lon), False),
        ]
    if duplicates:
        tested.append(("dup_id", "dup_id", F.coalesce("__dup", off), False))

    df = T.once(df, {f"__f{i}": cond for i, (_, _, cond, _) in enumerate(tested)})
    fired = [F.col(f"__f{i}") for i in range(len(tested))]
    severity = lambda blocks: (F.lit("block" if blocks else "warn") if isinstance(blocks, bool)
                               else F.when(blocks, "block").otherwise("warn"))
    flags = F.array_compact(F.array(*[
        F.when(f, F.struct(F.lit(code).alias("code"), F.lit(labels[key]).alias("label"),
                           severity(blocks).alias("severity")))
        for f, (code, key, _, blocks) in zip(fired, tested)]))
    blocking = T.any_of([f if blocks is True else f & blocks
                         for f, (_, _, _, blocks) in zip(fired, tested) if blocks is not False])
    df = T.once(df, {
        "flags": flags,
        "flag_labels": F.concat_ws("; ", *[F.when(f, labels[key])
                                           for f, (_, key, _, _) in zip(fired, tested)]),
        "flag_severity": F.when(blocking, "block").when(T.any_of(fired), "warn").otherwise(""),
    })
    return df.drop("__dup", "__lat", "__lon", "__street_blank", "__junk", "__type", "__cat",
                   *[f"__f{i}" for i in range(len(tested))])


def severity_counts(flagged: DataFrame) -> DataFrame:
    """One row: blocking, warnings and info rows."""
    s = F.col("flag_severity")
    return flagged.agg(
        F.count_if(s == "block").alias("blocking"),
        F.count_if(s.isin("warn", "review")).alias("warnings"),
        F.count_if(s == "info").alias("info"))


TRIAGE = {"block": "blocking", "warn": "review", "review": "review", "info": "info", "": "clean"}


def with_triage(flagged: DataFrame) -> DataFrame:
    """Add ``triage``: blocking, review, info or clean."""
    if "flag_severity" not in flagged.columns:
        return flagged.withColumn("triage", F.lit("clean"))
    return flagged.withColumn("triage", T.lookup("flag_severity", TRIAGE))


def triage_group(flagged: DataFrame, group: str) -> DataFrame:
    return with_triage(flagged).where(F.col("triage") == group)


def triage_summary(flagged: DataFrame) -> DataFrame:
    """Four rows in priority order, empty groups included."""
    groups = ["blocking", "review", "info", "clean"]
    counts = with_triage(flagged).agg(*[
        F.count_if(F.col("triage") == g).alias(g) for g in groups])
    return counts.select(F.posexplode(F.array(*[
        F.struct(F.lit(g).alias("triage"), F.col(g).alias("rows")) for g in groups
    ])).alias("position", "g")).select("position", "g.triage", "g.rows")


def waived_entries(flagged: DataFrame, run_id: str, timestamp: str) -> DataFrame:
    """Audit entries for the blocking rows a reviewer waived."""
    return flagged.where(F.col("flag_severity") == "block").select(
        F.col("ticket").cast("string").alias("ticket"), F.lit("flag_severity").alias("field"),
        F.lit("block").alias("old"), F.lit("waived").alias("new"), F.lit("waive").alias("source"),
        F.lit(timestamp).alias("timestamp"), F.lit(run_id).alias("run_id"))


def flag_breakdown(flagged: DataFrame, severity: str) -> DataFrame:
    """Labels on the rows of one severity, with how many rows carry each."""
    return (flagged.where(F.col("flag_severity") == severity)
            .select(F.explode("flags.label").alias("label"))
            .groupBy("label").agg(F.count(F.lit(1)).alias("rows")))


FLAG_INPUTS = ["date", "ticket", "street", "house", "loc_type", "category", "status",
               "lat", "lon", "geocode_method"]


def content_fingerprint(df: DataFrame, columns=FLAG_INPUTS) -> DataFrame:
    """One row: row count and an order-free sum of row hashes.

    Two tables differ in the columns when the row differs; each row's hash covers
    all of them, so a value moving between rows shows.
    """
    present = [c for c in columns if c in df.columns]
    row = F.concat_ws("␟", *[F.coalesce(F.col(c).cast("string"), F.lit("␀"))
                                  for c in present])
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(T.content_number(row).cast("decimal(38,0)")), F.lit(0))
        .cast("string").alias("fingerprint"))


def needs_rerun(current: DataFrame, stored: DataFrame) -> DataFrame:
    """One row, ``changed``: whether the stored fingerprint is another one or missing."""
    return current.select(F.lit(1).alias("__k"), "rows", "fingerprint").join(
        stored.select(F.lit(1).alias("__k"), F.col("rows").alias("__r"),
                      F.col("fingerprint").alias("__f")), "__k", "left").select(
        (~(F.col("rows").eqNullSafe(F.col("__r"))
           & F.col("fingerprint").eqNullSafe(F.col("__f")))).alias("changed"))
