"""Writers of the audit log and of the review and final exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.operators.flags import detect_flags
from tidyward.operators.repair import coerce_coordinates
from tidyward.schema import AUDIT
from tidyward.session import cut, rule_table
from tidyward.sources.readers import audit_commits, export_manifest, load_table


def append_audit(entries: DataFrame, path: str, batch: str | None = None) -> str:
    """Append entries under their run as one batch and return the batch's id.

    The entries are written first, and a marker under ``commits`` then makes them visible to
    :func:`readers.read_audit`. Appending a committed batch again does nothing, and a run that broke off before
    its marker is written anew in its own folder, so a retried run never doubles its entries.
    Without ``batch`` the id comes from the entries themselves, whatever their order. An id has
    letters, digits, - and _ only. Sources outside the closed list raise.
    """
    filled = entries.select(*[F.col(f.name).cast("string") for f in AUDIT]).withColumns({
        "old": F.coalesce("old", F.lit("")), "new": F.coalesce("new", F.lit("")),
        "run_id": F.coalesce(F.nullif("run_id", F.lit("")), F.lit("unscoped")),
    })
    # the id and the rows must come from the same entries
    filled = cut(filled)
    known = F.coalesce(F.col("source").isin(R.AUDIT_SOURCES), F.lit(False))
    wrong = filled.where(~known).select("source").limit(1).collect()
    if wrong:
        raise ValueError(f"source must be one of {sorted(R.AUDIT_SOURCES)}, got {wrong[0][0]!r}")
    row = F.to_json(F.struct("*"))
    seen = filled.agg(F.count(F.lit(1)), *[
        F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")) for seed in (1, 2)]).first()
    if batch is None:
        batch = "-".join("n" + str(abs(v or 0)) if (v or 0) < 0 else str(v or 0) for v in seen)
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"batch id {batch!r} may have letters, digits, - and _ only")
    spark = entries.sparkSession
    done = audit_commits(spark, path)
    if done is not None and not done.where(F.col("batch") == batch).isEmpty():
        return batch
    filled.write.mode("overwrite").partitionBy("run_id").json(f"{path}/entries/batch={batch}")
    marker = spark.range(1, numPartitions=1).select(F.lit(batch).alias("batch"), F.lit(seen[0]).alias("entries"))
    marker.write.mode("overwrite").json(f"{path}/commits/{batch}")
    return batch


def review_rows_export(flagged: DataFrame) -> DataFrame:
    """All rows, the five review columns first."""
    has = lambda c: F.col(c) if c in flagged.columns else F.lit("")
    internal = ("flags", "flag_labels", "flag_severity", "confidence", "confidence_details")
    kept = [c for c in flagged.columns if c not in internal and not c.startswith("_")]
    return flagged.select(
        F.col("flag_labels").alias("problem"),
        (F.col("flag_severity") == "block").alias("needs_fix"),
        (F.col("flag_severity") == "warn").alias("warning_only"),
        has("confidence").alias("confidence_level"),
        has("confidence_details").alias("decision_details"), *kept)


def review_summary(flagged: DataFrame, log: DataFrame) -> DataFrame:
    """Seven rows: position, metric, value."""
    tier = lambda t: F.count_if(F.col("confidence") == t) if "confidence" in flagged.columns \
        else F.count_if(F.lit(False))
    s = F.col("flag_severity")
    totals = flagged.agg(
        F.count(F.lit(1)).alias("rows"), tier("high").alias("high"), tier("medium").alias("medium"),
        tier("low").alias("low"), F.count_if(s == "block").alias("block"),
        F.count_if(s.isin("warn", "review")).alias("warn")).withColumn("__k", F.lit(1))
    fixes = log.agg(F.count(F.lit(1)).alias("fixes")).withColumn("__k", F.lit(1))
    # Names of the figures.
    metrics = [("סה״כ שורות", "rows"), ("סווגו ודאית", "high"), ("סווגו בחלקיות", "medium"),
               ("לבירור ידני", "low"), ("שגיאות מבניות", "block"), ("אזהרות מבניות", "warn"),
               ("תיקונים אוטומטיים", "fixes")]
    return totals.join(fixes, "__k").select(F.posexplode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in metrics
    ])).alias("position", "m")).select("position", "m.metric", "m.value")


def review_export(flagged: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """The five tables of the review export."""
    rows = review_rows_export(flagged)
    return {
        "rows": rows,
        "corrections": log,
        "low_confidence": rows.where(F.col("confidence_level") == "low"),
        "blocking": rows.where("needs_fix"),
        "summary": review_summary(flagged, log),
    }


def final_summary(df: DataFrame, flagged: DataFrame) -> DataFrame:
    """Nine rows: position, metric, value (text; null where the data cannot say)."""
    have = set(df.columns)
    n = F.count(F.lit(1))
    share = lambda c: F.concat(F.round(F.count_if(c) / n * 100, 1).cast("string"), F.lit("%"))
    when = lambda c, expr: expr.cast("string") if c in have else F.max(F.lit(None).cast("string"))
    ok = T.to_number("lat").isNotNull() if "lat" in have else F.lit(False)
    town = ~F.col("zone").isin(R.ZONE_UNKNOWN, R.ZONE_OUTSIDE) if "zone" in have else F.lit(False)
    one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)) if c in have else F.lit(False)
    metrics = [
        ("סה״כ שורות", n.cast("string")),
        ("גאוקודד", when("lat", F.count_if(ok))),
        ("אחוז כיסוי גאוקוד", when("lat", share(ok))),
        ("בתוך תחום העיר", when("zone", F.count_if(town))),
        ("תלונות חוזרות", when("is_recurring", F.count_if(one("is_recurring")))),
        ("שיעור תלונות חוזרות", when("is_recurring", share(one("is_recurring")))),
        ("תלונות ביום פינוי", when("same_day", F.count_if(one("same_day")))),
        ("שיעור תלונות ביום פינוי", when("same_day", share(one("same_day")))),
        ("שורות עם דגל אזהרה", F.count_if(F.col("flag_severity") == "warn").cast("string")),
    ]
    wide = flagged.agg(*[m.alias(f"v{i}") for i, (_, m) in enumerate(metrics)])
    return wide.select(F.posexplode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(f"v{i}").alias("value"))
        for i, (name, _) in enumerate(metrics)])).alias("position", "m")) \
        .select("position", "m.metric", "m.value")


def final_export(df: DataFrame, audit: DataFrame | None = None,
                 cards: dict[str, DataFrame] | None = None, date_min: str | None = None,
                 date_max: str | None = None) -> dict[str, DataFrame]:
    """Summary, data with flag labels and numeric coordinates, audit log, card strata."""
    df = coerce_coordinates(df)
    flagged = detect_flags(df, date_min, date_max, stage="all")
    dropped = ("flags", "flag_severity", "confidence", "confidence_details")
    data = flagged.drop(*[c for c in flagged.columns if c.startswith("_") or c in dropped]) \
        .withColumnRenamed("flag_labels", "review_flags")
    out = {"summary": final_summary(df, flagged), "data": data}
    if audit is not None:
        out["audit"] = audit
    for name, card in (cards or {}).items():
        out[f"card_{name}"] = card
    return out


def write_export(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Each table under its own folder of ``path``."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{path.rstrip('/')}/{name}")


def publish_export(spark: SparkSession, tables: dict[str, DataFrame], path: str, run: str, fmt: str = "parquet") -> None:
    """All tables of an export as one run: :func:`readers.read_export` sees all of them or none.

    The tables are written first, and a manifest of one file then names them with their rows. A run
    that broke off before that is written anew; a published run stays as it is, so a retry changes nothing.
    A run must not be published by two jobs at once. Names have letters, digits, - and _ only.
    """
    for name in [run, *tables]:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise ValueError(f"name {name!r} may have letters, digits, - and _ only")
    if not tables:
        raise ValueError("an export needs a table")
    root = path.rstrip("/")
    if export_manifest(spark, root, run) is not None:
        return
    write_export(tables, f"{root}/runs/{run}", fmt)
    rows = [(name, fmt, load_table(spark, f"{root}/runs/{run}/{name}", fmt).count()) for name in tables]
    rule_table(spark, ["name", "format", "rows"], rows).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{run}")
