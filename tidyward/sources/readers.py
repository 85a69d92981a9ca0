"""Readers of the input and reference tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidyward import schema as S
from tidyward.functions import text as T
from tidyward.operators.streets import registry_table


def check_columns(df: DataFrame, required=S.REQUIRED) -> tuple[list[str], list[str]]:
    """(found, missing) of the required columns, from the schema alone."""
    return ([c for c in required if c in df.columns], [c for c in required if c not in df.columns])


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A raw export under its own or the standard column names; missing columns raise."""
    if fmt == "csv":
        df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    else:
        df = spark.read.format(fmt).load(path)
    df = df.withColumnsRenamed({old: new for old, new in
                                {**S.SOURCE_NAMES, **{"﻿" + k: v for k, v in
                                                      S.SOURCE_NAMES.items()}}.items()
                                if old in df.columns})
    _, missing = check_columns(df)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    df = S.ensure_columns(df, {f.name: f.dataType.simpleString() for f in S.RAW_COMPLAINTS})
    return df.select(*[F.col(f.name) if f.name == "opened_at" else F.col(f.name).cast(f.dataType)
                       for f in S.RAW_COMPLAINTS])


REVIEW_COLUMNS = ["problem", "needs_fix", "warning_only", "confidence_level", "decision_details"]


def read_corrected(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A review export that came back corrected, without its five review columns."""
    return spark.read.format(fmt).load(path).drop(*REVIEW_COLUMNS)


# -- corrections --------------------------------------------------------------


def parse_corrections(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects ``{name: {status, note, nominatim, gis}}`` to one row per name."""
    entries = F.from_json(F.col(column), "map<string, map<string, string>>")
    field = lambda k: F.try_element_at("e", F.lit(k)).alias(k)
    return (documents.select(F.explode(entries).alias("name", "e"))
            .select("name", field("status"), field("note"), field("nominatim"), field("gis"),
                    F.map_contains_key("e", "gis").alias("has_gis")))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return parse_corrections(spark.read.text(path, wholetext=True))


def _describes(df: DataFrame):
    return F.coalesce(F.col("note").contains("description"), F.lit(False))


def street_corrections(corrections: DataFrame) -> DataFrame:
    return corrections.where("nominatim IS NOT NULL").select("name", "nominatim")


def manual_layer_names(corrections: DataFrame) -> DataFrame:
    """Names with a fixed layer name, or known to have none (null)."""
    return corrections.where("has_gis OR (status = 'unresolvable' AND gis IS NULL)") \
        .select("name", "gis")


def flag_descriptions(corrections: DataFrame) -> DataFrame:
    """Streets that only describe a place."""
    return corrections.where(((F.col("status") == "unresolvable") & F.col("gis").isNull())
                             | _describes(corrections)).select("name")


def known_unresolvable(corrections: DataFrame) -> DataFrame:
    """Raw addresses that name no street."""
    return corrections.where((F.col("status") == "unresolvable")
                             | _describes(corrections)).select("name")


def correction_conflicts(corrections: DataFrame) -> DataFrame:
    """Entries whose two target forms differ; reported, never raised."""
    return corrections.where("nominatim IS NOT NULL AND gis IS NOT NULL AND nominatim <> gis") \
        .select("name", "nominatim", "gis")


# -- reference tables ---------------------------------------------------------


def read_address_points(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(S.ADDRESS_POINTS).format(fmt).load(path)


def read_building_layer(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(S.BUILDING_LAYER).format(fmt).load(path)


def read_registry(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return registry_table(spark.read.schema(S.STREET_REGISTRY).format(fmt).load(path))


def read_zone_reference(spark: SparkSession, path: str) -> DataFrame:
    """Labelled points from CSV (lat, lon, zone; a byte-order mark is fine)."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    points = raw.select(T.to_number("lat").alias("lat"), T.to_number("lon").alias("lon"), "zone")
    # ids depend on the values alone, so any split of the file gives the same ones
    return points.distinct().select(F.xxhash64("lat", "lon", "zone").alias("ref_id"), "lat", "lon", "zone")


def read_geocoder_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(S.GEOCODER_RESULTS).format(fmt).load(path)


# -- audit log ----------------------------------------------------------------


def audit_commits(spark: SparkSession, path: str) -> DataFrame | None:
    """Committed batches of an audit log (batch, entries), one row each; None for a log without any."""
    try:
        return spark.read.schema("batch string, entries bigint").option(
            "recursiveFileLookup", True).json(f"{path}/commits").where("batch IS NOT NULL").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _audit_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of committed batches: batch, run_id, line, entry, and ``bad`` where it isn't one."""
    done = audit_commits(spark, path)
    if done is None:
        lines = spark.createDataFrame([], "value string, run_id string, batch string")
    else:
        lines = spark.read.schema("value string, run_id string, batch string").text(
            f"{path}/entries").join(done.select("batch"), "batch", "left_semi")
    inside = StructType([f for f in S.AUDIT if f.name != "run_id"]).add("bad", "string")
    entry = F.from_json("value", inside, {"columnNameOfCorruptRecord": "bad"})
    return (lines.where(T.strip("value") != "").select("batch", "run_id", F.col("value").alias("line"), entry.alias("entry"))
            .withColumn("bad", F.col("entry").isNull() | F.col("entry.bad").isNotNull()
                        | (F.col("entry.ticket").isNull() & F.col("entry.field").isNull())))


def read_audit(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Audit entries of one run or of all, of committed batches only; malformed lines are left out
    (:func:`read_audit_rejects` returns them). A log that isn't there is empty."""
    log = _audit_lines(spark, path).where(~F.col("bad")).select("entry.*", "run_id").select(S.AUDIT.fieldNames())
    return log if run_id is None else log.where(F.col("run_id") == run_id)


def read_audit_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines of committed batches that aren't entries: batch, run_id, line."""
    return _audit_lines(spark, path).where("bad").select("batch", "run_id", "line")


def audit_runs(log: DataFrame) -> DataFrame:
    """Runs with their entry counts, newest first."""
    return (log.groupBy("run_id")
            .agg(F.count(F.lit(1)).alias("entries"), F.max("timestamp").alias("last_entry"))
            .orderBy(F.desc("last_entry"), "run_id"))


# -- published exports --------------------------------------------------------


def load_table(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A table of an export as its writer left it; a csv has text columns and texts of several lines."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    return reader.load(path)


def export_manifest(spark: SparkSession, path: str, run: str) -> list[tuple[str, str, int]] | None:
    """(name, format, rows) of each table of a published run; None if it isn't published."""
    try:
        found = spark.read.schema("name string, format string, rows bigint").json(
            f"{path.rstrip('/')}/manifests/{run}").where("name IS NOT NULL").collect()      # a row per table
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return [tuple(r) for r in found] or None


def read_export(spark: SparkSession, path: str, run: str) -> dict[str, DataFrame]:
    """The tables of a published run; a run that isn't published raises."""
    tables = export_manifest(spark, path, run)
    if tables is None:
        raise FileNotFoundError(f"run {run!r} is not published under {path}")
    return {name: load_table(spark, f"{path.rstrip('/')}/runs/{run}/{name}", fmt) for name, fmt, _ in tables}
