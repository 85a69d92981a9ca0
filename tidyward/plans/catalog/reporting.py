"""Filters, distributions, headline figures, map rows and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidyward import rules as R
from tidyward.operators import report as RP
from tidyward.operators.audit import correction_log
from tidyward.operators.clean import clean
from tidyward.operators.flags import detect_flags
from tidyward.plans.flow import recheck
from tidyward.plans.inputs import COMPLAINTS, SPOTS
from tidyward.plans.catalog.cleaning import _FLAGGED, _KNOWN_BAD, flagged_rows
from tidyward.plans.catalog.quality import _LOGGED
from tidyward.plans.catalog.registry import CLEANED, EXPECTED, SPOT, blank, lit, num, query, with_ctes
from tidyward.session import shared_folder, stored
from tidyward.sources import readers as RD
from tidyward.sources import writers as WR

_HAS = f"({num('lat')} IS NOT NULL AND {num('lon')} IS NOT NULL)"
_SLICE = dict(zone="מרכז", responsibility="עירייה", recurrence="first")
_SLICED = SPOT + """, d AS (SELECT * FROM spots WHERE zone = 'מרכז' AND responsibility = 'עירייה'
  AND is_recurring = 0)"""


@query("slice_rows", with_ctes([_SLICED], "SELECT ticket, zone, category FROM d"))
def _(t):
    return RP.slice_rows(t.sql(SPOTS), **_SLICE).select("ticket", "zone", "category")


@query("slice_counts", """SELECT n_name, o_orderstatus, count(*) AS rows,
    CAST(sum(CAST(o_totalprice * 100 AS BIGINT)) AS BIGINT) AS cents
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  WHERE o_orderpriority = '2-HIGH' AND n_regionkey = 2 GROUP BY ALL""")
def _(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")) \
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    # cents round half up in the expected SQL
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return RP.slice_rows(rows, o_orderpriority="2-HIGH", n_regionkey=2) \
        .groupBy("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("rows"),
                                                F.sum(cents).alias("cents"))


@query("facet_values", with_ctes([SPOT], " UNION ".join(
    f"SELECT '{f}' AS facet, CAST({f} AS STRING) AS value FROM spots WHERE {f} IS NOT NULL"
    for f in RP.FACETS)))
def _(t):
    return RP.facet_values(t.sql(SPOTS))


@query("text_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the') OR "
       "contains(lower(lang), 'the') OR contains(lower(source), 'the') OR contains(CAST(doc_id AS STRING), 'the') "
       "OR contains(CAST(n_chars AS STRING), 'the')")
def _(t):
    return RP.search(t.documents, "The").select("doc_id", "lang")


@query("still_missing", with_ctes([SPOT], f"SELECT ticket FROM spots WHERE {num('lat')} IS NULL"))
def _(t):
    return RP.still_missing(t.sql(SPOTS)).select("ticket")


@query("is_located", with_ctes([SPOT], f"SELECT max({num('lat')} IS NOT NULL) AS geocoded FROM spots"))
def _(t):
    return RP.is_located(t.sql(SPOTS))


@query("category_distribution", with_ctes([SPOT], """SELECT category, count(*) AS rows FROM spots
  WHERE category IS NOT NULL GROUP BY category"""))
def _(t):
    return RP.distribution(t.sql(SPOTS), "category")


@query("monthly", with_ctes([SPOT], f"""SELECT month, CASE month {' '.join(
    f"WHEN {i + 1} THEN {lit(m)}" for i, m in enumerate(R.MONTHS))} END AS name, count(*) AS rows
  FROM spots WHERE month IS NOT NULL GROUP BY month"""))
def _(t):
    return RP.monthly(t.sql(SPOTS))


def _top(c):
    return f"""(SELECT {c} FROM spots WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""


@query("kpis", with_ctes([SPOT], f"""SELECT count(*) AS rows,
  round(avg(is_recurring) * 100, 1) AS recurring_pct,
  round(avg(CAST(coalesce(responsibility, '') IN ('עירייה', 'כשל עירוני') AS INT)) * 100, 1) AS municipal_pct,
  round(avg(CAST(coalesce(same_day, 0) = 1 AS INT)) * 100, 1) AS same_day_pct,
  {_top('category')} AS top_category,
  (SELECT count(*) FROM spots WHERE category = {_top('category')}) AS top_category_rows,
  {_top('street')} AS top_street, (SELECT count(*) FROM spots WHERE street = {_top('street')}) AS top_street_rows
  FROM spots"""))
def _(t):
    return RP.headline(t.sql(SPOTS))


@query("repeat_addresses", with_ctes([SPOT], f"""SELECT street, house, tickets, ticket FROM (
  SELECT coalesce(street, '') AS street, coalesce(house, '') AS house, ticket,
    count(*) OVER (PARTITION BY coalesce(street, ''), coalesce(house, '')) AS tickets
  FROM spots WHERE {num('lat')} IS NULL) WHERE tickets > 1"""))
def _(t):
    return RP.repeated_addresses(t.sql(SPOTS))


@query("heat_points", with_ctes([SPOT], f"""SELECT round_even({num('lat')}, 6) AS lat,
  round_even({num('lon')}, 6) AS lon, CAST(is_recurring AS DOUBLE) AS weight FROM spots WHERE {_HAS}"""))
def _(t):
    return RP.heat_points(t.sql(SPOTS), "is_recurring")


@query("marker_rows", with_ctes([SPOT], f"""SELECT round_even({num('lat')}, 6) AS lat,
  round_even({num('lon')}, 6) AS lon, coalesce(street, '') AS street, coalesce(house, '') AS house,
  coalesce(category, '') AS category, coalesce(zone, '') AS zone, coalesce(date, '') AS date
  FROM spots WHERE {_HAS}"""))
def _(t):
    return RP.marker_rows(t.sql(SPOTS))


@query("first_markers", with_ctes([SPOT], f"""SELECT round_even({num('lat')}, 6) AS lat,
  round_even({num('lon')}, 6) AS lon, coalesce(street, '') AS street, coalesce(house, '') AS house,
  coalesce(category, '') AS category, coalesce(zone, '') AS zone, coalesce(date, '') AS date
  FROM spots WHERE {_HAS} ORDER BY spots.date NULLS FIRST, ticket LIMIT 3000"""))
def _(t):
    """The top-k form: a map shows so many markers."""
    return RP.marker_rows(t.sql(SPOTS), most=3000)


_SEV = _FLAGGED + [f"""sp AS (SELECT ticket, {num('lat')} AS lat, {num('lon')} AS lon, street, house,
  flag_severity, CASE WHEN flag_labels = '' THEN 'תקין' ELSE flag_labels END AS flag_labels FROM flagged
  WHERE {num('lat')} BETWEEN 32 AND 33 AND {num('lon')} BETWEEN 34 AND 36)"""]


@query("severity_points", with_ctes(_SEV, "SELECT * FROM sp"))
def _(t):
    return RP.severity_points(flagged_rows(t))


@query("map_centre", with_ctes(_SEV, "SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM sp"))
def _(t):
    return RP.map_centre(RP.severity_points(flagged_rows(t))).select(
        F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


# -- exports ------------------------------------------------------------------


def _checked(t):
    return detect_flags(clean(t.sql(COMPLAINTS)), stage="clean")


# Flags of freshly cleaned rows: those a cleaner's output can raise.
_CLEAN_FLAGS = CLEANED + [f"""ck AS (SELECT *, concat_ws('; ',
    CASE WHEN {blank('date')} THEN {lit(R.FLAG_LABELS['no_date'])} END,
    CASE WHEN {blank('street')} AND loc_type = 'ללא רחוב' THEN {lit(R.FLAG_LABELS['addr_none'])} END,
    CASE WHEN {blank('street')} AND loc_type = 'ציון דרך' THEN {lit(R.FLAG_LABELS['addr_desc'])} END,
    CASE WHEN regexp_matches(coalesce(street, ''), '^[0-9 ()-]+$') THEN {lit(R.FLAG_LABELS['addr_junk'])} END,
    CASE WHEN category NOT IN ({', '.join(lit(c) for c in R.RESPONSIBILITY)}) AND category <> ''
      THEN {lit(R.FLAG_LABELS['cat_unknown'])} END,
    CASE WHEN {blank('status')} THEN {lit(R.FLAG_LABELS['no_status'])} END) AS problem FROM cleaned)""", f"""
  sv AS (SELECT *, contains(problem, {lit(R.FLAG_LABELS['no_date'])}) OR
      contains(problem, {lit(R.FLAG_LABELS['addr_none'])}) OR
      contains(problem, {lit(R.FLAG_LABELS['addr_junk'])}) AS needs_fix FROM ck)"""]


@query("review_export", with_ctes(_CLEAN_FLAGS, """SELECT problem, needs_fix,
  NOT needs_fix AND problem <> '' AS warning_only, confidence AS confidence_level,
  confidence_details AS decision_details, ticket, street FROM sv"""))
def _(t):
    flagged = _checked(t)
    return WR.review_rows_export(flagged).select(
        "problem", "needs_fix", "warning_only", "confidence_level", "decision_details", "ticket", "street")


@query("review_summary", with_ctes(_LOGGED + _CLEAN_FLAGS[len(CLEANED):], """
  SELECT 0 AS position, 'סה״כ שורות' AS metric, count(*) AS value FROM sv
  UNION ALL SELECT 1, 'סווגו ודאית', count(*) FILTER (confidence = 'high') FROM sv
  UNION ALL SELECT 2, 'סווגו בחלקיות', count(*) FILTER (confidence = 'medium') FROM sv
  UNION ALL SELECT 3, 'לבירור ידני', count(*) FILTER (confidence = 'low') FROM sv
  UNION ALL SELECT 4, 'שגיאות מבניות', count(*) FILTER (needs_fix) FROM sv
  UNION ALL SELECT 5, 'אזהרות מבניות', count(*) FILTER (NOT needs_fix AND problem <> '') FROM sv
  UNION ALL SELECT 6, 'תיקונים אוטומטיים', (SELECT count(*) FROM log)"""))
def _(t):
    flagged = _checked(t)
    return WR.review_summary(flagged, correction_log(flagged))


@query("final_export", with_ctes(_FLAGGED, f"""SELECT ticket, street, {num('lat')} AS lat, {num('lon')} AS lon,
  flag_labels AS review_flags FROM flagged"""))
def _(t):
    rows = t.sql(SPOTS).withColumn("_internal", F.lit(1)).withColumn(
        "ticket", F.when(F.col("ticket").cast("bigint") % 101 == 0, " nan").otherwise(F.col("ticket")))
    data = WR.final_export(rows, date_min="1996-01-01", date_max="2000-12-31")["data"]
    assert "_internal" not in data.columns
    return data.select("ticket", "street", "lat", "lon", "review_flags")


@query("final_summary", with_ctes(_FLAGGED, f"""SELECT 0 AS position, 'סה״כ שורות' AS metric,
    CAST(count(*) AS STRING) AS value FROM flagged
  UNION ALL SELECT 1, 'גאוקודד', CAST(count({num('lat')}) AS STRING) FROM flagged
  UNION ALL SELECT 2, 'אחוז כיסוי גאוקוד', CAST(round(count({num('lat')}) * 1.0::DOUBLE / count(*) * 100, 1) AS STRING) || '%' FROM flagged
  UNION ALL SELECT 3, 'בתוך תחום העיר', CAST(count(*) FILTER (zone NOT IN ('לא ידוע', 'מחוץ לתחום')) AS STRING) FROM flagged
  UNION ALL SELECT 4, 'תלונות חוזרות', CAST(count(*) FILTER (is_recurring = 1) AS STRING) FROM flagged
  UNION ALL SELECT 5, 'שיעור תלונות חוזרות', CAST(round(count(*) FILTER (is_recurring = 1) * 1.0::DOUBLE / count(*) * 100, 1) AS STRING) || '%' FROM flagged
  UNION ALL SELECT 6, 'תלונות ביום פינוי', CAST(count(*) FILTER (same_day = 1) AS STRING) FROM flagged
  UNION ALL SELECT 7, 'שיעור תלונות ביום פינוי', CAST(round(count(*) FILTER (same_day = 1) * 1.0::DOUBLE / count(*) * 100, 1) AS STRING) || '%' FROM flagged
  UNION ALL SELECT 8, 'שורות עם דגל אזהרה', CAST(count(*) FILTER (flag_severity = 'warn') AS STRING) FROM flagged"""))
def _(t):
    flagged = flagged_rows(t)
    return WR.final_summary(flagged, flagged)


@query("corrected_reingest", with_ctes(CLEANED, """SELECT ticket, category, responsibility, street, house
  FROM cleaned"""))
def _(t):
    sent = t.sql(COMPLAINTS).withColumns({c: F.lit("") for c in RD.REVIEW_COLUMNS})
    return clean(sent.drop(*RD.REVIEW_COLUMNS)).select(
        "ticket", "category", "responsibility", "street", "house")


def _published(t, tables):
    """Published and read back."""
    path = f"{shared_folder(t.spark)}/export-{uuid.uuid4().hex}"
    WR.publish_export(t.spark, tables, path, "run1")
    return RD.read_export(t.spark, path, "run1")


@query("published_review", EXPECTED["review_export"])
def _(t):
    # five tables are made from it
    flagged = stored(_checked(t))
    rows = _published(t, WR.review_export(flagged, correction_log(flagged)))["rows"]
    return rows.select(
        "problem", "needs_fix", "warning_only", "confidence_level", "decision_details", "ticket", "street")


@query("published_final", EXPECTED["final_export"])
def _(t):
    rows = t.sql(SPOTS).withColumn("_internal", F.lit(1)).withColumn(
        "ticket", F.when(F.col("ticket").cast("bigint") % 101 == 0, " nan").otherwise(F.col("ticket")))
    data = _published(t, WR.final_export(rows, date_min="1996-01-01", date_max="2000-12-31"))["data"]
    return data.select("ticket", "street", "lat", "lon", "review_flags")


@query("corrected_recheck", EXPECTED["auto_fix"])
def _(t):
    """The review columns are written and come back with the file."""
    sent = t.sql(COMPLAINTS).withColumns({c: F.lit("seen") for c in RD.REVIEW_COLUMNS})
    path = f"{shared_folder(t.spark)}/corrected-{uuid.uuid4().hex}"
    sent.write.parquet(path)
    checked = recheck(RD.read_corrected(t.spark, path), t.sql(_KNOWN_BAD))
    return checked.select("ticket", "street", "house", "loc_type")
