"""Sampling, comparison, audit and the correction log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidyward import rules as R
from tidyward.operators import audit as AU
from tidyward.operators import quality as Q
from tidyward.operators.clean import clean
from tidyward.operators.compare import compare_tables
from tidyward.plans.inputs import COMPLAINTS, SPOTS
from tidyward.plans.catalog.registry import (
    CLEANED, SPOT, lit, lits, mapped, num, query, txt, with_ctes,
)

# -- sampling -----------------------------------------------------------------


@query("sample_size", """SELECT source, count(*) AS lot, least(CAST(ceil(-ln(0.10) / 0.05) AS BIGINT),
  count(*)) AS sample_n FROM documents GROUP BY source""")
def _(t):
    lots = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("lot"))
    return lots.withColumn("sample_n", Q.sample_size("lot", 0.05))


@query("draw_sample", """SELECT doc_id, lang FROM documents
  ORDER BY md5('42|' || CAST(doc_id AS STRING)), doc_id LIMIT 60""")
def _(t):
    return Q.draw_sample(t.documents, 60, 42, "doc_id").select("doc_id", "lang")


_SIZES = {t: Q.full_size(R.P_REJECT[t]) for t in R.TIERS}
_DEFECT = f"""(precision = 'none' OR {num('lat')} IS NULL OR {num('lon')} IS NULL OR
  (precision IN ('address', 'near_address', 'address_unverified') AND NOT
    ({num('lat')} BETWEEN 32.14 AND 32.20 AND {num('lon')} BETWEEN 34.78 AND 34.87)))"""


@query("sampling_plan", with_ctes([SPOT, f"""s AS (SELECT *, row_number() OVER (PARTITION BY precision
    ORDER BY md5('42|' || ticket), ticket) AS pos, count(*) OVER (PARTITION BY precision) AS lot,
    CAST({mapped('precision', _SIZES)} AS BIGINT) AS full_n FROM spots WHERE precision IS NOT NULL)"""],
    f"""SELECT precision AS tier, any_value(lot) AS lot_size, count(*) AS sample_n,
  count(*) FILTER ({_DEFECT}) AS defects,
  CASE WHEN count(*) FILTER ({_DEFECT}) = 0 THEN {lit(R.ACCEPT)} ELSE {lit(R.REJECT)} END AS verdict,
  round(count(*) FILTER ({_DEFECT}) * 100.0 / count(*), 1) AS defect_pct
  FROM s WHERE pos <= least(full_n, lot) GROUP BY precision"""))
def _(t):
    return Q.sampling_plan(t.sql(SPOTS))


# the same plan with another defect rule: documents, toxic rows, one lot per language
@query("sampling_plan_documents", f"""WITH d AS (SELECT doc_id, lang, coalesce(toxic, 0) AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)),
  s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || CAST(doc_id AS STRING)), doc_id) AS pos,
    count(*) OVER (PARTITION BY lang) AS lot FROM d)
  SELECT lang AS tier, any_value(lot) AS lot_size, count(*) AS sample_n,
    count(*) FILTER (toxic = 1) AS defects,
    CASE WHEN count(*) FILTER (toxic = 1) = 0 THEN {lit(R.ACCEPT)} ELSE {lit(R.REJECT)} END AS verdict,
    round(count(*) FILTER (toxic = 1) * 100.0 / count(*), 1) AS defect_pct
  FROM s WHERE pos <= least(24, lot) GROUP BY lang""")
def _(t):
    docs = t.documents.select("doc_id", F.col("lang").alias("precision")) \
        .join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return Q.sampling_plan(docs, seed=7, defect=lambda tier: F.col("toxic") == 1,
                           tiers=["en", "es", "fr", "de"], key="doc_id")


_STRATA = [SPOT, """st0 AS (SELECT *, coalesce(category_source, '—') AS a, coalesce(resp_source, '—') AS b
    FROM spots)""", """
  st AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY a, b) < 5 THEN '(אחר)'
    ELSE 'סיווג: ' || a || ' · אחריות: ' || b END AS stratum FROM st0)""", """
  pl AS (SELECT stratum, ticket, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || ticket), ticket) AS pos,
    count(*) OVER (PARTITION BY stratum) AS lot FROM st)""", """
  plan AS (SELECT stratum, any_value(lot) AS lot_size, count(*) AS sample_n,
    string_agg(ticket, ',' ORDER BY pos) AS tickets FROM pl WHERE pos <= least(47, lot) GROUP BY stratum)"""]


@query("strata", with_ctes(_STRATA, "SELECT ticket, stratum FROM st"))
def _(t):
    return Q.stratify(t.sql(SPOTS), Q.CLEAN_STRATA).select("ticket", "stratum")


@query("strata_documents", """SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lang, source) < 5
  THEN '(אחר)' ELSE 'lang: ' || lang || ' · source: ' || source END AS stratum FROM documents""")
def _(t):
    return Q.stratify(t.documents, ["lang", "source"]).select("doc_id", "stratum")


@query("acceptance_plan", with_ctes(_STRATA, "SELECT * FROM plan"))
def _(t):
    plan = Q.sample_plan(t.sql(SPOTS), Q.CLEAN_STRATA)
    return plan.select("stratum", "lot_size", "sample_n",
                       F.array_join("sample_tickets", ",").alias("tickets"))


_SHOWN = ["street", "house", "lat", "lon", "addr_route", "precision"]


@query("review_rows", with_ctes([SPOT], "SELECT ticket, " + ", ".join(
    f"{txt(c)} AS {c}" for c in _SHOWN) + f", coalesce(nullif({txt('geocode_method')}, ''), '—') "
    f"AS geocode_method, {txt('status')} AS status FROM spots"))
def _(t):
    return Q.review_rows(t.sql(SPOTS), "geocode").select(
        "ticket", *[f"decision.{c}" for c in _SHOWN], "decision.geocode_method", "original.status")


# One verdict per document: its stratum, its place in the draw, and what the label says.
_VERDICTS = """SELECT d.lang || '/' || d.source AS stratum, d.doc_id AS position,
  CASE WHEN l.toxic = 1 THEN 'wrong' WHEN l.doc_id IS NULL THEN 'unsure' ELSE 'correct' END AS verdict
  FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id"""
_VERD = _VERDICTS.replace("{documents}", "documents").replace("{labels}", "labels")
_TALLY = [f"v AS ({_VERD})", """tally AS (SELECT stratum, count(*) FILTER (verdict <> 'unsure') AS reviewed,
    count(*) FILTER (verdict = 'wrong') AS defects FROM (SELECT *, count(*) FILTER (verdict = 'wrong') OVER (
      PARTITION BY stratum ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM v)
    WHERE w = 0 GROUP BY stratum)"""]


@query("curtailed", with_ctes(_TALLY, """SELECT stratum, reviewed, defects,
  CASE WHEN defects = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM tally"""))
def _(t):
    return Q.curtailed_tally(t.sql(_VERDICTS))


def _card(t):
    docs = t.documents.withColumn("ticket", F.col("doc_id").cast("string"))
    plan = Q.sample_plan(docs.withColumn("stratum_key", F.concat_ws("/", "lang", "source")),
                         ["stratum_key"])
    plan = plan.withColumn("stratum", F.regexp_replace("stratum", "^stratum_key: ", ""))
    return Q.acceptance_card(plan, Q.curtailed_tally(t.sql(_VERDICTS)), "clean",
                             "2026-01-01T00:00:00", run_id="run1")


_CARD = _TALLY + ["""lots AS (SELECT CASE WHEN count(*) OVER (PARTITION BY lang, source) < 5 THEN '(אחר)'
    ELSE lang || '/' || source END AS stratum FROM documents)""", """
  ls AS (SELECT stratum, count(*) AS lot_size, least(47, count(*)) AS sample_n FROM lots GROUP BY stratum)""", """
  cd AS (SELECT ls.*, coalesce(reviewed, 0) AS reviewed, coalesce(defects, 0) AS defects FROM ls
    LEFT JOIN tally ON tally.stratum = ls.stratum)"""]


@query("acceptance_card", with_ctes(_CARD, """SELECT 'clean' AS stage, bool_and(defects = 0) AS passed,
  CAST(sum(lot_size) AS BIGINT) AS total_lot, CAST(sum(reviewed) AS BIGINT) AS total_reviewed,
  CAST(sum(defects) AS BIGINT) AS total_defects,
  'נבדקו ' || CAST(sum(reviewed) AS BIGINT) || ' שורות מתוך ' || format('{:,}', CAST(sum(lot_size) AS BIGINT)) ||
    '. ' || CASE WHEN bool_and(defects = 0) THEN 'נמצאו 0 שגיאות. שיעור השגיאה נמוך מ-5% ברמת ביטחון 90%.'
    ELSE 'נמצאו ' || CAST(sum(defects) AS BIGINT) || ' שגיאות. אי אפשר להבטיח ששיעור השגיאה נמוך מ-5%.' END
    AS claim FROM cd"""))
def _(t):
    return _card(t).select("stage", "passed", "total_lot", "total_reviewed", "total_defects", "claim")


@query("card_rows", with_ctes(_CARD, """SELECT stratum, lot_size, sample_n, reviewed, defects,
    CASE WHEN defects = 0 THEN '✅ עבר' ELSE '❌ נכשל' END AS verdict FROM cd
  UNION ALL SELECT 'סה״כ', CAST(sum(lot_size) AS BIGINT), NULL, CAST(sum(reviewed) AS BIGINT),
    CAST(sum(defects) AS BIGINT), CASE WHEN bool_and(defects = 0) THEN '✅ עבר' ELSE '❌ נכשל' END FROM cd"""))
def _(t):
    return Q.card_rows(_card(t)).drop("pos")


# -- comparison ---------------------------------------------------------------

# A copy of the orders with some rows gone, some new, and some values changed.
_COPY = """SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS ticket,
  CASE WHEN o_orderkey % 7 = 0 THEN ' ' || lower(o_orderpriority) || ' ' WHEN o_orderkey % 11 = 0 THEN NULL
    ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS customer FROM {orders}"""
_MINE = """SELECT o_orderkey AS ticket, o_orderpriority AS priority,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 34 = 0 THEN NULL ELSE o_custkey END AS customer FROM {orders}"""
_PAIR = [f"a AS ({_MINE.replace('{orders}', 'orders')})", f"b AS ({_COPY.replace('{orders}', 'orders')})"]


def _agreement(c: str) -> str:
    same = f"lower(trim(CAST(a.{c} AS STRING))) IS NOT DISTINCT FROM lower(trim(CAST(b.{c} AS STRING)))"
    return f"""SELECT '{c}' AS "column", count(*) FILTER ({same}) AS agree,
      count(*) FILTER (NOT ({same})) AS differ, count(*) FILTER (a.{c} IS NULL) AS missing,
      round(count(*) FILTER ({same}) * 100.0 / count(*), 1) AS agree_pct FROM a JOIN b USING (ticket)"""


def _compared(t):
    return compare_tables(t.sql(_MINE), t.sql(_COPY))


@query("compare_keys", with_ctes(_PAIR, """SELECT (SELECT count(*) FROM a JOIN b USING (ticket)) AS matched_rows,
  (SELECT count(*) FROM a ANTI JOIN b USING (ticket)) AS only_left,
  (SELECT count(*) FROM b ANTI JOIN a USING (ticket)) AS only_right"""))
def _(t):
    return _compared(t)["keys"]


@query("compare_columns", with_ctes(_PAIR, " UNION ALL ".join(
    _agreement(c) for c in ("customer", "priority", "status"))))
def _(t):
    return _compared(t)["per_column"]


@query("compare_diff", with_ctes(_PAIR, """SELECT CAST(ticket AS STRING) AS ticket,
  a.customer AS customer_left, a.priority AS priority_left, a.status AS status_left,
  b.customer AS customer_right, b.priority AS priority_right, b.status AS status_right
  FROM a JOIN b USING (ticket)"""))
def _(t):
    return _compared(t)["diff"]


@query("membership", """SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    AS in_debt FROM orders WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)""")
def _(t):
    heavy = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("o_custkey")).distinct()
    debt = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"),
                                                    F.lit(True).alias("d"))
    return t.orders.join(heavy, "o_custkey", "left_anti").join(debt, "o_custkey", "left") \
        .select("o_orderkey", F.coalesce("d", F.lit(False)).alias("in_debt"))


# -- audit --------------------------------------------------------------------


def _change(c: str) -> str:
    return f"""SELECT CAST(ticket AS STRING) AS ticket, '{c}' AS field,
      coalesce(CAST(a.{c} AS STRING), '') AS old, coalesce(CAST(b.{c} AS STRING), '') AS new,
      'manual_editor' AS source, 'run1' AS run_id FROM a JOIN b USING (ticket)
      WHERE a.{c} IS DISTINCT FROM b.{c}"""


_CHANGES = " UNION ALL ".join(_change(c) for c in ("customer", "priority", "status"))


def _entries(t, run="run1"):
    return AU.change_entries(t.sql(_MINE), t.sql(_COPY), ["customer", "priority", "status"],
                             "manual_editor", run, "2026-01-01T00:00:00")


# Repeated and blank tickets: two rows per customer are one ticket, some tickets are blank.
_AGAIN = """SELECT CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_custkey % 11 = 0 THEN NULL
    WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING)
    ELSE CAST(o_orderkey AS STRING) || '-' || CAST(o_custkey AS STRING) END AS ticket,
  {status} AS status FROM {{orders}}"""
_OLD = _AGAIN.format(status="o_orderstatus")
_NEW = _AGAIN.format(status="CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END")
_SINGLE = """SELECT ticket, min(status) AS status FROM ({}) t WHERE ticket <> '' GROUP BY ticket HAVING count(*) = 1"""


@query("audit_repeats", f"""SELECT o.ticket, 'status' AS field, o.status AS old, n.status AS new
  FROM ({_SINGLE.format(_OLD.replace('{orders}', 'orders'))}) o
  JOIN ({_SINGLE.format(_NEW.replace('{orders}', 'orders'))}) n ON n.ticket = o.ticket
  WHERE o.status IS DISTINCT FROM n.status""")
def _(t):
    return AU.change_entries(t.sql(_OLD), t.sql(_NEW), ["status"], "manual_editor", "run1",
                             "2026-01-01T00:00:00").select("ticket", "field", "old", "new")


@query("audit_repeated_keys", f"""SELECT coalesce(ticket, '') AS ticket, count(*) AS rows
  FROM ({_OLD.replace('{orders}', 'orders')}) t GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return AU.repeated_keys(t.sql(_OLD))


@query("audit_diff", with_ctes(_PAIR, _CHANGES))
def _(t):
    return _entries(t).drop("timestamp")


@query("audit_runs", with_ctes(_PAIR + [f"e AS ({_CHANGES})"], """SELECT run_id, count(*) AS entries,
  last_entry FROM (SELECT CASE WHEN field = 'status' THEN 'run2' ELSE 'run1' END AS run_id,
    CASE WHEN field = 'status' THEN '2026-01-02T00:00:00' ELSE '2026-01-01T00:00:00' END AS last_entry FROM e)
  GROUP BY ALL"""))
def _(t):
    from tidyward.sources.readers import audit_runs
    second = F.col("field") == "status"
    return audit_runs(_entries(t).withColumns({
        "run_id": F.when(second, "run2").otherwise(F.col("run_id")),
        "timestamp": F.when(second, "2026-01-02T00:00:00").otherwise(F.col("timestamp"))}))


@query("audit_log", with_ctes(_PAIR, _CHANGES))
def _(t):
    """Written in two batches, one of them twice, and read back."""
    from tidyward.session import shared_folder
    from tidyward.sources.readers import read_audit
    from tidyward.sources.writers import append_audit
    path = f"{shared_folder(t.spark)}/audit-{uuid.uuid4().hex}"
    entries = _entries(t)
    status = F.col("field") == "status"
    for batch, part in (("b1", status), ("b2", ~status), ("b1", status)):
        append_audit(entries.where(part), path, batch)
    return read_audit(t.spark, path, "run1").drop("timestamp")


_SAY = "'אחריות נקבעה כ\"' || responsibility || '\"'"
_FIRST_WORD = "CASE resp_source " + " ".join(
    f"WHEN {lit('keyword:' + label)} THEN CASE " + " ".join(
        f"WHEN contains(description, {lit(w)}) THEN {lit(w)}" for w in words) + " END"
    for label, words in R.RESP_KEYWORDS.items()) + " END"
_LOGGED = CLEANED + [f"""log AS (
  SELECT ticket, 'קטגוריה' AS kind, {txt('subtopic')} AS before, category AS after,
    'תת-נושא "' || subtopic || '" שויך לקטגוריה "' || category || '" לפי טבלת המיפוי' AS reason,
    NULL AS keyword FROM cleaned
    WHERE category_source = 'map' AND subtopic <> '' AND category <> '' AND subtopic <> category
  UNION ALL SELECT ticket, 'אחריות', 'לא מסווג', responsibility,
    CASE WHEN resp_source = 'map' THEN {_SAY} || ' — כל פניות הקטגוריה "' || category || '" מסווגות כך'
      ELSE {_SAY} || ' בגלל מילת המפתח "' || replace(resp_source, 'keyword:', '') || '" שנמצאה בתיאור' END,
    {_FIRST_WORD} FROM cleaned
    WHERE (resp_source = 'map' AND responsibility NOT IN ('א.מ.ל', '')) OR resp_source LIKE 'keyword:%'
  UNION ALL SELECT ticket, 'כתובת', {txt('raw_address')},
    trim({txt('street')} || ' ' || {txt('house')}),
    'כתובת "' || {txt('raw_address')} || '" נוּתחה: רחוב "' || {txt('street')} || '", בית ' ||
      {txt('house')} || ' (סוג: ' || {mapped('addr_route', AU.ROUTES)} || ')', NULL FROM cleaned
    WHERE addr_route IN ({lits(AU.ROUTES)}) AND {txt('street')} <> '' AND length({txt('raw_address')}) > 2)"""]


@query("correction_log", with_ctes(_LOGGED, "SELECT * FROM log"))
def _(t):
    return AU.correction_log(clean(t.sql(COMPLAINTS))).select(
        "ticket", "kind", "before", "after", "reason", "keyword")


@query("correction_summary", with_ctes(_LOGGED, """SELECT count(*) AS corrections,
  count(DISTINCT ticket) AS tickets, count(*) FILTER (kind = 'קטגוריה') AS category,
  count(*) FILTER (kind = 'אחריות') AS responsibility, count(*) FILTER (kind = 'כתובת') AS address FROM log"""))
def _(t):
    return AU.correction_summary(AU.correction_log(clean(t.sql(COMPLAINTS))))


@query("provenance_counts", with_ctes([SPOT], """SELECT count(*) FILTER (category_source = 'map')
    AS category_corrections, count(*) FILTER (resp_source = 'map' OR resp_source LIKE 'keyword:%'
    OR resp_source = 'context_resolve') AS responsibility_corrections FROM spots"""))
def _(t):
    return AU.provenance_counts(t.sql(SPOTS))


@query("provenance_status", with_ctes([SPOT], """SELECT 'partial' AS level, 'addr_route' AS missing,
  count(*) AS rows FROM spots"""))
def _(t):
    rows = t.sql(SPOTS).drop("addr_route")
    level, missing = AU.provenance_status(rows)
    return rows.agg(F.lit(level).alias("level"), F.lit(",".join(missing)).alias("missing"),
                    F.count(F.lit(1)).alias("rows"))
