"""Domain tables derived from the driver's tables, as SQL both engines read.

Every derivation covers its whole source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidyward import rules as R
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def cases(expr: str, values: list, other: str = "NULL") -> str:
    """``expr`` picks the value at its position; None stands for ``other``."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None)
    return f"CASE {expr} {whens} ELSE {other} END"


def quoted(words: list[str]) -> list[str]:
    return ["'" + w + "'" for w in words]


SUBTOPIC_NAMES = [s[0] for s in R.SUBTOPICS]
HE_STREETS = ["הרצוג", "בראון", "הס", "לחי", "שחל"]

_N, _S = "p.p_name", "CAST(p.p_size AS STRING)"
ADDRESS_FORMS = [
    f"{_N} || ' ' || {_S}",
    f"{_N} || ' ' || {_S} || '-' || CAST(p.p_size + 4 AS STRING)",
    f"{_N} || ' פינת ' || p.p_brand",
    f"{_N} || ' ' || {_S} || 'א'",
    f"{_N} || ' ' || {_S} || ' ג' || chr(39)",
    f"{_N} || ' ליד בית ספר'",
    f"{_N} || ' ' || {_S} || ' (גן העיר)'",
    f"{_N} || ' ' || {_S} || '+' || CAST(p.p_size + 2 AS STRING)",
    _N,
    "''",
    f"{_N} || ' ' || {_S} || '&amp;' || CAST(p.p_size + 2 AS STRING)",
    f"{_N} || ' בין הנדיב לאלתרמן'",
    "'(גינת העיר)'",
    None,
    _S,
    f"{_N} || ' ' || {_S} || ' מול הגן'",
    f"'  ' || {_N} || ' פ' || chr(39) || ' ' || p.p_brand || ' '",
    "'חוף השרון'",
    f"{_S} || '(' || {_N} || ')'",
    "'טיילת הים'",
    cases("o.o_orderkey % 5", quoted(HE_STREETS)),
    f"{_N} || ' ' || {_S} || ' &quot;ב&quot;'",
]
PHRASES = [
    "שברו את הפח בפינוי", "ריח רע מהפח הגדול", "אשפה זרוקה בשביל", "הפח נעלם מהחצר",
    "שכנים זרקו שקיות", "עלים ושלכת בכל הרחוב", "ריח רע ושקיות בשביל", "מבקשת שיצרו קשר",
    "המכסה חסר בפח הגדול", "צואת יונים על הספסל", "כתמים על הרצפה", "ריח רע מהפח הגדול שוב",
    "כתמים על הרצפה בשביל", "לא טופל כבר שבועיים",
]
TOPIC_NAMES = ["פינוי אשפה", "תקלות בכלי אצירה", "ניקיון", "פינוי פגר", "אחר"]

# Raw complaints: one per order, its street taken from the part with the customer's number.
COMPLAINTS = f"""
SELECT
  '  ' || CAST(o.o_orderkey AS STRING) ||
    CASE o.o_orderkey % 7 WHEN 0 THEN '-ב' WHEN 1 THEN '.0' WHEN 2 THEN ' - ג ' ELSE '' END AS ticket,
  CASE WHEN o.o_orderkey % 89 = 0 THEN NULL
       ELSE o.o_orderdate + INTERVAL 1 HOUR * (o.o_orderkey % 24) END AS opened_at,
  {cases("o.o_orderkey % " + str(len(ADDRESS_FORMS)), ADDRESS_FORMS)} AS raw_address,
  {cases("o.o_custkey % 5", quoted(TOPIC_NAMES))} AS topic,
  {cases("(o.o_orderkey + o.o_custkey * 3) % 43",
         quoted(SUBTOPIC_NAMES) + ["''", "' '", "'בדיקת מים'", "'אחר &amp; שונות'"])} AS subtopic,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE
    {cases("(o.o_orderkey + o.o_custkey) % " + str(len(PHRASES)), quoted(PHRASES))} ||
    CASE WHEN o.o_orderkey % 11 = 0 THEN ' טלפון 052-1234567' ELSE '' END END AS description,
  {cases("o.o_orderkey % 3", quoted(["טופל", "פתוח"]))} AS status,
  o.o_orderpriority AS department
FROM {{orders}} o JOIN {{part}} p ON p.p_partkey = o.o_custkey
"""

METHODS = ["gis_exact", "nominatim", "gis_nearest", "unresolved", "nominatim_cached",
           "osm_centroid", "flagged_description", "local_exact", "no_street"]
CATEGORY_NAMES = list(R.RESPONSIBILITY)
ZONES = ["מרכז", "צפון", "דרום", "מזרח", "מערב", R.ZONE_OUTSIDE, R.ZONE_UNKNOWN]

# Cleaned and located rows: one per order.
SPOTS = f"""
SELECT
  CAST(o.o_orderkey AS STRING) AS ticket,
  CASE WHEN o.o_orderkey % 53 = 0 THEN NULL
       ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS date,
  CASE WHEN o.o_orderkey % 53 = 0 THEN NULL
       ELSE CAST(EXTRACT(MONTH FROM o.o_orderdate) AS INT) END AS month,
  CASE WHEN o.o_orderkey % 31 = 0 THEN NULL WHEN o.o_orderkey % 37 = 0 THEN '12-14'
       WHEN o.o_orderkey % 41 = 0 THEN ' ' ELSE p.p_name END AS street,
  CASE WHEN o.o_orderkey % 9 = 0 THEN '' WHEN o.o_orderkey % 23 = 0 THEN '0'
       WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE CAST(p.p_size AS STRING) END AS house,
  CASE o.o_orderkey % 10 WHEN 0 THEN 'ציון דרך' WHEN 1 THEN 'ללא רחוב' WHEN 2 THEN 'טווח בתים'
       WHEN 3 THEN 'צומת' ELSE 'כתובת' END AS loc_type,
  CASE WHEN o.o_orderkey % 6 = 0 THEN NULL
       ELSE '32.1' || CAST(40 + o.o_custkey % 70 AS STRING) ||
            CASE WHEN o.o_orderkey % 6 = 1 THEN ',' ELSE '' END END AS lat,
  CASE WHEN o.o_orderkey % 6 = 0 THEN NULL WHEN o.o_orderkey % 97 = 5 THEN 'nan'
       ELSE '34.' || CAST(770 + (o.o_custkey * 7) % 110 AS STRING) END AS lon,
  {cases("o.o_orderkey % 9", quoted(METHODS))} AS geocode_method,
  {cases("(o.o_orderkey + o.o_custkey) % 7",
         quoted(["address", "near_address", "street", "none", "address_unverified", "address"]))}
    AS precision,
  {cases("(o.o_orderkey * 3 + o.o_custkey) % 17", quoted(CATEGORY_NAMES + ["לא מסווג", ""]))}
    AS category,
  {cases("(o.o_orderkey + o.o_custkey * 5) % 6",
         quoted(["עירייה", "התנהגות אזרח", "טבעי", "בקשה מהעירייה", "א.מ.ל", "כשל עירוני"]))}
    AS responsibility,
  {cases("o.o_orderkey % 4", quoted(["טופל", "פתוח", " "]))} AS status,
  CAST(CASE WHEN o.o_custkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS is_recurring,
  CAST(CASE o.o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE NULL END AS INT) AS same_day,
  {cases("o.o_custkey % 7", quoted(ZONES))} AS zone,
  {cases("o.o_orderkey % 7", quoted(["שני", "שלישי", "רביעי", "חמישי", "שישי", "שבת"]))}
    AS weekday,
  {cases("o.o_orderkey % 8", quoted(["std", "intersection", "range", "apt_suffix", "multi",
                                     "landmark", "empty"]))} AS addr_route,
  {cases("o.o_custkey % 4", quoted(["map", "topic_fallback", "passthrough"]))} AS category_source,
  {cases("o.o_orderkey % 5", quoted(["map", "keyword:עירייה", "unresolved", "context_resolve"]))}
    AS resp_source,
  o.o_totalprice AS amount
FROM {{orders}} o JOIN {{part}} p ON p.p_partkey = o.o_custkey
"""

# Address points: one per part; a street's code is its first part number.
POINTS = """
SELECT CAST(c.code AS INT) AS street_code, p.p_name AS street_name,
  CAST(p.p_size * 2 AS STRING) || CASE WHEN p.p_partkey % 5 = 0 THEN 'א' ELSE '' END AS house_raw,
  CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE p.p_size * 2 END AS house_no,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE p.p_brand END AS neighborhood,
  32.14 + CAST(p.p_partkey % 590 AS DOUBLE) / 10000 AS lat,
  34.80 + CAST(p.p_partkey * 7 % 690 AS DOUBLE) / 10000 AS lon,
  p.p_partkey AS seq
FROM {part} p JOIN (SELECT p_name, min(p_partkey) + 1 AS code FROM {part} GROUP BY p_name) c
  ON c.p_name = p.p_name
"""

# Requests: one per line item, its street from the part.
REQUESTS = """
SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-' ||
    CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) AS ticket,
  CASE l.l_linenumber WHEN 6 THEN 'no such lane'
       WHEN 7 THEN """ + cases("l.l_suppkey % 5", quoted(HE_STREETS)) + """
       ELSE p.p_name END AS street,
  CASE WHEN l.l_suppkey % 13 = 0 THEN '0' WHEN l.l_suppkey % 17 = 0 THEN NULL
       WHEN l.l_suppkey % 7 = 0 THEN CAST(CAST(l.l_quantity AS INT) AS STRING) || 'ב'
       WHEN l.l_suppkey % 5 = 0 THEN CAST(CAST(l.l_quantity AS INT) * 3 AS STRING)
       ELSE CAST(CAST(l.l_quantity AS INT) AS STRING) END AS house,
  'כתובת' AS loc_type
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey
"""

# Corrections: one JSON document per part type, an entry per street name.
CORRECTIONS = """
SELECT p_name AS name,
  CASE WHEN min(p_partkey) % 4 = 0 THEN 'unresolvable' ELSE 'resolvable' END AS status,
  CASE WHEN min(p_partkey) % 6 = 1 THEN 'description of a place' ELSE '' END AS note,
  CASE WHEN min(p_partkey) % 3 = 0 THEN p_name || ' way' END AS nominatim,
  CASE WHEN min(p_partkey) % 5 < 2 THEN 'st ' || p_name END AS gis
FROM {part} GROUP BY p_name
"""


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer pieces than there are cores would leave most of them idle.

    A large file is read in pieces, but those without the start of a row group are empty: pieces with rows count.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.rdd.getNumPartitions() >= cores and \
            df.select(F.spark_partition_id().alias("piece")).distinct().count() >= cores:
        return df
    return df.repartition(cores)


class Tables:
    """The driver's tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._read = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = spread(self.spark.read.parquet(f"{self.dir}/{name}.parquet"))
        return self._read[name]

    def sql(self, text: str) -> DataFrame:
        used = {n: getattr(self, n) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


def plain(text: str) -> str:
    """The same SQL over views named like the tables."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text
