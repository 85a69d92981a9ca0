"""Reference tables, street names, geocoding, zones and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyward import rules as R
from tidyward.functions import geo as G
from tidyward.functions import text as T
from tidyward.operators import geocode as GC
from tidyward.operators import repair as RP
from tidyward.operators import streets as ST
from tidyward.operators import zones as Z
from tidyward.plans.inputs import (
    CORRECTIONS, POINTS, REQUESTS, SPOTS, plain,
)
from tidyward.plans.catalog.registry import (
    POINT, REQUEST, SPOT, lit, mapped, num, query, txt, with_ctes,
)
from tidyward.sources import readers as RD

# -- reference tables ---------------------------------------------------------

# One JSON document per street name, in the format of the corrections file.
_DOCS = f"""SELECT concat('{{{{"', name, '": {{{{"status": "', status, '", "note": "', note,
  '", "nominatim": ', CASE WHEN nominatim IS NULL THEN 'null' ELSE concat('"', nominatim, '"') END,
  ', "gis": ', CASE WHEN gis IS NULL THEN 'null' ELSE concat('"', gis, '"') END, '}}}}}}}}') AS value
  FROM ({CORRECTIONS})"""
_CORR = f"corr AS ({plain(CORRECTIONS)})"


def corrections(t):
    return RD.parse_corrections(t.sql(_DOCS))


@query("corrections_load", with_ctes([_CORR], """SELECT name, status, note, nominatim, gis,
  true AS has_gis FROM corr"""))
def _(t):
    return corrections(t)


@query("correction_sets", with_ctes([_CORR], """SELECT 'street' AS kind, name, nominatim AS target
    FROM corr WHERE nominatim IS NOT NULL
  UNION ALL SELECT 'layer', name, gis FROM corr
  UNION ALL SELECT 'described', name, NULL FROM corr
    WHERE (status = 'unresolvable' AND gis IS NULL) OR contains(note, 'description')
  UNION ALL SELECT 'unresolvable', name, NULL FROM corr
    WHERE status = 'unresolvable' OR contains(note, 'description')
  UNION ALL SELECT 'conflict', name, nominatim FROM corr
    WHERE nominatim IS NOT NULL AND gis IS NOT NULL AND nominatim <> gis"""))
def _(t):
    c = corrections(t)
    none = F.lit(None).cast("string")
    tag = lambda kind, df, target: df.select(F.lit(kind).alias("kind"), "name", target.alias("target"))
    return (tag("street", RD.street_corrections(c), F.col("nominatim"))
            .union(tag("layer", RD.manual_layer_names(c), F.col("gis")))
            .union(tag("described", RD.flag_descriptions(c), none))
            .union(tag("unresolvable", RD.known_unresolvable(c), none))
            .union(tag("conflict", RD.correction_conflicts(c), F.col("nominatim"))))


_INDEX = """idx AS (SELECT street_code, key, arg_max(round(lat, 7), seq) AS lat,
    arg_max(round(lon, 7), seq) AS lon, min(seq) AS seq FROM (
    SELECT DISTINCT street_code, unnest([trim(house_raw), CAST(house_no AS STRING)]) AS key, seq, lat, lon
    FROM points) WHERE key IS NOT NULL AND key <> '' GROUP BY street_code, key)"""
_CENTRES = """centres AS (SELECT street_code, round(avg(lat), 7) AS lat, round(avg(lon), 7) AS lon
  FROM points GROUP BY street_code)"""
_NAMES = """names AS (SELECT street_code, arg_min(street_name, seq) AS name,
  arg_min(neighborhood, seq) FILTER (neighborhood IS NOT NULL) AS neighborhood FROM points
  GROUP BY street_code)"""


@query("address_index", with_ctes([POINT, _INDEX], "SELECT street_code, key, lat, lon, seq FROM idx"))
def _(t):
    return GC.address_index(t.sql(POINTS)).select("street_code", "key", "point.lat", "point.lon", "seq")


@query("street_centroids", with_ctes([POINT, _CENTRES], "SELECT * FROM centres"))
def _(t):
    return GC.street_centroids(t.sql(POINTS))


@query("street_code_names", with_ctes([POINT, _NAMES], "SELECT * FROM names"))
def _(t):
    return GC.code_names(t.sql(POINTS)).drop("seq")


_REGISTRY = """SELECT ' ' || p_name || ' ' AS name, CASE p_partkey % 5 WHEN 0 THEN 'x'
  WHEN 1 THEN '-3' ELSE CAST(p_partkey + 1 AS STRING) || '.0' END AS code, p_partkey AS seq FROM {part}"""


@query("registry_load", f"""WITH r AS ({plain(_REGISTRY)}),
  ok AS (SELECT trim(name) AS name, CAST(TRY_CAST(code AS DOUBLE) AS INT) AS code, seq FROM r
    WHERE TRY_CAST(code AS DOUBLE) > 0)
  SELECT name, arg_max(code, seq) AS code, min(seq) AS seq FROM ok GROUP BY name""")
def registry(t):
    return ST.registry_table(t.sql(_REGISTRY))


def _degrees_sql() -> str:
    """The inverse series of the grid, written out for DuckDB with its published coefficients."""
    g = G.GRID
    n = "(f / (2 - f))"
    power = lambda k: f"pow({n}, {k})"
    series = lambda terms: " + ".join(f"({a}) * {power(k)}" for a, k in terms)
    alpha = [[("1.0/2", 1), ("-2.0/3", 2), ("5.0/16", 3), ("41.0/180", 4)],
             [("13.0/48", 2), ("-3.0/5", 3), ("557.0/1440", 4)],
             [("61.0/240", 3), ("-103.0/140", 4)], [("49561.0/161280", 4)]]
    beta = [[("1.0/2", 1), ("-2.0/3", 2), ("37.0/96", 3), ("-1.0/360", 4)],
            [("1.0/48", 2), ("1.0/15", 3), ("-437.0/1440", 4)],
            [("17.0/480", 3), ("-37.0/840", 4)], [("4397.0/161280", 4)]]
    delta = [[("2.0", 1), ("-2.0/3", 2), ("-2.0", 3), ("116.0/45", 4)],
             [("7.0/3", 2), ("-8.0/5", 3), ("-227.0/45", 4)],
             [("56.0/15", 3), ("-136.0/35", 4)], [("4279.0/630", 4)]]
    terms = lambda coefficients, term: " + ".join(
        f"({series(c)}) * {term.format(2 * j)}" for j, c in enumerate(coefficients, start=1))
    return f"""WITH p AS (SELECT p_partkey, (178000 + p_partkey % 900 * 10)::DOUBLE AS x,
    (671000 + p_size * 100)::DOUBLE AS y, {g['f']!r}::DOUBLE AS f, radians({g['lat0']!r}::DOUBLE) AS phi0,
    {g['a']!r}::DOUBLE AS a FROM part),
  c AS (SELECT *, {g['k0']!r}::DOUBLE * a / (1 + {n}) * (1 + {power(2)} / 4 + {power(4)} / 64) AS scale,
    2 * sqrt({n}) / (1 + {n}) AS e FROM p),
  d AS (SELECT *, atan(sinh(asinh(tan(phi0)) - e * atanh(e * sin(phi0)))) AS chi0 FROM c),
  o AS (SELECT *, chi0 + {terms(alpha, 'sin({0} * chi0)')} AS xi0 FROM d),
  q AS (SELECT *, (y - {g['y0']!r}::DOUBLE) / scale + xi0 AS xi, (x - {g['x0']!r}::DOUBLE) / scale AS eta FROM o),
  r AS (SELECT *, xi - ({terms(beta, 'sin({0} * xi) * cosh({0} * eta)')}) AS xp,
    eta - ({terms(beta, 'cos({0} * xi) * sinh({0} * eta)')}) AS ep FROM q),
  s AS (SELECT *, asin(sin(xp) / cosh(ep)) AS chi FROM r)
  SELECT p_partkey, round(degrees(chi + {terms(delta, 'sin({0} * chi)')}), 7) AS lat,
    round(degrees(atan2(sinh(ep), cos(xp))) + {g['lon0']!r}::DOUBLE, 7) AS lon FROM s"""


@query("reprojection", _degrees_sql())
def _(t):
    x = (178000 + F.col("p_partkey") % 900 * 10).cast("double")
    y = (671000 + F.col("p_size") * 100).cast("double")
    lat, lon = G.grid_to_degrees("x", "y")
    return t.part.select("p_partkey", x.alias("x"), y.alias("y")) \
        .select("p_partkey", lat.alias("lat"), lon.alias("lon"))


_HAV = """asin(sqrt(pow(sin(radians(32.166 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(32.166))
  * pow(sin(radians(34.843 - lon) / 2), 2))) * 2 * 6371000"""


@query("box_and_distance", with_ctes([POINT], f"""SELECT seq, lat BETWEEN 32.14 AND 32.17 AND
  lon BETWEEN 34.78 AND 34.83 AS in_box, round({_HAV}, 3) AS metres FROM points"""))
def _(t):
    return t.sql(POINTS).select(
        "seq", G.in_box("lat", "lon", (32.14, 32.17, 34.78, 34.83)).alias("in_box"),
        F.round(G.haversine_m("lat", "lon", F.lit(32.166), F.lit(34.843)), 3).alias("metres"))


# -- point lookups ------------------------------------------------------------

_CODED = f"""coded AS (SELECT DISTINCT n.street_code, r.house FROM requests r
  JOIN (SELECT DISTINCT street_code, street_name FROM points) n ON n.street_name = r.street)"""
_NUM = r"TRY_CAST(regexp_extract({}, '^(\d+)', 1) AS BIGINT)"
_WHOLE = rf"({txt('house')} IN ('', '0', 'nan', 'None') OR regexp_matches({txt('house')}, '^0+$'))"
_MATCHED = [POINT, REQUEST, _INDEX, _CENTRES, _CODED, f"""
  m1 AS (SELECT c.*, {_WHOLE} AS whole, {_NUM.format(txt('c.house'))} AS n,
      CASE WHEN NOT {_WHOLE} THEN coalesce(a.lat, b.lat) END AS elat,
      CASE WHEN NOT {_WHOLE} THEN coalesce(a.lon, b.lon) END AS elon
    FROM coded c LEFT JOIN idx a ON a.street_code = c.street_code AND a.key = {txt('c.house')}
    LEFT JOIN idx b ON b.street_code = c.street_code
      AND b.key = nullif(regexp_extract({txt('c.house')}, '^(\\d+)', 1), ''))""", f"""
  nums AS (SELECT street_code, {_NUM.format('key')} AS k, key, seq, lat, lon FROM idx)""", """
  near AS (SELECT m.street_code, m.house, min({'off': abs(i.k - m.n), 'seq': i.seq, 'key': i.key,
      'lat': i.lat, 'lon': i.lon}) AS p FROM m1 m JOIN nums i
      ON i.street_code = m.street_code AND abs(i.k - m.n) <= 20
    WHERE NOT whole AND elat IS NULL GROUP BY ALL)""", """
  matched AS (SELECT m.street_code, m.house,
    CASE WHEN elat IS NOT NULL THEN elat WHEN near.p IS NOT NULL THEN near.p.lat ELSE c.lat END AS lat,
    CASE WHEN elat IS NOT NULL THEN elon WHEN near.p IS NOT NULL THEN near.p.lon ELSE c.lon END AS lon,
    CASE WHEN elat IS NOT NULL THEN 'local_exact' WHEN near.p IS NOT NULL THEN 'local_nearest'
      ELSE 'local_street_centroid' END AS geocode_method
    FROM m1 m LEFT JOIN near ON near.street_code = m.street_code AND near.house = m.house
    LEFT JOIN centres c ON c.street_code = m.street_code)"""]


def _coded(t):
    streets = t.sql(POINTS).select("street_code", F.col("street_name").alias("street")).distinct()
    return t.sql(REQUESTS).join(streets, "street").select("street_code", "house")


def _matched(t, method):
    return GC.match_points(_coded(t), t.sql(POINTS)).where(F.col("geocode_method") == method) \
        .select("street_code", "house", "lat", "lon", "precision")


def _matched_sql(method, tier):
    return with_ctes(_MATCHED, f"""SELECT street_code, house, lat, lon, '{tier}' AS precision
      FROM matched WHERE geocode_method = '{method}'""")


@query("geocode_exact", _matched_sql("local_exact", "address"))
def _(t):
    return _matched(t, "local_exact")


@query("geocode_nearest", _matched_sql("local_nearest", "near_address"))
def _(t):
    return _matched(t, "local_nearest")


@query("geocode_centroid", _matched_sql("local_street_centroid", "street"))
def _(t):
    return _matched(t, "local_street_centroid")


_OSM = "osm(street, lat, lon) AS (VALUES " + ", ".join(
    f"({lit(s)}, {la}::DOUBLE, {lo}::DOUBLE)" for s, la, lo in R.STREET_CENTROIDS) + ")"


@query("listed_centroids", with_ctes([REQUEST, _OSM], """SELECT DISTINCT o.street, o.lat, o.lon,
  'osm_centroid' AS geocode_method FROM requests r JOIN osm o ON o.street = r.street"""))
def _(t):
    req = t.sql(REQUESTS).select(F.col("street").alias("k_street"))
    return GC.locate_by_centroid(req, GC.centroid_table(t.spark)).select(
        F.col("k_street").alias("street"), "hit.lat", "hit.lon", "hit.geocode_method")


@query("zero_houses", with_ctes([REQUEST, _OSM], """SELECT r.ticket, r.street, o.lat, o.lon,
  'street' AS precision FROM requests r LEFT JOIN osm o ON o.street = r.street
  WHERE TRY_CAST(house AS DOUBLE) = 0"""))
def _(t):
    zero = t.sql(REQUESTS).where(GC.is_zero_house("house"))
    return zero.join(GC.centroid_table(t.spark), "street", "left").select(
        "ticket", "street", "lat", "lon", F.lit("street").alias("precision"))


# -- street names -------------------------------------------------------------

_MISSPELT = """SELECT DISTINCT CASE p_partkey % 6
    WHEN 0 THEN substr(p_name, 1, length(p_name) - 2) || substr(p_name, length(p_name), 1)
    WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
    WHEN 2 THEN p_name || ' -מתחם ' || p_brand
    WHEN 3 THEN p_name || ' 12,14' WHEN 4 THEN p_name || ' (' || p_type || ')'
    ELSE p_name || ' ' || p_type || ' ' || CAST(p_size AS STRING) END AS name
  FROM {part}"""


@query("street_fuzzy")
def _(t):
    return ST.resolve_street_codes(t.sql(_MISSPELT), GC.name_codes(t.sql(POINTS)), registry(t),
                                   corrections(t))


_TWISTED = """SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS name
  FROM {part} UNION SELECT p_name FROM {part}"""


@query("registry_resolve", f"""WITH r AS ({plain(_REGISTRY)}),
  reg AS (SELECT name, arg_max(code, seq) AS code, min(seq) AS seq FROM (SELECT trim(name) AS name,
    CAST(TRY_CAST(code AS DOUBLE) AS INT) AS code, seq FROM r WHERE TRY_CAST(code AS DOUBLE) > 0)
    GROUP BY name),
  asked AS ({plain(_TWISTED)})
  SELECT a.name, coalesce(e.name, w.name) AS official, coalesce(e.code, w.code) AS code,
    CASE WHEN e.name IS NOT NULL THEN 'exact' ELSE 'words' END AS how FROM asked a
  LEFT JOIN reg e ON e.name = a.name
  LEFT JOIN (SELECT list_sort(string_split(name, ' ')) AS k, arg_min(name, seq) AS name,
    arg_min(code, seq) AS code FROM reg GROUP BY k) w ON w.k = list_sort(string_split(a.name, ' '))
  WHERE e.name IS NOT NULL OR w.name IS NOT NULL""")
def _(t):
    return ST.resolve_registry(t.sql(_TWISTED), registry(t))


# with names altered so that close matches exist, which SQL has no function for
@query("registry_resolve_whole")
def _(t):
    return ST.resolve_registry(t.sql(_TWISTED).union(t.sql(_MISSPELT)), registry(t))


ARTICLES = """SELECT DISTINCT p_name || ' ' || p_brand || ' ' || p_type || ' ' || CAST(p_size AS STRING) AS name
  FROM {part}"""
MISTYPED = """SELECT DISTINCT substr(p_name, 1, 4) || substr(p_name, 6) || ' ' || p_brand || 'x ' || p_type || ' '
  || CAST(p_size AS STRING) AS name FROM {part} WHERE p_size > 0"""


@query("close_articles")
def _(t):
    return ST.close_matches(t.sql(MISTYPED), t.sql(ARTICLES), 0.85)


@query("close_names")
def _(t):
    return ST.close_matches(t.sql(_MISSPELT), t.part.select(F.col("p_name").alias("name")), 0.78)


_VARIANTS = """SELECT 'רחוב ' || p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ב' || chr(34) || 'ה'
    ELSE ' בה' END || CASE p_partkey % 2 WHEN 0 THEN '' ELSE ' ' || CAST(p_size AS STRING) END AS street,
  'א' || p_name || CAST(p_size AS STRING) AS raw_address FROM {part}"""


@query("street_variants", f"""WITH v AS ({plain(_VARIANTS)}),
  c AS (SELECT regexp_replace(regexp_replace(street, '^רחוב ', ''), '( ב["]?ה)( \\d+)?$', '\\1') AS s
    FROM v),
  n AS (SELECT regexp_replace(s, ' \\d+$', '') AS s FROM c WHERE s IS NOT NULL),
  g AS (SELECT CASE WHEN regexp_matches(s, '[א-ת]') THEN s END AS s, count(*) AS k FROM n GROUP BY ALL),
  k AS (SELECT replace(s, '"', '') AS normalized, s, k, row_number() OVER (
    PARTITION BY replace(s, '"', '') ORDER BY k DESC, s) AS r FROM g WHERE s IS NOT NULL)
  SELECT normalized, arg_min(s, r) AS canonical, sum(k)::BIGINT AS total, count(*) AS spellings
  FROM k GROUP BY normalized HAVING sum(k) >= 4 AND count(*) > 1
  ORDER BY total DESC, normalized LIMIT 30""")
def _(t):
    named = t.sql(_VARIANTS).where(F.col("street").rlike("[א-ת].* ב"))
    return ST.street_variants(named, top=30, max_variants=6).select(
        "normalized", "canonical", "total", "spellings")


@query("street_variants_whole")
def _(t):
    return ST.street_variants(t.sql(_VARIANTS), registry(t))


# -- building layer, geocoder, cascade ----------------------------------------

_LAYER = """SELECT p_name AS street_name, CAST(p_size * 2 AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN 'ב'
    ELSE '' END AS house_raw, 34.80 + CAST(p_partkey % 700 AS DOUBLE) / 10000 AS x,
  32.14 + CAST(p_partkey % 590 AS DOUBLE) / 10000 AS y, p_partkey AS seq FROM {part}"""


def _as_is(x, y):
    return F.round(F.col(y), 7), F.round(F.col(x), 7)


def _request_keys(t):
    return t.sql(REQUESTS).select(T.text("street").alias("k_street"), T.text("house").alias("k_house"),
                                  T.text("loc_type").alias("k_type"), F.lit("").alias("k_cross"))


_KEYS = f"""keys AS (SELECT DISTINCT {txt('street')} AS street, {txt('house')} AS house FROM requests
  WHERE street IN (SELECT street_name FROM layer))"""


@query("layer_rescue", with_ctes([REQUEST, f"layer AS ({plain(_LAYER)})", _KEYS, rf"""
  h AS (SELECT k.*, {_NUM.format('house')} AS n0, CASE WHEN regexp_extract(house, '^(\d+)', 1) <> '0'
    THEN {_NUM.format('house')} END AS n FROM keys k)""", rf"""
  ex AS (SELECT street_name, house_raw, arg_min({{'x': x, 'y': y}}, seq) AS p FROM layer GROUP BY ALL)""",
  rf"""nr AS (SELECT h.street, h.house, arg_min({{'x': x, 'y': y}},
      abs({_NUM.format('house_raw')} - n) * 1000000000 + seq) AS p FROM h JOIN layer l
      ON l.street_name = h.street WHERE n IS NOT NULL GROUP BY ALL)""", """
  ce AS (SELECT street_name, {'x': avg(x), 'y': avg(y)} AS p FROM layer GROUP BY street_name)""", """
  al AS (SELECT h.street, h.house, CASE WHEN n IS NULL THEN 'gis_centroid' WHEN ex.p IS NOT NULL
      THEN 'gis_exact' ELSE 'gis_nearest' END AS geocode_method,
      CASE WHEN n IS NULL THEN ce.p WHEN ex.p IS NOT NULL THEN ex.p ELSE nr.p END AS p
    FROM h LEFT JOIN ex ON ex.street_name = h.street AND ex.house_raw = CAST(n AS STRING)
    LEFT JOIN nr ON nr.street = h.street AND nr.house = h.house
    LEFT JOIN ce ON ce.street_name = h.street)"""], """SELECT street, house, round(p.y, 7) AS lat,
  round(p.x, 7) AS lon, geocode_method FROM al WHERE p IS NOT NULL"""))
def _(t):
    hits = GC.locate_in_layer(_request_keys(t), t.sql(_LAYER), registry(t), None, _as_is)
    return hits.select(F.col("k_street").alias("street"), F.col("k_house").alias("house"),
                       "hit.lat", "hit.lon", "hit.geocode_method")


@query("layer_rescue_whole")
def _(t):
    hits = GC.locate_in_layer(_request_keys(t), t.sql(_LAYER), registry(t), None, _as_is)
    return hits.select(F.col("k_street").alias("street"), F.col("k_house").alias("house"), "hit.*")


@query("layer_names")
def _(t):
    return ST.resolve_layer_names(
        t.sql(_MISSPELT), t.sql(_LAYER).select(F.col("street_name").alias("name")),
        registry(t), corrections(t))


_ODD = """SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'שד. ' || p_name
    WHEN 1 THEN p_name || chr(34) || 'א' WHEN 2 THEN 'ג.' || p_name ELSE p_name END AS k_street,
  CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) || '/2'
    WHEN 1 THEN CAST(p_size AS STRING) || '-' || CAST(p_size + 5 AS STRING)
    WHEN 2 THEN '' ELSE CAST(p_size AS STRING) END AS k_house,
  CASE p_partkey % 4 WHEN 1 THEN 'טווח בתים' WHEN 2 THEN 'צומת' ELSE 'כתובת' END AS k_type,
  CASE p_partkey % 4 WHEN 2 THEN p_brand ELSE '' END AS k_cross FROM {part}"""
_CAND = f"""odd AS ({plain(_ODD)}),
  o1 AS (SELECT *, k_street AS s, k_house AS n, regexp_replace(k_house, '/\\d+$', '') AS cn,
    replace(k_street, '"', '') AS q,
    regexp_replace(trim(replace(k_street, '.', ' ')), '\\s+', ' ', 'g') AS d,
    regexp_replace(k_street, '^שד\\.\\s*', 'שדרות ') AS x FROM odd),
  pairs AS (SELECT *, CASE
    WHEN k_type = 'צומת' THEN [{{'s': s || ' פינת ' || k_cross, 'n': ''}}, {{'s': s, 'n': ''}},
      {{'s': k_cross, 'n': ''}}]
    WHEN k_type = 'טווח בתים' THEN [{{'s': s, 'n': CAST((CAST(split_part(n, '-', 1) AS BIGINT) +
      CAST(split_part(n, '-', 2) AS BIGINT)) // 2 AS STRING)}}, {{'s': s, 'n': split_part(n, '-', 1)}},
      {{'s': s, 'n': ''}}]
    ELSE [{{'s': s, 'n': n}}, {{'s': CASE WHEN cn <> n AND cn <> '' THEN s END, 'n': cn}},
      {{'s': CASE WHEN q <> s THEN q END, 'n': n}},
      {{'s': CASE WHEN q <> s THEN q END, 'n': CASE WHEN cn <> n THEN cn ELSE '' END}},
      {{'s': CASE WHEN q <> s THEN q END, 'n': ''}},
      {{'s': CASE WHEN d <> s THEN d END, 'n': n}}, {{'s': CASE WHEN d <> s THEN d END, 'n': ''}},
      {{'s': CASE WHEN x <> s THEN x END, 'n': n}}, {{'s': CASE WHEN x <> s THEN x END, 'n': ''}},
      {{'s': s, 'n': ''}}] END AS ps FROM o1),
  un AS (SELECT k_street, k_house, k_type, k_cross, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pairs),
  qs AS (SELECT k_street, k_house, k_type, k_cross, i, trim(p.s || ' ' || p.n) || ', הרצליה, ישראל' AS query
    FROM un WHERE p.s IS NOT NULL),
  firsts AS (SELECT k_street, k_house, k_type, k_cross, query, min(i) AS i FROM qs GROUP BY ALL),
  cand AS (SELECT k_street, k_house, k_type, k_cross, query, CAST(row_number() OVER (
    PARTITION BY k_street, k_house, k_type, k_cross ORDER BY i) - 1 AS INT) AS pos FROM firsts)"""


@query("geocoder_candidates", with_ctes([_CAND], """SELECT k_street, k_house, k_type, k_cross, pos,
  query FROM cand"""))
def _(t):
    return GC.geocoder_candidates(t.sql(_ODD))


# Canned answers: some with the house, some for the street, some outside the box.
_ANSWERS = """SELECT p_name || ' ' || CAST(p_size * 2 AS STRING) || ', הרצליה, ישראל' AS query,
    32.15 + CAST(p_partkey % 400 AS DOUBLE) / 10000 AS lat, 34.80 + CAST(p_partkey % 500 AS DOUBLE) / 10000 AS lon,
    CASE WHEN p_partkey % 4 = 0 THEN 26 ELSE 30 END AS place_rank FROM {part}
  UNION ALL SELECT p_name || ', הרצליה, ישראל', CASE WHEN p_partkey % 2 = 0 THEN 33.1 ELSE 32.16 END,
    34.81, 26 FROM {part}"""
_HITS = f"""ans AS (SELECT query, min({{'lat': lat, 'lon': lon, 'r': place_rank}}) AS a FROM ({plain(_ANSWERS)})
    WHERE lat BETWEEN 32.14 AND 32.20 AND lon BETWEEN 34.78 AND 34.87 GROUP BY query),
  hits AS (SELECT k_street, k_house, k_type, k_cross, arg_min(a, pos) AS a, arg_min(cand.query, pos) AS q
    FROM cand JOIN ans ON ans.query = cand.query GROUP BY k_street, k_house, k_type, k_cross)"""


@query("geocoder_join", with_ctes([_CAND, _HITS], """SELECT k_street, k_house, k_type, k_cross,
  round(a.lat, 6) AS lat, round(a.lon, 6) AS lon, CASE WHEN a.r = 30 THEN 'address' ELSE 'street' END
  AS precision, q AS query FROM hits"""))
def _(t):
    hits = GC.locate_by_geocoder(t.sql(_ODD), t.sql(_ANSWERS))
    return hits.select(*GC.KEY, "hit.lat", "hit.lon", "hit.precision",
                       F.col("hit.geocode_query").alias("query"))


def _sources(t):
    return GC.Sources(points=t.sql(POINTS), layer=t.sql(_LAYER), geocoder=t.sql(_ANSWERS),
                      project=_as_is)


_CASC = _MATCHED + [_OSM, f"""codes AS (SELECT DISTINCT street_code, street_name FROM points)""", f"""
  located AS (SELECT r.ticket, r.street, {txt('r.house')} AS house, CASE
      WHEN o.street IS NOT NULL AND TRY_CAST(r.house AS DOUBLE) = 0 THEN
        {{'lat': o.lat, 'lon': o.lon, 'm': 'street_zero_centroid', 'p': 'street'}}
      WHEN m.lat IS NOT NULL THEN {{'lat': m.lat, 'lon': m.lon, 'm': m.geocode_method, 'p':
        CASE m.geocode_method WHEN 'local_exact' THEN 'address' WHEN 'local_nearest' THEN 'near_address'
          ELSE 'street' END}}
      WHEN o.street IS NOT NULL THEN {{'lat': o.lat, 'lon': o.lon, 'm': 'osm_centroid', 'p': 'street'}}
      END AS hit
    FROM requests r LEFT JOIN osm o ON o.street = r.street
    LEFT JOIN codes c ON c.street_name = r.street
    LEFT JOIN matched m ON m.street_code = c.street_code AND m.house IS NOT DISTINCT FROM r.house)"""]


def _cascade(t):
    return GC.geocode(t.sql(REQUESTS), GC.Sources(points=t.sql(POINTS)), "run1")


@query("geocode_cascade", with_ctes(_CASC, """SELECT ticket, street, hit.lat AS lat, hit.lon AS lon,
  coalesce(hit.m, 'unresolved') AS geocode_method, coalesce(hit.p, 'none') AS precision,
  CASE WHEN hit IS NOT NULL THEN street END AS geocode_query FROM located"""))
def _(t):
    return _cascade(t).select("ticket", "street", "lat", "lon", "geocode_method", "precision",
                              "geocode_query")


@query("geocode_stats", with_ctes(_CASC, """SELECT count(*) AS total_rows,
  count(*) FILTER (hit IS NOT NULL) AS total_geocoded, count(*) FILTER (hit IS NULL) AS total_unresolved,
  round(count(*) FILTER (hit IS NOT NULL) * 100.0 / count(*), 1) AS coverage_pct FROM located"""))
def _(t):
    return GC.geocode_stats(_cascade(t))


@query("method_counts", with_ctes(_CASC, """SELECT coalesce(hit.m, 'unresolved') AS geocode_method,
  count(*) AS rows FROM located GROUP BY ALL"""))
def _(t):
    return GC.method_counts(_cascade(t))


@query("local_pass", with_ctes(_CASC + [_NAMES], f"""SELECT DISTINCT l.street, l.house, m.lat, m.lon,
  m.geocode_method, n.neighborhood FROM located l JOIN codes c ON c.street_name = l.street
  JOIN (SELECT DISTINCT street_code, {txt('house')} AS house, lat, lon, geocode_method FROM matched) m
    ON m.street_code = c.street_code AND m.house = l.house
  JOIN names n ON n.street_code = c.street_code"""))
def _(t):
    hits = GC.locate_locally(_request_keys(t), t.sql(POINTS), registry(t))
    return hits.select(
        F.col("k_street").alias("street"), F.col("k_house").alias("house"), "hit.lat", "hit.lon",
        "hit.geocode_method", "hit.neighborhood")


@query("local_pass_whole")
def _(t):
    hits = GC.locate_locally(_request_keys(t), t.sql(POINTS), registry(t))
    return hits.select(F.col("k_street").alias("street"), F.col("k_house").alias("house"), "hit.*")


@query("geocode_all_sources")
def _(t):
    src = _sources(t)
    src.registry, src.corrections = registry(t), corrections(t)
    done = GC.geocode(t.sql(REQUESTS), src, "run1")
    return done.groupBy("geocode_method", "precision").agg(F.count(F.lit(1)).alias("rows"))


@query("layer_retry")
def _(t):
    src = _sources(t)
    rows = t.sql(REQUESTS).withColumns({"lat": F.lit(None).cast("double"),
                                        "lon": F.lit(None).cast("double")})
    return GC.retry_layer(rows, rows.where("house IS NOT NULL"), src)


# -- zones --------------------------------------------------------------------

# References: the first two numbers of every embedding; points: the next two.
_ZONE_NAMES = ["מרכז", "צפון", "דרום", "הרצליה ב", "מזרח", "מערב", R.ZONE_OUTSIDE]
_REFS = """SELECT vec_id AS ref_id, CAST(embedding[{a}] AS DOUBLE) AS lat, CAST(embedding[{b}] AS DOUBLE) AS lon,
  CASE label % 7 """ + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(_ZONE_NAMES)) + """ END AS zone
  FROM {{embeddings}}"""
_PTS = """SELECT CAST(vec_id AS STRING) AS ticket, CASE WHEN vec_id % 10 = 0 THEN NULL
    ELSE CAST(embedding[{c}] AS DOUBLE) END AS lat, CAST(embedding[{d}] AS DOUBLE) AS lon,
  CASE vec_id % 4 WHEN 0 THEN 'שני' WHEN 1 THEN 'שלישי' WHEN 2 THEN 'רביעי' END AS weekday
  FROM {{embeddings}}"""
_ON = dict(a=0, b=1, c=2, d=3)       # arrays count from 0 in Spark
_DUCK = dict(a=1, b=2, c=3, d=4)     # and from 1 in DuckDB


def _hav(lat1, lon1, lat2, lon2):
    return (f"asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))) * 2 * 6371000")


_ZONED = [f"refs AS ({plain(_REFS.format(**_DUCK))})", f"pts AS ({plain(_PTS.format(**_DUCK))})", """
  nn AS (SELECT p.ticket, min({'d2': (p.lat - r.lat) * (p.lat - r.lat) + (p.lon - r.lon) * (p.lon - r.lon),
      'id': r.ref_id, 'zone': r.zone, 'rlat': r.lat, 'rlon': r.lon}) AS b
    FROM pts p, refs r WHERE p.lat IS NOT NULL GROUP BY p.ticket)""", f"""
  zoned AS (SELECT p.*, coalesce(b.zone, 'לא ידוע') AS zone,
    round_even({_hav('lat', 'lon', '(lat + sqrt(b.d2))', 'lon')}, 1) AS zone_distance_m,
    round_even({_hav('lat', 'lon', 'b.rlat', 'b.rlon')}, 1) AS zone_true_m,
    {mapped("coalesce(b.zone, 'לא ידוע')", R.ZONE_DAYS)} AS collection_day
    FROM pts p LEFT JOIN nn ON nn.ticket = p.ticket)"""]


def _enriched(t):
    return Z.enrich(t.sql(_PTS.format(**_ON)), t.sql(_REFS.format(**_ON)))


@query("zone_nn", with_ctes(_ZONED, """SELECT ticket, zone, zone_distance_m, zone_true_m,
  zone_distance_m > 150 AS zone_uncertain FROM zoned"""))
def _(t):
    return _enriched(t).select("ticket", "zone", "zone_distance_m", "zone_true_m", "zone_uncertain")


@query("same_day", with_ctes(_ZONED, """SELECT ticket, weekday, collection_day,
  CAST(weekday = collection_day AS INT) AS same_day FROM zoned"""))
def _(t):
    return _enriched(t).select("ticket", "weekday", "collection_day", "same_day")


@query("enrichment_stats", with_ctes(_ZONED, """SELECT count(*) AS total_rows,
  count(*) FILTER (zone NOT IN ('לא ידוע', 'מחוץ לתחום')) AS in_city,
  round(count(*) FILTER (zone NOT IN ('לא ידוע', 'מחוץ לתחום')) * 100.0 / count(*), 1) AS in_city_pct,
  count(*) FILTER (weekday = collection_day) AS same_day,
  round(count(*) FILTER (weekday = collection_day) * 100.0 / count(*), 1) AS same_day_pct FROM zoned"""))
def _(t):
    return Z.enrichment_stats(_enriched(t))


@query("zone_counts", with_ctes(_ZONED, "SELECT zone, count(*) AS rows FROM zoned GROUP BY zone"))
def _(t):
    from tidyward.operators.report import distribution
    return distribution(_enriched(t), "zone")


# -- repair -------------------------------------------------------------------

_GRID = """SELECT CAST(l_suppkey AS STRING) || '.5,' AS lat, CAST(l_linenumber AS STRING) || '.25' AS lon,
  CASE WHEN l_partkey % 6 = 0 THEN '0' WHEN l_partkey % 6 = 1 THEN NULL
    ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS house,
  CASE l_orderkey % 3 WHEN 0 THEN 'טווח בתים' ELSE 'כתובת' END AS loc_type FROM {lineitem}"""
_HOUSE_OK = "house IS NOT NULL AND house NOT IN ('', '0') AND loc_type NOT IN ('טווח בתים', 'ציון דרך')"


@query("collapsed_points", f"""SELECT {num('lat')} AS lat, {num('lon')} AS lon, count(*) AS rows,
  count(DISTINCT CASE WHEN {_HOUSE_OK} THEN house END) AS houses FROM ({plain(_GRID)})
  GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT CASE WHEN {_HOUSE_OK} THEN house END) >= 4""")
def _(t):
    return RP.collapsed_points(RP.coerce_coordinates(t.sql(_GRID)))


_REPAIRED = [SPOT, f"""r1 AS (SELECT * REPLACE ({num('lat')} AS lat, {num('lon')} AS lon), geocode_method AS old
    FROM spots)""", """
  r2 AS (SELECT * REPLACE (CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND geocode_method IN
    ('unresolved', 'flagged_description', 'no_street') THEN 'manual_backfilled' ELSE geocode_method END
    AS geocode_method) FROM r1)""", f"""
  cp AS (SELECT lat AS cla, lon AS clo FROM r2 WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL
    HAVING count(*) >= 5 AND count(DISTINCT CASE WHEN {_HOUSE_OK} AND trim(house) NOT IN ('', '0')
      THEN trim(house) END) >= 4)""", f"""
  rep AS (SELECT r2.* REPLACE (CASE WHEN lat IS NULL OR lon IS NULL THEN 'none'
      WHEN geocode_method IN ('nominatim_original', 'nominatim', 'nominatim_cached') THEN
        CASE WHEN cla IS NOT NULL THEN 'street' ELSE 'address_unverified' END
      ELSE {mapped('geocode_method', R.METHOD_TIER, lit('none'))} END AS precision)
    FROM r2 LEFT JOIN cp ON cla = lat AND clo = lon)"""]


@query("relabel_methods", with_ctes(_REPAIRED, "SELECT ticket, old, geocode_method FROM rep"))
def _(t):
    rows = RP.coerce_coordinates(t.sql(SPOTS)).withColumn("old", F.col("geocode_method"))
    return RP.relabel_methods(rows).select("ticket", "old", "geocode_method")


@query("precision_backfill", with_ctes(_REPAIRED, """SELECT ticket, lat, lon, geocode_method, precision
  FROM rep"""))
def _(t):
    rows = RP.relabel_methods(RP.coerce_coordinates(t.sql(SPOTS)))
    return RP.backfill_precision(rows, RP.collapsed_points(rows)).select(
        "ticket", "lat", "lon", "geocode_method", "precision")


_SITES = """SELECT s_suppkey AS ref_id, 32.14 + CAST(s_suppkey % 60 AS DOUBLE) / 1000 AS lat,
  34.78 + CAST(s_suppkey * 7 % 90 AS DOUBLE) / 1000 AS lon,
  CASE s_nationkey % 6 """ + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(_ZONE_NAMES[:6])) + \
    " END AS zone FROM {supplier}"


@query("repair_file", with_ctes(_REPAIRED + [f"sites AS ({plain(_SITES)})", """
  zn AS (SELECT p.lat AS zla, p.lon AS zlo, min({'d2': (p.lat - r.lat) * (p.lat - r.lat) +
      (p.lon - r.lon) * (p.lon - r.lon), 'id': r.ref_id, 'zone': r.zone}) AS b
    FROM (SELECT DISTINCT lat, lon FROM rep WHERE lat IS NOT NULL AND lon IS NOT NULL) p, sites r
    GROUP BY ALL)"""], f"""SELECT ticket, geocode_method, precision, coalesce(b.zone, 'לא ידוע') AS zone,
  {mapped("b.zone", R.ZONE_DAYS)} AS collection_day,
  CAST(weekday = {mapped("b.zone", R.ZONE_DAYS)} AS INT) AS same_day
  FROM rep LEFT JOIN zn ON zla = lat AND zlo = lon"""))
def _(t):
    return RP.repair(t.sql(SPOTS).drop("zone", "same_day"), t.sql(_SITES)).select(
        "ticket", "geocode_method", "precision", "zone", "collection_day", "same_day")
