"""Cleaning, classification, answers and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.functions.address import address_route, parse_address
from tidyward.operators import answers as A
from tidyward.operators import flags as FL
from tidyward.operators.clean import (
    classify, clean, cleaning_stats, split_timestamp,
)
from tidyward.operators.ordered import recurrence
from tidyward.operators.patterns import (
    pattern_groups, responsibility_clusters, term_counts, unknown_subtopics,
)
from tidyward.operators.report import hotspots
from tidyward.operators.resolve import auto_fix, resolve_from_context
from tidyward.plans.inputs import COMPLAINTS, SPOTS
from tidyward.plans.catalog.registry import (
    CLASSIFIED, CLEANED, KEYWORD, PARSED, RAW, ROUTE, SPOT, WEEKDAY, any_word, blank,
    confidence_sql, decode, junk, lit, lits, mapped, num, parse_ctes, query, resp_source_sql,
    resp_sql, txt, with_ctes, ws,
)
from tidyward.sources.readers import check_columns

# -- recurrence ---------------------------------------------------------------

_ORDER_KEYS = ["o_custkey", "o_orderpriority"]
_RECUR = """recur AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (
  PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS recurrence_no
  FROM orders)"""


def _recurring_orders(t):
    return recurrence(t.orders, _ORDER_KEYS, ["o_orderdate", "o_orderkey"])


@query("recurrence", with_ctes([_RECUR], """SELECT o_orderkey, o_custkey, o_orderpriority,
  recurrence_no, CAST(recurrence_no > 1 AS INT) AS is_recurring FROM recur"""))
def _(t):
    return _recurring_orders(t).select("o_orderkey", "o_custkey", "o_orderpriority",
                                       "recurrence_no", "is_recurring")


@query("hotspots", with_ctes([_RECUR], """SELECT o_custkey, o_orderpriority, count(*) AS repeats
  FROM recur WHERE recurrence_no > 1 GROUP BY ALL
  ORDER BY repeats DESC, o_custkey, o_orderpriority LIMIT 10"""))
def _(t):
    return hotspots(_recurring_orders(t), _ORDER_KEYS)


# -- scalar functions ---------------------------------------------------------


@query("timestamp_split", f"""SELECT event_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour,
  {WEEKDAY.format('ts')} AS weekday, CAST(month(ts) AS INT) AS month FROM events""")
def _(t):
    return split_timestamp(t.events, "ts").select("event_id", "date", "hour", "weekday", "month")


@query("entity_decode", f"""SELECT page_id, length({decode('html')}) AS chars,
  md5({decode('html')}) AS digest FROM pages""")
def _(t):
    decoded = t.pages.select("page_id", T.decode_entities("html").alias("d"))
    return decoded.select("page_id", F.length("d").cast("bigint").alias("chars"),
                          F.md5("d").alias("digest"))


@query("ticket_parse", with_ctes([RAW], rf"""SELECT ticket AS source,
  coalesce(nullif(regexp_extract({ws('ticket')}, '^(\d+)', 1), ''), {ws('ticket')}) AS ticket,
  nullif(regexp_extract({ws('ticket')}, '-\s*([א-ת])\s*$', 1), '') AS ticket_suffix,
  regexp_replace(regexp_replace({ws('ticket')}, '\.0$', ''), '\s+', '', 'g') AS tidy FROM raw"""))
def _(t):
    return t.sql(COMPLAINTS).select(
        F.col("ticket").alias("source"), T.ticket_id("ticket").alias("ticket"),
        T.ticket_suffix("ticket").alias("ticket_suffix"), T.tidy_ticket("ticket").alias("tidy"))


@query("address_parse", with_ctes(PARSED, f"""SELECT raw_address, address_text, street, cross_street,
  house, loc_type, loc_note, addr_note, {ROUTE} AS addr_route FROM parsed"""))
def _(t):
    parsed = parse_address(t.sql(COMPLAINTS), "raw_address")
    return parsed.select(
        "raw_address", "address_text", "street", "cross_street", "house", "loc_type", "loc_note",
        "addr_note", address_route(F.col("loc_type"), F.col("house"), F.col("address_text"))
        .alias("addr_route"))


@query("signals", with_ctes([RAW], rf"""SELECT 'complaint' AS kind, ticket AS id,
    CAST({any_word('description', R.CALLBACK_PHRASES)} AS INT) AS wants_callback,
    CAST(regexp_matches(coalesce(description, ''), '05\d[-\s]?\d{{6,7}}') AS INT) AS has_phone FROM raw
  UNION ALL SELECT 'document', CAST(doc_id AS STRING),
    CAST({any_word('text', R.CALLBACK_PHRASES)} AS INT),
    CAST(regexp_matches(coalesce(text, ''), '05\d[-\s]?\d{{6,7}}') AS INT) FROM documents"""))
def _(t):
    both = t.sql(COMPLAINTS).select(F.lit("complaint").alias("kind"), F.col("ticket").alias("id"),
                                    "description").union(
        t.documents.select(F.lit("document"), F.col("doc_id").cast("string"), "text"))
    return both.select("kind", "id", T.wants_callback("description").alias("wants_callback"),
                       T.has_phone("description").alias("has_phone"))


@query("coordinate_coercion", with_ctes([SPOT], f"""SELECT ticket, {num('lat')} AS lat,
  {num('lon')} AS lon FROM spots"""))
def _(t):
    return t.sql(SPOTS).select("ticket", T.to_number("lat").alias("lat"),
                               T.to_number("lon").alias("lon"))


@query("blank_and_junk", with_ctes([SPOT], f"""SELECT ticket, {blank('street')} AS street_blank,
  {junk('street')} AS street_junk, {blank('house')} AS house_blank, {junk('house')} AS house_junk
  FROM spots"""))
def _(t):
    return t.sql(SPOTS).select(
        "ticket", T.is_blank("street").alias("street_blank"), T.is_junk("street").alias("street_junk"),
        T.is_blank("house").alias("house_blank"), T.is_junk("house").alias("house_junk"))


_UNITS = ["'/2'", "' דירה 3'", "' קומה 2'", "' כניסה ב'", "'א'"]
_HOUSES = """SELECT p_partkey, CAST(p_size AS STRING) || CASE p_partkey % 6 """ + " ".join(
    f"WHEN {i} THEN {u}" for i, u in enumerate(_UNITS)) + " ELSE '' END AS house FROM {part}"


@query("house_numbers", rf"""WITH houses AS ({_HOUSES.replace('{part}', 'part')})
  SELECT p_partkey, nullif(regexp_extract(house, '^(\d+)', 1), '') AS number,
    {ws(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(house, '\s*[/\\]\s*\d+$', ''), '\s*דירה\s*\d*', '', 'g'), '\s*קומה\s*\d*', '', 'g'), '\s*כניסה\s*[א-ת\w]*', '', 'g')")}
    AS stripped FROM houses""")
def _(t):
    return t.sql(_HOUSES).select("p_partkey", T.leading_number("house").alias("number"),
                                 T.strip_unit("house").alias("stripped"))


_STREETS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'רחוב ' ELSE '' END ||
  CASE p_partkey % 3 WHEN 0 THEN 'שדה ' ELSE 'נחל ' END || p_name || CASE p_partkey % 5
    WHEN 0 THEN ' ' || CAST(p_size AS STRING) WHEN 1 THEN ', ' WHEN 2 THEN ' ' || CAST(p_size AS STRING) || 'א'
    WHEN 3 THEN ' 4/2 ;' ELSE '' END AS street FROM {part}"""
_TAIL = r"[\s,./\-]+\d{1,4}\s*[א-ת]?(?:\s*/\s*\d+)?\s*$"
_MARKS = r"""[\s,.;׳״''"־\-]+$"""


def _bare(x: str) -> str:
    for _ in range(3):
        x = f"{ws(f'''regexp_replace({x}, '{_TAIL}', '')''')}"
        x = f"{ws(f'''regexp_replace({x}, '{_MARKS}', '')''')}"
    return x


@query("street_names_tidy", rf"""WITH streets AS ({_STREETS.replace('{part}', 'part')})
  SELECT p_partkey, regexp_replace({ws('street')}, '[.,;:]+$', '') AS tidy,
    {_bare(rf"regexp_replace({ws('street')}, '^רחוב\s+', '')")} AS bare FROM streets""")
def _(t):
    return t.sql(_STREETS).select("p_partkey", T.tidy_street("street").alias("tidy"),
                                  T.bare_street("street").alias("bare"))


@query("legacy_labels", with_ctes([SPOT], f"""SELECT ticket, {mapped('responsibility',
  R.LEGACY_RESPONSIBILITY, 'responsibility')} AS responsibility FROM spots"""))
def _(t):
    return t.sql(SPOTS).select("ticket", T.current_responsibility("responsibility")
                               .alias("responsibility"))


_LATIN = "a-zA-Z"
_DOC_STOP = ["the", "and", "of"]


@query("tokens_ngrams", rf"""WITH w AS (SELECT doc_id, list_filter(
    regexp_extract_all(text, '[{_LATIN}]{{2,}}'), lambda x: x NOT IN ({lits(_DOC_STOP)})) AS words
    FROM documents)
  SELECT doc_id, CAST(len(words) AS BIGINT) AS words, md5(array_to_string(words, ' ')) AS digest,
    md5(array_to_string(list_transform(range(1, len(words)),
      lambda i: words[i] || ' ' || words[i + 1]), '|')) AS bigrams FROM w""")
def _(t):
    w = t.documents.select("doc_id", T.tokens("text", _LATIN, _DOC_STOP).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("words"),
                    F.md5(F.array_join("w", " ")).alias("digest"),
                    F.md5(F.array_join(T.ngrams("w"), "|")).alias("bigrams"))


# -- classification -----------------------------------------------------------


@query("category_map", with_ctes(CLASSIFIED, """SELECT ticket, sub AS subtopic, category,
  category_source, substance, asset FROM classified"""))
def _(t):
    return classify(t.sql(COMPLAINTS)).select(
        "ticket", "subtopic", "category", "category_source", "substance", "asset")


_EVENT_RULES = R.Rules(
    subtopics=(("view", "traffic", "page", "web"), ("click", "traffic", "link", "web"),
               ("purchase", "sale", "cart", "shop"), ("error", "fault", "page", "server")),
    topics={"": "none"}, responsibility={"traffic": "growth", "sale": "sales",
                                         "fault": R.UNKNOWN_RESP},
    keywords={"low": ['"k": 1', '"k": 2'], "mid": ['"k": 5', '"k": 3']})


@query("category_map_events", f"""SELECT event_id, event_type AS subtopic,
  {mapped('event_type', {s: c for s, c, _, _ in _EVENT_RULES.subtopics}, 'event_type')} AS category,
  CASE WHEN event_type IN ('view', 'click', 'purchase', 'error') THEN 'map' ELSE 'passthrough' END
    AS category_source,
  {mapped('event_type', {s: b for s, _, b, _ in _EVENT_RULES.subtopics}, lit('לא ידוע'))} AS substance,
  CASE WHEN event_type IN ('view', 'click') THEN 'growth' WHEN event_type = 'purchase' THEN 'sales'
    WHEN contains(props, '"k": 1') OR contains(props, '"k": 2') THEN 'low'
    WHEN contains(props, '"k": 5') OR contains(props, '"k": 3') THEN 'mid' ELSE 'א.מ.ל' END
    AS responsibility FROM events""")
def _(t):
    return classify(t.events.withColumn("topic", F.lit("")), _EVENT_RULES, "event_type", "topic",
                    "props").select("event_id", "subtopic", "category", "category_source",
                                    "substance", "responsibility")


@query("keyword_responsibility", with_ctes(CLASSIFIED, """SELECT ticket, category, responsibility,
  resp_source FROM classified"""))
def _(t):
    return classify(t.sql(COMPLAINTS)).select("ticket", "category", "responsibility", "resp_source")


@query("confidence", with_ctes(CLEANED, """SELECT ticket, confidence, confidence_details FROM cleaned"""))
def _(t):
    return clean(t.sql(COMPLAINTS)).select("ticket", "confidence", "confidence_details")


@query("clean_table", with_ctes(CLEANED, "SELECT * FROM cleaned"))
def clean_table(t):
    return clean(t.sql(COMPLAINTS))


@query("cleaning_stats", with_ctes(CLEANED, """SELECT count(*) AS rows,
  round(avg(is_recurring) * 100, 1) AS recurring_rate,
  round(avg(CAST(responsibility = 'א.מ.ל' AS INT)) * 100, 1) AS unknown_resp_rate,
  count(*) FILTER (confidence = 'high') AS conf_high,
  count(*) FILTER (confidence = 'medium') AS conf_medium,
  count(*) FILTER (confidence = 'low') AS conf_low FROM cleaned"""))
def _(t):
    return cleaning_stats(clean(t.sql(COMPLAINTS)))


_BEACH = "(" + " OR ".join(f"starts_with({txt('raw_address')}, {lit(p)})"
                           for p in R.BEACH_PREFIXES) + ")"
_NOTES = ("coalesce(description, '') || ' ' || coalesce(addr_note, '') || ' ' || "
          "coalesce(loc_note, '')")
_CONTEXT = f"""CASE WHEN contains(status, 'טופל') AND category IN ({lits(R.HANDLED_CATEGORIES)})
  THEN 'עירייה' WHEN {_BEACH} AND {any_word(_NOTES, R.NATURE_WORDS)} THEN 'טבעי'
  WHEN {_BEACH} AND {any_word(_NOTES, R.CITIZEN_WORDS)} THEN 'התנהגות אזרח' END"""
_RESOLVED = CLEANED + [
    f"""ctx AS (SELECT *, CASE WHEN resp_source = 'unresolved' THEN {_CONTEXT} END AS ctx_resp
        FROM cleaned)""",
    f"""resolved AS (SELECT ctx.* REPLACE (
        coalesce(ctx_resp, responsibility) AS responsibility,
        CASE WHEN ctx_resp IS NOT NULL THEN 'context_resolve' ELSE resp_source END AS resp_source,
        CASE WHEN ctx_resp IS NOT NULL THEN {confidence_sql('1')} ELSE confidence END AS confidence)
        FROM ctx)""",
]


@query("context_resolution", with_ctes(_RESOLVED, """SELECT ticket, category, responsibility,
  resp_source, confidence FROM resolved"""))
def _(t):
    return resolve_from_context(clean(t.sql(COMPLAINTS))).select(
        "ticket", "category", "responsibility", "resp_source", "confidence")


_KNOWN_BAD = "SELECT p_name || ' ' || CAST(p_size * 2 AS STRING) AS name FROM {part}"
_IS_KNOWN = f"{txt('raw_address')} IN ({_KNOWN_BAD.replace('{part}', 'part')})"
_PREFIXED = "(" + " OR ".join(f"starts_with({txt('raw_address')}, {lit(p)})"
                              for p in R.DESCRIPTIVE_PREFIXES) + ")"
_EMPTY = "coalesce(street0, '') = ''"
_HOLLOW = rf"""({_EMPTY} OR regexp_matches(street0, '^[\d\s.,\-_!?()״׳''"]+$'))"""
_FIXED = CLEANED + [
    rf"""x0 AS (SELECT ticket, raw_address, house, loc_type,
        regexp_replace({txt('street')}, '[.,;:]+$', '') AS street0 FROM cleaned)""",
    f"""x1 AS (SELECT *, {_EMPTY} AS is_empty, {_HOLLOW} AS hollow, {_IS_KNOWN} AS known,
        NOT {_IS_KNOWN} AND {_HOLLOW} AND {_PREFIXED} AS place FROM x0)""",
    rf"""x2 AS (SELECT *,
        CASE WHEN hollow AND regexp_matches({txt('raw_address')}, '^\d+\([^)]+\)')
          THEN regexp_extract({txt('raw_address')}, '^\d+\(([^)]+)\)', 1) END AS first_in,
        CASE WHEN hollow AND regexp_matches({txt('raw_address')}, '^\([^)]+\)$')
          THEN regexp_extract({txt('raw_address')}, '^\(([^)]+)\)$', 1) END AS only_in,
        CASE WHEN is_empty AND NOT known AND NOT place AND length({txt('raw_address')}) > 2
          THEN raw_address END AS again FROM x1)""",
] + parse_ctes("x2", "x3", "coalesce(first_in, only_in)", "in_") \
  + parse_ctes("x3", "x4", "again", "re_") + [
    """x5 AS (SELECT *, (first_in IS NOT NULL OR only_in IS NOT NULL)
          AND coalesce(in_street, '') <> '' AS inside,
        again IS NOT NULL AND coalesce(re_street, '') <> '' AND NOT
          regexp_matches(coalesce(re_street, ''), '^[0-9 .,_!?()-]+$') AS usable FROM x4)""",
]


@query("auto_fix", with_ctes(_FIXED, """SELECT ticket, CASE WHEN usable THEN re_street
    WHEN inside THEN in_street WHEN (known OR place) AND hollow THEN '' ELSE street0 END AS street,
  CASE WHEN usable THEN coalesce(re_house, house) ELSE house END AS house,
  CASE WHEN usable THEN re_loc_type WHEN inside THEN in_loc_type
    WHEN only_in IS NOT NULL THEN 'ציון דרך' WHEN known OR place THEN 'ציון דרך'
    ELSE loc_type END AS loc_type FROM x5"""))
def _(t):
    return auto_fix(clean(t.sql(COMPLAINTS)), t.sql(_KNOWN_BAD)).select(
        "ticket", "street", "house", "loc_type")


# -- answers ------------------------------------------------------------------

# One answer per part row, of a kind and target that depend on the part.
_CATS = ["כלי אצירה פגומים", "משטח מלוכלך", "פח נעלם"]
_ANSWERS = f"""SELECT CAST(p_partkey AS INT) AS seq,
  CASE p_partkey % 7 WHEN 0 THEN 'street' WHEN 1 THEN 'subtopic' WHEN 2 THEN 'resp_term'
    WHEN 3 THEN 'resp_default' WHEN 4 THEN 'resp_sub' WHEN 5 THEN 'resp_unmatched' ELSE 'resp' END AS kind,
  CASE p_partkey % 3 WHEN 0 THEN '{_CATS[0]}' WHEN 1 THEN '{_CATS[1]}' ELSE '{_CATS[2]}' END AS category,
  CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN 'בדיקת מים'
    WHEN 4 THEN CASE p_size % 2 WHEN 0 THEN 'טבעי' ELSE 'עירייה' END
    ELSE CASE p_size % 3 WHEN 0 THEN 'ריח רע' WHEN 1 THEN 'כתמים' ELSE 'המכסה' END END AS term,
  CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_size % 4 = 0 THEN '__skip__' ELSE p_name || ' st' END
    WHEN p_partkey % 7 = 1 THEN CASE p_size % 2 WHEN 0 THEN 'פח נעלם' ELSE 'פגר' END
    WHEN p_size % 5 = 0 THEN ' '
    ELSE CASE p_size % 4 WHEN 0 THEN 'עירייה' WHEN 1 THEN 'טבעי' WHEN 2 THEN 'התנהגות אזרח'
         ELSE 'בקשה מהעירייה' END END AS answer
FROM {{part}}"""


def _last(kind: str, key: str) -> str:
    return f"(SELECT {key} AS k, arg_max(answer, seq) AS a FROM given WHERE kind = '{kind}' GROUP BY {key})"


_LABEL_HIT = " OR ".join(f"(g.term = {lit(label)} AND {any_word('description', words)})"
                         for label, words in R.RESP_KEYWORDS.items())
_ANSWERED = CLEANED + [
    f"""given AS (SELECT * FROM ({_ANSWERS.replace('{part}', 'part')})
        WHERE trim(answer) NOT IN ('__skip__', '', 'nan'))""",
    f"""a1 AS (SELECT cleaned.* REPLACE (coalesce(s.a, street) AS street,
          coalesce(b.a, category) AS category,
          CASE WHEN b.a IS NOT NULL THEN 'user_map' ELSE category_source END AS category_source),
        b.a AS sub_answer FROM cleaned LEFT JOIN {_last('street', 'term')} s ON s.k = street
        LEFT JOIN {_last('subtopic', 'term')} b ON b.k = subtopic)""",
    f"""a2 AS (SELECT * REPLACE (
          CASE WHEN sub_answer IS NOT NULL THEN {resp_sql()} ELSE responsibility END AS responsibility,
          CASE WHEN sub_answer IS NOT NULL THEN {resp_source_sql()} ELSE resp_source END AS resp_source)
        FROM a1)""",
    """a3 AS (SELECT a2.*, (SELECT arg_min(g.answer, g.seq) FROM given g WHERE g.kind = 'resp_term'
          AND g.category = a2.category AND contains(coalesce(description, ''), g.term)) AS by_term FROM a2)""",
    f"""a4 AS (SELECT a3.* REPLACE (
          CASE WHEN resp_source = 'unresolved' THEN coalesce(by_term, d.a, responsibility)
               ELSE responsibility END AS responsibility,
          CASE WHEN resp_source = 'unresolved' THEN CASE WHEN by_term IS NOT NULL THEN 'user_resp_term'
               WHEN d.a IS NOT NULL THEN 'user_resp_default' ELSE resp_source END
               ELSE resp_source END AS resp_source)
        FROM a3 LEFT JOIN {_last('resp_default', 'category')} d ON d.k = category)""",
    f"""a5 AS (SELECT a4.*, (SELECT arg_max(g.answer, g.seq) FROM given g WHERE g.kind = 'resp_sub'
          AND g.category = a4.category AND ({_LABEL_HIT})) AS by_label,
          CASE WHEN {KEYWORD} IS NULL THEN u.a END AS by_rest, r.a AS by_cat
        FROM a4 LEFT JOIN {_last('resp_unmatched', 'category')} u ON u.k = category
        LEFT JOIN {_last('resp', 'category')} r ON r.k = category)""",
    """a6 AS (SELECT * REPLACE (coalesce(by_rest, by_label, responsibility) AS responsibility,
          CASE WHEN by_rest IS NOT NULL THEN 'user_resp_unmatched'
               WHEN by_label IS NOT NULL THEN 'user_resp_kw' ELSE resp_source END AS resp_source) FROM a5)""",
    """a7 AS (SELECT * REPLACE (
          CASE WHEN responsibility = 'א.מ.ל' THEN coalesce(by_cat, responsibility)
               ELSE responsibility END AS responsibility,
          CASE WHEN responsibility = 'א.מ.ל' AND by_cat IS NOT NULL THEN 'user_resp'
               ELSE resp_source END AS resp_source) FROM a6)""",
]


@query("apply_answers", with_ctes(_ANSWERED, f"""SELECT ticket, street, category, category_source,
  responsibility, resp_source, {confidence_sql()} AS confidence FROM a7"""))
def _(t):
    return A.apply_answers(clean(t.sql(COMPLAINTS)), t.sql(_ANSWERS)).select(
        "ticket", "street", "category", "category_source", "responsibility", "resp_source",
        "confidence")


# A term per line item, most of them in one category: pieces of the orders' numbers, short and long.
_MANY_TERMS = f"""SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq,
  CASE WHEN l_linenumber = 7 THEN '{_CATS[1]}' ELSE '{_CATS[0]}' END AS category,
  CASE WHEN l_partkey % 1000 = 0 THEN CAST(l_linenumber AS STRING) || CAST(l_suppkey % 10 AS STRING)
       ELSE CAST(l_suppkey AS STRING) || '-' || CAST(l_orderkey * 7919 % 1000003 AS STRING) END AS term,
  'a' || CAST(l_partkey AS STRING) AS answer
FROM {{lineitem}}"""
_NUMBERED = f"""SELECT CAST(o_orderkey AS BIGINT) AS ticket,
  CASE WHEN o_orderkey % 13 = 0 THEN '{_CATS[1]}' WHEN o_orderkey % 101 = 0 THEN NULL ELSE '{_CATS[0]}' END AS category,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN '' ELSE CAST(o_custkey AS STRING) || '-'
    || CAST(o_orderkey * 7919 % 1000003 AS STRING) || ' ' || o_orderpriority END AS description
FROM {{orders}}"""


@query("many_terms", f"""SELECT DISTINCT o.category, o.description,
  struct_extract(min({{'seq': t.seq, 'term': t.term, 'answer': t.answer}}) OVER (
    PARTITION BY o.category, o.description), 'answer') AS answer
  FROM ({_NUMBERED.replace('{orders}', 'orders')}) o JOIN ({_MANY_TERMS.replace('{lineitem}', 'lineitem')}) t
  ON t.category = o.category AND contains(o.description, t.term)""")
def _(t):
    """Answers by term where a category has one for every line item."""
    return A.term_hits(t.sql(_NUMBERED), t.sql(_MANY_TERMS))


# One override per line item, on the order's ticket.
_OVERRIDES = """SELECT CAST(l_orderkey AS STRING) AS ticket, l_partkey * 100 + l_suppkey AS seq,
  CASE l_linenumber WHEN 1 THEN 'category' WHEN 2 THEN 'responsibility' WHEN 3 THEN 'street'
    WHEN 4 THEN 'house' WHEN 5 THEN 'review' ELSE 'other' END AS field,
  CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE 'v' || CAST(l_partkey * 100 + l_suppkey AS STRING) END AS value
FROM {lineitem}"""
_OV = _OVERRIDES.replace("{lineitem}", "lineitem")


@query("apply_overrides", with_ctes(CLEANED + [f"ov AS ({_OV})", """
  lastov AS (SELECT ticket AS tk,
    arg_max(value, seq) FILTER (field = 'category' AND value <> '') AS c,
    arg_max(value, seq) FILTER (field = 'responsibility' AND value <> '') AS r,
    arg_max(value, seq) FILTER (field = 'street' AND value <> '') AS s,
    arg_max(value, seq) FILTER (field = 'house' AND value <> '') AS h,
    bool_or(field = 'review') AS rv FROM ov GROUP BY ticket)"""], """
  SELECT ticket, coalesce(c, category) AS category, coalesce(r, responsibility) AS responsibility,
    coalesce(s, street) AS street, coalesce(h, house) AS house,
    CASE WHEN c IS NOT NULL THEN 'user_override' ELSE category_source END AS category_source,
    CASE WHEN rv THEN 'manual_review' WHEN r IS NOT NULL THEN 'user_override' ELSE resp_source END AS resp_source,
    CASE WHEN rv THEN 'low' ELSE confidence END AS confidence
  FROM cleaned LEFT JOIN lastov ON tk = ticket"""))
def _(t):
    return A.apply_overrides(clean(t.sql(COMPLAINTS)), t.sql(_OVERRIDES)).select(
        "ticket", "category", "responsibility", "street", "house", "category_source",
        "resp_source", "confidence")


_LINES = """SELECT o_orderkey AS line_no,
  CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS STRING) || ', 32.1' || CAST(o_custkey AS STRING) || ',34.8'
    WHEN 1 THEN CAST(o_custkey AS STRING) || ',x,34.8' WHEN 2 THEN CAST(o_custkey AS STRING) || ',32.1'
    WHEN 3 THEN ' ' || CAST(o_custkey AS STRING) || ' ,32.2, 34.' || CAST(o_orderkey AS STRING) || ' '
    ELSE '' END AS line FROM {orders}"""


@query("upsert_coordinates", with_ctes([SPOT, f"lines AS ({_LINES.replace('{orders}', 'orders')})", f"""
  pts AS (SELECT line_no, trim(split_part(line, ',', 1)) AS tk,
    TRY_CAST(trim(split_part(line, ',', 2)) AS DOUBLE) AS la,
    TRY_CAST(trim(split_part(line, ',', 3)) AS DOUBLE) AS lo FROM lines
    WHERE len(string_split(line, ',')) = 3)""", """
  best AS (SELECT tk, arg_max(la, line_no) AS la, arg_max(lo, line_no) AS lo FROM pts
    WHERE la IS NOT NULL AND lo IS NOT NULL GROUP BY tk)"""], f"""
  SELECT ticket, coalesce(la, {num('lat')}) AS lat, coalesce(lo, {num('lon')}) AS lon,
    CASE WHEN la IS NOT NULL THEN 'manual' ELSE geocode_method END AS geocode_method,
    CASE WHEN la IS NOT NULL THEN 'address' ELSE precision END AS precision
  FROM spots LEFT JOIN best ON tk = ticket"""))
def _(t):
    spots = t.sql(SPOTS).withColumns({"lat": T.to_number("lat"), "lon": T.to_number("lon")})
    return A.upsert_coordinates(spots, A.parse_coordinate_lines(t.sql(_LINES))).select(
        "ticket", "lat", "lon", "geocode_method", "precision")


_EDITS = """SELECT CAST(c_custkey AS STRING) AS ticket,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '32.15,' END AS lat,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '34.83' END AS lon,
  c_mktsegment AS street, CAST(c_nationkey AS STRING) || ' דירה 4' AS house FROM {customer}"""


@query("manual_edits", with_ctes([SPOT, f"edits AS ({_EDITS.replace('{customer}', 'customer')})"], f"""
  SELECT s.ticket, CASE WHEN e.ticket IS NULL THEN {num('s.lat')} ELSE {num('e.lat')} END AS lat,
    CASE WHEN e.ticket IS NULL THEN {num('s.lon')} ELSE {num('e.lon')} END AS lon,
    CASE WHEN e.ticket IS NULL THEN s.street ELSE e.street END AS street,
    CASE WHEN e.ticket IS NULL THEN s.house ELSE replace(e.house, ' דירה 4', '') END AS house,
    CASE WHEN {num('e.lat')} IS NOT NULL AND {num('e.lon')} IS NOT NULL THEN 'manual'
         ELSE geocode_method END AS geocode_method,
    CASE WHEN {num('e.lat')} IS NOT NULL AND {num('e.lon')} IS NOT NULL THEN 'address'
         ELSE precision END AS precision
  FROM spots s LEFT JOIN edits e ON e.ticket = s.ticket"""))
def _(t):
    spots = t.sql(SPOTS).withColumns({"lat": T.to_number("lat"), "lon": T.to_number("lon")})
    return A.apply_manual_edits(spots, t.sql(_EDITS)).select(
        "ticket", "lat", "lon", "street", "house", "geocode_method", "precision")


# Several edits per ticket and blank tickets: the edit of the largest number counts.
_REPEATED_EDITS = """SELECT (l_partkey * 1000000 + l_suppkey) * 10 + l_linenumber AS seq,
  CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE CAST(l_orderkey AS STRING) END AS ticket,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE '32.15' END AS lat, '34.83' AS lon,
  CAST(l_partkey AS STRING) AS street, CAST(l_linenumber AS STRING) AS house FROM {lineitem}"""


@query("manual_edits_repeated", with_ctes([SPOT, f"edits AS ({_REPEATED_EDITS.replace('{lineitem}', 'lineitem')})", """
  last AS (SELECT ticket, max(seq) AS seq, arg_max({'lat': lat, 'street': street, 'house': house}, seq) AS e
    FROM edits WHERE ticket <> '' GROUP BY ticket)"""], f"""
  SELECT s.ticket, CASE WHEN l.ticket IS NULL THEN {num('s.lat')} ELSE {num('l.e.lat')} END AS lat,
    CASE WHEN l.ticket IS NULL THEN s.street ELSE l.e.street END AS street,
    CASE WHEN l.ticket IS NULL THEN s.house ELSE l.e.house END AS house,
    CASE WHEN l.e.lat IS NOT NULL THEN 'manual' ELSE geocode_method END AS geocode_method
  FROM spots s LEFT JOIN last l ON l.ticket = s.ticket"""))
def _(t):
    spots = t.sql(SPOTS).withColumns({"lat": T.to_number("lat"), "lon": T.to_number("lon")})
    return A.apply_manual_edits(spots, t.sql(_REPEATED_EDITS)).select(
        "ticket", "lat", "street", "house", "geocode_method")


# -- flags --------------------------------------------------------------------

_FLAG_ROWS = f"SELECT s.*, CASE WHEN CAST(ticket AS BIGINT) % 101 = 0 THEN ' nan' ELSE ticket END AS id FROM ({SPOTS}) s"
_D = ("1996-01-01", "2000-12-31")
_HAS = f"({num('lat')} IS NOT NULL AND {num('lon')} IS NOT NULL)"
_IN = f"coalesce({num('lat')} BETWEEN 32.14 AND 32.20 AND {num('lon')} BETWEEN 34.78 AND 34.87, false)"
_CHECKS = [
    ("no_date", "no_date", blank("date"), "true"),
    ("no_id", "no_id", blank("ticket"), "true"),
    ("date_early", "date_early", f"TRY_CAST(date AS DATE) < DATE '{_D[0]}'", "false"),
    ("date_late", "date_late", f"TRY_CAST(date AS DATE) > DATE '{_D[1]}'", "false"),
    ("addr_empty", "addr_none", f"{blank('street')} AND loc_type = 'ללא רחוב'", "true"),
    ("addr_desc", "addr_desc", f"{blank('street')} AND loc_type = 'ציון דרך'", "false"),
    ("addr_empty", "addr_empty", f"{blank('street')} AND loc_type NOT IN ('ללא רחוב', 'ציון דרך')",
     f"NOT {_HAS}"),
    ("addr_junk", "addr_junk", junk("street"), f"NOT {_HAS}"),
    ("no_house", "no_house", f"loc_type = 'כתובת' AND {blank('house')}", "false"),
    ("cat_unknown", "cat_unknown", f"{txt('category')} <> '' AND {txt('category')} NOT IN "
     f"({lits(R.RESPONSIBILITY)})", "false"),
    ("no_status", "no_status", blank("status"), "false"),
    ("geo_fail", "geo_fail", f"NOT {_HAS} AND loc_type NOT IN ('ללא רחוב', 'ציון דרך') AND "
     f"{txt('geocode_method')} <> 'flagged_description'", "true"),
    ("geo_outside", "geo_outside", f"{_HAS} AND NOT {_IN}", "false"),
    ("geo_sea", "geo_sea", f"{_HAS} AND {_IN} AND {num('lon')} < 34.79", "false"),
]
_FLAGGED = [
    SPOT,
    """fr AS (SELECT * REPLACE (CASE WHEN CAST(ticket AS BIGINT) % 101 = 0 THEN ' nan'
       ELSE ticket END AS ticket) FROM spots)""",
    "fx AS (SELECT *, " + ", ".join(
        f"coalesce({c}, false) AS f{i}, ({b}) AS b{i}" for i, (_, _, c, b) in enumerate(_CHECKS))
    + " FROM fr)",
    "flagged AS (SELECT *, concat_ws(',', " + ", ".join(
        f"CASE WHEN f{i} THEN '{c}' END" for i, (c, _, _, _) in enumerate(_CHECKS))
    + ") AS flag_codes, concat_ws('; ', " + ", ".join(
        f"CASE WHEN f{i} THEN {lit(R.FLAG_LABELS[k])} END" for i, (_, k, _, _) in enumerate(_CHECKS))
    + ") AS flag_labels, CASE WHEN " + " OR ".join(
        f"(f{i} AND b{i})" for i in range(len(_CHECKS))) + " THEN 'block' WHEN " + " OR ".join(
        f"f{i}" for i in range(len(_CHECKS))) + " THEN 'warn' ELSE '' END AS flag_severity FROM fx)",
]


def flagged_rows(t):
    rows = t.sql(_FLAG_ROWS).drop("ticket").withColumnRenamed("id", "ticket")
    return FL.detect_flags(rows, *_D, stage="all")


@query("flags", with_ctes(_FLAGGED, """SELECT ticket, street, flag_codes, flag_labels,
  flag_severity FROM flagged"""))
def _(t):
    return flagged_rows(t).select("ticket", "street", F.array_join("flags.code", ",").alias("flag_codes"),
                                  "flag_labels", "flag_severity")


@query("flag_breakdown", with_ctes(_FLAGGED, """SELECT label, count(*) AS rows FROM (
  SELECT unnest(string_split(flag_labels, '; ')) AS label FROM flagged WHERE flag_severity = 'block')
  GROUP BY label"""))
def _(t):
    return FL.flag_breakdown(flagged_rows(t), "block")


@query("severity_counts", with_ctes(_FLAGGED, """SELECT count(*) FILTER (flag_severity = 'block') AS blocking,
  count(*) FILTER (flag_severity = 'warn') AS warnings, count(*) FILTER (flag_severity = 'info') AS info
  FROM flagged"""))
def _(t):
    return FL.severity_counts(flagged_rows(t))


@query("triage", with_ctes(_FLAGGED, """SELECT ticket, street, CASE flag_severity WHEN 'block' THEN 'blocking'
  WHEN 'warn' THEN 'review' ELSE 'clean' END AS triage FROM flagged"""))
def _(t):
    return FL.with_triage(flagged_rows(t)).select("ticket", "street", "triage")


@query("triage_summary", with_ctes(_FLAGGED, """SELECT 0 AS position, 'blocking' AS triage,
    count(*) FILTER (flag_severity = 'block') AS rows FROM flagged
  UNION ALL SELECT 1, 'review', count(*) FILTER (flag_severity = 'warn') FROM flagged
  UNION ALL SELECT 2, 'info', count(*) FILTER (flag_severity = 'info') FROM flagged
  UNION ALL SELECT 3, 'clean', count(*) FILTER (flag_severity = '') FROM flagged"""))
def _(t):
    return FL.triage_summary(flagged_rows(t))


@query("waived_tickets", with_ctes(_FLAGGED, """SELECT ticket, 'flag_severity' AS field, 'block' AS old,
  'waived' AS new, 'waive' AS source, 'run1' AS run_id FROM flagged WHERE flag_severity = 'block'"""))
def _(t):
    return FL.waived_entries(flagged_rows(t), "run1", "2026-01-01T00:00:00").drop("timestamp")


@query("duplicate_tickets", with_ctes([SPOT], """SELECT ticket, street, 'dup_id' AS code FROM (
  SELECT CAST(CAST(ticket AS BIGINT) // 2 * 2 AS STRING) AS ticket, street, count(*) OVER (
    PARTITION BY CAST(ticket AS BIGINT) // 2) AS n FROM spots) WHERE n > 1"""))
def _(t):
    rows = t.sql(SPOTS).withColumn("ticket", (F.floor(F.col("ticket").cast("bigint") / 2) * 2)
                                   .cast("string"))
    return FL.detect_flags(rows, duplicates=True).select(
        "ticket", "street", F.explode("flags.code").alias("code")).where("code = 'dup_id'")


def _fingerprint_sql(columns):
    row = "concat_ws('␟', " + ", ".join(
        f"coalesce(CAST({c} AS STRING), '␀')" for c in columns) + ")"
    return (f"count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5({row}), 1, 15)) AS HUGEINT)) "
            "AS STRING) AS fingerprint")


@query("change_fingerprint", with_ctes([SPOT], f"SELECT {_fingerprint_sql(FL.FLAG_INPUTS)} FROM spots"))
def _(t):
    return FL.content_fingerprint(t.sql(SPOTS))


@query("coordinate_fingerprint", with_ctes([SPOT],
                                           f"SELECT {_fingerprint_sql(['ticket', 'lat', 'lon'])} FROM spots"))
def _(t):
    from tidyward.operators.zones import coordinate_fingerprint
    return coordinate_fingerprint(t.sql(SPOTS))


@query("rerun_needed", "SELECT true AS changed")
def _(t):
    spots = t.sql(SPOTS)
    return FL.needs_rerun(FL.content_fingerprint(spots), FL.content_fingerprint(
        spots.withColumn("lat", F.when(F.col("street").isNull(), "0").otherwise(F.col("lat")))))


# -- phrases ------------------------------------------------------------------


@query("term_counts", rf"""WITH w AS (SELECT doc_id, source, list_filter(
    regexp_extract_all(text, '[{_LATIN}]{{2,}}'), lambda x: x NOT IN ({lits(_DOC_STOP)})) AS words
    FROM documents),
  terms AS (SELECT DISTINCT doc_id, source, 1 AS n, unnest(words) AS term FROM w
    UNION ALL SELECT DISTINCT doc_id, source, 2, unnest(list_transform(range(1, len(words)),
      lambda i: words[i] || ' ' || words[i + 1])) FROM w)
  SELECT source, n, term, count(*) AS rows FROM terms GROUP BY ALL""")
def _(t):
    return term_counts(t.documents, "source", "text", _LATIN, _DOC_STOP)


@query("pattern_groups", rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS id, lang, list_filter(
    regexp_extract_all(text, '[{_LATIN}]{{2,}}'), lambda x: x NOT IN ({lits(_DOC_STOP)})) AS words
    FROM documents),
  least AS (SELECT lang, greatest(3, count(*) // 80) AS min_rows FROM documents GROUP BY lang),
  held AS (SELECT DISTINCT id, lang, 1 AS n, unnest(words) AS term FROM w
    UNION ALL SELECT DISTINCT id, lang, 2, unnest(list_transform(range(1, len(words)),
      lambda i: words[i] || ' ' || words[i + 1])) FROM w),
  often AS (SELECT lang, n, term, min_rows, list(id) AS ids FROM held JOIN least USING (lang)
    GROUP BY ALL HAVING count(*) >= min_rows),
  covered AS (SELECT DISTINCT lang, unnest(string_split(term, ' ')) AS term FROM often WHERE n = 2),
  cand AS (SELECT lang, term, min_rows, ids, row_number() OVER (PARTITION BY lang ORDER BY n * len(ids) DESC, term)
    AS rank FROM often o WHERE n = 2 OR NOT EXISTS (
      SELECT 1 FROM covered c WHERE c.lang = o.lang AND c.term = o.term)),
  state AS (SELECT DISTINCT lang, 0::BIGINT AS rank, 0 AS taken_groups, []::BIGINT[] AS taken, NULL::VARCHAR AS term,
      0::BIGINT AS rows, false AS fits FROM cand
    UNION ALL SELECT lang, rank, CASE WHEN len(free) >= min_rows THEN taken_groups + 1 ELSE taken_groups END,
      CASE WHEN len(free) >= min_rows THEN list_concat(taken, free) ELSE taken END, term, len(free),
      len(free) >= min_rows
    FROM (SELECT s.lang, c.rank, s.taken_groups, s.taken, c.term, c.min_rows,
      list_filter(c.ids, lambda i: NOT list_contains(s.taken, i)) AS free
      FROM state s JOIN cand c ON c.lang = s.lang AND c.rank = s.rank + 1 WHERE s.taken_groups < 12))
  SELECT lang, taken_groups - 1 AS position, term, rows FROM state WHERE fits""")
def _(t):
    minimum = t.documents.groupBy("lang").agg(
        F.greatest(F.lit(3).cast("bigint"), F.floor(F.count(F.lit(1)) / 80)).alias("min_rows"))
    return pattern_groups(t.documents, "lang", "doc_id", "text", minimum, 12, _LATIN, _DOC_STOP)[0]


@query("unknown_subtopics", with_ctes(CLEANED, f"""SELECT value, count(*) AS rows,
  array_to_string(list(description ORDER BY r) FILTER (r <= 2 AND {txt('description')} <> ''), '|') AS examples
  FROM (SELECT subtopic AS value, description, row_number() OVER (
      PARTITION BY subtopic ORDER BY ticket, description) AS r
    FROM cleaned WHERE category_source = 'passthrough') GROUP BY value"""))
def _(t):
    return unknown_subtopics(clean(t.sql(COMPLAINTS))).select(
        "value", "rows", F.array_join("examples", "|").alias("examples"))


@query("review_categories", with_ctes(CLEANED, f"""SELECT category, count(*) AS total,
  count(*) FILTER (resp_source = 'unresolved') AS unresolved FROM cleaned
  WHERE category IN ({lits(_CATS)}) GROUP BY category
  HAVING count(*) >= 3 AND count(*) FILTER (resp_source = 'unresolved') >= 5"""))
def _(t):
    return responsibility_clusters(clean(t.sql(COMPLAINTS)))[0].select("category", "total", "unresolved")


@query("review_questions")
def _(t):
    return responsibility_clusters(clean(t.sql(COMPLAINTS)))[1]


@query("required_columns", with_ctes([RAW], " UNION ALL ".join(
    f"SELECT '{c}' AS name, true AS found, count({c}) AS filled FROM raw"
    for c in ("ticket", "opened_at", "raw_address"))
    + " UNION ALL SELECT 'subtopic', false, CAST(0 AS BIGINT) WHERE EXISTS (SELECT 1 FROM raw)"))
def _(t):
    rows = t.sql(COMPLAINTS).drop("subtopic")
    found, missing = check_columns(rows)
    filled = rows.agg(*[F.count(c).alias(c) for c in found])
    return filled.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(c in found).alias("found"),
                 (F.col(c) if c in found else F.lit(0).cast("bigint")).alias("filled"))
        for c in found + missing])).alias("c")).select("c.*")
