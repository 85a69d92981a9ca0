"""Query registration and the SQL fragments the expected results share."""

from __future__ import annotations

from typing import Callable

from tidyward import rules as R
from tidyward.plans.inputs import COMPLAINTS, POINTS, REQUESTS, SPOTS, Tables, plain

QUERIES: dict[str, Callable] = {}
EXPECTED: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables`; ``sql`` is what it must equal."""
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            EXPECTED[name] = sql
        return fn
    return add


def lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


def ws(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def txt(x: str) -> str:
    return ws(f"coalesce(CAST({x} AS STRING), '')")


def decode(x: str) -> str:
    out = f"coalesce(CAST({x} AS STRING), '')"
    for a, b in [("&#039;", "'"), ("&quot;", '"'), ("&amp;", "&"), ("&#39;", "'"),
                 ("&gt;", ">"), ("&lt;", "<")]:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return ws(out)


def num(x: str) -> str:
    n = f"TRY_CAST({ws(f'''replace(CAST({x} AS STRING), ',', '')''')} AS DOUBLE)"
    return f"CASE WHEN isfinite({n}) THEN {n} END"


def blank(x: str) -> str:
    return f"({x} IS NULL OR lower({ws(f'CAST({x} AS STRING)')}) IN ('', 'nan', 'none'))"


JUNK = r"""'^[\d\s.,\-_!?()״׳''"]+$'"""


def junk(x: str) -> str:
    return f"(NOT {blank(x)} AND regexp_matches({txt(x)}, {JUNK}))"


def mapped(x: str, mapping: dict, other: str = "NULL") -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {x} {whens} ELSE {other} END"


def any_word(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(coalesce({x}, ''), {lit(w)})" for w in words) + ")"


def with_ctes(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


RAW = f"raw AS ({plain(COMPLAINTS)})"
SPOT = f"spots AS ({plain(SPOTS)})"
POINT = f"points AS ({plain(POINTS)})"
REQUEST = f"requests AS ({plain(REQUESTS)})"

_WORD_END = "(?:[^א-תA-Za-z0-9_]|$)"
CROSSING = lit(r"(?s)^(.*?)\s+(?:פינת|פינה|פ['.])\s*(.*)$")
RANGE = lit(r"^(.+?)\s+(\d+\s*[-–]\s*\d+)\s*$")
DIRECTION = lit(r"(?s)^(.*?)\s+(?:" + "|".join(R.DIRECTIONS).replace(r"\b", _WORD_END) + ")")
NUMBERED = lit(r"^(.+?)\s+(\d+)\s*$")
LETTERED = lit(r"^(.+?)\s+(\d+)\s*([א-ת]{1,2}['׳]?)\s*$")
JOINED = lit(r"^(.+?)\s+(\d+\s*[+&]\s*\d+)\s*$")


def parse_ctes(src: str, dst: str, source: str, p: str = "") -> list[str]:
    """Address decomposition of ``source`` as a chain of CTEs ending in ``dst``."""
    at, a, k, b, m = (f"{dst}_{x}" for x in ("at", "a", "k", "b", "m"))
    get = lambda x, pat, g: f"regexp_extract({x}, {pat}, {g})"
    return [
        f"{dst}1 AS (SELECT *, {decode(source)} AS {at} FROM {src})",
        rf"""{dst}2 AS (SELECT *,
          CASE WHEN regexp_matches({at}, '\([^)]*\)') THEN
            '(' || {ws(rf"regexp_extract({at}, '\(([^)]*)\)', 1)")} || ')' END AS {p}addr_note,
          {ws(rf"regexp_replace({at}, '\([^)]*\)', ' ')")} AS {a} FROM {dst}1)""",
        f"""{dst}3 AS (SELECT *, {get(a, DIRECTION, 1)} AS {b}, CASE WHEN {at} = '' THEN 'none'
          WHEN {ws(get(a, CROSSING, 2))} <> '' THEN 'crossing'
          WHEN regexp_matches({a}, {RANGE}) THEN 'range' END AS {k}1 FROM {dst}2)""",
        rf"""{dst}4 AS (SELECT *, CASE WHEN {k}1 IS NULL AND {ws(b)} <> '' THEN {ws(b)} ELSE {a} END AS {m},
          CASE WHEN {k}1 IS NULL AND {ws(b)} <> '' THEN
            regexp_replace(substr({a}, length({b}) + 1), '^[\s|]+|[\s|]+$', '', 'g') END AS {dst}_n
          FROM {dst}3)""",
        f"""{dst}5 AS (SELECT *, coalesce({k}1,
          CASE WHEN regexp_matches({m}, {NUMBERED}) THEN 'numbered'
               WHEN regexp_matches({m}, {LETTERED}) THEN 'lettered'
               WHEN regexp_matches({m}, {JOINED}) THEN 'joined' ELSE 'landmark' END) AS {k}
          FROM {dst}4)""",
        rf"""{dst}6 AS (SELECT *, CASE {k}
            WHEN 'range' THEN regexp_replace({get(m, RANGE, 2)}, '\s+', '', 'g')
            WHEN 'numbered' THEN {get(m, NUMBERED, 2)}
            WHEN 'lettered' THEN {get(m, LETTERED, 2)} ||
              regexp_replace({get(m, LETTERED, 3)}, '''+$', '')
            WHEN 'joined' THEN replace({get(m, JOINED, 2)}, ' ', '') END AS {p}house FROM {dst}5)""",
        f"""{dst} AS (SELECT *, {at} AS {p}address_text,
          {ws(f'''CASE {k} WHEN 'crossing' THEN {get(m, CROSSING, 1)} WHEN 'range' THEN {get(m, RANGE, 1)}
            WHEN 'numbered' THEN {get(m, NUMBERED, 1)} WHEN 'lettered' THEN {get(m, LETTERED, 1)}
            WHEN 'joined' THEN {get(m, JOINED, 1)} WHEN 'landmark' THEN {m} END''')} AS {p}street,
          CASE WHEN {k} = 'crossing' THEN {ws(get(m, CROSSING, 2))} END AS {p}cross_street,
          CASE {k} WHEN 'none' THEN 'ללא רחוב' WHEN 'crossing' THEN 'צומת'
            WHEN 'range' THEN 'טווח בתים' WHEN 'joined' THEN 'טווח בתים'
            WHEN 'landmark' THEN 'ציון דרך' ELSE 'כתובת' END AS {p}loc_type,
          CASE WHEN {k} = 'range' THEN 'בתים: ' || {p}house ELSE {dst}_n END AS {p}loc_note
          FROM {dst}6)""",
    ]


ROUTE = rf"""CASE WHEN loc_type = 'צומת' THEN 'intersection' WHEN loc_type = 'טווח בתים' THEN 'range'
  WHEN loc_type = 'כתובת' AND coalesce(house, '') <> '' THEN
    CASE WHEN regexp_matches(address_text, '\d+\s*[+&]\s*\d+\s*$') THEN 'multi'
         WHEN regexp_matches(address_text, {lit("[0-9]+[ ]*[א-ת]{1,2}['׳]?[ ]*$")}) THEN 'apt_suffix'
         ELSE 'std' END
  WHEN loc_type = 'ללא רחוב' THEN 'empty' ELSE 'landmark' END"""

PARSED = [RAW] + parse_ctes("raw", "parsed", "raw_address")

KEYWORD = "CASE " + " ".join(
    f"WHEN {any_word('description', words)} THEN {lit(label)}"
    for label, words in R.RESP_KEYWORDS.items()) + " END"
_KNOWN = {c: r for c, r in R.RESPONSIBILITY.items() if r != R.UNKNOWN_RESP}


def resp_sql(category: str = "category") -> str:
    return f"coalesce({mapped(category, _KNOWN)}, {KEYWORD}, {lit(R.UNKNOWN_RESP)})"


def resp_source_sql(category: str = "category") -> str:
    return (f"CASE WHEN {mapped(category, _KNOWN)} IS NOT NULL THEN 'map' "
            f"WHEN {KEYWORD} IS NOT NULL THEN 'keyword:' || {KEYWORD} ELSE 'unresolved' END")


RULES = "rules(r_sub, r_cat, r_substance, r_asset) AS (VALUES " + ", ".join(
    f"({lits(row)})" for row in R.SUBTOPICS) + ")"

CLASSIFIED = PARSED + [
    RULES,
    f"c1 AS (SELECT *, {decode('subtopic')} AS sub, {decode('topic')} AS top FROM parsed)",
    f"""c2 AS (SELECT *, CASE WHEN r_cat IS NOT NULL THEN r_cat
        WHEN sub = '' THEN {mapped('top', R.TOPICS, lit(R.UNCLASSIFIED))} ELSE sub END AS category,
        CASE WHEN r_cat IS NOT NULL THEN 'map' WHEN sub = '' THEN 'topic_fallback'
             ELSE 'passthrough' END AS category_source,
        coalesce(r_substance, 'לא ידוע') AS substance, coalesce(r_asset, 'לא ידוע') AS asset
        FROM c1 LEFT JOIN rules ON r_sub = sub)""",
    f"""classified AS (SELECT *, {resp_sql()} AS responsibility, {resp_source_sql()} AS resp_source,
        {ROUTE} AS addr_route FROM c2)""",
]

CAT_TIER = """CASE WHEN category_source IN ('map', 'user_map') THEN 2
  WHEN category_source = 'topic_fallback' THEN 1 ELSE 0 END"""
RESP_TIER = """CASE WHEN resp_source = 'map' OR resp_source IN ('user_resp', 'user_resp_kw',
  'user_resp_unmatched', 'user_resp_term', 'user_resp_default') THEN 2
  WHEN resp_source LIKE 'keyword:%' THEN 1 ELSE 0 END"""
ADDR_TIER = """CASE WHEN addr_route IN ('std', 'intersection', 'range') THEN 2
  WHEN addr_route IN ('apt_suffix', 'multi') THEN 1
  WHEN addr_route = 'landmark' AND coalesce(street, '') <> '' THEN 1 ELSE 0 END"""


def confidence_sql(resp: str = RESP_TIER) -> str:
    return (f"CASE least({CAT_TIER}, {resp}, {ADDR_TIER}) WHEN 2 THEN 'high' "
            "WHEN 1 THEN 'medium' ELSE 'low' END")


DETAILS = """concat_ws(' | ',
  CASE category_source WHEN 'map' THEN 'קטגוריה:מיפוי ישיר — ' || sub || ' ← ' || category || ':high'
    WHEN 'topic_fallback' THEN 'קטגוריה:נגזרה מנושא — ' || top || ' ← ' || category || ':medium'
    ELSE 'קטגוריה:תת-נושא לא מזוהה — ' || sub || ':low' END,
  CASE WHEN resp_source = 'map' THEN 'אחריות:מיפוי ישיר — ' || category || ' ← ' || responsibility || ':high'
    WHEN resp_source LIKE 'keyword:%' THEN 'אחריות:הוסקה ממילות מפתח — ' || responsibility || ':medium'
    ELSE 'אחריות:לא נפתרה — נותרת א.מ.ל:low' END,
  CASE WHEN addr_route IN ('std', 'intersection', 'range') THEN 'כתובת:' ||
      CASE addr_route WHEN 'std' THEN 'כתובת רגילה' WHEN 'intersection' THEN 'צומת' ELSE 'טווח בתים' END ||
      ' — ' || coalesce(street, '') || ' ' || coalesce(house, '') || ':high'
    WHEN addr_route IN ('apt_suffix', 'multi') THEN 'כתובת:' ||
      CASE addr_route WHEN 'apt_suffix' THEN 'עם סיומת דירה/קומה' ELSE 'מספרים מרובים' END ||
      ' — ' || coalesce(street, '') || ':medium'
    WHEN addr_route = 'landmark' AND coalesce(street, '') <> ''
      THEN 'כתובת:ציון דרך (ללא מספר בית) — ' || street || ':medium'
    WHEN addr_route = 'landmark' THEN 'כתובת:ציון דרך — לא זוהה רחוב ברור:low'
    ELSE 'כתובת:ריקה/לא ניתנת לפרסור — ריק:low' END)"""

WEEKDAY = "CASE isodow({}) " + " ".join(
    f"WHEN {i + 1} THEN {lit(n)}" for i, n in enumerate(R.WEEKDAYS)) + " END"

CLEANED = CLASSIFIED + [
    rf"""c3 AS (SELECT * EXCLUDE (ticket, subtopic), ticket AS t0, sub AS subtopic,
        coalesce(nullif(regexp_extract({ws('ticket')}, '^(\d+)', 1), ''), {ws('ticket')}) AS ticket,
        CAST(opened_at AS DATE) AS date FROM classified)""",
    f"""cleaned AS (SELECT ticket, opened_at, date, CAST(hour(opened_at) AS INT) AS hour,
        {WEEKDAY.format('opened_at')} AS weekday, CAST(month(opened_at) AS INT) AS month, status,
        topic, category, substance, responsibility, asset, street, cross_street, house, loc_type,
        description, loc_note,
        CAST(CASE WHEN street IS NOT NULL AND house IS NOT NULL AND row_number() OVER w > 1
             THEN 1 ELSE 0 END AS INT) AS is_recurring,
        CAST({any_word('description', R.CALLBACK_PHRASES)} AS INT) AS wants_callback,
        CAST(regexp_matches(coalesce(description, ''), '05\\d[-\\s]?\\d{{6,7}}') AS INT)
          AS has_personal_info,
        nullif(regexp_extract({ws('t0')}, '-\\s*([א-ת])\\s*$', 1), '') AS ticket_suffix,
        raw_address, address_text, addr_note, department, subtopic,
        CASE WHEN street IS NOT NULL AND house IS NOT NULL THEN row_number() OVER w END AS recurrence_no,
        category_source, resp_source, addr_route, false AS auto_fixed,
        {confidence_sql()} AS confidence, {DETAILS} AS confidence_details
        FROM c3 WINDOW w AS (PARTITION BY street, house, category
          ORDER BY date NULLS FIRST, opened_at NULLS FIRST, ticket))""",
]
