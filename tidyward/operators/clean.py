"""Cleaning and classification with provenance and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.functions.address import address_route, parse_address
from tidyward.operators.ordered import recurrence
from tidyward.schema import CLEAN_COLUMNS, ensure_columns
from tidyward.session import rule_table, stored

TIER_NAMES = {2: "high", 1: "medium", 0: "low"}


def split_timestamp(df: DataFrame, source: str = "opened_at") -> DataFrame:
    """Add date, hour, weekday name and month; malformed text gives nulls."""
    ts = F.col(source)
    if dict(df.dtypes)[source] == "string":
        ts = ts.try_cast("timestamp")
    return df.withColumns({
        "date": F.to_date(ts), "hour": F.hour(ts),
        "weekday": T.weekday_name(ts), "month": F.month(ts),
    })


def keyword_label(description: Column | str, keywords: dict = R.RESP_KEYWORDS) -> Column:
    """The first label, in rule order, with a keyword in the text; else null."""
    out = F.lit(None).cast("string")
    for label, words in reversed(list(keywords.items())):
        out = F.when(T.has_any(description, words), label).otherwise(out)
    return out


def with_responsibility(df: DataFrame, description: str = "description",
                        rules: R.Rules = R.MUNICIPAL, resp: str = "responsibility",
                        source: str = "resp_source") -> DataFrame:
    """Add responsibility and its source; the text decides the ambiguous categories."""
    known = {c: r for c, r in rules.responsibility.items() if r != R.UNKNOWN_RESP}
    base = T.lookup("category", known)
    df = T.once(df, {"__base": base, "__label": F.when(
        base.isNull(), keyword_label(description, rules.keywords))})
    return df.withColumns({
        resp: F.coalesce("__base", "__label", F.lit(R.UNKNOWN_RESP)),
        source: F.when(F.col("__base").isNotNull(), "map")
            .when(F.col("__label").isNotNull(), F.concat(F.lit("keyword:"), F.col("__label")))
            .otherwise("unresolved"),
    }).drop("__base", "__label")


def classify(df: DataFrame, rules: R.Rules = R.MUNICIPAL, subtopic: str = "subtopic",
             topic: str = "topic", description: str = "description") -> DataFrame:
    """Add category, substance, asset and responsibility, each with where it came from.

    The sub-topic is replaced by its decoded form.
    """
    table = rule_table(df.sparkSession, ["subtopic", "__cat", "__sub", "__asset"], rules.subtopics)
    out = (
        df.withColumn("__topic", T.decode_entities(topic))
        .withColumn("subtopic", T.decode_entities(subtopic))
        .join(F.broadcast(table), "subtopic", "left"))
    sub = F.col("subtopic")
    out = T.once(out, {
        "category": F.when(F.col("__cat").isNotNull(), F.col("__cat"))
            .when(sub == "", T.lookup("__topic", rules.topics, R.UNCLASSIFIED))
            .otherwise(sub),
        "category_source": F.when(F.col("__cat").isNotNull(), "map")
            .when(sub == "", "topic_fallback").otherwise("passthrough"),
        "substance": F.coalesce("__sub", F.lit(R.UNKNOWN_DIM)),
        "asset": F.coalesce("__asset", F.lit(R.UNKNOWN_DIM)),
    })
    return (with_responsibility(out, description, rules)
            .drop("__cat", "__sub", "__asset", "__topic"))


# -- confidence ---------------------------------------------------------------

def category_tier(source: Column | str) -> Column:
    s = T.col(source)
    return F.when(s.isin("map", "user_map"), 2).when(s == "topic_fallback", 1).otherwise(0)


def responsibility_tier(source: Column | str) -> Column:
    s = T.col(source)
    return (F.when(s.isin("map", "user_resp", "user_resp_kw", "user_resp_unmatched",
                          "user_resp_term", "user_resp_default"), 2)
            .when(s.startswith("keyword:"), 1).otherwise(0))


def address_tier(route: Column | str, street: Column | str) -> Column:
    r = T.col(route)
    return (F.when(r.isin("std", "intersection", "range"), 2)
            .when(r.isin("apt_suffix", "multi"), 1)
            .when(r == "landmark", (F.coalesce(T.col(street), F.lit("")) != "").cast("int"))
            .otherwise(0))


def tier_label(*tiers: Column) -> Column:
    return T.lookup(F.least(*tiers), {k: v for k, v in TIER_NAMES.items()})


def confidence_of(resp_tier: Column | None = None) -> Column:
    """The overall tier: the lowest of category, responsibility and address."""
    return tier_label(
        category_tier("category_source"),
        responsibility_tier("resp_source") if resp_tier is None else resp_tier,
        address_tier("addr_route", "street"))


def _said(c: Column | str) -> Column:
    return F.coalesce(T.col(c).cast("string"), F.lit(""))


def confidence_details(topic: Column) -> Column:
    """One sentence per decision, joined by " | "; missing parts stay empty."""
    # The sentences below must match.
    route = F.col("addr_route")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    category = (
        F.when(F.col("category_source") == "map",
               say("קטגוריה:מיפוי ישיר — ", F.col("subtopic"), " ← ", F.col("category"), ":high"))
        .when(F.col("category_source") == "topic_fallback",
              say("קטגוריה:נגזרה מנושא — ", topic, " ← ", F.col("category"), ":medium"))
        .otherwise(say("קטגוריה:תת-נושא לא מזוהה — ", F.col("subtopic"), ":low")))
    resp = (
        F.when(F.col("resp_source") == "map",
               say("אחריות:מיפוי ישיר — ", F.col("category"), " ← ", F.col("responsibility"),
                   ":high"))
        .when(F.col("resp_source").startswith("keyword:"),
              say("אחריות:הוסקה ממילות מפתח — ", F.col("responsibility"), ":medium"))
        .otherwise("אחריות:לא נפתרה — נותרת א.מ.ל:low"))
    name = lambda labels: T.lookup(route, labels)
    address = (
        F.when(route.isin("std", "intersection", "range"),
               say("כתובת:", name({"std": "כתובת רגילה", "intersection": "צומת",
                                   "range": "טווח בתים"}),
                   " — ", _said("street"), " ", _said("house"), ":high"))
        .when(route.isin("apt_suffix", "multi"),
              say("כתובת:", name({"apt_suffix": "עם סיומת דירה/קומה", "multi": "מספרים מרובים"}),
                  " — ", _said("street"), ":medium"))
        .when((route == "landmark") & (_said("street") != ""),
              say("כתובת:ציון דרך (ללא מספר בית) — ", F.col("street"), ":medium"))
        .when(route == "landmark", "כתובת:ציון דרך — לא זוהה רחוב ברור:low")
        .otherwise("כתובת:ריקה/לא ניתנת לפרסור — ריק:low"))
    return F.concat_ws(" | ", category, resp, address)


def clean(raw: DataFrame, rules: R.Rules = R.MUNICIPAL, hot_rows: int | None = None) -> DataFrame:
    """Raw export to the 34-column table: one narrow stage, then one shuffle to number repeats."""
    df = ensure_columns(raw, {c: "string" for c in
                              ("topic", "subtopic", "description", "status", "department",
                               "raw_address")})
    df = split_timestamp(df)
    df = parse_address(df, "raw_address")
    df = classify(df, rules)
    df = df.withColumns({
        "ticket_suffix": T.ticket_suffix("ticket"),
        "ticket": T.trim_decimal(T.ticket_id("ticket")),
        "wants_callback": T.wants_callback("description"),
        "has_personal_info": T.has_phone("description"),
        "addr_route": address_route(F.col("loc_type"), F.col("house"), F.col("address_text")),
        "auto_fixed": F.lit(False),
    })
    df = df.withColumns({
        "confidence": confidence_of(),
        "confidence_details": confidence_details(T.decode_entities("topic")),
    })
    # by column, as the counting of repeats and most readers need only a few of them
    df = stored(df.select(*[c for c in CLEAN_COLUMNS if c not in ("recurrence_no", "is_recurring")]))
    return recurrence(df, hot_rows=hot_rows).select(*CLEAN_COLUMNS)


def cleaning_stats(df: DataFrame) -> DataFrame:
    """One row: rows, recurring and unknown-responsibility rates, rows per tier."""
    rate = lambda c: F.coalesce(F.round(F.avg(c.cast("double")) * 100, 1), F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        rate(F.col("is_recurring")).alias("recurring_rate"),
        rate((F.col("responsibility") == R.UNKNOWN_RESP).cast("int")).alias("unknown_resp_rate"),
        *[F.count_if(F.col("confidence") == t).alias(f"conf_{t}")
          for t in ("high", "medium", "low")])
