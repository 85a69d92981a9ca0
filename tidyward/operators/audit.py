"""Change audit and the log of automatic corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.schema import PROVENANCE


def change_entries(before: DataFrame, after: DataFrame, fields: list[str], source: str,
                   run_id: str, timestamp: str, key: str = "ticket") -> DataFrame:
    """One audit entry per changed field of each ticket.

    Tickets are compared one to one. A blank ticket names no row, so such rows are left
    out; a ticket that one table repeats cannot be paired, so its rows are left out too
    and :func:`repeated_keys` reports them.
    """
    if source not in R.AUDIT_SOURCES:
        raise ValueError(f"no such audit source: {source!r}; known are {', '.join(sorted(R.AUDIT_SOURCES))}")
    def single(df: DataFrame, name: str) -> DataFrame:
        values = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
        return (df.where(T.text(key) != "").groupBy(key)
                .agg(F.any_value(values).alias(name), F.count(F.lit(1)).alias("__n"))
                .where("__n = 1").drop("__n"))

    old, new = single(before, "__old"), single(after, "__new")
    changes = F.array_compact(F.array(*[
        F.when(~F.col(f"__old.{f}").eqNullSafe(F.col(f"__new.{f}")), F.struct(
            F.lit(f).alias("field"), F.coalesce(F.col(f"__old.{f}"), F.lit("")).alias("old"),
            F.coalesce(F.col(f"__new.{f}"), F.lit("")).alias("new"))) for f in fields]))
    return (old.join(new, key).select(F.col(key).cast("string").alias("ticket"),
                                      F.explode(changes).alias("c"))
            .select("ticket", "c.field", "c.old", "c.new", F.lit(source).alias("source"),
                    F.lit(timestamp).alias("timestamp"), F.lit(run_id).alias("run_id")))


def repeated_keys(df: DataFrame, key: str = "ticket") -> DataFrame:
    """Keys that more than one row has, blank ones included: key, rows."""
    return (df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key))
            .agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))


# Labels and sentences of the log must match.
ROUTES = {"std": "כתובת", "intersection": "צומת", "range": "טווח",
          "apt_suffix": "סיומת דירה", "multi": "מרובה", "landmark": "ציון דרך"}


def correction_log(df: DataFrame, keywords: dict = R.RESP_KEYWORDS,
                   length: int | None = None) -> DataFrame:
    """Up to three rows per ticket: what the cleaner changed, from what, and why.

    Without provenance columns nothing can be said, and the log is empty. Texts come
    whole; with ``length`` addresses and descriptions are cut to it for display.
    """
    shown = lambda c: F.col(c) if length is None else F.substring(c, 1, length)
    have = set(df.columns)
    g: dict[str, Column] = {c: T.text(c) if c in have else F.lit("") for c in (
        "ticket", "date", "topic", "subtopic", "substance", "asset", "street", "house", "status",
        "category", "category_source", "responsibility", "resp_source", "raw_address",
        "addr_route", "description")}
    df = df.select(*[c.alias(n) for n, c in g.items()])
    c = F.col
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    source = c("resp_source")
    by_keyword = source.startswith("keyword:")
    word = F.lit(None).cast("string")
    for label, words in keywords.items():
        first = F.lit(None).cast("string")
        for w in reversed(words):
            first = F.when(c("description").contains(w), w).otherwise(first)
        word = F.when(by_keyword & (source == f"keyword:{label}"), first).otherwise(word)
    category = F.when(
        (c("subtopic") != "") & (c("category") != "") & (c("subtopic") != c("category"))
        & (c("category_source") == "map"),
        F.struct(F.lit("קטגוריה").alias("kind"), c("subtopic").alias("before"),
                 c("category").alias("after"),
                 say('תת-נושא "', c("subtopic"), '" שויך לקטגוריה "', c("category"),
                     '" לפי טבלת המיפוי').alias("reason"),
                 F.lit(None).cast("string").alias("keyword")))
    given = say('אחריות נקבעה כ"', c("responsibility"), '"')
    resp = F.when(
        ((source == "map") & ~c("responsibility").isin(R.UNKNOWN_RESP, ""))
        | by_keyword | (source == "context_resolve"),
        F.struct(F.lit("אחריות").alias("kind"), F.lit("לא מסווג").alias("before"),
                 c("responsibility").alias("after"),
                 F.when(source == "map", say(given, ' — כל פניות הקטגוריה "', c("category"),
                                             '" מסווגות כך'))
                 .when(by_keyword, say(given, ' בגלל מילת המפתח "',
                                       F.substring_index(source, ":", -1), '" שנמצאה בתיאור'))
                 .otherwise(say(given, " מהקשר: הפנייה טופלה והקטגוריה מצביעה על כשל בציוד"))
                 .alias("reason"), word.alias("keyword")))
    address = F.when(
        c("addr_route").isin(list(ROUTES)) & (c("street") != "") & (F.length("raw_address") > 2),
        F.struct(F.lit("כתובת").alias("kind"), shown("raw_address").alias("before"),
                 T.strip(say(c("street"), " ", c("house"))).alias("after"),
                 say('כתובת "', shown("raw_address"), '" נוּתחה: רחוב "', c("street"),
                     '", בית ', c("house"), " (סוג: ", T.lookup("addr_route", ROUTES), ")")
                 .alias("reason"), F.lit(None).cast("string").alias("keyword")))
    log = df.select(
        "ticket", "date", "topic", "subtopic", "substance", "asset", "street", "house", "status",
        shown("description").alias("description"),
        F.explode(F.array_compact(F.array(category, resp, address))).alias("k"))
    log = log.select("*", "k.*").drop("k")
    return log if have & set(PROVENANCE) else log.limit(0)


def correction_summary(log: DataFrame) -> DataFrame:
    """One row: corrections, distinct tickets, and how many of each kind."""
    return (
        log.groupBy("ticket", "kind").agg(F.count(F.lit(1)).alias("__n"))
        .groupBy("ticket").pivot("kind", ["קטגוריה", "אחריות", "כתובת"]).sum("__n")
        .agg(F.count(F.lit(1)).alias("tickets"), *[
            F.coalesce(F.sum(k), F.lit(0)).alias(name)
            for k, name in (("קטגוריה", "category"), ("אחריות", "responsibility"),
                            ("כתובת", "address"))])
        .select((F.col("category") + F.col("responsibility") + F.col("address"))
                .alias("corrections"), "*"))


def provenance_status(df: DataFrame) -> tuple[str, list[str]]:
    """("full" | "partial" | "none", missing columns), from the schema alone."""
    missing = [c for c in PROVENANCE if c not in df.columns]
    level = "full" if not missing else "none" if len(missing) == len(PROVENANCE) else "partial"
    return level, missing


def provenance_counts(df: DataFrame) -> DataFrame:
    """One row: categories and responsibilities the cleaner set; null where it cannot be known."""
    unknown = F.lit(None).cast("bigint")
    source = F.col("resp_source") if "resp_source" in df.columns else None
    return df.agg(
        (F.count_if(F.col("category_source") == "map") if "category_source" in df.columns
         else F.max(unknown)).alias("category_corrections"),
        (F.count_if((source == "map") | source.startswith("keyword:")
                    | (source == "context_resolve")) if source is not None
         else F.max(unknown)).alias("responsibility_corrections"))
