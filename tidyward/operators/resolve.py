"""Second-chance resolution: context rules and automatic address repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.functions.address import PARTS, parse_address
from tidyward.operators.clean import confidence_of, with_responsibility
from tidyward.schema import ensure_columns
from tidyward.session import join_known


def resolve_from_context(df: DataFrame, rules: R.Rules = R.MUNICIPAL) -> DataFrame:
    """Resolve still-open rows from status, place and text; re-tier the context ones."""
    if "resp_source" not in df.columns:
        return df
    df = ensure_columns(df, {c: "string" for c in
                             ("status", "raw_address", "description", "addr_note", "loc_note")})
    notes = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in
                               ("description", "addr_note", "loc_note")])
    place = T.text("raw_address")
    at_beach = T.any_of([place.startswith(p) for p in R.BEACH_PREFIXES])
    context = (
        F.when(F.col("status").contains(R.HANDLED_WORD)
               & F.col("category").isin(R.HANDLED_CATEGORIES), "עירייה")
        .when(at_beach & T.has_any(notes, R.NATURE_WORDS), "טבעי")
        .when(at_beach & T.has_any(notes, R.CITIZEN_WORDS), "התנהגות אזרח"))
    still_open = F.col("resp_source") == "unresolved"
    df = T.once(df, {"__context": F.when(still_open, context)})
    df = with_responsibility(df, "description", rules, "__resp", "__how")
    # a mapped category found open also gets the keyword form of source
    df = df.withColumn("__again", F.when(
        still_open & F.col("__context").isNull() & (F.col("__resp") != R.UNKNOWN_RESP),
        F.col("__resp"))).drop("__resp", "__how")
    df = df.withColumns({
        "responsibility": F.coalesce("__context", "__again", "responsibility"),
        "resp_source": F.when(F.col("__context").isNotNull(), "context_resolve")
            .when(F.col("__again").isNotNull(), F.concat(F.lit("keyword:"), F.col("__again")))
            .otherwise(F.col("resp_source")),
    })
    if "confidence" in df.columns:
        df = df.withColumn("confidence", F.when(
            F.col("resp_source") == "context_resolve", confidence_of(F.lit(1)))
            .otherwise(F.col("confidence")))
    return df.drop("__context", "__again")


def auto_fix(df: DataFrame, known_unresolvable: DataFrame | None = None,
             prefixes=R.DESCRIPTIVE_PREFIXES) -> DataFrame:
    """Repair rows that would block: ticket and street hygiene, places, second parse.

    ``known_unresolvable`` has one column, ``name``: raw addresses that name no street.
    """
    df = df.withColumns({"ticket": T.tidy_ticket("ticket"), "street": T.tidy_street("street")})
    if "raw_address" not in df.columns or "loc_type" not in df.columns:
        return df
    raw = T.text("raw_address")
    street = F.col("street")
    empty = F.coalesce(street, F.lit("")) == ""
    hollow = empty | street.rlike(T.JUNK)
    df = T.once(df, {"__raw": raw, "__empty": empty, "__hollow": hollow})
    if known_unresolvable is None:
        df = df.withColumn("__known", F.lit(False))
    else:
        known = known_unresolvable.select(F.col("name").alias("__asked")).distinct() \
            .withColumn("__known", F.lit(True))
        # blank addresses name no street; they are many, so they must not meet in one key
        asked = F.when(F.col("__raw") != "", F.col("__raw"))
        df = join_known(df.withColumn("__asked", asked), known, ["__asked"]) \
            .withColumn("__known", F.coalesce("__known", F.lit(False))).drop("__asked")
    place = (~F.col("__known") & F.col("__hollow")
             & T.any_of([F.col("__raw").startswith(p) for p in prefixes]))
    df = df.withColumn("__place", place)
    marked = F.col("__known") | F.col("__place")
    df = df.withColumns({
        "loc_type": F.when(marked, R.LOC_LANDMARK).otherwise(F.col("loc_type")),
        "street": F.when(marked & F.col("__hollow"), "").otherwise(F.col("street")),
    })
    # text inside parentheses, for hollow streets
    leading = r"(?U)^\d+\(([^)]+)\)"
    whole = r"(?U)^\(([^)]+)\)$"
    df = df.withColumns({
        "__first": F.when(F.col("__hollow"), T.match(F.col("__raw"), leading)),
        "__only": F.when(F.col("__hollow"), T.match(F.col("__raw"), whole)),
    })
    df = parse_address(df, F.coalesce("__first", "__only"), "in_")
    inside = F.coalesce(F.col("in_street"), F.lit("")) != ""
    bracketed = F.col("__first").isNotNull() | F.col("__only").isNotNull()
    df = df.withColumns({
        "street": F.when(bracketed & inside, F.col("in_street")).otherwise(F.col("street")),
        "loc_type": F.when(bracketed & inside, F.col("in_loc_type"))
            .when(F.col("__only").isNotNull(), R.LOC_LANDMARK)
            .otherwise(F.col("loc_type")),
    })
    # a second parse of the whole raw address, for streets that began empty
    retry = F.col("__empty") & ~marked & (F.length("__raw") > 2)
    df = parse_address(df, F.when(retry, F.col("raw_address")), "re_")
    usable = (retry & (F.coalesce(F.col("re_street"), F.lit("")) != "")
              & ~F.coalesce(F.col("re_street"), F.lit("")).rlike(T.JUNK))
    df = df.withColumns({
        "street": F.when(usable, F.col("re_street")).otherwise(F.col("street")),
        "house": F.when(usable, F.coalesce("re_house", "house")).otherwise(F.col("house")),
        "loc_type": F.when(usable, F.col("re_loc_type")).otherwise(F.col("loc_type")),
    })
    return df.drop("__raw", "__empty", "__hollow", "__known", "__place", "__first", "__only",
                   *["in_" + p for p in PARTS], *["re_" + p for p in PARTS])
