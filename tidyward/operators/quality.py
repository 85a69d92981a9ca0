"""Zero-acceptance sampling, review plans and acceptance cards."""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.functions.geo import in_box
from tidyward.session import pinned

WHOLE, OTHER = "(הכל)", "(אחר)"

# Names of the strata columns in a label.
STRATA_NAMES = {"category_source": "סיווג", "resp_source": "אחריות",
                "addr_route": "מסלול", "precision": "דיוק"}
CLEAN_STRATA = ["category_source", "resp_source"]
GEOCODE_STRATA = ["addr_route", "precision"]


def check_rates(p_reject: float, beta: float) -> None:
    if not 0 < p_reject <= 1:
        raise ValueError(f"p_reject is a share above 0 and up to 1, not {p_reject}")
    if not 0 < beta < 1:
        raise ValueError(f"beta is a share between 0 and 1, not {beta}")


def full_size(p_reject: float, beta: float = R.BETA) -> int:
    """Rows to check so that a lot with ``p_reject`` errors passes with chance ``beta``."""
    check_rates(p_reject, beta)
    return math.ceil(-math.log(beta) / p_reject)


def sample_size(lot: Column | str, p_reject: float, beta: float = R.BETA) -> Column:
    return F.least(F.lit(full_size(p_reject, beta)).cast("bigint"), T.col(lot).cast("bigint"))


def draw_order(seed: int, key: Column | str = "ticket") -> Column:
    """Repeatable random order: the md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), T.col(key).cast("string")))


def draw_sample(df: DataFrame, n: int, seed: int = 42, key: str = "ticket") -> DataFrame:
    """``n`` rows without replacement, the same ones for the same seed."""
    return df.orderBy(draw_order(seed, key), key).limit(max(n, 0))


def sample_per_group(df: DataFrame, groups: list[str], sizes: DataFrame, largest: int,
                     seed: int, key: str = "ticket") -> DataFrame:
    """The first ``sample_n`` rows of each group in draw order, with ``position``.

    The constant bound lets Spark keep only the first rows of each group before
    the shuffle, however large the group is.
    """
    w = Window.partitionBy(*groups).orderBy(draw_order(seed, key), key)
    top = df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= largest)
    return (top.join(sizes.select(*groups, "sample_n"), groups)
            .where(F.col("position") <= F.col("sample_n")))


def is_defect(tier: Column | str = "tier", box=R.BOX) -> Column:
    """No point; or outside the box where the tier claims an address; always for ``none``."""
    lat, lon = T.to_number("lat"), T.to_number("lon")
    lost = lat.isNull() | lon.isNull()
    strict = T.col(tier).isin("address", "near_address", "address_unverified")
    return (T.col(tier) == "none") | lost | (strict & ~F.coalesce(in_box(lat, lon, box), F.lit(False)))


def sampling_plan(df: DataFrame, p_reject: dict = R.P_REJECT, beta: float = R.BETA,
                  seed: int = 42, defect: Callable[[str], Column] = is_defect,
                  tiers: list[str] | None = None, key: str = "ticket") -> DataFrame:
    """Per precision tier: lot, sample, defects, verdict. ``defect`` names the rule as a column."""
    tiers = list(R.TIERS) if tiers is None else tiers
    if "precision" in df.columns:
        df = df.where(F.col("precision").isin(tiers)).withColumn("tier", F.col("precision"))
    else:
        tiers = ["(all)"]
        df = df.withColumn("tier", F.lit("(all)"))
    sizes_by_tier = {t: full_size(p_reject.get(t, R.P_REJECT.get(t, R.P_REJECT_OTHER)), beta)
                     for t in tiers}
    full = T.lookup("tier", sizes_by_tier).cast("bigint")
    lots = df.groupBy("tier").agg(F.count(F.lit(1)).alias("lot_size")) \
        .withColumn("sample_n", F.least(full, F.col("lot_size")))
    sample = sample_per_group(df, ["tier"], lots, max(sizes_by_tier.values()), seed, key)
    found = sample.groupBy("tier").agg(F.count_if(defect("tier")).alias("defects"))
    return (
        lots.join(found, "tier")
        .select("tier", "lot_size", "sample_n", "defects",
                F.when(F.col("defects") == 0, R.ACCEPT).otherwise(R.REJECT).alias("verdict"),
                F.round(F.col("defects") / F.col("sample_n") * 100, 1).alias("defect_pct")))


def stratify(df: DataFrame, columns: list[str], min_size: int = 5) -> DataFrame:
    """Add ``stratum``; strata under ``min_size`` rows merge into one."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.withColumn("stratum", F.lit(WHOLE))
    df = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in present})
    keys = [f"__{c}" for c in present]
    label = F.concat_ws(" · ", *[
        F.concat(F.lit(STRATA_NAMES.get(c, c) + ": "), F.col(f"__{c}")) for c in present])
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(
        *keys, F.when(F.col("__n") < min_size, OTHER).otherwise(label).alias("stratum"))
    return df.join(pinned(sizes), keys).drop(*keys)


def sample_plan(df: DataFrame, columns: list[str], p_reject: float = R.SPOT_P_REJECT,
                beta: float = R.BETA, seed: int = 42, key: str = "ticket") -> DataFrame:
    """Per stratum: lot, sample size and the sampled tickets, largest lot first."""
    strata = stratify(df, columns).select("stratum", F.col(key).alias("__key"))
    lots = strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("lot_size")) \
        .withColumn("sample_n", sample_size("lot_size", p_reject, beta))
    sample = sample_per_group(strata, ["stratum"], lots, full_size(p_reject, beta), seed, "__key")
    tickets = sample.groupBy("stratum").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", F.col("__key").cast("string").alias("t")))),
        lambda s: s["t"]).alias("sample_tickets"))
    return lots.join(tickets, "stratum").orderBy(F.desc("lot_size"), "stratum")


def review_rows(df: DataFrame, stage: str) -> DataFrame:
    """What a reviewer sees per row: ``original`` and ``decision`` structs."""
    show = lambda c, empty="": F.coalesce(
        F.nullif(T.text(c), F.lit("")) if c in df.columns else F.lit(None), F.lit(empty)).alias(c)
    original = F.struct(*[show(c) for c in ("ticket", "topic", "subtopic", "description",
                                            "raw_address", "status")])
    shown = {
        "clean": [show(c) for c in ("category", "responsibility", "category_source", "resp_source",
                                    "confidence_details")],
        "geocode": [show(c) for c in ("street", "house", "lat", "lon", "addr_route", "precision")]
        + [show("geocode_method", "—")],
    }[stage]
    return df.select("ticket", original.alias("original"), F.struct(*shown).alias("decision"))


def curtailed_tally(verdicts: DataFrame) -> DataFrame:
    """Per stratum: rows reviewed and wrong, reading up to the first wrong one.

    ``verdicts``: stratum, position, verdict (correct, wrong, unsure). The first
    wrong position is one aggregate; nothing is ordered.
    """
    wrong = F.col("verdict") == "wrong"
    first = verdicts.groupBy("stratum").agg(
        F.min(F.when(wrong, F.col("position"))).alias("__stop"))
    return (
        verdicts.join(first, "stratum")
        .where(F.col("__stop").isNull() | (F.col("position") <= F.col("__stop")))
        .groupBy("stratum").agg(F.count_if(F.col("verdict") != "unsure").alias("reviewed"),
                                F.count_if(wrong).alias("defects"))
        .withColumn("verdict", F.when(F.col("defects") == 0, "pass").otherwise("fail")))


def acceptance_card(plan: DataFrame, tally: DataFrame, stage: str, timestamp: str,
                    p_reject: float = R.SPOT_P_REJECT, beta: float = R.BETA,
                    run_id: str = "") -> DataFrame:
    """One row: totals, verdict, claim and the strata as an array."""
    done = plan.join(tally, "stratum", "left").select(
        "stratum", "lot_size", "sample_n",
        F.coalesce("reviewed", F.lit(0)).alias("reviewed"),
        F.coalesce("defects", F.lit(0)).alias("defects"),
        F.coalesce("verdict", F.lit("pass")).alias("verdict"), "sample_tickets")
    card = done.agg(
        F.coalesce(F.bool_and(F.col("verdict") == "pass"), F.lit(True)).alias("passed"),
        F.coalesce(F.sum("lot_size"), F.lit(0)).alias("total_lot"),
        F.coalesce(F.sum("reviewed"), F.lit(0)).alias("total_reviewed"),
        F.coalesce(F.sum("defects"), F.lit(0)).alias("total_defects"),
        F.sort_array(F.collect_list(F.struct(
            "lot_size", "stratum", "sample_n", "reviewed", "defects", "verdict",
            "sample_tickets")), asc=False).alias("strata"))
    # The text of the claim must match.
    rate, sure = f"{p_reject * 100:.0f}%", f"{round((1 - beta) * 100)}%"
    start = F.concat(F.lit("נבדקו "), F.col("total_reviewed").cast("string"),
                     F.lit(" שורות מתוך "), F.format_number("total_lot", 0), F.lit(". "))
    claim = F.when(F.col("passed"), F.concat(start, F.lit(
        f"נמצאו 0 שגיאות. שיעור השגיאה נמוך מ-{rate} ברמת ביטחון {sure}."))) \
        .otherwise(F.concat(start, F.lit("נמצאו "), F.col("total_defects").cast("string"), F.lit(
            f" שגיאות. אי אפשר להבטיח ששיעור השגיאה נמוך מ-{rate}.")))
    return card.select(F.lit(stage).alias("stage"), F.lit(timestamp).alias("timestamp"),
                       F.lit(p_reject).alias("p_reject"), F.lit(beta).alias("beta"),
                       claim.alias("claim"), "passed", "total_lot", "total_reviewed",
                       "total_defects", "strata", F.lit(run_id).alias("run_id"))


def card_rows(card: DataFrame) -> DataFrame:
    """The card's strata as rows, with a total row last."""
    verdict = lambda passed: F.when(passed, "✅ עבר").otherwise("❌ נכשל").alias("verdict")
    strata = card.select(F.posexplode("strata").alias("pos", "s")).select(
        "pos", "s.stratum", "s.lot_size", "s.sample_n", "s.reviewed", "s.defects",
        verdict(F.col("s.verdict") == "pass"))
    total = card.select(
        F.size("strata").alias("pos"), F.lit("סה״כ").alias("stratum"),
        F.col("total_lot").alias("lot_size"), F.lit(None).cast("bigint").alias("sample_n"),
        F.col("total_reviewed").alias("reviewed"), F.col("total_defects").alias("defects"),
        verdict(F.col("passed")))
    return strata.unionByName(total).orderBy("pos")
