"""Recurring phrases in free text and the review questions they give."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.operators.ordered import sequence_in_group
from tidyward.session import broadcast_within, cut


def terms_of(words: str) -> Column:
    """The distinct words and bigrams of an array of words, with their length ``n``."""
    tag = lambda found, n: F.transform(F.array_distinct(found), lambda w: F.struct(
        F.lit(n).alias("n"), w.alias("term")))
    return F.concat(tag(F.col(words), 1), tag(T.ngrams(words), 2))


def row_terms(df: DataFrame, text: str, letters: str = T.HEBREW,
              stop_words=R.STOP_WORDS) -> DataFrame:
    """Add ``terms``: the distinct words and bigrams of each row."""
    return (df.withColumn("__words", T.tokens(text, letters, stop_words))
            .withColumn("terms", terms_of("__words")).drop("__words"))


def term_counts(df: DataFrame, group: str, text: str, letters: str = T.HEBREW,
                stop_words=R.STOP_WORDS) -> DataFrame:
    """Rows per group that hold each word or bigram: group, n, term, rows."""
    return (row_terms(df.select(group, text), text, letters, stop_words)
            .select(group, F.explode("terms").alias("__t"))
            .groupBy(group, "__t.n", "__t.term").agg(F.count(F.lit(1)).alias("rows")))


def _candidates(rows: DataFrame, group: str, minimum: DataFrame) -> DataFrame:
    """Terms that may name a group, with ``score``: bigrams count twice, covered words drop.

    A bigram is no more frequent than either of its words, so only bigrams of
    frequent words are counted at all.
    """
    def often(terms: DataFrame) -> DataFrame:
        return (terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("rows"))
                .join(minimum, group).where(F.col("rows") >= F.col("min_rows")))

    words = cut(often(rows.select(group, F.explode(F.array_distinct("__words")).alias("term"))))
    known = broadcast_within(words)
    pairs = rows.select(group, F.explode(F.array_distinct(T.ngrams("__words"))).alias("term"))
    for side in (1, -1):
        word = F.substring_index("term", " ", side)
        pairs = pairs.withColumn("__w", word).join(
            known.select(group, F.col("term").alias("__w")), [group, "__w"], "left_semi").drop("__w")
    bigrams = cut(often(pairs))
    covered = bigrams.select(group, F.explode(F.split("term", " ")).alias("term")).distinct()
    single = words.join(covered, [group, "term"], "left_anti")
    entry = lambda d, n, weight: d.select(
        group, F.lit(n).alias("n"), "term", "min_rows", (F.col("rows") * weight).alias("score"))
    return entry(bigrams, 2, 2).unionByName(entry(single, 1, 1))


def pattern_groups(df: DataFrame, group: str, row_id: str, text: str, minimum: DataFrame,
                   max_groups: int | None = None, letters: str = T.HEBREW,
                   stop_words=R.STOP_WORDS) -> tuple[DataFrame, DataFrame]:
    """Greedy disjoint groups of rows that share a phrase, ``max_groups`` at most if given.

    ``minimum``: group, min_rows. Candidates are taken by score; one is accepted if
    at least ``min_rows`` of its rows are still free, and takes them. Free rows only get
    fewer, so a candidate that has too few is out for good. A round settles many at once: all
    that stand first in each of their free rows, as nothing can take one of those, and the
    first ``WINDOW`` of a group whatever they share, from the counts of the sets of them that
    rows hold. So candidates that share no rows need one round together, however many they
    are, and a chain that does takes its length over ``WINDOW`` rounds. Only whether
    any is left reaches the driver.

    Rows are told apart by a number of their own, so ``row_id`` may repeat or be null.
    Texts are split into words once.

    Returns the groups (group, position, term, rows) and the assigned rows
    (group, row_id, position, term), one for each row.
    """
    base = cut(df.select(group, F.col(row_id).alias("__id"), F.monotonically_increasing_id().alias("__row"),
                         T.tokens(text, letters, stop_words).alias("__words")))
    found = _candidates(base.select(group, "__words"), group, minimum)
    chosen = cut(sequence_in_group(found.withColumn("__falling", -F.col("score")), [group],
                                   ["__falling", "term"], "rank").drop("__falling"))
    named = broadcast_within(chosen)
    # one row for each text and candidate, then the open candidates of each text in order
    terms = base.select(group, "__row", F.explode(terms_of("__words")).alias("__t")).select(
        group, "__row", "__t.n", "__t.term").join(named.select(group, "n", "term", "rank"), [group, "n", "term"])
    rows = cut(terms.groupBy(group, "__row").agg(F.array_sort(F.collect_list("rank")).alias("ranks")))
    least = broadcast_within(cut(minimum.select(group, "min_rows")))
    accepted, taken = [], []
    while True:
        alive = rows.select(group, F.posexplode("ranks").alias("__at", "rank")).groupBy(group, "rank").agg(
            F.count(F.lit(1)).alias("rows"), F.max(F.col("__at") > 0).alias("waits")).join(least, group).where(
            F.col("rows") >= F.col("min_rows"))
        if max_groups is not None and accepted:
            # behind the last group that is wanted nothing counts
            ends = _union(accepted).withColumn("__nth", F.row_number().over(
                Window.partitionBy(group).orderBy("rank"))).where(F.col("__nth") == max_groups)
            alive = alive.join(broadcast_within(cut(ends.select(group, F.col("rank").alias("__end")))), group, "left") \
                .where(F.col("__end").isNull() | (F.col("rank") < F.col("__end"))).drop("__end")
        alive = cut(alive)
        if alive.isEmpty():
            break
        free = alive.where(~F.col("waits")).select(group, "rank", "rows")
        fits = cut(free.unionByName(_settle(rows, alive, group)).distinct())
        accepted.append(fits)
        hit = cut(rows.select(group, "__row", F.explode("ranks").alias("rank"))
                  .join(broadcast_within(fits.select(group, "rank")), [group, "rank"])
                  .groupBy(group, "__row").agg(F.min("rank").alias("rank")))
        taken.append(hit)
        rows = cut(rows.join(hit.select("__row"), "__row", "left_anti"))
    if not accepted:
        accepted.append(cut(rows.select(group, F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint")
                                        .alias("rows")).limit(0)))
        taken.append(rows.select(group, "__row", F.lit(0).cast("bigint").alias("rank")).limit(0))
    order = sequence_in_group(_union(accepted), [group], ["rank"], "position")
    order = order.where(F.lit(True) if max_groups is None else F.col("position") <= max_groups)
    order = cut(order.withColumn("position", (F.col("position") - 1).cast("int"))
                .join(named.select(group, "rank", "term"), [group, "rank"]))
    assigned = (
        _union(taken).join(broadcast_within(order.select(group, "rank", "position", "term")), [group, "rank"])
        .join(base.select("__row", F.col("__id").alias(row_id)), "__row")
        .select(group, row_id, "position", "term"))
    return order.select(group, "position", "term", "rows"), assigned


#: Candidates of a group settled together; rows hold at most 2 ** WINDOW sets of them.
WINDOW = 14


def _settle(rows: DataFrame, alive: DataFrame, group: str) -> DataFrame:
    """Which of the first ``WINDOW`` candidates of each group are accepted: group, rank, rows."""
    nth = Window.partitionBy(group).orderBy("rank")
    first = cut(alive.withColumn("__nth", F.row_number().over(nth)).where(F.col("__nth") <= WINDOW)
                .groupBy(group).agg(F.first("min_rows").alias("min_rows"),
                                    F.array_sort(F.collect_list("rank")).alias("firsts")))
    sets = F.array_intersect("firsts", "ranks")
    counted = (rows.join(broadcast_within(first), group).withColumn("held", sets).where(F.size("held") > 0)
               .groupBy(group, "min_rows", "held").agg(F.count(F.lit(1)).alias("n")))

    def greedy(table: pd.DataFrame) -> pd.DataFrame:
        held = [frozenset(map(int, h)) for h in table["held"]]
        n, minimum, out = table["n"].tolist(), int(table["min_rows"].iloc[0]), []
        for rank in sorted(set().union(*held)):
            free = sum(k for h, k in zip(held, n) if rank in h)
            if free >= minimum:
                out.append((table[group].iloc[0], rank, free))
                left = [(h, k) for h, k in zip(held, n) if rank not in h]
                held, n = [h for h, _ in left], [k for _, k in left]
        return pd.DataFrame(out, columns=[group, "rank", "rows"])

    kind = rows.schema[group].dataType.simpleString()
    return counted.groupBy(group).applyInPandas(greedy, f"`{group}` {kind}, rank bigint, rows bigint")


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _examples(rows: DataFrame, keys: list[str], text: str, order: str, n: int) -> DataFrame:
    """Up to ``n`` non-blank texts per key, in a repeatable random order."""
    draw = F.md5(F.concat_ws("|", F.lit("42"), F.col(order).cast("string")))
    w = Window.partitionBy(*keys).orderBy(draw, order)
    return (rows.where(T.text(text) != "")
            .withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
            .groupBy(*keys).agg(F.transform(
                F.array_sort(F.collect_list(F.struct("__r", F.col(text).alias("t")))),
                lambda s: s["t"]).alias("samples")))


def unknown_subtopics(df: DataFrame) -> DataFrame:
    """Sub-topics no rule knows: value, rows, up to two example texts, most rows first."""
    open_rows = df.where((F.col("category_source") == "passthrough") & ~T.is_blank("subtopic")) \
        .select(T.strip("subtopic").alias("value"), "description", "ticket")
    counts = open_rows.groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    first = Window.partitionBy("value").orderBy("ticket", "description")
    examples = (
        open_rows.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= 2)
        .where(T.text("description") != "")
        .groupBy("value").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("__r", F.col("description").alias("t")))),
            lambda s: s["t"]).alias("examples")))
    return counts.join(examples, "value", "left").orderBy(F.desc("rows"), "value")


def responsibility_clusters(df: DataFrame, rules: R.Rules = R.MUNICIPAL, letters: str = T.HEBREW,
                            stop_words=R.STOP_WORDS, first_groups: int | None = 12,
                            second_groups: int | None = 6, samples: int = 4) -> tuple[DataFrame, DataFrame]:
    """Questions about rows whose responsibility is still open.

    A review asks about the first ``first_groups`` and ``second_groups`` phrases of a
    category (None: all) and shows ``samples`` texts of each. Rows count, not tickets: these may
    be blank or repeat.

    Returns the categories (category, total, unresolved, remainder, samples) and
    their phrase groups (category, sweep, position, term, rows, samples). A second
    sweep looks at the rows the first left over.
    """
    unresolved = F.col("resp_source") == "unresolved" if "resp_source" in df.columns \
        else F.col("responsibility") == R.UNKNOWN_RESP
    # every sweep reads these rows again, so they are computed once
    cats = cut(df.where(F.col("category").isin(rules.ambiguous)).select(
        "category", "ticket", F.coalesce("description", F.lit("")).alias("description"),
        unresolved.alias("open"), F.monotonically_increasing_id().alias("__no")))
    sizes = cut(cats.groupBy("category")
                .agg(F.count(F.lit(1)).alias("total"), F.count_if("open").alias("unresolved"))
                .where("total >= 3 AND unresolved >= 5"))
    # the categories are those of the fixed rules
    pool = cats.where("open").join(F.broadcast(sizes.select("category")), "category", "left_semi") \
        .withColumn("__key", F.concat_ws("|", "ticket", "description")).drop("open")

    def sweep(rows: DataFrame, counts: DataFrame, divisor: int, groups: int):
        minimum = counts.select("category", F.greatest(
            F.lit(3).cast("bigint"), F.floor(F.col("n") / divisor)).alias("min_rows"))
        return pattern_groups(rows, "category", "__no", "description", minimum, groups,
                              letters, stop_words)

    first, taken = sweep(pool, sizes.select("category", F.col("unresolved").alias("n")), 80, first_groups)
    taken = cut(taken)
    left = pool.join(taken.select("__no"), "__no", "left_anti")
    left_sizes = cut(left.groupBy("category").agg(F.count(F.lit(1)).alias("n")).where("n >= 10"))
    rest = left.join(left_sizes.select("category"), "category", "left_semi")
    second, taken_again = sweep(rest, left_sizes, 40, second_groups)
    taken = taken.withColumn("sweep", F.lit(1)).unionByName(
        cut(taken_again).withColumn("sweep", F.lit(2)))
    groups = first.withColumn("sweep", F.lit(1)).unionByName(second.withColumn("sweep", F.lit(2)))
    where = ["category", "sweep", "position"]
    shown = _examples(pool.join(taken.drop("category"), "__no"), where, "description", "__key", samples)
    groups = groups.join(shown, where, "left") \
        .select("category", "sweep", "position", "term", "rows", "samples")
    loose = pool.join(taken.select("__no"), "__no", "left_anti")
    used = taken.groupBy("category").agg(F.count(F.lit(1)).alias("__used"))
    categories = (
        sizes.join(used, "category", "left")
        .withColumn("remainder", F.col("unresolved") - F.coalesce("__used", F.lit(0)))
        .drop("__used")
        .join(_examples(loose, ["category"], "description", "__key", samples), "category", "left")
        .orderBy(F.desc("unresolved"), "category"))
    return categories, groups
