"""Reviewer answers, overrides and manual coordinates applied as joined tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidyward import rules as R, session
from tidyward.functions import text as T
from tidyward.operators import windows as W
from tidyward.operators.clean import confidence_of, keyword_label, with_responsibility
from tidyward.session import BROADCAST_BYTES, cut, join_known, pinned, stored

SKIPPED = ["__skip__", "", "nan"]
OPEN = "unresolved"
KINDS = ["street", "subtopic", "resp_term", "resp_default", "resp_sub", "resp_unmatched", "resp"]


def _per_key(answers: DataFrame, kind: str, key: str) -> DataFrame:
    """The last given answer per key."""
    return (answers.where(F.col("kind") == kind)
            .groupBy(F.col(key).alias("__key"))
            .agg(F.max_by("answer", "seq").alias("__answer")))


def _label_lists(answers: DataFrame, kind: str, labels: list[str]) -> DataFrame:
    """Per category, its (seq, term, answer) entries in order, the last one of each term.

    Only terms among ``labels`` can be asked for, so no list is longer than the rule set.
    """
    return (answers.where((F.col("kind") == kind) & F.col("term").isin(labels))
            .groupBy("category", "term")
            .agg(F.max_by("answer", "seq").alias("answer"), F.max("seq").alias("seq"))
            .groupBy(F.col("category").alias("__key"))
            .agg(F.array_sort(F.collect_list(F.struct("seq", "term", "answer"))).alias("__terms")))


#: Tables that go to every task are at most this many bytes as text: the driver holds each in several copies.
INDEX_BYTES = 4 << 20
#: The shortest terms, up to this many, are looked up where the texts are: they stand in the most texts.
CARRIED = 10_000


def fits(table: DataFrame) -> bool:
    return session.fits(table, INDEX_BYTES)


def _shuffled(table: DataFrame) -> DataFrame:
    """A join side that is never broadcast, whatever the planner takes its size to be."""
    return table.hint("merge")


def term_hits(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per distinct (category, description) of ``rows`` that contains a term of its category:
    category, description and the answer of the smallest ``seq`` among those terms (equal ones: the
    smallest term, then answer).

    ``terms``: seq, category, term, answer. Empty terms, and null categories, terms and descriptions, match
    nothing. The shortest terms go to every task. Of the others a set of bits does: every stretch of a description
    that is as long as some term is looked up in it, and only stretches that it lets through are rows, a few more than
    there are hits. Of the terms, only those move that a set of bits of these stretches lets through.
    """
    key = F.xxhash64("category", "term")
    terms = terms.where((F.col("term") != "") & F.col("category").isNotNull()).select("seq", "category", "term", "answer")
    size = F.octet_length("term")
    # a row for each length
    counts = sorted(map(tuple, terms.groupBy(size).agg(F.count(F.lit(1)), F.approx_count_distinct(key)).collect()))
    if not counts:
        return rows.select("category", "description", F.lit(None).cast("string").alias("answer")).limit(0)
    upto, room = 0, CARRIED
    for n, _, kinds in counts:
        room -= kinds
        if room < 0:
            break
        upto = n
    best = lambda df, *keys: df.groupBy(*keys, "category", "term").agg(F.min(F.struct("seq", "answer")).alias("v")).select(
        *keys, "category", "term", "v.*")                                   # noqa: E731
    short = cut(best(terms.where(size <= upto).withColumn("key", key), "key"))
    # two terms of one key would need a list each
    if not fits(short) or short.select("key").distinct().count() < short.count():
        short, upto = short.limit(0), 0
    rest = terms.where(size > upto)
    lengths = [n for n, _, _ in counts]
    longer = [n for n in lengths if n > upto]
    many = sum(n for of, n, _ in counts if of > upto)

    sc = rows.sparkSession.sparkContext
    starts = terms.select(F.explode(W.prefix_keys("category", "term", lengths[-1])).alias("key")).distinct()
    bits = sc.broadcast(W.bits_of(starts.union(rest.select(key.alias("key"))), 5 * many // 4 + 10 * CARRIED))
    texts = rows.where((F.col("description") != "") & F.col("category").isNotNull()).select(
        "category", "description").distinct().withColumn("seed", F.xxhash64("category"))
    kind = {f.name: f.dataType.simpleString() for f in terms.schema.fields}
    found = texts.mapInArrow(
        W.finder(short.orderBy("seq", "term", "answer").toArrow(), [n for n in lengths if n <= upto], longer, bits),
        f"category string, description string, key bigint, seq {kind['seq']}, term string, answer {kind['answer']}")
    if not longer:
        return found.select("category", "description", "answer")

    found = stored(found)
    asked = found.where(F.col("key").isNotNull()).select("category", "description", "key")
    met = sc.broadcast(W.bits_of(asked.select("key"), asked.count()))
    own = best(rest.withColumn("key", key).where(W.among("key", met)), "key")
    hits = asked.join(_shuffled(own), ["key", "category"]).where(F.contains("description", "term"))
    columns = ["category", "description", "seq", "term", "answer"]
    return (found.where(F.col("key").isNull()).select(*columns).union(hits.select(*columns))
            .groupBy("category", "description").agg(F.min(F.struct("seq", "term", "answer")).alias("v"))
            .select("category", "description", "v.answer"))


SALTS = 16


def _beside(df: DataFrame, table: DataFrame, key: str, small: bool) -> DataFrame:
    """Left join with a table of one row per ``key``.

    One that is too large to broadcast is repeated under salts, so that the rows of a key spread.
    """
    table = table.withColumnRenamed("__key", key)
    if small:
        return df.join(F.broadcast(table), key, "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (df.withColumn("__salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
            .join(table.withColumn("__salt", salts), [key, "__salt"], "left").drop("__salt"))


def _set(df: DataFrame, hit, source: str) -> DataFrame:
    return df.withColumns({
        "responsibility": F.when(hit, F.col("__answer")).otherwise(F.col("responsibility")),
        "resp_source": F.when(hit, source).otherwise(F.col("resp_source")),
    }).drop("__answer")


def rerun_keywords(df: DataFrame, rules: R.Rules = R.MUNICIPAL) -> DataFrame:
    """Resolve still-open rows by category and keyword again."""
    df = with_responsibility(df, "description", rules, "__resp", "__how")
    again = F.when((F.col("resp_source") == OPEN) & (F.col("__resp") != R.UNKNOWN_RESP),
                   F.col("__resp"))
    return df.withColumn("__again", again).drop("__resp", "__how").withColumns({
        "responsibility": F.coalesce("__again", "responsibility"),
        "resp_source": F.when(F.col("__again").isNotNull(),
                              F.concat(F.lit("keyword:"), F.col("__again")))
            .otherwise(F.col("resp_source")),
    }).drop("__again")


def recompute_confidence(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", confidence_of())


def apply_answers(df: DataFrame, answers: DataFrame, rules: R.Rules = R.MUNICIPAL) -> DataFrame:
    """Apply answers by kind in a fixed order, then re-tier every row.

    ``answers``: seq, kind, category, term, answer. Kinds: ``street`` and
    ``subtopic`` (old value in ``term``), ``resp_term``, ``resp_default``, and the
    older ``resp_sub`` (keyword label in ``term``), ``resp_unmatched``, ``resp``.
    Skipped answers do nothing.
    """
    given = cut(answers.where(F.col("kind").isin(KINDS) & F.col("answer").isNotNull()
                              & ~T.strip("answer").isin(SKIPPED)))
    # each kind's table is a part of its answers, measured here: a row per kind
    bytes_of = dict(given.groupBy("kind").agg(
        F.sum(F.octet_length(F.to_json(F.struct("*"))))).collect())
    small = {kind: bytes_of.get(kind, 0) <= BROADCAST_BYTES for kind in KINDS}
    df = rerun_keywords(df, rules)

    df = (_beside(df, _per_key(given, "street", "term"), "street", small["street"])
          .withColumn("street", F.coalesce("__answer", "street")).drop("__answer"))

    df = _beside(df, _per_key(given, "subtopic", "term"), "subtopic", small["subtopic"])
    hit = F.col("__answer").isNotNull()
    df = df.withColumns({
        "category": F.coalesce("__answer", "category"),
        "category_source": F.when(hit, "user_map").otherwise(F.col("category_source")),
    })
    df = with_responsibility(df, "description", rules, "__resp", "__how")
    df = df.withColumns({
        "responsibility": F.when(hit, F.col("__resp")).otherwise(F.col("responsibility")),
        "resp_source": F.when(hit, F.col("__how")).otherwise(F.col("resp_source")),
    }).drop("__answer", "__resp", "__how")

    if "resp_term" in bytes_of:
        open_text = F.when(F.col("resp_source") == OPEN, F.col("description"))
        hits = pinned(term_hits(df.where(F.col("resp_source") == OPEN), given.where(F.col("kind") == "resp_term")))
        df = join_known(df.withColumn("__text", open_text), hits.select(
            "category", F.col("description").alias("__text"), F.col("answer").alias("__answer")),
            ["category", "__text"]).drop("__text")
        df = _set(df, F.col("__answer").isNotNull(), "user_resp_term")

    by_category = lambda df, kind: _beside(df, _per_key(given, kind, "category"), "category", small[kind])
    df = by_category(df, "resp_default")
    df = _set(df, F.col("__answer").isNotNull() & (F.col("resp_source") == OPEN),
              "user_resp_default")

    labels = _label_lists(given, "resp_sub", list(rules.keywords))
    hits = F.array_compact(F.array(*[
        F.when(T.has_any("description", words), label)
        for label, words in rules.keywords.items()]))
    df = _beside(df, labels, "category", small["resp_sub"]).withColumn("__hits", hits)
    named = lambda t: F.array_contains(F.col("__hits"), t["term"])
    df = df.withColumn("__answer", F.try_element_at(
        F.filter("__terms", named), F.lit(-1))["answer"]).drop("__terms", "__hits")
    df = _set(df, F.col("__answer").isNotNull(), "user_resp_kw")

    df = by_category(df, "resp_unmatched")
    df = _set(df, F.col("__answer").isNotNull()
              & keyword_label("description", rules.keywords).isNull(), "user_resp_unmatched")

    df = by_category(df, "resp")
    df = _set(df, F.col("__answer").isNotNull() & (F.col("responsibility") == R.UNKNOWN_RESP),
              "user_resp")
    return recompute_confidence(df)


OVERRIDABLE = ["category", "responsibility", "street", "house"]


def apply_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Set single columns of single tickets; ``overrides``: seq, ticket, field, value.

    The last value per ticket and field wins. The field ``review`` marks the
    ticket for review instead.
    """
    value = F.coalesce("value", F.lit(""))
    # only what can change a row is stripped and sorted into tickets
    given = T.once(
        overrides.where(((F.col("field").isin(OVERRIDABLE)) & (value != "")) | (F.col("field") == "review"))
        .select("seq", "ticket", "field", "value"), {"ticket": T.text("ticket")}).where(F.col("ticket") != "")
    last = given.groupBy("ticket").agg(*[
        F.max_by(F.when(F.col("field") == f, F.col("value")),
                 F.when((F.col("field") == f) & (value != ""), F.col("seq"))).alias(f"__{f}")
        for f in OVERRIDABLE
    ], F.bool_or(F.col("field") == "review").alias("__review"))
    df = df.join(last, "ticket", "left")
    review = F.coalesce("__review", F.lit(False))
    changes = {f: F.coalesce(f"__{f}", f) for f in OVERRIDABLE}
    changes["category_source"] = F.when(F.col("__category").isNotNull(), "user_override") \
        .otherwise(F.col("category_source"))
    changes["resp_source"] = F.when(review, "manual_review") \
        .when(F.col("__responsibility").isNotNull(), "user_override") \
        .otherwise(F.col("resp_source"))
    changes["confidence"] = F.when(review, "low").otherwise(F.col("confidence"))
    return df.withColumns(changes).drop("__review", *[f"__{f}" for f in OVERRIDABLE])


def parse_coordinate_lines(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """Lines ``ticket,lat,lon`` to one row per ticket; bad lines drop, the last one wins."""
    parts = F.transform(F.split(F.col(line), ","), lambda p: T.strip(p))
    number = lambda i: F.get("__p", F.lit(i)).try_cast("double")
    return (
        lines.withColumn("__p", parts).where(F.size("__p") == 3)
        .select(F.get("__p", F.lit(0)).alias("ticket"), number(1).alias("lat"),
                number(2).alias("lon"), F.col(order).alias("__o"))
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy("ticket").agg(F.max_by(F.struct("lat", "lon"), "__o").alias("__v"))
        .select("ticket", "__v.lat", "__v.lon"))


def _pin(df: DataFrame, lat, lon, hit) -> DataFrame:
    return df.withColumns({
        "lat": F.when(hit, lat).otherwise(F.col("lat")),
        "lon": F.when(hit, lon).otherwise(F.col("lon")),
        "geocode_method": F.when(hit, "manual").otherwise(F.col("geocode_method")),
        "precision": F.when(hit, "address").otherwise(F.col("precision")),
    })


def upsert_coordinates(df: DataFrame, points: DataFrame) -> DataFrame:
    """Write the points of ``points`` (ticket, lat, lon) over the rows with that ticket."""
    new = points.select("ticket", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    df = df.join(new, "ticket", "left")
    return _pin(df, F.col("__lat"), F.col("__lon"), F.col("__lat").isNotNull()) \
        .drop("__lat", "__lon")


def apply_manual_edits(df: DataFrame, edits: DataFrame, order: str = "seq") -> DataFrame:
    """Write edited rows (ticket, lat, lon, street, house) back; houses lose unit suffixes.

    Of several edits of a ticket the one with the largest ``order`` counts (without such
    a column, the largest row). Blank tickets name no row. A row with both coordinates
    becomes ``manual``.
    """
    value = F.struct(
        T.to_number("lat").alias("lat"), T.to_number("lon").alias("lon"),
        F.col("street").alias("street"), T.strip_unit("house").alias("house"))
    rank = F.struct(F.col(order), value) if order in edits.columns else value
    new = edits.where(T.text("ticket") != "").groupBy("ticket").agg(
        F.max_by(value, rank).alias("__v")).select(
        "ticket", F.col("__v.lat").alias("__lat"), F.col("__v.lon").alias("__lon"),
        F.col("__v.street").alias("__street"), F.col("__v.house").alias("__house"),
        F.lit(True).alias("__edited"))
    df = df.join(new, "ticket", "left")
    edited = F.coalesce("__edited", F.lit(False))
    both = F.col("__lat").isNotNull() & F.col("__lon").isNotNull()
    df = df.withColumns({
        "lat": F.when(edited, F.col("__lat")).otherwise(F.col("lat")),
        "lon": F.when(edited, F.col("__lon")).otherwise(F.col("lon")),
        "street": F.when(edited, F.col("__street")).otherwise(F.col("street")),
        "house": F.when(edited, F.col("__house")).otherwise(F.col("house")),
        "geocode_method": F.when(edited & both, "manual").otherwise(F.col("geocode_method")),
        "precision": F.when(edited & both, "address").otherwise(F.col("precision")),
    })
    return df.drop("__lat", "__lon", "__street", "__house", "__edited")
