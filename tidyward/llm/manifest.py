"""Merkle manifest of a table: a digest for each row, each group and the whole, with proofs.

Rows are leaves, numbered in their group; every run of ``fanout`` consecutive nodes becomes
one node of the next level, until a group has one node, its subroot. Subroots in the order
of their groups are the leaves of a tree of the same kind, which gives the root.

A level is an equi-join of the level's nodes with themselves: the node at slot 0 of a run
asks for the nodes at its computed sibling indices (its own plus 0 .. fanout - 1; with two
slots that is index XOR 1) and, being at slot 0, emits the parent. Keys are (tree, index),
which no two nodes share, so a group that holds most of the rows is no hot key. Levels
are stored as runs, so a node takes its siblings from its run, one row for ``fanout`` nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidyward.llm.common import number_rows, store
from tidyward.session import broadcast_within

STEPS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value as text that no other value has: ``-`` if null, else UTF-8 bytes, ``:``, value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Hex sha256 of the values of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(siblings, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_text(siblings: Column) -> Column:
    """Digests of all siblings, level by level, left to right."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["before"], s["after"])), "")


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                    group_col: str = "source", id_col: str = "doc_id", fanout: int = 16,
                    carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, group, leaf, subroot, root, siblings, and the columns of ``carry``.

    siblings holds, from the leaf's level up to the root, the digests before and after the
    node in its run, as hex text. A run of one node has none, but is hashed all the same; a
    group of one row is its own subroot, a table of one group has its subroot as root.
    Leaves ascend by id (null first), rows of equal ids by digest, equal rows in scan
    order; groups ascend bytewise, null first. Fields that are null count as such,
    empty ones don't. ``carry`` names expressions over ``docs`` that are computed in the
    same scan; other columns of ``docs`` are ignored, so none can clash. Texts are read
    once and never shuffled. An empty table gives no rows.
    """
    own = {"id", "group", "leaf", "subroot", "root", "siblings"}
    carry = carry or {}
    if clash := (own | {id_col, group_col}) & set(carry):
        raise ValueError(f"carry must not use the names {sorted(clash)}")
    extra = [f"__{c}" for c in carry]
    leaves = store(docs.select(
        F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf_digest(*map(F.col, fields)).alias("leaf"),
        *[e.alias(f"__{c}") for c, e in carry.items()], F.monotonically_increasing_id().alias("scan")))
    rows, _ = number_rows(leaves, ["group", "id", "leaf", "scan"])
    rows = store(rows)
    trees, count = number_rows(rows.groupBy("group").agg(
        F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), ["group"], "tree")
    trees = broadcast_within(store(trees).withColumnRenamed("group", "of"))
    nodes = store(rows.join(trees, F.col("group").eqNullSafe(F.col("of"))).select(
        "id", "group", "leaf", *extra, "tree", (F.col("row") - F.col("first")).alias("at"), "n"))

    levels, subroots = _climb(nodes.select("tree", "at", F.col("leaf").alias("digest"), "n"), fanout)
    subroots = store(subroots)
    tops = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), "digest",
                           F.lit(count).cast("bigint").alias("n"))
    high, roots = _climb(tops, fanout)
    seeds = roots.select("tree", F.col("digest").alias("root"), F.array().cast(STEPS).alias("above"))
    seeds = store(_with_siblings(tops, high, seeds, ["root"], fanout).select(
        F.col("at").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("siblings").alias("above")))
    return _with_siblings(nodes, levels, seeds, ["subroot", "root"], fanout).select(
        F.col("id").alias(id_col), F.col("group").alias(group_col), "leaf", "subroot", "root", "siblings",
        *[F.col(f"__{c}").alias(c) for c in carry])


def _climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs (tree, run, n, digests) of each level, and the last node (tree, digest) of each tree.

    ``nodes`` (tree, at, digest, n): n nodes of each tree, at 0 .. n - 1. The driver gets
    one number, the size of the largest tree.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], nodes.filter("n = 1").select("tree", "digest")
    while most > 1:
        live = nodes.filter("n > 1").select("tree", "at", "digest", "n")
        zero = live.filter(F.col("at") % fanout == 0)
        wanted = zero.select("tree", "n", F.col("at").alias("zero"), F.explode(
            F.sequence(F.lit(0), F.lit(fanout - 1))).alias("slot")).withColumn(
            "at", F.col("zero") + F.col("slot")).filter("at < n")
        # at most ``fanout`` digests meet at a slot 0
        runs = wanted.join(live.select("tree", "at", "digest"), ["tree", "at"]).groupBy("tree", "zero", "n").agg(
            F.array_sort(F.collect_list(F.struct("slot", "digest"))).alias("nodes")).select(
            "tree", (F.col("zero") / fanout).cast("bigint").alias("run"), "n",
            F.col("nodes.digest").alias("digests"))
        levels.append(store(runs))
        nodes = levels[-1].select("tree", F.col("run").alias("at"), F.sha2(F.array_join("digests", ""), 256).alias(
            "digest"), F.ceil(F.col("n") / fanout).alias("n"))
        roots = roots.union(nodes.filter("n = 1").select("tree", "digest"))
        most = -(-most // fanout)
    return levels, roots


def _step(digests: str, slot: Column) -> Column:
    """What stands before and after a slot of a run."""
    return F.struct(F.array_join(F.slice(digests, F.lit(1), slot), "").alias("before"),
                    F.array_join(F.slice(digests, slot + 2, F.size(digests)), "").alias("after"))


def _with_siblings(nodes: DataFrame, levels: list[DataFrame], seeds: DataFrame, also: list[str],
                   fanout: int) -> DataFrame:
    """``nodes`` with siblings and the columns ``also`` of ``seeds`` (tree, above, ...).

    Runs are joined to their parent's run from the top down; the top run of a tree, or its
    only node, goes on with the tree's seed.
    """
    upper = None
    slot = (F.col("run") % fanout).cast("int")
    for runs in reversed(levels):
        found = runs.filter(F.col("n") <= fanout).join(seeds, "tree").select("tree", "run", "digests", "above", *also)
        if upper is not None:
            parents = upper.select("tree", F.col("run").alias("up"), F.col("digests").alias("up_digests"),
                                   F.col("above").alias("up_above"), *also)
            found = found.unionByName(runs.filter(F.col("n") > fanout).withColumn(
                "up", F.floor(F.col("run") / fanout)).join(parents, ["tree", "up"]).select(
                "tree", "run", "digests", F.concat(F.array(_step("up_digests", slot)), "up_above").alias("above"), *also))
        upper = found
    alone = nodes.filter("n = 1").join(seeds, "tree").withColumnRenamed("above", "siblings")
    if upper is None:
        return alone
    at = (F.col("at") % fanout).cast("int")
    return alone.unionByName(nodes.filter("n > 1").withColumn("run", F.floor(F.col("at") / fanout)).join(
        upper, ["tree", "run"]).withColumn("siblings", F.concat(F.array(_step("digests", at)), "above")).drop(
        "run", "digests", "above"))
