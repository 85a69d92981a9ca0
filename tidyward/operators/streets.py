"""Street names: fuzzy matching, code resolution, spelling variants.

Everything here runs on distinct names, never on the rows that carry them.
"""

from __future__ import annotations

import difflib
import functools
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from tidyward import rules as R
from tidyward.functions import text as T
from tidyward.session import broadcast_within, cut

# -- close matches ------------------------------------------------------------


def sequence_ratio(candidate: str, name: str) -> Column:
    """The standard library's matching ratio, for pairs that may reach the cutoff."""

    # defined in here so that workers receive the code itself, not an import
    @pandas_udf(DoubleType())
    def ratio(candidate: pd.Series, name: pd.Series) -> pd.Series:
        matcher = difflib.SequenceMatcher()
        out = []
        for c, n in zip(candidate, name):
            if matcher.b != n:
                matcher.set_seq2(n)
            matcher.set_seq1(c)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    return ratio(candidate, name)


def nfc(name: str) -> Column:
    """The canonical composed form of a name."""

    @pandas_udf(StringType())
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    return compose(name)


def numbered_tokens(name: str) -> Column:
    """A name's letters (c) and pairs of neighbouring letters (g), each with its number among equal ones."""

    @pandas_udf(ArrayType(StringType()))
    def tokens(names: pd.Series) -> pd.Series:
        out = []
        for v in names:
            seen, row = {}, []
            for part in ["c" + c for c in v] + ["g" + v[i:i + 2] for i in range(len(v) - 1)]:
                seen[part] = seen.get(part, 0) + 1
                row.append(f"{part}{seen[part]}")
            out.append(row)
        return pd.Series(out, dtype=object)

    return tokens(name)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _name_tokens(names: DataFrame, spread: bool = False) -> DataFrame:
    """Each distinct ``name`` with its numbered letters (kind c) and pairs of neighbouring letters
    (kind g): rows name, token.

    Two names share as many tokens of a kind as they share letters or pairs, counting repeats. With ``spread``
    names stay in as many partitions as a shuffle has: they are few bytes, but give dozens of rows.
    """
    if spread:
        names = names.repartition(_partitions(names), "name")
    return names.select("name").where(F.col("name") != "").distinct().select(
        "name", F.explode(numbered_tokens("name")).alias("token"))


class CloseNames:
    """What a ratio of at least ``cutoff`` demands of two names.

    The ratio is 2 M / T: M letters in common blocks, T letters in all. So 2 M >= cutoff T letters
    are shared. Between two blocks stands a letter outside of them, so there are at
    most T - 2 M + 1 blocks, and within blocks 3 M - T - 1 pairs of neighbours are shared:
    at least (1.5 cutoff - 1) T - 1. Pairs are told by far more values than letters, so
    they find partners wherever at least one must be shared; letters do for the rest.
    """

    def __init__(self, cutoff: float):
        self.cutoff = cutoff
        self.stretch = (2 - cutoff) / cutoff        # no partner is longer by a larger factor
        self.per_letter = 1.5 * cutoff - 1
        # the shortest name of which every partner shares a pair
        total = 2 / (2 - cutoff)                    # T is at least this many times a name's length
        self.by_pairs = math.floor(1 / (self.per_letter * total) + 1e-9) + 1 if self.per_letter > 0 else None

    def prefix_length(self, length: Column, kind: str) -> Column:
        """How many of its rarest tokens hold one that each partner has as well."""
        least = length * F.lit(2 / (2 - self.cutoff))
        if kind == "c":
            return length - F.ceil(least * F.lit(self.cutoff / 2) - F.lit(1e-9)).cast("int") + 1
        return length - 1 - F.ceil(least * F.lit(self.per_letter) - F.lit(1 + 1e-9)).cast("int") + 1

    def uses(self, length: Column, kind: str) -> Column:
        if self.by_pairs is None:
            return F.lit(kind == "c")
        return length >= self.by_pairs if kind == "g" else length < self.by_pairs * self.stretch

    def band(self, length: Column) -> Column:
        """Partners stand in the same band of lengths or in one next to it."""
        return F.floor(F.log(length.cast("double")) / F.lit(math.log(self.stretch * (1 + 1e-9))))

    def enough(self, shared: Column, total: Column, kind: str) -> Column:
        """Whether ``shared`` tokens of a kind allow the ratio."""
        if kind == "c":
            return shared * 2.0 / total >= self.cutoff
        return shared >= total * F.lit(self.per_letter) - F.lit(1 + 1e-9)


#: Bits of a name's set of tokens of one kind, and pairs that are looked at together.
TOKEN_BITS, CHUNK = 512, 1 << 19


def met_pairs(cutoff: float):
    """The pairs (a, b) of two Arrow tables' names that share a key and may reach ``cutoff``, each once.

    The tables hold key, name, behind (tokens after the key's in the name's order) and paired (whether the
    key's token is a pair of letters). Names are compared as sets of bits, one for each numbered letter or pair: a bit
    that the other name lacks is a token that isn't shared. Bits that stand for several tokens only loosen this.
    """
    per_letter, bits, chunk = CloseNames(cutoff).per_letter, TOKEN_BITS, CHUNK

    # defined in here so that workers receive the code itself, not an import
    def compare(left, right):
        import numpy as np
        import pyarrow as pa

        def sets(values, owner, n):
            order = np.lexsort((values, owner))
            values, owner, each = values[order], owner[order], np.arange(len(order))
            new = np.ones(len(order), bool)
            new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
            number = each - np.maximum.accumulate(np.where(new, each, 0))
            kinds = np.unique(values, return_inverse=True)[1] * (number.max(initial=0) + 1) + number
            bit = np.unique(kinds, return_inverse=True)[1] % bits
            out = np.zeros(n * (bits // 64), np.uint64)
            np.bitwise_or.at(out, owner * (bits // 64) + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
            return out.reshape(n, -1)

        def shared(of, size, a, b):
            x, y = of[a], of[b]
            both = x & y
            return np.minimum(size[a] - np.bitwise_count(x ^ both).sum(1, dtype=np.int32),
                              size[b] - np.bitwise_count(y ^ both).sum(1, dtype=np.int32))

        column = lambda t, name: t[name].to_numpy()                 # noqa: E731
        coded = pa.chunked_array([*left["name"].chunks, *right["name"].chunks], left["name"].type) \
            .combine_chunks().dictionary_encode()
        names, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        n = len(names)
        size = np.fromiter(map(len, names), np.int64, n)
        points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(n), size)
        beside = owner[1:] == owner[:-1]
        letters = sets(points, owner, n)
        pairs = sets((points[:-1] << 21 | points[1:])[beside], owner[1:][beside], n)

        a, b = ids[:left.num_rows], ids[left.num_rows:]
        rank = np.unique(np.concatenate([column(left, "key"), column(right, "key")]), return_inverse=True)[1]
        rank_a, rank_b, wide = rank[:len(a)], rank[len(a):], size.max(initial=0) + 1
        order = np.argsort(rank_b * wide + size[b], kind="stable")
        b, behind_b, places = b[order], column(right, "behind")[order], (rank_b * wide + size[b])[order]
        behind_a, paired = column(left, "behind"), column(left, "paired").astype(bool)
        stretch = (2 - cutoff) / cutoff
        within = lambda length: rank_a * wide + np.clip(length, 0, wide - 1).astype(np.int64)
        first = np.searchsorted(places, within(np.floor(size[a] / stretch)))
        many = np.searchsorted(places, within(np.ceil(size[a] * stretch)), "right") - first
        ends, found, at = np.cumsum(many), [np.zeros(0, np.int64)], 0
        while at < len(a):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + chunk, "right")))
            i = np.repeat(np.arange(at, to), many[at:to])
            j = np.arange(len(i)) + np.repeat((first - ends + many)[at:to] + done, many[at:to])
            total = size[a[i]] + size[b[j]]
            # at the first shared token, only it and what stands behind it can be shared
            after = 1 + np.minimum(behind_a[i], behind_b[j])
            may = (np.minimum(size[a[i]], size[b[j]]) * 2.0 / total >= cutoff) & np.where(
                paired[i], after >= total * per_letter - (1 + 1e-9), after * 2.0 / total >= cutoff)
            x, y, total = a[i[may]], b[j[may]], total[may]
            may = shared(letters, size, x, y) * 2.0 / total >= cutoff
            x, y, total = x[may], y[may], total[may]
            may = shared(pairs, np.maximum(size - 1, 0), x, y) >= total * per_letter - (1 + 1e-9)
            found.append(np.unique(x[may] * n + y[may]))
            at = to
        out = np.unique(np.concatenate(found))
        take = lambda index: coded.dictionary.take(pa.array(index)).cast(pa.string())            # noqa: E731
        return pa.table({"a": take(out // max(n, 1)), "b": take(out % max(n, 1))})

    return compare


class Arranged:
    """The tokens of a corpus's entries, rarest first, and how often each stands in it."""

    def __init__(self, corpus: DataFrame, spread: bool = False):
        tokens = cut(_name_tokens(corpus, spread))
        self.frequency = broadcast_within(cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often"))))
        self.entries = cut(self.of(tokens, spread))

    def of(self, tokens: DataFrame, spread: bool = False) -> DataFrame:
        """Rows name, g, c: the tokens of both kinds in the order of the corpus."""
        if spread:
            tokens = tokens.repartition(_partitions(tokens), "name")
        kinds = {k: F.sort_array(F.collect_list(F.when(F.col("token").startswith(k), F.struct(
            F.coalesce("often", F.lit(0)).alias("often"), "token")))) for k in "gc"}
        return tokens.join(self.frequency, "token", "left").groupBy("name").agg(
            *[kinds[k]["token"].alias(k) for k in "gc"])


def close_candidates(names: DataFrame, corpus: DataFrame, cutoff: float, share: int = 256,
                     spread: bool = False, arranged: Arranged | None = None) -> DataFrame:
    """Pairs (a, b) of a name and a corpus entry that may reach ``cutoff``, each once.

    Tokens are ordered by their measured frequency in the corpus, rarest first, and
    names meet their partners on (token, band of lengths, salt). Keys that hold more than one in ``share``
    of the corpus's rows are salted. Of each shared token, its place in both names bounds what
    can be shared after it; lengths, shared letters and shared pairs bound the ratio (``met_pairs``). Rows are dealt by
    key to parts; only the names move, and pairs are made where they are judged. With ``spread`` the
    rows stay in as many partitions as a shuffle has. ``arranged``: the corpus's tokens, if they are known already.
    """
    rule = CloseNames(cutoff)
    arranged = arranged or Arranged(corpus, spread)

    def keyed(rows: DataFrame) -> DataFrame:
        """A row for each token of a name's prefix: name, band, token, behind, paired."""
        length = F.size("c")
        prefix = F.concat(*[F.when(rule.uses(length, k), F.slice(k, F.lit(1), F.greatest(
            rule.prefix_length(length, k), F.lit(0)))).otherwise(F.array().cast("array<string>")) for k in "gc"])
        # a prefix holds tokens of the first kind, then of the second, each from its start
        skipped = F.when(F.col("token").startswith("c"), F.size(F.filter(
            "prefix", lambda t: t.startswith("g")))).otherwise(0)
        behind = F.when(F.col("token").startswith("g"), F.size("g")).otherwise(length) \
            - F.col("__at") + skipped - 1
        return (rows.withColumn("prefix", prefix).withColumn("band", rule.band(length))
                .select("*", F.posexplode("prefix").alias("__at", "token"))
                .select("name", "band", "token", behind.cast("int").alias("behind"),
                        F.col("token").startswith("g").alias("paired")))

    right = cut(keyed(arranged.entries))
    keys = right.groupBy("token", "band").agg(F.count(F.lit(1)).alias("n"))
    total = right.count()
    most = max(64, -(-total // share))
    salts = broadcast_within(cut(keys.where(F.col("n") > most).select(
        "token", "band", F.ceil(F.col("n") / most).alias("salts"))))
    salted = F.coalesce("salts", F.lit(1).cast("bigint"))
    right = right.join(salts, ["token", "band"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("name"), salted)).drop("salts")
    left = (keyed(arranged.of(_name_tokens(names, spread)))
            .withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
            .join(salts, ["token", "band"], "left")
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salted - 1))).drop("salts"))
    # several parts in a partition, none very large
    parts = max(4 * _partitions(names), -(-total // 20_000))

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("key", F.xxhash64("token", "band", "salt"))
        rows = rows.select(F.pmod("key", F.lit(parts)).alias("part"), "key", "name", "behind", "paired")
        return (rows.repartition(_partitions(names), "part") if spread else rows).groupBy("part")

    return dealt(left).cogroup(dealt(right)).applyInArrow(met_pairs(cutoff), "a string, b string").distinct()


#: Products of names and entries from which the closest are looked for first.
MANY_PAIRS = 1 << 22


def close_matches(names: DataFrame, corpus: DataFrame, cutoff: float) -> DataFrame:
    """Best corpus entry per name by sequence ratio, at least ``cutoff``.

    ``names`` and ``corpus`` hold one ``name`` column. Only candidates of
    ``close_candidates`` are compared, as no other pair reaches the cutoff. Ties go to the
    larger entry; empty and null names match nothing.

    With ``MANY_PAIRS`` or more, cutoffs come down to ``cutoff`` in three rounds. A name whose
    best entry reaches a round's cutoff is settled by it, as all entries that do are compared then; only
    the others go on to the next round, which has many more candidates. It ends when all are settled.
    """
    names = cut(names.select("name").where(F.col("name") != "").distinct())
    corpus = cut(corpus.select("name").where(F.col("name") != "").distinct())
    if names.count() * corpus.count() < MANY_PAIRS:
        return _best_within(close_candidates(names, corpus, cutoff), cutoff)
    found, arranged = [], Arranged(corpus, spread=True)
    for share in (2 / 3, 1 / 3):
        least = cutoff + (1 - cutoff) * share
        found.append(cut(_best_within(close_candidates(names, corpus, least, spread=True, arranged=arranged), least)))
        names = cut(names.join(found[-1], "name", "left_anti"))
        if names.isEmpty():
            break
    else:
        found.append(_best_within(close_candidates(names, corpus, cutoff, spread=True, arranged=arranged), cutoff))
    return functools.reduce(DataFrame.unionByName, found)


def _best_within(pairs: DataFrame, cutoff: float) -> DataFrame:
    """The best entry (b) of each name (a) of ``pairs``, at least ``cutoff``."""
    return (
        pairs
        .withColumn("ratio", sequence_ratio("b", "a")).where(F.col("ratio") >= cutoff)
        .groupBy(F.col("a").alias("name"))
        .agg(F.max(F.struct("ratio", F.col("b").alias("match"))).alias("best"))
        .select("name", "best.match", "best.ratio"))


# -- lookup by exact name, word set, close name -------------------------------


def registry_table(raw: DataFrame) -> DataFrame:
    """Registry rows (name, code as text, seq) to name, code, seq: positive codes, last row wins."""
    code = T.strip("code").try_cast("double")
    return (raw.select(T.strip("name").alias("name"), code.alias("code"), "seq")
            .where((F.col("code") > 0) & ~F.isnan("code"))
            .groupBy("name")
            .agg(F.max_by("code", "seq").cast("int").alias("code"), F.min("seq").alias("seq")))


def _by_words(table: DataFrame) -> DataFrame:
    """First entry per word set, for names of two or more different words."""
    return (table.where(T.word_count("name") >= 2)
            .groupBy(T.word_set("name").alias("__words"))
            .agg(F.min_by(F.struct("name", "code"), "seq").alias("__w")))


def match_names(names: DataFrame, table: DataFrame, cutoff: float,
                min_length: int = 1) -> DataFrame:
    """Resolve ``names`` (name) against ``table`` (name, code, seq).

    Exact name, then equal word set, then closest name. Returns name, official,
    code, how; unmatched names are left out. Only names the first two steps
    leave over are compared.
    """
    names = names.where(F.coalesce("name", F.lit("")) != "").distinct()
    exact = table.select("name", F.struct("name", "code").alias("__e"))
    found = (
        names.join(exact, "name", "left")
        .withColumn("__words", F.when(T.word_count("name") >= 2, T.word_set("name")))
        .join(_by_words(table), "__words", "left"))
    found = cut(found)
    direct = found.where(F.col("__e").isNotNull() | F.col("__w").isNotNull()).select(
        "name", F.coalesce("__e", "__w").alias("m"),
        F.when(F.col("__e").isNotNull(), "exact").otherwise("words").alias("how"))
    left = found.where(F.col("__e").isNull() & F.col("__w").isNull()
                       & (F.length("name") >= min_length)).select("name")
    close = (
        close_matches(left, table.select("name"), cutoff)
        .join(table.select(F.col("name").alias("match"), "code"), "match")
        .select("name", F.struct(F.col("match").alias("name"), "code").alias("m"),
                F.lit("close").alias("how")))
    return direct.unionByName(close).select(
        "name", F.col("m.name").alias("official"), F.col("m.code").alias("code"), "how")


def resolve_registry(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Official name and code of street names (cutoff 0.85, three letters or more)."""
    return match_names(names, registry, 0.85, min_length=3)


# -- forms of a street name ---------------------------------------------------


def _before(s: Column, mark: str) -> Column:
    """Stripped text before the first ``mark``; null when it is absent."""
    return F.when(s.contains(mark), T.strip(F.substring_index(s, mark, 1)))


def _without_descriptor(s: Column) -> Column:
    words = "|".join(R.SUFFIX_DESCRIPTORS)
    out = T.strip(F.regexp_replace(s, rf"(?U)\s*[-–]\s*({words})\b.*$", ""))
    out = T.strip(F.regexp_replace(out, r"(?U)\s+\d+\s*$", ""))
    return F.coalesce(_before(out, "/"), out)


def street_forms(names: DataFrame) -> DataFrame:
    """Fall-back forms of each distinct ``name``: name, pos, form, plain, corrected.

    ``pos`` is the order to try them in; ``plain`` / ``corrected`` say whether the
    form itself and its correction are tried.
    """
    s = F.col("name")
    df = names.where(~T.is_blank("name")).distinct()
    df = df.withColumn("__short", _without_descriptor(s))
    short = F.col("__short")
    df = df.withColumn("__short", F.coalesce(
        *[_before(short, p) for p in R.SUFFIX_PREPOSITIONS], short))
    no_paren = T.strip(F.regexp_replace(
        T.strip(F.regexp_replace(s, r"(?U)\s*\([^)]*\)\s*", " ")), r"(?U)\s+\d+\s*$", ""))
    crossing = F.coalesce(*[_before(s, m) for m in R.CROSSING_SHORTHANDS])
    numbers = T.strip(T.match(s, r"(?U)^(.+?)\s+\d+\s*[,/\-]\s*\d+"))
    entrance = T.strip(T.match(s, r"(?U)^(.+?)\s+\d+\s*(כניסה|קומה|דירה)\b"))
    endings = "|".join(R.WHOLE_STREET_ENDINGS)
    whole = T.strip(F.regexp_replace(s, rf"(?U)\s+({endings})\s*$", ""))
    df = df.withColumn("__words", F.split(s, r"(?U)\s+"))
    n = F.size("__words")
    form = lambda f, plain, corrected: F.struct(
        f.alias("form"), F.lit(plain).alias("plain"), F.lit(corrected).alias("corrected"))
    changed = lambda f: F.when(f != s, f)
    fixed = F.array(
        form(s, False, True), form(s, True, False),
        form(changed(short), True, True),
        form(changed(no_paren), True, False),
        form(crossing, True, True),
        form(numbers, True, True),
        form(entrance, True, False),
        form(changed(whole), True, False))
    shorter = F.when(n >= 3, F.transform(
        F.sequence(n - 1, F.lit(2)),
        lambda i: form(F.array_join(F.slice("__words", F.lit(1), i), " "), True, True)))
    forms = F.concat(fixed, F.coalesce(shorter, F.array().cast(
        "array<struct<form:string,plain:boolean,corrected:boolean>>")))
    return (df.select("name", F.posexplode(forms).alias("pos", "f"))
            .where(F.coalesce("f.form", F.lit("")) != "")
            .select("name", "pos", "f.form", "f.plain", "f.corrected"))


def resolve_street_codes(names: DataFrame, streets: DataFrame, registry: DataFrame | None,
                         corrections: DataFrame | None = None) -> DataFrame:
    """Street code of each distinct ``name``.

    ``streets`` and ``registry``: name, code, seq. ``corrections``: name,
    nominatim, gis. Every form of a name is tried exactly, by word set, by closest
    name (0.78) and in the registry; the first form with any answer wins.
    Returns name, code, form, how.
    """
    forms = street_forms(names)
    if corrections is not None:
        fix = corrections.select(F.col("name").alias("form"),
                                 F.nullif("nominatim", F.lit("")).alias("__fixed"),
                                 F.when(~F.col("gis").startswith(R.INTERSECTION_MARK),
                                        F.col("gis")).alias("__manual"))
        forms = forms.join(fix, "form", "left")
    else:
        forms = forms.withColumns({"__fixed": F.lit(None).cast("string"),
                                   "__manual": F.lit(None).cast("string")})
    tries = (
        forms.select("name", F.explode(F.array(
            F.struct((F.col("pos") * 4 + 1).alias("pos"),
                     F.when(F.col("plain"), F.col("form")).alias("form")),
            F.struct((F.col("pos") * 4 + 2).alias("pos"),
                     F.when(F.col("corrected"), F.col("__fixed")).alias("form")),
            F.struct((F.col("pos") * 4 + 3).alias("pos"),
                     F.when(F.col("pos") == 0, F.col("__manual")).alias("form")))).alias("t"))
        .select("name", "t.pos", T.strip("t.form").alias("form"))
        .where(F.coalesce("form", F.lit("")) != ""))
    # forms after the first one with an exact or word-set answer are never needed
    certain = _by_words(streets).select("__words").distinct()
    settled = (
        tries.join(streets.where("code <> 0").select(F.col("name").alias("form"),
                                                     F.lit(True).alias("__exact")), "form", "left")
        .withColumn("__words", T.word_set("form"))
        .join(certain.withColumn("__set", F.lit(True)), "__words", "left")
        .where(F.col("__exact") | (F.col("__set") & (T.word_count("form") >= 2)))
        .groupBy("name").agg(F.min("pos").alias("__last")))
    tries = (tries.join(settled, "name", "left")
             .where(F.col("__last").isNull() | (F.col("pos") <= F.col("__last"))).drop("__last"))
    tries = cut(tries)
    wanted = tries.select(F.col("form").alias("name")).distinct()
    local = match_names(wanted, streets, 0.78).select(
        F.col("name").alias("form"), "code", "how").where("code <> 0")
    found = tries.join(local, "form", "left")
    if registry is not None:
        found = found.join(resolve_registry(wanted, registry).select(
            F.col("name").alias("form"), F.col("code").alias("__rcode")), "form", "left")
    else:
        found = found.withColumn("__rcode", F.lit(None).cast("int"))
    return (
        found
        .withColumn("how", F.coalesce("how", F.when(F.col("__rcode").isNotNull(), "registry")))
        .withColumn("code", F.coalesce("code", "__rcode"))
        .where(F.col("code").isNotNull())
        .groupBy("name").agg(F.min_by(F.struct("code", "form", "how"), "pos").alias("m"))
        .select("name", "m.code", "m.form", "m.how"))


def resolve_layer_names(names: DataFrame, layer_names: DataFrame, registry: DataFrame | None,
                        corrections: DataFrame | None = None) -> DataFrame:
    """Building-layer name of each distinct ``name``: name, layer_name.

    Manual entries first (an entry without a layer name ends that form), then exact,
    then the registry's spelling, then the closest layer or registry name (0.6).
    """
    s = F.col("name")
    base = names.select(T.strip("name").alias("name")).where(~T.is_blank("name")).distinct()
    short = _without_descriptor(s)
    forms = F.array(s, F.when(short != s, short), *[_before(s, p) for p in R.SUFFIX_PREPOSITIONS])
    tries = (base.select("name", F.posexplode(forms).alias("pos", "form"))
             .where(F.coalesce("form", F.lit("")) != ""))
    layer = layer_names.select(F.col("name").alias("form"), F.lit(True).alias("__in_layer")) \
        .where(F.coalesce("form", F.lit("")) != "").distinct()
    wanted = tries.select(F.col("form").alias("name")).distinct()
    if corrections is not None:
        manual = corrections.where("has_gis OR (status = 'unresolvable' AND gis IS NULL)").select(
            F.col("name").alias("form"), F.lit(True).alias("__manual"), F.col("gis").alias("__gis"))
    else:
        manual = layer.limit(0).select("form", F.lit(True).alias("__manual"),
                                       F.lit(None).cast("string").alias("__gis"))
    known = tries.join(manual, "form", "left").join(layer, "form", "left")
    if registry is not None:
        known = known.join(resolve_registry(wanted, registry).select(
            F.col("name").alias("form"), F.col("official").alias("__official")), "form", "left")
    else:
        known = known.withColumn("__official", F.lit(None).cast("string"))
    known = (
        known.join(layer.select(F.col("form").alias("__official"),
                           F.col("__in_layer").alias("__official_in_layer")), "__official", "left"))
    direct = (
        F.when(F.col("__manual"), F.col("__gis"))
        .when(F.col("__in_layer"), F.col("form"))
        .when(F.col("__official_in_layer") | (F.col("__official") != F.col("form")),
              F.col("__official")))
    known = cut(known.select("name", "pos", "form", direct.alias("__direct"),
                             F.coalesce("__manual", F.lit(False)).alias("__manual")))
    corpus = layer.select(F.col("form").alias("name"))
    corpus = (corpus.union(registry.select("name")) if registry is not None else corpus).distinct()
    close = close_matches(
        known.where(F.col("__direct").isNull() & ~F.col("__manual"))
        .select(F.col("form").alias("name")), corpus, 0.6)
    return (
        known.join(close.select(F.col("name").alias("form"), "match"), "form", "left")
        .withColumn("layer_name", F.coalesce(
            "__direct", F.when(~F.col("__manual"), F.col("match"))))
        .where(F.col("layer_name").isNotNull())
        .groupBy("name").agg(F.min_by("layer_name", "pos").alias("layer_name")))


# -- spelling variants --------------------------------------------------------


def street_variants(df: DataFrame, registry: DataFrame | None = None, min_total: int = 4,
                    top: int | None = None, max_variants: int | None = None, samples: int = 3,
                    letters: str = T.HEBREW, fold_quotes: bool = True) -> DataFrame:
    """Groups of street spellings that may be one street, largest first.

    Rows are counted per raw spelling first, so all later work is on distinct
    names. ``fold_quotes`` joins spellings that differ only in quote marks. ``top`` groups and
    ``max_variants`` variants of each are returned; None is all.
    """
    raw = (df.where(~T.is_blank("street")).groupBy("street")
           .agg(F.count(F.lit(1)).alias("__n")))
    # set by a generator and stored: filters and joins on these names would otherwise be pushed below the
    # counting, and every row would be cleaned and composed
    cleaned = T.once(raw, {"spelling": T.bare_street("street", letters)}).where(F.col("spelling") != "")
    spellings = cut(cleaned.groupBy("spelling").agg(F.sum("__n").alias("__n")))
    key = nfc("spelling")
    spellings = cut(spellings.withColumn("normalized", F.translate(key, "\"'״׳", "")
                                         if fold_quotes else key))
    ranked = Window.partitionBy("normalized").orderBy(F.desc("__n"), "spelling")
    totals = spellings.groupBy("normalized").agg(
        F.sum("__n").alias("total"), F.count(F.lit(1)).alias("spellings")) \
        .where(F.col("total") >= min_total)
    named = (
        spellings.withColumn("__rank", F.row_number().over(ranked))
        .where(F.lit(True) if max_variants is None else F.col("__rank") <= max_variants + 1)
        .groupBy("normalized").agg(
            F.min_by("spelling", "__rank").alias("canonical"),
            F.array_sort(F.collect_list(F.when(F.col("__rank") > 1, F.struct(
                F.col("__rank").alias("rank"), "spelling", F.col("__n").alias("rows")))))
            .alias("variants"))
        .join(totals, "normalized"))
    if registry is not None:
        asked = named.select(F.col("normalized").alias("name")).union(named.select("canonical"))
        official = resolve_registry(asked, registry).select("name", "official")
        named = (
            named
            .join(official.select(F.col("name").alias("normalized"),
                                  F.col("official").alias("__by_key")), "normalized", "left")
            .join(official.select(F.col("name").alias("canonical"),
                                  F.col("official").alias("__by_name")), "canonical", "left")
            .withColumn("registry_match", F.coalesce("__by_key", "__by_name"))
            .drop("__by_key", "__by_name"))
    else:
        named = named.withColumn("registry_match", F.lit(None).cast("string"))
    shown = (named.where((F.col("spellings") > 1)
                         | (F.col("registry_match") != F.col("canonical")))
             .orderBy(F.desc("total"), "normalized"))
    shown = shown if top is None else shown.limit(top)
    if "raw_address" in df.columns:
        shown = cut(shown)
    if "raw_address" not in df.columns:
        return shown
    listed = shown.select("normalized", F.explode(F.concat(
        F.array("canonical"), F.transform("variants", lambda v: v["spelling"]))).alias("street"))
    # at most `samples` addresses per group survive, each picked before any collect
    first = Window.partitionBy("normalized").orderBy("raw_address")
    examples = (
        df.where(F.col("raw_address").isNotNull()).join(broadcast_within(cut(listed)), "street")
        .select("normalized", "raw_address").distinct()
        .withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= samples)
        .groupBy("normalized").agg(F.array_sort(F.collect_list("raw_address")).alias("samples")))
    return shown.join(examples, "normalized", "left").orderBy(F.desc("total"), "normalized")
