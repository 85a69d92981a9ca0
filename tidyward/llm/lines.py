"""Line deduplication by a fixed-depth tree of line templates, in DataFrame functions only.

A line's leaf is its number of tokens and its leading tokens, where a token with a digit is
a variable field. Leaves that too few texts reach are left out first. In a leaf, a token
that enough lines have at a place is constant there; any other is a variable field too.
What remains of a line is its template, and lines whose template recurs in enough texts
are dropped. Copies of a whole text count as one text, so a text is not hollowed out for
having been copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidyward.llm.common import store

FIELD = "<*>"
BLANKS = r"[ \t\r\f\x0B]+"
#: A token with a digit: from the token's begin, so that a long token is walked once.
VARIABLE = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*"


def template_lines(text: Column) -> Column:
    """The lines of a text with single blanks and fields instead of variable tokens."""
    return F.split(F.regexp_replace(F.regexp_replace(text, BLANKS, " "), VARIABLE, FIELD), "\n", -1)


def tokens_of(line: str) -> Column:
    return F.char_length(line) - F.char_length(F.replace(F.col(line), F.lit(" "), F.lit(""))) + 1


def _line_keys(whole: DataFrame, id_col: str, text: Column, depth: int, min_tokens: int) -> DataFrame:
    """id, row, text, at, leaf (null for few tokens) and key (of the line as it is; null for a blank one)."""
    both = whole.select(F.col(id_col).alias("id"), F.col("__row").alias("row"), F.xxhash64(text).alias("text"),
                        template_lines(text).alias("line"), F.split(text, "\n", -1).alias("raw"))
    both = both.select("id", "row", "text", F.posexplode(F.arrays_zip("line", "raw")).alias("at", "both")).select(
        "id", "row", "text", "at", F.trim("both.line").alias("line"),
        F.regexp_replace("both.raw", r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "").alias("raw"))
    tokens = tokens_of("line")
    leaf = F.xxhash64(tokens, F.substring_index("line", " ", depth))
    return both.select("id", "row", "text", "at", F.when(tokens >= min_tokens, leaf).alias("leaf"),
                       F.when(F.col("raw") != "", F.xxhash64("raw")).alias("key"))


def drop_templates(docs: DataFrame, min_texts: int = 10, depth: int = 3, min_tokens: int = 3,
                   min_fixed: float = 0.6, keep_first: bool = False, whole_lines: bool = False, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs`` with the recurring lines taken out of the text, and n_lines, n_dropped.

    A line goes if its template stands in ``min_texts`` different texts or more and
    ``min_fixed`` of its tokens are constant. Lines of fewer than ``min_tokens`` tokens stay.
    With ``whole_lines`` a line that isn't blank also goes, whatever its tokens, if the same line
    stands in ``min_texts`` different texts, but for blanks at its ends.
    With ``keep_first`` a template's or such a line's lines stay in the document of the smallest id. Null texts
    stay null and have no lines; an empty text has one, empty, line. Every document is
    returned. Texts, lines and templates are told apart by 64-bit hashes. Rows are numbered and
    stored once, so the frame is read once. Columns named n_lines or n_dropped are replaced.
    """
    text = F.col(text_col).cast("string")
    whole = store(docs.drop("n_lines", "n_dropped").withColumn("__row", F.monotonically_increasing_id()))
    lines = whole.select(
        F.col(id_col).alias("id"), F.col("__row").alias("row"), F.xxhash64(text).alias("text"),
        F.posexplode(template_lines(text)).alias("at", "line")).withColumn("line", F.trim("line"))
    lines = lines.withColumn("tokens", tokens_of("line")).filter(F.col("tokens") >= min_tokens)
    head = F.substring_index("line", " ", depth)
    lines = lines.withColumn("leaf", F.xxhash64("tokens", head))

    # one pass over the texts gives the leaf and the key of each whole line; only these are stored
    keys = _line_keys(whole, id_col, text, depth, min_tokens) if whole_lines else lines.select("leaf", "text")
    if whole_lines:
        keys = store(keys)
    leaves = store(keys.filter("leaf IS NOT NULL").select("leaf", "text").distinct().groupBy("leaf").agg(
        F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= min_texts).select("leaf"))
    lines = store(lines.join(leaves, "leaf", "left_semi").select(
        "id", "row", "text", "at", "line", "tokens", F.xxhash64("line").alias("key")))

    # from here on only lines of well-visited leaves, each distinct one once, by its key
    kinds = lines.select("key", "tokens", "line").distinct()
    often = lines.select("key", "text").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    spread = kinds.select("key", "tokens", head.alias("head"), F.posexplode(F.split("line", " ")).alias("at", "token"))
    # a place is a token at its position in a leaf
    place = F.xxhash64("tokens", "head", "at", "token").alias("place")
    spread = spread.select("key", "tokens", "at", "token", place)
    constant = spread.join(often, "key").groupBy("place").agg(F.sum("texts").alias("seen")).filter(
        F.col("seen") >= min_texts)
    fixed = F.col("seen").isNotNull() & (F.col("token") != FIELD)
    templates = spread.join(constant, "place", "left").groupBy("key", "tokens").agg(
        F.sort_array(F.collect_list(F.struct("at", F.when(fixed, F.col("token")).otherwise(FIELD).alias("token"))))
        .alias("parts"), F.count(F.when(fixed, 1)).alias("fixed"))
    templates = store(templates.filter(F.col("fixed") >= F.col("tokens") * min_fixed).select(
        "key", F.xxhash64(F.array_join("parts.token", " ")).alias("template")))

    placed = lines.select("id", "row", "text", "at", "key").join(templates, "key")
    recurring = placed.groupBy("template", "text").agg(F.min("id").alias("first")).groupBy("template").agg(
        F.min("first").alias("first"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= min_texts)
    gone = placed.join(recurring.select("template", "first"), "template")
    if keep_first:
        gone = gone.filter(~F.col("id").eqNullSafe(F.col("first")))
    gone = gone.select("row", "at")
    if whole_lines:
        same = keys.filter("key IS NOT NULL").select("id", "row", "text", "at", "key")
        often = same.groupBy("key", "text").agg(F.min("id").alias("first")).groupBy("key").agg(
            F.min("first").alias("first"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= min_texts)
        found = same.join(often.select("key", "first"), "key")
        if keep_first:
            found = found.filter(~F.col("id").eqNullSafe(F.col("first")))
        gone = gone.unionByName(found.select("row", "at"))
    drops = gone.groupBy(F.col("row").alias("__row")).agg(F.collect_set("at").alias("__gone"))

    out = whole.join(drops.hint("shuffle_hash"), "__row", "left").withColumn("__lines", F.split(text, "\n", -1))
    n = F.coalesce(F.size("__lines"), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"),
                       lambda i: F.get("__lines", i))
    return out.withColumn("n_lines", F.when(text.isNull(), 0).otherwise(n)).withColumn(
        "n_dropped", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))).withColumn(
        text_col, F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(kept, "\n"))).drop(
        "__row", "__gone", "__lines")
