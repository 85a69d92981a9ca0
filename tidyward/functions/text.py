"""Column functions over text, numbers and dates.

Patterns carry ``(?U)`` so that ``\\s``, ``\\d`` and ``\\b`` follow Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidyward import rules as R

# The letters, and text that is only digits and punctuation.
HEBREW = "א-ת"
JUNK = r"""(?U)^[\d\s.,\-_!?()״׳'"]+$"""


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Set the columns so that each is computed once per row.

    A one-element generator: filters and joins on these columns stay above it, where
    plain projections would have their whole expressions copied into them.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(
        *[c.alias(name) for name, c in columns.items()]))))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def text(c: Column | str) -> Column:
    """The value as stripped text, null as empty."""
    return strip(F.coalesce(col(c).cast("string"), F.lit("")))


def match(c: Column, pattern: str, group: int = 1) -> Column:
    """A capture group, or null when the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def decode_entities(c: Column | str) -> Column:
    """Decode six HTML entities, one after the other, and strip; null becomes empty."""
    out = F.coalesce(col(c).cast("string"), F.lit(""))
    for entity, char in [("&#039;", "'"), ("&quot;", '"'), ("&amp;", "&"),
                         ("&#39;", "'"), ("&gt;", ">"), ("&lt;", "<")]:
        out = replace(out, entity, char)
    return strip(out)


def ticket_id(c: Column | str) -> Column:
    """Leading digits of a ticket, or the whole text when there are none."""
    s = strip(col(c).cast("string"))
    return F.coalesce(F.nullif(F.regexp_extract(s, r"(?U)^\s*(\d+)", 1), F.lit("")), s)


def ticket_suffix(c: Column | str) -> Column:
    s = strip(col(c).cast("string"))
    return F.nullif(F.regexp_extract(s, rf"(?U)-\s*([{HEBREW}])\s*$", 1), F.lit(""))


def trim_decimal(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\.0$", "")


def tidy_ticket(c: Column | str) -> Column:
    return F.regexp_replace(trim_decimal(strip(col(c).cast("string"))), r"(?U)\s+", "")


def tidy_street(c: Column | str) -> Column:
    """Strip, drop trailing ``.,;:`` and turn the words for missing into empty."""
    s = F.regexp_replace(text(c), r"[.,;:]+$", "")
    return F.when(s.isin("nan", "None"), "").otherwise(s)


def weekday_name(c: Column | str, names=R.WEEKDAYS) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.weekday(col(c)))


def month_name(c: Column | str, names=R.MONTHS) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), col(c) - 1)


def is_blank(c: Column | str) -> Column:
    """Null, empty, ``nan`` or ``none``."""
    c = col(c)
    return c.isNull() | F.lower(strip(c.cast("string"))).isin("", "nan", "none")


def is_junk(c: Column | str) -> Column:
    """Not blank, yet only digits and punctuation."""
    return ~is_blank(c) & text(c).rlike(JUNK)


def to_number(c: Column | str) -> Column:
    """Text with stray commas as a double; anything else, NaN and infinities, as null."""
    n = strip(F.regexp_replace(col(c).cast("string"), ",", "")).try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)


def has_any(c: Column | str, words) -> Column:
    c = F.coalesce(col(c).cast("string"), F.lit(""))
    return any_of([c.contains(w) for w in words])


def wants_callback(c: Column | str, phrases=R.CALLBACK_PHRASES) -> Column:
    return has_any(c, phrases).cast("int")


def has_phone(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit("")).rlike(r"(?U)05\d[-\s]?\d{6,7}").cast("int")


def lookup(c: Column | str, mapping: dict, default=None) -> Column:
    """A fixed mapping as one membership test per distinct value."""
    by_value: dict = {}
    for key, value in mapping.items():
        by_value.setdefault(value, []).append(key)
    c, out = col(c), None
    for value, keys in by_value.items():
        out = F.when(c.isin(keys), value) if out is None else out.when(c.isin(keys), value)
    if out is None:
        return F.lit(default)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def current_responsibility(c: Column | str) -> Column:
    """Labels of older files in their current form; others unchanged."""
    return lookup(strip(c), R.LEGACY_RESPONSIBILITY, default=col(c))


def leading_number(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(strip(col(c).cast("string")), r"(?U)^(\d+)", 1), F.lit(""))


def _drop_unit(s: Column, slash: str) -> Column:
    s = strip(F.regexp_replace(s, slash, ""))
    for word in (r"(?U)\s*דירה\s*\d*", r"(?U)\s*קומה\s*\d*", r"(?U)\s*כניסה\s*\w*"):
        s = F.regexp_replace(s, word, "")
    return strip(s)


def strip_unit(c: Column | str) -> Column:
    """House number without ``/n``, apartment, floor or entrance; missing and 0 as empty."""
    s = text(c)
    return F.when(s.isin("", "nan", "None", "0"), "").otherwise(
        _drop_unit(s, r"(?U)\s*[/\\]\s*\d+$"))


def query_house(c: Column) -> Column:
    """House number as cleaned for the second geocoder candidate."""
    return _drop_unit(c, r"(?U)[/\\]\s*\d+$")


def tokens(c: Column | str, letters: str = HEBREW, stop_words=R.STOP_WORDS) -> Column:
    """Words of two or more letters, without stop words, in order."""
    words = F.regexp_extract_all(F.coalesce(col(c).cast("string"), F.lit("")),
                                 F.lit(f"[{letters}]{{2,}}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def ngrams(words: Column | str, n: int = 2) -> Column:
    """Consecutive n-grams of an array of words, in one pass per position."""
    words = col(words)
    count = F.size(words) - (n - 1)
    out = F.slice(words, 1, count)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, k + 1, count),
                         lambda left, right: F.concat(left, F.lit(" "), right))
    return F.when(count > 0, out).otherwise(F.array().cast("array<string>"))


# What stands before and behind a street name.
STREET_PREFIX = r"""(?U)^(רחוב|רח[׳'״]|ר[׳'״]|ה?רחוב)\s+"""
TRAILING_HOUSE = rf"(?U)[\s,./\-]+\d{{1,4}}\s*[{HEBREW}]?(?:\s*/\s*\d+)?\s*$"
MARK_RUN = r"""[\s,.;׳״'"־\-]+"""
TRAILING_MARKS = rf"(?U){MARK_RUN}$"


def bare_street(c: Column | str, letters: str = HEBREW) -> Column:
    """A street value reduced to its name.

    The word for street goes first; then trailing house numbers and marks go, one
    of each per round, unless no letter would be left. A round that changes anything
    takes a number or a run of marks, so there are as many rounds as the text has of them.
    """
    def cut_tail(s: Column, pattern: str) -> Column:
        shorter = strip(F.regexp_replace(s, pattern, ""))
        return F.when(shorter.rlike(f"[{letters}]"), shorter).otherwise(s)

    start = F.regexp_replace(text(c), STREET_PREFIX, "")
    rounds = F.regexp_count(start, F.lit(rf"(?U)\d{{1,4}}|{MARK_RUN}")) + 1
    return strip(F.aggregate(
        F.array_repeat(F.lit(0), rounds), start,
        lambda s, _: cut_tail(cut_tail(s, TRAILING_HOUSE), TRAILING_MARKS)))


def word_set(c: Column | str) -> Column:
    """The distinct words in sorted order: equal for names that differ in word order."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(strip(c), r"(?U)\s+"))), " ")


def word_count(c: Column | str) -> Column:
    return F.size(F.array_distinct(F.split(strip(c), r"(?U)\s+")))


def content_number(c: Column) -> Column:
    """A repeatable 60-bit number of a text, from its md5."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")
