"""Address decomposition: an ordered set of patterns, the first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidyward import rules as R
from tidyward.functions.text import HEBREW, decode_entities, match, once, replace, strip

# Patterns of the address forms.
CROSSING = r"(?Us)^(.*?)\s+(?:פינת|פינה|פ['.])\s*(.*)$"
RANGE = r"(?U)^(.+?)\s+(\d+\s*[-–]\s*\d+)\s*$"
DIRECTION = r"(?Us)^(.*?)\s+(?:" + "|".join(R.DIRECTIONS) + ")"
NUMBERED = r"(?U)^(.+?)\s+(\d+)\s*$"
LETTERED = rf"(?U)^(.+?)\s+(\d+)\s*([{HEBREW}]{{1,2}}['׳]?)\s*$"
JOINED = r"(?U)^(.+?)\s+(\d+\s*[+&]\s*\d+)\s*$"
NOTE = r"(?s)^(.*?)\(([^)]*)\)(.*)$"

PARTS = ["address_text", "street", "cross_street", "house", "loc_type", "loc_note", "addr_note"]


def parse_address(df: DataFrame, source: Column | str, prefix: str = "") -> DataFrame:
    """Add the seven address parts of ``source``, each named with ``prefix``.

    Staged columns keep every pattern evaluated once per row.
    """
    tmp = [f"__{prefix}{n}" for n in ("a", "kind", "main", "num", "note")]
    a, kind, main, num, note = tmp
    text_col = prefix + "address_text"
    out = df.withColumn(text_col, decode_entities(source))
    full = F.col(text_col)
    noted = full.contains("(") & full.rlike(NOTE)
    out = out.withColumns({
        prefix + "addr_note": F.when(
            noted, F.concat(F.lit("("), strip(F.regexp_extract(full, NOTE, 2)), F.lit(")"))),
        a: F.when(noted, strip(F.concat(F.regexp_extract(full, NOTE, 1), F.lit(" "),
                                        F.regexp_extract(full, NOTE, 3)))).otherwise(full),
    })
    whole = F.col(a)
    out = out.withColumn(kind, F.when(full == "", "none")
                         .when(strip(F.regexp_extract(whole, CROSSING, 2)) != "", "crossing")
                         .when(whole.rlike(RANGE), "range"))
    # direction words end the name, for rows no earlier pattern took
    before = F.when(F.col(kind).isNull(), match(whole, DIRECTION))
    out = out.withColumn(main, before)
    cut = F.coalesce(strip(F.col(main)) != "", F.lit(False))
    out = out.withColumns({
        note: F.when(cut, F.regexp_replace(
            F.substring(whole, F.length(F.col(main)) + 1, F.length(whole)),
            r"(?U)^[\s|]+|[\s|]+$", "")),
        main: F.when(cut, strip(F.col(main))).otherwise(whole),
    })
    name = F.col(main)
    out = out.withColumn(kind, F.coalesce(
        F.col(kind),
        F.when(name.rlike(NUMBERED), "numbered").when(name.rlike(LETTERED), "lettered")
        .when(name.rlike(JOINED), "joined").otherwise("landmark")))
    k = F.col(kind)
    spaces = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    out = out.withColumn(num, F.when(k == "range", spaces(F.regexp_extract(name, RANGE, 2)))
                         .when(k == "numbered", F.regexp_extract(name, NUMBERED, 2))
                         .when(k == "lettered", F.concat(
                             F.regexp_extract(name, LETTERED, 2),
                             F.regexp_replace(F.regexp_extract(name, LETTERED, 3), "'+$", "")))
                         .when(k == "joined", replace(F.regexp_extract(name, JOINED, 2), " ", "")))
    out = once(out, {
        prefix + "street": strip(
            F.when(k == "crossing", F.regexp_extract(name, CROSSING, 1))
            .when(k == "range", F.regexp_extract(name, RANGE, 1))
            .when(k == "numbered", F.regexp_extract(name, NUMBERED, 1))
            .when(k == "lettered", F.regexp_extract(name, LETTERED, 1))
            .when(k == "joined", F.regexp_extract(name, JOINED, 1))
            .when(k == "landmark", name)),
        prefix + "cross_street": F.when(
            k == "crossing", strip(F.regexp_extract(name, CROSSING, 2))),
        prefix + "house": F.col(num),
        prefix + "loc_type": F.when(k == "none", R.LOC_NONE)
            .when(k == "crossing", R.LOC_INTERSECTION)
            .when(k.isin("range", "joined"), R.LOC_RANGE)
            .when(k.isin("numbered", "lettered"), R.LOC_ADDRESS)
            .otherwise(R.LOC_LANDMARK),
        prefix + "loc_note": F.when(k == "range", F.concat(F.lit("בתים: "), F.col(num)))
            .otherwise(F.col(note)),
    })
    return out.drop(*tmp)


def address_route(loc_type: Column, house: Column, address_text: Column) -> Column:
    """Which pattern produced the parts, as a short label."""
    return (
        F.when(loc_type == R.LOC_INTERSECTION, "intersection")
        .when(loc_type == R.LOC_RANGE, "range")
        .when((loc_type == R.LOC_ADDRESS) & (F.coalesce(house, F.lit("")) != ""),
              F.when(address_text.rlike(r"(?U)\d+\s*[+&]\s*\d+\s*$"), "multi")
              .when(address_text.rlike(rf"(?U)\d+\s*[{HEBREW}]{{1,2}}['׳]?\s*$"), "apt_suffix")
              .otherwise("std"))
        .when(loc_type == R.LOC_NONE, "empty")
        .otherwise("landmark")
    )
