"""The whole path from a raw export to an enriched, flagged table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidyward import rules as R
from tidyward.operators.clean import clean
from tidyward.operators.flags import detect_flags
from tidyward.operators.geocode import Sources, geocode
from tidyward.operators.resolve import auto_fix, resolve_from_context
from tidyward.operators.zones import enrich
from tidyward.sources.readers import REVIEW_COLUMNS, known_unresolvable


def prepare(raw: DataFrame, corrections: DataFrame | None = None,
            rules: R.Rules = R.MUNICIPAL) -> DataFrame:
    """Clean, repair and resolve from context."""
    known = None if corrections is None else known_unresolvable(corrections)
    fixed = auto_fix(clean(raw, rules), known)
    return resolve_from_context(fixed, rules)


def recheck(corrected: DataFrame, known_unresolvable: DataFrame | None = None, date_min: str | None = None,
            date_max: str | None = None, rules: R.Rules = R.MUNICIPAL) -> DataFrame:
    """A review file that came back: without its review columns, cleaned, repaired and
    flagged again with the flags of stage ``clean``."""
    fixed = auto_fix(clean(corrected.drop(*REVIEW_COLUMNS), rules), known_unresolvable)
    return detect_flags(fixed, date_min, date_max, stage="clean")


def locate(df: DataFrame, sources: Sources, references: DataFrame | None,
           run_id: str | None = None) -> DataFrame:
    """Geocode and assign zones."""
    return enrich(geocode(df, sources, run_id), references)


def full(raw: DataFrame, sources: Sources, references: DataFrame | None,
         date_min: str | None = None, date_max: str | None = None,
         run_id: str | None = None) -> DataFrame:
    """Everything, with the flags of stage ``all``."""
    done = locate(prepare(raw, sources.corrections), sources, references, run_id)
    return detect_flags(done, date_min, date_max, stage="all")
