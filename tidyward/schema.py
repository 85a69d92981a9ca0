"""Column names and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in columns.items()])


RAW_COMPLAINTS = _table(
    ticket=StringType, opened_at=TimestampType, raw_address=StringType, topic=StringType,
    subtopic=StringType, description=StringType, status=StringType, department=StringType,
)

# Names in the source export, for files that keep their original header.
SOURCE_NAMES = {
    "מס' פניה": "ticket",
    "תאריך ושעת פתיחה": "opened_at",
    "כתובת ואתר/מוסד": "raw_address",
    "נושא": "topic",
    "תת נושא": "subtopic",
    "תיאור": "description",
    "סטטוס פנייה": "status",
    "מחלקה": "department",
}

REQUIRED = ["ticket", "opened_at", "raw_address", "subtopic"]

CLEAN_COLUMNS = [
    "ticket", "opened_at", "date", "hour", "weekday", "month", "status", "topic",
    "category", "substance", "responsibility", "asset", "street", "cross_street", "house",
    "loc_type", "description", "loc_note", "is_recurring", "wants_callback",
    "has_personal_info", "ticket_suffix", "raw_address", "address_text", "addr_note",
    "department", "subtopic", "recurrence_no", "category_source", "resp_source",
    "addr_route", "auto_fixed", "confidence", "confidence_details",
]

ADDRESS_POINTS = _table(
    street_code=IntegerType, street_name=StringType, house_raw=StringType, house_no=IntegerType,
    neighborhood=StringType, lat=DoubleType, lon=DoubleType, seq=LongType,
)
BUILDING_LAYER = _table(
    street_name=StringType, house_raw=StringType, x=DoubleType, y=DoubleType, seq=LongType,
)
STREET_REGISTRY = _table(name=StringType, code=StringType, seq=LongType)
ZONE_REFERENCE = _table(lat=DoubleType, lon=DoubleType, zone=StringType)
GEOCODER_RESULTS = _table(query=StringType, lat=DoubleType, lon=DoubleType, place_rank=IntegerType)
AUDIT = _table(
    ticket=StringType, field=StringType, old=StringType, new=StringType,
    source=StringType, timestamp=StringType, run_id=StringType,
)
ANSWERS = _table(
    seq=IntegerType, kind=StringType, category=StringType, term=StringType, answer=StringType,
)

PROVENANCE = ["category_source", "resp_source", "addr_route"]


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the named columns as typed nulls where they are absent."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df
