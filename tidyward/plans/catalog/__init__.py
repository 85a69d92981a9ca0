"""Every operator as a named query over the driver's tables, with its expected SQL."""

from tidyward.plans.catalog.registry import EXPECTED, QUERIES
from tidyward.plans.catalog import cleaning, geocoding, quality, reporting  # noqa: F401

__all__ = ["QUERIES", "EXPECTED"]
