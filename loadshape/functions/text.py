"""Plan-name token extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the plan token pattern of the tariff study (size + house type).
PLAN_PATTERN = r"(\d+\s*kW\s*(?:Villa|Normal))"


def plan_token(col, pattern: str = PLAN_PATTERN) -> Column:
    """First capture of ``pattern``; no match (or null input) gives NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
