"""Join-strategy helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dimension tables up to this many rows are broadcast; above it the join
# falls back to a shuffle join (and AQE may still convert at runtime).
DEFAULT_BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows.

    The check is a plain distributed count (no rows are gathered); a larger
    side is returned unchanged and joined by shuffle.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
