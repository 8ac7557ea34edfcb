"""Size-checked broadcast.

A side is broadcast only after its row count was measured against a bound;
beyond the bound the caller's join falls back to a shuffle join (sort-merge
with AQE skew handling). The counted frame is written to the shared
checkpoint folder, so counting does not compute it twice and nothing stays
cached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.session import materialize

# Rows of (ids, a term, a few numbers): ~100 bytes each, so 500k rows ~ 50 MB.
BROADCAST_MAX_ROWS = 500_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, int]:
    """Return (frame to join, measured rows); hinted for broadcast when small."""
    kept = materialize(df, "checked")
    rows = kept.count()
    return (F.broadcast(kept) if rows <= max_rows else kept), rows
