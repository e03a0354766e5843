"""Join helpers that keep broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension above this many rows, or this many bytes of text, is joined by
# shuffle instead of broadcast.
DIM_BROADCAST_MAX_ROWS = 200_000
DIM_BROADCAST_MAX_BYTES = 64 << 20


def sized_broadcast(dim: DataFrame, max_rows: int = DIM_BROADCAST_MAX_ROWS,
                    max_bytes: int = DIM_BROADCAST_MAX_BYTES) -> DataFrame:
    """Mark ``dim`` for broadcast only if it has at most ``max_rows`` rows and
    ``max_bytes`` bytes in its string columns.

    The check reads at most ``max_rows + 1`` rows, so it stays cheap even when
    the dimension turns out to be large; in that case the frame is returned
    unmarked and Catalyst/AQE plans a shuffle join.
    """
    size = F.lit(0)
    for name, kind in dim.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
    got = dim.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(dim) if got[0] <= max_rows and got[1] <= max_bytes else dim
