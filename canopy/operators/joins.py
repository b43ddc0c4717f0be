"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# A side is broadcast only when its rows are measured to be below this many bytes.
BROADCAST_MAX_BYTES = 64 << 20
_ROW, _VALUE = 16, 8


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows: texts by their length, other values and each row by a fixed size."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    length = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in texts), F.lit(_ROW + _VALUE * len(df.columns)))
    return int(df.agg(F.sum(length.cast("long")).alias("n")).first()["n"] or 0)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join ``big`` to a side expected to be small.

    The small side is measured first; it is broadcast only when it has at
    most ``max_bytes``.  Otherwise a sort-merge join is planned and adaptive query
    execution (with skew-join splitting) handles it.
    """
    if measured_bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)
