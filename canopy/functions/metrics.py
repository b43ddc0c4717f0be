"""Error metrics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the floor on |y| in the percentage error, machine epsilon of
# float64, as used by the common MAPE definition.
MAPE_EPS = 2.220446049250313e-16


def ape(y: Column, p: Column) -> Column:
    """Absolute percentage error of one row: |y - p| / max(|y|, eps)."""
    return F.abs(y - p) / F.greatest(F.abs(y), F.lit(MAPE_EPS))


def mape(y: Column, p: Column) -> Column:
    """Mean absolute percentage error (aggregate)."""
    return F.avg(ape(y, p))
