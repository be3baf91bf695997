"""The one place that knows about NaN, infinities and masks.

Public DataFrames hold NULL for an invalid sample; NaN lives only inside chunk arrays
and Arrow kernels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mask bytes that mark an invalid sample.
INVALID_MASK = (0, 255)


def finite(*cols: Column) -> Column:
    """Every column is there, no NaN and no infinity."""
    tests = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in cols]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def mask_ok(mask: Column | None) -> Column:
    """A mask byte of 1..254; where there is no mask, everything is valid."""
    return F.lit(True) if mask is None else F.coalesce(~mask.isin(*INVALID_MASK), F.lit(True))


def as_float(value: Column, when: Column | None = None) -> Column:
    """value as float32, NULL unless ``when`` holds and the float32 is finite."""
    v = value.cast("float")
    ok = finite(v)
    return F.when(ok if when is None else when & ok, v)


def nan_to_null(c: Column) -> Column:
    return F.when(finite(c), c)


def null_to_nan(c: Column) -> Column:
    """Of float32 samples, for chunk arrays and kernels."""
    return F.coalesce(c.cast("float"), F.lit(float("nan")).cast("float"))
