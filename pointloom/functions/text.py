"""Lists in option strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")


def device_list(text: Column) -> Column:
    """The comma-separated names of a string, trimmed; empty ones and -1, which stands for no device, are left out."""
    return F.filter(_parts(text), lambda p: p != "-1")


def float_list(text: Column, n: int, default: float = 0.0) -> Column:
    """The first n comma-separated numbers of a string, filled up with ``default``; null where one of its parts is no number."""
    values = F.transform(_parts(text), lambda p: p.try_cast("double"))
    return F.when(~F.exists(values, lambda v: v.isNull()), F.slice(F.concat(values, F.array_repeat(F.lit(float(default)), n)), 1, n))
