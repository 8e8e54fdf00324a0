"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(col, digits: int = 6) -> Column:
    """Rounded value with negative zero folded into zero."""
    return F.round(_col(col), digits) + F.lit(0.0)


def ratio(top, bottom) -> Column:
    """``top / bottom`` as double, 0 where the bottom is 0."""
    bottom = _col(bottom).cast("double")
    return F.when(bottom == 0, F.lit(0.0)).otherwise(_col(top).cast("double") / bottom)


def clip01(col) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(col)))


def banded(value, bands, last) -> Column:
    """First label whose upper bound is above ``value``, else ``last``."""
    value = _col(value)
    out = None
    for bound, label in bands:
        test = value < F.lit(bound)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(last)


def sigmoid(col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(col)))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
