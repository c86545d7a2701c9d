"""Parameter and column checks shared by the three families.

Missing values: NULL and NaN are skipped by every family; t-digests skip infinities too. Accessors on an empty sketch
return NaN, never NULL. Bad parameters raise ValueError or TypeError when the plan is built; bad weights in the data
fail the query.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from numbers import Integral, Real

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 2.220446049250313e-16


def numeric(df: DataFrame, name: str) -> Column:
    """The column as double; TypeError unless it is boolean or a number."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{name} is {kind.simpleString()}, not numeric")
    return F.col(name).cast("double")


def integral_weight(df: DataFrame, weight: str | int) -> Column:
    """A whole positive weight: a constant is checked at once, a column row by row."""
    if isinstance(weight, str):
        if not isinstance(df.schema[weight].dataType, T.IntegralType):
            raise TypeError(f"{weight} must hold whole numbers")
        c = F.col(weight).cast("long")
    else:
        if isinstance(weight, bool) or not isinstance(weight, Integral):
            raise TypeError("count must be a whole number")
        if weight <= 0:
            raise ValueError("count must be > 0")
        return F.lit(int(weight)).cast("long")
    return F.when(c > 0, c).otherwise(F.raise_error(F.lit("count must be > 0")).cast("long"))


def real_weight(df: DataFrame, weight: str | float) -> Column:
    """A finite positive weight for t-digests."""
    if isinstance(weight, str):
        w = numeric(df, weight)
    else:
        number(weight, "w")
        if weight <= 0:
            raise ValueError("w must be > 0")
        return F.lit(float(weight))
    return F.when((w > 0) & (w < float("inf")) & ~F.isnan(w), w).otherwise(F.raise_error(F.lit("w must be finite and > 0")).cast("double"))


def number(x, name: str) -> float:
    if isinstance(x, bool) or not isinstance(x, Real):
        raise TypeError(f"{name} must be a number")
    if not math.isfinite(x):
        raise ValueError(f"{name} must be finite")
    return float(x)


def numbers(xs, name: str) -> list[float]:
    return [number(x, name) for x in (xs if isinstance(xs, Iterable) and not isinstance(xs, str) else [xs])]


def key_list(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys or [])
