"""Accessors of a ``STATS`` struct column; all are JVM expressions. Each returns NaN where it is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAN = float("nan")


def _col(s) -> Column:
    return F.col(s) if isinstance(s, str) else s


def _n(s: Column) -> Column:
    return s["count"].cast("double")


def _nan_if_empty(s: Column, value: Column) -> Column:
    return F.when(s["count"] > 0, value).otherwise(F.lit(_NAN))


def count(s) -> Column:
    return _col(s)["count"]


def total(s) -> Column:
    """Sum of the values; 0 when there are none."""
    return _col(s)["sum"]


def minimum(s) -> Column:
    s = _col(s)
    return _nan_if_empty(s, s["min"])


def maximum(s) -> Column:
    s = _col(s)
    return _nan_if_empty(s, s["max"])


def mean(s) -> Column:
    s = _col(s)
    return _nan_if_empty(s, F.try_divide(s["sum"], _n(s)))


def var(s, ddof: int = 0) -> Column:
    """m2 / (count - ddof); NaN when count <= ddof."""
    s = _col(s)
    return F.when((s["count"] > ddof) & (s["count"] > 0), F.try_divide(s["m2"], _n(s) - F.lit(float(ddof)))).otherwise(F.lit(_NAN))


def std(s, ddof: int = 0) -> Column:
    return F.sqrt(var(s, ddof))


def _varied(s: Column, value: Column) -> Column:
    """NaN for a stream that is empty or holds one value only."""
    return F.when((s["count"] > 0) & (s["min"] != s["max"]), value).otherwise(F.lit(_NAN))


def skew(s, bias: bool = True) -> Column:
    """Third standardised moment; without bias it is corrected from three observations on."""
    s = _col(s)
    n = _n(s)
    raw = F.when(s["m2"] == 0, F.lit(0.0)).otherwise(F.try_divide(s["m3"] / n, F.pow(s["m2"] / n, 1.5)))
    if not bias:
        raw = F.when((n > 2) & (s["m2"] > 0), raw * F.try_divide(F.sqrt(n * (n - 1.0)), n - 2.0)).otherwise(raw)
    return _varied(s, raw)


def kurt(s, fisher: bool = True, bias: bool = True) -> Column:
    """Fourth standardised moment, less 3 for Fisher's; without bias it is corrected from four observations on."""
    s = _col(s)
    n = _n(s)
    k = F.when(s["m2"] == 0, F.lit(0.0)).otherwise(F.try_divide(s["m4"] / n, F.pow(s["m2"] / n, 2.0)))
    if not bias:
        fair = F.try_divide((n * n - 1.0) * k - 9.0 * n + 15.0, (n - 2.0) * (n - 3.0))
        k = F.when((n > 3) & (s["m2"] > 0), fair).otherwise(k)
    return _varied(s, k - 3.0 if fisher else k)


#: Counts and even moments that aren't negative, extremes in order, and nothing but zeros where nothing was counted.
VALID = """coalesce({s}.count >= 0 AND {s}.sum IS NOT NULL AND {s}.m2 >= 0D AND {s}.m3 IS NOT NULL AND {s}.m4 >= 0D
 AND CASE WHEN {s}.count > 0 THEN {s}.min <= {s}.max ELSE {s}.min IS NULL AND {s}.max IS NULL AND {s}.sum = 0D AND {s}.m2 = 0D AND {s}.m3 = 0D AND {s}.m4 = 0D END, false)"""


def valid(s: str) -> Column:
    """Whether stored statistics are sound; NULL aren't."""
    return F.expr(VALID.format(s=s))


def describe(s) -> Column:
    """Text such as ``stats(count=10)``."""
    return F.format_string("stats(count=%d)", _col(s)["count"])
