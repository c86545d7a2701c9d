"""Queries on a ``TDIGEST`` struct column. All are JVM expressions over the centroid array.

The distribution function is the polyline through (min, 0), (mean_i, weight before i + weight_i / 2) and (max, total);
quantile is its inverse. A digest is named by its column's name, such as ``"digest"`` or ``"row.digest"``. The SQL texts
serve the DataFrame functions and the SQL functions alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sketchloom.functions.checks import EPS, number, numbers

#: {s} is the digest, {q} a double. (at, prev) is the polyline's point before the one looked at.
QUANTILE = """CASE WHEN {s} IS NULL OR coalesce({s}.total_weight, 0D) <= 0D OR {q} IS NULL THEN double('NaN')
 WHEN {q} <= 0D THEN {s}.min WHEN {q} >= 1D THEN {s}.max WHEN size({s}.centroids) = 1 THEN {s}.centroids[0].mean
 ELSE aggregate({s}.centroids,
  named_struct('cum', 0D, 'at', 0D, 'prev', {s}.min, 'found', CAST(NULL AS DOUBLE)),
  (a, c) -> named_struct('cum', a.cum + c.weight, 'at', a.cum + c.weight / 2D, 'prev', c.mean, 'found',
   coalesce(a.found, CASE WHEN a.cum + c.weight / 2D >= {q} * {s}.total_weight
    THEN a.prev + (c.mean - a.prev) * coalesce(try_divide({q} * {s}.total_weight - a.at, a.cum + c.weight / 2D - a.at), 0D) END)),
  a -> coalesce(a.found, a.prev + ({s}.max - a.prev) * coalesce(try_divide({q} * {s}.total_weight - a.at, {s}.total_weight - a.at), 0D))) END"""

#: {x} is a double. (lm, la) is the last point at or before x, (rm, ra) the first after it.
CDF = """CASE WHEN {s} IS NULL OR coalesce({s}.total_weight, 0D) <= 0D OR {x} IS NULL THEN double('NaN')
 WHEN size({s}.centroids) = 1 THEN CASE WHEN {x} < {s}.min THEN 0D WHEN {x} > {s}.max THEN 1D WHEN {s}.max - {s}.min < {eps}D THEN 0.5D
  ELSE ({x} - {s}.min) / ({s}.max - {s}.min) END
 WHEN {x} >= {s}.max THEN 1D WHEN {x} <= {s}.min THEN 0D
 ELSE aggregate({s}.centroids,
  named_struct('cum', 0D, 'lm', {s}.min, 'la', 0D, 'rm', CAST(NULL AS DOUBLE), 'ra', CAST(NULL AS DOUBLE)),
  (a, c) -> named_struct('cum', a.cum + c.weight,
   'lm', CASE WHEN c.mean <= {x} THEN c.mean ELSE a.lm END, 'la', CASE WHEN c.mean <= {x} THEN a.cum + c.weight / 2D ELSE a.la END,
   'rm', CASE WHEN c.mean > {x} AND a.rm IS NULL THEN c.mean ELSE a.rm END, 'ra', CASE WHEN c.mean > {x} AND a.rm IS NULL THEN a.cum + c.weight / 2D ELSE a.ra END),
  a -> (a.la + (coalesce(a.ra, {s}.total_weight) - a.la) * coalesce(try_divide({x} - a.lm, coalesce(a.rm, {s}.max) - a.lm), 0D)) / {s}.total_weight) END"""

#: Centroids in order, of finite means between minimum and maximum and of positive weights that add up to the total.
VALID = """coalesce({s}.compression >= 20D AND {s}.compression <= 1000D
 AND forall({s}.centroids, c -> coalesce(c.weight > 0D AND c.weight < double('Infinity') AND abs(c.mean) < double('Infinity'), false))
 AND forall(transform({s}.centroids, (c, i) -> i = 0 OR c.mean >= get({s}.centroids, i - 1).mean), x -> x)
 AND abs({s}.total_weight - aggregate({s}.centroids, 0D, (a, c) -> a + c.weight)) <= 1e-9D * {s}.total_weight
 AND (size({s}.centroids) = 0 OR {s}.min - 1e-9D * ({s}.max - {s}.min) <= get({s}.centroids, 0).mean AND get({s}.centroids, size({s}.centroids) - 1).mean <= {s}.max + 1e-9D * ({s}.max - {s}.min)), false)"""


def sql_quantile(s: str, q: str) -> str:
    return QUANTILE.format(s=s, q=q)


def sql_cdf(s: str, x: str) -> str:
    return CDF.format(s=s, x=x, eps=EPS)


def _array(values: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


def quantile(s: str, q) -> Column:
    """Quantile at a number, or an array of them at a list. q outside [0, 1] clamps; a q that isn't finite is a ValueError."""
    qs = numbers(q, "q")
    if isinstance(q, (int, float)):
        return F.expr(sql_quantile(s, f"{qs[0]!r}D"))
    return F.expr(f"transform({_array(qs)}, q -> {sql_quantile(s, 'q')})") if qs else F.array().cast("array<double>")


def cdf(s: str, x) -> Column:
    """Share of the weight at or below a number, or an array of shares at a list."""
    xs = numbers(x, "x")
    if isinstance(x, (int, float)):
        return F.expr(sql_cdf(s, f"{xs[0]!r}D"))
    return F.expr(f"transform({_array(xs)}, x -> {sql_cdf(s, 'x')})") if xs else F.array().cast("array<double>")


def quantile_of(s: str, q: str) -> Column:
    """Quantile at the probability in column ``q``."""
    return F.expr(sql_quantile(s, q))


def cdf_of(s: str, x: str) -> Column:
    """Share at the value in column ``x``; it must be finite, and NULL gives NaN."""
    return F.expr(sql_cdf(s, x))


def histogram(s: str, bins=10, range: tuple[float, float] | None = None) -> Column:
    """``struct<hist array<double>, edges array<double>>``: weight between successive edges.

    ``bins`` is a number of equal bins or a sorted list of edges. The range defaults to (min, max); if both are equal it
    is widened by a half on each side. Weight outside the range is left out. An empty digest gives zeros.
    """
    if range is not None:
        lo, hi = (number(v, "range") for v in range)
        if lo > hi:
            raise ValueError("range must not decrease")
    if isinstance(bins, bool) or isinstance(bins, str):
        raise TypeError("bins must be a whole number or a list of edges")
    if isinstance(bins, float) and not bins.is_integer():
        raise TypeError("bins must be a whole number")
    if isinstance(bins, (int, float)):
        if bins < 1:
            raise ValueError("bins must be >= 1")
        n = int(bins)
        if range is None:
            lo, hi = f"(CASE WHEN {s}.total_weight > 0D THEN {s}.min ELSE 0D END)", f"(CASE WHEN {s}.total_weight > 0D THEN {s}.max ELSE 0D END)"
        else:
            lo, hi = f"{lo!r}D", f"{hi!r}D"
        wide = f"(CASE WHEN {lo} = {hi} THEN 0.5D ELSE 0D END)"
        edges = f"transform(sequence(0, {n}), i -> CASE WHEN i = {n} THEN {hi} + {wide} ELSE {lo} - {wide} + ({hi} - {lo} + 2D * {wide}) * i / {n}D END)"
    else:
        es = numbers(bins, "bins")
        if not es:
            raise ValueError("bins must have an edge at least")
        if any(a > b for a, b in zip(es, es[1:])):
            raise ValueError("bins must not decrease")
        n, edges = len(es) - 1, _array(es)
    shares = f"array(transform({edges}, x -> {sql_cdf(s, 'x')}))"  # in an array, whose lambda reads it twice but makes it once
    if n == 0:
        hist = "CAST(array() AS ARRAY<DOUBLE>)"
    else:
        hist = f"CASE WHEN coalesce({s}.total_weight, 0D) <= 0D THEN array_repeat(0D, {n}) ELSE flatten(transform({shares}, c -> zip_with(slice(c, 1, {n}), slice(c, 2, {n}), (a, b) -> (b - a) * {s}.total_weight))) END"
    return F.expr(f"named_struct('hist', {hist}, 'edges', {edges})")


def valid(s: str) -> Column:
    """Whether a stored digest is sound; NULL isn't."""
    return F.expr(VALID.format(s=s))


def minimum(s: str) -> Column:
    return F.expr(f"CASE WHEN {s}.total_weight > 0D THEN {s}.min ELSE double('NaN') END")


def maximum(s: str) -> Column:
    return F.expr(f"CASE WHEN {s}.total_weight > 0D THEN {s}.max ELSE double('NaN') END")


def size(s: str) -> Column:
    """Total weight."""
    return F.expr(f"{s}.total_weight")


def compression(s: str) -> Column:
    return F.expr(f"{s}.compression")


def centroids(s: str) -> Column:
    """Array of (mean, weight), sorted by mean; ``inline`` makes rows of it."""
    return F.expr(f"{s}.centroids")


def scale(s: str, factor: float) -> Column:
    """All weights times ``factor``; centroids whose weight vanishes go. Min and max stay unless nothing is left."""
    f = number(factor, "factor")
    if f <= 0:
        raise ValueError("factor must be > 0")
    return F.expr(sql_scale(s, f"{f!r}D"))


def sql_scale(s: str, f: str) -> str:
    kept = f"filter(transform({s}.centroids, c -> named_struct('mean', c.mean, 'weight', c.weight * {f})), c -> c.weight > {EPS}D)"
    return (
        f"named_struct('compression', {s}.compression, 'min', CASE WHEN size({kept}) > 0 THEN {s}.min END, 'max', CASE WHEN size({kept}) > 0 THEN {s}.max END,"
        f" 'total_weight', aggregate({kept}, 0D, (a, c) -> a + c.weight), 'centroids', {kept})"
    )


def describe(s: str) -> Column:
    return F.expr(f"format_string('tdigest(compression=%s, size=%s)', {s}.compression, {s}.total_weight)")
