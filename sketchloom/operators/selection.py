"""Exact quantiles by selection: a digest brackets each rank, exact counts narrow the bracket until it fits.

No pass sorts the rows. The first builds digests, whose quantiles around a rank are a guess of where its value is. Each
later pass cuts every bracket into cells of equal width and counts the rows of each cell, exactly and within each task
first; the cell that holds the rank, from its least to its greatest value, is the next bracket. A guess that misses does
no harm, as what is below and above it are cells too. Once a bracket has at most ``fit`` rows its distinct values are
counted and ranked; as a rule that is the third pass. Keys of few rows are ranked at once. What tasks send on are counts, and values of brackets that fit.

Defined cases: NULL, NaN and infinite values are skipped; a key without any other value, or an empty table, has no row;
zeros of either sign are one value; NULL is a key like others. Whole numbers of any size stay exact; decimals are read as
doubles. A key that holds most rows is in as many tasks as its rows are, for only counts are grouped.
"""

from __future__ import annotations

from numbers import Integral

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchloom.functions.checks import key_list, numbers
from sketchloom.functions.digest import sql_quantile
from sketchloom.operators import tdigest
from sketchloom.sources.tables import load, save, scratch

#: Rows of a bracket that are ranked at once; cells of a bracket in a pass; and the share of rows by which a first bracket reaches beyond its rank on either side.
FIT, CELLS, REACH = 1_000_000, 2048, 0.005
#: Rows up to which a key is ranked at once: less than the cells of its brackets would be.
SMALL = 50_000
#: Keys up to which brackets go to all tasks, some 100 bytes for each rank; beyond, rows are joined to them in so many parts of a key.
BROADCAST_KEYS, SALTS = 10_000, 16
_WHOLE = T.DecimalType(20, 0)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read back."""
    path = scratch(df.sparkSession, name)
    save(df, path)
    return load(df.sparkSession, path)


def _rows(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(k0, k1, ..., x): x as a decimal without a fraction, or as a double."""
    kind = df.schema[x].dataType
    if isinstance(kind, T.IntegralType):
        value = F.col(x).cast(_WHOLE)
    elif isinstance(kind, T.NumericType):
        value = F.col(x).cast("double") + F.lit(0.0)
    else:
        raise TypeError(f"{x} must be a numeric column")
    rows = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), value.alias("x")).filter("x IS NOT NULL")
    return rows if isinstance(kind, T.IntegralType) else rows.filter(~F.isnan("x") & (F.abs("x") < float("inf")))


def _place(n: Column, q: float, midpoints: bool) -> Column:
    """The rank less 1, with a fraction, of a quantile of n values."""
    if midpoints:
        return F.greatest(F.lit(0.0), F.least(n * F.lit(q) - 0.5, n - 1.0))
    return (n - 1) * F.lit(q)


def _ranks(n: Column, qs: list[float], midpoints: bool) -> Column:
    return F.array_distinct(F.array(*(c.cast("long") + 1 for at in (_place(n, q, midpoints) for q in qs) for c in (F.floor(at), F.ceil(at)))))


def _targets(rows: DataFrame, names: list[str], qs: list[float], whole: bool, midpoints: bool) -> DataFrame:
    """(k0, ..., n, rank, want, lo, hi, rows): the ranks on either side of each quantile, with guesses of where they are."""
    digests = tdigest.build(rows.withColumn("x", F.col("x").cast("double")), names, "x", out="d").filter("d.total_weight > 0").withColumn("n", F.col("d.total_weight").cast("long"))
    t = digests.select(*names, "n", "d", F.explode(_ranks(F.col("n"), qs, midpoints)).alias("rank"))
    lo, hi = (F.expr(sql_quantile("d", f"(double(rank) / n {by})")) for by in (f"- {REACH}D", f"+ {REACH}D"))
    if whole:
        lo, hi = F.floor(lo).cast(_WHOLE), F.ceil(hi).cast(_WHOLE)
    return t.select(*names, "n", "rank", F.col("rank").alias("want"), lo.alias("lo"), hi.alias("hi"), F.col("n").alias("rows"))


def _within(rows: DataFrame, targets: DataFrame, names: list[str], inside: bool) -> DataFrame:
    """(k0, ..., rank, want, lo, hi, x): the rows beside the brackets of their keys, or only those inside."""
    t = targets.groupBy(*names).agg(F.collect_list(F.struct("rank", "want", "lo", "hi")).alias("t"))  # two ranks for each quantile
    if not names:
        joined = rows.crossJoin(F.broadcast(t))  # one row
    elif t.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        t = t.select(*(F.col(k).alias(f"t_{k}") for k in names), "t")
        joined = rows.join(F.broadcast(t), [rows[k].eqNullSafe(t[f"t_{k}"]) for k in names])
    else:
        t = t.select(*(F.col(k).alias(f"t_{k}") for k in names), "t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t_salt"))
        rows = rows.withColumn("salt", F.monotonically_increasing_id() % SALTS)
        joined = rows.join(t, [*(rows[k].eqNullSafe(t[f"t_{k}"]) for k in names), rows["salt"] == t["t_salt"]])
    beside = F.filter("t", lambda b: F.col("x").between(b["lo"], b["hi"])) if inside else F.col("t")
    return joined.select(*names, "x", F.explode(beside).alias("b")).select(*names, "b.*", "x")


def _cell(cells: int, whole: bool) -> Column:
    """-1 below the bracket, ``cells`` above it, else the number of the cell; it never falls as x rises."""
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    if whole:
        share = (x - lo).cast("double") / F.nullif((hi - lo).cast("double"), F.lit(0.0))
    else:  # a quarter of each where a difference of doubles might be too large for one
        by = F.when(F.greatest(F.abs(lo), F.abs(hi)) > 1e300, 0.25).otherwise(1.0)
        share = (x * by - lo * by) / F.nullif(hi * by - lo * by, F.lit(0.0))
    at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells), F.lit(cells - 1)).cast("int")
    return F.when(x < lo, -1).when(x > hi, cells).otherwise(at)


def exact_quantiles(df: DataFrame, keys, x: str, q, out: str = "quantiles", fit: int = FIT, cells: int = CELLS, midpoints: bool = False) -> DataFrame:
    """Each key's exact quantiles, as an array in the order of ``q``, linear between neighbouring values as in ``percentile``,
    or with ``midpoints`` as in a digest whose points all stay apart: the i-th value is at i - 1/2.

    A q outside [0, 1] counts as the nearer end. ``fit`` bounds the rows of a bracket that are ranked at once, ``cells``
    (at least 2) is what a bracket is cut into in each pass; neither changes the result. The driver reads how many rows the largest bracket has.
    """
    keys, qs = key_list(keys), [min(1.0, max(0.0, p)) for p in numbers(q, "q")]
    if not qs:
        raise ValueError("q must have a number")
    for value, name, least in ((fit, "fit", 1), (cells, "cells", 2)):
        if isinstance(value, bool) or not isinstance(value, Integral):
            raise TypeError(f"{name} must be a whole number")
        if value < least:
            raise ValueError(f"{name} must be at least {least}")
    rows, names = _rows(df, keys, x), [f"k{i}" for i in range(len(keys))]
    whole = isinstance(rows.schema["x"].dataType, T.DecimalType)
    large = _kept(rows.groupBy(*names).agg(F.count("*").alias("n")).filter(F.col("n") > min(fit, SMALL)), "large")
    n_large = large.limit(BROADCAST_KEYS + 1).count()
    small = None
    if not n_large:
        small = rows
    elif names:
        of = large.select(*(F.col(k).alias(f"l_{k}") for k in names))
        of = F.broadcast(of) if n_large <= BROADCAST_KEYS else of
        same = [rows[k].eqNullSafe(of[f"l_{k}"]) for k in names]
        small, rows = rows.join(of, same, "left_anti"), rows.join(of, same, "left_semi")
    if small is not None:
        at_once = _at_once(small, names, qs, midpoints)
    if not n_large:
        return _interpolated(at_once, keys, names, qs, whole, midpoints, out)
    targets, known = _kept(_targets(rows, names, qs, whole, midpoints), "brackets"), False
    each = [*names, "rank"]
    while not known or (targets.filter("lo < hi").agg(F.max("rows")).first()[0] or 0) > fit:
        counted = _within(rows, targets if not known else targets.filter("lo < hi"), names, known)
        counted = counted.groupBy(*each, "want", _cell(cells, whole).alias("cell")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*each).orderBy("cell"))  # a row for each cell
        found = counted.withColumn("upto", upto).filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("c") < F.col("want")))
        found = found.select(*each, (F.col("want") - F.col("upto") + F.col("c")).alias("want"), "lo", "hi", F.col("c").alias("rows"))
        if known:
            found = found.unionByName(targets.filter("lo = hi").select(found.columns))
        else:
            sizes = targets.select(*names, "n").distinct()
        targets, known = _kept(found, "brackets"), True
    open_ = targets.filter("lo < hi")
    ranked = _within(rows, open_, names, True).groupBy(*each, "want", "x").agg(F.count("*").alias("c"))
    ranked = ranked.withColumn("upto", F.sum("c").over(Window.partitionBy(*each).orderBy("x")))  # of a bracket that fits
    ranked = ranked.filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("c") < F.col("want"))).select(*each, "x")
    values = ranked.unionByName(targets.filter("lo = hi").select(*each, F.col("lo").alias("x"))).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("v"))
    values = values.select(*(F.col(k).alias(f"v_{k}") for k in names), "v")
    both = sizes.join(values, [sizes[k].eqNullSafe(values[f"v_{k}"]) for k in names]) if names else sizes.crossJoin(F.broadcast(values))  # one row
    both = both.select(*names, "n", "v")
    return _interpolated(both if small is None else both.unionByName(at_once), keys, names, qs, whole, midpoints, out)


def _at_once(rows: DataFrame, names: list[str], qs: list[float], midpoints: bool) -> DataFrame:
    """(k0, ..., n, v): the ranked values of keys that have few rows."""
    of = Window.partitionBy(*(names or [F.lit(1)]))
    ranked = rows.select(*names, "x", F.row_number().over(of.orderBy("x")).cast("long").alias("rank"), F.count("*").over(of).alias("n"))
    ranked = ranked.filter(F.array_contains(_ranks(F.col("n"), qs, midpoints), F.col("rank")))
    return ranked.groupBy(*names, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("v"))


def _interpolated(both: DataFrame, keys: list[str], names: list[str], qs: list[float], whole: bool, midpoints: bool, out: str) -> DataFrame:
    """The quantiles of (k0, ..., n, v), by values next to their places."""

    def between(p: float) -> Column:
        h = _place(F.col("n"), p, midpoints)
        a, b = (F.element_at("v", c.cast("long") + 1) for c in (F.floor(h), F.ceil(h)))
        share = h - F.floor(h)
        if whole:
            return a.cast("double") + (b - a).cast("double") * share
        return F.when((F.abs(a) < 1e300) & (F.abs(b) < 1e300), a + (b - a) * share).otherwise(a * (1 - share) + b * share)

    return both.select(*(F.col(k).alias(name) for k, name in zip(names, keys)), F.array(*map(between, qs)).alias(out))
