"""Spark's own mergeable sketches by the interface of this library: KLL quantile sketches and approximate top-k states.

Both are built, stored, merged by other keys and queried like digests and summaries, and run in the JVM alone, with a
partial state for each task and key before the shuffle. A KLL sketch is a binary column whose rank error doesn't depend on
where in the distribution the rank is (about 2.3 / k ** 0.97, 99 times of 100); a t-digest is more exact in its tails. A top-k
state is a struct with a binary sketch, and counts of at most ``tracked`` items.

Defined cases: NULLs are skipped; NaN and infinities are skipped by ``kll``. An empty table without keys gives one row, one
with keys none; a merge of no top-k states gives none either way, as they have no type of items then. A KLL sketch without values has NULL quantiles and ranks; a top-k state without items gives no items.
"""

from __future__ import annotations

from numbers import Integral

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchloom.functions.checks import key_list, numbers


def _whole(value: int, name: str, least: int, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, Integral):
        raise TypeError(f"{name} must be a whole number")
    if not least <= value <= most:
        raise ValueError(f"{name} must be from {least} to {most}")
    return int(value)


def kll(df: DataFrame, keys, x: str, k: int = 200, out: str = "kll") -> DataFrame:
    """One KLL sketch of doubles for each key; ``k`` from 8 to 65535, the larger the more exact."""
    if not isinstance(df.schema[x].dataType, T.NumericType):
        raise TypeError(f"{x} must be a numeric column")
    v = F.col(x).cast("double")
    return df.groupBy(*key_list(keys)).agg(F.kll_sketch_agg_double(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v), F.lit(_whole(k, "k", 8, 65535))).alias(out))


def kll_merge(df: DataFrame, keys, sketch: str = "kll") -> DataFrame:
    return df.groupBy(*key_list(keys)).agg(F.kll_merge_agg_double(F.col(sketch)).alias(sketch))


def kll_size(sketch: str) -> Column:
    return F.kll_sketch_get_n_double(F.col(sketch))


def kll_quantile(sketch: str, q) -> Column:
    """Quantiles at the given probabilities, an array; a q outside [0, 1] counts as the nearer end."""
    qs = F.array(*(F.lit(min(1.0, max(0.0, p))) for p in numbers(q, "q")))
    return F.when(kll_size(sketch) > 0, F.kll_sketch_get_quantile_double(F.col(sketch), qs))


def kll_cdf(sketch: str, x) -> Column:
    """Shares of values up to the given ones, an array."""
    return F.when(kll_size(sketch) > 0, F.kll_sketch_get_rank_double(F.col(sketch), F.array(*map(F.lit, numbers(x, "x")))))


def topk_state(df: DataFrame, keys, item: str, tracked: int = 10000, out: str = "state") -> DataFrame:
    """One top-k state for each key, with counts of up to ``tracked`` items."""
    tracked = _whole(tracked, "tracked", 1, 1_000_000)
    name = "`" + item.replace("`", "``") + "`"
    return df.groupBy(*key_list(keys)).agg(F.expr(f"approx_top_k_accumulate({name}, {tracked}) FILTER (WHERE {name} IS NOT NULL)").alias(out))


def topk_merge(df: DataFrame, keys, state: str = "state", tracked: int = 10000) -> DataFrame:
    tracked = _whole(tracked, "tracked", 1, 1_000_000)
    by = key_list(keys) or [F.lit(1).alias("__all")]
    return df.groupBy(*by).agg(F.expr(f"approx_top_k_combine(`{state}`, {tracked})").alias(state)).drop("__all")


def topk_estimate(state: str, k: int = 5) -> Column:
    """The ``k`` most frequent items and their counts, an array of structs."""
    return F.expr(f"approx_top_k_estimate(`{state}`, {_whole(k, 'k', 1, 1_000_000)})")
