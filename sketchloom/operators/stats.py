"""Summary statistics as a mergeable struct column.

Without weights they are native aggregates. Weighted observations and summaries that are merged are gone through once:
each task combines its own in numpy, by shifting moments to the common mean, and only a part for each task and key is
shuffled and added up as it comes by.

The weight of an observation multiplies the count but not the sum, so that (x, c) stands for c copies of x / c; pass
``weighting="frequency"`` for c copies of x.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sketchloom.functions.checks import integral_weight, key_list, numeric
from sketchloom.functions.types import STATS
from sketchloom.operators.keys import key_codes

FIELDS = STATS.names
#: Keys that a task holds before it passes its parts on.
HELD = 200_000


def _pack(n: Column, s: Column, lo: Column, hi: Column, m2: Column, m3: Column, m4: Column) -> Column:
    parts = [n.cast("long").alias("count"), *(c.cast("double").alias(k) for k, c in (("sum", s), ("min", lo), ("max", hi), ("m2", m2), ("m3", m3), ("m4", m4)))]
    return F.struct(*parts)


def build(df: DataFrame, keys, x: str, weight: str | int = 1, weighting: str = "reference", out: str = "stats") -> DataFrame:
    """One row of ``STATS`` for each key. NaN and NULL values are skipped; a key that has no others gets an empty summary.

    Without weights this is a single partial and final hash aggregation; with weights each row is a summary of its own.
    """
    if weighting not in ("reference", "frequency"):
        raise ValueError("weighting is 'reference' or 'frequency'")
    keys = key_list(keys)
    value = numeric(df, x)
    value = F.when(F.isnan(value), None).otherwise(value)
    if weight == 1 and not isinstance(weight, bool):
        rows = df.select(*keys, value.alias("__x"))
        return aggregate(rows, keys, "__x", out)
    c = integral_weight(df, weight)
    rows = df.select(*keys, value.alias("__x"), c.alias("__c"))
    each = F.col("__x") if weighting == "reference" else F.col("__x") * F.col("__c").cast("double")
    zero, live = F.lit(0.0), F.col("__x").isNotNull()
    # a row is a summary of its own; a skipped one has count 0. The weight of a skipped row is still checked.
    single = _pack(F.when(live, F.col("__c")).otherwise(F.col("__c") * 0), F.when(live, each).otherwise(zero), F.col("__x"), F.col("__x"), zero, zero, zero)
    return merge(rows.select(*keys, single.alias(out)), keys, out)


#: Spark's skewness and kurtosis divide by powers of m2, which leave a double's range long before m3 and m4 do. So they
#: are taken of values times a power of two, which depends on a key's largest magnitude: (from which on, factor).
RANGES = [(1e50, 2.0**-240), (1e-22, 1.0), (1e-94, 2.0**240)]
#: Scaled values under this are taken as 0: beside the largest they don't count, and m2 of others can't vanish by rounding.
FLUSH = 1e-37


def _standard(function: str, v: str) -> str:
    """Skewness or kurtosis of values of whatever size; where all are under 1e-94 their moments have no place in a double."""
    most = f"greatest(abs(min({v})), abs(max({v})))"
    cases, above = [], None
    for least, factor in RANGES:
        beyond = "" if above is None else f"WHEN abs({v}) >= {above!r}D THEN 0D "  # such keys are another range's
        value = f"CASE WHEN abs({v}) < {FLUSH / factor!r}D THEN 0D {beyond}ELSE {v} * {factor!r}D END"
        cases.append(f"WHEN {most} >= {least!r}D THEN {function}({value})")
        above = least
    return "CASE " + " ".join(cases) + " END"


def aggregate(df: DataFrame, keys: list[str], x: str, out: str = "stats") -> DataFrame:
    """``build`` for a double column whose NaNs are NULL already; it also works on a streaming DataFrame."""
    v = f"`{x}`"
    aggs = [F.expr(f"{f}({v}) AS {n}") for f, n in (("count", "__n"), ("sum", "__s"), ("min", "__lo"), ("max", "__hi"), ("var_pop", "__v"))]
    aggs += [F.expr(f"{_standard(f, v)} AS {n}") for f, n in (("skewness", "__g"), ("kurtosis", "__k"))]
    m2 = "coalesce(__v * __n, 0D)"
    m3 = f"CASE WHEN __n > 0 THEN coalesce(__g * pow({m2}, 1.5D) / sqrt(__n), 0D) ELSE 0D END"
    m4 = f"CASE WHEN __n > 0 THEN coalesce((__k + 3D) * {m2} * {m2} / __n, 0D) ELSE 0D END"
    packed = F.expr(f"named_struct('count', __n, 'sum', coalesce(__s, 0D), 'min', __lo, 'max', __hi, 'm2', {m2}, 'm3', {m3}, 'm4', {m4})")
    return df.groupBy(*keys).agg(*aggs).select(*keys, packed.alias(out))


def merge(df: DataFrame, keys, stats: str = "stats") -> DataFrame:
    """Merges the summaries of each key: each task those that it reads, then the tasks' parts of a key with each other.

    Both steps hold one summary for each key: parts come sorted by key to the second and are added up as they come by,
    however many tasks there were.
    """
    keys = key_list(keys)
    if [f.name for f in df.schema[stats].dataType] != FIELDS:
        raise TypeError(f"{stats} is not a column of summary statistics")
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(stats, STATS)])
    arrow = to_arrow_schema(schema)
    fields = [(F.col(stats)[f] if f in ("min", "max") else F.coalesce(F.col(stats)[f].cast("double"), F.lit(0.0))).alias(f"__{f}") for f in FIELDS]
    parts = df.select(*keys, *fields).mapInArrow(partial(_partial, nkeys=len(keys), schema=arrow), schema)
    parts = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.repartition(1)
    whole = parts.select(*keys, *fields).mapInArrow(partial(_partial, nkeys=len(keys), schema=arrow, ordered=True), schema)
    if keys:
        return whole
    # without keys there is one summary, of no rows too
    none = F.struct(F.lit(0).cast("long").alias("count"), *(F.lit(None if f in ("min", "max") else 0.0).cast("double").alias(f) for f in FIELDS[1:]))
    return whole.agg(F.coalesce(F.first(stats), none).alias(stats))


def _combine(code: np.ndarray, k: int, n: np.ndarray, s: np.ndarray, lo: np.ndarray, hi: np.ndarray, m2: np.ndarray, m3: np.ndarray, m4: np.ndarray) -> list[np.ndarray]:
    """Fields of ``k`` groups' merged summaries; ``code`` is each summary's group. Moments are shifted to the group's mean."""
    total, sums = np.bincount(code, n, k), np.bincount(code, s, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.nan_to_num(s / n - (sums / total)[code], nan=0.0, posinf=0.0, neginf=0.0)
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(code[order], np.arange(k))
    live = n[order] > 0
    least, most = (f.reduceat(np.where(live, v[order], np.nan), first) if len(code) else np.empty(0) for f, v in ((np.fmin, lo), (np.fmax, hi)))
    return [total, sums, least, most, np.bincount(code, m2 + n * d**2, k), np.bincount(code, m3 + 3 * d * m2 + n * d**3, k), np.bincount(code, m4 + 4 * d * m3 + 6 * d**2 * m2 + n * d**4, k)]


def _partial(batches: Iterator[pa.RecordBatch], nkeys: int, schema: pa.Schema, ordered: bool = False) -> Iterator[pa.RecordBatch]:
    """One part for each key. A task with very many keys passes parts on early; ``ordered`` rows come by key, and of theirs the last key stays."""
    held: dict[tuple, int] = {}
    fields = [np.empty(0)] * len(FIELDS)

    def out(names: list[tuple], values: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in names], type=schema.field(i).type) for i in range(nkeys)]
        parts = [pa.array(values[0].astype(np.int64)), *(pa.array(f, mask=np.isnan(f)) if name in ("min", "max") else pa.array(f) for name, f in zip(FIELDS[1:], values[1:]))]
        return pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(parts, fields=list(schema.field(nkeys).type))], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        code, names = key_codes(b.columns[:nkeys], b.num_rows)
        new = _combine(code, len(names), *(c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[nkeys:]))
        if ordered:
            last = names[code[-1]]
        place = np.array([held.setdefault(name, len(held)) for name in names])
        both = np.concatenate([np.arange(len(fields[0])), place])
        fields = _combine(both, len(held), *(np.concatenate([a, x]) for a, x in zip(fields, new)))
        if len(held) > HELD:
            if not ordered:
                yield out(list(held), fields)
                held, fields = {}, [np.empty(0)] * len(FIELDS)
                continue
            stays = held[last]
            rest = np.array([i for i in range(len(held)) if i != stays])
            everyone = list(held)
            yield out([everyone[i] for i in rest], [f[rest] for f in fields])
            held, fields = {last: 0}, [f[stays : stays + 1] for f in fields]
    if held:
        yield out(list(held), fields)
