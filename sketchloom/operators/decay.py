"""Digests and counts of rows that weigh less with age, by forward decay.

A row of time t weighs 2 ** ((t - landmark) / half_life) when it comes in, so that its weight never has to be touched
again: as time goes on all weights shrink alike, which changes no quantile and no share. A decayed digest keeps its
landmark; where digests of different landmarks meet, those of earlier ones are scaled to the latest. A landmark near the
latest rows keeps weights in a double's range; rows whose weight is under the double's epsilon are left out, some 52
half-lives before it. Counts are whole numbers, of ``UNIT`` for each row as old as the landmark; rows of under half a
unit, some 21 half-lives before it, are left out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.checks import key_list, number
from sketchloom.functions.digest import sql_scale
from sketchloom.operators import spacesaving, tdigest

#: What a row as old as the landmark counts in a summary; 2 ** 63 / UNIT such rows are the most that an item can have.
UNIT = 1 << 20


def _half_life(seconds: float) -> float:
    if number(seconds, "half_life") <= 0:
        raise ValueError("half_life must be > 0")
    return float(seconds)


def _age(ts: str, life: float, landmark: float) -> Column:
    """Half-lives from the landmark on."""
    return (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - landmark) / life


def _parts(out: str, life: float, landmark: float, of: str) -> Column:
    return F.struct(F.lit(landmark).alias("landmark"), F.lit(life).alias("half_life"), F.col(out).alias(of))


def build(df: DataFrame, keys, x: str, ts: str, half_life: float, landmark: float, compression: float = 100.0, out: str = "decayed") -> DataFrame:
    """One decayed digest for each key: ``struct<landmark, half_life, digest>``; ``half_life`` and ``landmark`` are in seconds (since 1970).

    Rows without a time are skipped, as are values that a digest skips. A row so far ahead of the landmark that its weight
    isn't finite fails the query.
    """
    keys, life, at = key_list(keys), _half_life(half_life), number(landmark, "landmark")
    age = _age(ts, life, at)
    weight = F.when(age > -1000, F.pow(F.lit(2.0), age)).otherwise(F.lit(1e-300))
    rows = df.filter(F.col(ts).isNotNull()).select(*keys, F.col(x), weight.alias("__weight"))
    return tdigest.build(rows, keys, x, weight="__weight", compression=compression, out=out).withColumn(out, _parts(out, life, at, "digest"))


def build_counts(df: DataFrame, keys, item: str, ts: str, half_life: float, landmark: float, capacity: int = 20, out: str = "decayed") -> DataFrame:
    """One decayed summary for each key: ``struct<landmark, half_life, summary>``, a Space-Saving summary that counts in ``UNIT``.

    Rows without a time are skipped, as are NULL items; a row too far ahead of the landmark for a long fails the query.
    """
    keys, life, at = key_list(keys), _half_life(half_life), number(landmark, "landmark")
    age = F.greatest(_age(ts, life, at), F.lit(-1000.0))
    rows = df.filter(F.col(ts).isNotNull()).select(*keys, F.col(item), F.round(F.pow(F.lit(2.0), age) * UNIT).cast("long").alias("__count"))
    return spacesaving.build(rows.filter("__count > 0"), keys, item, count="__count", capacity=capacity, out=out).withColumn(out, _parts(out, life, at, "summary"))


def _aligned(df: DataFrame, keys: list[str], decayed: str) -> DataFrame:
    """(keys, __landmark, __life, __sketch, __f): the sketches, the latest landmark of all, and by what each must be scaled to it."""
    c = F.col(decayed)
    of = df.schema[decayed].dataType.names[-1]
    latest = df.agg(F.max(c["landmark"]).alias("__landmark"), F.min(c["half_life"]).alias("__life"), F.max(c["half_life"]).alias("__other"))
    rows = df.filter(c.isNotNull()).crossJoin(F.broadcast(latest))  # one row
    same = F.when(F.col("__life") == F.col("__other"), F.col("__life")).otherwise(F.raise_error(F.lit("half-lives differ")).cast("double"))
    rows = rows.select(*keys, "__landmark", same.alias("__life"), c["landmark"].alias("__from"), c[of].alias("__sketch"))
    return rows.withColumn("__f", F.pow(F.lit(2.0), F.greatest((F.col("__from") - F.col("__landmark")) / F.col("__life"), F.lit(-1000.0))))


def _joined(merged: DataFrame, keys: list[str], decayed: str, of: str) -> DataFrame:
    return merged.select(*keys, F.struct(F.col("__landmark").alias("landmark"), F.col("__life").alias("half_life"), F.col(decayed).alias(of)).alias(decayed))


def merge(df: DataFrame, keys, decayed: str = "decayed") -> DataFrame:
    """Merges the decayed digests of each key, as of the latest landmark of all; their half-lives must be the same."""
    keys = key_list(keys)
    rows = _aligned(df, keys, decayed).select(*keys, "__landmark", "__life", F.expr(sql_scale("__sketch", "__f")).alias(decayed))
    return _joined(tdigest.merge(rows, [*keys, "__landmark", "__life"], decayed), keys, decayed, "digest")


def merge_counts(df: DataFrame, keys, decayed: str = "decayed", capacity: int | None = None) -> DataFrame:
    """The same for decayed summaries. Scaled counts are rounded away from what is sure, so that count - error and count stay bounds."""
    keys = key_list(keys)
    s, f = F.col("__sketch"), F.col("__f")

    def scaled(c: Column) -> Column:
        most, sure = F.ceil(c["count"] * f).cast("long"), F.floor((c["count"] - c["error"]) * f).cast("long")
        return F.struct(c["item"].alias("item"), most.alias("count"), (most - sure).alias("error"))

    summary = F.struct(s["capacity"].alias("capacity"), F.ceil(s["m"] * f).cast("long").alias("m"), F.transform(s["counters"], scaled).alias("counters"))
    rows = _aligned(df, keys, decayed).select(*keys, "__landmark", "__life", F.when(f == 1.0, s).otherwise(summary).alias(decayed))
    return _joined(spacesaving.merge(rows, [*keys, "__landmark", "__life"], decayed, capacity), keys, decayed, "summary")


def topk_at(s: str, k: int, seconds: float) -> Column:
    """The first k counters as ``array<struct<item, count, error>>``, weights at a time in rows of age 0."""
    c = F.col(s)
    f = F.pow(F.lit(2.0), (c["landmark"] - F.lit(number(seconds, "seconds"))) / c["half_life"]) / UNIT
    return F.transform(spacesaving.topk(f"{s}.summary", k), lambda x: F.struct(x["item"].alias("item"), (x["count"] * f).alias("count"), (x["error"] * f).alias("error")))


def size_at(s: str, seconds: float) -> Column:
    """Weight of all rows at a time, in rows of age 0."""
    c = F.col(s)
    return c["digest"]["total_weight"] * F.pow(F.lit(2.0), (c["landmark"] - F.lit(number(seconds, "seconds"))) / c["half_life"])
