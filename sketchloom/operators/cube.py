"""Cube, rollup and grouping sets over sketches.

Sketches are built once, for the finest keys; each of these few rows is then expanded to the grouping sets and merged, so
that the input is scanned once, however many sets there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.checks import key_list

Merge = Callable[[DataFrame, list[str]], DataFrame]


def grouping_sets(sketches: DataFrame, keys, sets: Iterable[Iterable[str]], merge: Merge, gid: str = "gid") -> DataFrame:
    """Sketches of each of ``sets``, subsets of ``keys``: keys that a set lacks are NULL, and ``gid`` is Spark's grouping_id.

    ``merge`` takes rows and their keys, such as ``tdigest.merge``. A NULL of the data is told from a key that is lacking by
    ``gid``. The set of no keys gives a row also where there are no sketches, if ``merge`` gives one.
    """
    keys = key_list(keys)
    wanted = list(dict.fromkeys(frozenset(s) for s in sets))
    if any(s - set(keys) for s in wanted):
        raise ValueError("a grouping set has a column that isn't a key")
    if not wanted:
        raise ValueError("there must be a grouping set at least")
    number = {s: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for s in wanted}
    each = [F.struct(*((F.col(k) if k in s else F.lit(None).cast(sketches.schema[k].dataType)).alias(k) for k in keys), F.lit(number[s]).cast("long").alias(gid)) for s in wanted]
    others = [c for c in sketches.columns if c not in keys]
    rows = sketches.select(F.explode(F.array(*each)).alias("__set"), *others).select(*(F.col(f"__set.{c}").alias(c) for c in [*keys, gid]), *others)
    return merge(rows, [*keys, gid])


def rollup(sketches: DataFrame, keys, merge: Merge, gid: str = "gid") -> DataFrame:
    """All keys, all but the last, and so on to none."""
    keys = key_list(keys)
    return grouping_sets(sketches, keys, [keys[:n] for n in range(len(keys), -1, -1)], merge, gid)


def cube(sketches: DataFrame, keys, merge: Merge, gid: str = "gid") -> DataFrame:
    """All subsets of the keys."""
    keys = key_list(keys)
    return grouping_sets(sketches, keys, [s for n in range(len(keys), -1, -1) for s in combinations(keys, n)], merge, gid)
