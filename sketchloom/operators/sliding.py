"""Sketches of sliding windows, from sketches of panes.

A window of w panes is put together from runs of 1, 2, 4, ... panes, as the binary digits of w say. Runs double from round
to round, so that a pane's sketch is merged some 2 log2(w) times, not w times, and the input is read once.
"""

from __future__ import annotations

from collections.abc import Callable
from numbers import Integral

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.checks import key_list


def sliding(panes: DataFrame, keys, pane: str, width: int, merge: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """For each key the sketch of each window of ``width`` panes that has any, named by its last pane.

    ``panes`` has a whole-number column ``pane`` and a sketch for each key and pane; panes may be lacking. ``merge`` takes
    rows and their keys, such as ``stats.merge``. The first windows have the first pane alone, the last ones end up to
    width - 1 panes behind the last pane.
    """
    if isinstance(width, bool) or not isinstance(width, Integral):
        raise TypeError("width must be a whole number")
    if width < 1:
        raise ValueError("width must be > 0")
    keys = key_list(keys)
    others = [c for c in panes.columns if c not in (*keys, pane)]
    # a run of ``size`` panes is named by its last; what is put together so far ends ``done`` panes later
    rows, size, done = panes.withColumn("__run", F.lit(True)), 1, 0
    while True:
        last = size * 2 > width
        goes = [F.struct(F.lit(False).alias("run"), (F.col(pane) + done).alias("p"))] if width & size else []
        if not last:
            goes += [F.struct(F.lit(True).alias("run"), (F.col(pane) + by).alias("p")) for by in (0, size)]
        stay = F.array(F.struct(F.lit(False).alias("run"), F.col(pane).alias("p")))
        moved = rows.withColumn("__to", F.explode(F.when(F.col("__run"), F.array(*goes)).otherwise(stay)))
        moved = moved.select(*keys, F.col("__to.p").alias(pane), F.col("__to.run").alias("__run"), *others)
        rows = merge(moved, [*keys, pane, "__run"])
        if width & size:
            done += size
        if last:
            return rows.drop("__run")
        size *= 2
