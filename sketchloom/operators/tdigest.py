"""t-digest: build, merge and compaction.

Building is in two phases. Each task compacts the values of each key as they come by (Arrow batches, no shuffle); only
sketches, of up to some 200 centroids, are shuffled to be merged, by a fold over sorted centroids in the JVM. A key's sketches are
merged in rounds of ``fan_in`` tasks at a time, so that no task ever has more, however many tasks the input has. Up to about 4 * compression / pi points of weight 1 all stay
apart, and quantiles are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sketchloom.functions.checks import EPS, key_list, number, numeric, real_weight
from sketchloom.functions.types import TDIGEST
from sketchloom.operators.keys import key_codes

#: Points and keys that a task holds before it compacts or passes them on.
HELD, KEYS = 500_000, 100_000
#: Sketches of a key that a task merges at once, and tasks that an input without a known size is taken to have at most.
FAN_IN, MOST = 256, 256**3


def clamp(compression: float) -> float:
    """Compression within 20 and 1000; a value that isn't finite is a ValueError."""
    return min(1000.0, max(20.0, number(compression, "compression")))


def compact(mean: np.ndarray, weight: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorts points by mean and joins runs of them: a run may span at most 1 on the scale c * (asin(2q - 1) + pi / 2) / pi."""
    order = np.argsort(mean, kind="stable")
    mean, weight = mean[order], weight[order]
    if len(mean) < 2:
        return mean, weight
    after = np.cumsum(weight)
    k = compression * (np.arcsin(2 * np.minimum(after / after[-1], 1) - 1) + math.pi / 2) / math.pi
    starts, at, opened = [], 0, 0.0
    while at < len(mean):
        starts.append(at)
        at = max(int(np.searchsorted(k, opened + 1, side="right")), at + 1)
        opened = k[at - 1]
    if len(starts) == len(mean):
        return mean, weight
    lo, total = mean[starts], np.add.reduceat(weight, starts)
    shift = np.add.reduceat(weight * (mean - np.repeat(lo, np.diff([*starts, len(mean)]))), starts)  # from each run's least mean
    return lo + shift / total, total


def state(mean: np.ndarray, weight: np.ndarray, compression: float, lo: float | None = None, hi: float | None = None) -> dict:
    """A digest of points as a value of ``TDIGEST``."""
    m, w = compact(mean, weight, compression)
    ends = (mean.min() if lo is None else lo, mean.max() if hi is None else hi) if len(m) else (None, None)
    return {"compression": compression, "min": None if ends[0] is None else float(ends[0]), "max": None if ends[1] is None else float(ends[1]), "total_weight": float(w.sum()), "centroids": [{"mean": x, "weight": y} for x, y in zip(m.tolist(), w.tolist())]}


class _Held:
    """Points of all keys of a task, end to end, and each key's extremes and compression."""

    def __init__(self) -> None:
        self.names: dict[tuple, int] = {}
        self.code, self.mean, self.weight = [], [], []
        self.n = 0
        self.lo, self.hi, self.compression = np.empty(0), np.empty(0), np.empty(0)

    def add(self, names: list[tuple], row: np.ndarray, compression: np.ndarray, lo: np.ndarray, hi: np.ndarray, code: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> None:
        """``row`` has the number of each row's name; rows have a compression and extremes (NaN for none), points the number of their row's name."""
        place = np.array([self.names.setdefault(k, len(self.names)) for k in names], np.int64)
        more = len(self.names) - len(self.lo)
        self.lo, self.hi, self.compression = (np.concatenate([v, np.full(more, x)]) for v, x in ((self.lo, np.inf), (self.hi, -np.inf), (self.compression, np.nan)))
        for f, mine, theirs in ((np.fmin, self.lo, lo), (np.fmax, self.hi, hi), (np.fmax, self.compression, compression)):
            f.at(mine, place[row], theirs)
        self.code.append(place[code])
        self.mean.append(mean)
        self.weight.append(weight)
        self.n += len(mean)

    def squeeze(self) -> None:
        """Sorts points by key and mean, and compacts those of keys that have more than a digest's."""
        code, mean, weight = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((self.code, np.int64), (self.mean, float), (self.weight, float)))
        order = np.lexsort((mean, code))
        code, mean, weight = code[order], mean[order], weight[order]
        at = np.searchsorted(code, np.arange(len(self.names) + 1))
        most = 2 * np.ceil(np.where(np.isnan(self.compression), 100.0, self.compression))
        big = np.flatnonzero(np.diff(at) > most)
        if len(big):
            keep = np.ones(len(code), bool)
            for k in big.tolist():
                lo, hi = at[k], at[k + 1]
                m, w = compact(mean[lo:hi], weight[lo:hi], 100.0 if np.isnan(self.compression[k]) else float(self.compression[k]))
                mean[lo : lo + len(m)], weight[lo : lo + len(m)] = m, w
                keep[lo + len(m) : hi] = False
            code, mean, weight = code[keep], mean[keep], weight[keep]
        self.code, self.mean, self.weight, self.n = [code], [mean], [weight], len(code)

    def batch(self, nkeys: int, schema: pa.Schema) -> pa.RecordBatch:
        self.squeeze()
        at = np.searchsorted(self.code[0], np.arange(len(self.names) + 1))
        columns = [pa.array([k[i] for k in self.names], type=schema.field(i).type) for i in range(nkeys)]
        kind = schema.field(nkeys).type
        points = pa.StructArray.from_arrays([pa.array(self.mean[0]), pa.array(self.weight[0])], fields=list(kind.field("centroids").type.value_type))
        sums = np.concatenate([[0.0], np.cumsum(self.weight[0])]) if not self.n else np.add.reduceat(np.append(self.weight[0], 0.0), at[:-1]) * (np.diff(at) > 0)
        total = sums if self.n else np.zeros(len(self.names))
        values = [pa.array(self.compression, from_pandas=True), pa.array(self.lo, mask=~np.isfinite(self.lo)), pa.array(self.hi, mask=~np.isfinite(self.hi)), pa.array(total), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), points)]
        return pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(values, fields=list(kind))], schema=schema)


def _partial(batches: Iterator[pa.RecordBatch], nkeys: int, schema: pa.Schema, compression: float | None, digests: bool) -> Iterator[pa.RecordBatch]:
    """One sketch for each key of a task, of its values and weights or of its digests; a task with very many keys passes them on early."""
    held = _Held()
    for batch in batches:
        if not batch.num_rows:
            continue
        row, names = key_codes(batch.columns[:nkeys], batch.num_rows)
        first, second, *rest = batch.columns[nkeys:]
        if digests:
            lists = first
            size = np.diff(lists.offsets.to_numpy())
            mean, weight = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lo, hi, own = (c.to_numpy(zero_copy_only=False).astype(float) for c in (second, *rest))
            code = np.repeat(row, size)
        else:
            mean, weight = (c.to_numpy(zero_copy_only=False).astype(float) for c in (first, second))
            lo = hi = np.where(np.isfinite(mean) & (weight > EPS), mean, np.nan)
            own, code = np.full(batch.num_rows, compression), row
        live = np.isfinite(mean) & (weight > (0.0 if digests else EPS))
        held.add(names, row, own if compression is None else np.full(batch.num_rows, compression), lo, hi, code[live], mean[live], weight[live])
        if held.n > HELD or len(held.names) > KEYS:
            held.squeeze()
            if held.n > HELD // 2 or len(held.names) > KEYS:
                yield held.batch(nkeys, schema)
                held = _Held()
    if held.names:
        yield held.batch(nkeys, schema)


#: The scale at a weight {x} of __t; and the fold that joins runs of sorted centroids as ``compact`` does: a run is open
#: from ``lo`` on with weight ``w``, and ``shift`` times its weight from ``lo``; ``opened`` is the scale at its beginning.
SCALE = "__c * (asin(2D * least(({x}) / __t, 1D) - 1D) + pi() / 2D) / pi()"
_RUN = "array(named_struct('mean', a.lo + a.shift / a.w, 'weight', a.w))"
FOLD = f"""aggregate(__l, named_struct('done', CAST(array() AS ARRAY<STRUCT<mean: DOUBLE, weight: DOUBLE>>), 'lo', 0D, 'w', 0D, 'shift', 0D, 'after', 0D, 'opened', 0D),
 (a, p) -> CASE WHEN a.w = 0D THEN named_struct('done', a.done, 'lo', p.mean, 'w', p.weight, 'shift', 0D, 'after', p.weight, 'opened', 0D)
  WHEN {SCALE.format(x="a.after + p.weight")} <= a.opened + 1D
  THEN named_struct('done', a.done, 'lo', a.lo, 'w', a.w + p.weight, 'shift', a.shift + p.weight * (p.mean - a.lo), 'after', a.after + p.weight, 'opened', a.opened)
  ELSE named_struct('done', concat(a.done, {_RUN}), 'lo', p.mean, 'w', p.weight, 'shift', 0D, 'after', a.after + p.weight, 'opened', {SCALE.format(x="a.after")}) END,
 a -> CASE WHEN a.w = 0D THEN a.done ELSE concat(a.done, {_RUN}) END)"""


def fold(df: DataFrame, keys: list[str], digest: str, compression: float | None) -> DataFrame:
    """One digest of all of a key's, by JVM expressions: centroids are sorted and gone through once. A key's digests must be few enough for an array."""
    c = F.col(digest)
    points = F.filter(F.flatten(F.collect_list(c["centroids"])), lambda p: p["weight"] > 0)
    own = F.coalesce(F.max(c["compression"]), F.lit(100.0)) if compression is None else F.lit(compression)
    whole = df.groupBy(*keys).agg(own.alias("__c"), F.min(c["min"]).alias("__lo"), F.max(c["max"]).alias("__hi"), F.array_sort(points).alias("__l"))
    whole = whole.withColumn("__t", F.expr("aggregate(__l, 0D, (a, p) -> a + p.weight)"))
    # Spark would put a deterministic fold into whatever reads the digest, and into the filter that it puts below a generator, once for each mention
    return whole.select(*keys, F.expr(f"if(spark_partition_id() >= 0, named_struct('compression', __c, 'min', __lo, 'max', __hi, 'total_weight', __t, 'centroids', {FOLD}), NULL)").alias(digest))


def partitions(df: DataFrame) -> int:
    """How many tasks the rows come from, or more, without running anything: as the plan has it, or by the input's size."""
    spark, plan = df.sparkSession, df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes())) // max(1, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    known = plan.sparkPlan().outputPartitioning().numPartitions()
    return max(known, min(size, MOST), int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _tree(sketches: DataFrame, keys: list[str], digest: str, compression: float | None, parts: int, fan_in: int) -> DataFrame:
    """Merges one sketch from each of ``parts`` tasks: ``fan_in`` of a key at a time, in rounds, by the number of the task."""
    rows = sketches.withColumn("__part", F.spark_partition_id())
    while parts > fan_in:
        rows = fold(rows.withColumn("__part", F.floor(F.col("__part") / fan_in)), [*keys, "__part"], digest, compression)
        parts = -(-parts // fan_in)
    return fold(rows, keys, digest, compression)


def _whole(df: DataFrame, keys: list[str], columns: list, digests: bool, compression: float | None, out: str, fan_in: int) -> DataFrame:
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(out, TDIGEST)])
    rows = df.select(*keys, *columns)
    sketches = rows.mapInArrow(partial(_partial, nkeys=len(keys), schema=to_arrow_schema(schema), compression=compression, digests=digests), schema)
    return _tree(sketches, keys, out, compression, partitions(df), fan_in)


def build(df: DataFrame, keys, x: str, weight: str | float = 1, compression: float = 100.0, out: str = "digest", fan_in: int = FAN_IN) -> DataFrame:
    """One digest for each key. NULL, NaN and infinite values are skipped, and weights up to the double's epsilon.

    A weight that isn't finite and positive fails the query. A key of which nothing is left has an empty digest, and so has
    an empty table without keys.
    """
    compression = clamp(compression)
    return _whole(df, key_list(keys), [numeric(df, x).alias("__x"), real_weight(df, weight).alias("__w")], False, compression, out, fan_in)


def merge(df: DataFrame, keys, digest: str = "digest", compression: float | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Merges the digests of each key; the compression is the given one, else the largest among them.

    Each task merges those that it reads; then up to ``fan_in`` tasks' sketches of a key are merged at a time.
    """
    keys = key_list(keys)
    if [f.name for f in getattr(df.schema[digest].dataType, "fields", [])] != TDIGEST.names:
        raise TypeError(f"{digest} is not a column of t-digests")
    d = F.col(digest)
    columns = [F.coalesce(d["centroids"], F.array().cast(TDIGEST["centroids"].dataType)).alias("__l"), d["min"].alias("__lo"), d["max"].alias("__hi"), d["compression"].alias("__c")]
    return _whole(df, keys, columns, True, None if compression is None else clamp(compression), digest, fan_in)
