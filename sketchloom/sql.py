"""SQL names. ``register`` makes the aggregates and queries below known to a session.

Aggregates run as Arrow functions over the whole group in one task. For groups that don't fit there, ``sketch_partial`` is
a table function that each task runs over its own rows (k, x), so that only its sketches are grouped and merged:
``SELECT k, tdigest_merge(digest) FROM sketch_partial(TABLE(SELECT a AS k, b AS x FROM t)) GROUP BY k``.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sketchloom.functions.checks import EPS
from sketchloom.functions import digest as digests
from sketchloom.functions import moments
from sketchloom.functions.digest import sql_cdf, sql_quantile, sql_scale
from sketchloom.functions.types import STATS, TDIGEST, space_saving
from sketchloom.operators.keys import key_codes
from sketchloom.operators.spacesaving import _Counts
from sketchloom.operators.stats import _combine
from sketchloom.operators.tdigest import HELD, _Held, clamp
from sketchloom.operators.tdigest import state as digest_of

_DIGEST_DDL = "STRUCT<compression: DOUBLE, min: DOUBLE, max: DOUBLE, total_weight: DOUBLE, centroids: ARRAY<STRUCT<mean: DOUBLE, weight: DOUBLE>>>"


def _digest(x: pa.Array, compression: float = 100.0) -> dict:
    v = x.cast(pa.float64()).to_numpy(zero_copy_only=False)
    v = v[np.isfinite(v)]
    return digest_of(v, np.ones(len(v)), compression)


def _one(values: pa.Array, name: str, default: float) -> float:
    """The number that a parameter has in all rows."""
    given = set(values.drop_null().to_pylist())
    if len(given) > 1:
        raise ValueError(f"{name} must be one number")
    return given.pop() if given else default


def _digest_of(x: pa.Array, compression: pa.Array) -> dict:
    return _digest(x, clamp(float(_one(compression, "compression", 100.0))))


def _weighted(x: pa.Array, w: pa.Array, compression: float = 100.0) -> dict:
    v, u = (a.cast(pa.float64()).to_numpy(zero_copy_only=False) for a in (x, w))
    if not (np.isfinite(u) & (u > 0)).all():
        raise ValueError("w must be finite and > 0")
    live = np.isfinite(v) & (u > EPS)
    return digest_of(v[live], u[live], compression)


def _weighted_of(x: pa.Array, w: pa.Array, compression: pa.Array) -> dict:
    return _weighted(x, w, clamp(float(_one(compression, "compression", 100.0))))


def _counts(weights: pa.Array) -> np.ndarray:
    """Whole positive weights; NULL isn't one."""
    n = weights.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
    if (n <= 0).any():
        raise ValueError("count must be > 0")
    return n


def _summary(items: pa.Array, capacity: int = 20, weights: pa.Array | None = None) -> dict:
    counts = _Counts()
    if weights is None:
        sums = [(x["values"], x["counts"]) for x in items.drop_null().value_counts().to_pylist()]
    else:
        table = pa.table({"item": items, "n": _counts(weights)}).group_by("item", use_threads=False).aggregate([("n", "sum")])
        sums = [(x["item"], x["n_sum"]) for x in table.to_pylist() if x["item"] is not None]
    for x, n in sums:
        counts.add(x, n)
    ranked = counts.ranked(capacity)
    return {"capacity": capacity, "m": counts.m, "counters": [{"item": i, "count": c, "error": e} for i, (c, e) in ranked]}


def _merged(d: pa.Array) -> dict:
    live = [x for x in d.to_pylist() if x is not None and x["centroids"]]
    compression = max((c for c in d.drop_null().field("compression").to_pylist() if c is not None), default=100.0)
    points = np.array([(p["mean"], p["weight"]) for x in live for p in x["centroids"]]).reshape(-1, 2)
    return digest_of(points[:, 0], points[:, 1], compression, min((x["min"] for x in live), default=None), max((x["max"] for x in live), default=None))


def _moments(n: np.ndarray, *rest: np.ndarray) -> dict:
    fields = _combine(np.zeros(len(n), np.int64), 1, n, *rest)
    return {k: int(v[0]) if k == "count" else None if np.isnan(v[0]) else float(v[0]) for k, v in zip(STATS.names, fields)}


def _stats(x: pa.Array) -> dict:
    v = x.cast(pa.float64()).to_numpy(zero_copy_only=False)
    v = v[~np.isnan(v)]
    zero = np.zeros(len(v))
    return _moments(np.ones(len(v)), v, v, v, zero, zero, zero)


def _stats_weighted(x: pa.Array, w: pa.Array, frequency: bool = False) -> dict:
    v, n = x.cast(pa.float64()).to_numpy(zero_copy_only=False), _counts(w).astype(float)
    here = ~np.isnan(v)
    v, n = v[here], n[here]
    zero = np.zeros(len(v))
    return _moments(n, v * n if frequency else v, v, v, zero, zero, zero)


def _stats_frequency(x: pa.Array, w: pa.Array) -> dict:
    return _stats_weighted(x, w, True)


def _stats_merged(s: pa.Array) -> dict:
    live = s.filter(s.is_valid())
    return _moments(*(live.field(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(len(STATS.names))))


def _capacity_of(c: pa.Array) -> int:
    capacity = _one(c, "capacity", 20)
    if capacity < 1:
        raise ValueError("capacity must be > 0")
    return capacity


def _summary_of(items: pa.Array, capacity: pa.Array) -> dict:
    return _summary(items, _capacity_of(capacity))


def _summary_weighted(items: pa.Array, weights: pa.Array) -> dict:
    return _summary(items, 20, weights)


def _summary_weighted_of(items: pa.Array, weights: pa.Array, capacity: pa.Array) -> dict:
    return _summary(items, _capacity_of(capacity), weights)


def _summaries_merged(s: pa.Array) -> dict:
    """Counts and errors add; where a summary lacks an item its m counts instead."""
    live = [x for x in s.to_pylist() if x is not None]
    capacity, m = max((x["capacity"] for x in live), default=20), sum(x["m"] for x in live)
    total = _Counts()
    total.m = m
    for x in live:
        for c in x["counters"]:
            n, e = total.counts.get(c["item"], (m, m))
            total.counts[c["item"]] = n + c["count"] - x["m"], e + c["error"] - x["m"]
    ranked = total.ranked(capacity)
    return {"capacity": capacity, "m": total.m, "counters": [{"item": i, "count": c, "error": e} for i, (c, e) in ranked]}


class _SketchPartial:
    """Rows (k, x) of a task's part of a table, as a digest and a summary of statistics of each k."""

    def __init__(self) -> None:
        self.digests, self.fields, self.places = _Held(), [np.empty(0)] * len(STATS.names), {}

    def eval(self, batch: pa.RecordBatch):
        k, x = batch.column(0), batch.column(1).cast(pa.float64())
        code, names = key_codes([k.cast(pa.string())], batch.num_rows)
        v, n = x.to_numpy(zero_copy_only=False), batch.num_rows
        live, ends = np.isfinite(v), np.where(np.isfinite(v), v, np.nan)
        self.digests.add(names, code, np.full(n, 100.0), ends, ends, code[live], v[live], np.ones(int(live.sum())))
        if self.digests.n > HELD:
            self.digests.squeeze()
        here = ~np.isnan(v)
        zero, value = np.zeros(n), np.where(here, v, 0.0)
        new = _combine(code, len(names), here.astype(float), value, np.where(here, v, np.nan), np.where(here, v, np.nan), zero, zero, zero)
        place = np.array([self.places.setdefault(name, len(self.places)) for name in names], np.int64)
        both = np.concatenate([np.arange(len(self.fields[0])), place])
        self.fields = _combine(both, len(self.places), *(np.concatenate([a, b]) for a, b in zip(self.fields, new)))
        return iter(())

    def terminate(self):
        if self.places:
            kind, state = to_arrow_type(TDIGEST), to_arrow_type(STATS)
            schema = pa.schema([("k", pa.string()), ("digest", kind)])
            rows = self.digests.batch(1, schema)
            values = [pa.array(self.fields[0].astype(np.int64)), *(pa.array(f, mask=np.isnan(f)) if n in ("min", "max") else pa.array(f) for n, f in zip(STATS.names[1:], self.fields[1:]))]
            yield pa.Table.from_arrays([*rows.columns, pa.StructArray.from_arrays(values, fields=list(state))], names=["k", "digest", "stats"])


def register(spark: SparkSession) -> None:
    """Aggregates: tdigest(x), tdigest_of(x, compression), tdigest_weighted(x, w), tdigest_weighted_of(x, w, compression),
    tdigest_merge(d); summary_stats(x), summary_stats_weighted(x, n), where weights multiply the count alone,
    summary_stats_frequency(x, n), where they stand for copies, summary_stats_merge(s); and space_saving for strings,
    space_saving_long and space_saving_double for numbers, each by itself (item), with _of (item, capacity), _weighted
    (item, n), _weighted_of (item, n, capacity) and _merge for summaries.

    Functions: tdigest_quantile(d, q), tdigest_cdf(d, x), tdigest_scale(d, f), tdigest_histogram(d, bins[, lo, hi]) and
    tdigest_edges of the same, tdigest_histogram_at(d, edges), tdigest_valid(d); stats_mean, stats_var, stats_std (s, ddof),
    stats_skew(s[, bias]), stats_kurt(s[, fisher[, bias]]), stats_valid(s); space_saving_topk(s, k), space_saving_valid(s)
    and the like.
    """
    partial = F.arrow_udtf(_SketchPartial, returnType=f"k string, digest {TDIGEST.simpleString()}, stats {STATS.simpleString()}")
    spark.udtf.register("sketch_partial", partial)
    spark.udf.register("tdigest", _agg(_digest, TDIGEST))
    spark.udf.register("tdigest_of", _agg2(_digest_of, TDIGEST))
    spark.udf.register("tdigest_weighted", _agg2(_weighted, TDIGEST))
    spark.udf.register("tdigest_weighted_of", _agg3(_weighted_of, TDIGEST))
    spark.udf.register("tdigest_merge", _agg(_merged, TDIGEST))
    spark.udf.register("summary_stats", _agg(_stats, STATS))
    spark.udf.register("summary_stats_weighted", _agg2(_stats_weighted, STATS))
    spark.udf.register("summary_stats_frequency", _agg2(_stats_frequency, STATS))
    spark.udf.register("summary_stats_merge", _agg(_stats_merged, STATS))

    def function(name: str, arguments: str, returns: str, text: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {text}")

    for name, kind in (("space_saving", T.StringType()), ("space_saving_long", T.LongType()), ("space_saving_double", T.DoubleType())):
        state = space_saving(kind)
        spark.udf.register(name, _agg(_summary, state))
        spark.udf.register(f"{name}_of", _agg2(_summary_of, state))
        spark.udf.register(f"{name}_weighted", _agg2(_summary_weighted, state))
        spark.udf.register(f"{name}_weighted_of", _agg3(_summary_weighted_of, state))
        spark.udf.register(f"{name}_merge", _agg(_summaries_merged, state))
        function(f"{name}_valid", f"s {state.simpleString()}", "BOOLEAN", "coalesce(size(s.counters) <= s.capacity AND size(array_distinct(transform(s.counters, c -> c.item))) = size(s.counters), false)")
        function(f"{name}_topk", f"s {state.simpleString()}, k INT", state["counters"].dataType.simpleString(), "slice(s.counters, 1, k)")
    digest = f"s {_DIGEST_DDL}"
    function("tdigest_quantile", f"{digest}, q DOUBLE", "DOUBLE", sql_quantile("s", "q"))
    function("tdigest_cdf", f"{digest}, x DOUBLE", "DOUBLE", sql_cdf("s", "x"))
    function("tdigest_scale", f"{digest}, f DOUBLE", _DIGEST_DDL, sql_scale("s", "CASE WHEN f > 0D AND f < double('Infinity') THEN f ELSE raise_error('factor must be finite and > 0') END"))
    function("tdigest_valid", digest, "BOOLEAN", digests.VALID.format(s="s"))
    own = "CASE WHEN s.total_weight > 0D THEN s.{} ELSE 0D END"
    # ends that aren't given are the digest's own; equal ones are moved apart
    ends = f"transform(array(named_struct('lo', coalesce(lo, {own.format('min')}), 'hi', coalesce(hi, {own.format('max')}))), e -> CASE WHEN e.lo > e.hi THEN raise_error('range must not decrease') WHEN e.lo = e.hi THEN named_struct('lo', e.lo - 0.5D, 'hi', e.hi + 0.5D) ELSE e END)[0]"
    edges = f"transform(array({ends}), e -> transform(sequence(0, CASE WHEN n > 0 THEN n ELSE raise_error('bins must be >= 1') END), i -> CASE WHEN i = n THEN e.hi ELSE e.lo + (e.hi - e.lo) * i / n END))[0]"
    ranged = f"{digest}, n INT, lo DOUBLE DEFAULT NULL, hi DOUBLE DEFAULT NULL"

    def histogram(at: str) -> str:
        shares = f"transform({at}, x -> {sql_cdf('s', 'x')})"
        weights = f"transform(array({shares}), c -> zip_with(slice(c, 1, greatest(size(c) - 1, 0)), slice(c, 2, greatest(size(c) - 1, 0)), (a, b) -> (b - a) * s.total_weight))[0]"
        return f"CASE WHEN coalesce(s.total_weight, 0D) <= 0D THEN array_repeat(0D, greatest(size({at}) - 1, 0)) ELSE {weights} END"

    function("tdigest_edges", ranged, "ARRAY<DOUBLE>", edges)
    function("tdigest_histogram", ranged, "ARRAY<DOUBLE>", histogram(edges))
    function("tdigest_histogram_at", f"{digest}, edges ARRAY<DOUBLE>", "ARRAY<DOUBLE>", histogram("CASE WHEN size(edges) > 0 AND array_sort(edges) = edges THEN edges ELSE raise_error('edges must not be empty or decrease') END"))
    stats, nan = f"s {STATS.simpleString()}", "double('NaN')"
    function("stats_mean", stats, "DOUBLE", f"CASE WHEN s.count > 0 THEN s.sum / s.count ELSE {nan} END")
    function("stats_var", f"{stats}, ddof INT", "DOUBLE", f"CASE WHEN s.count > greatest(ddof, 0) THEN s.m2 / (s.count - ddof) ELSE {nan} END")
    function("stats_std", f"{stats}, ddof INT", "DOUBLE", f"CASE WHEN s.count > greatest(ddof, 0) THEN sqrt(s.m2 / (s.count - ddof)) ELSE {nan} END")
    varied = f"CASE WHEN s.count > 0 AND s.min <> s.max THEN {{}} ELSE {nan} END"
    n = "CAST(s.count AS DOUBLE)"
    skew = f"try_divide(s.m3 / {n}, pow(s.m2 / {n}, 1.5D))"
    fair_skew = f"CASE WHEN bias OR s.count <= 2 THEN 1D ELSE try_divide(sqrt({n} * ({n} - 1D)), {n} - 2D) END"
    kurt = f"try_divide(s.m4 / {n}, pow(s.m2 / {n}, 2D))"
    fair_kurt = f"CASE WHEN bias OR s.count <= 3 THEN {kurt} ELSE try_divide(({n} * {n} - 1D) * {kurt} - 9D * {n} + 15D, ({n} - 2D) * ({n} - 3D)) END"
    function("stats_skew", f"{stats}, bias BOOLEAN DEFAULT true", "DOUBLE", varied.format(f"CASE WHEN s.m2 = 0 THEN 0D ELSE {skew} * {fair_skew} END"))
    function("stats_kurt", f"{stats}, fisher BOOLEAN DEFAULT true, bias BOOLEAN DEFAULT true", "DOUBLE", varied.format(f"CASE WHEN s.m2 = 0 THEN 0D ELSE {fair_kurt} END - CASE WHEN fisher THEN 3D ELSE 0D END"))
    function("stats_valid", stats, "BOOLEAN", moments.VALID.format(s="s"))


def _agg(f, state: T.DataType):
    kind = to_arrow_type(state)

    def agg(x: pa.Array) -> pa.Scalar:
        return pa.scalar(f(x), type=kind)

    return F.arrow_udf(agg, state)


def _agg2(f, state: T.DataType):
    kind = to_arrow_type(state)

    def agg(x: pa.Array, w: pa.Array) -> pa.Scalar:
        return pa.scalar(f(x, w), type=kind)

    return F.arrow_udf(agg, state)


def _agg3(f, state: T.DataType):
    kind = to_arrow_type(state)

    def agg(x: pa.Array, w: pa.Array, p: pa.Array) -> pa.Scalar:
        return pa.scalar(f(x, w, p), type=kind)

    return F.arrow_udf(agg, state)
