import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sketchloom import sql
from sketchloom.functions import digest as D
from sketchloom.functions import moments as M
from sketchloom.functions.types import STATS, TDIGEST
from sketchloom.operators import spacesaving, stats, tdigest
from sketchloom.streaming.sinks import SketchTable, stream_stats


def frame(spark, xs, schema="x double"):
    return spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in xs], schema)


def test_stats_edges(spark):
    for xs in ([], [1.0], [1.0, 1.0], [1.0, float("nan"), 1.0], [-5.0, -2.0, None]):
        r = stats.build(frame(spark, xs), None, "x").select(M.count("stats").alias("n"), M.total("stats").alias("s"), M.maximum("stats").alias("hi"), M.skew("stats").alias("g"), M.var("stats", 1).alias("v")).first()
        live = [x for x in xs if x is not None and x == x]
        assert r.n == len(live) and r.s == sum(live)
        assert r.hi == max(live) if live else math.isnan(r.hi)
        assert math.isnan(r.g) == (len(set(live)) < 2) and math.isnan(r.v) == (len(live) < 2)


def test_stats_merge_equals_whole(spark):
    x = np.random.default_rng(1).normal(50, 100, 5000).tolist()
    df = frame(spark, [(float(v), i % 7) for i, v in enumerate(x)], "x double, k int")
    cols = [M.mean("stats"), M.std("stats"), M.skew("stats", bias=False), M.kurt("stats", bias=False)]
    whole = stats.build(df, None, "x").select(*cols).first()
    parts = stats.merge(stats.build(df, "k", "x").drop("k"), None).select(*cols).first()
    assert np.allclose(tuple(whole), tuple(parts), atol=1e-8, rtol=0)


def test_bad_parameters(spark):
    df = frame(spark, [1.0])
    for f in (lambda: tdigest.clamp(float("inf")), lambda: spacesaving.build(df, None, "x", capacity=0), lambda: D.scale("d", 0.0), lambda: D.histogram("d", 0), lambda: D.histogram("d", [2.0, 1.0]), lambda: spacesaving.topk("s", -1), lambda: stats.build(df, None, "x", 0)):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(TypeError):
        tdigest.build(frame(spark, ["a"], "x string"), None, "x")


@pytest.mark.parametrize("kind", ["gamma", "normal", "step", "mixed"])
def test_digest_accuracy(spark, kind):
    rng = np.random.default_rng(4)
    n = 20_000
    x = {"gamma": lambda: rng.gamma(0.1, 0.1, n), "normal": lambda: rng.normal(0, 1e-5, n), "step": lambda: np.arange(n) % 1000 * 1.0, "mixed": lambda: np.concatenate([rng.normal(0, 1e-5, n // 2), rng.uniform(-1, 1, n // 2)])}[kind]()
    q = [0.001, 0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99, 0.999]
    d = tdigest.build(frame(spark, x.tolist()), None, "x")
    r = d.select(D.quantile("digest", q).alias("q"), D.size("digest").alias("n"), F.size(D.centroids("digest")).alias("c")).first()
    assert r.n == n and r.c <= 200
    for p, v in zip(q, r.q):
        lo, hi = (x < v).mean(), (x <= v).mean()
        assert lo - 0.012 <= p <= hi + 0.012


def test_space_saving_bounds_and_structs(spark):
    items = np.random.default_rng(6).zipf(1.5, 5000).clip(max=2000).tolist()
    df = frame(spark, items, "x long").repartition(5)
    s = spacesaving.build(df, None, "x", capacity=30).first()["summary"]
    exact = {v: items.count(v) for v in set(items)}
    for c in s["counters"]:
        assert c["count"] - c["error"] <= exact[c["item"]] <= c["count"]
    kept = {c["item"] for c in s["counters"]}
    assert all(n <= s["m"] for v, n in exact.items() if v not in kept) and len(kept) == 30
    t = spacesaving.build(df.select(F.struct((F.col("x") % 3).alias("a")).alias("t")), None, "t").first()["summary"]
    assert sum(c["count"] for c in t["counters"]) == 5000 and t["counters"][0]["item"]["a"] in (0, 1, 2)


def test_sql_functions(spark):
    sql.register(spark)
    frame(spark, [float(i) for i in range(1, 100)]).createOrReplaceTempView("v")
    r = spark.sql("SELECT tdigest_quantile(d, 0.5D) q, tdigest_cdf(d, 50D) c FROM (SELECT tdigest(x) d FROM v)").first()
    assert r.q == 50 and abs(r.c - 0.5) < 1e-9
    assert spark.sql("SELECT space_saving_long(CAST(x % 3 AS BIGINT)) s FROM v").first().s["counters"][0]["count"] == 33


def test_streaming_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = frame(spark, [(float(i % 40), i % 3) for i in range(600)], "x double, k int").repartition(4)
    rows.write.parquet(src)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    table = SketchTable.summaries(str(tmp_path / "sketch"), "k", "x", capacity=64)
    q = stream().writeStream.foreachBatch(table.update).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = spacesaving.build(rows, "k", "x", capacity=64)
    assert sorted(map(str, table.read(spark).collect())) == sorted(map(str, want.collect()))
    q = stream_stats(stream(), "k", "x").writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.k: r.stats["count"] for r in spark.table("live").collect()}
    assert got == {0: 200, 1: 200, 2: 200}


def test_digests_of_a_key_from_very_many_tasks(spark):
    """No step merges more than the fan-in: 10,000 tasks take two rounds before the last, and the result has the bounds of one digest."""
    df = spark.range(0, 100_000, 1, 10_000).select(F.lit("a").alias("k"), (F.col("id") * 0.001).alias("x"))
    assert tdigest.partitions(df) == 10_000
    few = spark.range(0, 100_000, 1, 300).select(F.lit("a").alias("k"), (F.col("id") * 0.001).alias("x"))
    for d, fan_in, rounds in ((df, 256, 1), (few, 16, 2), (few, 512, 0)):
        plan = tdigest.build(d, "k", "x", fan_in=fan_in)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == rounds + 1 and "Python" not in text.replace("PythonMapInArrow", "") and text.count("MapInArrow") == 1
        if d is few:
            q = plan.select(D.quantile("digest", [0.001, 0.1, 0.5, 0.99]).alias("q"), D.size("digest").alias("n")).first()
            assert q.n == 100_000 and np.abs(np.array(q.q) / 100 - [0.001, 0.1, 0.5, 0.99]).max() < 0.012
    # what a task of the first round is given, at most
    parts = df.select("k", F.spark_partition_id().alias("t")).groupBy("k", F.floor(F.col("t") / 256)).agg(F.countDistinct("t").alias("n"))
    assert parts.agg(F.max("n")).first()[0] <= 256


@pytest.mark.parametrize("compression", [20, 100, 500])
def test_folding_in_the_jvm_is_compacting(spark, compression):
    rng = np.random.default_rng(5)
    values, weights = rng.gamma(0.5, 1.0, 3000), rng.integers(1, 9, 3000).astype(float)
    rows = [({"compression": float(compression), "min": None, "max": None, "total_weight": 0.0, "centroids": [{"mean": m, "weight": w} for m, w in zip(values[i::7].tolist(), weights[i::7].tolist())]},) for i in range(7)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("digest", TDIGEST)]))
    got = tdigest.fold(df, [], "digest", None).first().digest["centroids"]
    want = tdigest.compact(values, weights, compression)
    assert np.allclose([(c["mean"], c["weight"]) for c in got], np.array(want).T, rtol=1e-12)


def test_empty_digests(spark):
    none = spark.createDataFrame([], "k string, x double")
    for keys, n in ((None, 1), ("k", 0)):
        d = tdigest.build(none, keys, "x", compression=50)
        assert d.count() == n and tdigest.merge(d, keys).count() == n
    d = tdigest.merge(tdigest.build(none, None, "x", compression=50), None).first().digest
    assert (d["compression"], d["min"], d["total_weight"], d["centroids"]) == (50, None, 0, [])
    nans = spark.createDataFrame([("a", float("nan")), ("b", None), ("c", 1.0)], "k string, x double")
    got = {r.k: r.digest["total_weight"] for r in tdigest.merge(tdigest.build(nans, "k", "x"), "k").collect()}
    assert got == {"a": 0, "b": 0, "c": 1}


def test_a_new_checkpoint_loses_no_batch(spark, tmp_path):
    """A stream that is restarted from nothing goes on from the last version, one that is run again counts once, and old versions go."""
    table = SketchTable.stats(str(tmp_path / "sketch"), "k", "x", weight="w", weighting="frequency")
    total = 0
    for turn in range(3):
        src = str(tmp_path / f"in{turn}")
        rows = frame(spark, [(float(i), i % 3, 1 + i % 2) for i in range(60)], "x double, k int, w long").repartition(3)
        rows.write.parquet(src)
        for _ in range(2):  # the second time finds nothing new
            q = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(table.update).option("checkpointLocation", str(tmp_path / f"c{turn}")).start()
            q.processAllAvailable()
            q.stop()
        total += 90
        assert sum(r.stats["count"] for r in table.read(spark).collect()) == total
        assert len(table.versions(spark)) == len(list((tmp_path / "sketch").iterdir())) == 2
    named = SketchTable.digests(str(tmp_path / "digest"), None, "x", weight="w", stream="a")
    for batch_id in (0, 0, 1):
        named.update(rows, batch_id)
    assert named.read(spark).first().digest["total_weight"] == 180
    SketchTable(named.path, named.build, named.merge, stream="b").update(rows, 0)
    named.update(rows, 1)
    assert named.read(spark).first().digest["total_weight"] == 270


def test_moments_of_any_size(spark):
    """Values of very small or large spread: skewness and kurtosis as numpy has them for the same numbers scaled, and no error."""
    rng = np.random.default_rng(3)
    base = rng.gamma(2.0, 1.0, 500)
    sets = [base * f for f in (1e-75, 1e-60, 1e-40, 1e-25, 1.0, 1e30, 1e60, 1e70)] + [1.0 + base * 1e-12, np.array([1e-60, 2e-60, 4e-60]), np.array([1e-120, 3e-120]), np.array([1e-60, 1.0, 2.0, 4.0]), np.array([1e200, -1e200, 3e200])]
    df = frame(spark, [(i, float(v)) for i, x in enumerate(sets) for v in x], "k int, x double")
    got = {r.k: (r.g, r.e) for r in stats.build(df, "k", "x").select("k", M.skew("stats").alias("g"), M.kurt("stats").alias("e")).collect()}
    for i, x in enumerate(sets[:-3] + [sets[-2]]):
        i = i if i < len(sets) - 3 else len(sets) - 2
        y = x / np.abs(x).max()
        d = y - y.mean()
        assert np.isclose(got[i][0], (d**3).mean() / (d**2).mean() ** 1.5, rtol=1e-3 if i == 8 else 1e-9)
        assert np.isclose(got[i][1], (d**4).mean() / (d**2).mean() ** 2 - 3, rtol=1e-3 if i == 8 else 1e-8)
    assert len(got) == len(sets)


def test_statistics_of_very_many_parts(spark, monkeypatch):
    """The last step holds a summary for each key, whatever the number of parts, and passes on those that are done."""
    df = spark.range(0, 30_000, 1, 400).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("x"), F.lit(2).alias("w"))
    got = {r.k: r.stats for r in stats.build(df, "k", "x", weight="w", weighting="frequency").collect()}
    assert all(s["count"] == 2 * len(range(k, 30_000, 7)) and s["sum"] == 2 * sum(range(k, 30_000, 7)) for k, s in got.items()) and len(got) == 7
    monkeypatch.setattr(stats, "HELD", 2)
    schema = to_arrow_schema(T.StructType([T.StructField("k", T.LongType()), T.StructField("stats", STATS)]))
    rows = [pa.record_batch([pa.array(k), *(pa.array([1.0] * len(k)) for _ in range(7))], names=["k", *STATS.names]) for k in ([1, 1, 2], [2, 3, 4, 5], [5, 5, 6])]
    out = [r for b in stats._partial(iter(rows), 1, schema, ordered=True) for r in b.to_pylist()]
    assert [(r["k"], r["stats"]["count"]) for r in out] == [(1, 2), (2, 2), (3, 1), (4, 1), (5, 3), (6, 1)]


def test_summaries_in_one_pass(spark):
    """Building reads its input once, and the merge's ranks are trimmed before its last step."""
    df = spark.range(1000).select((F.col("id") % 90).alias("x"))
    for capacity, steps, trim in ((20, 1, "TakeOrdered"), (2000, 2, "Exchange hashpartitioning(_w0")):
        plan = spacesaving.build(df, None, "x", capacity=capacity)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("Window [") == steps and trim in plan
    plan = stats.merge(stats.build(df.withColumn("w", F.lit(2)), "x", "x", weight="w"), "x")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_space_saving_bounds_with_many_parts(spark):
    rng = np.random.default_rng(8)
    items = (rng.zipf(1.3, 60_000).clip(max=20_000)).tolist()
    df = frame(spark, [(v, i % 3) for i, v in enumerate(items)], "x long, k int").repartition(13)
    for keys in (None, "k"):
        for row in spacesaving.build(df, keys, "x", capacity=1500).collect():
            mine = [v for i, v in enumerate(items) if keys is None or i % 3 == row["k"]]
            exact = dict(zip(*(a.tolist() for a in np.unique(mine, return_counts=True))))
            s = row["summary"]
            kept = {c["item"]: (c["count"], c["error"]) for c in s["counters"]}
            assert len(kept) == 1500 and all(n - e <= exact[v] <= n for v, (n, e) in kept.items())
            assert all(n <= s["m"] for v, n in exact.items() if v not in kept)


def test_space_saving_in_order_against_a_plain_list(spark):
    rng = np.random.default_rng(12)
    items = rng.zipf(1.4, 800).clip(max=60).tolist()
    got = spacesaving.build_in_order(frame(spark, list(enumerate(items)), "i long, x long").repartition(4), None, "x", "i", capacity=7).first()["summary"]
    counters = []  # (item, count, error), heaviest first; equals in the order in which they came there
    for x in items:
        at = next((i for i, c in enumerate(counters) if c[0] == x), None)
        if at is not None:
            c = counters.pop(at)
            new = (x, c[1] + 1, c[2])
        elif len(counters) < 7:
            new = (x, 1, 0)
        else:
            c = counters.pop()
            new = (x, c[1] + 1, c[1])
        place = len(counters)
        while place and (counters[place - 1][1] < new[1] or counters[place - 1][1] == new[1] and counters[place - 1][2] > new[2]):
            place -= 1
        counters.insert(place, new)
    assert [(c["item"], c["count"], c["error"]) for c in got["counters"]] == counters


def test_bad_counts_and_merges(spark):
    df = frame(spark, [(1, 2), (2, 0)], "x long, n long")
    with pytest.raises(Exception, match="count must be > 0"):
        spacesaving.build(df, None, "x", count="n").collect()
    with pytest.raises(Exception, match="w must be finite"):
        tdigest.build(df, None, "x", weight="n").collect()
    with pytest.raises(TypeError):
        spacesaving.merge(df.select(F.struct("x").alias("summary")), None)
    with pytest.raises(TypeError):
        stats.merge(df.select(F.struct("x").alias("stats")), None)
    assert spacesaving.merge(spacesaving.build(df.limit(0), "n", "x"), None).first()["summary"]["counters"] == []


def test_merge_with_null_and_nested_keys(spark):
    df = frame(spark, [(float(i), None if i % 3 else i % 5) for i in range(200)], "x double, k int")
    want = {None if i % 3 else i % 5 for i in range(200)}
    assert {r.k for r in tdigest.build(df, "k", "x").collect()} == want
    parts = stats.build(df.withColumn("s", F.struct((F.col("x") % 2).alias("half"))), ["s", "k"], "x", weight=3)
    got = stats.merge(parts, ["s", "k"]).collect()
    assert len(got) == len(parts.collect()) and sum(r.stats["count"] for r in got) == 600


def test_sql_merges_statistics_and_parameters(spark):
    sql.register(spark)
    frame(spark, [(float(i), i % 4) for i in range(1, 101)], "x double, k int").createOrReplaceTempView("vk")
    r = spark.sql("SELECT tdigest_quantile(tdigest_merge(d), 0.5D) q, tdigest_scale(tdigest_merge(d), 2D).total_weight n, tdigest_histogram(tdigest_merge(d), 4, 0D, 200D) h FROM (SELECT k, tdigest(x) d FROM vk GROUP BY k)").first()
    assert r.q == 50.5 and r.n == 200 and np.allclose(r.h, [49.5, 50.5, 0, 0])
    r = spark.sql("SELECT stats_mean(s) m, stats_var(s, 0) v, stats_std(s, 1) d, stats_skew(s) g, stats_kurt(s) k FROM (SELECT summary_stats_merge(s) s FROM (SELECT k, summary_stats(x) s FROM vk GROUP BY k))").first()
    x = np.arange(1, 101.0)
    z = (x - x.mean()) / x.std()
    assert np.allclose(tuple(r), (x.mean(), x.var(), x.std(ddof=1), (z**3).mean(), (z**4).mean() - 3), atol=1e-9)
    r = spark.sql("SELECT space_saving_long_topk(space_saving_long_merge(s), 2) t FROM (SELECT k, space_saving_long_of(CAST(x % 5 AS BIGINT), 5) s FROM vk GROUP BY k)").first()
    assert [(c["count"], c["error"]) for c in r.t] == [(20, 0), (20, 0)]
    assert spark.sql("SELECT space_saving_of(CAST(k AS STRING), 2) s FROM vk").first().s["capacity"] == 2


@pytest.mark.parametrize("capacity", [1, 3, 20, 200])
@pytest.mark.parametrize("kind", [pa.string(), pa.int64()])
def test_counting_in_arrays_equals_counting_in_dicts(monkeypatch, capacity, kind):
    monkeypatch.setattr(spacesaving, "ROWS", 700)
    monkeypatch.setattr(spacesaving, "SLACK", 2)
    rng = np.random.default_rng(capacity)
    items = [None if x % 19 == 0 else x if kind == pa.int64() else f"w{x}" for x in (rng.zipf(1.4, 5000) % 900).tolist()]
    weights = rng.integers(1, 4, 5000).tolist()
    batches = [pa.RecordBatch.from_arrays([pa.array(items[i : i + 100], kind), pa.array(weights[i : i + 100], pa.int64())], names=["item", "n"]) for i in range(0, 5000, 100)]
    counter = pa.struct([("item", kind), ("count", pa.int64()), ("error", pa.int64())])
    schema = pa.schema([("s", pa.struct([("capacity", pa.int32()), ("m", pa.int64()), ("counters", pa.list_(counter))]))])
    plain = [b.to_pylist() for b in spacesaving._partial(iter(batches), 0, capacity, schema)]
    assert [b.to_pylist() for b in spacesaving._partial_of_all(iter(batches), capacity, schema)] == plain
    assert list(spacesaving._partial_of_all(iter([]), capacity, schema)) == []
