"""Grouping sets, sliding windows, table functions and composite items against plain Python."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sketchloom
from sketchloom import sql
from sketchloom.functions import digest as D
from sketchloom.functions import moments as M
from sketchloom.operators import decay, spacesaving, stats, tdigest
from sketchloom.operators.cube import cube, grouping_sets, rollup
from sketchloom.operators.sliding import sliding


def test_grouping_sets_scan_once_and_tell_nulls_apart(spark):
    rows = [(a, b, float(i)) for i, (a, b) in enumerate([("x", 1), ("x", None), (None, 1), ("y", 2), ("x", 1)])]
    df = spark.createDataFrame(rows, "a string, b int, v double")
    finest = stats.build(df, ["a", "b"], "v")
    got = {(r.a, r.b, r.gid): r.stats["sum"] for r in cube(finest, ["a", "b"], stats.merge).collect()}
    want = Counter()
    for n in range(3):
        for s in combinations("ab", n):
            for a, b, v in rows:
                want[a if "a" in s else None, b if "b" in s else None, 2 * ("a" not in s) + ("b" not in s)] += v
    assert got == want and len(got) == 4 + 3 + 3 + 1
    plan = cube(finest, ["a", "b"], stats.merge)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
    assert {r.gid for r in rollup(finest, ["a", "b"], stats.merge, gid="gid").collect()} == {0, 1, 3}
    digests = tdigest.build(df, ["a", "b"], "v")
    assert grouping_sets(digests, ["a", "b"], [[]], tdigest.merge).first().digest["total_weight"] == 5
    assert cube(stats.build(df.limit(0), ["a", "b"], "v"), ["a", "b"], stats.merge).count() == 0
    for sets in ([], [["c"]]):
        with pytest.raises(ValueError):
            grouping_sets(finest, ["a", "b"], sets, stats.merge)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 8, 13])
def test_sliding_windows_of_any_width(spark, width):
    rng = np.random.default_rng(width)
    rows = [("ab"[int(k)], int(p), float(v)) for k, p, v in zip(rng.integers(0, 2, 40), rng.choice([0, 1, 2, 5, 6, 20, 21], 40), rng.normal(size=40))]
    df = spark.createDataFrame(rows, "k string, day long, v double")
    got = {(r.k, r.day): (r.stats["count"], round(r.stats["sum"], 9)) for r in sliding(stats.build(df, ["k", "day"], "v"), "k", "day", width, stats.merge).collect()}
    want = {}
    for k in "ab":
        for day in range(22 + width):
            x = [v for kk, p, v in rows if kk == k and day - width < p <= day]
            if x:
                want[k, day] = len(x), round(sum(x), 9)
    assert got == want


def test_sliding_parameters(spark):
    panes = stats.build(spark.createDataFrame([(1, 1.0)], "day long, v double"), "day", "v")
    for width, error in ((0, ValueError), (1.5, TypeError), (True, TypeError)):
        with pytest.raises(error):
            sliding(panes, None, "day", width, stats.merge)
    wide = sliding(panes, None, "day", 365, stats.merge)
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 10  # nine rounds, not 365, and the panes
    assert sliding(panes.limit(0), None, "day", 7, stats.merge).count() == 0


def test_partial_sketches_in_sql(spark):
    sql.register(spark)
    rng = np.random.default_rng(6)
    rows = [(k, v) for k, v in zip(["a", "b", None] * 400, [*rng.normal(size=1197).tolist(), float("nan"), None, float("inf")])]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    df.createOrReplaceTempView("partial_rows")
    parts = spark.sql("SELECT * FROM sketch_partial(TABLE(SELECT k, x FROM partial_rows))")
    assert 5 <= parts.count() <= 15  # one row for each task and key: no task has a whole group
    whole = spark.sql("SELECT k, summary_stats_merge(stats) s, tdigest_merge(digest) t FROM sketch_partial(TABLE(SELECT k, x FROM partial_rows)) GROUP BY k")
    got = {r.k: (r.s["count"], r.t["total_weight"], round(r.q, 9)) for r in whole.select("k", "s", "t", D.quantile("t", 0.3).alias("q")).collect()}
    want = {r.k: (r.n, r.w, round(r.q, 9)) for r in stats.build(df, "k", "x").join(tdigest.build(df.withColumnRenamed("k", "j"), "j", "x"), F.expr("k <=> j")).select("k", M.count("stats").alias("n"), D.size("digest").alias("w"), D.quantile("digest", 0.3).alias("q")).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(abs(got[k][2] - want[k][2]) < 0.1 for k in want)


KINDS = [
    ("array<string>", [["a", "b"], ["a"], [], ["b", None], ['"', "!"]]),
    ("array<struct<a: int, b: array<int>>>", [[(1, [2])], [(1, None)], [], [(1, [2]), (3, [])]]),
    ("map<string, int>", [{"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 1}, {}, {"c": None}]),
    ("struct<a: string, b: double>", [("x", 1.5), ("x", None), (None, float("nan"))]),
]


@pytest.mark.parametrize("kind,items", KINDS)
def test_composite_items(spark, kind, items):
    rng = np.random.default_rng(2)
    rows = [(int(i) % 2, items[int(i) % len(items)]) for i in rng.integers(0, 1000, 300)] + [(0, None)]
    df = spark.createDataFrame(rows, f"k int, item {kind}").repartition(3)
    exact = Counter()
    text = lambda x: str(sorted(x.items()) if isinstance(x, dict) else x if not isinstance(x, T.Row) else tuple(x)).replace("Row", "")
    for r in df.collect():
        if r.item is not None:
            exact[r.k, text(r.item)] += 1
    s = spacesaving.build(df, "k", "item", capacity=10)
    assert s.schema["summary"].dataType["counters"].dataType.elementType["item"].dataType == df.schema["item"].dataType
    got = {(r.k, text(c["item"])): (c["count"], c["error"]) for r in s.collect() for c in r.summary["counters"]}
    assert got == {k: (n, 0) for k, n in exact.items()}
    if not kind.startswith("struct"):
        whole = spacesaving.merge(s, None).first().summary["counters"]
        both = Counter()
        for (_, i), n in exact.items():
            both[i] += n
        assert {text(c["item"]): c["count"] for c in whole} == both


def test_items_that_cannot_be_counted(spark):
    df = spark.createDataFrame([([{"a": 1}],)], "item array<map<string, int>>")
    with pytest.raises(TypeError):
        spacesaving.build(df, None, "item")


def test_merge_without_a_capacity_in_parts(spark):
    """The largest capacity among a key's summaries holds, wherever its items are; parts are trimmed before one task ranks a key's."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(k), int(v)) for k, v in zip(rng.integers(0, 3, 4000), rng.zipf(1.4, 4000).clip(max=900))], "k int, x int")
    small, large = spacesaving.build(df, "k", "x", capacity=5), spacesaving.build(df, "k", "x", capacity=300)
    merged = spacesaving.merge(small.unionByName(large), "k")
    want = {r.k: r.summary for r in spacesaving.merge(small.unionByName(large), "k", capacity=300).collect()}
    assert {r.k: r.summary for r in merged.collect()} == want and all(s["capacity"] == 300 for s in want.values())
    assert merged._jdf.queryExecution().executedPlan().toString().count("Window [") >= 3
    one = spacesaving.merge(small.limit(0), None).collect()
    assert len(one) == 1 and one[0].summary["counters"] == []


def test_space_saving_traces(spark):
    """Two sequences whose counters are known: with evictions, offered in order, and with weights."""
    steps = [*((i, 1) for i in range(5)), (4, 2), (2, 1), (5, 1), *[(6, 1), (7, 1)] * 5]
    rows = spark.createDataFrame([(i, x, n) for i, (x, n) in enumerate(steps)], "i long, item long, n long")
    s = spacesaving.build_in_order(rows, None, "item", "i", count="n", capacity=5).first().summary["counters"]
    assert [tuple(c) for c in s] == [(6, 6, 1), (7, 6, 1), (4, 3, 0), (2, 2, 0), (5, 2, 1)]
    steps = [(1, 10), *[(i, 5) for i in (1, 2, 3)], *[(3, n) for n in (5, 10, 5)], *[(i, i) for i in (1, 2, 3)]]
    rows = spark.createDataFrame([(i, x, n) for i, (x, n) in enumerate(steps)], "i long, item long, n long")
    for s in (spacesaving.build_in_order(rows, None, "item", "i", count="n"), spacesaving.build(rows, None, "item", count="n")):
        assert [tuple(c) for c in s.first().summary["counters"]] == [(3, 28, 0), (1, 16, 0), (2, 7, 0)]


def test_versions():
    assert sketchloom.__version__ == "0.2.0" and sketchloom.engine_version()


def test_decay_with_any_landmarks(spark):
    """Landmarks change no quantile and no weight as of a time; very old rows vanish, and half-lives must agree."""
    rng = np.random.default_rng(9)
    rows = [(float(v), int(t)) for v, t in zip(rng.normal(size=60), rng.integers(0, 1000, 60))]
    df = spark.createDataFrame(rows, "x double, t long").withColumn("ts", F.timestamp_seconds("t"))
    sizes, quantiles = set(), set()
    for parts in ([(0, 1000, 1000)], [(0, 1000, 0)], [(0, 500, 400), (500, 1000, 1200)]):
        made = [decay.build(df.filter((F.col("t") >= lo) & (F.col("t") < hi)), None, "x", "ts", 200, at) for lo, hi, at in parts]
        s = decay.merge(made[0] if len(made) == 1 else made[0].unionByName(made[1]), None)
        r = s.select(decay.size_at("decayed", 1000).alias("n"), D.quantile("decayed.digest", 0.4).alias("q")).first()
        sizes.add(round(r.n, 9))
        quantiles.add(round(r.q, 9))
    assert sizes == {round(sum(2 ** ((t - 1000) / 200) for _, t in rows), 9)} and len(quantiles) == 1
    old = decay.build(df, None, "x", "ts", 0.001, 10**6)
    assert old.first().decayed["digest"]["total_weight"] == 0
    with pytest.raises(Exception, match="half-lives differ"):
        decay.merge(decay.build(df, None, "x", "ts", 5, 0).unionByName(decay.build(df, None, "x", "ts", 6, 0)), None).collect()
    for bad in (0, -1, float("inf")):
        with pytest.raises(ValueError):
            decay.build(df, None, "x", "ts", bad, 0)
