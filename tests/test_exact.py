"""Exact quantiles, decayed counts and Spark's own sketches against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom import sql
from sketchloom.functions import digest as D
from sketchloom.functions import moments as M
from sketchloom.operators import decay, native, spacesaving, stats, tdigest
from sketchloom.operators.selection import exact_quantiles

QS = [0.0, 0.1, 0.5, 0.77, 1.0]


def _frame(spark, values, kind="double"):
    return spark.createDataFrame([(k, v) for k, xs in values.items() for v in xs], f"k string, v {kind}")


@pytest.mark.parametrize("fit, cells", [(1, 2), (3, 7), (1_000_000, 2048)])
def test_any_fit_and_cells_give_the_same(spark, fit, cells):
    rng = np.random.default_rng(fit)
    values = {"normal": rng.normal(size=300), "ties": rng.integers(0, 3, 300) * 1.0, "tail": np.exp(rng.normal(0, 9, 300)), "one": [4.5], None: [1.0, 2.0], "huge": [-1.7e308, 1.7e308, 5.0], "tiny": [5e-324, 1e-323, 0.0]}
    values = {k: [float(v) for v in xs] for k, xs in values.items()}
    got = {r.k: r.quantiles for r in exact_quantiles(_frame(spark, values), "k", "v", QS, fit=fit, cells=cells).collect()}
    assert set(got) == set(values)
    for k, xs in values.items():
        if k != "huge":
            assert got[k] == pytest.approx(np.quantile(xs, QS).tolist(), rel=1e-12, abs=0)
    assert got["huge"][0] == -1.7e308 and got["huge"][2] == 5.0 and got["huge"][-1] == 1.7e308


def test_whole_numbers_beyond_doubles_stay_exact(spark):
    n = (1 << 62) + 1
    values = {"a": [n, n + 1, n + 2, -n, 7], "b": [-(1 << 63), (1 << 63) - 1, 0]}
    got = {r.k: r.q for r in exact_quantiles(_frame(spark, values, "long"), "k", "v", [0.25, 0.5], out="q", fit=1, cells=2).collect()}
    assert got == {"a": [7.0, float(n)], "b": [-float(1 << 62), 0.0]}


def test_skipped_values_and_empty_tables(spark):
    df = _frame(spark, {"a": [1.0, None, float("nan"), float("inf"), 3.0], "none": [None, float("nan")]})
    assert [(r.k, r.quantiles) for r in exact_quantiles(df, "k", "v", 0.5).collect()] == [("a", [2.0])]
    assert exact_quantiles(df.limit(0), "k", "v", 0.5).count() == 0
    assert exact_quantiles(df.limit(0), None, "v", 0.5).count() == 0


def test_clashing_names_and_many_keys_in_parts(spark, monkeypatch):
    monkeypatch.setattr("sketchloom.operators.selection.BROADCAST_KEYS", 3)
    df = spark.range(1000).select((F.col("id") % 10).alias("rank"), F.col("id").alias("k0"), F.lit(1).alias("x"))
    got = {r["rank"]: r.lo for r in exact_quantiles(df, "rank", "k0", [0.5], out="lo", fit=5, cells=4).collect()}
    assert got == {i: [495.0 + i] for i in range(10)}


def test_parameters(spark):
    df = _frame(spark, {"a": [1.0]})
    for more, error in (({"q": []}, ValueError), ({"q": "a"}, TypeError), ({"q": 0.5, "fit": 0}, ValueError), ({"q": 0.5, "cells": 1}, ValueError), ({"q": 0.5, "cells": 2.0}, TypeError)):
        with pytest.raises(error):
            exact_quantiles(df, "k", "v", **more)
    with pytest.raises(TypeError):
        exact_quantiles(df, "v", "k", 0.5)


def test_three_passes_are_enough_for_a_smooth_column(spark, monkeypatch):
    from sketchloom.operators import selection

    passes = []
    within = selection._within
    monkeypatch.setattr(selection, "_within", lambda *a: passes.append(1) or within(*a))
    df = spark.range(200_000).select(F.randn(3).alias("v")).persist()
    want = df.select(F.percentile("v", [0.1, 0.5])).first()[0]
    assert exact_quantiles(df, None, "v", [0.1, 0.5], fit=1000).first().quantiles == pytest.approx(want, rel=1e-12)
    assert len(passes) == 2  # after that of the digests
    df.unpersist()


def test_decayed_counts_hold_their_bounds_whatever_the_landmarks(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(t)) for i, t in zip(rng.zipf(1.4, 4000) % 300, rng.integers(0, 1000, 4000))]
    df = spark.createDataFrame(rows, "item long, t long").withColumn("ts", F.timestamp_seconds("t"))
    parts = [decay.build_counts(df.filter(F.col("t").between(a, b)), None, "item", "ts", 100, at, capacity=30) for a, b, at in ((0, 399, 400), (400, 799, 650), (800, 1000, 1000))]
    merged = decay.merge_counts(parts[0].unionByName(parts[1]).unionByName(parts[2]), None)
    got = merged.select("decayed.landmark", F.inline(decay.topk_at("decayed", 30, 1000))).collect()
    exact = {}
    for i, t in rows:
        exact[i] = exact.get(i, 0.0) + 2 ** ((t - 1000) / 100)
    slack = len(rows) / decay.UNIT
    assert len(got) == 30 and {r.landmark for r in got} == {1000.0}
    assert all(r["count"] - r.error - slack <= exact[r.item] <= r["count"] + slack for r in got)
    assert max(exact, key=exact.get) == got[0].item
    later = merged.select(decay.topk_at("decayed", 1, 1100)[0]["count"]).first()[0]
    assert later == pytest.approx(got[0]["count"] / 2)


def test_decayed_counts_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", None, 5), ("b", 7, -(10**6))], "k string, item long, t long").withColumn("ts", F.timestamp_seconds("t"))
    one, other = (decay.build_counts(df, "k", "item", "ts", life, 0) for life in (10, 20))
    assert {r.k: r.n for r in one.select("k", F.size("decayed.summary.counters").alias("n")).collect()} == {"a": 0}
    assert decay.merge_counts(one.filter("false"), "k").count() == 0
    with pytest.raises(Exception, match="half-lives differ"):
        decay.merge_counts(one.unionByName(other), "k").collect()


def test_kll_builds_merges_and_skips(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).otherwise(float("nan")).alias("v"))
    m = native.kll_merge(native.kll(df, "k", "v", k=800), None)
    n, qs, share = m.select(native.kll_size("kll"), native.kll_quantile("kll", [-1, 0.5, 2]), native.kll_cdf("kll", [5000])).first()
    assert n == 20_000 - 2858 and qs[0] == 1 and qs[2] == 19_998
    assert abs(qs[1] - 10_000) < 240 and abs(share[0] - 0.25) < 0.012
    assert native.kll(df.limit(0), None, "v").select(native.kll_size("kll"), native.kll_quantile("kll", [0.5])).first()[:] == (0, None)
    assert native.kll(df.limit(0), "k", "v").count() == 0
    for k, error in ((7, ValueError), (1.5, TypeError)):
        with pytest.raises(error):
            native.kll(df, "k", "v", k=k)


def test_topk_states_skip_nulls_and_merge(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a b"), (2, "c"), (2, None), (3, None)], "k int, `odd.name` string")
    s = native.topk_state(df, "k", "odd.name", tracked=100)
    got = native.topk_merge(s, None, tracked=100).select(F.inline(native.topk_estimate("state", 5))).collect()
    assert [tuple(r) for r in got] == [("a b", 3), ("c", 1)]
    assert {r.k: r.n for r in s.select("k", F.size(native.topk_estimate("state")).alias("n")).collect()} == {1: 1, 2: 2, 3: 0}
    assert native.topk_merge(s.limit(0), None, tracked=100).count() == 0


def test_sql_parameters_are_those_of_the_functions(spark):
    sql.register(spark)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(v), int(w), str(int(v) % 5)) for v, w in zip(rng.gamma(2, 3, 200), rng.integers(1, 5, 200))], "x double, w long, s string").coalesce(1)
    df.createOrReplaceTempView("parameters")
    r = spark.sql("""SELECT stats_skew(s, false), stats_kurt(s, false, false), stats_kurt(s, false), stats_mean(w), stats_std(w, 1), stats_mean(f) FROM
        (SELECT summary_stats(x) s, summary_stats_weighted(x, w) w, summary_stats_frequency(x, w) f FROM parameters)""").first()
    want = stats.build(df, None, "x").select(M.skew("stats", bias=False), M.kurt("stats", fisher=False, bias=False), M.kurt("stats", fisher=False)).first()
    weighted = stats.build(df, None, "x", weight="w").select(M.mean("stats"), M.std("stats", 1)).first()
    copies = stats.build(df, None, "x", weight="w", weighting="frequency").select(M.mean("stats")).first()
    assert np.allclose(tuple(r), [*want, *weighted, *copies], rtol=1e-9)
    r = spark.sql("""SELECT d.compression c, tdigest_histogram(d, 4) h, tdigest_edges(d, 4) e, tdigest_histogram_at(d, array(0D, 5D, 5D, 50D)) a, tdigest_histogram_at(d, array(1D)) one, tdigest_histogram(d, 2, -3D, -3D) apart FROM
        (SELECT tdigest_weighted_of(x, w, 400D) d FROM parameters)""").first()
    d = tdigest.build(df, None, "x", weight="w", compression=400)
    h = d.select(D.histogram("digest", 4).alias("h"), D.histogram("digest", [0.0, 5.0, 5.0, 50.0]).alias("a")).first()
    assert r.c == 400 and np.allclose(r.h, h.h["hist"]) and np.allclose(r.e, h.h["edges"]) and np.allclose(r.a, h.a["hist"]) and r.one == [] and r.apart == [0, 0]
    got = spark.sql("SELECT space_saving_weighted_of(s, w, 3) s FROM parameters").first().s
    want = spacesaving.build(df, None, "s", count="w", capacity=3).first().summary
    assert got["capacity"] == 3 and sorted(got["counters"]) == sorted(want["counters"]) and got["m"] == want["m"]
    assert spark.sql("SELECT tdigest_of(x, 5000D).compression FROM parameters").first()[0] == 1000
    for text in ("summary_stats_weighted(x, w - 4)", "tdigest_of(x, x)", "space_saving_weighted(s, w - 1)", "tdigest_histogram(tdigest(x), 0)", "tdigest_histogram_at(tdigest(x), array(2D, 1D))"):
        with pytest.raises(Exception, match="must"):
            spark.sql(f"SELECT {text} FROM parameters").collect()


def test_tiny_values_in_sql_end_without_an_error(spark):
    sql.register(spark)
    text = "SELECT stats_skew(s), stats_kurt(s), stats_valid(s) FROM (SELECT summary_stats(x) s FROM VALUES (1e-160D), (2e-160D), (4e-160D) t(x))"
    assert spark.sql(text).first()[2]


def test_soundness_of_stored_sketches(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    d, s = tdigest.build(df, "k", "v", compression=20), stats.build(df, "k", "v")
    assert {r[0] for r in d.select(D.valid("digest")).collect()} == {r[0] for r in s.select(M.valid("stats")).collect()} == {True}
    assert tdigest.build(df.limit(0), None, "v").select(D.valid("digest")).first()[0] and stats.build(df.limit(0), None, "v").select(M.valid("stats")).first()[0]
    c = F.col("digest.centroids")
    for broken in (d.digest.withField("total_weight", F.lit(1.0)), d.digest.withField("centroids", F.reverse(c)), d.digest.withField("max", F.lit(0.0)), d.digest.withField("compression", F.lit(5.0)), d.digest.withField("centroids", F.transform(c, lambda x: x.withField("weight", -x["weight"]))), F.lit(None).cast(d.schema["digest"].dataType)):
        assert {r[0] for r in d.select(broken.alias("digest")).select(D.valid("digest")).collect()} == {False}
    for broken in (s.stats.withField("m2", F.lit(-1.0)), s.stats.withField("min", F.lit(1e9)), s.stats.withField("count", F.lit(0).cast("long")), s.stats.withField("sum", F.lit(None).cast("double")), F.lit(None).cast(s.schema["stats"].dataType)):
        assert {r[0] for r in s.select(broken.alias("stats")).select(M.valid("stats")).collect()} == {False}
