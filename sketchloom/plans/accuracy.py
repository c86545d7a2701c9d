"""Queries that hold sketches against exact answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions import digest as D
from sketchloom.functions import moments as M
from sketchloom.operators import spacesaving, stats, tdigest
from sketchloom.plans.queries import _r, _top, query
from sketchloom.sources.tables import load, save, scratch, table

#: Probabilities at which digests are held against exact ranks, and the bounds on errors of quantiles and shares.
PROBES, QUANTILE_ERROR, CDF_ERROR = [0.001, 0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99, 0.999], 0.012, 0.005


def _bounds(rows: DataFrame, digests: DataFrame, key: str, x: str) -> DataFrame:
    """For each key and probe whether the quantile's exact rank, and the share at it, are within the bounds."""
    probes = digests.select(F.col(key).alias("__key"), D.quantile("digest", PROBES).alias("__q"), "digest")  # a row for each key of the digests
    probes = probes.select("__key", "__q", F.array(*(D.cdf_of("digest", f"__q[{i}]") for i in range(len(PROBES)))).alias("__c"))
    joined = rows.join(F.broadcast(probes), rows[key] == probes["__key"])  # of flags, a handful: rows stay in their tasks
    below = [F.sum(F.when(F.col(x) < F.col("__q")[i], 1).otherwise(0)).alias(f"b{i}") for i in range(len(PROBES))]
    upto = [F.sum(F.when(F.col(x) <= F.col("__q")[i], 1).otherwise(0)).alias(f"u{i}") for i in range(len(PROBES))]
    got = joined.groupBy(key, F.col("__c").alias("c")).agg(F.count("*").alias("n"), *below, *upto)  # a first(c) would have all rows sorted
    each = []
    for i, q in enumerate(PROBES):
        lo, hi, c = F.col(f"b{i}") / F.col("n"), F.col(f"u{i}") / F.col("n"), F.col("c")[i]
        each.append(F.struct(F.lit(q).alias("q"), ((lo - QUANTILE_ERROR <= q) & (F.lit(q) <= hi + QUANTILE_ERROR)).alias("quantile_ok"), ((lo - CDF_ERROR <= c) & (c <= hi + CDF_ERROR)).alias("cdf_ok")))
    return got.select(key, F.inline(F.array(*each)))


@query
def tdigest_bounds(spark, d):
    """Large groups whose centroids are folded."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    return _bounds(rows, tdigest.build(rows, "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")


@query
def tdigest_merge_bounds(spark, d):
    """The same after a merge of digests of disjoint ranges, of low and of high prices."""
    rows = table(spark, d, "lineitem").select("l_linestatus", "l_extendedprice", (F.col("l_extendedprice") > 30000).alias("dear"))
    parts = tdigest.build(rows, ["l_linestatus", "dear"], "l_extendedprice")
    return _bounds(rows, tdigest.merge(parts.drop("dear"), "l_linestatus"), "l_linestatus", "l_extendedprice")


@query
def tdigest_skewed_bounds(spark, d):
    """A long-tailed column: cubes of prices, divided by quantities."""
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.pow(F.col("l_extendedprice"), 3) / F.col("l_quantity")).alias("x"))
    return _bounds(rows, tdigest.build(rows, "l_returnflag", "x"), "l_returnflag", "x")


@query
def tdigest_folds(spark, d):
    """What folding must keep: at most 2 * compression centroids, in order, with all of the weight and the same mean."""
    rows = table(spark, d, "lineitem")
    s = tdigest.build(rows, "l_returnflag", "l_extendedprice")
    c = D.centroids("digest")
    s = s.withColumn("n_centroids", F.size(c)).withColumn("weight", F.aggregate(c, F.lit(0.0), lambda a, x: a + x["weight"])).withColumn("mean", F.aggregate(c, F.lit(0.0), lambda a, x: a + x["mean"] * x["weight"]) / F.col("weight"))
    means = F.transform(c, lambda x: x["mean"])
    return s.select("l_returnflag", ((F.col("n_centroids") <= 200) & (F.col("n_centroids") > 20)).alias("folded"), (F.array_sort(means) == means).alias("sorted"), F.col("weight").alias("n"), _r("mean", 4).alias("mean"))


def _weighted(spark, d) -> DataFrame:
    points = table(spark, d, "lineitem").groupBy("l_partkey", "l_extendedprice").agg(F.sum("l_linenumber").alias("w"))
    return tdigest.build(points, "l_partkey", "l_extendedprice", weight="w", compression=1000)


@query
def tdigest_weighted(spark, d):
    s = _weighted(spark, d)
    return s.select("l_partkey", D.size("digest").alias("n"), *(_r(D.quantile("digest", q)).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)))


@query
def tdigest_weighted_scaled(spark, d):
    """A factor that makes weights under 3 vanish: their centroids go, and minimum and maximum stay unless nothing is left."""
    s = _weighted(spark, d).select("l_partkey", D.scale("digest", 2.220446049250313e-16 / 2.5).alias("digest"))
    kept = F.size(D.centroids("digest")).cast("long")
    return s.select("l_partkey", kept.alias("n_centroids"), (D.size("digest") > 0).alias("any_left"), *(F.nanvl(c, F.lit(-1.0)).alias(n) for n, c in (("lo", D.minimum("digest")), ("hi", D.maximum("digest")))))


@query
def tdigest_skips(spark, d):
    """NULL, NaN and infinite values, and weights of no more than the double's epsilon, are left out."""
    i = F.col("event_id")
    x = F.when(i % 5 == 0, float("nan")).when(i % 7 == 0, float("inf")).when(i % 11 == 0, float("-inf")).when(i % 13 == 0, F.lit(None)).otherwise(F.col("value"))
    rows = table(spark, d, "events").select("user_id", x.alias("x"), F.when(i % 3 == 0, 1e-17).otherwise(1.0).alias("w"))
    return tdigest.build(rows, "user_id", "x", weight="w").select("user_id", D.size("digest").alias("n"), D.minimum("digest").alias("lo"), D.maximum("digest").alias("hi"))


@query
def tdigest_compressions(spark, d):
    """Compressions outside 20 to 1000 are clamped; the number of points that stay apart follows."""
    rows = table(spark, d, "events").filter("user_id IS NOT NULL").select("user_id", "value")
    out = None
    for c in (1.0, 20.0, 100.0, 1000.0, 5000.0):
        s = tdigest.build(rows, "user_id", "value", compression=c)
        one = s.agg(F.lit(c).alias("given"), F.max(D.compression("digest")).alias("compression"), F.max(F.size(D.centroids("digest")) <= 2 * D.compression("digest")).alias("bounded"), F.sum(D.size("digest")).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def tdigest_histogram_forms(spark, d):
    """Default range, given edges with a repeated one, and a range without any weight, of each user's exact digest."""
    s = tdigest.build(table(spark, d, "events"), "user_id", "value")
    forms = {"default": D.histogram("digest", 3), "edges": D.histogram("digest", [-1000.0, 50.0, 50.0, 100000.0]), "outside": D.histogram("digest", 2, (-5.0, -3.0))}
    each = F.array(*(F.struct(F.lit(k).alias("form"), h["hist"].alias("hist"), h["edges"].alias("edges")) for k, h in forms.items()))
    rows = s.select("user_id", F.inline(each)).select("user_id", "form", F.col("edges")[0].alias("first_edge"), F.element_at("edges", -1).alias("last_edge"), F.posexplode("hist").alias("bin", "w"))
    return rows.select("user_id", "form", F.col("bin").cast("long").alias("bin"), _r("first_edge", 5).alias("first_edge"), _r("last_edge", 5).alias("last_edge"), _r("w", 5).alias("w"))


@query
def tdigest_small(spark, d):
    """No values, one, and two: sizes, quantiles, shares and histograms."""
    regions = table(spark, d, "region").select("r_regionkey", F.explode(F.when(F.col("r_regionkey") < 3, F.slice(F.array(F.lit(1.0), F.lit(2.0)), F.lit(1), F.col("r_regionkey").cast("int"))).otherwise(F.array(F.lit(float("nan"))))).alias("x"))
    keys = table(spark, d, "region").select("r_regionkey", F.lit(float("nan")).alias("x"))
    s = tdigest.build(regions.unionByName(keys), "r_regionkey", "x")
    h = D.histogram("digest", 2)
    nan = lambda c: F.coalesce(F.nanvl(c, F.lit(-1.0)), F.lit(-1.0))
    return s.select(F.col("r_regionkey").cast("long").alias("k"), D.size("digest").alias("n"), nan(D.quantile("digest", 0.5)).alias("q50"), nan(D.cdf("digest", 1.0)).alias("c1"), nan(D.minimum("digest")).alias("lo"), h["edges"][0].alias("e0"), h["edges"][2].alias("e2"), h["hist"][0].alias("w0"), h["hist"][1].alias("w1"))


@query
def tdigest_stored(spark, d):
    """Digests that are kept as a table and read back are the same."""
    path = scratch(spark, "digests")
    save(tdigest.build(table(spark, d, "events"), "user_id", "value"), path)
    return load(spark, path).select("user_id", D.describe("digest").alias("text"), _r(D.quantile("digest", 0.5)).alias("q50"))


@query
def stats_stored(spark, d):
    path = scratch(spark, "stats")
    save(stats.build(table(spark, d, "events"), "event_type", "value"), path)
    return load(spark, path).select("event_type", M.describe("stats").alias("text"), _r(M.mean("stats")).alias("mean"), _r(M.kurt("stats")).alias("fisher"))


@query
def stats_single(spark, d):
    """One observation at a time: each row is a summary of its own, and shape is undefined."""
    s = stats.build(table(spark, d, "customer"), "c_custkey", "c_acctbal")
    return s.select("c_custkey", M.count("stats").alias("n"), M.total("stats").alias("total"), M.minimum("stats").alias("lo"), M.maximum("stats").alias("hi"), M.var("stats").alias("var0"), F.isnan(M.var("stats", 1)).alias("var1_undefined"), F.isnan(M.skew("stats")).alias("skew_undefined"), F.isnan(M.kurt("stats")).alias("kurt_undefined"))


@query
def stats_frequency(spark, d):
    """Weights as numbers of copies."""
    s = stats.build(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", weight="l_linenumber", weighting="frequency")
    return s.select("l_returnflag", M.count("stats").alias("n"), _r(M.mean("stats"), 4).alias("mean"), _r(M.std("stats"), 4).alias("std"), _r(M.skew("stats")).alias("skew_biased"), _r(M.kurt("stats")).alias("fisher"))


@query
def stats_merge_weighted(spark, d):
    parts = stats.build(table(spark, d, "lineitem"), ["l_returnflag", "l_suppkey"], "l_extendedprice", weight="l_linenumber", weighting="frequency")
    return stats.merge(parts.drop("l_suppkey"), "l_returnflag").select("l_returnflag", M.count("stats").alias("n"), _r(M.mean("stats"), 4).alias("mean"), _r(M.std("stats"), 4).alias("std"), _r(M.kurt("stats")).alias("fisher"), M.maximum("stats").alias("hi"))


@query
def spacesaving_bounds(spark, d):
    """Summaries that evict: each counter's bounds hold the exact count, and what has no counter is no heavier than m."""
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("half"), "l_partkey")
    s = spacesaving.build(rows, "half", "l_partkey", capacity=20)
    exact = rows.groupBy("half", F.col("l_partkey").alias("item")).agg(F.count("*").alias("n"))
    kept = s.select("half", F.col("summary.m").alias("m"), F.inline("summary.counters"))
    both = exact.join(kept.select(F.col("half").alias("h"), "item", "count", "error"), (F.col("half") == F.col("h")) & (exact["item"] == kept["item"]), "left").select("half", "n", "count", "error")
    both = both.join(F.broadcast(s.select(F.col("half").alias("h"), F.col("summary.m").alias("m"))), F.col("half") == F.col("h"))  # two rows
    ok = F.when(F.col("count").isNull(), F.col("n") <= F.col("m")).otherwise((F.col("count") - F.col("error") <= F.col("n")) & (F.col("n") <= F.col("count")))
    return both.groupBy("half").agg(F.count("count").alias("n_counters"), F.min(ok).alias("bounds_hold"), F.sum("n").alias("n"))


@query
def spacesaving_stored(spark, d):
    path = scratch(spark, "summaries")
    save(spacesaving.build(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", capacity=64), path)
    s = load(spark, path)
    return s.select("l_returnflag", spacesaving.valid("summary").alias("sound"), spacesaving.describe("summary").alias("text"), F.inline(spacesaving.topk("summary", 3)))


@query
def spacesaving_unsound(spark, d):
    """Stored states that repeat an item, or have more counters than their capacity, are told from sound ones."""
    s = spacesaving.build(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", capacity=64)
    parts = {"sound": F.col("summary.counters"), "repeated": F.concat(F.slice("summary.counters", 1, 2), F.slice("summary.counters", 1, 1)), "too many": F.col("summary.counters")}
    each = [F.struct(F.lit(k).alias("state"), F.struct(F.lit(10 if k == "too many" else 64).alias("capacity"), F.col("summary.m").alias("m"), c.alias("counters")).alias("summary")) for k, c in parts.items()]
    return s.select("l_returnflag", F.inline(F.array(*each))).select("l_returnflag", "state", spacesaving.valid("summary").alias("sound"))


@query
def spacesaving_merge_unequal(spark, d):
    """Summaries of capacities 20 and 30, merged to the larger one."""
    rows = table(spark, d, "lineitem").withColumn("half", F.col("l_linenumber") % 2)
    full = spacesaving.build(rows, "half", "l_quantity", capacity=64)
    cut = [spacesaving.merge(full.filter(F.col("half") == h), "half", capacity=c) for h, c in ((0, 20), (1, 30))]
    s = spacesaving.merge(cut[0].unionByName(cut[1]).drop("half"), None)
    return s.select(spacesaving.capacity("summary").alias("capacity"), F.inline(spacesaving.counters("summary")))


@query
def spacesaving_in_order(spark, d):
    """Each half's rows in order, with room for all items: counts are exact."""
    rows = table(spark, d, "lineitem").withColumn("half", F.col("l_linenumber") % 2)
    return _top(spacesaving.build_in_order(rows, "half", "l_quantity", ["l_orderkey", "l_linenumber"], capacity=64), ["half"], 64)
