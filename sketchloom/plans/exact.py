"""Queries of exact quantiles, of decayed counts and of Spark's own sketches, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sketchloom import sql
from sketchloom.operators import decay, native
from sketchloom.operators.selection import exact_quantiles
from sketchloom.plans.queries import _r, query
from sketchloom.plans.rollups import _EARLY, _HALF_LIFE, _LATE
from sketchloom.sources.tables import load, save, scratch, table

ORACLES: dict[str, str] = {}
_QS = {"lo": 0.0, "q01": 0.01, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q999": 0.999, "hi": 1.0}


def _named(df, keys):
    return df.select(*keys, *(_r(F.col("quantiles")[i]).alias(n) for i, n in enumerate(_QS)))


def _cont(x: str) -> str:
    return ", ".join(f"round(quantile_cont({x}, {p}), 6) AS {n}" for n, p in _QS.items())


@query
def exact_quantiles_lineitem(spark, d):
    """Exact quantiles of all prices, without a sort."""
    return _named(exact_quantiles(table(spark, d, "lineitem"), None, "l_extendedprice", list(_QS.values())), [])


ORACLES["exact_quantiles_lineitem"] = f"SELECT {_cont('l_extendedprice')} FROM lineitem"


@query
def exact_quantiles_by_flags(spark, d):
    """By two keys, one of whose groups has half of the rows."""
    keys = ["l_returnflag", "l_linestatus"]
    return _named(exact_quantiles(table(spark, d, "lineitem"), keys, "l_extendedprice", list(_QS.values())), keys)


ORACLES["exact_quantiles_by_flags"] = f"SELECT l_returnflag, l_linestatus, {_cont('l_extendedprice')} FROM lineitem GROUP BY 1, 2"


@query
def exact_quantiles_whole_numbers(spark, d):
    """Of whole numbers, by very many keys."""
    return _named(exact_quantiles(table(spark, d, "events"), "user_id", "event_id", list(_QS.values())), ["user_id"])


ORACLES["exact_quantiles_whole_numbers"] = f"SELECT user_id, {_cont('event_id')} FROM events GROUP BY 1"


@query
def spacesaving_decayed(spark, d):
    """The five heaviest buckets of users of each type by weights that halve every thirty days; early and late events have landmarks of their own."""
    rows = table(spark, d, "events").select("event_type", "ts", (F.col("user_id") % 200).alias("bucket"), (F.col("ts") >= F.timestamp_seconds(F.lit(_EARLY))).alias("late"))
    parts = [decay.build_counts(rows.filter(F.col("late") == late), "event_type", "bucket", "ts", _HALF_LIFE, at, capacity=256) for late, at in ((True, _LATE), (False, _EARLY))]
    s = decay.merge_counts(parts[0].unionByName(parts[1]), "event_type")
    return s.select("event_type", F.inline(decay.topk_at("decayed", 5, _LATE))).select("event_type", "item", _r("count", 2).alias("weight"))


ORACLES["spacesaving_decayed"] = f"""SELECT event_type, user_id % 200 AS item, round(sum(pow(2.0, (epoch_us(ts) / 1e6 - {_LATE}) / {_HALF_LIFE}.0)), 2) AS weight FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sum(pow(2.0, (epoch_us(ts) / 1e6 - {_LATE}) / {_HALF_LIFE}.0)) DESC) <= 5"""

#: Probabilities and values at which KLL sketches of k = 800 are held against exact ranks; their error is some 0.0035.
_PROBES, _VALUES, _ERROR = [0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99], [0.5, 5.0, 15.0, 35.0, 70.0, 110.0, 200.0], 0.012


@query
def kll_bounds(spark, d):
    """KLL sketches by day, stored, then merged by type: whether quantiles' exact ranks and shares up to values are within the bound."""
    rows = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value").filter("value IS NOT NULL AND NOT isnan(value)")
    save(native.kll(rows, ["event_type", "day"], "value", k=800), path := scratch(spark, "kll"))
    s = native.kll_merge(load(spark, path), "event_type").select(F.col("event_type").alias("type"), native.kll_quantile("kll", _PROBES).alias("qs"), native.kll_cdf("kll", _VALUES).alias("shares"))
    joined = rows.join(F.broadcast(s), F.col("event_type") == F.col("type"))  # of types, a handful: rows stay in their tasks
    tests = lambda i: (("b", F.col("value") < F.col("qs")[i]), ("u", F.col("value") <= F.col("qs")[i]), ("v", F.col("value") <= _VALUES[i]))
    sums = [F.sum(F.when(test, 1).otherwise(0)).alias(f"{n}{i}") for i in range(len(_PROBES)) for n, test in tests(i)]
    got = joined.groupBy("event_type", "shares").agg(F.count("*").alias("n"), *sums)  # a first(shares) would have all rows sorted
    each = []
    for i, q in enumerate(_PROBES):
        lo, hi, share = F.col(f"b{i}") / F.col("n") - _ERROR, F.col(f"u{i}") / F.col("n") + _ERROR, F.col(f"v{i}") / F.col("n")
        each.append(F.struct(F.lit(q).alias("q"), F.lit(q).between(lo, hi).alias("quantile_ok"), (F.abs(F.col("shares")[i] - share) <= _ERROR).alias("cdf_ok")))
    return got.select("event_type", "n", F.inline(F.array(*each)))


ORACLES["kll_bounds"] = "SELECT event_type, count(*) AS n, CAST(q AS DOUBLE) AS q, true AS quantile_ok, true AS cdf_ok FROM events, (VALUES (0.01), (0.1), (0.3), (0.5), (0.7), (0.9), (0.99)) t(q) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type, q"


@query
def topk_states(spark, d):
    """Top-k states by month, stored, then merged by flag; all fifty quantities are tracked, so that counts are exact."""
    rows = table(spark, d, "lineitem").select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_quantity")
    save(native.topk_state(rows, ["l_returnflag", "month"], "l_quantity", tracked=1000), path := scratch(spark, "topk"))
    s = native.topk_merge(load(spark, path), "l_returnflag", tracked=1000)
    return s.select("l_returnflag", F.inline(native.topk_estimate("state", 1000))).select("l_returnflag", "item", "count")


ORACLES["topk_states"] = 'SELECT l_returnflag, l_quantity AS item, count(*) AS "count" FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1, 2'


@query
def sql_parameters(spark, d):
    """SQL with weights, corrected moments and a compression, and whether what they gave is sound, for each supplier: a group is one task's."""
    sql.register(spark)
    table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_linenumber", "l_quantity").createOrReplaceTempView("sketchloom_lines")
    return spark.sql("""SELECT l_suppkey, round(stats_skew(s, false), 6) AS skew_fair, round(stats_kurt(s, true, false), 6) AS kurt_fair, round(stats_mean(f), 4) AS mean_of_copies, f.count AS copies, t.total_weight AS weight, t.compression,
 aggregate(tdigest_histogram(t, 7), 0D, (a, x) -> a + x) BETWEEN t.total_weight * (1D - 1e-9D) AND t.total_weight * (1D + 1e-9D) AS whole, tdigest_valid(t) AND stats_valid(s) AND stats_valid(f) AND space_saving_double_valid(c) AS sound, c.counters[0].item AS quantity, c.counters[0].count AS quantity_weight
FROM (SELECT l_suppkey, summary_stats(l_extendedprice) AS s, summary_stats_frequency(l_extendedprice, l_linenumber) AS f, tdigest_weighted_of(l_extendedprice, CAST(l_linenumber AS DOUBLE), 250D) AS t, space_saving_double_weighted_of(l_quantity, CAST(l_linenumber AS BIGINT), 64) AS c FROM sketchloom_lines GROUP BY l_suppkey)""")


ORACLES["sql_parameters"] = """WITH q AS (SELECT l_suppkey, CAST(l_quantity AS DOUBLE) item, CAST(sum(l_linenumber) AS BIGINT) n FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_linenumber) DESC, item) = 1)
SELECT l_suppkey, round(skewness(l_extendedprice), 6) AS skew_fair, round(kurtosis(l_extendedprice), 6) AS kurt_fair, round(sum(l_extendedprice * l_linenumber) / sum(l_linenumber), 4) AS mean_of_copies, CAST(sum(l_linenumber) AS BIGINT) AS copies, CAST(sum(l_linenumber) AS DOUBLE) AS weight, CAST(250 AS DOUBLE) AS compression, true AS whole, true AS sound, any_value(item) AS quantity, any_value(n) AS quantity_weight
FROM lineitem JOIN q USING (l_suppkey) GROUP BY 1"""
