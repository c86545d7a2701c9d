"""Plans and operators that must not grow faster than their input, and results that mustn't depend on its size."""

import pytest
from pyspark.sql import functions as F

from sketchloom.plans.registry import QUERIES

TINY = "/root/testdata/sf0.001"


def test_quantiles_by_a_generator_can_be_written(spark, tmp_path):
    QUERIES["tdigest_large"](spark, TINY).write.parquet(f"{tmp_path}/large")
    got = spark.read.parquet(f"{tmp_path}/large")
    assert got.columns == ["l_returnflag", "i", "quantile"] and got.count() == 3 * 7


@pytest.mark.parametrize("name", ["tdigest_bounds", "tdigest_skewed_bounds", "tdigest_merge_bounds", "kll_bounds"])
def test_rows_stay_in_their_tasks_where_they_meet_a_few_digests(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = QUERIES[name](spark, TINY)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan


def test_a_digest_is_folded_once_whatever_reads_it(spark):
    for name in ("tdigest_histogram_user", "tdigest_centroids_user"):
        plan = QUERIES[name](spark, TINY)._jdf.queryExecution().optimizedPlan()
        text = "".join(e.toString() for e in _nodes(plan))
        assert text.count("ASIN(") == 2  # the scale stands twice in a fold


def _nodes(plan):
    """Each node's own expressions."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        for seq, into in ((p.expressions(), out), (p.children(), todo)):
            into.extend(seq.apply(i) for i in range(seq.size()))
    return out


@pytest.mark.parametrize("capacity", [3, 40, 1000])
def test_heaviest_items_are_exact_whatever_the_capacity(spark, capacity):
    from sketchloom.operators import spacesaving

    counts = {i: 5 for i in range(300)} | {500: 400, 501: 300, 502: 300, 7: 6}  # a tie, and ten thousandths that summaries drop
    rows = [(i,) for i, n in counts.items() for _ in range(n)] + [(None,)]
    for k in (2, 3, 6):
        want = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:k]
        for kind in ("long", "double", "array<long>"):
            df = spark.createDataFrame(rows, "x long").repartition(5)
            df = df.select((F.when(F.col("x").isNotNull(), F.array("x")) if kind == "array<long>" else F.col("x").cast(kind)).alias("x"))
            got = [(r.item[0] if kind == "array<long>" else r.item, r["count"], r.error) for r in spacesaving.certain_topk(df, "x", k, capacity=capacity).collect()]
            assert got == [(i, n, 0) for i, n in want]


def test_keys_with_room_for_their_items_are_counted_without_an_order(spark):
    from sketchloom.operators import spacesaving

    few, many = [3, 1, 2, 1, 3, None], [i % 9 for i in range(50)]
    rows = [("few", i, x) for i, x in enumerate(few)] + [("many", i, x) for i, x in enumerate(many)] + [(None, 0, 5), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, i long, x long").repartition(6)
    got = {r.k: r.summary for r in spacesaving.build_in_order(df, "k", "x", "i", capacity=3).collect()}
    assert set(got) == {"few", "many", None, "none"}
    assert [tuple(c) for c in got["few"]["counters"]] == [(1, 2, 0), (3, 2, 0), (2, 1, 0)] and got["few"]["m"] == 1  # 1 moved before 3
    assert sum(c["count"] for c in got["many"]["counters"]) == 50 and len(got["many"]["counters"]) == 3
    assert [tuple(c) for c in got[None]["counters"]] == [(5, 1, 0)] and got[None]["m"] == 0 and got["none"]["counters"] == []
    assert spacesaving.build_in_order(df.limit(0), None, "x", "i", capacity=3).count() == 0

    roomy = spacesaving.build_in_order(df.filter("k = 'few'"), "k", "x", "i", capacity=3)
    roomy.collect()
    assert "EmptyRelation" in roomy._jdf.queryExecution().executedPlan().toString()  # no row is left to be put in order


def test_keys_of_few_rows_need_no_brackets(spark, monkeypatch):
    from sketchloom.operators import selection

    df = spark.range(5000).select((F.col("id") % 500).alias("k"), (F.col("id") * 7919 % 5000).alias("x"))
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("x", [0.1, 0.5]).alias("q")).collect()}
    bracketed = {r.k: r.quantiles for r in selection.exact_quantiles(df, "k", "x", [0.1, 0.5], fit=5).collect()}
    monkeypatch.setattr(selection, "_within", None)
    at_once = {r.k: r.quantiles for r in selection.exact_quantiles(df, "k", "x", [0.1, 0.5]).collect()}
    assert at_once == bracketed and all(at_once[k] == pytest.approx(q, rel=1e-12) for k, q in want.items())


@pytest.mark.parametrize("fit", [4, 1000])
def test_quantiles_by_midpoints(spark, fit):
    from sketchloom.operators.selection import exact_quantiles

    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 8, 16)], "x double")
    q = [0.0, 0.05, 0.25, 0.5, 0.6, 0.99, 1.0]
    want = [1.0, 1.0, 2.0, 6.0, 8.0, 16.0, 16.0]
    got = exact_quantiles(df, None, "x", q, fit=fit, midpoints=True).first().quantiles
    assert got == pytest.approx(want, rel=1e-12)


def test_windows_of_more_rows_than_stay_apart_have_exact_quartiles(spark, tmp_path):
    from oracle import compare

    from sketchloom.plans.registry import ORACLES

    i = F.col("id")
    user = F.when(i % 5 == 0, 1000 + i % 7).otherwise(5)
    events = spark.range(6000).select(i.alias("event_id"), F.timestamp_seconds(1704067200 + i * 86400 * 3 / 6000).alias("ts"), user.alias("user_id"), (F.rand(3) * 1000).alias("value"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    compare(QUERIES["tdigest_sliding_week"](spark, str(tmp_path)), ORACLES["tdigest_sliding_week"], str(tmp_path))


def test_a_task_passes_digests_of_many_keys_on_early():
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from sketchloom.functions.types import TDIGEST
    from sketchloom.operators import tdigest

    schema = to_arrow_schema(T.StructType([T.StructField("k", T.LongType()), T.StructField("d", TDIGEST)]))
    one = np.ones(10_000)
    batches = (pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 10_000)), pa.array(one), pa.array(one)], names=["k", "x", "w"]) for i in range(0, 300_000, 10_000))
    sizes = [b.num_rows for b in tdigest._partial(batches, 1, schema, 100.0, False)]
    assert sum(sizes) == 300_000 and max(sizes) <= 110_000


def test_pairs_are_counted_without_text_or_a_shuffle_of_all(spark, monkeypatch):
    from sketchloom.operators import spacesaving

    plans, build, exact = [], spacesaving.build, spacesaving.exact_topk
    plan = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower()) or df
    monkeypatch.setattr(spacesaving, "build", lambda *a, **b: plan(build(*a, **b)))
    monkeypatch.setattr(spacesaving, "exact_topk", lambda df, *a, **b: exact(plan(df), *a, **b))
    QUERIES["spacesaving_word_pairs"](spark, TINY)
    assert len(plans) == 2 and not any("json" in p for p in plans)
    assert "leftsemi" in plans[1]  # only pairs that may be among the ten are shuffled


@pytest.mark.parametrize("kind", ["array<string>", "struct<a:array<string>,b:int>", "array<struct<a:string,b:int>>", "array<array<int>>"])
def test_composite_items_meet_by_parts(spark, kind):
    import numpy as np

    from sketchloom.operators import spacesaving

    text = "transform(sequence(1, 1 + id % 3), i -> if((id + i) % 5 = 0, null, concat('w', (id * 7 + i) % 4)))"
    if kind == "array<string>":
        item = f"case when id % 11 = 0 then null when id % 13 = 0 then array() else {text} end"
    elif kind.startswith("struct"):
        item = f"if(id % 11 = 0, null, struct({text} as a, if(id % 7 = 0, null, int(id % 2)) as b))"
    elif kind == "array<array<int>>":
        item = "array(array(int(id % 3)), if(id % 5 = 0, null, array(int(id % 2), null)))"
    else:
        item = "array(if(id % 5 = 0, null, struct(concat('w', id % 3) as a, int(id % 2) as b)), struct(null as a, int(id % 4) as b))"
    df = spark.range(3000).select(F.expr(item).cast(kind).alias("x"), (F.col("id") % 3 + 1).alias("n"))
    counts = df.filter("x is not null").groupBy("x").agg(F.count("*").alias("c"), F.sum("n").alias("s")).orderBy(F.desc("c"), "x").collect()
    for count, of in ((1, "c"), (5, "c"), ("n", "s")):
        want = {str(r.x): r[of] * (count if count == 5 else 1) for r in counts}
        full = spacesaving.build(df.repartition(4), None, "x", count, capacity=1000).first().summary
        assert full.m == 0 and {str(c.item): c["count"] for c in full.counters} == want and len(full.counters) == len(want)
        assert all(c.error == 0 for c in full.counters)
        few = spacesaving.build(df.repartition(4), None, "x", count, capacity=3).first().summary
        assert len(few.counters) == 3 and few.m > 0
        assert all(c["count"] - c.error <= want[str(c.item)] <= c["count"] for c in few.counters)
        assert all(n <= few.m for i, n in want.items() if i not in {str(c.item) for c in few.counters})
    top = [(r.item, r["count"]) for r in spacesaving.certain_topk(df.repartition(4), "x", 5, capacity=8).collect()]
    assert top == [(r.x, r.c) for r in counts[:5]]
    by_x = df.select("x").orderBy("x").toArrow().column("x").combine_chunks()
    ranks, items = spacesaving._ranks(by_x), by_x.to_pylist()
    same = [a == b for a, b in zip(items, items[1:])]
    assert (np.diff(ranks) >= 0).all() and [bool(v) for v in np.diff(ranks) == 0] == same
