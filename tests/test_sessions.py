"""Session sketches from a stream against batch's session windows."""

import numpy as np
from pyspark.sql import functions as F

from sketchloom.functions import digest as D
from sketchloom.operators import stats
from sketchloom.streaming.sessions import PROVIDER, session_sketches


def test_sessions_of_late_and_unordered_events(spark, tmp_path):
    """Events in any order within the lateness, over several batches and a restart from the checkpoint, give batch's sessions."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rng = np.random.default_rng(7)
    base = 1_700_000_000
    rows = [(["a", "b", None][int(k)], base + int(t), float(v)) for k, t, v in zip(rng.integers(0, 3, 240), np.sort(rng.integers(0, 20_000, 240)), rng.normal(size=240))]
    rows += [("a", base + 20_100, float("nan")), ("b", base + 20_200, None)]
    batches = [[rows[i] for i in range(len(rows)) if i * 4 // len(rows) == b] for b in range(4)]
    for b in range(3):  # some events come a batch later than they should
        batches[b + 1] = batches[b][-8:] + batches[b + 1]
        del batches[b][-8:]
    last = [("z", base + 90_000, 0.0)]  # moves the watermark beyond all others
    schema = "k string, t long, x double"
    src = str(tmp_path / "in")

    def put(some):
        spark.createDataFrame([some[i] for i in rng.permutation(len(some))], schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(src).withColumn("ts", F.timestamp_seconds("t"))
        out = session_sketches(stream, "k", "x", "ts", "5 minutes", late="2 hours", compression=50)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(100)

    for b in [*batches, last, [("z", base + 90_001, 0.0)]]:
        put(b)
        run()
    whole = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t"))
    want = stats.build(whole.select(F.session_window("ts", "5 minutes").alias("w"), "k", "x"), ["k", "w"], "x")
    key = lambda r: (r.k or "", r.start)
    want = sorted(want.select("k", "w.start", "w.end", "stats").collect(), key=key)
    got = sorted(spark.read.parquet(str(tmp_path / "out")).withColumn("n", D.size("digest")).collect(), key=key)
    assert [(r.k, r.start, r.end, r.stats["count"]) for r in got] == [(r.k, r.start, r.end, r.stats["count"]) for r in want] and len(got) > 30
    for a, b in zip(got, want):
        assert a.n == b.stats["count"] and a.digest["min"] == b.stats["min"] and np.isclose(a.stats["sum"], b.stats["sum"]) and np.isclose(a.stats["m2"], b.stats["m2"], atol=1e-12)
