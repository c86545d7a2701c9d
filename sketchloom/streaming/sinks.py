"""Sketches over streams: native streaming statistics, and a sink that merges each micro-batch into a sketch table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.checks import key_list, numeric
from sketchloom.operators import spacesaving, stats, tdigest


def stream_stats(stream: DataFrame, keys, x: str, ts: str | None = None, width: str | None = None, late: str = "10 minutes", out: str = "stats") -> DataFrame:
    """Statistics as an ordinary streaming aggregation; with ``ts`` and ``width`` by tumbling window with a watermark."""
    keys = key_list(keys)
    value = numeric(stream, x)
    value = F.when(F.isnan(value), None).otherwise(value)
    if ts is None:
        return stats.aggregate(stream.select(*keys, value.alias("__x")), keys, "__x", out)
    rows = stream.withWatermark(ts, late).select(F.window(ts, width).alias("window"), *keys, value.alias("__x"))
    return stats.aggregate(rows, ["window", *keys], "__x", out)


class SketchTable:
    """A keyed sketch table that micro-batches are merged into; use ``table.update`` with ``foreachBatch``.

    Each batch writes a new version beside the last one, of which the version before is kept for readers. A version is
    named by a running number, the stream that made it and the batch: a batch that is run again finds that its stream has
    done it and does nothing, so that each counts once, and a stream that isn't known, such as one restarted with a new
    checkpoint, goes on from the last version. ``stream`` names the stream; without it that is the id that Spark gives a
    query, which belongs to its checkpoint. One stream updates a table at a time. The folder must be on shared storage.
    """

    #: Versions that are kept.
    KEPT = 2

    def __init__(self, path: str, build: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], stream: str | None = None) -> None:
        self.path, self.build, self.merge, self.stream = path.rstrip("/"), build, merge, stream

    @classmethod
    def digests(cls, path: str, keys, x: str, compression: float = 100.0, weight: str | float = 1, stream: str | None = None) -> SketchTable:
        return cls(path, lambda df: tdigest.build(df, keys, x, weight=weight, compression=compression), lambda df: tdigest.merge(df, keys, compression=compression), stream)

    @classmethod
    def summaries(cls, path: str, keys, item: str, capacity: int = 20, count: str | int = 1, stream: str | None = None) -> SketchTable:
        return cls(path, lambda df: spacesaving.build(df, keys, item, count=count, capacity=capacity), lambda df: spacesaving.merge(df, keys, capacity=capacity), stream)

    @classmethod
    def stats(cls, path: str, keys, x: str, weight: str | int = 1, weighting: str = "reference", stream: str | None = None) -> SketchTable:
        return cls(path, lambda df: stats.build(df, keys, x, weight=weight, weighting=weighting), lambda df: stats.merge(df, keys), stream)

    def _system(self, spark):
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self, spark) -> list[tuple[int, str, dict[str, int]]]:
        """(number, folder, last batch of each stream) of each complete version, the last one last."""
        root, system, path = self._system(spark)
        if not system.exists(root):
            return []
        names = [s.getPath().getName() for s in system.listStatus(root)]
        done = [n for n in names if n.startswith("v=") and system.exists(path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted((int(number), name, self._batches(name)) for name in done for number in [name[2:].partition(".")[0]])

    @staticmethod
    def _batches(name: str) -> dict[str, int]:
        """Streams and batches of a folder's name: v=<number>.<stream>-<batch>[.<stream>-<batch>...]."""
        return {s: int(b) for s, _, b in (x.rpartition("-") for x in name.split(".")[1:])}

    def update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = self.stream or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batches"
        stream = hashlib.sha1(stream.encode()).hexdigest()[:10]  # folders' names are bounded
        done = self.versions(spark)
        number, name, known = done[-1] if done else (-1, "", {})
        if known.get(stream, -1) >= batch_id:
            return
        new = self.build(batch)
        if done:
            new = self.merge(spark.read.parquet(f"{self.path}/{name}").unionByName(new))
        # streams that are known stay so, the latest ten: one may be run again after another
        known = dict([*((s, b) for s, b in known.items() if s != stream), (stream, batch_id)][-10:])
        new.write.mode("overwrite").parquet(f"{self.path}/v={number + 1}." + ".".join(f"{s}-{b}" for s, b in known.items()))
        _, system, path = self._system(spark)
        for _, old, _ in done[: 1 - self.KEPT]:
            system.delete(path(f"{self.path}/{old}"), True)

    def read(self, spark) -> DataFrame:
        """The last version."""
        return spark.read.parquet(f"{self.path}/{self.versions(spark)[-1][1]}")
