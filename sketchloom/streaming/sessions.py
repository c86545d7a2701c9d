"""Session windows over a stream, with a sketch of each open session in the state store.

A session of a key holds events that are up to ``gap`` apart, as in Spark's session windows. Its statistics and t-digest are kept as state, merged
with other sessions where an event joins them, whatever the order in which events arrive, and given out by a timer once
the watermark has passed the session's end. So a row comes out once, when it is final, and the state that stays is that of
open sessions: some 200 centroids each, however many events they have.

Spark keeps this state in RocksDB: ``spark.sql.streaming.stateStore.providerClass`` must name its provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sketchloom.functions.checks import key_list, numeric
from sketchloom.functions.types import STATS, TDIGEST
from sketchloom.operators.stats import _combine
from sketchloom.operators.tdigest import clamp, compact

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An open session: first and last event in microseconds, moments, and points of the digest.
STATE = "first long, last long, count double, sum double, min double, max double, m2 double, m3 double, m4 double, mean array<double>, weight array<double>"


class _Sessions(StatefulProcessor):
    def __init__(self, gap: int, compression: float) -> None:
        self.gap, self.compression = gap, compression

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("sessions", STATE)

    def _joined(self, parts: list[tuple]) -> list[tuple]:
        """Sessions of these, in order of time; those that are up to the gap apart become one."""
        out: list[list[tuple]] = []
        for p in sorted(parts, key=lambda p: p[:2]):
            if out and p[0] <= max(q[1] for q in out[-1]) + self.gap:
                out[-1].append(p)
            else:
                out.append([p])
        return [g[0] if len(g) == 1 else self._merged(g) for g in out]

    def _merged(self, parts: list[tuple]) -> tuple:
        moments = _combine(np.zeros(len(parts), np.int64), 1, *(np.array([p[i] for p in parts], float) for i in range(2, 9)))
        mean, weight = (np.concatenate([p[i] for p in parts]) for i in (9, 10))
        if len(mean) > 2 * self.compression:
            mean, weight = compact(mean, weight, self.compression)
        return (min(p[0] for p in parts), max(p[1] for p in parts), *(float(m[0]) for m in moments), mean, weight)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(*r[:9], np.array(r[9], float), np.array(r[10], float)) for r in self.state.get()] if self.state.exists() else []
        for batch in rows:
            t, v = batch["at"].to_numpy(np.int64), batch["value"].to_numpy(float)
            order = np.argsort(t, kind="stable")
            t, v = t[order], v[order]
            code = np.concatenate([[0], np.cumsum(np.diff(t) > self.gap)])
            live, zero = ~np.isnan(v), np.zeros(len(v))
            moments = _combine(code, int(code[-1]) + 1, live.astype(float), np.where(live, v, 0.0), v, v, zero, zero, zero)
            for i in range(int(code[-1]) + 1):
                mine = v[(code == i) & np.isfinite(v)]
                at = t[code == i]
                mean, weight = compact(mean=mine, weight=np.ones(len(mine)), compression=self.compression) if len(mine) > 2 * self.compression else (mine, np.ones(len(mine)))
                held.append((int(at[0]), int(at[-1]), *(float(m[i]) for m in moments), mean, weight))
        self._keep(self._joined(held))
        return iter(())

    def _keep(self, held: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not held:
            self.state.clear()
            return
        self.state.put([(*p[:9], p[9].tolist(), p[10].tolist()) for p in held])
        self.handle.registerTimer(min(self._end(p) for p in held))

    def _end(self, p: tuple) -> int:
        """When no event can join the session any more, in milliseconds."""
        return (p[1] + self.gap) // 1000 + 1

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [(*r[:9], np.array(r[9], float), np.array(r[10], float)) for r in self.state.get()] if self.state.exists() else []
        done = [p for p in held if self._end(p) <= now]
        self._keep([p for p in held if self._end(p) > now])
        for p in done:
            mean, weight = compact(p[9], p[10], self.compression)
            none = lambda x: None if np.isnan(x) else float(x)
            row = {"key": key[0], "start": pd.Timestamp(p[0], unit="us"), "end": pd.Timestamp(p[1] + self.gap, unit="us")}
            row["stats"] = {"count": int(p[2]), "sum": p[3], "min": none(p[4]), "max": none(p[5]), "m2": p[6], "m3": p[7], "m4": p[8]}
            finite = len(mean) > 0
            row["digest"] = {"compression": self.compression, "min": none(p[4]) if finite else None, "max": none(p[5]) if finite else None, "total_weight": float(weight.sum()), "centroids": [{"mean": m, "weight": w} for m, w in zip(mean.tolist(), weight.tolist())]}
            yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def session_sketches(stream: DataFrame, keys, x: str, ts: str, gap: str, late: str = "10 minutes", compression: float = 100.0) -> DataFrame:
    """(keys, start, end, stats, digest) of each session that is over; ``end`` is ``gap`` after its last event.

    ``gap`` and ``late`` are intervals such as ``"30 minutes"``; rows that come more than ``late`` behind the latest event
    are dropped. Keys are told apart by their JSON, so that timestamps among them count by milliseconds. NULL and NaN values count for the session's bounds alone; infinities are left out of digests, whose least
    and largest values are the statistics'.
    """
    keys = key_list(keys)
    if not keys:
        raise ValueError("sessions need a key")
    micros = stream.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {gap})").first()[0]
    kinds = T.StructType([stream.schema[k] for k in keys])
    # keys travel as text: state has no place for a NULL key
    rows = stream.withWatermark(ts, late).select(F.to_json(F.struct(*keys)).alias("key"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts)).alias("at"), numeric(stream, x).alias("value"))
    fields = [T.StructField("key", T.StringType()), T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType()), T.StructField("stats", STATS), T.StructField("digest", TDIGEST)]
    out = rows.groupBy("key").transformWithStateInPandas(_Sessions(micros, clamp(compression)), T.StructType(fields), "append", "eventtime")
    return out.select(F.from_json("key", kinds).alias("key"), "start", "end", "stats", "digest").select("key.*", "start", "end", "stats", "digest")
