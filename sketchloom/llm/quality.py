"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features, namely words, word pairs and character n-grams, hashed
into a table; a softmax over the average gives the class. Vectors and softmax weights are learned together by stochastic
gradient descent in numpy. Features keep the case of letters and punctuation.

Scoring takes one number a table row: the row's vector times the difference of the two classes' weights, so that a
document's logit is the mean of its features' numbers plus a bias.

Defined cases: a NULL or empty text has no features and gets the bias alone; repeated rows are scored alike, each on its
own; rows without a label, or whose label is NULL, aren't learned from; without any labels every score is 0.5. Long rows
are learned from only where a class has too few others (``sample``), and every text is scored whole. Names of columns may
have dots and clash; a column named like the output keeps its name, and the output gets underscores before its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchloom.llm.common import SLICE, fresh, slices, text_bytes
from sketchloom.llm.text import BYTE, MULTIPLIERS, WHITE, mix, piece_hash, powers, prefix_sums, spans

BUCKETS, DIM = 1 << 18, 16
#: Labelled rows of each class that are learned from, at most; bytes of text of all of them; and bytes beyond which a row gives way to the next.
SAMPLE_ROWS, SAMPLE_BYTES, ROW_BYTES = 1500, 16 << 20, 32 << 10
NGRAMS = (2, 3)
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Families of features: table rows and each text's first feature (len + 1 numbers)."""
    starts, ends, first = spans(data, offsets, WHITE)
    sums = prefix_sums(data)
    h = piece_hash(sums, starts, ends)
    mask = _U(BUCKETS - 1)
    yield (h & mask).astype(np.int64), first
    if len(h):
        pair = mix(h[:-1] * MULTIPLIERS[1] + h[1:] * MULTIPLIERS[2])
        docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
        same = docs[1:] == docs[:-1]
        same_word = h[1:] == h[:-1]  # a word that repeats itself is a feature of its own, whatever the word
        pair[same_word] = MULTIPLIERS[3]
        yield (pair[same] & mask).astype(np.int64), np.searchsorted(np.flatnonzero(same), first)
    inverse = powers(len(data) + 1)[1]
    for n in NGRAMS:
        if len(data) < n:
            continue
        g = (sums[n:] - sums[:-n]) * inverse[: len(data) - n + 1] + _U(n) * MULTIPLIERS[5]
        g ^= g >> _U(32)
        g *= MULTIPLIERS[4]
        rows = (g >> _U(64 - 18)).astype(np.int64)
        limit = np.maximum(offsets[1:] - n + 1, offsets[:-1])  # n-grams that start from here on would run into the next text
        if len(offsets) > 2:
            keep = np.ones(len(rows), bool)
            for a, b in zip(limit[:-1], offsets[1:-1]):
                keep[a:b] = False
            at = np.flatnonzero(keep)
            yield rows[at], np.searchsorted(at, np.minimum(offsets, len(rows)))
        else:
            yield rows, np.minimum(offsets, len(rows))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return c[first[1:]] - c[first[:-1]]


class Model:
    """Scores of the table's rows for each family of features, and a bias."""

    def __init__(self, rows: np.ndarray, bias: float) -> None:
        self.rows, self.bias = rows, bias

    def score(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for rows, first in features(data, offsets):
            total += _sums(self.rows[rows], first)
            n += np.diff(first)
        z = total / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(texts: list[str | None], labels: list[int], epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model:
    """Learns from the given rows. Classes weigh alike, however many rows each has."""
    y = np.asarray(labels)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if len(y) == 0 else 3.0 * (2 * float(y[0]) - 1))
    docs = []
    for at in range(0, len(texts), 8):
        data, offsets = text_bytes(pa.array(texts[at : at + 8], pa.large_string()))
        families = list(features(data, offsets))
        for i in range(len(offsets) - 1):
            rows, counts = np.unique(np.concatenate([r[f[i] : f[i + 1]] for r, f in families]), return_counts=True)
            docs.append((rows.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(y, minlength=2) / len(y)
    moment, table_moment = np.full((DIM, 2), 1e-8, np.float32), np.full(BUCKETS, 1e-8, np.float32)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(docs)):
            rows, part = docs[i]
            vectors = table[rows]
            x = part @ vectors if len(rows) else np.zeros(DIM, np.float32)
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= 0.5 / share[y[i]]
            back = w @ p
            g = np.outer(x, p)
            moment += g * g
            w -= (lr * g / np.sqrt(moment)).astype(np.float32)
            bias -= (0.02 * lr * p).astype(np.float32)
            if len(rows):
                g2 = part * part * float(back @ back) / DIM
                table_moment[rows] += g2
                table[rows] = vectors - (lr * part / np.sqrt(table_moment[rows]))[:, None] * back[None, :]
    return Model((table @ (w[:, 1] - w[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(__id, t, y): the rows that ``train`` learns from, whole texts of each class in the order of a hash of their id.

    Each class has up to ``sample_rows`` rows and half of ``sample_bytes``, one row at least, whatever its length. Rows of
    over ``row_bytes`` come after all others of their class: they give way to the next ones, and are learned from only
    where a class hasn't enough of those. An id counts once, with its shortest text and its least label. Never a held-out row.
    """
    known = labels.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__y")).filter(F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.min("__y").alias("__y"))
    texts = docs.select(F.col(f"`{key}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    sizes = texts.select("__id", F.octet_length("__t").alias("__n")).join(known, "__id").groupBy("__id").agg(F.min("__n").alias("__n"), F.first("__y").alias("__y"))
    order = [F.col("__n") > row_bytes, F.xxhash64("__id"), F.col("__id")]
    picks = [sizes.filter(F.col("__y") == y).orderBy(*order).limit(sample_rows) for y in (0, 1)]
    by = Window.partitionBy("__y").orderBy(*order)  # over 2 * sample_rows rows
    chosen = picks[0].unionByName(picks[1]).withColumn("__sum", F.sum("__n").over(by)).withColumn("__at", F.row_number().over(by))
    chosen = F.broadcast(chosen.filter((F.col("__sum") <= sample_bytes // 2) | (F.col("__at") == 1)).select("__id", "__y"))
    rows = texts.join(chosen, "__id").groupBy("__id").agg(F.min(F.struct(F.octet_length("__t").alias("n"), F.col("__t").alias("t"), F.col("__y").alias("y"))).alias("__r"))
    return rows.select("__id", "__r.t", "__r.y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, row_bytes: int = ROW_BYTES) -> Model:
    """Learns from the bounded ``sample``. One task gathers it and learns from it; what comes back to the driver is the model's fixed 1 MB."""
    rows = sample(docs, labels, label, key, text, sample_rows, sample_bytes, row_bytes)
    rows = rows.repartition(1).sortWithinPartitions(F.crc32(F.col("__id").cast("string")), "t").select("t", "y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
        m = fit(texts, ys)
        yield pa.RecordBatch.from_arrays([pa.array([m.rows.tobytes()], pa.binary()), pa.array([m.bias])], names=["rows", "bias"])

    got = rows.mapInArrow(learn, "rows binary, bias double").first()
    return fit([], []) if got is None else Model(np.frombuffer(got["rows"], np.float32), got["bias"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """Columns ``key``, those in ``keep``, and the score, named ``out``; the model travels as a broadcast of a fixed 1 MB."""
    shared = docs.sparkSession.sparkContext.broadcast((model.rows, model.bias))
    kept = [key, *(c for c in keep if c != key)]
    (out,) = fresh(kept, out)
    fields = {f.name: f.dataType for f in docs.schema}
    # columns travel by place, as their names may have dots
    schema = T.StructType([T.StructField(f"c{i}", fields[c]) for i, c in enumerate(kept)] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in slices(batches, 0, SLICE):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(m.score(b.column(0)))], names=schema.names)

    rows = docs.select(F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    return rows.mapInArrow(run, schema).toDF(*kept, out)
