"""Best-fit packing: best-two-fit over the histogram of lengths.

A document's tokens and an end token make pieces of at most ``size`` tokens; only longer documents are cut. Sequences are
filled greedily, each with the longest pieces that still fit; then the shortest piece of a sequence is given up for two
unpacked ones whose sum is larger and fits into the gap that this leaves, the largest such sum.

Which of several pieces of one length goes where makes no difference, so that all decisions are taken on the number of
pieces of each length, at most ``size`` numbers whatever the input: a sequence's lengths are a pattern, which is used as
often as pieces last. A piece finds its sequence and place by its rank among the pieces of its length, which is its rank
in the task that made it plus the number of such pieces of earlier tasks. So the result is that of one packer that sees
all documents, and no task sees more than its own.

The tokenizer drops white space and looks at nothing across it, nor does it from a letter or digit to ASCII punctuation and
back, but for what follows an apostrophe, nor from a digit to the next. So texts are cut at all these places, and the units
between them, in small letters, are encoded once for each task, by the hundred thousand; texts are put together from
those. Units of Latin letters alone go to the tokenizer's merges directly. Texts with ``<|``, which may begin a special
token, are encoded by themselves.

Defined cases: a NULL or empty text, or one of white space only, is the end token alone; repeated rows, NULL ids and ids
of any type are each a document of their own; an empty table gives an empty result; texts are taken whole. Columns other
than id and text are ignored; where the id is named like an output, that output's name gets underscores before it.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sketchloom.llm.common import fresh, slices, stored, text_bytes
from sketchloom.llm.text import LOWER, byte_level

SIZE, END = 4096, 1
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: Units whose ids a task keeps, and their bytes, before it begins anew.
UNITS, UNIT_BYTES = 400_000, 32 << 20
_ALNUM, _DIGIT, _PUNCT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True
_PUNCT[0x21:0x7F] = ~_ALNUM[0x21:0x7F]
_BEFORE = _PUNCT.copy()
_BEFORE[0x27] = False  # 's and the like are one word of the tokenizer


#: Letters of which normalising changes nothing but their size, so that a unit of them is one word to be merged.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The character that stands for each byte in a byte-level vocabulary.
_BYTES = {b: c for c, b in byte_level().items()}


def units(text: bytes) -> list[bytes]:
    """What the tokenizer takes by itself."""
    if not text:
        return []
    data = LOWER[np.frombuffer(text, np.uint8)]
    x, y = data[:-1], data[1:]
    cut = np.flatnonzero(_ALNUM[x] & (_PUNCT[y] | _DIGIT[y]) | (_BEFORE[x] | _DIGIT[x]) & _ALNUM[y]) + 1
    return np.insert(data, cut, 0x20).tobytes().split()


class Encoder:
    """Ids of texts by way of their distinct units."""

    def __init__(self, vocabulary: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.model = self.tokenizer.model  # merges alone
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        encoded: list[list[int]] = []
        rest = []
        for w in new:
            text = w.decode()
            if _PLAIN.fullmatch(text):
                encoded.append([t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(_BYTES))])
            else:
                rest.append(len(encoded))
                encoded.append([])
        for i, e in zip(rest, self.tokenizer.encode_batch([new[i].decode() for i in rest], add_special_tokens=False)):
            encoded[i] = e.ids
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.starts, self.sizes = np.concatenate([self.starts, begin]), np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter((i for e in encoded for i in e), np.uint32, int(sizes.sum()))])
        self.held += sum(map(len, new))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and len + 1 offsets into them."""
        if len(self.known) > UNITS or self.held > UNIT_BYTES:
            self._clear()
        each = [[t] if b"<|" in t else units(t) for t in texts]
        new = list(set().union(*each).difference(self.known))
        if new:
            self._learn(new)
        known = self.known
        at = np.fromiter((known[u] for us in each for u in us), np.int64)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(us) for us in each])])]


def _pieces(vocabulary, size: int, end: int, schema: pa.Schema):
    """Rows (key, piece, start, length, ids, part, rank): rank is among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder(vocabulary.value), uuid.uuid4().int >> 65, np.zeros(size + 1, np.int64)
        for b in slices(batches):
            data, off = text_bytes(b.column(1))
            raw = data.tobytes()
            ids, at = encoder.encode([raw[x:y] for x, y in zip(off[:-1], off[1:])])
            n = np.diff(at) + 1
            ids = np.insert(ids, at[1:], end).astype("<u4")
            count = -(-n // size)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * size
            length = np.minimum(n[doc] - start, size)
            order = np.argsort(length, kind="stable")
            runs = np.flatnonzero(np.diff(length[order], prepend=-1))
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(runs, np.diff(np.append(runs, len(doc))))
            rank += seen[length]
            seen += np.bincount(length, minlength=size + 1)
            ends = np.concatenate([[0], np.cumsum(length)]) * 4  # pieces lie end to end, as documents do
            # binary offsets are 32 bits: a batch has up to 1 MB of text, or one longer document
            body = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            columns = [b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), body, pa.array(np.full(len(doc), part, np.int64)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


class Plan(NamedTuple):
    """Rows sorted by (length, rank from which on): sequence from which on, pieces a sequence, offset of the first; and number of sequences."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths and ranks."""
        key = np.rec.fromarrays([self.length, self.rank], names="l,r")
        at = np.searchsorted(key, np.rec.fromarrays([length, rank], names="l,r").astype(key.dtype), side="right") - 1
        more, slot = np.divmod(rank - self.rank[at], self.each[at])
        return self.sequence[at] + more, self.offset[at] + slot * length


def best_two_fit(counts: np.ndarray, size: int) -> Plan:
    """``counts[l]`` pieces of length l. A pattern ends when a length has no more pieces for it, so that there are at most some ``size * log(size)`` of them."""
    left = counts.astype(np.int64).copy()
    used = np.zeros(size + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    while left.any():
        have = np.flatnonzero(left)
        gap, at, pattern, whole = size, len(have), {}, True
        while gap and (at := int(np.searchsorted(have[:at], gap, side="right"))):
            long = int(have[at - 1])
            n = min(int(left[long]), gap // long)
            whole &= n == gap // long
            pattern[long] = n
            gap -= n * long
            at -= 1
        taken = dict(pattern)  # at any moment, for how often the same choices can be made again
        if gap and sum(pattern.values()) > 1:
            short = min(pattern)
            room, rest = gap + short, left.copy()
            for long, n in pattern.items():
                rest[long] -= n
            have = np.flatnonzero(rest[: room + 1])
            at = np.searchsorted(have, room - have, side="right") - 1
            twin = (at >= 0) & (have[at] == have) & (rest[have] < 2)  # the pair needs two of one length
            at -= twin
            sums = np.where(at >= 0, have + have[at], 0)
            if len(sums) and sums.max() > short:
                a = int(sums.argmax())
                pattern[short] -= 1
                for long in (int(have[a]), int(have[at[a]])):
                    pattern[long] = pattern.get(long, 0) + 1
                    taken[long] = taken.get(long, 0) + 1
        times = 1
        if whole:
            times += min((int(left[long]) - taken[long]) // pattern[long] for long in pattern if pattern[long])
        offset = 0
        for long in sorted(pattern, reverse=True):
            if n := pattern[long]:
                rows.append((long, int(used[long]), sequences, n, offset))
                offset += n * long
                used[long] += n * times
                left[long] -= n * times
        sequences += times
    rows.sort()
    return Plan(*(np.array([r[i] for r in rows], np.int64) for i in range(5)), sequences)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each piece: key, piece, start (tokens before it), length, ids, sequence_id and offset.

    ``ids`` holds little-endian unsigned 32-bit numbers. ``sequences`` puts sequences together.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())  # a fixed file of 2 MB
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length")] + [T.StructField("ids", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in ("part", "rank")])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(vocabulary, size, end, arrow), schema), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(best_two_fit(histogram, size))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in plan.value.place(length.to_numpy(), rank.to_numpy())], names=["sequence_id", "offset"])

    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("part", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    placed = pieces.join(before, ["part", "length"]).withColumn("at", place(F.col("length"), F.col("rank") + F.col("before")))
    names = fresh([key], "piece", "start", "length", "ids", "sequence_id", "offset")
    columns = ["piece", "start", "length", "ids", "at.sequence_id", "at.offset"]
    return placed.select(F.col("key").alias(key), *(F.col(c).alias(n) for c, n in zip(columns, names)))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of whole sequences: each is a group of at most ``size`` tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return whole.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
