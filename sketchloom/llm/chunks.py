"""Documents packed in chunks on shared storage, for operators that go over the texts several times.

A chunk is an Arrow stream of (id, text) rows, compressed, of 2 MB of text, up to 16 MB on large inputs, or one longer document. A small table
says where each chunk lies, so that later passes shuffle that table and per-chunk results, never texts. Only chunks that
successful tasks have reported are in the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.common import open_uri, shared_dir, slices, stored, tasks, text_bytes
from sketchloom.llm.text import spans

#: Bytes of text in a chunk: about a CHUNKS-th of the input within these bounds.
CHUNK, LARGEST, CHUNKS = 2 << 20, 16 << 20, 20_000
TABLE = "chunk long, path string, at long, size long, rows long, length long, words long"


class Packed(NamedTuple):
    """The table of chunks, the folder that they lie in, and how much text there is."""

    table: DataFrame
    root: str
    n_bytes: int
    n_words: int


def pack(docs: DataFrame, key: str, text: str, name: str, inside: np.ndarray) -> Packed:
    """Writes all rows; ``words`` counts runs of bytes that are ``inside``, and ``length`` all bytes of text."""
    root = shared_dir(docs.sparkSession, name)
    # what Spark knows of the input's size without reading it
    size_in_bytes = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    limit = min(LARGEST, max(CHUNK, size_in_bytes // CHUNKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_uri(root)
        system.create_dir(folder, recursive=True)
        path, at, rows = f"{folder}/{uuid.uuid4().hex}", 0, []
        held: list[pa.RecordBatch] = []
        size = 0
        with system.open_output_stream(path) as out:

            def put() -> None:
                nonlocal at, held, size
                if not held:
                    return
                t = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, names=["id", "text"]) for b in held]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(t)
                body = sink.getvalue()
                out.write(body)
                data, off = text_bytes(t.column(1))
                rows.append((uuid.uuid4().int >> 65, path, at, len(body), t.num_rows, len(data), len(spans(data, off, inside)[0])))
                at += len(body)
                held, size = [], 0

            for b in slices(batches, 1, limit):
                n = int(text_bytes(b.column(1))[1][-1])
                if size + n > limit:
                    put()
                held.append(b)
                size += n
            put()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["chunk", "path", "at", "size", "rows", "length", "words"])

    table = stored(docs.select(key, text).mapInArrow(run, TABLE), name + "-table")
    return Packed(table, root, *table.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("length", "words"))).first())


class Files:
    """Reads chunks. Paths are in the scheme-less form that ``pack`` has written."""

    def __init__(self, root: str) -> None:
        self.system = open_uri(root)[0]

    def read(self, path: str, at: int, size: int) -> pa.Table:
        with self.system.open_input_file(path) as f:
            return pa.ipc.open_stream(f.read_at(size, at)).read_all().combine_chunks()


def spread(table: DataFrame, packed: Packed) -> DataFrame:
    """Chunks dealt out evenly among tasks. Rows are small and the work behind them isn't: Spark must not put tasks together by bytes."""
    return table.repartition(tasks(table.sparkSession, packed.n_bytes), "path", "at")


def groups(packed: Packed, least: int = 3_000_000, most: int = 24_000_000, number: int = 4000) -> int:
    """Number of hash ranges for a shuffle of packed rows: several a task, and each with some ``least`` words, or more where there would be over ``number``.

    A range is held by one task, so that beyond ``most`` words a range their number grows with the input. A row holds a
    chunk's hashes of a range: with 16 MB chunks some hundred of them at a TB.
    """
    per_word = min(most, max(least, packed.n_words // number))
    return max(4 * int(packed.table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-packed.n_words // per_word))


def range_bounds(sorted_hashes: np.ndarray, p: int) -> np.ndarray:
    """Where each of ``p`` equal ranges of 64-bit hashes begins (p + 1 numbers)."""
    edges = [(i << 64) // p for i in range(1, p)]
    return np.concatenate([[0], np.searchsorted(sorted_hashes, np.array(edges, np.uint64)), [len(sorted_hashes)]])
