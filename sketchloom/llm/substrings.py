"""Substring dedup by level-wise doubling.

A window of 20 words can be a repeat only if both its halves are, and these only if both of theirs are. So windows of 5
words are looked at first; those that repeat alone are extended to 10 words, and those of these that repeat to 20. The
passes end when no candidate survives, or when the window asked for is reached.

At each level a chunk sends the distinct hashes of its candidates, sorted and packed in a few binary rows, to tasks by
hash range; what comes back is one bit for each: repeated or not. A window that very many documents share is sent once a
chunk. At the last level a window has a second hash, made from second hashes of its words that are independent of the
first; both bring the least (document, start) in their chunk, and the bit says whether that is the first of all that
agree in both.

Words covered by a window that isn't the first of its kind are removed; windows are judged on the input.

Defined cases: ids are whole numbers, else a TypeError; a NULL or empty text, or one of fewer words than the window, loses nothing; a NULL id comes before all
others; of rows that repeat an id, either may count as the earlier; long documents are taken whole; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.chunks import Files, Packed, groups, pack, range_bounds, spread
from sketchloom.llm.common import fresh, stored, text_bytes, whole_ids
from sketchloom.llm.text import MULTIPLIERS, WHITE, mix, spans, windows, word_hashes

WINDOW, FIRST = 20, 5
_U = np.uint64
_LEAST = -(1 << 63)


class Chunk:
    """A chunk's words, and the hashes of its windows of each level so far."""

    def __init__(self, table: pa.Table, first: int, window: int) -> None:
        self.ids = table.column(0)
        self.data, self.offsets = text_bytes(table.column(1))
        self.starts, self.stops, self.first = spans(self.data, self.offsets, WHITE)
        self.words = word_hashes(self.data, self.starts, self.stops)
        self.ends = np.repeat(self.first[1:], np.diff(self.first))  # of each word's document
        self.length, self.window = first, window
        self.hashes = windows(self.words, first)
        self.second: np.ndarray | None = None
        self.candidates = np.flatnonzero(np.arange(len(self.hashes)) + first <= self.ends[: len(self.hashes)])
        self._packed: tuple | None = None
        if first == window:
            self._last()

    def _last(self) -> None:
        self.second = windows(word_hashes(self.data, self.starts, self.stops, 1), self.window, 1)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct candidates' hashes in order, which one each candidate has, and how often each occurs. At the last level both hashes count."""
        if self._packed is None:
            h = self.hashes[self.candidates]
            keys = (h,) if self.second is None else (self.second[self.candidates], h)
            order = np.argsort(h) if self.second is None else np.lexsort(keys)
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
            inverse = np.empty(len(order), np.int64)
            inverse[order] = np.cumsum(new) - 1
            self._packed = h[order][new], inverse, np.bincount(inverse)
        return self._packed

    def double(self, repeated: np.ndarray) -> None:
        """Goes on to windows of twice the length. ``repeated``: for each distinct hash of ``packed``."""
        keep = np.zeros(len(self.hashes) + self.length, bool)
        keep[self.candidates[repeated[self.packed()[1]]]] = True
        n, half = max(0, len(self.words) - 2 * self.length + 1), self.length
        both = np.flatnonzero(keep[:n] & keep[half : half + n])
        self.candidates = both[both + 2 * half <= self.ends[both]]
        self.hashes = mix(self.hashes[:n] * MULTIPLIERS[7] + self.hashes[half : half + n] * MULTIPLIERS[8]) if n else np.empty(0, np.uint64)
        self.length, self._packed = 2 * half, None
        if self.length == self.window:
            self._last()


def _answers(rows, n_groups: int, distinct: np.ndarray) -> np.ndarray:
    """One flag for each distinct hash, from (group, bits) rows."""
    bounds = range_bounds(distinct, n_groups)
    out = np.zeros(len(distinct), bool)
    for g, bits in rows:
        a, b = bounds[g], bounds[g + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def _advance(chunk: Chunk, answers: list, n_groups: int) -> None:
    for level in answers:
        chunk.double(_answers(level, n_groups, chunk.packed()[0]))


def _low32(u: np.ndarray, g: int, n_groups: int) -> np.ndarray:
    """32 bits of hashes of a range, in the same order: candidates only need to be likely."""
    lo = (g << 64) // n_groups
    shift = max(0, (((1 << 64) // n_groups) + 1).bit_length() - 32)
    return ((u - _U(lo)) >> _U(shift)).astype(np.uint32)


def _ask(packed: Packed, n_groups: int, answers: list[DataFrame], first: int, window: int) -> DataFrame:
    """Rows (g, chunk, hashes, twice, ...) of all chunks at the level after ``answers``."""
    root, last = packed.root, first << len(answers) == window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(root)
        for b in batches:
            for chunk_id, path, at, size, *levels in zip(*(c.to_pylist() for c in b.columns)):
                c = Chunk(files.read(path, at, size), first, window)
                _advance(c, [[(r["g"], r["bits"]) for r in x or []] for x in levels], n_groups)
                u, inverse, counts = c.packed()
                if not len(u):
                    continue
                bounds = range_bounds(u, n_groups)
                if last:
                    at_first, second, doc, start = _firsts(c, inverse, len(u))
                out: dict[str, list] = {"g": [], "chunk": [], "hashes": [], "twice": [], "second": [], "doc": [], "start": []}
                for g in np.flatnonzero(np.diff(bounds)).tolist():
                    s = slice(bounds[g], bounds[g + 1])
                    out["g"].append(g)
                    out["chunk"].append(chunk_id)
                    out["hashes"].append((u[s] if last else _low32(u[s], g, n_groups)).tobytes())
                    out["twice"].append(np.packbits(counts[s] > 1).tobytes())
                    out["second"].append(second[s].tobytes() if last else None)
                    out["doc"].append(doc[s].tobytes() if last else None)
                    out["start"].append(start[s].tobytes() if last else None)
                t = {"g": pa.int32(), "chunk": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(v, t.get(k, pa.binary())) for k, v in out.items()], names=list(out))

    return _with(packed, answers).mapInArrow(run, "g int, chunk long, hashes binary, twice binary, second binary, doc binary, start binary")


def _with(packed: Packed, answers: list[DataFrame]) -> DataFrame:
    """The table of chunks with a column of (g, bits) for each level's answers."""
    table = packed.table.select("chunk", "path", "at", "size")
    for i, a in enumerate(answers):
        each = a.groupBy("chunk").agg(F.collect_list(F.struct("g", "bits")).alias(f"level{i}"))
        table = table.join(each, "chunk", "left")
    return spread(table, packed)


def _firsts(c: Chunk, inverse: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """For each distinct hash, its first occurrence in the chunk: candidate number, second hash, document id, start."""
    ids = np.array([_LEAST if x is None else x for x in c.ids.to_pylist()], np.int64)
    doc = np.searchsorted(c.first, c.candidates, side="right") - 1
    start = c.candidates - c.first[doc]
    order = np.lexsort((c.candidates, start, ids[doc], inverse))
    lead = np.ones(len(order), bool)
    lead[1:] = inverse[order][1:] != inverse[order][:-1]
    at = order[lead]
    return at, c.second[c.candidates[at]], ids[doc[at]], start[at].astype(np.int64)


def _bits(table: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    """Rows (g, chunk, bits) of those chunks of which any flag is set."""
    some = pa.array([bool(f.any()) for f in flags], pa.bool_())
    return pa.table({"g": table.column("g"), "chunk": table.column("chunk"), "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())}).filter(some)


def _cut(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(sizes)[:-1])


def _repeated(table: pa.Table) -> pa.Table:
    """Which hashes occur in two chunks, or twice in one."""
    parts = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("twice").to_pylist(), parts)]
    # within a chunk distinct hashes may be equal in 32 bits; that makes them candidates, no more
    flat = np.concatenate(parts)
    order = np.argsort(flat, kind="stable")
    v = flat[order]
    same = np.zeros(len(v), bool)
    eq = v[1:] == v[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    out = np.empty(len(v), bool)
    out[order] = same
    return _bits(table, _cut(out | np.concatenate(twice), [len(p) for p in parts]))


def _first_of_all(table: pa.Table) -> pa.Table:
    """Which chunk's first occurrence is the first of all."""
    get = lambda n, t: [np.frombuffer(x, t) for x in table.column(n).to_pylist()]
    parts = get("hashes", np.uint64)
    u, v, doc, start = (np.concatenate(x) for x in (parts, get("second", np.uint64), get("doc", np.int64), get("start", np.int64)))
    order = np.lexsort((start, doc, v, u))
    lead = np.ones(len(order), bool)
    lead[1:] = (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])
    out = np.empty(len(order), bool)
    out[order] = lead
    return _bits(table, _cut(out, [len(p) for p in parts]))


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False, window: int = WINDOW, first: int = FIRST, passes: list | None = None) -> DataFrame:
    """One row for each document: key, n_words, n_removed, kept_sha256, and with ``keep_text`` kept.

    Windows of ``first`` words are looked at first, and ``window`` is that times a power of two; what the passes return is
    appended to ``passes``, if given. Where the key is named like an output, that output's name gets underscores before it.
    """
    levels = (window // first).bit_length() if first > 0 else 0
    if levels < 1 or first << (levels - 1) != window:
        raise ValueError("window must be first times a power of two")
    packed = pack(docs.select(whole_ids(docs, key).alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", "substrings", WHITE)
    root, n_groups = packed.root, groups(packed)
    answers: list[DataFrame] = [] if passes is None else passes
    schema = "g int, chunk long, bits binary"

    def repeated(t: pa.Table) -> pa.Table:
        return _repeated(t)

    def first_of_all(t: pa.Table) -> pa.Table:
        return _first_of_all(t)

    while len(answers) < levels:
        last = len(answers) == levels - 1
        asked = _ask(packed, n_groups, answers, first, window)
        answers.append(stored(asked.groupBy("g").applyInArrow(first_of_all if last else repeated, schema), f"substrings-{first << len(answers)}"))
        if answers[-1].isEmpty():  # no candidates survive: nothing that is longer repeats
            break
    ended = len(answers) < levels or answers[-1].isEmpty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(root)
        for b in batches:
            for path, at, size, *found in zip(*(c.to_pylist() for c in b.columns[1:])):
                table = files.read(path, at, size)
                if ended:
                    yield _result(Untouched(table), np.empty(0, bool), keep_text)
                    continue
                c = Chunk(table, first, window)
                found = [[(r["g"], r["bits"]) for r in x or []] for x in found]
                _advance(c, found[:-1], n_groups)
                yield _result(c, _answers(found[-1], n_groups, c.packed()[0]), keep_text)

    out = _with(packed, [] if ended else answers).mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    out = out if keep_text else out.drop("kept")
    return out.toDF(key, *fresh([key], *out.columns[1:]))


class Untouched:
    """A chunk's words, where no window repeats."""

    candidates, length = np.empty(0, np.int64), 0

    def __init__(self, table: pa.Table) -> None:
        self.ids = table.column(0)
        self.data, self.offsets = text_bytes(table.column(1))
        self.words, _, self.first = spans(self.data, self.offsets, WHITE)

    def packed(self) -> tuple:
        return (), (), ()


def _result(c: Chunk | Untouched, first: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    _, inverse, _ = c.packed()
    edge = np.zeros(len(c.words) + 1, np.int64)
    if len(c.candidates):
        covered = np.ones(len(c.candidates), bool)
        covered[_firsts(c, inverse, len(first))[0][first]] = False
        at = c.candidates[covered]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + c.length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    raw, off = c.data.tobytes(), c.offsets
    removed = np.concatenate([[0], np.cumsum(gone)])[c.first]
    kept = []
    for i in range(len(off) - 1):
        words = raw[off[i] : off[i + 1]].split()
        if removed[i + 1] > removed[i]:
            words = [w for w, g in zip(words, gone[c.first[i] : c.first[i + 1]].tolist()) if not g]
        kept.append(b" ".join(words))
    n = pa.array(np.diff(c.first).astype(np.int64))
    return pa.RecordBatch.from_arrays([c.ids.combine_chunks() if isinstance(c.ids, pa.ChunkedArray) else c.ids, n, pa.array(np.diff(removed).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode() if keep_text else None for k in kept], pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])


ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) i FROM d),
k AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS win FROM t),
r AS (SELECT doc_id, i, x, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM k),
g AS (SELECT doc_id, i, x, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) gone FROM r),
s AS (SELECT doc_id, count(*) FILTER (gone) n, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') kept FROM g GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""
