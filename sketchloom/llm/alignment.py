"""Cross-tokenizer alignment by distinct segments.

Tokens of A (byte-level BPE) and B (SentencePiece BPE) of one text are cut into groups wherever tokens of both end at the
same byte. Texts are split before runs of white space first. Neither tokenizer merges across such a place: A's words end
there, and ``Splits`` checks in both vocabularies that no entry has the run's first character behind one that isn't white
space; characters that fail are not split at. So a text's tokens are those of its segments end to end.

1. Tasks cut texts into segments, write each document as numbers of the distinct segments of its chunk, and deal these
   segments, packed in compressed rows, to ranges of a hash.
2. A range's distinct segments, of all chunks, are encoded and aligned once, and each chunk's go back to it in one row.
3. Each chunk counts in how many of its documents an A-B pair is linked; the sums over all chunks are the pairs' counts.
4. Counts are joined back to chunks by the pair, and documents are composed from their segments.

A segment or a pair travels once for each chunk that has it, however often documents do. Ranges grow with the input, so
that rows stay long: by calculation 500 segments at 30 GB; beyond some 3 TB rows have few and packing gains little.

Defined cases: texts that are NULL or empty, or whose tokens don't join to space + text in A or B (B takes U+2581 for a
space), have no tokens: zeros and an empty ``groups``; repeated rows are documents of their own, each counted; ids may be
NULL and of any type; texts are taken whole; an empty table gives an empty result. Columns other than id and text are
ignored; where the id is named like an output, that output's name gets underscores before it. The input is read twice,
the first time for its size alone.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sketchloom.llm.common import discard, fresh, open_uri, shared_dir, slices, stored, tasks, text_bytes
from sketchloom.llm.text import byte_level

TOKENIZER_A, TOKENIZER_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text in a chunk (a longer document is one alone), segments encoded at a time, and segments of documents looked at at once.
CHUNK, SEGMENTS, WORK = 8 << 20, 20_000, 500_000
#: Bytes of text for each hash range, at least and at most, and ranges up to which it is the least.
LEAST, MOST, RANGES = 16 << 20, 128 << 20, 2000
#: Bytes after which nothing is split: white space, or what may end a white-space character of two or three bytes.
_SPACES = np.zeros(256, bool)
_SPACES[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


class Pair:
    """Both tokenizers, the bytes of their entries, and the characters before which texts may be split."""

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of, entries = byte_level(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            # the strings of special tokens are never produced, as they are plain text here
            self.bytes_a[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        normal = [p.replace("▁", " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.splits = [c for c in " \n\t" if self._safe(c, normal)]
        self.space = [pieces.index("▁")]
        self.size_a, self.size_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])

    def _safe(self, c: str, normal: list[str]) -> bool:
        """No entry of A or B has ``c`` behind something that isn't white space. B has other characters than space in no entry at all, so that the space that it adds stays alone."""
        def inside(entry: bytes) -> bool:
            return any(entry[i] == ord(c) and not _SPACES[entry[i - 1]] and entry[i - 1] < 0x80 or entry[i] == ord(c) and entry[i - 1] >= 0x80 and not _wide_space(entry[:i]) for i in range(1, len(entry)))

        if any(inside(e) for e in self.bytes_a) or any(inside(p.encode()) for p in normal):
            return False
        return c == " " or not any(c in p for p in normal)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments; each begins with one of ``splits``."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        # B adds a space: it is the first of those that begin with one, and a token of its own before others
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return a, [(self.space if s == " " else ids) if s[0] == " " else ids[1:] for s, ids in zip(segments, b)]


@lru_cache(maxsize=1)
def _loaded(a: bytes, b: bytes) -> Pair:
    """Loaded once by each worker, which works on many ranges."""
    return Pair(a, b)


def _wide_space(before: bytes) -> bool:
    """Whether bytes end in a white-space character beyond ASCII, or in one that shares its first bytes."""
    return before[-2:] in (b"\xc2\x85", b"\xc2\xa0") or before[-3:-2] == b"\xe1" or before[-3:-1] in (b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")


def split_places(data: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Where segments begin: at bytes of ``splits`` that follow a character which isn't white space, seen narrowly."""
    at = np.flatnonzero(splits[data])
    at = at[at > 0]
    p1 = data[at - 1]
    p2, p3 = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 == 0xE1) | (p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81)) | (p3 == 0xE3) & (p2 == 0x80)
    return at[~_SPACES[p1] & ~(wide & (p1 >= 0x80))]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), sizes


class Aligned(NamedTuple):
    """Alignments of segments: ok, and numbers of A's and B's tokens and groups of each; ids of A and of B; and tokens of A and of B in each group."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray

    def take(self, at: np.ndarray) -> Aligned:
        def some(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            n = sizes[at].astype(np.int64)
            begin = (np.cumsum(sizes, dtype=np.int64) - sizes)[at]
            return values[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

        return Aligned(self.ok[at], self.n_a[at], self.n_b[at], self.n_groups[at], some(self.a, self.n_a), some(self.b, self.n_b), some(self.in_a, self.n_groups), some(self.in_b, self.n_groups))


def joined(parts: list[Aligned]) -> Aligned:
    return Aligned(*(np.concatenate(x) for x in zip(*parts))) if parts else Aligned(*[np.empty(0, np.uint32)] * 8)


def align(pair: Pair, segments: list[bytes]) -> Aligned:
    """Where tokens don't join to the segment, ok is 0 and the rest empty."""
    a, b = pair.encode([s.decode() for s in segments])
    ok = np.array([b"".join([pair.bytes_a[i] for i in x]) == s and b"".join([pair.bytes_b[i] for i in y]) == s for s, x, y in zip(segments, a, b)], bool)
    for i in np.flatnonzero(~ok):
        a[i], b[i] = [], []
    (fa, na), (fb, nb) = _flat(a), _flat(b)
    # ends on one line through all segments, as tokens of both cover each of them
    ends_a, ends_b = np.cumsum(pair.size_a[fa]), np.cumsum(pair.size_b[fb])
    both = np.intersect1d(ends_a, ends_b)
    ga, gb = np.searchsorted(ends_a, both, side="right"), np.searchsorted(ends_b, both, side="right")
    groups = np.bincount(np.searchsorted(np.cumsum(na), ga), minlength=len(segments))[: len(segments)]
    return Aligned(*(x.astype(np.uint32) for x in (ok, na, nb, groups, fa, fb, np.diff(ga, prepend=0), np.diff(gb, prepend=0))))


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers, compressed; ``_spread`` gives them back."""
    sizes = np.array([len(arrays), *map(len, arrays)], np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([sizes.tobytes(), *(x.astype(np.uint32).tobytes() for x in arrays)]))


def _spread(body: bytes) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint32)
    n = int(flat[0])
    return np.split(flat[n + 1 :], np.cumsum(flat[1 : n + 1].astype(np.int64))[:-1])


def _bundle(segments: list[bytes]) -> bytes:
    sizes = np.array([len(segments), *map(len, segments)], np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(segments))


def _unbundle(body: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int.from_bytes(raw[:4], "little")
    ends = (4 * (n + 1) + np.cumsum(np.frombuffer(raw, np.uint32, n, 4))).tolist()
    return [raw[x:y] for x, y in zip([4 * (n + 1), *ends], ends)]


def _put(out, table: pa.Table) -> int:
    """Writes a table and returns its size."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    body = sink.getvalue()
    out.write(body)
    return len(body)


def _get(system, path: str, at: int, size: int) -> pa.Table:
    with system.open_input_file(path) as f:
        return pa.ipc.open_stream(f.read_at(size, at)).read_all().combine_chunks()


#: A row of a chunk's segments of one hash range, which are numbered from ``first`` on; and where the chunk's documents are.
ROWS = "chunk long, bucket int, first int, segments binary, path string, at long, size long"
BACK = "chunk long, first int, aligned binary, path string, at long, size long"


def _chunks(root: str, splits: str, buckets: int):
    """Rows as in ``ROWS``; a chunk without segments has one with bucket 0."""
    inside = np.zeros(256, bool)
    inside[[ord(c) for c in splits]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_uri(root)
        system.create_dir(folder, recursive=True)
        path, at = f"{folder}/{uuid.uuid4().hex}", 0
        with system.open_output_stream(path) as out:

            def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                nonlocal at
                seen: dict[bytes, int] = {}
                ids, index, sizes = [b.column(0) for b in held], [], []
                for b in held:
                    data, off = text_bytes(b.column(1))
                    raw = data.tobytes()
                    for x, y in zip(off[:-1].tolist(), off[1:].tolist()):
                        n = 0
                        if x < y:
                            text = b" " + raw[x:y]
                            places = split_places(np.frombuffer(text, np.uint8), inside)
                            begin, found = 0, np.empty(len(places) + 1, np.int32)
                            for lo in range(0, len(places), 1 << 16):
                                some = places[lo : lo + (1 << 16)].tolist()
                                found[lo : lo + len(some)] = [seen.setdefault(text[i:j], len(seen)) for i, j in zip([begin, *some], some)]
                                begin = some[-1]
                            found[-1] = seen.setdefault(text[begin:], len(seen))
                            index.append(found)
                            n = len(found)
                        sizes.append(n)
                segments = list(seen)
                del seen
                bucket = np.fromiter(map(zlib.crc32, segments), np.int64, len(segments)) % buckets
                order = np.argsort(bucket, kind="stable")
                number = np.empty(len(order), np.int32)
                number[order] = np.arange(len(order))  # segments are numbered by range
                flat = number[np.concatenate(index)] if index else np.empty(0, np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                table = pa.table({"id": pa.chunked_array(ids), "index": pa.ListArray.from_arrays(offsets, pa.array(flat))}).combine_chunks()
                size, name = _put(out, table), uuid.uuid4().int >> 65
                kinds, first = np.unique(bucket[order], return_index=True)
                if not len(kinds):
                    kinds, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
                ends, ranked = [*first[1:].tolist(), len(order)], order.tolist()
                rows = [_bundle([segments[i] for i in ranked[x:y]]) for x, y in zip(first.tolist(), ends)]
                n = len(rows)
                columns = [pa.array([name] * n, pa.int64()), pa.array(kinds.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(rows, pa.binary()), pa.array([path] * n), pa.array([at] * n, pa.int64()), pa.array([size] * n, pa.int64())]
                at += size
                return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "first", "segments", "path", "at", "size"])

            held, size = [], 0
            for b in slices(batches):
                n = int(text_bytes(b.column(1))[1][-1])
                if held and size + n > CHUNK:
                    yield chunk(held)
                    held, size = [], 0
                held.append(b)
                size += n
            if held:
                yield chunk(held)

    return run


def _encode(models):
    """Distinct segments of a range, once, and each chunk's alignments."""

    def run(rows: pa.Table) -> pa.Table:
        pair = _loaded(*models.value)
        seen: dict[bytes, int] = {}
        asked = [np.array([seen.setdefault(s, len(seen)) for s in _unbundle(b)], np.int64) for b in rows.column("segments").to_pylist()]
        segments = list(seen)
        del seen
        whole = joined([align(pair, segments[i : i + SEGMENTS]) for i in range(0, len(segments), SEGMENTS)])
        back = [_squeeze(*whole.take(x)) for x in asked]
        return pa.table({c: pa.array(back, pa.binary()) if c == "aligned" else rows.column(c) for c in ("chunk", "first", "aligned", "path", "at", "size")})

    return run


class Links:
    """Links of a chunk's distinct segments: the segment and the pair (A id << 32 | B id) of each."""

    def __init__(self, x: Aligned) -> None:
        self.ok = x.ok.astype(bool)
        na, nb = x.in_a.astype(np.int64), x.in_b.astype(np.int64)
        links = na * nb
        group = np.repeat(np.arange(len(na)), links)
        i = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
        at_a, at_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        self.pair = (x.a[at_a[group] + i // nb[group]].astype(np.int64) << 32) | x.b[at_b[group] + i % nb[group]]
        self.segment = np.repeat(np.repeat(np.arange(len(self.ok)), x.n_groups), links)

    def by_segment(self, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.segment, values, len(self.ok)).astype(np.int64)


def _documents(table: pa.Table, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all documents end to end, offsets into them, and which documents have tokens."""
    index = table.column("index").combine_chunks()
    flat, off = index.flatten().to_numpy().astype(np.int64), index.offsets.to_numpy().astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~ok[flat])])
    return flat, off, (np.diff(off) > 0) & (bad[off[1:]] == bad[off[:-1]])


def _pairs(links: Links, flat: np.ndarray, off: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and in how many documents each is linked. Documents are gone through some hundred thousand segments at a time."""
    n = len(links.ok)
    pairs, code = np.unique(links.pair, return_inverse=True)
    per = np.bincount(links.segment, minlength=n)
    begin = np.cumsum(per) - per
    total = np.zeros(len(pairs), np.int64)
    lo = 0
    while lo < len(live):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + WORK, side="right")) - 1)
        doc = np.repeat(np.arange(hi - lo), np.diff(off[lo : hi + 1]))
        keep = live[lo:hi][doc]
        doc, segment = np.divmod(np.unique(doc[keep] * max(n, 1) + flat[off[lo] : off[hi]][keep]), max(n, 1))
        count = per[segment]
        where = np.repeat(begin[segment] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        linked = np.unique(np.repeat(doc, count) * max(len(pairs), 1) + code[where])
        total += np.bincount(linked % max(len(pairs), 1), minlength=len(pairs))
        lo = hi
    return pairs[total > 0], total[total > 0]


def _count(root: str):
    """From a chunk's alignments, rows (chunk, pair, n), and one of the chunk with the places of its documents and alignments."""

    def run(rows: pa.Table) -> pa.Table:
        system, folder = open_uri(root)
        parts = sorted(zip(rows.column("first").to_pylist(), rows.column("aligned").to_pylist()))
        aligned = joined([Aligned(*_spread(x)) for _, x in parts])
        path, at, size = (rows.column(c)[0].as_py() for c in ("path", "at", "size"))
        links = Links(aligned)
        pairs, n = _pairs(links, *_documents(_get(system, path, at, size), links.ok))
        name = f"{folder}/{uuid.uuid4().hex}"
        with system.open_output_stream(name) as out:
            out.write(_squeeze(*aligned))
        none = [None] * len(pairs)
        head = lambda v, t: pa.array([v, *none], t)
        return pa.table({"chunk": pa.array([rows.column("chunk")[0].as_py()] * (len(pairs) + 1), pa.int64()), "pair": pa.array([None, *pairs.tolist()], pa.int64()), "n": pa.array([None, *n.tolist()], pa.int64()), "path": head(path, pa.string()), "at": head(at, pa.int64()), "size": head(size, pa.int64()), "aligned": head(name, pa.string())})

    return run


def _text(x: Aligned) -> pa.Array:
    """``a1,a2|b1;a3|b2`` of each segment."""
    def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), values)

    a, b = (pc.binary_join(lists(pa.array(ids).cast(pa.string()), n), ",") for ids, n in ((x.a, x.in_a), (x.b, x.in_b)))
    return pc.binary_join(lists(pc.binary_join_element_wise(a, b, "|"), x.n_groups), ";")


def _compose(root: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_uri(root)
        rows = pa.Table.from_batches(list(batches))
        counts = rows.filter(pc.is_valid(rows.column("pair"))).combine_chunks()
        (p,) = rows.filter(pc.is_null(rows.column("pair"))).to_pylist()
        with system.open_input_stream(p["aligned"]) as f:
            aligned = Aligned(*_spread(f.read()))
        links, table = Links(aligned), _get(system, p["path"], p["at"], p["size"])
        flat, off, live = _documents(table, links.ok)
        known = counts.column("pair").to_numpy()
        order = np.argsort(known)
        known = known[order]
        at = np.searchsorted(known, links.pair)
        shared = np.append(known, -1)[at] == links.pair  # pairs of documents without tokens alone have no count

        def of(name: str) -> np.ndarray:
            return np.where(shared, np.append(counts.column(name).to_numpy(zero_copy_only=False).astype(np.int64)[order], 0)[at], 0)

        sums = [aligned.n_a, aligned.n_b, aligned.n_groups, links.by_segment(), links.by_segment(of("best")), links.by_segment(of("df"))]
        totals = []
        for s in sums:
            c = np.concatenate([[0], np.cumsum(s.astype(np.int64)[flat])])
            totals.append(np.where(live, c[off[1:]] - c[off[:-1]], 0))
        ids, forms, lo = table.column("id").combine_chunks(), _text(aligned), 0
        del links, c
        while lo < len(live):  # some hundred thousand segments at a time
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + WORK, side="right")) - 1)
            some = pa.ListArray.from_arrays(pa.array((off[lo : hi + 1] - off[lo]).astype(np.int32)), forms.take(pa.array(flat[off[lo] : off[hi]])))
            text = pc.if_else(pa.array(live[lo:hi]), pc.binary_join(some, ";"), "")
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(t[lo:hi]) for t in totals), text], schema=schema)
            lo = hi

    return run


def cross_align(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """One row for each document: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A, then of B, of each group. A pair's count is the number of documents that
    have it linked; n_best counts links whose count is the highest of their A id, and count_sum adds up all links' counts.
    """
    spark = docs.sparkSession
    models = Path(tokenizer_a).read_bytes(), Path(tokenizer_b).read_bytes()
    shared = spark.sparkContext.broadcast(models)  # fixed files of 2 MB together
    splits = "".join(Pair(*models).splits)
    root = shared_dir(spark, "alignment")
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // min(MOST, max(LEAST, size // RANGES))))
    found = stored(rows.mapInArrow(_chunks(root, splits, buckets), ROWS), "alignment-segments")
    back = found.groupBy("bucket").applyInArrow(_encode(shared), BACK)
    n = tasks(spark, size)  # groups are few bytes for much work: Spark must not put them together by size
    counted = stored(back.repartition(n, "chunk").groupBy("chunk").applyInArrow(_count(root), "chunk long, pair long, n long, path string, at long, size long, aligned string"), "alignment-pairs")
    discard(found)
    pairs = counted.filter("pair IS NOT NULL").select("chunk", "pair", "n")
    df = stored(pairs.groupBy("pair").agg(F.sum("n").alias("df")), "alignment-counts")
    top = df.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("df").alias("top"))
    df = df.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "df", (F.col("df") == F.col("top")).alias("best"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("at", "long"), ("size", "long"), ("aligned", "string"))]
    known = pairs.join(df, "pair").select("chunk", "pair", "df", "best", *none)
    heads = counted.filter("pair IS NULL").select("chunk", "pair", F.lit(None).cast("long").alias("df"), F.lit(None).cast("boolean").alias("best"), "path", "at", "size", "aligned")
    names = fresh([key], "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    schema = pa.schema([("id", to_arrow_type(kind)), *((n, pa.int64()) for n in names[:-1]), (names[-1], pa.string())])
    out = known.unionByName(heads).repartition(n, "chunk").groupBy("chunk").applyInArrow(_compose(root, schema), f"id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names[:-1]) + f", {names[-1]} string")
    return out.withColumnRenamed("id", key)
