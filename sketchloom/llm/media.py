"""Media columns: payloads kept as images in archives, read back by a Spark data source of our own.

Each payload becomes a grey PNG, 64 samples of 8 bits wide, whose length before padding stands in a text chunk. Images
are members of tar archives, and next to each archive lies an index of its members' offsets. The reader plans byte
ranges over all archives, longer ones the more there is, so that their number stays bounded; the task of a range reads the members that begin in it, in spans of a few MB, and yields
Arrow batches. A member that can't be read or whose checks fail is read again on its own, from its offset.

Files are named at random by the task that writes them. Only those that a successful task has reported are listed in
the manifest, which is written when the whole write succeeds, so that lost or repeated tasks leave no trace in what is
read.

Defined cases: ids are whole numbers, else a TypeError; a NULL or empty text is 64 zero bytes with length 0; a NULL key stays NULL; repeated rows are members of
their own; an empty table makes an empty manifest. Equal texts have equal images.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sketchloom.llm.common import open_uri, qualified, shared_dir, slices, text_bytes, whole_ids

WIDTH, LEVEL = 64, 1
ARCHIVE_BYTES, RANGE_BYTES, SPAN_BYTES, BATCH_BYTES = 128 << 20, 8 << 20, 2 << 20, 2 << 20
#: Ranges that the driver plans at most, about: on large inputs they are longer than RANGE_BYTES.
RANGES = 50_000
SCHEMA = "key long, archive string, offset long, n_bytes long, media binary, payload binary, feature string, attempts int, error string"
_ARROW = pa.schema([("key", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("feature", pa.string()), ("attempts", pa.int32()), ("error", pa.string())])
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(raw: bytes) -> bytes:
    """PNG of the padded payload."""
    rows = np.frombuffer(pad(raw), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    return b"".join([_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), _chunk(b"tEXt", b"bytes\0%d" % len(raw)), _chunk(b"IDAT", zlib.compress(lines, LEVEL)), _chunk(b"IEND", b"")])


def decode(media: bytes) -> tuple[int, bytes]:
    """Length before padding, and the payload. ValueError if any check fails."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, n, data, height = 8, None, [], 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(media) < at + 12 + size or zlib.crc32(media[at + 4 : at + 8 + size]) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            _, height = struct.unpack_from(">II", body)
        elif kind == b"tEXt":
            n = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if n is None or len(lines) != height * (WIDTH + 1):
        raise ValueError("wrong size")
    return n, lines.reshape(height, WIDTH + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Lines, sum of the samples, and how many samples fall into each eighth of the range."""
    v = np.frombuffer(payload, np.uint8)
    return f"{len(v) // WIDTH};{int(v.sum(dtype=np.int64))};" + ",".join(map(str, np.bincount(v >> 5, minlength=8)))


def _header(name: bytes, size: int) -> bytes:
    """A ustar header."""
    head = bytearray(512)
    for at, field in ((0, name[:100]), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b"        "), (156, b"0"), (257, b"ustar\0"), (263, b"00")):
        head[at : at + len(field)] = field
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def parse_header(head: bytes) -> tuple[str, int]:
    if len(head) < 512 or head[257:262] != b"ustar" or int(head[148:154], 8) != sum(head) - sum(head[148:156]) + 8 * 32:
        raise ValueError("not a member")
    return head[:100].rstrip(b"\0").decode(), int(head[124:135], 8)


def member(read: Callable[[int, int], bytes], offset: int, retries: int, span: tuple[int, bytes] | None = None, wait: float = 0.05) -> tuple[int | None, bytes, int, bytes, int]:
    """Key, image, length, payload and attempts of the member at ``offset``: from ``span`` (its offset and bytes), else read anew."""
    for attempt in range(retries + 1):
        try:
            if span is not None and attempt == 0:
                local = offset - span[0]
                name, size = parse_header(span[1][local : local + 512])
                media = span[1][local + 512 : local + 512 + size]
                if len(media) < size:
                    raise ValueError("reaches beyond the span")
            else:
                name, size = parse_header(read(offset, 512))
                media = read(offset + 512, size)
            n, payload = decode(media)
            key = name.partition(".")[0]
            return None if key == "null" else int(key), media, n, payload, attempt + 1
        except (OSError, ValueError, struct.error, zlib.error):
            if attempt == retries:
                raise
            time.sleep(wait * attempt)
    raise AssertionError


@dataclass
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of an archive."""

    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list


class ArchiveWriter(DataSourceArrowWriter):
    """Input columns: key, text."""

    def __init__(self, path: str, limit: int) -> None:
        self.path, self.limit = path, limit

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_uri(self.path)
        system.create_dir(root, recursive=True)
        done, out, name, offsets, at = [], None, "", [], 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(bytes(1024))
                out.close()
                with system.open_output_stream(f"{root}/{name}.idx") as index:
                    index.write(np.array([*offsets, at], np.int64).tobytes())
                done.append([name, at])
                out = None

        for batch in slices(iterator):
            data, off = text_bytes(batch.column(1))
            raw = data.tobytes()
            for i, key in enumerate(batch.column(0).to_pylist()):
                if out is None:
                    name, offsets, at = f"{uuid.uuid4().hex}.tar", [], 0
                    out = system.open_output_stream(f"{root}/{name}")
                media = encode(raw[off[i] : off[i + 1]])
                offsets.append(at)
                out.write(_header(b"%s.png" % (b"null" if key is None else b"%d" % key), len(media)) + media + bytes(-len(media) % 512))
                at += 512 + len(media) + -len(media) % 512
                if at >= self.limit:
                    close()
        close()
        return Written(done)

    def commit(self, messages: list) -> None:
        system, root = open_uri(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            for m in messages:
                for name, size in m.archives if m else []:
                    out.write(json.dumps([name, size]).encode() + b"\n")

    def abort(self, messages: list) -> None:
        """Files of tasks that did succeed stay unlisted."""


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, options: dict) -> None:
        self.path = path
        self.range = int(options.get("rangebytes", RANGE_BYTES))
        self.retries, self.permissive = int(options.get("retries", 3)), options.get("mode", "failfast") == "permissive"

    def partitions(self) -> list[Range]:
        system, root = open_uri(self.path)
        found = []
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith("_manifest"):
                with system.open_input_stream(f.path) as s:
                    found += [json.loads(x) for x in s.read().splitlines()]
        step = max(self.range, -(-sum(size for _, size in found) // RANGES))
        return [Range(name, a, min(a + step, size)) for name, size in sorted(found) for a in range(0, size, step)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        system, root = open_uri(self.path)
        with system.open_input_file(f"{root}/{part.archive}.idx") as s:
            offsets = np.frombuffer(s.read(), np.int64)
        lo, hi = np.searchsorted(offsets[:-1], [part.start, part.end])
        with system.open_input_file(f"{root}/{part.archive}") as file:

            def read(at: int, n: int) -> bytes:
                return file.read_at(n, at)

            rows, held = [], 0
            at = lo
            while at < hi:
                end = max(at + 1, min(hi, int(np.searchsorted(offsets, offsets[at] + SPAN_BYTES)) - 1))
                try:
                    span = (int(offsets[at]), read(int(offsets[at]), int(offsets[end] - offsets[at])))
                except OSError:
                    span = None
                for o in offsets[at:end].tolist():
                    try:
                        key, media, n, payload, attempts = member(read, o, self.retries, span)
                        rows.append((key, part.archive, o, n, media, payload, feature(payload), attempts, None))
                        held += len(media) + len(payload)
                    except (OSError, ValueError, struct.error, zlib.error) as e:
                        if not self.permissive:
                            raise
                        rows.append((None, part.archive, o, None, None, None, None, self.retries + 1, str(e)))
                    if held > BATCH_BYTES or len(rows) >= 2000:
                        yield self._batch(rows)
                        rows, held = [], 0
                at = end
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class MediaArchive(DataSource):
    """Format ``media_archive``; options: path (with its scheme), rangeBytes, archiveBytes, retries, mode (failfast or permissive)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archivebytes", ARCHIVE_BYTES)))


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(whole_ids(docs, key).alias("key"), F.col(text).cast("string").alias("text")).write.format("media_archive").mode("append").save(qualified(docs.sparkSession, path))


def read(spark, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(qualified(spark, path))


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all texts as images to shared storage and reads them back (columns of ``SCHEMA``)."""
    path = shared_dir(docs.sparkSession, "media")
    write(docs, path, key, text)
    return read(docs.sparkSession, path)
