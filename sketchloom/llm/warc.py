"""WARC: writing with revisit records, and reading by boundary chains.

Reading takes no index. Archives are cut into byte ranges; the task of a range finds each place where the magic stands
and a header can be parsed, be it a record or bytes inside a payload, and emits the candidate's offset, its successor
(offset + header + block + 4) and where its chain of successors leaves the range. Pointer jumping over these exits, from
offset 0 of each file, finds in rounds that double their reach in which offset each range is entered by the true chain. What isn't
reachable from a file's start is never read as a record, so that magic inside payloads is rejected.

Bodies that get smaller by it are stored with Content-Encoding: deflate, but for a share, picked by digest, that is stored
as it is; lengths and digests are of the full payload.

Defined cases: a NULL payload is empty; a NULL page id never refers or is referred to before others, and stays NULL; rows
that repeat the largest page id of a group of equal payloads are responses both; a NULL URL is empty and control
characters in one are percent-encoded; one of over half a MB stands in the record's block; ids are whole numbers, else a
TypeError; an empty table makes no archive and no records. Damage fails the query, or with mode ``permissive`` makes a row
of type ``damaged`` that says where in ``error``: after a damaged header the rest of its file can't be reached, after a
damaged payload it can.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm.common import discard, open_uri, qualified, shared_dir, slices, stored, tasks, text_bytes, whole_ids

MAGIC = b"WARC/1.1\r\n"
ARCHIVE_BYTES, RANGE_BYTES, HEADER_BYTES = 128 << 20, 8 << 20, 1 << 20
MIN_REVISIT = 1000
#: Share of payloads that are never compressed, so that what reads an archive meets payloads as they are.
PLAIN_SHARE = 0.125
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.I)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, compress: bool = True) -> bytes:
    """One record: a response, or with ``refers_to`` a revisit without the payload."""
    name = b"null" if page_id is None else b"%d" % page_id
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    target = quote(url or "", safe="!#$&'()*+,/:;=?@[]~%").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: %d\r\n" % len(payload)
    if len(target) > HEADER_BYTES // 2:  # too long for a record's header, not for its block
        http += b"X-Target-URI: " + target + b"\r\n"
        target = b"urn:x-sha256:" + hashlib.sha256(target).hexdigest().encode()
    body = b""
    if refers_to is None:
        compress = compress and hashlib.sha1(payload).digest()[0] >= PLAIN_SHARE * 256
        body = zlib.compress(payload, 1) if compress else payload
        if compress and len(body) < len(payload):
            http += b"Content-Encoding: deflate\r\n"
        else:
            body = payload
    block = http + b"Content-Length: %d\r\n\r\n" % len(body) + body
    lines = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:x-page:%s>" % name, b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Target-URI: " + target, b"WARC-Payload-Digest: sha1:" + digest]
    if refers_to is not None:
        lines += [b"WARC-Profile: " + _PROFILE, b"WARC-Refers-To: <urn:x-page:%d>" % refers_to]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return MAGIC + b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def header(data: bytes, at: int) -> tuple[int, int] | None:
    """Start of the block and the successor's offset of a record header at ``at``; None if there is no whole header."""
    if not data.startswith(MAGIC, at):
        return None
    end = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if end < 0:
        return None
    size = _LENGTH.search(data, at, end + 2)
    if size is None:
        return None
    return end + 4, end + 4 + int(size[1]) + 4


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """(__id, __h, __ref): distinct rows that repeat the payload of a row with a larger id, which is __ref.

    Only ids and hashes are shuffled, made distinct first. A payload that very many pages have is counted by partial
    aggregates; its pages come to the join by a shuffle of their own and leave it for storage, so that Spark is free to
    split them among tasks as a skewed join.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    light = pages.filter(F.octet_length(body) >= least).select(F.col(key).alias("__id"), F.sha2(body, 256).alias("__h"))
    light = stored(light.groupBy("__id", "__h").agg(F.count("*").alias("__n")), "warc-payloads")
    best = light.groupBy("__h").agg(F.max("__id").alias("__ref"), F.sum("__n").alias("__all")).filter("__all > 1 AND __ref IS NOT NULL")
    best = stored(best.select("__h", "__ref"), "warc-largest")
    pairs = light.join(best.hint("merge"), "__h").filter(F.col("__id").isNull() | (F.col("__id") < F.col("__ref")))
    return pairs.select("__id", "__h", "__ref")


def write(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url", least: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES, compress: bool = True) -> DataFrame:
    """Writes archives below ``path`` and returns the manifest (name, size), which lists those of successful tasks only."""
    path = qualified(pages.sparkSession, path)
    marks = stored(revisits(pages, key, payload, least), "warc-revisits")
    rows = pages.select(whole_ids(pages, key).alias("__k"), F.col(payload).cast("string").alias("__p"), F.col(url).cast("string").alias("__u"))
    rows = rows.withColumn("__hash", F.sha2(F.coalesce("__p", F.lit("")), 256))
    on = rows["__k"].eqNullSafe(marks["__id"]) & (rows["__hash"] == marks["__h"])
    rows = rows.join(marks.hint("merge"), on, "left").select("__k", "__p", "__u", F.col("__ref").cast("long").alias("__ref"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_uri(path)
        system.create_dir(root, recursive=True)
        out, name, size = None, "", 0
        for b in slices(batches):
            data, off = text_bytes(b.column(1))
            raw = data.tobytes()
            for i, (k, u, ref) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 3)))):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc", 0
                    out = system.open_output_stream(f"{root}/{name}")
                r = record(k, u, raw[off[i] : off[i + 1]], ref, compress)
                out.write(r)
                size += len(r)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"name": [name], "size": pa.array([size], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "size": pa.array([size], pa.int64())})

    return stored(rows.mapInArrow(run, "name string, size long"), "warc-manifest")


def _ranges(manifest: DataFrame, size: int) -> DataFrame:
    rows = manifest.filter("size > 0").select("name", "size", F.explode(F.sequence(F.lit(0), F.expr(f"(size - 1) div {size}"))).alias("r"))
    total = manifest.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return rows.repartition(tasks(manifest.sparkSession, total), "name", "r")


def candidates(manifest: DataFrame, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(name, off, succ, leave): each candidate record, its successor, and where its chain leaves the range or breaks off (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_uri(path)
        for b in batches:
            for name, size, r in zip(*(c.to_pylist() for c in b.columns)):
                lo, hi = r * range_bytes, min(size, (r + 1) * range_bytes)
                with system.open_input_file(f"{root}/{name}") as f:
                    data = f.read_at(min(size, hi + HEADER_BYTES) - lo, lo)
                succ: dict[int, int] = {}
                at = data.find(MAGIC)
                while 0 <= at < hi - lo:
                    h = header(data, at)
                    if h is not None:
                        succ[lo + at] = lo + h[1]
                    at = data.find(MAGIC, at + 1)
                leave: dict[int, int] = {}
                for o in sorted(succ, reverse=True):  # successors lie ahead, so that theirs is known
                    s = succ[o]
                    leave[o] = s if s >= hi else leave.get(s, -1)
                if succ:
                    offs = list(succ)
                    yield pa.RecordBatch.from_pydict({"name": [name] * len(offs), "off": pa.array(offs, pa.int64()), "succ": pa.array(succ.values(), pa.int64()), "leave": pa.array([leave[o] for o in offs], pa.int64())})

    return _ranges(manifest, range_bytes).mapInArrow(run, "name string, off long, succ long, leave long")


def entries(cands: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, off): where the true chain of each file enters its ranges, by pointer jumping from offset 0, which counts as reached whatever stands there."""
    jump = cands.filter("leave >= 0").select("name", "off", "leave")
    reached = stored(manifest.filter("size > 0").select("name", F.lit(0).cast("long").alias("off")).distinct(), "warc-reached")
    while True:
        more = reached.join(jump, ["name", "off"]).select("name", F.col("leave").alias("off")).join(cands.select("name", "off"), ["name", "off"], "left_semi")
        more = stored(more.join(reached, ["name", "off"], "left_anti").distinct(), "warc-more")
        if more.isEmpty():
            return reached
        ahead = jump.select("name", F.col("off").alias("leave"), F.col("leave").alias("__far"))
        old = reached, more, jump
        reached = stored(reached.unionByName(more), "warc-reached")
        jump = stored(jump.join(ahead, ["name", "leave"]).select("name", "off", F.col("__far").alias("leave")), "warc-jump")
        discard(*old)


def parse(raw: bytes, block_at: int, at: int, end: int) -> dict:
    """Fields of the record from ``at`` to ``end``. ValueError if the payload of a response doesn't have the digest it should."""
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in raw[at + len(MAGIC) : block_at].split(b"\r\n") if x)}
    http, _, body = raw[block_at : end - 4].partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    kind = head[b"warc-type"].decode()
    digest = base64.b32decode(head[b"warc-payload-digest"].rpartition(b":")[2])
    if fields.get(b"content-encoding") == b"deflate":
        body = zlib.decompress(body)
    if kind == "response" and hashlib.sha1(body).digest() != digest:
        raise ValueError(f"damaged payload of {head[b'warc-record-id']!r}")
    page = head[b"warc-record-id"][len(b"<urn:x-page:") : -1]
    refers = head.get(b"warc-refers-to")
    return {"page_id": None if page == b"null" else int(page), "url": fields.get(b"x-target-uri", head[b"warc-target-uri"]).decode(), "payload_bytes": int(fields.get(b"x-payload-length", len(body))), "payload_digest": digest.hex(), "record_type": kind, "refers_to": int(refers[len(b"<urn:x-page:") : -1]) if refers else None, "error": None, "payload": body if kind == "response" else None}


_TYPES = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "error": pa.string(), "payload": pa.binary()}


def read(spark: SparkSession, path: str, manifest: DataFrame, payload: bool = True, range_bytes: int = RANGE_BYTES, mode: str = "failfast") -> DataFrame:
    """Records that are reachable from their file's start. Without ``payload`` that column is left out.

    Revisit records give the length and digest that their response has; their payload is NULL. ``mode`` is ``failfast`` or
    ``permissive``, as above.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError("mode is 'failfast' or 'permissive'")
    path = qualified(spark, path)
    cands = stored(candidates(manifest, path, range_bytes), "warc-candidates")
    names = [n for n in _TYPES if payload or n != "payload"]
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}

    def damaged(what: str) -> dict:
        if mode == "failfast":
            raise ValueError(what)
        return dict.fromkeys(_TYPES) | {"record_type": "damaged", "error": what}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_uri(path)
        for b in batches:
            for name, off in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with system.open_input_file(f"{root}/{name}") as f:
                    size, hi, rows, held = f.size(), (off // range_bytes + 1) * range_bytes, [], 0
                    lo, data = off, f.read_at(min(size, hi + HEADER_BYTES) - off, off)
                    while off < min(size, hi):
                        h = header(data, off - lo)
                        if h is None or lo + h[1] > size:
                            rows.append(damaged(f"{name}: no whole record at {off}"))
                            break
                        block, end = h
                        if end > len(data):  # the record runs on beyond the range
                            lo, data = off, f.read_at(lo + end - off, off)
                            block, end = header(data, 0)
                        try:
                            rows.append(parse(data, block, off - lo, end))
                        except Exception as e:  # whatever the bytes make a parser of base64, deflate or numbers raise
                            rows.append(damaged(f"{name}: {e!r} in the record at {off}"))
                        held += rows[-1]["payload_bytes"] or 0
                        off = lo + end
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield _batch(rows, names)
                            rows, held = [], 0
                        if off - lo > len(data) - HEADER_BYTES and off < min(size, hi):
                            lo, data = off, f.read_at(min(size, hi + HEADER_BYTES) - off, off)
                    else:
                        # the next range is entered here, unless no record is
                        if off < size:
                            near = off - lo < len(data) and header(data, off - lo)
                            if not near and header(f.read_at(min(size - off, HEADER_BYTES), off), 0) is None:
                                rows.append(damaged(f"{name}: no whole record at {off}"))
                    if rows:
                        yield _batch(rows, names)

    total = manifest.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    spread = entries(cands, manifest).repartition(tasks(spark, total), "name", "off")
    return spread.mapInArrow(run, ", ".join(f"{n} {kinds[_TYPES[n]]}" for n in names))


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _TYPES[n]) for n in names], names=names)


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", keep_payload: bool = False) -> DataFrame:
    """Writes all pages to shared storage and reads the records back."""
    path = shared_dir(pages.sparkSession, "warc")
    return read(pages.sparkSession, path, write(pages, path, key, payload, url), keep_payload)


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), m AS (SELECT h, max(page_id) r FROM p WHERE strlen(h) >= 1000 GROUP BY 1)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN r > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN r > page_id THEN r END AS refers_to
FROM p LEFT JOIN m ON m.h = p.h"""
