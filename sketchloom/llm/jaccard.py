"""N-gram Jaccard join by partitions of the token universe.

Sets of shingles fall into size bands, so narrow that similar sets are in one band or in neighbouring ones. For a band
whose pairs can differ in up to H shingles, shingles are hashed into H + 1 segments. A set is indexed by each segment's
subset, and for a few segments also by its one-deletion neighbourhood (each subset that lacks one element). It probes
with an allocation over the segments: -1 leaves a segment out, 0 asks for an equal subset, 1 also for one that differs
by an element. If the sum of allocation + 1 is above the H of its own size, no partner of its size or less can be missed
(pigeonhole). What the deletion neighbourhoods and the set's own size leave over is spent on leaving out the costliest
segments: those with the fewest shingles, whose subsets are the most common.

Equal signatures make a bucket. Within a bucket only pairs with one probing member, its pivot, are verified at first;
signatures are bucketed within each task before they are shuffled, so that a bucket that very many documents fall into
sends one row a task. Pairs are verified exactly, on the shingles of whole texts. Where the verified links leave a
bucket in several components and pairs of a probing member with one of another component are many, rounds compare its
members with further pivots, which grows components at a cost that is linear in the bucket, for as long as that finds
links; then all of these pairs that remain are compared, each probing member with the others, once: components are exact,
pairs that are connected already are never looked at, and neither are those of two members that don't probe.

Texts with equal sets are one class and count as linked without verification. Sets are equal if their sizes and two sums
of independent shingle hashes are; verification compares shingles by two independent hashes, too.

Defined cases: ids are whole numbers, else a TypeError; a NULL or empty text has no shingles and is linked with nothing; a text with fewer words than a shingle
has one, of all its words; a NULL id is never linked, and its component is NULL; rows that share an id are one document, which has
the links of all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.chunks import range_bounds
from sketchloom.llm.common import discard, slices, stored, text_bytes, whole_ids
from sketchloom.llm.components import components
from sketchloom.llm.text import MULTIPLIERS, mix, shingle_sets

_U = np.uint64
#: Bounds on the signatures that a task gathers before it sends them on, and on the shingles whose signatures make a hash range, about.
#: Both are a RANGES-th of all shingles in between, so that what a task sends to a range stays long enough to be packed.
FLUSH, RANGE, RANGES = (1_500_000, 4_000_000), (2_000_000, 8_000_000), 20_000
#: 64-bit words of a set's parity bitmap.
BITMAP = 8
#: Further pivots that each bucket's members are compared with, before all pairs across components are; and of the latter how many for each
#: member are cheaper than a first round, which spares comparisons of texts, and as comparisons of sizes and bitmaps than another.
PIVOTS, AT_ONCE, PER_MEMBER = 4, 8, 2000


class Scheme:
    """Size bands for a threshold in hundredths, and the numbers of segments of each."""

    def __init__(self, percent: int, largest: int = 1 << 26) -> None:
        self.percent = percent
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, -(-100 * low[-1] // percent)))
        self.low = np.array(low, np.int64)
        high = self.low[1:] - 1
        self.h = self.apart(2 * high)
        self.m = self.h + 1
        self.d = np.where(self.h > 0, np.minimum(self.m, 1 + np.ceil(1.5 * self.m * np.exp(-high / self.m))), 0).astype(np.int64)

    def apart(self, both: np.ndarray) -> np.ndarray:
        """Shingles in which two linked sets can differ at most, given the sum of their sizes."""
        return both * (100 - self.percent) // (100 + self.percent)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1


def signatures(s: Scheme, value: np.ndarray, offsets: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the set each is of, and whether it probes. ``ahead``: 1 for the next band's segments, without probes."""
    n = np.diff(offsets)
    band = s.band(np.maximum(n, 1)) + ahead
    live = (n > 0) & (s.h[band] > 0)
    m, d = np.where(live, s.m[band], 0), np.where(live, s.d[band], 0)
    base = np.concatenate([[0], np.cumsum(m)])
    doc = np.repeat(np.arange(len(n)), n)
    if not live.all():
        keep = live[doc]
        value, doc = value[keep], doc[keep]
    seg = ((value >> _U(32)) * m[doc].astype(np.uint64) >> _U(32)).astype(np.int64)
    key = base[doc] + seg
    token = mix(value * MULTIPLIERS[20])
    total = np.zeros(base[-1], np.uint64)
    np.add.at(total, key, token)
    count = np.bincount(key, minlength=base[-1])
    owner = np.repeat(np.arange(len(n)), m)
    number = np.arange(base[-1]) - base[owner]
    place = mix((band[owner].astype(np.uint64) << _U(40)) + number.astype(np.uint64))
    exact = mix(total + place + count.astype(np.uint64) * MULTIPLIERS[21])
    deleting = number < d[owner]
    at = np.flatnonzero(deleting[key])
    less = mix(total[key[at]] - token[at] + place[key[at]] + (count[key[at]] - 1).astype(np.uint64) * MULTIPLIERS[21])
    if ahead:
        return np.concatenate([exact, less]), np.concatenate([owner, doc[at]]), np.zeros(len(exact) + len(at), bool)
    spare = m + d - (s.apart(2 * n) + 1)
    probe = np.ones(len(exact), bool)
    small = deleting & (count <= 1)  # two units each
    rank = np.cumsum(small) - np.concatenate([[0], np.cumsum(small)])[base[owner]]
    out = small & (rank <= spare[owner] // 2)
    probe[out] = False
    spare = spare - 2 * np.bincount(owner[out], minlength=len(n))
    plain = np.flatnonzero(~deleting)
    order = plain[np.lexsort((count[plain], owner[plain]))]
    first = np.searchsorted(owner[order], np.arange(len(n)))
    probe[order[np.arange(len(order)) - first[owner[order]] < spare[owner[order]]]] = False
    return np.concatenate([exact, less]), np.concatenate([owner, doc[at]]), np.concatenate([probe, probe[key[at]]])


def _summaries(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, h1, h2, bits): size of each document's set, two hashes of it, from independent hashes of its shingles, and its parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            value, second, off = shingle_sets(*text_bytes(b.column(1)), k)
            n = np.diff(off)
            hashes = []
            for v in (value, second):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(v * MULTIPLIERS[30]), dtype=np.uint64)])
                hashes.append((sums[off[1:]] - sums[off[:-1]]).view(np.int64))
            doc = np.repeat(np.arange(len(n)), n)
            bit = (mix(value * MULTIPLIERS[32]) % _U(64 * BITMAP)).astype(np.int64)
            parity = (np.bincount(doc * 64 * BITMAP + bit, minlength=len(n) * 64 * BITMAP) & 1).astype(np.uint8)
            bits = np.packbits(parity.reshape(len(n), -1), axis=1).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(hashes[0]), pa.array(hashes[1]), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(BITMAP))], names=["id", "n", "h1", "h2", *(f"b{i}" for i in range(BITMAP))])

    schema = "id long, n long, h1 long, h2 long, " + ", ".join(f"b{i} long" for i in range(BITMAP))
    return docs.mapInArrow(run, schema)


def _runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal numbers."""
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(sig)]]))


class _Bucketed:
    """Rows sorted by signature, those that probe first: the first of each bucket is its pivot."""

    def __init__(self, sig: np.ndarray, doc: np.ndarray, probe: np.ndarray, many: np.ndarray) -> None:
        order = np.lexsort((doc, ~probe, sig))
        sig, doc, probe, many = sig[order], doc[order], probe[order], many[order]
        new = np.ones(len(sig), bool)  # a document may have one signature twice
        new[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]) | (probe[1:] != probe[:-1])
        self.sig, self.doc, self.probe, self.many = sig[new], doc[new], probe[new], many[new]
        self.start, self.length = _runs(self.sig)
        self.run = np.repeat(np.arange(len(self.start)), self.length)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        pivot = self.start[self.run]
        at = np.flatnonzero((np.arange(len(self.sig)) > pivot) & self.probe[pivot] & (self.doc != self.doc[pivot]))
        a, b = self.doc[pivot[at]], self.doc[at]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(at) else np.empty((2, 0), np.int64)
        return both[0], both[1]


_PACKED = "g int, kind int, sig binary, doc binary, probe binary, many binary"


def _pack(g: int, kind: int, sig: np.ndarray, doc: np.ndarray, probe: np.ndarray | None = None, many: np.ndarray | None = None) -> tuple:
    return (g, kind, sig.tobytes(), doc.tobytes(), None if probe is None else np.packbits(probe).tobytes(), None if many is None else np.packbits(many).tobytes())


def extent(total: int, partitions: int) -> tuple[int, int]:
    """Number of hash ranges for so many shingles, and of signatures that a task gathers; both bounded by what a task can hold."""
    per = min(RANGE[1], max(RANGE[0], total // RANGES))
    return max(4 * partitions, total // per), min(FLUSH[1], max(FLUSH[0], total // RANGES))


def _buckets(docs: DataFrame, k: int, percent: int, n_groups: int, flush_at: int) -> DataFrame:
    """Packed rows by hash range. kind 0: signatures; 1: pairs found within a task; 2: members of buckets within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        held, size, turn = [], 0, TaskContext.get().partitionId()  # tasks start with groups of their own

        def flush() -> pa.RecordBatch:
            nonlocal held, size, turn
            sig, doc, probe = (np.concatenate(x) for x in zip(*held))
            held, size = [], 0
            b = _Bucketed(sig, doc, probe, np.zeros(len(sig), bool))
            rows = []
            x, y = b.pairs()
            inside = np.repeat(b.length > 1, b.length)
            turn += 1
            if inside.any():
                rows.append(_pack(turn % n_groups, 1, x, y))
                rows.append(_pack(turn % n_groups, 2, b.sig[inside], b.doc[inside], b.probe[inside]))
            lead, many = b.start, b.length > 1
            s, d, p = b.sig[lead], b.doc[lead], b.probe[lead]
            bounds = range_bounds(s, n_groups)
            for g in np.flatnonzero(np.diff(bounds)).tolist():
                c = slice(bounds[g], bounds[g + 1])
                o = np.argsort(d[c], kind="stable")  # documents side by side are compressed well
                rows.append(_pack(g, 0, s[c][o], d[c][o], p[c][o], many[c][o]))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["g", "kind", "sig", "doc", "probe", "many"])

        for b in slices(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            value, _, off = shingle_sets(*text_bytes(b.column(1)), k)
            for ahead in (0, 1):
                sig, doc, probe = signatures(scheme, value, off, ahead)
                held.append((sig, ids[doc].astype(np.int64), probe))
                size += len(sig)
            if size >= flush_at:
                yield flush()
        if size:
            yield flush()

    return docs.mapInArrow(run, _PACKED)


def _reduce(table: pa.Table) -> pa.Table:
    """kind 0: a pair (x, y). kind 2: packed members of buckets that have more than one pair."""
    kind = table.column("kind").to_pylist()
    cols = {n: table.column(n).to_pylist() for n in ("sig", "doc", "probe", "many")}
    at = [i for i, x in enumerate(kind) if x == 0]
    pairs = [np.stack([np.frombuffer(cols[n][i], np.int64) for n in ("sig", "doc")]) for i, x in enumerate(kind) if x == 1]
    members = [(cols["sig"][i], cols["doc"][i], cols["probe"][i]) for i, x in enumerate(kind) if x == 2]
    if at:
        docs = [np.frombuffer(cols["doc"][i], np.int64) for i in at]
        flags = {n: np.concatenate([np.unpackbits(np.frombuffer(cols[n][i], np.uint8), count=len(d)) for i, d in zip(at, docs)]).astype(bool) for n in ("probe", "many")}
        b = _Bucketed(np.concatenate([np.frombuffer(cols["sig"][i], np.uint64) for i in at]), np.concatenate(docs), flags["probe"], flags["many"])
        pairs.append(np.stack(b.pairs()))
        some = np.logical_or.reduceat(b.many, b.start) if len(b.start) else np.empty(0, bool)
        inside = np.repeat((b.length > 2) | ((b.length > 1) & some), b.length)
        if inside.any():
            members.append((b.sig[inside].tobytes(), b.doc[inside].tobytes(), np.packbits(b.probe[inside]).tobytes()))
    both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
    n, k = both.shape[1], len(members)
    none = [None] * n
    return pa.table({
        "kind": pa.array([0] * n + [2] * k, pa.int32()),
        "x": pa.array([*both[0].tolist(), *[None] * k], pa.int64()),
        "y": pa.array([*both[1].tolist(), *[None] * k], pa.int64()),
        **{name: pa.array([*none, *(m[i] for m in members)], pa.binary()) for i, name in enumerate(("sig", "doc", "probe"))},
    })


def _members(found: DataFrame) -> DataFrame:
    """(sig, id, probe) of the packed members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, d, p in zip(*(c.to_pylist() for c in b.columns)):
                doc = np.frombuffer(d, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s, np.int64)), pa.array(doc), pa.array(np.unpackbits(np.frombuffer(p, np.uint8), count=len(doc)).astype(bool))], names=["sig", "id", "probe"])

    return found.filter("kind = 2").select("sig", "doc", "probe").mapInArrow(run, "sig long, id long, probe boolean")


def _possible(percent: int, x: str, y: str) -> Column:
    """Whether two sets may be linked, going by sizes and parity bitmaps: bits that differ need shingles that do."""
    differ = sum((F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(1, BITMAP)), F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0"))))
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    sizes = 100 * F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) >= percent * F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n"))
    return sizes & (differ * (100 + percent) <= both * (100 - percent))


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets are linked."""
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(tb.hint("merge"), "b").join(ta.hint("merge"), "a").select("a", "text_a", "b", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            ids = batch.column(0).to_numpy()
            whole = batch.column(1)  # an id may have several texts
            other = pc.not_equal(whole.slice(1), whole.slice(0, len(whole) - 1)).to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | other]))
            own = np.repeat(np.arange(len(turns)), np.diff([*turns, len(ids)]))
            va, wa, oa = shingle_sets(*text_bytes(whole.take(pa.array(turns))), k)
            vb, wb, ob = shingle_sets(*text_bytes(batch.column(3)), k)
            good = np.zeros(len(ids), bool)
            for i in range(len(ids)):
                a, b = slice(oa[own[i]], oa[own[i] + 1]), slice(ob[i], ob[i + 1])
                p, q = va[a], vb[b]
                _, x, y = np.intersect1d(p, q, assume_unique=True, return_indices=True)
                same = int((wa[a][x] == wb[b][y]).sum())
                good[i] = same > 0 and 100 * same >= percent * (len(p) + len(q) - same)
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(2).take(keep)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: key, n_shingles, and component_id, the smallest id that it is linked with through others."""
    spark = docs.sparkSession
    clean = docs.select(whole_ids(docs, key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = clean.filter("id IS NOT NULL")
    info = stored(_summaries(clean, k), "join-sets")
    sets = info.filter("n > 0 AND id IS NOT NULL")
    # on storage, so that joins with it come right after shuffles: Spark splits a class that very many documents are in
    classes = stored(sets.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "join-least")
    # the class of each id; where an id has several rows, these are linked
    of = stored(sets.join(classes.hint("merge"), ["n", "h1", "h2"]).select("id", "rep", "n", *(f"b{i}" for i in range(BITMAP))), "join-classes")
    total = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_groups, flush_at = extent(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "kind int, x long, y long, sig binary, doc binary, probe binary"

    def reduce(t: pa.Table) -> pa.Table:
        return _reduce(t)

    found = stored(_buckets(known, k, percent, n_groups, flush_at).groupBy("g").applyInArrow(reduce, schema), "join-buckets")
    rep = of.select("id", "rep").distinct()
    pairs = found.filter("kind = 0").select("x", "y").distinct()
    pairs = pairs.join(rep.select(F.col("id").alias("x"), F.col("rep").alias("a")).hint("merge"), "x").join(rep.select(F.col("id").alias("y"), F.col("rep").alias("b")).hint("merge"), "y").filter("a <> b")
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-pairs")
    # an id that is the least of several classes has a row for each, and pairs with it are ruled out only if all rule them out
    reps = stored(of.filter("id = rep").distinct(), "join-reps")
    members = _members(found).join(rep.hint("merge"), "id").groupBy("sig", F.col("rep").alias("id")).agg(F.max("probe").alias("probe"))
    members = stored(members, "join-members")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(members.select("id")).distinct()
    texts = stored(known.join(ids.hint("merge"), "id", "left_semi"), "join-texts")
    links = stored(_verify(_filtered(pairs, reps, percent), texts, k, percent), "join-links")
    more = rep.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    links = links.unionByName(more)
    labels, done, turn, linked = components(links), pairs, 0, True
    sets = reps.select("id", F.struct("n", *(f"b{i}" for i in range(BITMAP))).alias("s"))
    split = stored(_split(members, labels).join(sets, "id"), "join-split")
    while True:
        pivots = linked and _many(split, PER_MEMBER if turn else AT_ONCE)
        left = stored((_pivots(split, percent, turn) if pivots else _across(split, percent)).join(done, ["a", "b"], "left_anti"), "join-remaining")
        linked = False
        if not left.isEmpty():
            more = stored(_verify(left, texts, k, percent), "join-links")
            linked = not more.isEmpty()
            labels = _merged(labels, more) if linked else labels
            done = done.unionByName(left)
        if not pivots:
            break  # links only merge components, so no pair across them is left
        if linked:  # nor does a bucket of one component get several
            before, split = split, stored(_split(split, labels), "join-split")
            discard(before)
        turn += 1
    discard(split)
    discard(found, of, pairs, reps, members, texts, left)
    tagged = info.join(classes.hint("merge"), ["n", "h1", "h2"], "left")
    out = tagged.join(labels.hint("merge"), tagged["rep"] == labels["v"], "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("label", "rep"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _filtered(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    cols = F.struct("n", *(f"b{i}" for i in range(BITMAP)))
    ia, ib = reps.select(F.col("id").alias("a"), cols.alias("sa")), reps.select(F.col("id").alias("b"), cols.alias("sb"))
    return pairs.join(ia.hint("merge"), "a").join(ib.hint("merge"), "b").filter(_possible(percent, "sa", "sb")).select("a", "b")


def _split(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels, of the buckets that hold several components and a document that probes."""
    m = members.drop("label").join(labels.select(F.col("v").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    split = m.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("probe").alias("any")).filter("lo <> hi AND any").select("sig")
    split = stored(split, "join-split-buckets")
    return m.join(split, "sig", "left_semi")


def _many(split: DataFrame, most: int) -> bool:
    """Whether pairs of a probing member with one of another component are more than ``most`` for each member."""
    counts = F.count("*").cast("double").alias("n"), F.sum(F.col("probe").cast("double")).alias("p")
    sizes = split.groupBy("sig", "label").agg(*counts).groupBy("sig").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("n") * F.col("p")).alias("np"))
    pairs, rows = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("p") - F.col("np")), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    return pairs > most * rows


def _pivots(split: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's further pivots with the members in other components; pivots are often the same in many buckets."""
    chosen = [F.min_by(F.struct("id", "label", "s"), F.xxhash64("id", F.lit(PIVOTS * turn + i))) for i in range(PIVOTS)]
    pivot = split.filter("probe").groupBy("sig").agg(F.array_distinct(F.array(*chosen)).alias("ps")).select("sig", F.explode("ps").alias("p"))
    pivot = stored(pivot.select("sig", F.col("p.id").alias("pid"), F.col("p.label").alias("plabel"), F.col("p.s").alias("ps")), "join-pivots")
    near = split.join(pivot, (split["sig"] == pivot["sig"]) & (F.col("label") != F.col("plabel")) & _possible(percent, "s", "ps"))
    return near.select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: components of the components that these join."""
    la, lb = labels.select(F.col("v").alias("a"), F.col("label").alias("la")), labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    between = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct()
    joined = components(between)
    new = joined.select(F.col("v").alias("label"), F.col("label").alias("up"))
    old = labels.join(new, "label", "left").select("v", F.coalesce("up", "label").alias("label"))
    return stored(old.unionByName(joined.join(labels.select("v"), "v", "left_anti")), "labels")


def _across(split: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of a bucket in different components, of which one probes, that sizes and bitmaps don't rule out.

    Only members that probe are one side of the join: of a common subset these are few, and all pairs its square.
    """
    x = split.filter("probe").select("sig", F.col("id").alias("x"), F.col("label").alias("lx"), F.col("s").alias("sx"))
    y = split.select(F.col("sig").alias("sig2"), F.col("id").alias("y"), F.col("label").alias("ly"), F.col("probe").alias("py"), F.col("s").alias("sy"))
    on = (F.col("sig") == F.col("sig2")) & (F.col("lx") != F.col("ly")) & (~F.col("py") | (F.col("x") < F.col("y"))) & _possible(percent, "sx", "sy")
    return x.join(y.hint("merge"), on).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id"""
