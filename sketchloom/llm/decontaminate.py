"""Benchmark decontamination by a BM25 inverted index of test items.

The items are the indexed side: entries of up to 48 words, with BM25 impacts divided by the entry's score for itself.
Every training document is cut into half-passages of 64 words, and each two in succession are a passage that queries the
index, so that each stretch of up to 64 words lies in some passage whole.

The index is sparse: each term has a list of the entries that it is in, in the order of their numbers, cut into blocks
with their last entry and their largest impact. Entries are numbered by length, so that impacts within a block are alike.
Retrieval is block-max WAND, for all passages of a batch in step with each other: each passage's terms have cursors on
their lists; by the cursors' order the terms' largest impacts are summed up to the pivot, the first entry that could
reach the threshold, and what lies before it is skipped; the maxima of the blocks that hold the pivot are summed, and if
they can't reach the threshold the passage goes on behind the first of these blocks to end; else the entry is scored.
Besides, an entry can reach the threshold only if the passage has several (up to NEED) of its essential terms, its
rarest, beyond which the rest and the heaviest NEED - 1 of them weigh too little, so that pivots move on to the next such
entry. All bounds are exact: every entry that scores at least ``threshold`` is returned, with no limit on their number.

Each retrieved item is verified: shares of its question's and answer's shingles of up to 5 words that stand near the
passage. Where items have no answer of their own but one text, a text of which enough shingles stand there as a whole is
reported as well, wherever they lie: an edited or missing last sentence doesn't hide it.

The index is built by tasks, in shards of up to SHARD_ITEMS items and SHARD_BYTES of text, which lie on shared storage;
neither the driver nor a broadcast holds it. Documents are read once, whatever the number of shards: a worker keeps
shards of up to RESIDENT bytes, and if there are more it goes through all of them for each LARGE bytes of text. BM25
statistics are of all shards' entries, so that the number of shards changes no result.

Defined cases: NULL and empty texts match nothing, neither as document nor as item; repeated rows of a document are
reported once for each row; of an item's several passages the best is reported; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from sketchloom.llm import text as T
from sketchloom.llm.common import SLICE, fresh, open_uri, shared_dir, slices, stored, text_bytes
from sketchloom.llm.text import LETTERS, LOWER, spans, windows

ENTRY_WORDS, HALF, BLOCK = 48, 64, 16
K1, B = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER, WHOLE, SHINGLE = 0.6, 0.5, 0.5, 0.5, 5
SHARD_ITEMS, SHARD_BYTES = 2000, 2 << 20
#: Bytes of stored shards that a worker keeps, and of text that it looks at for each round through more shards than that.
RESIDENT, LARGE = 256 << 20, 16 << 20
#: (passage, term) pairs that are worked on at a time, and slack of bounds that are sums of 32-bit floats.
PAIRS, SLACK = 400_000, 1e-4
#: Essential terms of an entry that a passage must have, where entries have so many.
NEED = 3


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of letters and digits, and each text's first word."""
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, LETTERS)
    return T.word_hashes(data, starts, ends), first


def _shingles(h: np.ndarray, short: bool = False) -> tuple[int, np.ndarray]:
    """Words of a shingle, and all shingles. ``short``: so few words that one changed word leaves half, but two at least."""
    size = min(SHINGLE, len(h), max(2, (len(h) + 1) // 3) if short else SHINGLE)
    return size, np.unique(windows(h, size)) if len(h) else np.empty(0, np.uint64)


def split_answer(text: str) -> tuple[str, str]:
    """Question and answer of a plain text: its last sentence is the answer, if there are several."""
    body = text.rstrip()
    cut = max(body.rfind(p, 0, len(body) - 1) for p in (". ", ".\n", "? ", "?\n", "! ", "!\n", "\n"))
    return (body[: cut + 1], body[cut + 1 :]) if cut > 0 else (body, body)


def _words(q: str, a: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of an item's question, its answer and all of it."""
    q_, a_ = (word_hashes(*text_bytes(pa.array([x or ""])))[0] for x in (q, a))
    return q_, a_, q_ if q == a else np.concatenate([q_, a_])


def _entries(h: np.ndarray) -> list[np.ndarray]:
    return np.array_split(h, -(-len(h) // ENTRY_WORDS)) if len(h) else []


class Index(NamedTuple):
    """Lists are one after the other, in the order of ``terms``; keys are term * n + entry, so that they are in order, too."""

    n: int  # entries
    terms: np.ndarray  # sorted hashes
    probe: np.ndarray  # by the low 16 bits of a hash: whether any term has them
    top: np.ndarray  # largest impact of each term
    key: np.ndarray  # of the postings
    impact: np.ndarray
    end: np.ndarray  # end of each term's postings
    block_key: np.ndarray  # of each block's last posting
    block_max: np.ndarray
    block_end: np.ndarray
    essential: np.ndarray  # entries that each term is essential for, term after term
    essential_at: np.ndarray
    need: np.ndarray  # essential terms of each entry without which it can't reach the threshold
    item_of: np.ndarray  # item of each entry
    questions: list
    answers: list
    wholes: list
    lengths: np.ndarray
    ids: list


def build(items: list[tuple], df: dict[int, int] | None = None, total: tuple[int, float] | None = None, threshold: float = THRESHOLD) -> Index | None:
    """Index of (id, question, answer) rows. ``df``: entries that have a term, and ``total``: entries and words of all shards."""
    entries, questions, answers, wholes, lengths, ids = [], [], [], [], [], []
    for id_, q, a in items:
        *qa, h = _words(q, a)
        if not len(h):
            continue
        entries += [(len(p), len(ids), p) for p in _entries(h)]
        ids.append(id_)
        questions.append(_shingles(qa[0]))
        answers.append(_shingles(qa[1], short=True))
        wholes.append(_shingles(h, short=True))
        lengths.append(len(h))
    if not ids:
        return None
    entries.sort(key=lambda e: e[:2])
    size = np.array([e[0] for e in entries])
    terms, word = np.unique(np.concatenate([e[2] for e in entries]), return_inverse=True)
    n, words = total or (len(entries), float(size.sum()))
    own = len(entries)
    key, tf = np.unique(word * own + np.repeat(np.arange(own), size), return_counts=True)
    term, entry = key // own, key % own
    seen = np.bincount(term) if df is None else np.array([df.get(int(t), 1) for t in terms])
    idf = np.log(1 + (n - seen + 0.5) / (seen + 0.5))
    norm = K1 * (1 - B + B * size / (words / n))
    impact = idf[term] * tf * (K1 + 1) / (tf + norm[entry])
    impact = (impact / np.bincount(entry, impact)[entry]).astype(np.float32)
    end = np.searchsorted(term, np.arange(len(terms)), side="right")
    # blocks: each list is cut from its own start
    place = np.arange(len(key)) - np.concatenate([[0], end[:-1]])[term]
    last = np.ones(len(key), bool)
    last[:-1] = (term[1:] != term[:-1]) | (place[1:] % BLOCK == 0)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    essential, need = _essential(term, entry, impact, seen, threshold)
    probe = np.zeros(1 << 16, bool)
    probe[(terms & np.uint64(0xFFFF)).astype(int)] = True
    return Index(own, terms, probe, np.maximum.reduceat(impact, np.concatenate([[0], end[:-1]])), key, impact, end, key[last], np.maximum.reduceat(impact, first), np.searchsorted(term[last], np.arange(len(terms)), side="right"), entry[essential], np.searchsorted(term[essential], np.arange(len(terms) + 1)), need, np.array([e[1] for e in entries]), questions, answers, wholes, np.array(lengths), ids)


def _essential(term: np.ndarray, entry: np.ndarray, impact: np.ndarray, seen: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Postings whose term is essential for the entry, and how many of them each entry needs.

    Of an entry's terms, the rarest first, the shortest run is taken so that all behind it, and the heaviest m - 1 within
    it, can't reach the threshold together: then m of the run are needed.
    """
    order = np.lexsort((term, seen[term], entry))
    cut = np.searchsorted(entry[order], np.arange(int(entry.max()) + 2))
    chosen, need = [], []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = impact[order[a:b]].astype(np.float64)
        rest = 1.0 - np.cumsum(own)
        heaviest = np.zeros(NEED)  # in the run so far, in ascending order
        tops = np.empty((len(own), NEED))
        for i, x in enumerate(own.tolist()):
            if x > heaviest[0]:
                heaviest[0] = x
                heaviest.sort()
            tops[i] = np.concatenate([[0.0], np.cumsum(heaviest[:0:-1])])
        for m in range(NEED, 0, -1):
            enough = np.flatnonzero(rest + tops[:, m - 1] < threshold - SLACK)
            if len(enough):
                break
        chosen.append(order[a : a + enough[0] + 1])
        need.append(m)
    return np.sort(np.concatenate(chosen)), np.array(need)


def retrieve(ix: Index, h: np.ndarray, first: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, entry, score, first word and end of the passage) of all passages and entries that reach the threshold."""
    at = np.flatnonzero(ix.probe[(h & np.uint64(0xFFFF)).astype(np.int64)])
    t = np.searchsorted(ix.terms, h[at])
    t[t == len(ix.terms)] = 0
    hit = ix.terms[t] == h[at]
    at, t = at[hit], t[hit]
    if not len(at):
        return []
    doc = np.searchsorted(first, at, side="right") - 1
    halves = -(-np.diff(first) // HALF)
    half_at = np.concatenate([[0], np.cumsum(halves)])
    half = half_at[doc] + (at - first[doc]) // HALF
    # a passage is named by its first half; a text of one half is a passage by itself
    starts, ends = half_at[:-1][doc], half_at[1:][doc]
    ahead, behind = (half + 1 < ends) | (half == starts), half > starts
    pairs = np.unique(np.concatenate([half[ahead] * len(ix.terms) + t[ahead], (half[behind] - 1) * len(ix.terms) + t[behind]]))
    passage, t = pairs // len(ix.terms), pairs % len(ix.terms)
    # only passages with enough essential terms of an entry, and whose terms together can reach the threshold, have anything to find
    count = ix.essential_at[t + 1] - ix.essential_at[t]
    lead = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    work = np.add.reduceat(count + 1, lead)
    live = np.add.reduceat(ix.top[t].astype(np.float64), lead) >= threshold - SLACK
    stop = np.append(lead[1:], len(t))
    found: list = []
    lo, total = 0, np.cumsum(work)
    while lo < len(lead):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - work[lo] + PAIRS, side="right")))
        part = slice(lead[lo], stop[hi - 1])
        keep = np.repeat(live[lo:hi], (stop - lead)[lo:hi])
        found += _search(ix, passage[part][keep], t[part][keep], threshold)
        lo = hi
    out = []
    for p, entry, score in found:
        d = int(np.searchsorted(half_at, p, side="right")) - 1
        w = int(first[d] + (p - half_at[d]) * HALF)
        out.append((d, entry, score, w, int(min(first[d + 1], w + 2 * HALF))))
    return out


def _search(ix: Index, passage: np.ndarray, t: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """``wand`` for those passages that have enough essential terms of some entry."""
    names, own = np.unique(passage, return_inverse=True)
    count = ix.essential_at[t + 1] - ix.essential_at[t]
    which = np.repeat(np.arange(len(t)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + ix.essential_at[t][which]
    wanted, times = np.unique(own[which] * ix.n + ix.essential[place], return_counts=True)
    wanted = wanted[times >= ix.need[wanted % ix.n]]
    some = np.zeros(len(names), bool)
    some[wanted // ix.n] = True
    keep = some[own]
    new = np.cumsum(some) - 1
    return wand(ix, names[some], new[own[keep]], t[keep], new[wanted // ix.n] * ix.n + wanted % ix.n, threshold)


def wand(ix: Index, names: np.ndarray, own: np.ndarray, t: np.ndarray, wanted: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(passage, entry, score) of all entries that reach the threshold.

    ``own`` and ``t``: pairs of a passage's number among ``names`` and a term, in order; ``wanted``: number * n + entry of
    the entries that have enough essential terms there, in order.
    """
    found, n, number = [], ix.n, np.arange(len(names))
    at = np.zeros(len(names), np.int64)  # the entry that each passage looks at next; no cursor stands before it

    def cursor(keys: np.ndarray, end: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair's list the first posting from ``entry`` on, and its entry; n if there is none."""
        i = np.searchsorted(keys, t * n + entry)
        on = i < end[t]
        i[~on] = 0
        return i, np.where(on, keys[i] - t * n, n)

    while len(names):
        lead = np.searchsorted(own, np.arange(len(names)))
        _, cur = cursor(ix.key, ix.end, at[own])
        i = np.searchsorted(wanted, number * n + at)
        want = wanted[np.minimum(i, len(wanted) - 1)] - number * n
        want[(i == len(wanted)) | (want >= n)] = n
        # the pivot: in the order of the cursors, where the sum of the terms' largest impacts reaches the threshold
        order = np.lexsort((cur, own))
        upto = np.cumsum(np.where(cur < n, ix.top[t], 0)[order], dtype=np.float64)
        upto -= np.concatenate([[0.0], upto])[lead][own]
        pivot = np.full(len(names), n)
        reach = np.flatnonzero(upto >= threshold - SLACK)
        np.minimum.at(pivot, own[reach], cur[order][reach])
        # no entry before both can reach the threshold; where the essential one comes first, cursors move to the pivot
        ready = (want >= pivot) & (want < n)
        going = np.where(ready, want, n)
        near = cur <= going[own]
        block, _ = cursor(ix.block_key, ix.block_end, going[own])
        inside = near & (ix.block_key[block] - t * n >= going[own]) & (ix.block_key[block] // n == t) & ready[own]
        bound = np.add.reduceat(np.where(inside, ix.block_max[block], 0).astype(np.float64), lead)
        full = ready & (bound >= threshold - SLACK)
        i, place = cursor(ix.key, ix.end, going[own])
        hit = (place == going[own]) & full[own]
        score = np.add.reduceat(np.where(hit, ix.impact[i], 0).astype(np.float64), lead)
        found += [(int(names[j]), int(going[j]), float(score[j])) for j in np.flatnonzero(full & (score >= threshold - 1e-6))]
        # where blocks can't: behind the first of them to end, or to the first list that begins after the pivot
        skip = np.minimum.reduceat(np.where(inside, ix.block_key[block] - t * n + 1, np.where(near, n, cur)), lead)
        at = np.where(full, going + 1, np.where(ready, np.maximum(skip, going + 1), pivot))
        live = (at < n) & (want < n) & (pivot < n)
        keep = live[own]
        t, own, names, number, at = t[keep], (np.cumsum(live) - 1)[own[keep]], names[live], number[live], at[live]
    return found


def verify(ix: Index, item: int, h: np.ndarray, lo: int, hi: int) -> tuple[float, float, float]:
    """Shares of the shingles of the item's question, its answer and all of it within words lo to hi."""
    near, shares = h[lo:hi], []
    for size, want in (ix.questions[item], ix.answers[item], ix.wholes[item]):
        shares.append(float(np.isin(want, windows(near, size)).mean()) if len(want) else 1.0)
    return shares[0], shares[1], shares[2]


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Pairs of a document and a test item that it holds: key, item, score, question, answer and whole overlap, first word, rule.

    ``rule`` says what the shares have reached: ``parts``, those of question and answer both, or ``whole``, that of the whole
    text alone. Where key or item is named like another column, later ones get underscores before their names.

    Items have columns for question and answer, or one text whose last sentence is taken for the answer; of one text a
    share of ``w_share`` over all of it is enough too. Options are those of ``Search``.
    """
    search = Search(docs.sparkSession, items, **options)
    item, kind, ikind = search.item, docs.schema[key].dataType.simpleString(), items.schema[search.item].dataType.simpleString()
    look = search.task()
    names = ["score", "question_overlap", "answer_overlap", "whole_overlap", "first_word", "rule"]
    kinds = [pa.float64()] * 4 + [pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, best, ids in look(batches, 1):
            if best:
                keys = b.column(0).take(pa.array([d for d, _ in best]))
                yield pa.RecordBatch.from_arrays([keys, pa.array([ids[i] for _, i in best]), *(pa.array([r[c] for r in best.values()], t) for c, t in enumerate(kinds))], names=["key", "item", *names])

    schema = f"key {kind}, item {ikind}, score double, question_overlap double, answer_overlap double, whole_overlap double, first_word long, rule string"
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, schema).toDF(key, *fresh([key], item, *names))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns: each row by itself, whatever its id."""
    look, at = Search(docs.sparkSession, items, **options).task(), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: set[int] = set()
        for b, best, _ in look(batches, at, True):
            if best is None:  # the last shard of this batch
                keep = np.ones(b.num_rows, bool)
                keep[list(gone)] = False
                gone = set()
                yield b.filter(pa.array(keep))
            else:
                gone |= {d for d, _ in best}

    # columns travel by place, as their names may have dots
    schema = types.StructType([types.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    return docs.toDF(*schema.names).mapInArrow(run, schema).toDF(*docs.columns)


class Search:
    """Shards of the index on shared storage, and what tasks need to go through them."""

    def __init__(self, spark, items: DataFrame, item: str = "item_id", question: str | None = None, answer: str | None = None, item_text: str = "text", threshold: float = THRESHOLD, q_share: float = QUESTION, a_share: float = ANSWER, w_share: float = WHOLE) -> None:
        self.item, self.limits = item, (threshold, q_share, a_share, None if answer else w_share)
        q = F.col(question) if question else F.col(item_text)
        a = F.col(answer).cast("string") if answer else F.lit(None).cast("string")
        rows = items.select(F.col(item).alias("id"), q.cast("string").alias("q"), a.alias("a"))
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "q", "a"))), F.lit(0))).first()
        shards = max(1, -(-n // SHARD_ITEMS), -(-size // SHARD_BYTES))
        self.root = shared_dir(spark, "benchmark-index")
        self.files = _write_shards(rows.withColumn("shard", F.pmod(F.xxhash64("id", "q", "a"), F.lit(shards)).cast("int")), self.root, bool(answer), threshold)

    def task(self) -> Callable:
        """A function of a task's batches that yields (batch, best row by document and item, item ids) for each shard, and with ``marks`` (batch, None, None) after each batch's last."""
        files, root, (threshold, q_share, a_share, w_share) = self.files, self.root, self.limits
        limit = SLICE if sum(size for _, size in files) <= RESIDENT else LARGE

        def look(batches: Iterator[pa.RecordBatch], text: int, marks: bool = False) -> Iterator[tuple]:
            for b in slices(batches, text, limit):
                h, first = word_hashes(*text_bytes(b.column(text)))
                for name, _ in files:
                    ix = _shard(root, name)
                    best: dict[tuple[int, int], tuple] = {}
                    for d, entry, score, lo, hi in retrieve(ix, h, first, threshold):
                        it = int(ix.item_of[entry])
                        room = int(ix.lengths[it])
                        q, a, w = verify(ix, it, h, max(int(first[d]), lo - room), min(int(first[d + 1]), hi + room))
                        if q >= q_share and a >= a_share or w_share is not None and w >= w_share:
                            row = (score, q, a, w, lo - int(first[d]), "parts" if q >= q_share and a >= a_share else "whole")
                            if (d, it) not in best or row[:3] > best[d, it][:3]:
                                best[d, it] = row
                    yield b, best, ix.ids
                if marks:
                    yield b, None, None

        return look


_KEPT: OrderedDict[str, tuple[int, Index]] = OrderedDict()


def _shard(root: str, name: str) -> Index:
    """A shard from storage; the worker keeps those it has used last."""
    path = f"{root}/{name}"
    if path not in _KEPT:
        system, file = open_uri(path)
        with system.open_input_stream(file) as s:
            raw = s.read()
        _KEPT[path] = len(raw), Index(*pickle.loads(raw))
        while len(_KEPT) > 1 and sum(size for size, _ in _KEPT.values()) > RESIDENT:
            _KEPT.popitem(last=False)
    _KEPT.move_to_end(path)
    return _KEPT[path][1]


def _question_answer(q: str | None, a: str | None, answers: bool) -> tuple[str, str | None]:
    return (q or "", a) if answers else split_answer(q or "")


def _write_shards(rows: DataFrame, root: str, answers: bool, threshold: float) -> list[tuple[str, int]]:
    """Builds each shard in a task of its own and writes it; returns their names and sizes, some for each 2000 items."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, ts, ns = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for q, a, shard in zip(*(b.column(i).to_pylist() for i in range(3))):
                for e in _entries(_words(*_question_answer(q, a, answers))[2]):
                    t = np.unique(e).view(np.int64)
                    ts += [[0], t]
                    ns += [[len(e)], np.zeros(len(t), np.int64)]
                    shards += [shard] * (len(t) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(np.concatenate(ts), pa.int64()), pa.array(np.concatenate(ns), pa.int64())], names=["shard", "t", "n"])

    # in how many entries of a shard each term is, and under 0 its entries and their words
    counts = rows.select("q", "a", "shard").mapInArrow(terms, "shard int, t long, n long").groupBy("shard", "t").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    counts = stored(counts, "benchmark-terms")
    all_ = counts.groupBy("t").agg(F.sum("c").alias("all_c"), F.sum("n").alias("all_n"))
    of_shards = counts.select("shard", "t").join(all_, "t")

    def write(items: pa.Table, stats: pa.Table) -> pa.Table:
        df = dict(zip(stats.column("t").to_pylist(), zip(stats.column("all_c").to_pylist(), stats.column("all_n").to_pylist())))
        n, words = df.pop(0, (1, 1))
        part = sorted(((r["id"], *_question_answer(r["q"], r["a"], answers)) for r in items.to_pylist()), key=lambda r: (str(r[0]), r[1], r[2] or ""))
        ix = build(part, {t % (1 << 64): c for t, (c, _) in df.items()}, (n, float(max(1, words))), threshold)
        names, sizes = [], []
        if ix is not None:
            system, folder = open_uri(root)
            system.create_dir(folder, recursive=True)
            names, raw = [f"{uuid.uuid4().hex}.index"], pickle.dumps(tuple(ix), protocol=5)
            with system.open_output_stream(f"{folder}/{names[0]}") as out:
                out.write(raw)
            sizes = [len(raw)]
        return pa.table({"name": pa.array(names, pa.string()), "size": pa.array(sizes, pa.int64())})

    done = rows.groupBy("shard").cogroup(of_shards.groupBy("shard")).applyInArrow(write, "name string, size long")
    return sorted((r["name"], r["size"]) for r in done.collect())
