"""Spelling variants by Aho-Corasick halves.

A word is cut into two halves. Of two words that differ by one inserted, deleted or replaced letter, one has a half of the
other intact, at its beginning or at its end. So automata hold every word's two halves; all words are scanned, and a hit
counts where the half stands at its own end of the word and the lengths differ by one at most. What is left of both
words must then differ by exactly one letter.

Automata are in shards by a hash of the half. A word is sent to the shards of those beginnings and ends of it that can be
halves of words of its length or one more or less, which are four at most, so that scanning grows with the words and not
with words times shards. What is left of the words with one half is looked up by its forms with one letter deleted or
masked: a half that very many words share costs the forms that they have, not their square. A half of more than ``HOT``
words isn't gathered in one task: its words are joined by these forms.

Defined cases: NULL and empty texts have no words; a NULL id is written as an empty string; rows that repeat count each by
itself; texts are taken whole; an empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.common import discard, slices, stored

MIN_LETTERS, MIN_COUNT, RATIO, EVERY = 7, 2, 10, 31
#: Words in a shard, words of one half in a shard, and words that a task counts before it passes them on.
SHARD, HOT, HELD = 200_000, 100_000, 500_000
#: Bytes of text whose words are listed at once.
LISTED = 4 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LETTERS, every: int = EVERY) -> DataFrame:
    """(word, n): words of at least ``least`` letters and how often they occur, counted in each task first.

    Where ``every`` divides the CRC-32 of ``<id>:<word>``, the word's letter at that number modulo its length is left out.
    """
    run_of_letters = re.compile(rf"[A-Za-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if not t:
                    continue
                lowered = t.translate(_LOWER).decode()
                found = Counter(run_of_letters.findall(lowered) if len(t) < LISTED else (m.group() for m in run_of_letters.finditer(lowered)))
                start = zlib.crc32(f"{'' if k is None else k}:".encode())
                for w, n in found.items():
                    h = zlib.crc32(w.encode(), start)
                    if h % every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least:
                            continue
                    held[w] += n
            if len(held) > HELD:
                yield out()
                held = Counter()
        if held:
            yield out()

    rows = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def forms(rest: str) -> Iterator[tuple[str, str]]:
    """(deleted, masked): the rest of a word without each of its letters, and with each masked."""
    for i in range(len(rest)):
        yield rest[:i] + rest[i + 1 :], rest[:i] + "\0" + rest[i + 1 :]


class Half:
    """Words that share a half, by what is left of them."""

    __slots__ = ("exact", "shorter", "masked")

    def __init__(self) -> None:
        self.exact: dict[str, tuple[str, int]] = {}
        self.shorter: dict[str, set[str]] = defaultdict(set)
        self.masked: dict[str, list[str]] = defaultdict(list)

    def add(self, rest: str, word: str, n: int) -> None:
        self.exact[rest] = word, n
        for deleted, masked in forms(rest):
            self.shorter[deleted].add(rest)
            self.masked[masked].append(rest)

    def near(self, rest: str) -> set[str]:
        """Rests held that differ from ``rest`` by exactly one letter."""
        out = set(self.shorter.get(rest, ()))
        for deleted, masked in forms(rest):
            if deleted in self.exact:
                out.add(deleted)
            out.update(self.masked.get(masked, ()))
        out.discard(rest)
        return out


def scan(table: pa.Table) -> pa.Table:
    """Near words of a shard: rows (word, n, near, near_n). ``own`` marks words whose half the row's segment is, so that it is in this shard's automaton."""
    columns = [table.column(c).to_pylist() for c in ("left", "segment", "word", "n", "own")]
    halves: dict[tuple[bool, str], Half] = {}
    everything = {}
    for left, segment, word, n, own in zip(*columns):
        everything[word] = n
        if own:
            rest = word[len(segment) :] if left else word[: len(word) - len(segment)]
            halves.setdefault((left, segment), Half()).add(rest, word, n)
    out: list[tuple] = []
    if halves:
        automaton = ahocorasick.Automaton()
        for _, segment in halves:
            automaton.add_word(segment, segment)
        automaton.make_automaton()
        for word, n in everything.items():
            seen = set()
            for end, segment in automaton.iter(word):
                for left in (True, False):
                    half = halves.get((left, segment))
                    # a beginning must stand at the word's beginning, and an end at its end
                    if half is None or end + 1 != (len(segment) if left else len(word)):
                        continue
                    for rest in half.near(word[len(segment) :] if left else word[: len(word) - len(segment)]):
                        seen.add(half.exact[rest])
            out += [(word, n, *x) for x in seen]
    w, n, x, m = zip(*out) if out else ((), (), (), ())
    return pa.table({"word": pa.array(w, pa.string()), "n": pa.array(n, pa.int64()), "near": pa.array(x, pa.string()), "near_n": pa.array(m, pa.int64())})


PAIR = "word string, n long, near string, near_n long"


def _segments(vocabulary: DataFrame) -> DataFrame:
    """(left, segment, word, n, own): beginnings and ends of each word that can be halves of words of its length or one more or less."""
    size = F.length("word")
    half = lambda l: F.floor(l / 2).cast("int")  # noqa: E731, E741
    lengths = [size - 1, size, size + 1]

    def side(left: bool, of) -> Column:
        cut = F.array_distinct(F.array(*map(of, lengths)))
        take = (lambda c: F.substring("word", F.lit(1), c)) if left else (lambda c: F.substring("word", size - c + 1, c))
        return F.transform(cut, lambda c: F.struct(F.lit(left).alias("left"), take(c).alias("segment"), (c == of(size)).alias("own")))

    each = F.explode(F.concat(side(True, half), side(False, lambda l: l - half(l))))  # noqa: E741
    return vocabulary.select("word", "n", each.alias("s")).select("s.left", "s.segment", "word", "n", "s.own")


def _joined(rows: DataFrame) -> DataFrame:
    """Near words among the rows of hot halves, by a join of the forms of what is left; at most a letter's choices share a form."""
    segment = F.length("segment")
    rest = F.when(F.col("left"), F.expr("substring(word, length(segment) + 1)")).otherwise(F.substring("word", F.lit(1), F.length("word") - segment))
    rows = rows.withColumn("rest", rest)
    places = F.when(F.length("rest") > 0, F.sequence(F.lit(1), F.length("rest"))).otherwise(F.array().cast("array<int>"))
    part = lambda i, mark: F.concat(F.substring("rest", F.lit(1), i - 1), F.lit(mark), F.substring("rest", i + 1, F.length("rest")))
    deleted, masked = F.transform(places, lambda i: part(i, "")), F.transform(places, lambda i: part(i, "\0"))
    key = lambda kind, forms_: F.transform(forms_, lambda x: F.concat(F.lit(kind), x))
    whole = F.array(F.col("rest"))
    held = rows.filter("own").select("left", "segment", F.explode(F.array_distinct(F.concat(key("=", whole), key("-", deleted), key("?", masked)))).alias("form"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    asked = rows.select("left", "segment", F.explode(F.array_distinct(F.concat(key("=", deleted), key("-", whole), key("?", masked)))).alias("form"), "word", "n")
    return asked.join(held, ["left", "segment", "form"]).filter("word != near").select("word", "n", "near", "near_n")


def near_words(vocabulary: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by exactly one inserted, deleted or replaced letter, both ways. ``vocabulary`` is (word, n), each word once."""
    spark = vocabulary.sparkSession
    rows = stored(_segments(vocabulary), "variant-segments")
    # halves that a task shouldn't hold; there are fewer than rows / hot of them
    sizes = stored(rows.groupBy("left", "segment").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("left", "segment"), "variant-hot")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // shard))
    some = not sizes.isEmpty()
    calm = rows.join(sizes, ["left", "segment"], "left_anti") if some else rows
    calm = calm.withColumn("shard", F.pmod(F.xxhash64("left", "segment"), F.lit(shards)))
    found = calm.groupBy("shard").applyInArrow(lambda t: scan(t), PAIR)
    if some:
        found = found.unionByName(_joined(rows.join(sizes, ["left", "segment"], "left_semi")))
    return found.distinct()  # a pair may share both halves


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where following ``form`` from each word of (word, form) ends, by pointer jumping. Forms occur more and more often, so that there are no cycles."""
    now = stored(links.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = stored(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "variant-roots")
        discard(now)
        now = new
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, every: int = EVERY, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words that occur at least ``min_count`` times.

    A word's form is the near word that occurs most often (of equals the first in code-point order), if that is at least
    ``ratio`` times as often as the word; its root is where following forms ends.
    """
    vocabulary = stored(words(docs, key, text, least, every).filter(F.col("n") >= min_count), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    summary = near_words(vocabulary, shard, hot).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = vocabulary.join(summary, "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "variant-forms")
    ends = roots(known.filter("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
