"""Space-Saving summaries: the heaviest items with bounds on their counts.

A summary keeps at most ``capacity`` counters, ordered by count (largest first), error, item. For each of them
count - error <= actual count <= count, and an item without a counter has at most ``m``. Floating-point zeros of either
sign are one item, as are all NaNs; NULL items are skipped. Items may be arrays, structs or maps, whose entries count
whatever their order; maps within other items can't be counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush, nsmallest
from itertools import repeat
from numbers import Integral

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sketchloom.functions.checks import integral_weight, key_list
from sketchloom.functions.types import space_saving
from sketchloom.sources.tables import load, save, scratch

_NAN = float("nan")
#: Counters of a key, in capacities, at which a task trims them; counters of all keys before it passes them on.
SLACK, HELD = 8, 500_000
#: Rows, or bytes of them, that a task counts at a time.
ROWS, BYTES = 1 << 19, 32 << 20
#: Ranks up to which Spark itself trims within each task before a shuffle; with larger capacities counters are dealt to so many parts first.
SPARK_RANKS, PARTS = 1000, 32
#: Parts where the capacity is only known from the summaries, each of which has a row in every part.
FEW = 8


def _capacity(capacity: int) -> int:
    if isinstance(capacity, bool) or not isinstance(capacity, Integral):
        raise TypeError("capacity must be a whole number")
    if capacity <= 0:
        raise ValueError("capacity must be > 0")
    return int(capacity)


def _item(df: DataFrame, item: str) -> tuple[Column, T.DataType, bool]:
    """Item expression, its type, and whether it travels as JSON."""
    kind = df.schema[item].dataType
    if isinstance(kind, T.VariantType) or _maps_inside(kind):
        raise TypeError(f"{kind.simpleString()} can't be counted")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.when(F.col(item).isNotNull(), _code(F.col(item), kind)), kind, True
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.col(item).cast("double") + F.lit(0.0), T.DoubleType(), False
    return F.col(item), kind, False


def _maps_inside(kind: T.DataType) -> bool:
    """Whether maps stand inside an item, where their entries have no order."""
    inner = [f.dataType for f in kind] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.keyType, kind.valueType] if isinstance(kind, T.MapType) else []
    return any(isinstance(k, (T.MapType, T.VariantType)) or _maps_inside(k) for k in inner)


def _by_parts(kind: T.DataType) -> bool:
    """Whether an array or a struct is told apart by parts of which Arrow knows equality and order, so that it needs no text."""
    if isinstance(kind, T.ArrayType):
        return _by_parts(kind.elementType)
    if isinstance(kind, T.StructType):
        return 0 < len(set(kind.names)) == len(kind) and all(_by_parts(f.dataType) for f in kind)
    return kind == T.StringType() or isinstance(kind, (T.IntegralType, T.BooleanType, T.DateType))


def _code(c: Column, kind: T.DataType) -> Column:
    """Text that equal composite items share: JSON, of maps with entries in order of their keys."""
    if isinstance(kind, T.MapType):
        c = F.map_from_entries(F.array_sort(F.map_entries(c)))
    return F.to_json(c)


def _decoded(s: Column, kind: T.DataType) -> Column:
    """A summary of codes as one of items, of which equal counts are in the order of items that have one."""
    read = F.transform(s["counters"], lambda c: F.struct(F.from_json(c["item"], kind).alias("item"), c["count"].alias("count"), c["error"].alias("error")))
    if not isinstance(kind, T.MapType):
        ranked = F.array_sort(F.transform(read, lambda c: F.struct((-c["count"]).alias("a"), c["error"].alias("b"), c["item"].alias("c"))))
        read = F.transform(ranked, lambda c: F.struct(c["c"].alias("item"), (-c["a"]).alias("count"), c["b"].alias("error")))
    return F.struct(s["capacity"].alias("capacity"), s["m"].alias("m"), read.alias("counters"))


def _rank(kv: tuple) -> tuple:
    item, (count, error) = kv
    return -count, error, item != item, item


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they have ROWS rows or BYTES bytes, so that repeated items meet before Python sees them."""
    held, n, size = [], 0, 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        size += b.nbytes
        if n >= ROWS or size >= BYTES:
            yield pa.Table.from_batches(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


class _Counts:
    __slots__ = ("counts", "m")

    def __init__(self) -> None:
        self.counts: dict = {}
        self.m = 0

    def add(self, item, n: int) -> None:
        had = self.counts.get(item)
        self.counts[item] = (had[0] + n, had[1]) if had else (n + self.m, self.m)

    def trim(self, capacity: int) -> None:
        """Keeps the heaviest. Only those that tie with the least count kept are ranked further."""
        if len(self.counts) <= capacity:
            return
        n = np.fromiter((c for c, _ in self.counts.values()), np.int64, len(self.counts))
        least = int(np.partition(n, len(n) - capacity)[len(n) - capacity])
        kept = {i: v for i, v in self.counts.items() if v[0] > least}
        kept.update(nsmallest(capacity - len(kept), (kv for kv in self.counts.items() if kv[1][0] == least), key=_rank))
        self.m, self.counts = max(self.m, least), kept

    def ranked(self, capacity: int) -> list:
        self.trim(capacity)
        return sorted(self.counts.items(), key=_rank)


class _Column:
    """``_Counts`` in arrays, for tasks without keys and items whose equality Arrow shares with us."""

    def __init__(self, kind: pa.DataType) -> None:
        self.items, self.m = pa.array([], kind), 0
        self.n = self.e = np.empty(0, np.int64)

    def add(self, items: pa.Array, n: np.ndarray) -> None:
        """Items must be distinct and not NULL."""
        at = pc.fill_null(pc.index_in(items, value_set=self.items), -1).to_numpy()
        new = at < 0
        self.n[at[~new]] += n[~new]
        self.items = pa.concat_arrays([self.items, items.filter(pa.array(new))])
        self.n = np.concatenate([self.n, n[new] + self.m])
        self.e = np.concatenate([self.e, np.full(int(new.sum()), self.m, np.int64)])

    def trim(self, capacity: int) -> None:
        if len(self.n) <= capacity:
            return
        least = int(np.partition(self.n, len(self.n) - capacity)[len(self.n) - capacity])
        above, level = np.flatnonzero(self.n > least), np.flatnonzero(self.n == least)
        if len(above) + len(level) > capacity:
            level = self.first(level, capacity - len(above))
        kept = np.sort(np.concatenate([above, level]))
        self.m, self.items, self.n, self.e = max(self.m, least), self.items.take(pa.array(kept)), self.n[kept], self.e[kept]

    def first(self, level: np.ndarray, k: int) -> np.ndarray:
        """The k of equal count that come first by error and item."""
        ties = zip(self.e[level].tolist(), self.items.take(pa.array(level)).to_pylist(), level.tolist())
        return np.array([i for _, _, i in nsmallest(k, ties)], np.int64)

    def state(self, capacity: int, kind: pa.StructType) -> pa.Array:
        self.trim(capacity)
        ranked = sorted(zip(self.items.to_pylist(), zip(self.n.tolist(), self.e.tolist())), key=_rank)
        return pa.array([{"capacity": capacity, "counters": [{"item": i, "count": c, "error": e} for i, (c, e) in ranked], "m": self.m}], type=kind)


class _Parts(_Column):
    """``_Column`` of arrays or structs, kept in their order: they meet by ranks, since Arrow doesn't group or look them up."""

    def add(self, items: pa.Array, n: np.ndarray) -> None:
        """Items may repeat, and must not be NULL."""
        both = pa.concat_arrays([self.items, items])
        rank = _ranks(both)
        order = np.argsort(rank, kind="stable")  # an item's counter before its new rows
        start = np.flatnonzero(np.diff(rank[order], prepend=-1))
        at = order[start]
        sums = np.add.reduceat(np.concatenate([self.n, n])[order], start)
        self.n = sums + np.where(at < len(self.items), 0, self.m)
        self.e = np.concatenate([self.e, np.full(len(items), self.m, np.int64)])[at]
        self.items = both.take(pa.array(at))

    def first(self, level: np.ndarray, k: int) -> np.ndarray:
        return level[np.lexsort((level, self.e[level]))[:k]]

    def state(self, capacity: int, kind: pa.StructType) -> pa.Array:
        self.trim(capacity)
        by = np.lexsort((self.e, -self.n))
        counters = kind.field("counters").type
        columns = {"item": self.items.take(pa.array(by)), "count": pa.array(self.n[by]), "error": pa.array(self.e[by])}
        each = [counters.value_type.field(i) for i in range(counters.value_type.num_fields)]
        listed = pa.StructArray.from_arrays([columns[f.name].cast(f.type) for f in each], fields=each)
        whole = {"capacity": pa.array([capacity], pa.int32()), "m": pa.array([self.m], pa.int64()), "counters": pa.ListArray.from_arrays(pa.array([0, len(by)], pa.int32()), listed, type=counters)}
        fields = [kind.field(i) for i in range(kind.num_fields)]
        return pa.StructArray.from_arrays([whole[f.name] for f in fields], fields=fields)


def _ranks(a: pa.Array) -> np.ndarray:
    """Numbers up to the array's length that values share only with equal ones, in their order: NULLs first, lists and structs by their parts."""
    if not pa.types.is_nested(a.type):
        d = a.dictionary_encode()
        rank = np.zeros(len(d.dictionary) + 1, np.int64)  # the last one is NULL's
        rank[pc.sort_indices(d.dictionary).to_numpy()] = np.arange(1, len(rank))
        return rank[pc.fill_null(d.indices, -1).to_numpy()]
    valid = a.is_valid().to_numpy(zero_copy_only=False)
    rank = np.where(valid, len(a) - int(valid.sum()), 0)
    at = np.flatnonzero(valid)
    if pa.types.is_struct(a.type):
        for field in a.flatten():
            at, _ = _refine(rank, at, _ranks(field)[at])
        return rank
    parts = np.append(_ranks(a.flatten()) + 1, 0)
    size = pc.fill_null(pc.list_value_length(a), 0).to_numpy().astype(np.int64)
    place = np.cumsum(size) - size
    j = 0
    while len(at):  # a list that has ended comes before those that go on
        at, part = _refine(rank, at, np.where(size[at] > j, parts[np.minimum(place[at] + j, len(parts) - 1)], 0))
        at = at[part > 0]
        j += 1
    return rank


def _refine(rank: np.ndarray, at: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks ``at`` some places, where all of equal rank are, go by a next part too; returns places that still share one, and their parts.

    A rank is the number of values that are known to be less.
    """
    if not len(at):
        return at, part
    order = np.argsort(rank[at] * (int(part.max()) + 1) + part)
    at, part = at[order], part[order]
    was = np.diff(rank[at], prepend=-1) != 0
    new = was | (np.diff(part, prepend=-1) != 0)
    place = np.arange(len(at))
    rank[at] += np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(was, place, 0))
    shared = ~(new & np.append(new[1:], True))
    return at[shared], part[shared]


def _partial_of_all(batches: Iterator[pa.RecordBatch], capacity: int, schema: pa.Schema, each: int = 1) -> Iterator[pa.RecordBatch]:
    """``_partial`` without keys. Rows without a count have ``each``."""
    held = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([held.state(capacity, schema.field(0).type)], schema=schema)

    for table in _wide(batches):
        if table.num_columns == 1:
            table = table.append_column("__count", pa.repeat(each, table.num_rows).cast(pa.int64()))
        item, count = table.column_names
        kind = table.schema.field(item).type
        nested = pa.types.is_nested(kind)
        sums = table if nested else table.group_by([item]).aggregate([(count, "sum")]).rename_columns([item, count])
        sums = sums.filter(sums.column(item).is_valid()).combine_chunks()
        held = held or (_Parts if nested else _Column)(kind)
        if sums.num_rows:
            held.add(sums.column(item).chunk(0), sums.column(count).to_numpy())
        if len(held.n) > SLACK * capacity:
            held.trim(capacity)
        if len(held.n) >= HELD:
            yield out()
            held = None
    if held is not None:
        yield out()


def _partial(batches: Iterator[pa.RecordBatch], nkeys: int, capacity: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, _Counts] = {}

    def out() -> pa.RecordBatch:
        states = [{"capacity": capacity, "counters": [{"item": i, "count": c, "error": e} for i, (c, e) in k.ranked(capacity)], "m": k.m} for k in held.values()]
        columns = [pa.array([k[i] for k in held], type=schema.field(i).type) for i in range(nkeys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(states, type=schema.field(nkeys).type)], schema=schema)

    for table in _wide(batches):
        names = table.column_names
        columns = [c.to_pylist() for c in table.group_by(names[:-1]).aggregate([(names[-1], "sum")]).select([*names[:-1], f"{names[-1]}_sum"]).columns]
        for key in zip(*columns[:nkeys]) if nkeys else [()]:
            if key not in held:
                held[key] = _Counts()
        last = object()
        for key, item, n in zip(zip(*columns[:nkeys]) if nkeys else repeat(()), columns[-2], columns[-1]):
            if key != last:
                counts, last = held[key], key
            if item is not None:
                counts.add(_NAN if item != item else item, n)
            if len(counts.counts) > SLACK * capacity + ROWS:
                counts.trim(capacity)
        for counts in held.values():
            if len(counts.counts) > SLACK * capacity:
                counts.trim(capacity)
        if sum(len(k.counts) + 1 for k in held.values()) > HELD:
            yield out()
            held = {}
    if held:
        yield out()


def build(df: DataFrame, keys, item: str, count: str | int = 1, capacity: int = 20, out: str = "summary") -> DataFrame:
    """One summary for each key: each task counts and trims its own rows, then summaries are merged natively."""
    keys, capacity = key_list(keys), _capacity(capacity)
    value, kind, as_json = _item(df, item)
    if as_json and not keys and _by_parts(kind):
        value, as_json = F.col(item), False
    rows = df.select(*keys, value.alias("__item"), integral_weight(df, count).alias("__count"))
    carried = T.StringType() if as_json else kind
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(out, space_saving(carried))])
    # NaNs are one item whatever their bits, which Arrow doesn't know
    whole = not keys and not isinstance(carried, T.DoubleType)
    count_rows = partial(_partial, nkeys=len(keys), capacity=capacity)
    if whole:
        count_rows = partial(_partial_of_all, capacity=capacity, each=1 if isinstance(count, str) else int(count))
        rows = rows if isinstance(count, str) else rows.drop("__count")  # a number is not sent with each row
    sketches = rows.mapInArrow(partial(count_rows, schema=to_arrow_schema(schema)), schema)
    merged = merge(sketches, keys, out, capacity)
    if as_json:
        merged = merged.withColumn(out, _decoded(F.col(out), kind))
    return merged


def merge(df: DataFrame, keys, summary: str = "summary", capacity: int | None = None) -> DataFrame:
    """Merges the summaries of each key by native aggregation: counts and errors add, and where a summary lacks an item its ``m`` counts instead.

    The capacity is the given one, else the largest among the key's summaries. Capacities may differ. Summaries are read
    once: each gives a row for itself, with its capacity and m, and one for each counter, less m. Rows are summed by item,
    and ranked within each key; with a given capacity only its heaviest counters of each task or part go on to that.
    """
    keys = key_list(keys)
    if [f.name for f in getattr(df.schema[summary].dataType, "fields", [])] != ["capacity", "m", "counters"]:
        raise TypeError(f"{summary} is not a column of Space-Saving summaries")
    if capacity is not None:
        capacity = _capacity(capacity)
    kind = df.schema[summary].dataType["counters"].dataType.elementType["item"].dataType
    if isinstance(kind, T.MapType):  # maps have no order: their codes are merged
        s = F.col(summary)
        codes = F.transform(s["counters"], lambda c: F.struct(_code(c["item"], kind).alias("item"), c["count"].alias("count"), c["error"].alias("error")))
        coded = df.select(*keys, F.when(s.isNotNull(), F.struct(s["capacity"].alias("capacity"), s["m"].alias("m"), codes.alias("counters"))).alias(summary))
        return merge(coded, keys, summary, capacity).withColumn(summary, _decoded(F.col(summary), kind))
    s, zero = F.col(summary), F.lit(0).cast("long")
    entry = lambda item, n, e, whole: F.struct(item.alias("item"), n.alias("n"), e.alias("e"), F.lit(whole).alias("whole"))
    # without a given capacity each part has rows of all summaries, and so knows how many counters to keep
    part = F.lit(0) if capacity is not None else F.pmod(F.xxhash64("__c.item"), F.lit(FEW))
    own = F.array(*[entry(F.lit(None).cast(kind), zero, zero, True)] * (1 if capacity is not None else FEW))
    each = F.transform(s["counters"], lambda c: entry(c["item"], c["count"] - s["m"], c["error"] - s["m"], False))
    rows = df.filter(s.isNotNull()).select(*keys, s["m"].alias("__m"), s["capacity"].alias("__cap"), F.posexplode(F.concat(own, F.coalesce(each, F.slice(own, 1, 0)))).alias("__at", "__c"))
    part = F.when(F.col("__c.whole"), F.col("__at")).otherwise(part).alias("__of")
    items = rows.groupBy(*keys, part, F.col("__c.whole").alias("__whole"), F.col("__c.item").alias("__item")).agg(F.sum("__c.n").alias("__n"), F.sum("__c.e").alias("__e"), F.sum("__m").alias("__m"), F.max("__cap").alias("__cap"))
    order = [F.desc("__whole"), F.desc("__n"), "__e", "__item"]
    # the row of the summaries themselves has rank 1; one more counter than is kept tells whether any was cut
    if capacity is not None and capacity + 2 > SPARK_RANKS:
        part = Window.partitionBy(*keys, F.pmod(F.xxhash64("__item"), F.lit(PARTS))).orderBy(*order)
        items = items.withColumn("__part", F.row_number().over(part)).filter(F.col("__part") <= capacity + 2)
    if capacity is None:
        of = Window.partitionBy(*keys, "__of")
        items = items.withColumn("__most", F.max("__cap").over(of)).withColumn("__part", F.row_number().over(of.orderBy(*order)))
        items = items.filter((F.col("__part") <= F.col("__most") + 2) & (~F.col("__whole") | (F.col("__of") == 0)))
    by_key = Window.partitionBy(*(keys or [F.lit(1)]))
    ranked = items.withColumn("__rank", F.row_number().over(by_key.orderBy(*order)))
    if capacity is None:
        ranked = ranked.withColumn("__cap", F.max("__cap").over(by_key))
        kept, cap = ranked.filter(F.col("__rank") <= F.col("__cap") + 2), F.coalesce(F.max("__cap"), F.lit(20))
    else:
        kept, cap = ranked.filter(F.col("__rank") <= capacity + 2), F.lit(capacity)
    one = F.struct(F.col("__rank").alias("rank"), F.col("__item").alias("item"), F.col("__n").alias("n"), F.col("__e").alias("e"))
    done = kept.groupBy(*keys).agg(cap.cast("int").alias("__cap"), F.coalesce(F.max(F.when(F.col("__whole"), F.col("__m"))), zero).alias("__m"), F.array_sort(F.collect_list(F.when(~F.col("__whole"), one))).alias("__l"))
    full = F.slice("__l", F.lit(1), F.col("__cap"))
    counters = F.transform(full, lambda c: F.struct(c["item"].alias("item"), (c["n"] + F.col("__m")).alias("count"), (c["e"] + F.col("__m")).alias("error")))
    least = F.col("__m") + F.try_element_at(full, F.lit(-1))["n"]
    m = F.when(F.size("__l") > F.col("__cap"), F.greatest(least, F.col("__m"))).otherwise(F.col("__m"))
    return done.select(*keys, F.struct(F.col("__cap").alias("capacity"), m.cast("long").alias("m"), counters.alias("counters")).alias(summary))


def _in_order(batches: Iterator[pa.RecordBatch], nkeys: int, capacity: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and order; one counter set is held at a time."""
    last, held, queue, turn = None, {}, [], 0

    def out() -> pa.RecordBatch:
        ranked = sorted(held.items(), key=lambda kv: (-kv[1][0], kv[1][1], kv[1][2]))
        state = {"capacity": capacity, "m": max((e for _, e, _ in held.values()), default=0) if len(held) < capacity else min(c for c, _, _ in held.values()), "counters": [{"item": i, "count": c, "error": e} for i, (c, e, _) in ranked]}
        return pa.RecordBatch.from_arrays([*(pa.array([last[i]], type=schema.field(i).type) for i in range(nkeys)), pa.array([state], type=schema.field(nkeys).type)], schema=schema)

    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for key, item, n in zip(zip(*columns[:nkeys]) if nkeys else repeat(()), columns[-2], columns[-1]):
            if key != last:
                if last is not None:
                    yield out()
                last, held, queue = key, {}, []
            if item is None:
                continue
            item = _NAN if item != item else item
            turn += 1
            if item in held:
                count, error, _ = held[item]
                held[item] = count + n, error, turn
            elif len(held) < capacity:
                held[item] = n, 0, turn
            else:  # the least count goes; among equals the largest error, then what moved last
                while True:
                    count, error, moved, lost = heappop(queue)
                    if held.get(lost) == (count, -error, -moved):
                        break
                del held[lost]
                held[item] = count + n, count, turn
            count, error, _ = held[item]
            heappush(queue, (count, -error, -turn, item))
            if len(queue) > 8 * capacity + 64:
                queue = [(c, -e, -t, i) for i, (c, e, t) in held.items()]
                heapify(queue)
    if last is not None:
        yield out()


def build_in_order(df: DataFrame, keys, item: str, order, count: str | int = 1, capacity: int = 20, out: str = "summary") -> DataFrame:
    """One summary for each key by the sequential algorithm: rows are offered one by one, as ``order`` sorts them.

    When all counters are taken, a new item takes over the one with the least count, which becomes its error; among
    equals the one with the largest error goes, then the one that moved last. Keys of at most ``capacity`` items never
    evict, and are counted in the tasks that have their rows. Another key's rows are one task's, which sorts them on disk
    if need be and holds its counters; use ``build`` where the order of rows doesn't matter. Keys without rows have no summary.
    """
    keys, capacity = key_list(keys), _capacity(capacity)
    value, kind, as_json = _item(df, item)
    if as_json:
        raise TypeError("arrays, structs and maps can't be counted in order")
    by = [F.col(c) for c in key_list(order)]
    rows = df.select(*keys, *(c.alias(f"__o{i}") for i, c in enumerate(by)), value.alias("__item"), integral_weight(df, count).alias("__count"))
    state = space_saving(kind)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(out, state)])
    order = [f"__o{i}" for i in range(len(by))]
    # keys whose items all have room never evict: counts don't depend on the order, ties are ranked by an item's last row
    last = F.max(order[0] if len(order) == 1 else F.struct(*order))
    items = rows.groupBy(*keys, "__item").agg(F.sum("__count").alias("__n"), last.alias("__last"))
    few = F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.asc_nulls_first("__item")))
    each = F.struct((-F.col("__n")).alias("a"), F.col("__last").alias("b"), F.col("__item").alias("c"))
    listed = items.withColumn("__at", few).filter(F.col("__at") <= capacity + 2).groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("__item").isNotNull(), each))).alias("__l"), F.count("*").alias("__rows"))
    listed = listed.filter("__rows > 0")
    zero = F.lit(0).cast("long")
    counted = F.transform("__l", lambda c: F.struct(c["c"].alias("item"), (-c["a"]).alias("count"), zero.alias("error")))
    m = F.when(F.size("__l") == capacity, -F.try_element_at("__l", F.lit(-1))["a"]).otherwise(zero)
    roomy = listed.filter(F.size("__l") <= capacity).select(*keys, F.struct(F.lit(capacity).cast("int").alias("capacity"), m.alias("m"), counted.alias("counters")).cast(state).alias(out))
    crowded = listed.filter(F.size("__l") > capacity)
    crowded = crowded.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.lit(True).alias("__crowded"))
    if keys:
        rows = rows.join(crowded, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left_semi")
    else:
        rows = rows.crossJoin(F.broadcast(crowded))  # a row or none
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, *order).select(*keys, "__item", "__count")
    evicting = rows.mapInArrow(partial(_in_order, nkeys=len(keys), capacity=capacity, schema=to_arrow_schema(schema)), schema)
    return roomy.unionByName(evicting)


def topk(s, k: int) -> Column:
    """The first k counters (all, if there are fewer), heaviest first."""
    if isinstance(k, bool) or not isinstance(k, Integral):
        raise TypeError("k must be a whole number")
    if k < 0:
        raise ValueError("k must be >= 0")
    c = (F.col(s) if isinstance(s, str) else s)["counters"]
    return F.slice(c, 1, int(k))


def counters(s) -> Column:
    return (F.col(s) if isinstance(s, str) else s)["counters"]


def size(s) -> Column:
    """Number of counters in use."""
    return F.size(counters(s))


def capacity(s) -> Column:
    return (F.col(s) if isinstance(s, str) else s)["capacity"]


def valid(s) -> Column:
    """Whether a stored summary is sound: no more counters than its capacity, no item twice."""
    c = counters(s)
    items = F.transform(c, lambda x: x["item"])
    return (F.size(c) <= capacity(s)) & (F.size(F.array_distinct(items)) == F.size(c))


def describe(s) -> Column:
    return F.format_string("space_saving(capacity=%d, size=%d)", capacity(s), size(s))


def certain_topk(df: DataFrame, item: str, k: int, count: str | int = 1, capacity: int = 20) -> DataFrame:
    """The k heaviest items with exact counts, ties by item; a summary says which items have to be counted.

    A summary that dropped nothing is exact. Else the items without a counter weigh at most ``m``: if k counters are
    surely heavier, only counters that may be as heavy as the last of these are counted again, and if not, all items,
    in as many tasks as the rows are. The driver reads three numbers.
    """
    path = scratch(df.sparkSession, "summary")
    save(build(df, None, item, count, capacity), path)
    s = load(df.sparkSession, path)
    if not s.select("summary.m").first().m:
        return s.select(F.inline(topk("summary", k)))
    return recounted_topk(df, s, item, k, count)


def recounted_topk(df: DataFrame, summaries: DataFrame, item: str, k: int, count: str | int = 1) -> DataFrame:
    """The k heaviest items by counts of the rows themselves, where the table's one summary of these rows says which may be among them; else by those of all items."""
    value, kind, as_json = _item(df, item)
    if as_json and _by_parts(kind):
        value, as_json = F.col(item), False
    surely = F.sort_array(F.transform("summary.counters", lambda c: c["count"] - c["error"]), asc=False)
    m, least = summaries.select("summary.m", F.try_element_at(surely, F.lit(max(1, k)))).first()
    if least is not None and least > m:
        may = summaries.select(F.inline("summary.counters")).filter(F.col("count") >= least).select((_code(F.col("item"), kind) if as_json else F.col("item")).alias("__may"))
        df = df.join(F.broadcast(may), value == F.col("__may"), "left_semi")  # at most ``capacity`` items
    return exact_topk(df, None, item, k, count)


def exact_topk(df: DataFrame, keys, item: str, k: int, count: str | int = 1) -> DataFrame:
    """Exact counts by one aggregation; rank 1..k within each key, ties by item."""
    keys = key_list(keys)
    value, kind, as_json = _item(df, item)
    rows = df.select(*keys, (F.col(item) if as_json else value).alias("item"), integral_weight(df, count).alias("__count")).filter(F.col("item").isNotNull())
    counts = rows.groupBy(*keys, "item").agg(F.sum("__count").alias("count"))
    if not keys:
        return counts.orderBy(F.desc("count"), "item").limit(k).select("item", "count", F.lit(0).cast("long").alias("error"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "item"))
    return counts.withColumn("__r", rank).filter(F.col("__r") <= k).select(*keys, "item", "count", F.lit(0).cast("long").alias("error"))
