"""Line dedup by distinct-site spread.

Each line's sites are gathered in a HyperLogLog sketch by its hash of 128 bits; partial sketches are made before the shuffle and
merged after it, so that a line on very many pages is no burden. Lines whose estimate is clearly above the threshold are
boilerplate, lines clearly below aren't, and those near it get an exact distinct count.

Boilerplate lines are then removed from all documents, whatever their share. With ``spare``, which a pipeline needs that
looks for near-duplicates later, documents stay whole that consist of boilerplate by more than that share of their
characters and are shown to be copies: all their lines that aren't blank are boilerplate, or a document with another id
has the same lines (in any order, as often).

Rows are joined with their boilerplate by a hash of id and text, so that rows that share an id, or have none, spread out.

Defined cases: a NULL text stays NULL and has no lines; an empty text is one empty line; lines are compared without
spaces at their ends; blank lines are never boilerplate, nor are those under ``min_chars``, for who wants to spare short
ones; a NULL site is a site of its own; repeated rows are
treated alike, each on its own; a NULL id is an id like others. Columns of whatever names stay as they are; where one of
them has the name of a count, that count's name gets underscores before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.common import fresh, stored

MIN_SITES, MIN_CHARS = 5, 1
#: log2 of the sketch's registers, and the band around the threshold that is counted exactly: over six standard errors.
LG_K, MARGIN = 12, 0.1


def _hash(line: Column) -> Column:
    """128 bits of the line's SHA-256: as many as two independent hashes have, and nobody can make lines that collide."""
    return F.substring(F.unhex(F.sha2(F.trim(line).cast("binary"), 256)), 1, 16)


def _signature(text: Column) -> Column:
    """Of a document's lines, whatever their order."""
    whole = F.array_join(F.sort_array(F.transform(F.split(text, "\n"), lambda x: F.hex(_hash(x)))), ",")
    return F.substring(F.unhex(F.sha2(F.concat(F.lit("\0lines"), whole).cast("binary"), 256)), 1, 16)


def _copied(signatures: DataFrame) -> DataFrame:
    """Signatures that documents of different ids have; a NULL id is an id like others."""
    n, ids = F.count("*"), F.count("id")
    seen = signatures.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), n.alias("n"), ids.alias("ids"))
    return seen.filter("lo != hi OR (ids > 0 AND ids < n)").select("h")


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Hashes ``h`` of the lines that at least ``min_sites`` distinct sites have."""
    rows = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("\0null")).alias("site"), F.explode(F.split(text, "\n")).alias("line"))
    lines = rows.filter(F.length(F.trim("line")) >= min_chars).select(_hash(F.col("line")).alias("h"), "site")
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("est"))
    likely = stored(spread.filter(F.col("est") >= min_sites * (1 - MARGIN)), "line-spread")
    sure = likely.filter(F.col("est") > min_sites * (1 + MARGIN)).select("h")
    near = likely.filter(F.col("est") <= min_sites * (1 + MARGIN)).select("h")
    # line and site are made distinct first, by partial aggregates: a line that very many documents have is a few rows in the join
    pairs = lines.groupBy("h", "site").agg(F.lit(1).alias("one"))
    counts = pairs.join(near, "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    return sure.unionByName(counts.filter(F.col("n") >= min_sites).select("h"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, spare: float | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with boilerplate lines taken out of the text, and last __n_lines and __n_removed.

    Which side of a join is broadcast is left to Spark, which looks at sizes as they turn out; a line that very many
    documents share is split among tasks as a skewed join.
    """
    row, bad_, cut_, n_lines_, n_removed_ = fresh(docs.columns, "__row", "__bad", "__cut", "__n_lines", "__n_removed")
    common = stored(boilerplate(docs, text, site, min_sites, min_chars), "boilerplate")
    who = F.xxhash64(key, text)  # rows that share it by chance get each other's boilerplate lines too, which changes nothing
    each = docs.select(who.alias("row"), F.explode(F.split(text, "\n")).alias("line")).select("row", _hash(F.col("line")).alias("h"), F.length(F.trim("line")).alias("n"))
    each = each.filter(F.col("n") >= min_chars).select("row", "h")
    if spare is not None:  # signatures go the way of line hashes: those of copies end among a row's hits
        signatures = stored(docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), who.alias("row"), _signature(F.col(text)).alias("h")), "line-signatures")
        common = stored(common.unionByName(_copied(signatures)), "line-copies")
        each = each.unionByName(signatures.select("row", "h"))
    hits = stored(each.join(common, "h", "left_semi").groupBy("row").agg(F.collect_set("h").alias("bad")), "line-hits")
    # always by a shuffle, whatever the number of hits: what it costs then follows the documents alone
    rows = docs.withColumn(row, who)
    joined = rows.join(hits.select(F.col("row").alias(f"{row}_"), F.col("bad").alias(bad_)).hint("merge"), F.col(row) == F.col(f"{row}_"), "left")
    lines = F.split(F.col(text), "\n")
    bad = lambda x: (F.length(F.trim(x)) >= min_chars) & F.array_contains(bad_, _hash(x))
    joined = joined.withColumn(cut_, F.when(F.col(bad_).isNotNull(), F.filter(lines, bad)))
    if spare is not None:
        mostly = F.aggregate(cut_, F.lit(0), lambda a, x: a + F.length(x)) > spare * (F.length(text) - (F.size(lines) - 1))
        own = F.exists(lines, lambda x: (F.length(F.trim(x)) > 0) & ~bad(x))
        whole = mostly & (~own | F.array_contains(bad_, _signature(F.col(text))))
        joined = joined.withColumn(cut_, F.when(~whole, F.col(cut_)))
    cut = F.col(cut_).isNotNull()
    kept = F.when(cut, F.array_join(F.filter(lines, lambda x: ~bad(x)), "\n")).otherwise(F.col(text))
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(cut, F.size(cut_)).otherwise(F.lit(0)).cast("long")
    return joined.select(*(kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns), n_lines.alias(n_lines_), n_removed.alias(n_removed_))


ORACLE = """WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
b AS (SELECT trim(line) k FROM l WHERE length(trim(line)) >= 1 GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(1) || 'null')) >= 5),
f AS (SELECT l.*, k IS NOT NULL bad FROM l LEFT JOIN b ON trim(line) = k),
r AS (SELECT doc_id, count(*) n_lines, count(*) FILTER (bad) n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '') t FROM f GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(t, '') AS text FROM documents LEFT JOIN r USING (doc_id)"""
