"""Chat formatting of reply trees, by DataFrame operations only.

A tree's nodes know their parents. Self-joins that double their reach give each node its ancestors at distances 1, 2, 4
and so on, with the path's score so far; leaves are ranked by their path's score within their tree, and the nodes of the
chosen paths are listed by joins over the same distances in reverse. Rows have a fixed size throughout, and there are
about log2(depth) joins each way. Each chosen path is then one conversation.

Template: ``### role: text</turn>`` and a line feed for each turn. In roles and texts ``\\`` becomes ``\\b``, ``#``
becomes ``\\h`` and ``<`` becomes ``\\l`` (in roles, ``:`` becomes ``\\c``), so that no control string can stand inside
a text, and parsing gives back what was put in.

Defined cases: of rows that repeat a tree's node the least counts, by parent, score, role and text; a node
whose parent isn't there is a root; nodes on a cycle, and those that hang from one, have no root and are on no path; a
NULL node is on none, either. In linear conversations: a NULL text or role is empty; rows of a conversation that have the same turn are ordered by role and text,
and repeated rows are turns of their own; a NULL conversation id is an id like others; an empty table gives no
conversations; long texts are taken whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm.common import stored

HEAD, COLON, END = "### ", ": ", "</turn>\n"
#: What stands for each character of the template inside texts; the escape sign itself goes first.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]


def escape(c: Column, pairs=ESCAPES) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def unescape(c: Column, pairs=ESCAPES) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[1]), F.lit(p[0])), [*pairs[1:], pairs[0]], c)


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of linear conversations: each turn replies to the one before it."""
    clean = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("__turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("tree").orderBy("__turn", "role", "text")).cast("long")
    return clean.withColumn("node", n).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: DataFrame, x: str, b: DataFrame, y: str) -> Column:
    return a["tree"].eqNullSafe(b["t"]) & (a[x] == b[y])


def single(nodes: DataFrame) -> DataFrame:
    """One row for each tree and node, the least."""
    rest = F.struct("parent", "score", "role", "text")
    least = nodes.filter("node IS NOT NULL").groupBy("tree", "node").agg(F.min(rest).alias("least"))
    return least.select("tree", "node", *(F.col("least")[c].alias(c) for c in ("parent", "role", "text", "score")))


def paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, node, pos, path_score, rank) of the paths from root to leaf that are chosen: all, or each tree's ``best``.

    ``nodes``: tree, node, parent, score, one row for each node. Ranks go by the sum of scores, then by leaf.
    """
    step = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = step.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    up = step.join(ids, _same(step, "parent", ids, "n"), "left").select("tree", "node", F.col("n").alias("up"), "score", F.lit(1).cast("long").alias("depth"))
    level, jumps = stored(up.withColumn("fresh", F.lit(True)), "chat-step"), []
    done = [level.filter("up IS NULL")]
    most = step.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    # a path has no more nodes than its tree: what then has no root still is on a cycle or below one
    while 1 << len(jumps) < most and not level.filter("up IS NOT NULL").isEmpty():
        active = level.filter("up IS NOT NULL")
        jumps.append(active.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("to")))
        # only trees that still have a node below its distance go on
        trees = active.select(F.col("tree").alias("t")).distinct()
        here = level.join(trees, level["tree"].eqNullSafe(trees["t"]), "left_semi")
        far = here.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        moved = active.join(far, _same(active, "up", far, "n")).select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("depth") + F.col("depth2")).alias("depth"), F.lit(True).alias("fresh"))
        level = stored(here.filter("up IS NULL").withColumn("fresh", F.lit(False)).unionByName(moved), "chat-jump")
        done.append(level.filter("fresh AND up IS NULL"))
    level = reduce(DataFrame.unionByName, done)
    parents = step.filter("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = level.join(parents, _same(level, "node", parents, "n"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    at = leaves.select("tree", F.col("node").alias("leaf"), "node", F.col("depth").alias("pos"), F.col("score").alias("path_score"), rank.alias("rank"))
    if best is not None:
        at = at.filter(F.col("rank") <= best)
    for k in reversed(range(len(jumps))):
        j = jumps[k]
        at = at.unionByName(at.join(j, _same(at, "node", j, "n")).select("tree", "leaf", F.col("to").alias("node"), (F.col("pos") - (1 << k)).alias("pos"), "path_score", "rank"))
        if k % 2 == 0:
            at = stored(at, "chat-paths")  # a union reads its input twice
    return at


def conversations(nodes: DataFrame, best: int | None = None, trained: str = "assistant", unique: bool = False) -> DataFrame:
    """One row for each chosen path: tree, leaf, rank, path_score, formatted, and loss spans (start from 0, length) within it.

    The spans cover the texts, as escaped, of turns whose role is ``trained``. ``unique``: no node is repeated, as after
    ``chains``, so that nothing needs to be done about it.
    """
    blank = F.lit("")
    nodes = nodes.select("tree", "node", "parent", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    nodes = stored(nodes if unique else single(nodes), "chat-nodes")
    p = paths(nodes, best)
    texts = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = p.join(texts, _same(p, "node", texts, "n")).groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    piece = lambda t: F.struct(F.concat(F.lit(HEAD), escape(t["role"], ROLE_ESCAPES), F.lit(COLON)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained).alias("loss"))
    turns = turns.withColumn("pieces", F.transform("turns", piece))
    formatted = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END)
    start = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans")),
        lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.when(x["loss"], F.array_append(a["spans"], F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    )
    return turns.select("tree", "leaf", "rank", "path_score", formatted.alias("formatted"), start.alias("loss"))


def parse(formatted: Column) -> Column:
    """Array of (role, text), read from a formatted conversation."""
    raw = F.split(formatted, r"</turn>\n")
    turns = F.slice(raw, 1, F.size(raw) - 1)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, COLON, 1)
        text = F.substr(p, F.length(role) + len(COLON) + 1)
        return F.struct(unescape(F.substr(role, F.lit(len(HEAD) + 1)), ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
