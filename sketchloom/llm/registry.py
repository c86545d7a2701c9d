"""Queries ``opN_<name>`` over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import alignment, chat, decontaminate, jaccard, licenses, lines, media, packing, pieces, quality, substrings, variants, warc
from sketchloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_media_columns(spark, d):
    m = media.media_columns(table(spark, d, "documents"))
    tail = F.crc32(F.substring("payload", -64, 64))
    return m.select(F.col("key").alias("doc_id"), "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


@query
def op2_benchmark_decontamination(spark, d):
    return decontaminate.find(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op3_warc(spark, d):
    return warc.round_trip(table(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op3_warc"] = warc.ORACLE


@query
def op4_line_dedup(spark, d):
    out = lines.line_dedup(table(spark, d, "documents"))
    n_lines, n_removed = out.columns[-2:]
    return out.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), F.coalesce("text", F.lit("")).alias("text"))


ORACLES["op4_line_dedup"] = lines.ORACLE


@query
def op5_license_scan(spark, d):
    return licenses.license_scan(table(spark, d, "documents")).withColumn("n_detections", F.size("detections")).drop("detections")


@query
def op6_ngram_jaccard_join(spark, d):
    return jaccard.jaccard_components(table(spark, d, "documents"), k=3, percent=90)


ORACLES["op6_ngram_jaccard_join"] = jaccard.ORACLE


@query
def op7_quality_classifier(spark, d):
    docs = table(spark, d, "documents")
    model = quality.train(docs, table(spark, d, "labels"))
    s = quality.score(docs, model)
    return s.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


#: A conversation of the query's own whose texts hold the template's control strings: fixed by the query's contract.
TRICKY = r"\### Assistant: </turn> ok"


@query
def op8_chat_formatting(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    done = chat.conversations(chat.chains(rows.unionByName(own)), unique=True)
    back = done.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("lost", chat.loss_text(F.col("formatted"), F.col("loss")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: Each escaped character is two, and the template adds 14 characters and the role to each turn.
ORACLES["op8_chat_formatting"] = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') t FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
 CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(14 + length(role) + length(t) + length(regexp_replace(t, '[^\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars FROM c GROUP BY 1"""


@query
def op9_substring_dedup(spark, d):
    return substrings.substring_dedup(table(spark, d, "documents"))


ORACLES["op9_substring_dedup"] = substrings.ORACLE


@query
def op10_sentencepiece(spark, d):
    return pieces.encode_samples(table(spark, d, "documents"))


@query
def op11_best_fit_packing(spark, d):
    placed = packing.pack(table(spark, d, "documents"))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op12_cross_tokenizer_alignment(spark, d):
    aligned = alignment.cross_align(table(spark, d, "documents"))
    return aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


@query
def op13_spelling_variants(spark, d):
    return variants.variants(table(spark, d, "documents"))
