"""Corpus pipeline: quality, line dedup, near-duplicates, benchmark leaks, and tokens, in this order.

Each stage works on all that its predecessor has kept. All but the last return the columns of ``documents``:

1. quality classifier: documents that score under 0.3 go;
2. line dedup: boilerplate lines that many sites share go, out of all documents but those that consist of
   them mostly and are shown to be copies, which are left to the next stage;
3. n-gram Jaccard join, five words and a similarity of 0.8: of each group the document with the least id stays;
4. benchmark decontamination: documents that hold a test item go;
5. SentencePiece: sampled segmentations of each document, each with its ids.

Rows that share an id are one document to stage 3: it stays or goes with all its rows, of which those that are equal in
all columns count once. Rows with a NULL doc_id have nothing by which that stage could name them and go through it
unchanged. The other stages take each row by itself, whatever its id. Documents without any words belong to no group and
stay. Columns of whatever names stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import decontaminate, jaccard, lines, pieces, quality
from sketchloom.llm.common import discard, fresh, stored, table

ORACLE_SQL = None
THRESHOLD = 0.3
#: Share of boilerplate beyond which a document that is shown to be a copy is left whole to the Jaccard join.
SPARE = 0.5


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "score")
    return quality.score(docs, model, keep=tuple(docs.columns), out=score).filter(F.col(score) >= THRESHOLD).select(_own(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.line_dedup(docs, spare=SPARE).select(_own(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.jaccard_components(docs, k=5, percent=80).filter("doc_id IS NOT NULL")
    ids = stored(groups.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n")), "pipeline-groups")
    known = docs.filter("doc_id IS NOT NULL").join(ids.filter("least = doc_id").select("doc_id").hint("merge"), "doc_id", "left_semi").select(_own(docs))
    again = ids.filter("least = doc_id AND n > 1").select("doc_id")
    if not again.isEmpty():
        known = known.join(again, "doc_id", "left_anti").select(_own(docs)).unionByName(known.join(again, "doc_id", "left_semi").select(_own(docs)).distinct())
    return known.unionByName(docs.filter("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_samples(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to shared storage and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
