"""Corpus pipeline: toxicity, line dedup, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next stage's documents; all but the
last return the columns of documents.

- toxicity: documents with a score of 0.3 or more go. The model is learned
  from the stage's own documents and the ``labels`` table.
- lines: lines of repeated three-line windows are taken out; a document that
  loses all of its lines goes.
- near_duplicates: of documents linked by a Jaccard index of 0.8 or more on
  five-word shingles, directly or over others, the one with the smallest id
  stays.
- mixing: documents are repeated or left out so that sources come near their
  targets.
- packing: the tokens of what is left, in sequences of 1024; a row a piece.

SQL can express neither the toxicity model nor the tokens, so there is no
ORACLE_SQL; tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barquet.llm import jaccard, lines, mixing, packing, toxicity
from barquet.llm.common import settle, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, width=5, threshold=(8, 10))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "pipeline", name)
    return STAGES[-1][1](spark, docs, sf_dir)
