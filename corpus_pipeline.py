"""From raw documents to packed training sequences, in five stages that each work on all that the one before kept.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; :func:`run` writes what a stage returns as Parquet in
the shared folder and hands it to the next one, so that a lost executor costs a part of one stage only.
Stages but the last return the columns of ``documents``; rows with a null ``doc_id`` pass the stages that judge by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import without
from pelagia.llm.decontam import decontaminate
from pelagia.llm.line_dedup import dedup_lines
from pelagia.llm.near_dedup import near_duplicates
from pelagia.llm.packing import pack_documents
from pelagia.llm.toxicity import without_toxic
from pelagia.staging import discard, new_path, scratch

#: Words of a shingle and percentage of similarity of the near-duplicate stage.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted as toxic go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first of all documents stays; ``n_chars`` follows the text. No document goes."""
    kept = dedup_lines(docs)
    columns = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays."""
    return without(docs, near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT).filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hold 5 % of the words or more go."""
    judged = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, judged.filter("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in as few sequences as possible."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't train the model, restore words or pack; tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``. A stage's input and intermediate tables are deleted when its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
