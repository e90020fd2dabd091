"""A corpus pipeline over ``documents``: five stages, each written and read again.

Counts as part of the subpackage ``veilframe.llm``.  The stages, in order:
quality classifier (rejected documents go), line dedup (lines of recurring
templates go; near copies count as one text), MinHash near-dedup (one document of each
group stays), benchmark decontamination (contaminated documents go) and
SentencePiece encoding (token ids, with the check that they decode to the text).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import contamination, line_templates, near_dup, quality_pu, tokens
from veilframe.llm.common import remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_pu.stage(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.stage(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.stage(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.stage(spark, docs, sf_dir)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.stage(spark, docs, sf_dir)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: The classifier, the template tree and the encoder can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is a Parquet table in the shared folder, and the last one stays."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:  # the stage before is no longer read
            remove(spark, done)
        done = path
    return docs
