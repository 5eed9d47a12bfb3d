"""The corpus pipeline: five stages over the whole documents table, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its decisions take effect in its result.
"""

from __future__ import annotations

import posixpath
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bytebpe, decontam, linededup, minmax, quality
from lectern.llm.common import remainder, remove, shared_folder
from lectern.session import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be good, learnt as in op7_quality."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that 10 or more of them share; n_chars follows the text."""
    cut = linededup.dedup_lines(docs, min_docs=10)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 or more of five-word shingles: the one with the smallest id."""
    return minmax.keep_one(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to 0.8 of its five-word shingles."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=5, percent=80)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left, encoded and decoded."""
    return bytebpe.digests(bytebpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("byte_bpe", encode)]

#: A trained classifier and encoding by ranks have no SQL; the tests hold run() against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again; what only earlier stages read is removed."""
    docs, folder, last = table(spark, sf_dir, "documents"), posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := posixpath.join(folder, name))
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
