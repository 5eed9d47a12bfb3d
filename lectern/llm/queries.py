"""The thin contract queries of the subpackage: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bwtdedup, bytebpe, decontam, linededup, lm, minmax, mpegts, quality, tokencount, urlfilter
from lectern.llm.common import remainder
from lectern.session import table


def op1_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.digests(mpegts.demux(mpegts.mux(table(spark, sf_dir, "documents"))))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    scored = lm.score(table(spark, sf_dir, "documents"), ~held_out, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(linededup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, counts=("n_lines", "n_dropped")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bytebpe.digests(bytebpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=5, percent=80)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 4) == 2
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return judged.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.RULES)


def op9_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwtdedup.digests(bwtdedup.remove(bwtdedup.repeats(table(spark, sf_dir, "documents"), length=400), length=400))


def op10_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


QUERIES = {q.__name__: q for q in (op1_mpeg_ts, op2_lm_scoring, op3_line_dedup, op4_byte_bpe, op5_token_counts, op6_decontamination, op7_quality, op8_url_filter, op9_bwt_dedup, op10_min_max)}
ORACLES = {"op3_line_dedup": linededup.ORACLE, "op6_decontamination": decontam.ORACLE, "op8_url_filter": urlfilter.ORACLE, "op10_min_max": minmax.ORACLE}
