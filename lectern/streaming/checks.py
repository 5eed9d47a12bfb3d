"""Checks over streams of documents.

Row-local rules run as one stateless plan on each micro-batch's rows. Kinds that compare rows of a document need windows, which
streams do not have, so they run in foreachBatch on the newest version of each document. Words for which the result is known are
kept in a table keyed by the sentence's hash, so that unchanged sentences are not checked twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.segment import BREAK, Corpus, broken
from lectern.plans.pack import Pack, check
from lectern.sources.blocks import quoted_spans


def stream_matches(docs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(doc_id, rule, sentence, match) of patterns by rule id on a stream of (doc_id, text); stateless, in append mode."""
    sentences = docs.select("doc_id", F.explode(F.split(broken(F.coalesce(F.col("text"), F.lit(""))), BREAK, -1)).alias("sentence"))
    per = [F.transform(X.match_all(F.col("sentence"), p), _named(r)) for r, p in rules.items()]
    gate = F.col("sentence").rlike("|".join(f"(?:{p})" for p in rules.values()))
    return sentences.where(gate).select("doc_id", "sentence", F.explode(F.flatten(F.array(*per))).alias("m")).select("doc_id", "m.rule", F.trim("sentence").alias("sentence"), "m.match")


def _named(rule: str) -> Callable:
    return lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("match"))


def windowed_rates(matches: DataFrame, time_col: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings of each rule in tumbling windows; later ones than the watermark are left out."""
    return matches.withWatermark(time_col, late).groupBy(F.window(time_col, width), "rule").agg(F.count(F.lit(1)).alias("n"))


def newest(batch: DataFrame, version: str = "version") -> DataFrame:
    """The newest version of each document of a batch."""
    return batch.groupBy("doc_id").agg(F.max_by("text", version).alias("text"), F.max(version).alias(version))


def check_stream(docs: DataFrame, packs: list[Pack], write: Callable[[DataFrame, int], None], checkpoint: str, version: str = "version"):
    """Starts a query that checks the newest version of each document of a micro-batch by all rules and hands the findings to `write`."""

    def each(batch: DataFrame, number: int) -> None:
        corpus = Corpus(newest(batch, version))
        try:
            write(check(corpus, packs, quoted_spans(corpus.docs)), number)
        finally:
            corpus.release()

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def unseen(sentences: DataFrame, cache: DataFrame) -> DataFrame:
    """Sentences whose text is not in a cache keyed by its hash (key), with that key."""
    keyed = sentences.withColumn("key", F.sha2(F.col("text"), 256))
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")
