"""What the operators share: reading, checkpoints, word splitting and hashing."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as all contracts of this subpackage use it.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows and bytes in an Arrow batch: whole texts travel in them, so that a batch stays small.
BATCH_ROWS, BATCH_BYTES = 200, 16 << 20
#: Keys (16 bytes each) up to which they are broadcast; beyond, both sides are shuffled.
FEW_KEYS = 2_000_000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone; null texts become empty. Other columns, whatever their names, are left out."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Bounds what an Arrow batch of whole texts holds, in rows and in bytes.

    The settings are read when a plan runs, so they stay; smaller ones of the session's own are left alone.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.match(r"\d+", spark.conf.get(name) or "")
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(name, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only in local mode where it names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="lectern-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder wherever Spark's file systems hold it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def whole_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """(row, the given columns): all columns of docs in one struct, so that their names clash with none of ours; select("row.*") gives them back."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def text_key(text: Column) -> Column:
    """128 bits of a text as (a, b); null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def by_keys(big: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join with distinct, checkpointed keys: broadcast where they are few, so that big rows stay where they are."""
    return big.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys.hint("shuffle_hash"), on, how)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept for the words met lately."""

    LIMIT = 120_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles in order; with fewer words, of the whole sequence; of no words, none."""
    if not len(words):
        return words
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        out = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
        return mix(out + np.uint64(k))


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def one_worker_thread() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


Batches = Iterator[pa.RecordBatch]
