"""Benchmark decontamination by size-partitioned MinHash containment search (operator 6).

A short item inside a long document has a tiny Jaccard similarity with it, so only the item is sketched: of its k-word
shingles, those with the smallest hashes. Items are partitioned by size, in octaves, and each partition has parameters of its
own: a document that contains the share `percent` of an item's n shingles misses at most n - ceil(percent * n / 100) of them, so
one more sketch element than that, for the largest n of the partition, is enough to meet every such document; a
document with fewer shingles than the smallest item needs is not looked up in it. The documents' own shingles look the
elements up; each candidate is then confirmed by the exact share of the item's shingles, words compared as words.

Items go through in blocks of a bounded number of words, each block over all documents.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Batches, WordHashes, as_bytes, by_keys, checkpoint, documents, record_batch, shingle_hashes, small_batches, text_key, whole_rows

BLOCK_WORDS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """Distinct n-word shingles; with fewer words the whole sequence is the only one; of no words, none."""
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


class Partition:
    """Items of one size class: those with more than half of `most` shingles and no more. Its sketches hold so many of the
    smallest hashes of an item that a document with the share `percent` of the shingles meets one."""

    def __init__(self, items: list[tuple[int, list[int]]], percent: int):
        fewest, most = min(len(of) for _, of in items), max(len(of) for _, of in items)
        self.needed = least(fewest, percent)  # shingles of a document that contains any item
        self.sketch = most - least(most, percent) + 1
        met = defaultdict(list)
        for at, of in items:
            for h in sorted(of)[: self.sketch]:
                met[h].append(at)
        order = sorted(met)
        self.elements, self.items = np.array(order, np.uint64), [met[h] for h in order]

    def candidates(self, own: np.ndarray) -> set[int]:
        """Items that share a sketch element with the hashes of a document."""
        if len(own) < self.needed:
            return set()
        at = np.searchsorted(self.elements, own)
        at[at == len(self.elements)] = 0
        return {c for hit in np.unique(at[self.elements[at] == own]) for c in self.items[hit]}


def least(n: int, percent: int) -> int:
    return max(1, -(-percent * n // 100))


class Block:
    """Some items, in partitions by the words of a shingle and by size."""

    def __init__(self, items: list[tuple[object, bytes]], n: int, percent: int):
        self.percent = percent
        self.items = [(i, shingles(words_of(t), n)) for i, t in items]
        hashes, parts = WordHashes(), defaultdict(list)
        for at, (_, whole) in enumerate(self.items):
            if whole:
                k = len(next(iter(whole)))
                parts[k, len(whole).bit_length()].append((at, [int(shingle_hashes(hashes.of(list(s)), k)[0]) for s in whole]))
        self.parts = {of: Partition(members, percent) for of, members in sorted(parts.items())}

    def search(self, text: bytes, hashes: WordHashes) -> list[tuple[int, int]]:
        """(item, shingles it shares) of the items that the text contains."""
        words = words_of(text)
        of = hashes.of(words)
        own: dict[int, np.ndarray] = {}
        candidates: set[int] = set()
        for (k, _), part in self.parts.items():
            if len(words) >= k:
                if k not in own:
                    own[k] = shingle_hashes(of, k)
                candidates |= part.candidates(own[k])
        out, whole = [], {}
        for c in sorted(candidates):
            wanted = self.items[c][1]
            k = len(next(iter(wanted)))
            if k not in whole:
                whole[k] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
            common = len(wanted & whole[k])
            if common >= least(len(wanted), self.percent):
                out.append((c, common))
        return out


def blocks(items: DataFrame, n: int, percent: int, id_col: str, text_col: str, block_words: int) -> list[Block]:
    """Blocks of items, drawn one after the other through the driver."""
    out, rows, size = [], [], 0
    source = documents(items, id_col, text_col).where("doc_id is not null").orderBy("doc_id", "text")
    for row in source.toLocalIterator(prefetchPartitions=False):
        text = row.text.encode()
        rows.append((row.doc_id, text))
        size += len(text.split())
        if size >= block_words:
            out.append(Block(rows, n, percent))
            rows, size = [], 0
    return [*out, Block(rows, n, percent)] if rows else out


def contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_common, n_item, containment): the items of which each document contains the share percent / 100 or more.

    A-Z are lower-cased and words stand between ASCII blanks. An item of fewer than n words is one shingle, its whole
    sequence. Null and empty texts contain nothing and are contained in nothing; items without an id are left
    out. Repeated documents give repeated rows, repeated items one row for each. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = documents(docs, id_col, text_col)
    id_type, item_type = source.schema["doc_id"], benchmark.schema[item_id].dataType
    schema = T.StructType([id_type, T.StructField("item_id", item_type), *(T.StructField(c, T.LongType()) for c in ("n_common", "n_item"))])
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, n, percent, item_id, item_text, block_words):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Batches, held=held) -> Batches:
            hashes, block = WordHashes(), held.value
            for batch in batches:
                rows = [(i, block.items[c][0], common, len(block.items[c][1])) for i, t in enumerate(as_bytes(batch.column(1))) for c, common in block.search(t, hashes)]
                whole = pa.schema([batch.schema.field(0), ("item_id", pa.array([r[1] for r in rows]).type if rows else pa.int64()), ("n_common", pa.int64()), ("n_item", pa.int64())])
                yield record_batch(whole, [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *([r[k] for r in rows] for k in (1, 2, 3))])

        out = out.union(source.mapInArrow(run, schema))
    return out.withColumn("containment", F.col("n_common") / F.col("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **settings) -> DataFrame:
    """The documents that contain no item, with all their columns, whatever their names.

    A row stays or goes by its text, so repeated rows do so together and rows without an id as any other; null and empty texts
    stay. An empty benchmark lets all stay.
    """
    keyed = docs.select(text_key(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    found = contaminated(keyed, benchmark, **settings | {"id_col": "key", "text_col": "text"})
    gone = checkpoint(found.select(F.col("doc_id.a").alias("a"), F.col("doc_id.b").alias("b")).distinct())
    key = text_key(F.col(f"`{text_col}`"))
    return by_keys(whole_rows(docs, a=key["a"], b=key["b"]), gone, ["a", "b"], "left_anti").select("row.*")


ORACLE = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
),
i as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from benchmark
),
sized as (select item_id, w, least(5, len(w)) as k from i where len(w) > 0),
item_shingles as (
  select distinct item_id, k, array_to_string(w[p : p + k - 1], ' ') as s
  from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as p from sized)
),
counts as (select item_id, k, count(*) as n_item from item_shingles group by item_id, k),
ks as (select distinct k from sized),
doc_shingles as (
  select distinct doc_id, k, array_to_string(w[p : p + k - 1], ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, ks where len(w) >= k)
),
common as (select doc_id, item_id, k, count(*) as n_common from doc_shingles join item_shingles using (k, s) group by all)
select doc_id, item_id, n_common::bigint as n_common, n_item::bigint as n_item, n_common / n_item as containment
from common join counts using (item_id, k) where 100 * n_common >= 80 * n_item
"""
