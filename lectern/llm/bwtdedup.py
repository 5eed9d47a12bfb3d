"""Suffix-array dedup by merging shard Burrows-Wheeler transforms (operator 9).

Every byte covered by a string of `length` bytes that also starts elsewhere goes. Suffixes are not sorted over the
whole corpus; they are split into buckets that can be merged alone, with nothing lost:

* Anchors. The smallest hash of a 64-byte gram in a window of `length` bytes is the window's anchor. Equal windows have
  their anchor at the same offset, so only windows whose anchor's hash occurs twice can repeat.
* Buckets. The windows of an anchor are cut into slices of 64 that start next to each other. All windows of a
  slice share a core; a slice with another core shares none of its windows. A bucket is the slices of one core.
* Rows. A slice is kept as what precedes its core (the Burrows-Wheeler columns of its suffixes, nearest first) and what
  follows it. Equal rows of all shards are one, with their count, before they are shuffled.

A shard is a partition of the different rows. It sorts its own rows once by what follows their cores: its part of the
transform, with the preceding columns beside it. In a bucket the shards are merged by interleave refinement: all rows begin
as one interval, shard after shard, and each round splits the intervals by one more symbol, stably, so that every shard keeps
its order. The round that splits two neighbours is their longest common prefix. An interval left with rows of one shard is
settled: its order and common prefixes are the shard's own. The preceding columns then take the order of the suffixes at one
place to the order one place before, by a stable partition again. Neighbours that agree in both parts of a window are a
repeated interval. A bucket with too many different rows for one task is resolved window by window, by counts that are
summed before they are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Batches, as_bytes, checkpoint, documents, mix, record_batch, small_batches

GRAM = 64  # a power of 2
SLICE = 64  # windows of a slice: one bit each in a long
KEYS = 2_000_000  # keys of texts (16 bytes each) up to which they are broadcast
COPIES, HOT = 256, 100_000  # copies of a text that one task takes in any case; texts dealt out over several, at most
HEAVY = 200_000  # different rows from which a bucket is resolved window by window
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of all grams of GRAM bytes, each built from the two halves of its length."""
    out, size = _BYTES[raw], 1
    while size < GRAM:
        out = out[:-size] * np.uint64(0xD6E8FEB86659FD93 + 2 * size) + out[size:]
        out ^= out >> np.uint64(29)
        size *= 2
    return mix(out)


def owners(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its hash, first window, last window): the windows of a text in runs that have one anchor.

    The anchor is the leftmost gram with the smallest upper half of the hash.
    """
    if len(text) < length:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    hashed = gram_hashes(np.frombuffer(text, np.uint8))
    least = (hashed & ~_LOW) | np.arange(len(hashed), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [len(anchor)]]) - 1
    return anchor[first], hashed[anchor[first]], first, last


def slices(text: bytes, length: int, wanted: set[int]) -> list[tuple[int, bytes, int, int, bytes, bytes]]:
    """(base, core digest, lo, hi, preceding bytes nearest first, following bytes) for the wanted anchors.

    The windows of a slice are those that start at base - o for o from lo to hi.
    """
    out, core = [], length - SLICE + 1
    for anchor, _, first, last in zip(*(x.tolist() for x in owners(text, length)), strict=True):
        if anchor not in wanted:
            continue
        for j in range((anchor - last) // SLICE, (anchor - first) // SLICE + 1):
            base = anchor - j * SLICE
            lo, hi = max(base - last, 0), min(base - first, SLICE - 1)
            out.append((base, xxhash.xxh3_128_digest(text[base : base + core]), lo, hi, text[base - hi : base][::-1], text[base + core : base + length - lo]))
    return out


def interleave(bucket: np.ndarray, shard: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of rows that come by bucket, by shard in it and sorted by `after` in each shard.

    order: the merged order of the rows. common: the longest common prefix of each with the one before, -1 where a bucket begins.
    """
    n, depth = after.shape
    order, common = np.arange(n), np.full(n, depth)
    if not n:
        return order, common
    begins = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    common[begins] = -1
    beside = np.concatenate([[False], (shard[1:] == shard[:-1]) & ~begins[1:]])  # a row and its shard's row before it
    differ = after[1:] != after[:-1]
    own = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), depth)])
    at = order.copy()  # places in intervals that are not settled
    for h in range(depth):
        interval = np.cumsum(common[at] < depth) - 1
        mixed = np.zeros(len(at), bool)
        mixed[interval[1:][(shard[order[at]][1:] != shard[order[at]][:-1]) & (interval[1:] == interval[:-1])]] = True
        at, interval = at[mixed[interval]], interval[mixed[interval]]
        if not len(at):
            break
        symbol = after[order[at], h]
        splits = np.zeros(int(interval[-1]) + 1, bool)
        splits[interval[1:][(symbol[1:] != symbol[:-1]) & (interval[1:] == interval[:-1])]] = True
        split = splits[interval]
        places, key = at[split], interval[split] * 256 + symbol[split]
        step = np.argsort(key, kind="stable")
        order[places], key = order[places[step]], key[step]
        common[places[1:][(key[1:] != key[:-1]) & (key[1:] >> 8 == key[:-1] >> 8)]] = h
    settled = (common == depth) & beside[order]
    settled[1:] &= order[1:] == order[:-1] + 1
    common[settled] = own[order[settled]]
    return order, common


def merge(bucket: np.ndarray, shard: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: np.ndarray, after: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Masks of the repeated windows of rows, over many buckets at once.

    Rows come by bucket, by shard in it and sorted by `after` in each shard. before, after: uint8 of shape (rows, SLICE - 1),
    nearest the core first, padded. several: rows that occur more than once.
    """
    n, depth = len(bucket), SLICE - 1
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    order, common = interleave(bucket, shard, after)
    common = common[1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    interval = np.cumsum(np.concatenate([[0], common < 0])).astype(np.int64)  # in the current order
    for o in range(SLICE):
        if o:  # one place to the left: stable partition by the preceding symbol within each interval
            key = interval * 256 + before[order, o - 1]
            step = np.argsort(key, kind="stable")
            order, key = order[step], key[step]
            interval = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.int64)
        following = np.cumsum(np.concatenate([[0], common < depth - o]))[rank[order]]
        here = (lo[order] <= o) & (o <= hi[order])
        rows, left, right = order[here], interval[here], following[here]
        same = (left[1:] == left[:-1]) & (right[1:] == right[:-1])
        repeated = several[rows]
        repeated[1:] |= same
        repeated[:-1] |= same
        out[rows[repeated]] |= np.uint64(1) << np.uint64(o)
    return out


def covered(n: int, length: int, places: list[tuple[int, int]]) -> np.ndarray:
    """Which of n bytes lie in a repeated window; places: (base, mask) of slices."""
    change = np.zeros(n + 1, np.int32)
    if places:
        bases = np.array([b for b, _ in places], np.int64)
        masks = np.array([m for _, m in places], np.int64).view(np.uint64)
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, o = np.nonzero(bits)
        starts = bases[row] - o
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


_CORE = ["core_a", "core_b"]
_ROW = [*_CORE, "lo", "hi", "before", "after"]


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, anchor, hash) of the anchors of each row."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [owners(t, length)[:2] for t in as_bytes(batch.column(2))]
            which = np.repeat(np.arange(len(found)), [len(a) for a, _ in found])
            anchors, hashed = (np.concatenate([np.empty(0, k), *(f[i] for f in found)]) for i, k in ((0, np.int64), (1, np.uint64)))
            whole = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("anchor", pa.int64()), ("hash", pa.int64())])
            yield record_batch(whole, [batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)), anchors, hashed.view(np.int64)])

    return texts.mapInArrow(run, "k1 long, k2 long, anchor long, hash long")


def _slices(wanted: DataFrame, length: int) -> DataFrame:
    """The slices of rows (k1, k2, text, anchors, copies), once for rows of one key that come one after the other."""

    def run(batches: Batches) -> Batches:
        last = None
        for batch in batches:
            columns: list[list] = [[] for _ in range(12)]
            for k1, k2, text, anchors, copies in zip(*(batch.column(i).to_pylist() for i in (0, 1)), as_bytes(batch.column(2)), *(batch.column(i).to_pylist() for i in (3, 4)), strict=True):
                if (k1, k2) == last:
                    continue
                last = (k1, k2)
                for base, core, lo, hi, before, after in slices(text, length, set(anchors)):
                    row = xxhash.xxh3_128_digest(core + bytes((lo, hi)) + before + after)
                    values = (k1, k2, base, int.from_bytes(core[:8], "big", signed=True), int.from_bytes(core[8:], "big", signed=True), lo, hi, before, after, int.from_bytes(row[:8], "big", signed=True), int.from_bytes(row[8:], "big", signed=True), copies)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                if len(columns[0]) >= 5_000:
                    yield record_batch(whole, columns)
                    columns = [[] for _ in columns]
            yield record_batch(whole, columns)

    kinds = [("k1", "long"), ("k2", "long"), ("base", "long"), ("core_a", "long"), ("core_b", "long"), ("lo", "int"), ("hi", "int"), ("before", "binary"), ("after", "binary"), ("row_a", "long"), ("row_b", "long"), ("copies", "long")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    whole = pa.schema([(n, arrow[k]) for n, k in kinds])
    return wanted.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds))


def _padded(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(b.ljust(SLICE - 1, b"\0") for b in as_bytes(column)), np.uint8).reshape(-1, SLICE - 1)


def _merged(rows: DataFrame, least_rows: int = 50_000) -> DataFrame:
    """(row_a, row_b, mask) of the rows with repeated windows; whole buckets are in one partition, each together."""
    schema = pa.schema([("row_a", pa.int64()), ("row_b", pa.int64()), ("mask", pa.int64())])

    def resolve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        a, b = table["core_a"].to_numpy(), table["core_b"].to_numpy()
        bucket = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        size = np.bincount(bucket)[bucket]
        several = table["copies"].to_numpy() > 1
        at = np.flatnonzero((size > 1) | several)
        table = table.take(pa.array(at)).combine_chunks()
        column = lambda n: table[n].chunk(0) if table.num_rows else pa.array([], table.schema.field(n).type)
        shard = column("place").to_numpy() >> 33  # as monotonically_increasing_id() has them
        masks = merge(bucket[at], shard, column("lo").to_numpy(), column("hi").to_numpy(), _padded(column("before")), _padded(column("after")), several[at])
        some = np.flatnonzero(masks)
        return record_batch(schema, [column("row_a").take(pa.array(some)), column("row_b").take(pa.array(some)), masks[some].view(np.int64)])

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < least_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            a, b = table["core_a"].to_numpy(), table["core_b"].to_numpy()
            ends = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            if len(ends):  # the last bucket may go on
                cut = int(ends[-1]) + 1
                yield resolve(table.slice(0, cut))
                table = table.slice(cut)
            held, count = table.to_batches(), table.num_rows
        if count:
            yield resolve(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "row_a long, row_b long, mask long")


def _window_by_window(rows: DataFrame) -> DataFrame:
    """(row_a, row_b, mask) for buckets with very many different rows: windows are counted by their hashes."""
    each = rows.select("row_a", "row_b", "copies", F.col("core_a"), F.col("core_b"), "before", "after", F.explode(F.sequence("lo", "hi")).alias("o"))
    left, right = F.substring("before", F.lit(1), F.col("o")), F.substring("after", F.lit(1), F.lit(SLICE - 1) - F.col("o"))
    each = each.select("row_a", "row_b", "copies", "o", *(F.xxhash64(F.lit(s), "core_a", "core_b", "o", left, right).alias(f"w{s}") for s in (1, 2)))
    often = each.groupBy("w1", "w2").agg(F.sum("copies").alias("times")).where("times > 1").select("w1", "w2")
    return each.join(often, ["w1", "w2"], "left_semi").groupBy("row_a", "row_b").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("mask"))


def _hot(wanted: DataFrame) -> DataFrame:
    """(k1, k2, parts) of texts with more than COPIES copies and more than one in HOT of all: HOT rows at the most."""
    each = max(COPIES, wanted.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] / HOT)
    return wanted.where(F.col("copies") > each).select("k1", "k2", F.ceil(F.col("copies") / F.lit(float(each))).alias("parts"))


def repeats(docs: DataFrame, *, length: int = 400, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, places) of every row: slices (base, mask) with repeated windows, or null where there is none.

    Texts are UTF-8 bytes. Equal rows repeat each other; null and empty texts and those under `length` bytes have no
    window. Null ids stay null, other columns are ignored.
    """
    if length < GRAM + SLICE:
        raise ValueError(f"the length must be {GRAM + SLICE} bytes or more")
    small_batches(docs.sparkSession)
    whole = documents(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    texts = whole.select("k1", "k2", "text").where(F.octet_length("text") >= length)
    anchors = checkpoint(_anchors(texts, length))
    # A table of its own, so that both sides of the join are dealt out by exchanges that adaptive execution can split.
    often = checkpoint(anchors.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("hash"))
    # Rows of one text count as its copies.
    wanted = anchors.join(often, "hash", "left_semi").groupBy("k1", "k2", "anchor").agg(F.count(F.lit(1)).alias("copies"))
    wanted = checkpoint(wanted.groupBy("k1", "k2").agg(F.collect_list("anchor").alias("anchors"), F.max("copies").alias("copies")))
    # Texts without an anchor that occurs twice need not be shuffled, as long as the keys of the others are few.
    keys = wanted.select("k1", "k2")
    few = keys.count() <= KEYS
    touched = texts.join(F.broadcast(keys), ["k1", "k2"], "left_semi") if few else texts
    touched = touched.dropDuplicates(["k1", "k2"])  # a text's copies have the same slices
    found = _slices(touched.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "anchors", "copies"), length)
    rows = found.groupBy(*_ROW, "row_a", "row_b").agg(F.sum("copies").alias("copies"))
    rows = checkpoint(rows)
    heavy_cores = checkpoint(rows.groupBy(*_CORE).count().where(F.col("count") > heavy).select(*_CORE))
    # Each partition sorts its rows once; a place holds the shard and the row's rank in it.
    shards = rows.join(heavy_cores, _CORE, "left_anti").sortWithinPartitions(*_CORE, "after").withColumn("place", F.monotonically_increasing_id())
    masks = _merged(shards.repartition(*_CORE).sortWithinPartitions(*_CORE, "place"))
    if not heavy_cores.isEmpty():
        masks = masks.union(_window_by_window(rows.join(heavy_cores, _CORE, "left_semi")))
    places = found.select("k1", "k2", "base", "row_a", "row_b").join(masks, ["row_a", "row_b"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("base", "mask")).alias("places"))
    # The places of a partition are far smaller than its texts: they are hashed, and texts stream by without a sort.
    # Copies of a text that has very many are dealt out over several tasks, its places to each of them.
    hot = _hot(wanted)
    deal = F.xxhash64("doc_id", F.spark_partition_id())
    parted = lambda df: df.join(F.broadcast(hot), ["k1", "k2"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = parted(places).select("k1", "k2", "places", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    with_places = lambda df: parted(df).withColumn("part", F.pmod(deal, "parts")).join(dealt.hint("shuffle_hash"), ["k1", "k2", "part"], "left").select("doc_id", "text", "places")
    if not few:
        return with_places(whole)
    rest = whole.join(F.broadcast(keys), ["k1", "k2"], "left_anti")
    return with_places(whole.join(F.broadcast(keys), ["k1", "k2"], "left_semi")).unionByName(rest.select("doc_id", "text", F.lit(None).cast("array<struct<base:bigint,mask:bigint>>").alias("places")))


def remove(found: DataFrame, *, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of the texts of repeats(), as bytes."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text, places in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                gone = covered(len(text), length, [(p["base"], p["mask"]) for p in places or ()])
                spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
                for column, value in zip(columns, (len(text), len(text) - len(kept), spans, kept), strict=True):
                    column.append(value)
            whole = pa.schema([batch.schema.field(0), *((n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), ("kept", pa.binary())])
            yield record_batch(whole, [batch.column(0), *columns])

    fields = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    return found.mapInArrow(run, T.StructType([found.schema["doc_id"], *fields, T.StructField("kept", T.BinaryType())]))


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by a table of all windows, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
