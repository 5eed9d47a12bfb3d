"""MinHash near-dedup by min-max hashing (operator 10).

Each permutation of the shingles gives two values, its minimum and its maximum, so half as many hashes are
evaluated; both agree in two sets with the probability of their Jaccard similarity. The values are banded, and documents
that share a band are candidates. Documents with the same set are one representative from the start.

Links are looked for bucket by bucket, but never all pairs of a bucket: each member is confirmed against one
centre of its bucket on the full sets. Members that this leaves in different components can reach each
other only by a difference from the centre that they share, and meet in a join on the rarest of those. So no link
between components is lost, and copies of one text do not meet in pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Batches, WordHashes, as_bytes, by_keys, checkpoint, documents, mix, record_batch, shingle_hashes, small_batches, whole_rows
from lectern.llm.components import connected_components

ROWS = 4  # values in a band
MISS = 1e-7  # a pair just at the threshold is missed by all bands with at most this probability


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that make a miss at the threshold as unlikely as `miss`; even, as each permutation serves two."""
    n = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
    return n + n % 2


class Signer:
    """Band keys of shingle sets."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 2**63, bands * rows // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = rng.integers(0, 2**63, bands * rows // 2, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """Keys of shape (sets, bands) for sets that aren't empty."""
        out = np.empty((len(sets), self.bands), np.uint64)
        step = 0
        while step < len(sets):  # blocks of a size that stays in the cache
            size, end = len(sets[step]), step + 1
            while end < len(sets) and size + len(sets[end]) <= 60_000:
                size, end = size + len(sets[end]), end + 1
            values = np.concatenate(sets[step:end])
            starts = np.cumsum([0, *map(len, sets[step:end])])[:-1]
            least, most = np.empty((len(self.factors), end - step), np.uint64), np.empty((len(self.factors), end - step), np.uint64)
            for i, (a, b) in enumerate(zip(self.factors, self.offsets, strict=True)):
                hashed = values * a + b
                hashed ^= hashed >> np.uint64(32)
                least[i], most[i] = np.minimum.reduceat(hashed, starts), np.maximum.reduceat(hashed, starts)
            rows = np.concatenate([least, most]).reshape(self.bands, self.rows, end - step)
            key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64)[:, None], (self.bands, end - step))
            for r in range(self.rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
            out[step:end] = key.T
            step = end
        return out


def shingle_sets(texts: list[bytes], n: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words between ASCII blanks."""
    return [np.unique(shingle_hashes(hashes.of(t.lower().split()), n)) for t in texts]


def sketch(docs: DataFrame, n: int, bands: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): size, 128-bit fingerprint and band keys of each document's set."""
    small_batches(docs.sparkSession)
    source = documents(docs, id_col, text_col)

    def run(batches: Batches) -> Batches:
        hashes, signer = WordHashes(), Signer(bands)
        for batch in batches:
            sets = shingle_sets(as_bytes(batch.column(1)), n, hashes)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), bands), np.uint64)
            if full:
                keys[full] = signer([sets[i] for i in full])
            prints = [[int(mix(s + np.uint64(k)).sum(dtype=np.uint64)) for s in sets] for k in (1, 2)]
            whole = pa.schema([batch.schema.field(0), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])
            edges = np.cumsum([0, *(bands * (len(s) > 0) for s in sets)]).astype(np.int32)
            yield record_batch(whole, [batch.column(0), [len(s) for s in sets], *(np.array(p, np.uint64).view(np.int64) for p in prints), pa.ListArray.from_arrays(pa.array(edges), pa.array(keys[full].reshape(-1).view(np.int64)))])

    fields = [T.StructField(c, T.LongType()) for c in ("n_shingles", "set_a", "set_b")]
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *fields, T.StructField("bands", T.ArrayType(T.LongType()))]))


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles) with the full sets as arrays."""
    small_batches(docs.sparkSession)
    source = documents(docs)

    def run(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            sets = shingle_sets(as_bytes(batch.column(1)), n, hashes)
            edges = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield record_batch(pa.schema([batch.schema.field(0), ("shingles", pa.list_(pa.int64()))]), [batch.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("shingles", T.ArrayType(T.LongType()))]))


def _fits(percent: int, small: Column, large: Column) -> Column:
    """What sizes alone allow: the smaller set is at least the threshold's share of the larger."""
    return F.lit(100) * F.least(small, large) >= F.lit(percent) * F.greatest(small, large)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("sizes") - F.col("common"))).select("a", "b")


def links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (node, component) over members (bucket, id, n) of all pairs that share a bucket and reach the threshold.

    members and sets (doc_id, shingles) hold no nulls, each id once in a bucket and in sets; without members there are no components.
    """
    # Tables of their own, so that both sides of a join are dealt out by exchanges that adaptive execution can split.
    sizes = checkpoint(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")))
    weights = members.join(sizes, "bucket").groupBy("id").agg(F.sum("size").alias("weight"))
    alive = checkpoint(members.join(weights, "id").select("bucket", "id", "n", "weight"))
    # The member that meets most others is the centre: of near copies, the text they were made from.
    centres = checkpoint(alive.groupBy("bucket").agg(F.max(F.struct("weight", "id", "n")).alias("c")).select("bucket", F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n")))
    around = alive.join(centres, "bucket").where("id <> centre")
    meet = around.where(_fits(percent, F.col("n"), F.col("centre_n"))).select("id", F.col("centre").alias("other"))
    edges, components = _merge(None, meet, sets, percent)
    labelled = checkpoint(around.join(components.withColumnRenamed("node", "id"), "id", "left").select("bucket", "centre", "id", "n", F.coalesce("component", "id").alias("component")))
    split = checkpoint(labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket"))
    left = checkpoint(labelled.join(split, "bucket").select("centre", "id", "n", "component").distinct())
    return _merge(edges, _share_differences(left, sets, percent), sets, percent)[1]


def _share_differences(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (id, other) of different components around one centre that may reach the threshold.

    Let D(u) be the symmetric difference of u and the centre. Sets u and v reach the threshold if |D(u)| + |D(v)| - 2 |D(u) & D(v)|
    is at most d(u, v) = (100 - percent) / (100 + percent) * (|u| + |v|). If D(u) and D(v) have nothing in common, this puts both
    in reach of the centre and so in one component. Any other pair shares an element, and one among the rarest of
    |D(u)| - o + 1, where o >= |D(u)| - d(u, |u| * 100 / percent) is the least overlap that any partner needs.
    So the pairs come from a join on rare differences, of which copies of one text seldom have the same.
    """
    share = (100 - percent) / (100 + percent)
    one = sets.select(F.col("doc_id").alias("id"), F.col("shingles").alias("su"))
    other = sets.select(F.col("doc_id").alias("centre"), F.col("shingles").alias("sc"))
    differ = left.join(one, "id").join(other, "centre").select("centre", "id", "n", "component", F.concat(F.array_except("su", "sc"), F.array_except("sc", "su")).alias("d"))
    elements = differ.select("centre", "id", "n", "component", F.size("d").alias("size"), F.explode("d").alias("e"))
    often = elements.groupBy("centre", "e").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    common = elements.join(often, ["centre", "e"]).groupBy("centre", "id", "n", "component", "size").agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("es"))
    # Elements of one member alone come first in the order and join with nothing.
    placed = common.select("centre", "id", "n", "component", "size", (F.col("size") - F.size("es")).alias("alone"), F.posexplode("es").alias("at", "e"))
    least = F.greatest(F.lit(1), F.ceil(F.col("size") - F.lit(share * (1 + 100 / percent)) * F.col("n") - 1e-6))
    placed = placed.select("centre", F.col("e.e").alias("e"), "id", "n", "component", "size", (F.col("at") + F.col("alone")).alias("place")).where(F.col("place") <= F.col("size") - least)
    placed = checkpoint(placed)
    mate = placed.select("centre", "e", F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("component").alias("other_component"), F.col("size").alias("other_size"), F.col("place").alias("other_place"))
    reach = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))
    needed = (F.col("size") + F.col("other_size") - F.lit(share) * (F.col("n") + F.col("other_n"))) / 2 - 1e-6
    met = (placed["centre"] == mate["centre"]) & (placed["e"] == mate["e"]) & (F.col("id") < F.col("other")) & (F.col("component") != F.col("other_component")) & _fits(percent, F.col("n"), F.col("other_n")) & (reach >= needed)
    return placed.join(mate, met).select("id", "other")


def _merge(edges: DataFrame | None, meet: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed pairs of those that meet, with the earlier ones, and the components of all."""
    pairs = checkpoint(meet.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    found = confirmed(pairs, sets, percent)
    edges = checkpoint(found if edges is None else edges.union(found))
    return edges, connected_components(edges)


def near_duplicates(docs: DataFrame, *, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs; documents are linked at Jaccard similarity percent / 100 or more.

    With fewer words than n, the whole sequence is the only shingle; null and empty texts have none, are linked
    with nothing and kept. Rows with one id are one document if their texts agree; a row without an id is kept, has
    no component and links nothing. Other columns are ignored.
    """
    bands = bands_for(percent / 100)
    drawn = checkpoint(sketch(docs, n, bands, id_col, text_col))
    full = drawn.where("doc_id is not null and n_shingles > 0")
    classes = checkpoint(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    exploded = classes.select(F.explode("bands").alias("bucket"), "id", "n")
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    members = checkpoint(exploded.join(shared, "bucket"))
    involved = checkpoint(members.select(F.col("id").alias("doc_id")).distinct())
    # The texts stay where they are; only those of ids that occur more than once are brought together.
    named = by_keys(documents(docs, id_col, text_col), involved, ["doc_id"], "left_semi")
    twice = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    twice = checkpoint(twice.join(involved, "doc_id", "left_semi"))
    sets = sets_of(named, n)
    if not twice.isEmpty():
        once = by_keys(sets, twice, ["doc_id"], "left_semi").groupBy("doc_id").agg(F.first("shingles").alias("shingles"))
        sets = by_keys(sets, twice, ["doc_id"], "left_anti").unionByName(once)
    merged = links(members, checkpoint(sets), percent)
    by_class = classes.select("set_a", "set_b", "id").join(merged.withColumnRenamed("node", "id"), "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component"))
    out = drawn.drop("bands").join(by_class, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps; of rows with one id, one.

    Rows without an id all stay, as do null and empty texts. Columns pass through whatever their names.
    """
    judged = checkpoint(near_duplicates(docs, n=n, percent=percent, id_col=id_col, text_col=text_col))
    ids = judged.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    ids = checkpoint(ids.where("not kept or rows > 1"))
    rows = whole_rows(docs, doc_id=F.col(f"`{id_col}`"))
    out = by_keys(rows, checkpoint(ids.where("not kept").select("doc_id")), ["doc_id"], "left_anti")
    several = checkpoint(ids.where("kept").select("doc_id"))
    if not several.isEmpty():
        once = by_keys(out, several, ["doc_id"], "left_semi").dropDuplicates(["doc_id"])
        out = by_keys(out, several, ["doc_id"], "left_anti").unionByName(once)
    return out.select("row.*")


#: The contract query by comparing all pairs that share a shingle.
ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) end) as s
  from w
),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach(doc_id, other) as (select doc_id, doc_id from w union select r.doc_id, e.y from reach r join both_ways e on r.other = e.x),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select l.doc_id, coalesce(n.n, 0)::bigint as n_shingles, l.component_id, l.doc_id = l.component_id as kept from least l left join n using (doc_id)
"""
