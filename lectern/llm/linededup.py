"""Line dedup (operator 3): lines that many documents share go from all of them.

Lines are counted once a document by two 64-bit hashes of their key (128 bits together), and the counts are
summed before they are shuffled, so that a line of every third document weighs no more than another. Only
positions of dropped lines come back to a document; its text is cut by them in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BLANKS, checkpoint, text_key, whole_rows

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; where a text is ASCII, by the faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_hashes(text: Column, min_length: int) -> Column:
    """The hashes of a text's lines in order; null for keys that are too short. Lower-casing A-Z leaves the line breaks alone."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.when(F.length(line_key(line)) >= min_length, F.struct(F.xxhash64(line_key(line)).alias("a"), F.xxhash64(F.lit(1), line_key(line)).alias("b"))))


def dedup_lines(docs: DataFrame, *, min_docs: int, min_length: int = 1, counts: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, the text without its frequent lines; with `counts`, the numbers of lines and of dropped ones under these two names.

    Each row is a document, so repeated rows count as often as they occur. A null or empty text is one empty
    line, which has no key of a code point and stays; a text all of whose lines go becomes empty. Null ids are
    ids of their own. Other columns pass through untouched, whatever their names, but for those that `counts` names anew.
    An empty table stays empty.
    """
    whole_text, names = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), ["id", "a", "b"]
    # Equal rows get equal keys and lose the same lines, so the key need not be unique.
    key = F.struct(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), text_key(whole_text).alias("t"))
    unpacked = lambda k: [k["id"].alias("id"), k["t"]["a"].alias("a"), k["t"]["b"].alias("b")]
    lines = docs.select(*unpacked(key), line_hashes(whole_text, min_length).alias("lines"))
    once = lines.select(F.explode(F.array_distinct(F.filter("lines", lambda h: h.isNotNull()))).alias("h"))
    # A table of its own, so that both sides of the join are dealt out by exchanges that adaptive execution can split.
    common = checkpoint(once.groupBy(F.col("h.a").alias("ha"), F.col("h.b").alias("hb")).count().where(F.col("count") >= min_docs).select("ha", "hb"))
    placed = lines.select(*names, F.posexplode("lines").alias("pos", "h")).where("h is not null").select(*names, "pos", F.col("h.a").alias("ha"), F.col("h.b").alias("hb"))
    dropped = placed.join(common, ["ha", "hb"], "left_semi").groupBy(*names).agg(F.collect_set("pos").alias("dropped"))
    # The positions of a partition are far smaller than its texts: they are hashed, and texts stream by without a sort.
    out = whole_rows(docs, **dict(zip(names, unpacked(key), strict=True))).join(dropped.hint("shuffle_hash"), names, "left")
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    split = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("dropped")), lambda i: F.get(split, i))
    kept_text = F.when(F.col("dropped").isNull(), text).otherwise(F.concat_ws("\n", kept))
    columns = [kept_text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in (counts or ())]
    if counts:
        columns += [F.size(split).cast("long").alias(counts[0]), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias(counts[1])]
    return out.select(*columns)


def digests(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row of dedup_lines() with these counts."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
lines as (
  select r, generate_subscripts(l, 1) as pos, unnest(l) as line
  from (select r, string_split(t, chr(10)) as l from docs)
),
keyed as (
  select r, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
),
common as (select k from keyed where length(k) >= 1 group by k having count(distinct r) >= 10),
kept as (
  select k.r, count(*) as n_lines, count(c.k) as n_dropped,
    coalesce(string_agg(k.line, chr(10) order by k.pos) filter (where c.k is null), '') as t
  from keyed k left join common c on k.k = c.k group by k.r
)
select d.doc_id, x.n_lines::bigint as n_lines, x.n_dropped::bigint as n_dropped, sha256(x.t) as kept_sha256
from docs d join kept x using (r)
"""
