"""The queries over the driver's tables, with their oracles in DuckDB SQL.

The oracles share a prelude of views (sentences, tokens and the like) that is written for that engine on its own.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import kinds, post, shallow, structure
from lectern.operators.segment import Corpus, marks
from lectern.plans.pack import built_in, check
from lectern.session import table
from lectern.sources.blocks import code_words as words_of_code
from lectern.sources.blocks import html_blocks, markdown_blocks, quoted_spans, to_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words the catalogue's own rules look for. The texts are invented prose, so common short words stand for style words.
HEDGES = ["perhaps", "maybe", "somewhat", "the be of", "with the", "it is", "of the", "in the", "is the", "to the", "for the"]
SWAPS = {"of the": "of a", "the and": "the", "is to": "will", "with that": "with this", "in in": "in", "that is": "which is|being"}
TERMS = [("c1", "the and", "deprecated", False), ("c1", "the", "preferred", False), ("c2", "In The", "preferred", True), ("c3", "of that", "deprecated", False)]


def corpus_of(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def corpus_with(spark: SparkSession, sf_dir: str, sentence: str) -> Corpus:
    """The documents, each with one more paragraph by an SQL expression over doc_id: for kinds that the tables' own prose does not set off."""
    return Corpus(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), F.expr(sentence)).alias("text")))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages as of a document: h1, p and li elements; list items of a page are one list."""
    return html_blocks(table(spark, sf_dir, "pages")).withColumn("ordered", F.lit(False)).withColumn("list_id", F.when(F.col("kind") == "list-item", 1))


def article_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with a hierarchy: each line of a document is a block; a short line is a heading, whose level follows from its length."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("block_id", "text")).where("text <> ''")
    short = F.length("text") <= 40
    return lines.select("doc_id", "block_id", F.when(short, "heading").otherwise("paragraph").alias("kind"), F.when(short, F.length("text") % 3 + 1).otherwise(0).alias("level"), "text", F.lit(None).cast("int").alias("list_id"), F.lit(None).cast("boolean").alias("ordered"), F.lit(0).alias("begin"))


# Oracle prelude -------------------------------------------------------------------------------

_WORD = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*(?:-[\p{L}\p{N}]+)*"
_TRIM = "' ' || chr(9) || chr(10) || chr(13)"
_sql_text = lambda text: "'" + re.sub(r"\$(\d)", r"\\\1", text.replace("'", "''")) + "'"
_PRELUDE = rf"""
d as (select doc_id, coalesce(text, '') as t from documents),
parts as (
  select doc_id, unnest(range(0, len(p))) as n, unnest(p) as part, unnest(list_append(g, '')) as gap
  from (select doc_id, regexp_split_to_array(t, '(?:[ \t\r]*\n){{2,}}') as p, regexp_extract_all(t, '(?:[ \t\r]*\n){{2,}}') as g from d)
),
placed as (
  select doc_id, n, part, coalesce(sum(length(part) + length(gap)) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as pos0 from parts
),
blocks as (
  select doc_id, (row_number() over (partition by doc_id order by n) - 1)::int as block_id, 'paragraph' as kind, 0 as level,
    trim(part, {_TRIM}) as text, (pos0 + length(part) - length(ltrim(part, {_TRIM})))::int as begin_at
  from placed where trim(part, {_TRIM}) <> ''
),
cut as (select *, string_split(@MARKED@, chr(1)) as pieces from blocks),
pieces as (
  select doc_id, block_id, kind, begin_at, unnest(range(0, len(pieces))) as sent_id, unnest(pieces) as piece from cut
),
pieces_at as (
  select *, coalesce(sum(length(piece)) over (partition by doc_id, block_id order by sent_id rows between unbounded preceding and 1 preceding), 0) as pos0 from pieces
),
sentences as (
  select doc_id, block_id, sent_id::int as sent_id, kind, (begin_at + pos0 + length(piece) - length(ltrim(piece, {_TRIM})))::int as begin_at,
    trim(piece, {_TRIM}) as text, len(regexp_extract_all(piece, '{_WORD}'))::int as n_words
  from pieces_at where trim(piece, {_TRIM}) <> ''
),
token_lists as (
  select doc_id, block_id, sent_id, begin_at, regexp_extract_all(text, '{_WORD}') as w, regexp_split_to_array(text, '{_WORD}') as g from sentences
),
token_rows as (
  select doc_id, block_id, sent_id, begin_at, unnest(range(0, len(w)))::int as tok_id, unnest(w) as form, unnest(g[1:len(w)]) as gap from token_lists where len(w) > 0
),
tokens as (
  select doc_id, block_id, sent_id, tok_id, form, gap,
    (begin_at + sum(length(gap) + length(form)) over (partition by doc_id, block_id, sent_id order by tok_id rows between unbounded preceding and current row))::int as stop_at
  from token_rows
),
near as (
  select *, stop_at - length(form) as begin_at, lead(form) over w as next_form, lead(gap) over w as next_gap, lead(stop_at) over w as next_stop,
    lead(form, 2) over w as next2_form, lead(gap, 2) over w as next2_gap, lead(stop_at, 2) over w as next2_stop, lag(form) over w as before_form
  from tokens window w as (partition by doc_id, block_id, sent_id order by tok_id)
)
"""
_MARKED = functools.reduce(lambda sql, m: f"regexp_replace({sql}, {_sql_text(m[0])}, {_sql_text(m[1])}, 'g')", marks(), "text")
_PRELUDE = _PRELUDE.replace("@MARKED@", _MARKED)



def _sql(body: str, extra: str = "") -> str:
    return f"with {_PRELUDE}{', ' + extra if extra else ''} {body}"


def _sql_with(body: str, sentence: str, extra: str = "") -> str:
    """_sql() over the documents of corpus_with()."""
    return _sql(body, extra).replace("select doc_id, coalesce(text, '') as t from documents", f"select doc_id, coalesce(text, '') || chr(10) || chr(10) || ({sentence}) as t from documents", 1)


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


_AT = ["doc_id", "block_id", "sent_id"]

# Segmentation ---------------------------------------------------------------------------------


@query(_sql("select doc_id, block_id, sent_id, begin_at as begin, text, n_words from sentences"))
def sentences(spark, d):
    return corpus_of(spark, d).sentences.select(*_AT, "begin", "text", "n_words")


@query(_sql("select doc_id, block_id, sent_id, tok_id, form, begin_at as begin, stop_at as stop from near"))
def tokens(spark, d):
    return corpus_of(spark, d).tokens.drop("gap")


@query(_sql("select doc_id, lower(form) as word, count(*) as n from tokens group by all having count(*) > 1"))
def doc_token_freq(spark, d):
    return corpus_of(spark, d).tokens.groupBy("doc_id", F.lower("form").alias("word")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(_sql("select doc_id, sum(n_words)::bigint as n_words, count(*) as n_sentences, max(n_words) as longest from sentences group by doc_id"))
def word_counts(spark, d):
    return corpus_of(spark, d).sentences.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_sentences"), F.max("n_words").alias("longest"))


_HTML = r"""
e as (
  select page_id as doc_id, unnest(range(0, len(x)))::int as block_id, unnest(x) as element
  from (select page_id, regexp_extract_all(coalesce(html, ''), '(?is)<(?:h[1-6]|p|li)(?:\s[^>]*)?>.*?</(?:h[1-6]|p|li)>') as x from pages)
),
page_blocks as (
  select doc_id, block_id, case when tag = 'p' then 'paragraph' when tag = 'li' then 'list-item' else 'heading' end as kind,
    case when tag like 'h%' then substr(tag, 2, 1)::int else 0 end as level, trim(t, ' ' || chr(9) || chr(10) || chr(13)) as text
  from (select *, lower(regexp_extract(element, '^<([a-zA-Z0-9]+)', 1)) as tag,
    replace(replace(replace(replace(replace(replace(regexp_replace(element, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') as t from e)
  where trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> ''
)
"""


@query(f"with {_HTML} select * from page_blocks")
def blocks_html(spark, d):
    return html_blocks(table(spark, d, "pages"))


@query(r"with m as (select doc_id, strpos(text, '.') as p, text from documents where strpos(text, '.') > 0) select doc_id, len(string_split(substr(text, 1, p - 1), chr(10)))::int as line, (length(string_split(substr(text, 1, p - 1), chr(10))[-1]) + 1)::int as col from m")
def line_col(spark, d):
    docs = table(spark, d, "documents").withColumn("p", F.locate(".", F.col("text")) - 1).where("p >= 0")
    return docs.select("doc_id", X.line_of(F.col("text"), F.col("p")).alias("line"), X.column_of(F.col("text"), F.col("p")).alias("col"))


# Rule kinds -----------------------------------------------------------------------------------


def _grams() -> str:
    one = "select doc_id, block_id, sent_id, tok_id, begin_at, stop_at, form as match, lower(form) as gram, 1 as n from near"
    two = "select doc_id, block_id, sent_id, tok_id, begin_at, next_stop, form || next_gap || next_form, lower(form || ' ' || next_form), 2 from near where next_form is not null"
    three = "select doc_id, block_id, sent_id, tok_id, begin_at, next2_stop, form || next_gap || next_form || next2_gap || next2_form, lower(form || ' ' || next_form || ' ' || next2_form), 3 from near where next2_form is not null"
    return f"grams as ({one} union all {two} union all {three})"


def _greedy(items: str) -> str:
    """Longest first, then leftmost: with items of up to three words an item stands if no stronger standing one overlaps; solved by levels."""
    return f"""{_grams()},
items(item, n, fix) as (values {items}),
hits as (select g.*, i.fix from grams g join items i on g.gram = i.item and g.n = i.n),
l3 as (select * from (select *, row_number() over (partition by doc_id, block_id, sent_id order by tok_id) as r from hits where n = 3)),
k3 as (select * from l3),
h2 as (select * from hits h where n = 2 and not exists (select 1 from k3 k where k.doc_id = h.doc_id and k.block_id = h.block_id and k.sent_id = h.sent_id and k.tok_id < h.tok_id + 2 and h.tok_id < k.tok_id + 3)),
run2 as (select *, tok_id - row_number() over (partition by doc_id, block_id, sent_id order by tok_id) as island from h2),
k2 as (select * from (select *, row_number() over (partition by doc_id, block_id, sent_id, island order by tok_id) as r from run2) where r % 2 = 1)
"""


@query(_sql("select doc_id, block_id, sent_id, begin_at as begin, stop_at as stop, match from k2 union all select doc_id, block_id, sent_id, begin_at, stop_at, match from k3", _greedy(", ".join(f"('{w}', {len(w.split())}, '')" for w in HEDGES if len(w.split()) > 1))))
def words_surface(spark, d):
    items = kinds.phrase_items(spark, [(w, None) for w in HEDGES])
    return kinds.words(corpus_of(spark, d), items, 3).select(*_AT, "begin", "stop", "match")


@query(_sql(r"select doc_id, block_id, sent_id, (begin_at + list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::int as begin, m[i] as match, regexp_replace(m[i], '^([A-Za-z]+), and', '\1 and') as fixed from (select *, unnest(range(1, len(m) + 1)) as i from (select *, regexp_extract_all(text, '\b[A-Za-z]+, and\b') as m, regexp_split_to_array(text, '\b[A-Za-z]+, and\b') as g from sentences where not regexp_matches(text, 'by the') and list_contains(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)), 'and')))"))
def regex_rules(spark, d):
    found = kinds.regex(corpus_of(spark, d).sentences, r"\b([A-Za-z]+), and\b", needs=["and"], unless="by the", replace="$1 and")
    return found.select(*_AT, "begin", "match", "fixed")


@query(_sql("select doc_id, block_id, sent_id, begin_at as begin, form as match from near where lower(form) in ('idiot', 'stupid', 'pathetic', 'worthless', 'clown', 'loser') and lower(form) <> 'clown'"))
def existence(spark, d):
    found = kinds.existence(corpus_of(spark, d).sentences, ["idiot", "stupid", "pathetic", "worthless", "clown", "loser"], ignore_case=True, exceptions=["clown"])
    return found.select(*_AT, "begin", "match")


def _case(model: str, word: str) -> str:
    capital = f"upper(substr({word}, 1, 1)) || substr({word}, 2)"
    return f"case when length({model}) > 1 and upper({model}) = {model} and lower({model}) <> {model} then upper({word}) when regexp_matches({model}, '^\\p{{Lu}}') then {capital} else {word} end"


@query(_sql(f"select doc_id, block_id, sent_id, begin_at as begin, match, case when fix not like '%|%' then {_case('match', 'fix')} end as fixed from k2 where fix like '%|%' or match <> {_case('match', 'fix')}", _greedy(", ".join(f"('{k}', 2, '{v}')" for k, v in SWAPS.items()))))
def substitution(spark, d):
    return kinds.substitution(corpus_of(spark, d), SWAPS).select(*_AT, "begin", "match", "fixed")


@query(_sql(r"select doc_id, block_id, sent_id, begin_at as begin, text as match from (select *, lead(text) over (partition by doc_id, block_id order by sent_id) as n from sentences) where regexp_matches(text, '^The ') and regexp_matches(n, '^(And|Of|In) ')"))
def sentence_pair(spark, d):
    return kinds.sentence_pair(corpus_of(spark, d), "^The ", "^(And|Of|In) ").select(*_AT, "begin", "match")


@query(_sql("select doc_id, block_id, sent_id, begin_at as begin, n_words from sentences where n_words > 35"))
def sentence_length(spark, d):
    return kinds.sentence_length(corpus_of(spark, d), 35).select(*_AT, "begin", "n_words")


@query(_sql("select t.doc_id, count(*) as n from (select doc_id from sentences, unnest(regexp_extract_all(text, '!')) u) t join (select doc_id, sum(n_words) as total from sentences group by doc_id) s using (doc_id) group by t.doc_id, s.total having count(*) * 100 / greatest(s.total, 1) > 1.0"))
def density(spark, d):
    return kinds.density(corpus_of(spark, d), ["!"], [], 100, 1.0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_DOUBLED = f"lower(form) = lower(next_form) and lower(form) in {_in(kinds.DOUBLED)} and regexp_matches(next_gap, '^[ \\t]+$') and not coalesce(lower(next2_form) = lower(form), false) and not coalesce(lower(before_form) = lower(form), false)"


@query(_sql(f"select doc_id, block_id, sent_id, begin_at as begin, next_stop as stop, form || next_gap || next_form as match, form as fixed from near where {_DOUBLED}"))
def repeated_word(spark, d):
    return kinds.repeated_word(corpus_of(spark, d)).select(*_AT, "begin", "stop", "match", "fixed")


@query(_sql("select doc_id, block_id, sent_id, begin_at as begin, form || next_gap || next_form as match from near where form in ('a', 'an', 'the') and next_form in ('a', 'an', 'the') and form <> next_form and regexp_matches(next_gap, '^[ \\t]+$')"))
def double_article(spark, d):
    return kinds.double_article(corpus_of(spark, d)).select(*_AT, "begin", "match")


_AN = "case when regexp_matches(f, '^\\p{Lu}{2}') then contains('" + X.VOWEL_NAMES + "', substr(f, 1, 1)) when lower(f) in ('one', 'once') then false when regexp_matches(lower(f), '^(" + "|".join(X.CONSONANT_SOUNDS) + ")') then false when regexp_matches(lower(f), '^(" + "|".join(X.VOWEL_SOUNDS) + ")') then true when starts_with(lower(f), 'uni') then null when regexp_matches(lower(f), '^([aeio]|u[nmplgtr])') then true when regexp_matches(lower(f), '^[b-df-gj-np-tv-wyz]') then false end"


@query(_sql(f"select doc_id, block_id, sent_id, begin_at as begin, form as match, next_form as word, case when form like 'A%' then case when an then 'An' else 'A' end else case when an then 'an' else 'a' end end as fixed from (select *, {_AN} as an from (select *, regexp_extract(next_form, '^[\\p{{L}}\\p{{N}}''’]+') as f from near where form in ('a', 'an', 'A', 'An') and regexp_matches(next_gap, '^[ \\t]+$'))) where an <> (lower(form) = 'an')"))
def articles(spark, d):
    return kinds.articles(corpus_of(spark, d)).select(*_AT, "begin", "match", "word", "fixed")


_VARIANTS = [("anea", "x", "first", "inea"), ("inea", "x", "second", "anea"), ("thea", "x", "first", "ofea"), ("ha", "x", "second", "he"), ("he", "x", "first", "ha"), ("or", "y", "first", "er"), ("er", "y", "second", "or")]


@query(_sql("select distinct doc_id, block_id, sent_id, begin_at as begin, form as match, winner from used join ranked using (doc_id, axis) where variety <> winner", "v(word, axis, variety, other) as (values " + ", ".join(map(str, _VARIANTS)) + "), used as (select n.*, v.axis, v.variety from near n join v on lower(n.form) = v.word where n.tok_id = 0 or lower(n.form) = n.form), ranked as (select doc_id, axis, arg_max(variety, (n, -f)) as winner from (select doc_id, axis, variety, count(*) as n, min(begin_at) as f from used group by all) group by all)"))
def consistency(spark, d):
    listed = spark.createDataFrame(_VARIANTS, "word string, axis string, variety string, other string")
    return kinds.consistency(corpus_of(spark, d), F.broadcast(listed)).select(*_AT, "begin", "match", "winner")


_PLAIN = f"length(regexp_replace({{c}}, '[^\\p{{{{Lu}}}}]', '', 'g')) <= 1 and lower({{c}}) not in {_in(kinds.DOUBLED)}"


@query(_sql("select doc_id, key, spelling, begin_at as begin, winner, n as times from spelt join counts using (doc_id, key, spelling) join best using (doc_id, key) where spellings > 1 and joined and spelling <> winner", f"spelt as (select doc_id, begin_at, replace(lower(form), '-', '') as key, lower(form) as spelling from near where {_PLAIN.format(c='form')} union all select doc_id, begin_at, lower(form) || lower(next_form), lower(form) || ' ' || lower(next_form) from near where {_PLAIN.format(c='form')} and {_PLAIN.format(c='next_form')} and next_gap = ' ' and form not like '%-%' and next_form not like '%-%'), counts as (select doc_id, key, spelling, count(*) as n, min(begin_at) as f from spelt where length(key) >= 5 group by all), best as (select doc_id, key, count(*) as spellings, bool_or(spelling not like '% %') as joined, arg_max(spelling, (spelling = 'ofthe', n, -f)) as winner from counts group by all)"))
def variants(spark, d):
    terms = spark.createDataFrame([("c9", "OfThe", "preferred", False)], "concept string, term string, status string, exact boolean")
    found = kinds.variants(corpus_of(spark, d), terms=terms)
    return found.select("doc_id", "key", "spelling", "begin", "winner", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "key", "spelling")).alias("times"))


_ACRONYM = r"acro as (select *, regexp_replace(form, '(\p{Lu})s$', '\1') as sf from near), ac as (select * from acro where length(sf) between 2 and 8 and regexp_matches(sf, '^[\p{Lu}\p{Ll}0-9]+$') and length(regexp_replace(sf, '[^\p{Lu}]', '', 'g')) >= 2 and length(regexp_replace(sf, '[^\p{Lu}]', '', 'g')) * 2 >= length(sf) and not regexp_matches(sf, '^[IVXLCDM]+$') and not regexp_matches(sf, '\p{Ll}{3}') and not coalesce(regexp_matches(before_form, '^[\p{Lu}]{2,}$|^[0-9]'), false) and not coalesce(regexp_matches(next_form, '^[\p{Lu}]{2,}$|^[0-9]'), false))"


#: A paragraph with acronyms: defined ahead, behind or in words, late, twice, once, never, or first in a heading.
_SHORT = """case doc_id % 8
  when 0 then 'The Random Access Memory (RAM) holds it. Then RAM is read.' when 1 then 'We read RAM twice. The random-access memory (RAM) holds it.'
  when 2 then 'A NATO (North Atlantic Treaty Organization) plan. The NATO plan.' when 3 then 'Our SLA stands for service level agreement, as said.'
  when 4 then 'The hypertext markup language (HTML) is old. The HyperText Mark Language (HTML) is new, says HTML.' when 5 then 'The CPU and the GPUs run. A note (FYI) about CPU.'
  when 6 then 'The XQZ (no long form here) stays. XQZ again.' else 'About the QPS rule' || chr(10) || chr(10) || 'Queries per second (QPS) rise. More QPS.' end"""
_DEFINED = _ACRONYM + r""",
placed_ac as (
  select a.doc_id, a.sf, a.begin_at, s.kind, regexp_split_to_array(trim(regexp_replace(substr(s.text, 1, a.begin_at - s.begin_at), '\s*\($', '')), '\s+') as w,
    suffix(substr(s.text, 1, a.begin_at - s.begin_at), '(') as opened, substr(s.text, a.stop_at - s.begin_at + 1) as after,
    '^(?s:.*?)' || array_to_string(regexp_split_to_array(reverse(lower(regexp_replace(a.sf, '[^\p{L}\p{N}]', '', 'g'))), ''), '(?s:.*?)') || '(?:$|\s|[^\p{L}\p{N}\s]\S*)' as pat
  from ac a join sentences s using (doc_id, block_id, sent_id)
),
tails as (
  select *, array_to_string(w[greatest(1, len(w) - least(length(sf) + 5, 2 * length(sf)) + 1):], ' ') as tail, trim(regexp_extract(after, '^ ?\(([^()]{1,80})\)', 1)) as inside,
    trim(regexp_extract(after, '^\s*,?\s*(?:stands for|is short for|is an abbreviation (?:for|of)|is an acronym for)\s+([^,.;:]+)', 1)) as stands from placed_ac
),
uses as (
  select doc_id, sf, begin_at, kind, lower(coalesce(
    case when opened and regexp_matches(after, '^\s*\)') and trim(reverse(regexp_extract(reverse(lower(tail)), pat))) not in ('', lower(sf)) then trim(reverse(regexp_extract(reverse(lower(tail)), pat))) end,
    case when len(regexp_split_to_array(inside, '\s+')) >= 2 and trim(reverse(regexp_extract(reverse(lower(inside)), pat))) not in ('', lower(sf)) then inside end, nullif(stands, ''))) as long
  from tails
),
defs as (select doc_id, sf, min(begin_at) as def_begin, count(*) as defs, arg_min(long, begin_at) as first_long from uses where long is not null group by all)"""


def _headed(corpus: Corpus) -> Corpus:
    """Short blocks without an end mark become headings."""
    heading = (F.length("text") <= 60) & ~F.col("text").rlike("[.!?…]")
    return Corpus(corpus.docs, corpus.blocks.withColumn("kind", F.when(heading, "heading").otherwise("paragraph")))


def _acronym_rows(check: str, body: str):
    def run(spark, d):
        return kinds.acronyms(_headed(corpus_with(spark, d, _SHORT)), check, ["AND", "THE"]).select("doc_id", "sf", "begin")

    run.__name__ = f"acronym_{check.replace('-', '_')}"
    headed = _sql_with(body, _SHORT, _DEFINED).replace("'paragraph' as kind", f"case when length(trim(part, {_TRIM})) <= 60 and not regexp_matches(part, '[.!?…]') then 'heading' else 'paragraph' end as kind", 1)
    return query(headed)(run)


_acronym_rows("undefined", "select doc_id, sf, min(begin_at) as begin from uses where kind <> 'heading' and sf not in ('AND', 'THE') and (doc_id, sf) not in (select (doc_id, sf) from defs) group by all")
_acronym_rows("defined-after-use", "select doc_id, sf, begin from (select doc_id, sf, min(begin_at) as begin from uses where kind <> 'heading' group by all) join defs using (doc_id, sf) where begin < def_begin and sf not in ('AND', 'THE')")
_acronym_rows("used-once", "select doc_id, sf, begin from (select doc_id, sf, min(begin_at) as begin, count(*) as n from uses group by all) join defs using (doc_id, sf) where n = 1 and defs = 1")
_acronym_rows("redefined", "select doc_id, sf, begin_at as begin from uses join defs using (doc_id, sf) where long <> first_long")
_acronym_rows("first-use-in-heading", "select doc_id, sf, begin from (select doc_id, sf, min(begin_at) as begin, arg_min(kind, begin_at) as k from uses group by all) where k = 'heading' and sf not in ('AND', 'THE')")


@query(_sql("select doc_id, block_id, sent_id, begin_at as begin, match from k2", _greedy("('the and', 2, 'the'), ('of that', 2, '')")))
def glossary_deprecated(spark, d):
    terms = spark.createDataFrame(TERMS, "concept string, term string, status string, exact boolean")
    return kinds.glossary(corpus_of(spark, d), terms, "deprecated").select(*_AT, "begin", "match")


@query(_sql("select doc_id, block_id, sent_id, begin_at as begin, match from k2 where match <> 'In The'", _greedy("('in the', 2, 'In The')")))
def glossary_casing(spark, d):
    terms = spark.createDataFrame(TERMS, "concept string, term string, status string, exact boolean")
    return kinds.glossary(corpus_of(spark, d), terms, "casing").select(*_AT, "begin", "match")


#: The word and its forms with one character less: two words share one if an edit or a swap of neighbours leads from one to the other.
_DELETED = "list_distinct(list_append(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)), word))"
_NEAR = """abs(length(a) - length(b)) <= 1 and (length(a) <> length(b) or len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1
  or list_contains(list_transform(range(1, length(b)), lambda i: substr(b, 1, i - 1) || substr(b, i + 1, 1) || substr(b, i, 1) || substr(b, i + 2)), a))"""
_LEX = r"lex as (select lower(replace(form, '’', '''')) as word, count(distinct doc_id) as docs from tokens where regexp_matches(form, '^\p{Ll}[\p{Ll}''’-]*$') group by 1 having count(distinct doc_id) >= 20)"


@query(_sql("select doc_id, word as match, begin from once where word in (select a from pairs where " + _NEAR + ")", _LEX + r", o as (select doc_id, form as word, min(begin_at) as begin from near where regexp_matches(form, '^\p{Ll}{6,}$') group by all having count(*) = 1), once as (select * from o where word not in (select word from lex)), wrong as (select distinct word from once), wrong_keys as (select word, unnest(" + _DELETED + ") as k from wrong), lex_keys as (select word, unnest(" + _DELETED + ") as k from lex), pairs as (select distinct w.word as a, l.word as b from wrong_keys w join lex_keys l using (k))"))
def spelling_candidates(spark, d):
    c = corpus_of(spark, d)
    return kinds.spelling(c, kinds.lexicon(c, 20), min_length=6).select("doc_id", "match", "begin")


@query(_sql(r"select doc_id, word as match, begin, n as times from u where exists (select 1 from lex where lex.word in (stem, stem || 'e', regexp_replace(stem, 'i$', 'y')))", _LEX + rf", u as (select *, regexp_extract(word, '^(\p{{Ll}}{{3,}}?)({'|'.join(kinds.SUFFIXES)})$', 1) as stem from (select doc_id, form as word, count(*) as n, min(begin_at) as begin from near where regexp_matches(form, '^(\p{{Ll}}{{3,}}?)({'|'.join(kinds.SUFFIXES)})$') group by all) where word not in (select word from lex))"))
def coined_words(spark, d):
    c = corpus_of(spark, d)
    return kinds.coined_words(c, kinds.lexicon(c, 20)).select("doc_id", "match", "begin", "times")


_NAMES = "case doc_id % 3 when 0 then 'We call it the Second Mover Principle. The Second Mover Principle holds.' when 1 then 'Our Long Tail Effect and the Dead Letter Model fit.' else 'A Model of no name.' end"


@query(_sql_with(rf"select doc_id, block_id, sent_id, begin, match from (select *, row_number() over (partition by doc_id, regexp_replace(match, '^\p{{L}}+ ', '') order by begin) as r from (select doc_id, block_id, sent_id, match, (begin_at + sum(length(g) + length(match)) over (partition by doc_id, block_id, sent_id order by i) - length(match))::int as begin from (select doc_id, block_id, sent_id, begin_at, unnest(m) as match, unnest(g[1:len(m)]) as g, unnest(range(0, len(m))) as i from (select *, regexp_extract_all(text, '@N@') as m, regexp_split_to_array(text, '@N@') as g from sentences)))) where r = 1".replace("@N@", rf"\b(?:[Tt]he|[Oo]ur|[Aa]n?) (?:\p{{Lu}}\p{{Ll}}+ ){{1,3}}(?:{'|'.join(kinds.HEADS)})\b"), _NAMES))
def concept_names(spark, d):
    return kinds.concept_names(corpus_with(spark, d, _NAMES)).select(*_AT, "begin", "match")


#: A paragraph with hyphenated words, one kind for each remainder of the id.
_HYPHENS = "case doc_id % 4 when 0 then 'A state-of-the-art newly-built tool.' when 1 then 'An early-stage, fully-fledged one by one-two-three.' when 2 then 'The plain-text file.' else 'Family-run, boldly-made, up-to-date work.' end"


@query(_sql_with(r"select doc_id, block_id, sent_id, begin_at as begin, form as match, len(string_split(form, '-'))::int as parts from near where regexp_matches(form, '^\p{L}+(-\p{L}+){2,}$')", _HYPHENS))
def hyphen_chain(spark, d):
    return kinds.hyphen_chain(corpus_with(spark, d, _HYPHENS), []).select(*_AT, "begin", "match", "parts")


@query(_sql_with(rf"select doc_id, block_id, sent_id, begin_at as begin, form as match, replace(form, '-', ' ') as fixed from near where regexp_matches(form, '^\p{{L}}{{2,}}ly-\p{{L}}+$') and lower(string_split(form, '-')[1]) not in {_in(kinds.NOT_ADVERBS)}", _HYPHENS))
def ly_hyphen(spark, d):
    return kinds.ly_hyphen(corpus_with(spark, d, _HYPHENS)).select(*_AT, "begin", "match", "fixed")


# Shallow grammar ------------------------------------------------------------------------------

_TAG = rf"""tagged as (select *, case when regexp_matches(form, '^[0-9]') then 'CD' when lower(form) in {_in(shallow.DETERMINERS)} then 'DT' when lower(form) in {_in(shallow.PREPOSITIONS)} then 'IN'
  when lower(form) in {_in(shallow.PRONOUNS)} then 'PRP' when lower(form) in {_in(shallow.CONJUNCTIONS)} then 'CC' when lower(form) = 'to' then 'TO' when lower(form) in {_in(shallow.MODALS)} then 'MD'
  when lower(form) in ('is', 'was', 'has', 'does') then 'VBZ' when lower(form) in {_in(shallow.BE)} then 'VBP' when lower(form) in {_in(shallow.NEGATIONS)} then 'RB' when lower(form) in {_in(shallow.PARTICIPLES)} then 'VBN'
  when regexp_matches(form, '^\p{{Lu}}') and tok_id <> 0 then case when regexp_matches(form, 's$') then 'NNPS' else 'NNP' end
  when regexp_matches(lower(form), 'ly$') then 'RB' when regexp_matches(lower(form), '\p{{L}}{{2,}}ing$') then 'VBG' when regexp_matches(lower(form), '\p{{L}}{{2,}}ed$') then 'VBN'
  when regexp_matches(lower(form), '(ous|ful|ive|able|ible|al|ic|less|ary|ish)$') then 'JJ' when regexp_matches(lower(form), '(ss|us|is)$') then 'NN' when regexp_matches(lower(form), 's$') then 'NNS' else 'NN' end as tag from near)"""


@query(_sql("select tag, count(*) as n from tagged group by tag", _TAG))
def pos_tags(spark, d):
    return shallow.tagged(corpus_of(spark, d)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(_sql("select chunk, count(*) as n from (select case when cls is null then 'O' when coalesce(before = cls, false) and tag not in ('DT', 'PRP', 'IN') and gap not like '%,%' then 'I-' || cls else 'B-' || cls end as chunk from (select *, lag(cls) over (partition by doc_id, block_id, sent_id order by tok_id) as before from (select *, case when tag in ('DT', 'JJ', 'NN', 'NNS', 'NNP', 'NNPS', 'CD', 'PRP') then 'NP' when tag in ('MD', 'VBZ', 'VBP', 'VBN', 'VBG', 'TO') then 'VP' when tag = 'IN' then 'PP' when tag = 'RB' then 'ADVP' end as cls from tagged))) group by chunk", _TAG))
def base_chunks(spark, d):
    return shallow.chunks(corpus_of(spark, d)).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query(_sql("select doc_id, block_id, sent_id, min(begin_at) as begin, count(*) as n from (select *, sum((not noun or not regexp_matches(gap, '^[ \\t\\n]*$'))::int) over (partition by doc_id, block_id, sent_id order by tok_id) as island from (select *, tag in ('NN', 'NNS') and lower(form) = form as noun from tagged)) where noun group by doc_id, block_id, sent_id, island having count(*) >= 4", _TAG))
def noun_stack_shallow(spark, d):
    return shallow.noun_stacks(corpus_of(spark, d), 4).select(*_AT, "begin", "n")


#: A paragraph of modifiers: at the least number of them, one short of it, and at it but thin among other words.
_MODIFIERS = "case doc_id % 3 when 0 then 'A useful, highly readable, plainly global plan.' when 1 then 'A really useful, highly readable plan.' else 'The really useful plan of the group went from the town to the coast by a highly readable and global map of the land and the sea.' end"


@query(_sql_with("select doc_id, block_id, sent_id, sum((tag in ('JJ', 'RB'))::int)::bigint as n_modifiers, count(*) as n_words from tagged group by all having sum((tag in ('JJ', 'RB'))::int) >= 5 and sum((tag in ('JJ', 'RB'))::int) >= 0.3 * count(*)", _MODIFIERS, _TAG))
def modifier_density(spark, d):
    return shallow.modifier_density(corpus_with(spark, d, _MODIFIERS)).select(*_AT, "n_modifiers", "n_words")


@query(_sql(f"select doc_id, block_id, sent_id, begin_at as begin, case when t1 = 'VBN' then f1 when t2 = 'VBN' then f2 else f3 end as participle from (select *, lead(tag) over w as t1, lead(tag, 2) over w as t2, lead(tag, 3) over w as t3, lead(form) over w as f1, lead(form, 2) over w as f2, lead(form, 3) over w as f3 from tagged window w as (partition by doc_id, block_id, sent_id order by tok_id)) where lower(form) in {_in(shallow.BE)} and (t1 = 'VBN' or (t1 = 'RB' and (t2 = 'VBN' or (t2 = 'RB' and t3 = 'VBN'))))", _TAG))
def passive_shallow(spark, d):
    return shallow.passives(corpus_of(spark, d)).select(*_AT, "begin", "participle")


@query(_sql(f"select doc_id, block_id, sent_id, count(*) as n from tokens where lower(form) in {_in(shallow.NEGATIONS)} or regexp_matches(lower(form), 'n[''’]t$') group by all having count(*) >= 2"))
def stacked_negation(spark, d):
    return shallow.stacked_negations(corpus_of(spark, d)).select(*_AT, "n")


@query(_sql(r"select doc_id, block_id, sent_id, begin_at as begin from sentences where regexp_matches(text, '^(?:This|That) (?:is|was|will|can|may|might|must|should|would|means|makes|gives|shows|has|does)\b')"))
def bare_demonstrative(spark, d):
    return shallow.bare_demonstratives(corpus_of(spark, d)).select(*_AT, "begin")


@query(_sql(r"select doc_id, block_id, sent_id, past, n, n_past from (select *, count(*) over b as n, sum(past) over b as n_past from (select doc_id, block_id, sent_id, p::int as past from (select *, regexp_matches(lower(text), '\b(was|were|had|did)\b') as p, regexp_matches(lower(text), '\b(is|are|has|does)\b') as q from sentences) where p <> q) window b as (partition by doc_id, block_id)) where n >= 3 and ((n_past >= n * (2.0 / 3.0)::double and past = 0) or (n_past < n * (2.0 / 3.0)::double and n - n_past >= n * (2.0 / 3.0)::double and past = 1))"))
def tense_shift_shallow(spark, d):
    return shallow.tense_shifts(corpus_of(spark, d)).select(*_AT, "past", "n", F.col("n_past"))


@query(_sql("select doc_id, l.b as block_id, l.s as sent_id, min(e).b as of_block, min(e).s as of_sent from (select a.doc_id, {'b': a.block_id, 's': a.sent_id} as l, {'b': b.block_id, 's': b.sent_id} as e, a.n, count(*) as c from sized a join sized b on a.doc_id = b.doc_id and a.word = b.word and (b.block_id, b.sent_id) < (a.block_id, a.sent_id) group by all) where c * 100 >= n * 80 group by doc_id, l", "content as (select distinct doc_id, block_id, sent_id, lower(form) as word from tokens where length(form) >= 4), sized as (select * from (select *, count(*) over (partition by doc_id, block_id, sent_id) as n from content) where n >= 4)"))
def restatement(spark, d):
    return shallow.restatements(corpus_of(spark, d))


#: A paragraph with lists of words, of three members and of others.
_LISTS = "case doc_id % 4 when 0 then 'We like fast, small and safe tools, or old, worn, or lost ones.' when 1 then 'Red, green, blue and black paint.' when 2 then 'Salt and pepper.' else 'Née, été, and naïve words.' end"
_LIST = r"\p{L}+(?:, \p{L}+)+,? (?:and|or) \p{L}+"


@query(_sql_with("select doc_id, block_id, sent_id, begin, match, n from (select *, len(regexp_extract_all(regexp_replace(match, ',? (and|or) ', ', ', 'g'), '\\p{L}+'))::int as n from (select doc_id, block_id, sent_id, match, (begin_at + sum(length(g) + length(match)) over (partition by doc_id, block_id, sent_id order by i) - length(match))::int as begin from (select doc_id, block_id, sent_id, begin_at, unnest(m) as match, unnest(g[1:len(m)]) as g, unnest(range(0, len(m))) as i from (select *, regexp_extract_all(text, '@P@') as m, regexp_split_to_array(text, '@P@') as g from sentences)))) where n = 3".replace("@P@", _LIST), _LISTS))
def rule_of_three_shallow(spark, d):
    return shallow.coordinations(corpus_with(spark, d, _LISTS)).select(*_AT, "begin", "match", "n")


@query()
def agreement_shallow(spark, d):
    return shallow.agreement(corpus_of(spark, d)).select(*_AT, "begin", "rule", "match", "fixed")


@query(_sql("select doc_id, block_id, sent_id, count(*) filter (where length(form) >= 4) as n, count(*) filter (where length(form) >= 4 and lower(form) in (select word from lex)) as n_abstract from tagged group by doc_id, block_id, sent_id having count(*) filter (where length(form) >= 4) >= 3 and count(*) filter (where length(form) >= 4 and lower(form) in (select word from lex)) * 100 >= 80 * count(*) filter (where length(form) >= 4) and not bool_or(tag in ('NNP', 'NNPS', 'CD'))", _LEX + ", " + _TAG))
def vacuous(spark, d):
    c = corpus_of(spark, d)
    return shallow.vacuous(c, kinds.lexicon(c, 20)).select(*_AT, "n", "n_abstract")


# Structure ------------------------------------------------------------------------------------

_ARTICLE = "blk as (select doc_id, block_id, case when length(text) <= 40 then 'heading' else 'paragraph' end as kind, case when length(text) <= 40 then (length(text) % 3 + 1)::int else 0 end as level, text from (select doc_id, unnest(range(0, len(l)))::int as block_id, unnest(l) as text from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)) where text <> ''), nx as (select *, lead(kind) over w as next_kind, lead(level) over w as next_level from blk window w as (partition by doc_id order by block_id))"


@query(f"with {_ARTICLE} select doc_id, block_id, level, before as from_level from (select *, lag(level) over (partition by doc_id order by block_id) as before from blk where kind = 'heading') where level > before + 1")
def heading_increment(spark, d):
    return structure.heading_increment(article_blocks(spark, d)).select("doc_id", "block_id", "level", "from_level")


@query(f"with {_ARTICLE} select doc_id, block_id, total from (select *, row_number() over (partition by doc_id order by block_id) as n, count(*) over (partition by doc_id) as total from blk where kind = 'heading' and level = 1) where n > 1")
def single_h1(spark, d):
    return structure.single_h1(article_blocks(spark, d)).select("doc_id", "block_id", "total")


@query(f"with {_ARTICLE} select doc_id, block_id, level from nx where kind = 'heading' and (next_kind is null or (next_kind = 'heading' and next_level <= level))")
def empty_section(spark, d):
    return structure.empty_section(article_blocks(spark, d)).select("doc_id", "block_id", "level")


@query(f"with {_ARTICLE} select doc_id, block_id, level from nx where kind = 'heading' and next_kind = 'heading' and next_level > level")
def stacked_headings(spark, d):
    return structure.stacked_headings(article_blocks(spark, d)).select("doc_id", "block_id", "level")


@query(f"with {_ARTICLE}, h as (select * from blk where kind = 'heading'), p as (select h.*, (select max(b.block_id) from h b where b.doc_id = h.doc_id and b.block_id < h.block_id and b.level < h.level) as parent from h), q as (select p.*, h.level as pl from p join h on h.doc_id = p.doc_id and h.block_id = p.parent) select doc_id, block_id, level from (select *, count(*) over (partition by doc_id, parent) as n from q where level = pl + 1) where n = 1")
def lone_subsection(spark, d):
    return structure.lone_subsection(article_blocks(spark, d)).select("doc_id", "block_id", "level")


@query(f"with {_ARTICLE} select doc_id, block_id, level from blk where kind = 'heading' and level > 2")
def depth(spark, d):
    return structure.depth(article_blocks(spark, d), 2).select("doc_id", "block_id", "level")


_CHUNKS = r"len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')))"


@query(f"with {_ARTICLE} select doc_id, min(block_id) as block_id, count(*) as n_blocks, sum({_CHUNKS})::bigint as n_words from (select *, sum((kind = 'heading')::int) over (partition by doc_id order by block_id) as island from blk) where kind = 'paragraph' group by doc_id, island having sum({_CHUNKS}) > 150 or count(*) > 2")
def wall_of_text(spark, d):
    return structure.wall_of_text(article_blocks(spark, d), 150, 2)


@query(_sql("select doc_id, block_id, c as n_words, n as n_sentences from (select b.doc_id, b.block_id, " + _CHUNKS.replace("text", "b.text") + "::int as c, s.n from blocks b join (select doc_id, block_id, count(*) as n from sentences group by all) s on b.doc_id = s.doc_id and b.block_id = s.block_id) where c > 150 or n > 8"))
def paragraph_length(spark, d):
    c = corpus_of(spark, d)
    return structure.paragraph_length(c.blocks, c.sentences, 150, 8).select("doc_id", "block_id", "n_words", "n_sentences")


_ARTICLE_PIECES = rf"per as (select doc_id, block_id, count(*) as n_sentences, sum(len(regexp_extract_all(piece, '{_WORD}')))::bigint as n_words from (select doc_id, block_id, trim(unnest(string_split({_MARKED}, chr(1))), {_TRIM}) as piece from blk where kind = 'paragraph') where piece <> '' group by doc_id, block_id)"


@query(f"with {_ARTICLE}, {_ARTICLE_PIECES} select doc_id, block_id, n_words, n_short, n_all from (select *, sum(short::int) over (partition by doc_id)::bigint as n_short, count(*) over (partition by doc_id) as n_all from (select *, n_sentences = 1 and n_words <= 8 as short from per)) where short and n_short >= 3 and n_short >= 0.4 * n_all")
def one_line_paragraphs(spark, d):
    c = Corpus(None, article_blocks(spark, d))
    return structure.one_line_paragraphs(c.blocks, c.sentences)


@query(f"with {_ARTICLE}, l as (select doc_id, min(block_id) as block_id from (select *, sum((kind = 'heading' and level <= 2)::int) over (partition by doc_id order by block_id) as s from blk) where kind = 'paragraph' group by doc_id, s) select b.doc_id, b.block_id from blk b join l using (doc_id, block_id) where regexp_matches(b.text, '^(The|Of|In) ') and not regexp_matches(b.text, '[0-9“\"]|[\\p{{L}},] \\p{{Lu}}')")
def vague_lead(spark, d):
    return structure.vague_lead(article_blocks(spark, d), "^(The|Of|In) ").select("doc_id", "block_id")


@query(f"with {_ARTICLE} select doc_id, block_id from (select doc_id, max(block_id) as block_id, arg_max(text, block_id) as t, count(*) as n from blk where kind = 'heading' and level = 2 group by doc_id) where n >= 2 and regexp_matches(t, '^(The|And|Of|In)')")
def conclusion_at_end(spark, d):
    return structure.conclusion_at_end(article_blocks(spark, d), "^(The|And|Of|In)").select("doc_id", "block_id")


@query()
def parallel_lists_shallow(spark, d):
    return structure.parallel(page_blocks(spark, d), "list-items", 3, 0.6).select("doc_id", "block_id", "form", "wanted")


# Findings and what follows --------------------------------------------------------------------


def _findings(spark, d) -> tuple[Corpus, DataFrame]:
    c = corpus_of(spark, d)
    rules = [
        ("repeated-word", "core.repeated-word", "warning", "“{match}” repeats a word", None),
        ("articles", "core.articles", "warning", "“{match}” does not fit the next word", None),
        ("sentence-length", "plain.sentence-length", "suggestion", "a long sentence", 35),
    ]
    return c, kinds.together(c, rules)


_FOUND = f"""found as (
  select doc_id, 'core.repeated-word' as rule, 1 as rank, 'warning' as severity, begin_at as b, next_stop as e, form as fix from near where {_DOUBLED}
  union all select doc_id, 'core.articles', 1, 'warning', begin_at, stop_at, case when form like 'A%' then case when an then 'An' else 'A' end else case when an then 'an' else 'a' end end from (select *, {_AN} as an from (select *, regexp_extract(next_form, '^[\\p{{L}}\\p{{N}}''’]+') as f from near where form in ('a', 'an', 'A', 'An') and regexp_matches(next_gap, '^[ \\t]+$'))) where an <> (lower(form) = 'an')
  union all select doc_id, 'plain.sentence-length', 2, 'suggestion', begin_at, begin_at + length(text), null from sentences where n_words > 35
)"""


@query(_sql("select doc_id, rule, b as begin, e as stop from found f where not exists (select 1 from found o where o.doc_id = f.doc_id and f.rule = 'plain.sentence-length' and o.rule = 'core.articles' and f.b < o.e and o.b < f.e)", _FOUND))
def yields_to(spark, d):
    _, found = _findings(spark, d)
    order = spark.createDataFrame([("plain.sentence-length", "core.articles")], "rule string, over string")
    return post.yields_to(found, order).select("doc_id", "rule", "begin", "stop")


@query(_sql("select doc_id, rule, b as begin, e as stop, row_number() over (partition by doc_id order by b, rank, rule, e)::int as place from (select distinct doc_id, rule, rank, b, e from found)", _FOUND))
def dedup_sorted(spark, d):
    return post.dedup_sorted(_findings(spark, d)[1]).select("doc_id", "rule", "begin", "stop", "place")


@query(_sql("select rule, severity, count(*) as n, count(distinct doc_id) as n_docs from found group by rollup (rule, severity)", _FOUND))
def severity_rollup(spark, d):
    return post.severity_rollup(_findings(spark, d)[1])


@query(_sql("select rule, count(*) as n, 1000.0 * count(*) / (select sum(n_words) from sentences) as per_1000 from found group by rule", _FOUND))
def rule_rates(spark, d):
    c, found = _findings(spark, d)
    return post.rule_rates(found, c.texts().select(X.word_count(F.concat_ws(" ", "texts")).alias("n_words")))


@query(_sql("select doc_id, count(*) as n from found f join (select doc_id, sum(n_words) as w from sentences group by doc_id) s using (doc_id) where rule like 'core.%' group by doc_id, w having count(*) >= 5 and count(*) * 100 / greatest(w, 1) > 2.0", _FOUND))
def tell_density(spark, d):
    c, found = _findings(spark, d)
    return post.tell_density(found, c.sentences, ["core."], 100, 2.0, 5).select("doc_id", "n")


@query()
def quote_filter(spark, d):
    c, found = _findings(spark, d)
    return post.quote_filter(found, quoted_spans(c.docs)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query()
def apply_fixes(spark, d):
    c, found = _findings(spark, d)
    return post.apply_fixes(c.docs, found)


@query(_sql("select word, choice, r as place from (select a as word, b as choice, row_number() over (partition by a order by docs desc, b) as r from pairs where " + _NEAR + ") where r <= 5", _LEX + r", o as (select distinct form as word from (select doc_id, form from near where regexp_matches(form, '^\p{Ll}{6,}$') group by all having count(*) = 1)), wrong as (select * from o where word not in (select word from lex)), wrong_keys as (select word, unnest(" + _DELETED + ") as k from wrong), lex_keys as (select word, docs, unnest(" + _DELETED + ") as k from lex), pairs as (select distinct w.word as a, l.word as b, l.docs from wrong_keys w join lex_keys l using (k))"))
def top_k_suggestions(spark, d):
    c = corpus_of(spark, d)
    offered = kinds.spelling(c, kinds.lexicon(c, 20), min_length=6).select(F.col("match").alias("word"), "choices").distinct()
    return offered.select("word", F.posexplode("choices").alias("place", "choice")).select("word", "choice", (F.col("place") + 1).cast("long").alias("place"))


@query("select least(floor(p * 10), 9)::int as bin, count(*) as n, avg(p) as mean_p, avg(r) as accuracy, avg((p - r) ** 2) as brier, avg(-case when r = 1 then ln(greatest(least(p, 1 - 1e-9), 1e-9)) else ln(1 - greatest(least(p, 1 - 1e-9), 1e-9)) end) as nll from (select n_chars % 1000 / 1000.0::double as p, quality::double as r from documents join labels using (doc_id)) group by 1")
def calibration(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return post.calibration(rows.select((F.col("n_chars") % 1000 / F.lit(1000.0)).alias("p"), F.col("quality").alias("right")))


@query()
def report_json(spark, d):
    c, found = _findings(spark, d)
    return post.report_json(found, c.docs)


@query()
def sarif(spark, d):
    c, found = _findings(spark, d)
    return post.sarif_results(found, c.docs).select("doc_id", "place", "result")


@query()
def rewrite_choice(spark, d):
    c, found = _findings(spark, d)
    candidates = post.rewrite_candidates(c.sentences, found)
    return post.choose_rewrites(candidates, c.sentences, F.col("n_fixes").cast("double")).select(*_AT, "candidate", "n_fixes", "edit")


@query(_sql("select doc_id, block_id, sent_id, concat_ws(chr(10), 'Before it: ' || lag(text) over w, 'After it: ' || lead(text) over w) as context from sentences window w as (partition by doc_id order by block_id, sent_id)"))
def surroundings(spark, d):
    return post.surroundings(corpus_of(spark, d).sentences)


@query(_sql("select doc_id, form, begin_at as begin, s as span_begin from near, (values (100, 180), (150, 152), (400, 1000)) v(s, e) where begin_at < e and s < stop_at"))
def words_in_spans(spark, d):
    c = corpus_of(spark, d)
    spans = c.docs.select("doc_id", F.explode(F.expr("array(struct(100 as begin, 180 as stop), struct(150 as begin, 152 as stop), struct(400 as begin, 1000 as stop))")).alias("s")).select("doc_id", "s.*")
    return post.words_in(c.tokens, spans).select("doc_id", "form", "begin", "span_begin")


_STACKS = "case doc_id % 3 when 0 then 'The national digital educational plan holds.' when 1 then 'A useful, careful, helpful, formal tool.' else 'The national formal one is useful careful practical.' end"


@query(_sql_with("select doc_id, block_id, sent_id, begin, n from (select doc_id, block_id, sent_id, island, min(begin_at) as begin, count(*) as n, arg_max(nt, tok_id) as nt, arg_max(ng, tok_id) as ng from (select *, sum((tag <> 'JJ' or not regexp_matches(gap, '^[ \\t\\n]*$'))::int) over w as island, lead(tag) over w as nt, lead(gap) over w as ng from tagged window w as (partition by doc_id, block_id, sent_id order by tok_id)) where tag = 'JJ' group by all) where n >= 2 and starts_with(nt, 'NN') and regexp_matches(ng, '^[ \\t\\n]*$')", _STACKS, _TAG))
def adjective_stack_shallow(spark, d):
    return shallow.adjective_stacks(corpus_with(spark, d, _STACKS), 2).select(*_AT, "begin", "n")


_LEADS = "case doc_id % 4 when 0 then 'It is a good fit if:' when 1 then 'We stop unless : so' when 2 then 'These hold: ' else 'Wait until:  ' end"


@query(_sql_with("select doc_id, block_id, sent_id from sentences where regexp_matches(text, '(?i)(?:^|[^a-z])(?:if|when|whenever|whether|because|unless|while|where|although|though|until):$')", _LEADS))
def lead_ins(spark, d):
    return corpus_with(spark, d, _LEADS).sentences.where(X.lead_in(F.col("text"))).select(*_AT)


_CODED = """case doc_id % 3 when 0 then 'Use `git commit -m` or `Rebase`, not `x' when 1 then 'Text' || chr(10) || '```sh' || chr(10) || 'make All -j8' || chr(10) || '```' || chr(10) || 'More `ls`.' else 'No code' end"""


@query(f"select distinct doc_id, lower(unnest(regexp_extract_all(code, '[\\p{{L}}\\p{{N}}]+'))) as word from (select doc_id, case when fence then '' when inside then line else array_to_string(list_transform(range(2, len(p) + 1, 2), lambda i: p[i]), ' ') end as code from (select *, sum(fence::int) over (partition by doc_id order by n) % 2 = 1 as inside, string_split(line, '`') as p from (select *, regexp_matches(line, '^[ \\t]*(```|~~~)') as fence from (select doc_id, unnest(l) as line, unnest(range(0, len(l))) as n from (select doc_id, string_split(coalesce(text, '') || chr(10) || chr(10) || ({_CODED}), chr(10)) as l from documents)))))")
def code_words(spark, d):
    return words_of_code(corpus_with(spark, d, _CODED).docs)


#: Each word with mistakes of four kinds at a place that follows from its length.
_TYPOS = "select distinct lower(form) as word from {t} where {m}"


@query(_sql(r"select word, kind, typed, case when typed = word then 0 else 1 end as distance, typed = word or kind in ('drop', 'twice') as indels, (case kind when 'swap' then 0.5 when 'twice' then 0.6 when 'drop' then case when substr(word, p, 1) in (substr(word, p - 1, 1), substr(word, p + 1, 1)) then 0.6 else 0.9 end else case when abs(rw - re) <= 1 and abs(cw - 3) <= 1 then 0.8 else 1.0 end end)::double as cost from (select *, case when contains('qwertyuiop', substr(word, p, 1)) then 0 when contains('asdfghjkl', substr(word, p, 1)) then 1 else 2 end as rw, 0 as re, greatest(instr('qwertyuiop', substr(word, p, 1)), instr('asdfghjkl', substr(word, p, 1)), instr('zxcvbnm', substr(word, p, 1))) as cw from typos) where typed <> word", r"w as (select word, length(word) % 3 + 2 as p from (select distinct lower(form) as word from near where regexp_matches(form, '^[A-Za-z]{5,9}$'))), typos as (select word, p, 'swap' as kind, substr(word, 1, p - 1) || substr(word, p + 1, 1) || substr(word, p, 1) || substr(word, p + 2) as typed from w where length(word) > p union all select word, p, 'drop', substr(word, 1, p - 1) || substr(word, p + 1) from w union all select word, p, 'twice', substr(word, 1, p) || substr(word, p) from w union all select word, p, 'other', substr(word, 1, p - 1) || 'e' || substr(word, p + 1) from w)"))
def typing_mistakes(spark, d):
    words = corpus_of(spark, d).tokens.where(F.col("form").rlike("^[A-Za-z]{5,9}$")).select(F.lower("form").alias("word")).distinct().withColumn("p", F.length("word") % 3 + 2)
    kinds_of = "stack(4, 'swap', if(length(word) > p, substr(word, 1, p - 1) || substr(word, p + 1, 1) || substr(word, p, 1) || substr(word, p + 2), word), 'drop', substr(word, 1, p - 1) || substr(word, p + 1), 'twice', substr(word, 1, p) || substr(word, p), 'other', substr(word, 1, p - 1) || 'e' || substr(word, p + 1)) as (kind, typed)"
    made = words.selectExpr("word", kinds_of).where("typed <> word")
    return made.select("word", "kind", "typed", X.osa(F.col("typed"), F.col("word")).alias("distance"), X.indels_only(F.col("typed"), F.col("word")).alias("indels"), X.typo_cost(F.col("typed"), F.col("word")).alias("cost"))


@query("select doc_id, text as cell from documents where text is not null")
def tsv_cells(spark, d):
    """Texts escaped to cells and back."""
    cells = table(spark, d, "documents").where("text is not null").select("doc_id", X.tsv_escaped(F.col("text")).alias("cell"))
    return cells.where(~F.col("cell").rlike("[\n\t\r]")).select("doc_id", X.tsv_unescaped(F.col("cell")).alias("cell"))


@query("with s as (select doc_id, [(doc_id % 7) / 2.0, (doc_id % 5) / 1.0, (doc_id % 3) / 1.5] as x, (doc_id % 11 % 3)::int as r from documents), t as (select unnest(range(0, 4001)) as k), g as (select k, exp(ln(0.05) + (ln(20) - ln(0.05)) * k / 4000) as t from t) select round(ln(arg_min(t, loss)) * 50)::bigint as log_t from (select t, sum(ln(exp(x[1] / t) + exp(x[2] / t) + exp(x[3] / t)) - x[r + 1] / t) as loss from s, g group by t)")
def temperature(spark, d):
    """The temperature that scores and answers made from ids want, as its logarithm in fiftieths."""
    import math

    scores = F.expr("array((doc_id % 7) / 2.0D, (doc_id % 5) / 1.0D, (doc_id % 3) / 1.5D)")
    t = post.fit_temperature(table(spark, d, "documents").select(scores.alias("scores"), F.expr("cast(doc_id % 11 % 3 as int)").alias("right")))
    return spark.range(1).select(F.lit(round(math.log(t) * 50)).cast("long").alias("log_t"))


#: A document in Markdown around the text's first line.
_MARKED = """'---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || '# The the heading' || chr(10) || chr(10) || 'Some long' || chr(10) || 'intro in in line.' || chr(10) || chr(10) || '> Quoted' || chr(10) || '> and and so on.' || chr(10) || chr(10) || '1. First of of' || chr(10) || '   to to.' || chr(10) || 'n' || doc_id || chr(10) || chr(10) || 'Then {{< tip text="or or" >}} it it is.'"""


@query(f"with m as (select doc_id, {_MARKED} as t from documents), w(word) as (values ('The the'), ('in in'), ('and and'), ('of of'), ('to to'), ('or or'), ('it it')) select doc_id, word as match, (strpos(t, word) - 1)::int as begin, (strpos(t, word) - 1 + length(word))::int as stop from m, w")
def markdown_offsets(spark, d):
    """Doubled words of Markdown documents, at their places in the document."""
    docs = table(spark, d, "documents").select("doc_id", F.expr(_MARKED).alias("text"))
    c = Corpus(docs, markdown_blocks(docs))
    found = kinds.repeated_word(c)
    return to_source(found, c.blocks).select("doc_id", "match", "begin", "stop")


@query()
def check_packs(spark, d):
    """All built-in packs over the documents: the findings by rule."""
    c = corpus_of(spark, d)
    return check(c, built_in(), quoted_spans(c.docs)).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the core and plain packs outside quotations over documents, in order."""
    c = corpus_of(spark, sf_dir)
    found = check(c, built_in(["core", "plain"]), quoted_spans(c.docs))
    return post.dedup_sorted(found).select("doc_id", "place", "rule", "severity", "message", "begin", "stop", "match", "replacement")
