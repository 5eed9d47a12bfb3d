from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.register import register
from lectern.operators import kinds, shallow, structure
from lectern.operators.segment import Corpus
from lectern.sources import glossary
from lectern.sources.blocks import markdown_blocks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_spans_count_characters(spark):
    s = F.lit("😀 ab é ab")
    assert [(r.begin, r.match) for r in one(spark, X.spans(s, "ab"))] == [(2, "ab"), (7, "ab")]
    assert one(spark, X.line_of(F.lit("a\nbc"), F.lit(3))) == 2 and one(spark, X.column_of(F.lit("a\nbc"), F.lit(3))) == 2


def test_words_and_case(spark):
    assert one(spark, X.match_case(F.lit("The"), F.lit("our"))) == "Our"
    assert one(spark, X.match_case(F.lit("THE"), F.lit("our"))) == "OUR"
    assert one(spark, X.match_all(F.lit("don’t re-use x2, ok"), X.WORD)) == ["don’t", "re-use", "x2", "ok"]
    assert one(spark, X.osa_within_two(F.lit("teh"), F.lit("the"))) == 1
    assert one(spark, X.takes_an(F.lit("SQL"))) is True and one(spark, X.takes_an(F.lit("unit"))) is False


def sentences(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = Corpus(docs).sentences.orderBy("block_id", "sent_id").collect()
    for r in rows:
        assert text[r.begin : r.begin + len(r.text)] == r.text
    return [r.text for r in rows]


def test_sentence_breaks(spark):
    assert sentences(spark, "One two. Three four!  Five? \"Six.\" Seven") == ["One two.", "Three four!", "Five?", '"Six."', "Seven"]
    assert sentences(spark, "Dr. Smith met J. Doe. They left at 3.5 km. then home.") == ["Dr. Smith met J. Doe.", "They left at 3.5 km. then home."]
    assert sentences(spark, "First block\nstill first.\n\n \nSecond block. End.") == ["First block\nstill first.", "Second block.", "End."]
    assert sentences(spark, "") == []


def test_tokens_keep_their_places(spark):
    text = "  A b-c, d’e 😀 f."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = Corpus(docs).tokens.orderBy("tok_id").collect()
    assert [r.form for r in rows] == ["A", "b-c", "d’e", "f"] and all(text[r.begin : r.stop] == r.form for r in rows)


MD = """---
title: x
---
# Title

Intro line
goes on.

## Section

- **Bold** item
- Second item
  continues

1. One
2. Two

> A quote

```
code # no heading
```

| a | b |
|---|---|
| c | d |
"""


def test_markdown_blocks(spark):
    docs = spark.createDataFrame([(1, MD), (2, None)], "doc_id long, text string")
    rows = [(r.kind, r.level, r.text, r.ordered) for r in markdown_blocks(docs).orderBy("block_id").collect()]
    assert rows[:5] == [("heading", 1, "Title", None), ("paragraph", 0, "Intro line goes on.", None), ("heading", 2, "Section", None), ("list-item", 0, "**Bold** item", False), ("list-item", 0, "Second item continues", False)]
    assert [r[0] for r in rows[5:]] == ["list-item", "list-item", "quote", "code", "table-cell", "table-cell"] and rows[5][3] is True and rows[8][2] == ""


def test_lone_subsection_against_a_plain_version(spark):
    import random

    rng = random.Random(0)
    for doc in range(6):
        levels = [rng.randrange(1, 5) for _ in range(25)]
        want = set()
        parents = [max((j for j in range(i) if levels[j] < levels[i]), default=None) for i in range(25)]
        for i, p in enumerate(parents):
            if p is not None and levels[i] == levels[p] + 1 and sum(parents[k] == p and levels[k] == levels[p] + 1 for k in range(25)) == 1:
                want.add(i)
        blocks = spark.createDataFrame([(1, i, "heading", x, "h") for i, x in enumerate(levels)], "doc_id long, block_id int, kind string, level int, text string")
        assert {r.block_id for r in structure.lone_subsection(blocks).collect()} == want


def test_glossaries(spark):
    terms = glossary.from_toml(spark, '[[concept]]\nid = "c"\nterm = [{ text = "Web site", status = "deprecated" }, { text = "website" }]\n')
    assert {(r.term, r.status, r.exact) for r in terms.collect()} == {("Web site", "deprecated", True), ("website", "preferred", False)}
    text = "<tbx><body>" + "".join(r.tbx for r in glossary.to_tbx(terms).collect()) + "</body></tbx>"
    assert {(r.term, r.status) for r in glossary.from_tbx(spark, text).collect()} == {("Web site", "deprecated"), ("website", "preferred")}
    back = glossary.from_toml(spark, "\n".join(r.toml for r in glossary.to_toml(terms).collect()))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, terms.collect()))
    listed, left = glossary.from_word_lists(spark, "[Pp]ython\nGitHub\n(?i)x+", "foo bar")
    assert left == ["(?i)x+"] and {(r.term, r.status, r.exact) for r in listed.collect()} == {("python", "preferred", False), ("GitHub", "preferred", True), ("foo bar", "deprecated", False)}


def test_ambiguity_shares(spark):
    rows = [(1, 0.0, ["a", "b"]), (1, 0.0, ["b", "a"]), (1, 0.0, ["c"]), (2, 0.0, ["a"]), (2, -9.0, ["b"])]
    got = shallow.ambiguities(spark.createDataFrame(rows, "sent_key long, score double, dependencies array<string>")).collect()
    assert [(r.sent_key, round(r.share, 3)) for r in got] == [(1, 0.333)]


def test_sql_functions_and_streams(spark, tmp_path):
    register(spark)
    assert [r.sentence for r in spark.sql("select sentence from sentences('One two. Three.')").collect()] == ["One two.", "Three."]
    from lectern.plans.pack import built_in
    from lectern.streaming.checks import check_stream, newest, stream_matches, unseen

    spark.createDataFrame([(1, 1, "He is very tall. It is in in June."), (1, 2, "He is very very tall. Go."), (2, 1, None)], "doc_id long, version long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, version long, text string").parquet(f"{tmp_path}/in")
    q = stream_matches(stream, {"very": r"\bvery\b"}).writeStream.format("memory").queryName("very_matches").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("very_matches").count() == 3
    out = []
    q = check_stream(stream, built_in(["core"]), lambda found, n: out.extend(found.collect()), f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert out == []  # the newest version has no doubled function word
    assert newest(spark.read.parquet(f"{tmp_path}/in")).count() == 2
    sents = Corpus(spark.createDataFrame([(1, "A b. C d.")], "doc_id long, text string")).sentences
    cache = sents.limit(1).select(F.sha2("text", 256).alias("key"))
    assert unseen(sents, cache).count() == 1


def test_long_glossary_terms_are_found(spark):
    docs = Corpus(spark.createDataFrame([(1, "We use the very long name of it and old way.")], "doc_id long, text string"))
    rows = [("c", "very long name of it", "deprecated", False), ("c", "old way", "deprecated", False), ("c", "It", "preferred", True), ("d", "Use The Very Long Name", "preferred", True)]
    terms = spark.createDataFrame(rows, "concept string, term string, status string, exact boolean")
    assert {r.match for r in kinds.glossary(docs, terms, "deprecated").collect()} == {"very long name of it", "old way"}
    assert "use the very long name" in {r.match for r in kinds.glossary(docs, terms, "casing").collect()}
    assert kinds.glossary(docs, terms.limit(0), "casing").count() == 0


def test_streams_leave_quotations_out(spark, tmp_path):
    from lectern.plans.pack import built_in
    from lectern.streaming.checks import check_stream

    spark.createDataFrame([(1, 1, 'He put "of of" down.'), (2, 1, "He put of of down.")], "doc_id long, version long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, version long, text string").parquet(f"{tmp_path}/in")
    out = []
    q = check_stream(stream, built_in(["core"]), lambda found, n: out.extend(found.collect()), f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert {r.doc_id for r in out} == {2}


def test_restatements_against_all_pairs(spark):
    import random

    from lectern.operators.shallow import restatements

    rng = random.Random(4)
    pool = ["apple", "banjo", "cedar", "delta", "ember", "fjord", "grape", "hotel", "it", "ox"]
    docs = [[[rng.choice(pool) for _ in range(rng.randrange(1, 9))] for _ in range(25)] for _ in range(4)]
    text = lambda doc: " ".join(" ".join(words).capitalize() + "." for words in doc)
    frame = spark.createDataFrame([(i, text(d)) for i, d in enumerate(docs)] + [(9, None), (10, "")], "doc_id int, text string")
    for percent in (50, 80, 100):
        want = set()
        for i, doc in enumerate(docs):
            sets = [{w for w in words if len(w) >= 4} for words in doc]
            for j, one in enumerate(sets):
                first = next((k for k in range(j) if len(sets[k]) >= 4 and len(one & sets[k]) * 100 >= len(one) * percent), None)
                if len(one) >= 4 and first is not None:
                    want.add((i, j, first))
        found = restatements(Corpus(frame), percent=percent).collect()
        assert {(r.doc_id, r.sent_id, r.of_sent) for r in found} == want and len(found) == len(want)
        assert want
