import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import kinds, post, structure
from lectern.operators.segment import Corpus
from lectern.plans.pack import built_in, check
from lectern.sources.blocks import blocks_of, code_words, markdown_blocks, to_source

DOCS = [
    "# T\nSome long intro line here.\nIt took a afternoon to do.",
    "---\ntitle: a afternoon\n---\n> Quoted it took\n> a afternoon.\n\n| a afternoon | x |\n|---|---|\n",
    '1. It took {{< tip text="a afternoon" >}} here.\n   More a afternoon.\n\n```\na afternoon\n```\n\n**Label**\na afternoon went by. ##\n',
]


def test_findings_and_fixes_of_markdown_are_at_their_places(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    c = Corpus(docs, markdown_blocks(docs))
    found = check(c, built_in(["core"]))
    rows = found.where("match = 'a'").collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 1, 2, 2, 2]
    assert all(DOCS[r.doc_id][r.begin : r.stop] == r.match for r in found.collect())
    fixed = {r.doc_id: r.fixed for r in post.apply_fixes(docs, found.where("match = 'a'")).collect()}
    assert fixed[0].endswith("It took an afternoon to do.")
    assert fixed[1] == DOCS[1].replace("a afternoon.", "an afternoon.").replace("| a afternoon", "| an afternoon")
    assert fixed[2] == DOCS[2].replace("a afternoon", "an afternoon").replace("```\nan", "```\na")
    c.release()


def test_pack_examples_as_markdown_keep_their_offsets(spark):
    texts = ["Intro.\n\n" + e for pack in built_in() for r in pack.rules for e in r.examples]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = Corpus(docs, markdown_blocks(docs))
    sents = to_source(c.sentences.withColumn("stop", F.col("begin") + F.length("text")), c.blocks).collect()
    assert len(sents) > len(texts)
    for s in sents:
        assert texts[s.doc_id][s.begin] == s.text[0] and texts[s.doc_id][s.stop - 1] == s.text[-1]


def test_scan_by_format(spark):
    docs = spark.createDataFrame([(1, "# A\n\nb", "markdown"), (2, "# A\n\nb", "plain"), (3, "<h2>A</h2><p>b</p>", "html"), (4, "# A", None)], "doc_id long, text string, format string")
    kinds_of = {}
    for r in blocks_of(docs).collect():
        kinds_of.setdefault(r.doc_id, []).append(r.kind)
    assert {k: sorted(v) for k, v in kinds_of.items()} == {1: ["heading", "paragraph"], 2: ["paragraph", "paragraph"], 3: ["heading", "paragraph"], 4: ["paragraph"]}


GOLDEN = [
    ("We met Mr. Jones and Dr. Li. They left.", 2),
    ("See Fig. 3 and No. 7. Then go.", 2),
    ("Tools, e.g. Make and so on. Done.", 2),
    ("They sell pens, paper, etc. The shop is old.", 2),
    ("They sell pens, paper, etc. Maker unknown.", 1),
    ("Albert I. Jones stayed.", 1),
    ("So did you and I. Did he?", 2),
    ("J. R. Smith wrote it. It sold.", 2),
    ("Wait ... Then go on.", 1),
    ("He left . . . He came back.", 1),
    ("He left. . . . Then he came back. Yes.", 3),
    ("1. Open the door. 2 is next.", 2),
    ("She works at Acme Inc. Her boss left.", 2),
    ("It cost 3.5 euros. Cheap!", 2),
    ("Really?! Yes.", 2),
]


@pytest.mark.parametrize(("text", "n"), GOLDEN)
def test_segmentation(spark, text, n):
    from lectern.functions.register import Sentences

    assert len(list(Sentences.func.eval(None, text))) == n


def test_segmentation_by_columns_agrees(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "doc_id long, text string")
    counts = {r.doc_id: r["count"] for r in Corpus(docs).sentences.groupBy("doc_id").count().collect()}
    assert [counts[i] for i in range(len(GOLDEN))] == [n for _, n in GOLDEN]


def test_vowel_sounds_in_columns_and_sql(spark):
    from lectern.functions.register import register

    register(spark)
    want = {"hour": True, "house": None, "unit": False, "uninteresting": None, "unable": True, "one": False, "onion": True, "yes": False, "European": False, "SQL": True, "UPS": False, "x": None, "user": False, "upper": True}
    words = spark.createDataFrame([(w,) for w in want], "w string")
    assert {r.w: r.a for r in words.select("w", X.takes_an(F.col("w")).alias("a")).collect()} == want
    words.createOrReplaceTempView("some_words")
    assert {r.w: r.a for r in spark.sql("select w, takes_an(w) as a from some_words").collect()} == want


def test_acronym_definitions(spark):
    texts = ["The random access memory (RAM) works.", "A NATO (North Atlantic Treaty Organization) plan.", "An SLA stands for service level agreement.", "Nothing to see (XQZ).", "No word of Extensible Markup Language (XML) begins with an x."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.sf, r.long) for r in kinds.acronym_definitions(Corpus(docs)).collect()}
    assert got == {("RAM", "random access memory"), ("NATO", "north atlantic treaty organization"), ("SLA", "service level agreement")}


def test_variants_follow_the_glossary(spark):
    docs = spark.createDataFrame([(1, "A data base and a database. One database, one data base, one Data-base.")], "doc_id long, text string")
    terms = spark.createDataFrame([("c", "data-base", "preferred", False)], "concept string, term string, status string, exact boolean")
    plain, with_terms = kinds.variants(Corpus(docs)).collect(), kinds.variants(Corpus(docs), terms=terms).collect()
    assert {r.winner for r in plain} == {"data base"} and len(plain) == 3 and "Data base" in {r.fixed for r in plain}
    assert {r.winner for r in with_terms} == {"data-base"} and len(with_terms) == 4


def test_unnumbered_steps_and_rewrite_choice(spark):
    rows = [(1, i, "list-item", 0, f"{verb} the file.", 0, 1, False, i) for i, verb in enumerate(["Open", "Close", "Save"])]
    blocks = spark.createDataFrame(rows, "doc_id long, block_id int, kind string, level int, text string, begin int, list_id int, ordered boolean, item_id int")
    assert structure.unnumbered_steps(blocks, ["open", "close", "save"]).count() == 0
    ordered = blocks.withColumn("text", F.when(F.col("block_id") == 1, "Close it, then wait.").otherwise(F.col("text")))
    assert [(r.doc_id, r.n_items) for r in structure.unnumbered_steps(ordered, ["open", "close", "save"]).collect()] == [(1, 3)]
    docs = spark.createDataFrame([(1, "A apple and a egg.")], "doc_id long, text string")
    c = Corpus(docs)
    found = kinds.findings(kinds.articles(c), "core.articles", "warning", "m", F.col("fixed"))
    best = post.choose_rewrites(post.rewrite_candidates(c.sentences, found), c.sentences, F.col("n_fixes").cast("double")).collect()
    assert [(r.candidate, r.n_fixes) for r in best] == [("An apple and an egg.", 2)]


def test_released_and_code_words(spark):
    rows = [("neccesary", ["necessary"], True), ("grafana", ["grafena"], True), ("Admnistrator", ["Administrator"], True), ("abcdefg", ["abcdef", "abcdefgh"], True), ("fine", [], False)]
    found = spark.createDataFrame(rows, "match string, suggestions array<string>, needs_model boolean")
    assert {r.match for r in post.released(found).collect()} == {"fine", "neccesary"}
    found = spark.createDataFrame([("securly", ["securely"], True), ("mebibytes", ["megabytes"], True)], found.schema)
    assert [r.match for r in post.released(found).collect()] == ["securly"]
    docs = spark.createDataFrame([(1, "`Ab c` d `e\n~~~\nF g\n~~~"), (2, None)], "doc_id long, text string")
    assert sorted(r.word for r in code_words(docs).collect()) == ["ab", "c", "e", "f", "g"]
