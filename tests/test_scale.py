"""Steps that must not grow faster than their input, and results that must not depend on the engine's pattern dialect."""

import random

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import kinds, post, shallow
from lectern.operators.segment import Corpus, broken, marks
from lectern.sources.blocks import quoted_spans


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_placed_without_a_window_or_a_shuffle_of_words(spark):
    c = Corpus(docs_of(spark, "The the cat. An dog (see a apple)."))
    for df in (c.tokens, kinds.articles(c), kinds.repeated_word(c), shallow.noun_stacks(c)):
        plan = plan_of(df)
        assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange") == 1


def test_one_pass_breaks_as_all_marks_do(spark):
    rng = random.Random(3)
    bits = ["Dr.", "A.", "I.", "etc.", "e.g.", "Co.", "The", "But", "cat", "x", "1.", "12.", "a.", "...", ". . .", "\n", "\n    ", " ", " ", "!", "?", "…", "”", "(", "É", "No.", ".e.g.", ".)", "\t"]
    rows = spark.createDataFrame([("".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(25)),) for _ in range(3000)], "t string")
    plain = F.col("t")
    for pattern, replacement in marks():
        plain = F.regexp_replace(plain, pattern, replacement)
    assert rows.select((broken(F.col("t")) == plain).alias("same")).where("not same").count() == 0


def test_word_edges_are_those_of_the_sql(spark):
    text = "Habéis dicho. It was so. It was then. It was there. Vea rosas, and it. Escribió éa, and x@mail.com, and so."
    c = Corpus(docs_of(spark, text))
    shifts = shallow.tense_shifts(c).select("past", "n", "n_past").collect()
    assert [tuple(r) for r in shifts] == [(0, 4, 3)]
    found = kinds.regex(c.sentences, r"\b([A-Za-z]+), and\b", needs=["and"], replace="$1 and").select("match", "begin").collect()
    assert sorted(r["match"] for r in found) == ["a, and", "com, and", "rosas, and"]
    assert all(text[r["begin"] :].startswith(r["match"]) for r in found)


def test_precedence_and_quotations_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(d, rng.choice("abc"), b, b + rng.randrange(6), i) for i, (d, b) in enumerate((rng.randrange(4), rng.randrange(60)) for _ in range(300))]
    found = spark.createDataFrame(rows, "doc_id long, rule string, begin int, stop int, i int")
    order = [("a", "b"), ("c", "b"), ("b", "c")]
    kept = {r["i"] for r in post.yields_to(found, spark.createDataFrame(order, "rule string, over string")).collect()}
    assert kept == {i for d, r, b, e, i in rows if not any(d == d2 and (r, r2) in order and b < e2 and b2 < e for d2, r2, b2, e2, _ in rows)}
    quotes = [(rng.randrange(4), b, b + rng.randrange(12)) for b in (rng.randrange(60) for _ in range(20))]
    kept = {r["i"] for r in post.quote_filter(found, spark.createDataFrame(quotes, "doc_id long, begin int, stop int")).collect()}
    assert kept == {i for d, r, b, e, i in rows if not any(d == d2 and b >= b2 and e <= e2 and b < e for d2, b2, e2 in quotes)}
    assert "Join" not in plan_of(post.quote_filter(found, spark.createDataFrame(quotes, "doc_id long, begin int, stop int")))


def test_lines_come_without_the_text(spark):
    docs = docs_of(spark, "one\n\nthe the x\nat at", "é the the")
    c = Corpus(docs)
    found = kinds.together(c, [("repeated-word", "r", "warning", "“{match}”", None), ("articles", "a", "warning", "", None), ("sentence-length", "s", "info", "", 100)])
    rows = post.located(found, docs).select("doc_id", "message", "line", "column", "end_line", "end_column").collect()
    assert sorted(map(tuple, rows)) == [(0, "“at at”", 4, 1, 4, 6), (0, "“the the”", 3, 1, 3, 8), (1, "“the the”", 1, 3, 1, 10)]


def test_rewrites_keep_the_distance_of_the_whole_sentence(spark):
    c = Corpus(docs_of(spark, "It took a afternoon and an day in in the end."))
    found = kinds.together(c, [("repeated-word", "r", "warning", "", None), ("articles", "a", "warning", "", None)])
    rows = post.rewrite_candidates(c.sentences, found)
    assert rows.select((F.levenshtein("candidate", "original") == F.expr("levenshtein(candidate, original, most)")).alias("same")).where("not same").count() == 0
    best = post.choose_rewrites(rows, c.sentences, F.col("n_fixes").cast("double")).select("candidate", "n_fixes", "edit").collect()
    assert [tuple(r) for r in best] == [("It took an afternoon and a day in the end.", 3, 5)]


def test_running_sums_and_edges(spark):
    one = spark.range(1)
    assert one.select(X.running(F.array(F.lit(2), F.lit(3)), F.lit(5))).first()[0] == [5, 7, 10]
    assert one.select(X.running(F.array().cast("array<int>"))).first()[0] == [0]


def test_quotations_have_their_places(spark):
    text = 'Say "a b" and “é” or "c".'
    rows = quoted_spans(docs_of(spark, text)).orderBy("begin").collect()
    assert [text[r["begin"] : r["stop"]] for r in rows] == ['"a b"', "“é”", '"c"']
