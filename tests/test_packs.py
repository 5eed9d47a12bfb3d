import pytest

from lectern.operators import post
from lectern.operators.segment import Corpus
from lectern.plans.pack import PackError, built_in, check, parse
from lectern.sources.blocks import markdown_blocks


@pytest.fixture(scope="module")
def found(spark):
    """Findings of the packs over all examples of their rules, each a Markdown document."""
    rows = []
    for pack in built_in():
        for r in pack.rules:
            rows += [(len(rows) + i, r.id, True, e) for i, e in enumerate(r.examples)]
            rows += [(len(rows) + i, r.id, False, e) for i, e in enumerate(r.acceptable)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, text string")
    hits = {(r.doc_id, r.rule) for r in check(Corpus(docs, markdown_blocks(docs)), built_in()).select("doc_id", "rule").collect()}
    return rows, hits


def test_examples_are_found_and_acceptable_ones_are_not(found):
    rows, hits = found
    assert len(rows) >= 25
    for i, rule, wanted, text in rows:
        assert ((i, rule) in hits) == wanted, (rule, text)


@pytest.mark.parametrize("text", ["", "name = ", 'name = "p"\n[[rule]]\nid = "a"', 'name = "p"\n[[rule]]\nid="a"\nkind="nope"\nseverity="error"\nmessage="m"', 'name = "p"\n[[rule]]\nid="a"\nkind="regex"\nseverity="error"\nmessage="m"', 'name = "p"\n[[rule]]\nid="a"\nkind="regex"\nseverity="error"\nmessage="m"\npattern="("'])
def test_bad_packs_are_errors(text):
    with pytest.raises(PackError):
        parse(text)


def test_post_processing(spark):
    docs = spark.createDataFrame([(1, 'abcdefgh "quoted text" x'), (2, "none"), (3, None)], "doc_id long, text string")
    schema = "doc_id long, rule string, severity string, message string, begin int, stop int, match string, replacement string, suggestions array<string>, block_id int, sent_id int"
    rows = [(1, "a.x", "warning", "m", 0, 3, "abc", "A", [], 0, 0), (1, "a.y", "error", "m", 2, 4, "cd", "B", [], 0, 0), (1, "a.z", "suggestion", "m", 4, 5, "e", "C", [], 0, 0), (1, "b.q", "warning", "m", 10, 16, "quoted", None, ["s"], 0, 0), (1, "b.q", "warning", "m", 10, 16, "quoted", None, ["s"], 0, 0)]
    found = spark.createDataFrame(rows, schema)
    fixed = {r.doc_id: (r.fixed, r.n_fixes) for r in post.apply_fixes(docs, found).collect()}
    assert fixed == {1: ('AdCfgh "quoted text" x', 2), 2: ("none", 0), 3: ("", 0)}
    from lectern.sources.blocks import quoted_spans

    assert {r.rule for r in post.quote_filter(found, quoted_spans(docs)).collect()} == {"a.x", "a.y", "a.z"}
    order = spark.createDataFrame([("a.x", "a.y"), ("a.y", "a.x"), ("a.z", "a.y")], "rule string, over string")
    assert sorted(r.rule for r in post.yields_to(found, order).collect()) == ["a.z", "b.q", "b.q"]
    assert [r.rule for r in post.dedup_sorted(found).orderBy("place").collect()] == ["a.x", "a.y", "a.z", "b.q"]
    assert post.at_least(found, "warning").count() == 4
    assert {r.rule for r in post.enabled(found, ["a.*"]).collect()} == {"b.q"}
    import json

    report = json.loads(post.report_json(found, docs).first().json)
    assert [d["rule"] for d in report["diagnostics"]] == ["a.x", "a.y", "a.z", "b.q"] and report["diagnostics"][1]["column"] == 3
    log = json.loads(post.sarif_log(post.sarif_results(found, docs)).first().sarif)
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == 4 and log["runs"][0]["results"][2]["level"] == "note"


def test_decide_with_a_scripted_model(spark):
    units = spark.createDataFrame([(1, 0, 0, "sure thing"), (1, 0, 1, "who knows")], "doc_id long, block_id int, sent_id int, text string")
    model = lambda text, options: [3.0 if (o == "yes") == ("sure" in text) else 0.0 for o in options]
    assert [r.sent_id for r in post.decide(units, model, ["yes", "no"], "no").collect()] == [1]
