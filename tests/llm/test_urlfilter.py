import random

from lectern.llm import urlfilter
from lectern.llm.components import connected_components


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    star = [(500, i) for i in range(501, 560)]
    loose = [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)]
    pairs = chain + star + loose + [(7, 7), (3, 2)]
    rng.shuffle(pairs)
    got = connected_components(spark.createDataFrame(pairs + [(None, 1)], "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == union_find([p for p in pairs if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def link(to):
    return f"<html><head><link href='{to}' rel=\"canonical\"></head>"


def refresh(to):
    return f'<meta http-equiv="refresh" content="0; URL={to}">'


PAGES = [
    (1, "http://a.example.org/es/1", ""),
    (2, "https://A.Example.ORG/en/15?x#y", ""),
    (3, "https://www.x.com/de/9#f", None),
    (4, "http://other.net/p", link("https://www.x.com/de/9")),  # aliases of blocked 3
    (5, "http://third.net/q", refresh("http://other.net/p#top")),
    (6, "http://fourth.net/r", link("http://third.net/q")),
    (7, "http://fifth.net/s", link("http://y.com/fr/2") + refresh("http://y.com/de/2")),  # allowed wins
    (8, "no scheme", link("https://www.x.com/de/9")),
    (9, None, "x"),
    (10, "http://sixth.net", link("/de/") + link("//x.com/de/1")),
    (11, "http://example.org", link("https://www.x.com/de/9")),
    (12, "http://notexample.org/en/1", ""),
    (12, "http://notexample.org/en/1", ""),
    (13, "HTTP://X.org?q=://b/c", ""),
    (14, "http://com/de/", ""),
    (None, "http://xcom/de/", ""),
]
WANT = {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("com/de/", "block"), 4: (None, "block"), 5: (None, "block"), 6: (None, "block"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "block"), 11: (None, "block"), 12: ("org/", "allow"), 13: (None, "allow"), 14: ("com/de/", "block"), None: (None, "allow")}


def test_verdicts(spark, run_op):
    pages = spark.createDataFrame([(*p, 1, "z") for p in PAGES], "page_id long, url string, html string, rule int, node string")
    rows = run_op("op8_url_filter", pages=pages).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        assert (r.rule, r.verdict) == WANT[r.page_id], r
    by = {r.page_id: r for r in rows}
    assert (by[2].host, by[2].path) == ("a.example.org", "/en/15") and (by[9].host, by[8].path) == ("", "")
    assert (by[13].host, by[13].path) == ("x.org", "")
    assert run_op("op8_url_filter", pages=pages.limit(0)).count() == 0


def test_the_oracle_agrees_on_links(tmp_path, spark, run_op):
    import duckdb

    pages = spark.createDataFrame([p for p in PAGES if p[0]], "page_id long, url string, html string")
    rows = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in run_op("op8_url_filter", pages=pages).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert set(con.execute(f"select page_id, host, path, rule, verdict from ({urlfilter.ORACLE})").fetchall()) == rows


def test_relative_and_encoded_targets_join_their_class(spark):
    pages = [
        (1, "http://www.com/de/a/x?page=2&ref=x", ""),  # blocked, as all urls under com/de/
        (2, "http://w.net/p", link("http://www.com/de/a/x?page=2&amp;ref=x")),
        (3, "http://m.net/a/b/c.html", link("../next.html?q=1")),
        (4, "http://m.net/a/next.html?q=1", link("http://www.com/de/1")),
        (5, "http://n.net/l?id=1", link("?id=2")),
        (6, "http://n.net/l?id=2", refresh("http://www.com/de/1")),
        (7, "http://o.net/in", link("/go?to=http://z.org/q")),
        (8, "http://o.net/go?to=http://z.org/q", link("http://www.com/de/1")),
        (9, "http://s.net/d/one", refresh("two")),
        (10, "http://s.net/d/two", link("//www.com/de/1")),
        (11, "http://t.net/a", link("mailto:x@www.com/de/1") + link("#top") + link("http:&#x2F;&#x2F;[")),
        (12, "ftps://u.net/a", link("b")),
        (13, "ftps://u.net/b", link("http://www.com/de/1")),
    ]
    rows = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), urlfilter.RULES).collect()
    assert {r.page_id for r in rows if r.verdict == "allow"} == {11}


def test_redirect_tables_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://u.net/a", "")], "page_id long, url string, html string")
    known = spark.createDataFrame([("http://u.net/a", "http://b.com/de/x"), (None, "q")], "a string, b string")
    assert urlfilter.judge(pages, urlfilter.RULES, known).first().verdict == "block"
