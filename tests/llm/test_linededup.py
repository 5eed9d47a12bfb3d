import hashlib
from collections import defaultdict

from lectern.llm import linededup

BLANK = " \t\n\x0b\x0c\r"


def brute(texts, least):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(BLANK))
    found = defaultdict(set)
    lines = [(t or "").split("\n") for t in texts]
    for i, ls in enumerate(lines):
        for x in ls:
            if key(x):
                found[key(x)].add(i)
    return [(len(ls), len(kept := [x for x in ls if len(found[key(x)]) < least]), "\n".join(kept)) for ls in lines]


def test_against_brute_force(run_op, frame):
    common = ["  Share This \r", "share this", "SHARE THIS\t"]
    texts = [f"{common[i % 3]}\nown {i}\n\n É{i % 12}\n{common[i % 2]}" for i in range(40)] + ["", None, "\n", "\n\n", "share this", "É1", "é1", "  share this", "a\r\nb"] + ["same\ntext"] * 11
    rows = {r.doc_id: r for r in run_op("op3_line_dedup", documents=frame(texts)).collect()}
    assert len(rows) == len(texts)
    for i, (n, kept, text) in enumerate(brute(texts, 10)):
        assert (rows[i].n_lines, rows[i].n_dropped) == (n, n - kept), texts[i]
        assert rows[i].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_ids_repeat_or_are_null_and_columns_clash(frame):
    docs = frame([(1, "x\ny"), (1, "x\ny"), (None, "x\nz"), (None, None)]).selectExpr("doc_id", "text", "7 as a", "8 as pos", "9 as h")
    out = linededup.dedup_lines(docs, min_docs=3, counts=("_n_lines", "_n_dropped"))
    assert sorted((r.doc_id or 0, r.text, r._n_dropped, r.a, r.pos) for r in out.collect()) == [(0, None or "", 0, 7, 8), (0, "z", 1, 7, 8), (1, "y", 1, 7, 8), (1, "y", 1, 7, 8)]
    assert linededup.dedup_lines(docs.limit(0), min_docs=3).count() == 0
