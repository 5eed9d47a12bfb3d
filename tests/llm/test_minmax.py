import random

from lectern.llm import minmax


def shingles(text, n):
    words = [bytes(w) for w in (text or "").encode().lower().split()]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    """Smallest id reachable from each id, by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(12):  # chains and stars of copies with a few edits
        base = [word() for _ in range(rng.randrange(20, 150))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    texts += ["", None, " \n", "one", "ONE", "one two", "One  Two\n", "one two three", "é É", "É é", "a b c d"] + texts[:5]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def test_query_against_all_pairs(run_op, frame):
    rows = corpus()
    got = run_op("op10_min_max", documents=frame(rows)).collect()
    want = brute(rows, 3, 85)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_away_from_the_centre(spark):
    """Members of one bucket: chains and families of edits, most of them out of the centre's reach."""
    rng = random.Random(8)
    for case in range(6):
        base = list(range(rng.randrange(30, 120)))
        sets = []
        for k in range(60):
            if rng.random() < 0.5 or not sets:
                one = list(base)
            else:
                one = list(rng.choice(sets))
            for _ in range(rng.randrange(0, 9)):
                one[rng.randrange(len(one))] = 1000 + (rng.randrange(40) if case % 2 else 10_000 * k + rng.randrange(500))
            for _ in range(rng.randrange(0, 5)):
                one.append(5000 + rng.randrange(30))
            sets.append(sorted(set(one)))
        distinct = {tuple(x) for x in sets}
        sets = [set(x) for x in distinct]
        rows = [(i, sorted(x)) for i, x in enumerate(sets)]
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        members = spark.createDataFrame([(b, i, len(sets[i])) for b in (1, 2) for i in range(len(sets)) if b == 1 or i % 3], "bucket long, id long, n long")
        got = minmax.links(members, spark.createDataFrame(rows, "doc_id long, shingles array<long>"), 85)
        found = {r.node: r.component for r in got.collect()}
        assert {i: found.get(i, i) for i in range(len(sets))} == {i: find(i) for i in range(len(sets))}, case


def test_bands_find_pairs_at_the_threshold():
    for percent in (80, 85):
        p = 1 - (1 - (percent / 100) ** minmax.ROWS) ** minmax.bands_for(percent / 100)
        assert 1 - p <= minmax.MISS


def test_repeated_and_null_ids_clashing_columns_and_no_rows(frame, spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, ""), (2, "A B C D"), (3, None)]
    docs = frame(rows).selectExpr("*", "1 as bands", "2 as id", "3 as component", "4 as kept")
    got = sorted(minmax.near_duplicates(docs, n=3, percent=85).collect(), key=lambda r: (r.doc_id or 0, r.n_shingles))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(None, None, True), (None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert minmax.near_duplicates(docs.limit(0), n=3, percent=85).count() == 0
