import random

from lectern.llm import decontam


def brute(docs, items, n, percent):
    out = []
    for d, t in docs:
        words = (t or "").encode().lower().split()
        for i, x in items:
            want = decontam.shingles((x or "").encode().lower().split(), n)
            if not want:
                continue
            k = len(next(iter(want)))
            own = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
            if 100 * len(want & own) >= percent * len(want):
                out.append((d, i, len(want & own), len(want)))
    return sorted(out)


def data():
    rng = random.Random(6)
    word = lambda: rng.choice("the of and river Moon é".split()) + str(rng.randrange(30))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 30, 80])))) for i in range(40)] + [(40, ""), (41, None), (42, "Twin item twin item twin item twin"), (43, "twin ITEM twin item twin item twin")]
    docs = []
    for d in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(60)))]
        for _ in range(rng.randrange(3)):
            passage = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(3)):
                if passage:
                    passage[rng.randrange(len(passage))] = word()
            parts.append("\n".join(passage).upper() if rng.random() < 0.3 else " ".join(passage))
        docs.append((d, " ".join(parts)))
    return docs + [(120, ""), (121, None), (122, "x " * 30_000 + (items[8][1] or ""))], items


def test_query_against_brute_force(run_op, frame, spark):
    docs, items = data()
    got = run_op("op6_decontamination", documents=frame(docs), benchmark=spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items, 5, 80)
    assert len(want) > 30
    assert sorted((r.doc_id, r.item_id, r.n_common, r.n_item) for r in got) == want


def test_blocks_and_filter(frame, spark):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = decontam.contaminated(frame(docs), bench, block_words=20)
    assert sorted((r.doc_id, r.item_id, r.n_common, r.n_item) for r in one.collect()) == brute(docs, items, 5, 80)
    bad = {d for d, *_ in brute(docs, items, 5, 80)}
    table = frame(docs + [(None, docs[min(bad)][1]), (None, "clean")]).selectExpr("*", "1 as item_id", "2 as n_common")
    kept = decontam.decontaminate(table, bench)
    assert kept.columns == table.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == sorted([d for d, _ in docs if d not in bad] + [-1])


def test_empty_tables(frame, spark):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contaminated(frame(docs).limit(0), bench).count() == 0
    assert decontam.contaminated(frame(docs), bench.limit(0)).count() == 0
    assert decontam.decontaminate(frame(docs), bench.limit(0)).count() == len(docs)


def test_repeated_documents_and_null_ids(frame, spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "one two"), (None, "never named at all here"), (3, None)], "item_id long, text string")
    docs = frame([(1, "zero one two three four five six seven eight"), (1, "zero one two three four five six seven eight"), (None, "say one two"), (2, None), (3, "never named at all here")])
    got = sorted((r.doc_id or 0, r.item_id) for r in decontam.contaminated(docs, items).collect())
    assert got == [(0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, items).collect()) == [2, 3]


def test_partitions_by_size_lose_no_item(frame, spark):
    import random

    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 9, 17, 40, 130])))) for i in range(60)]
    docs = []
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        cut = rng.choice(items)[1].split()
        docs.append((i, " ".join(words + cut[: max(1, int(len(cut) * rng.choice([0.7, 0.85, 1])))] + words[:5])))
    got = sorted((r.doc_id, r.item_id, r.n_common) for r in decontam.contaminated(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == sorted((d, i, c) for d, i, c, *_ in brute(docs, items, 5, 80)) and got
