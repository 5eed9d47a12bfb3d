import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import quality


def junk(rng):
    return " ".join(rng.choice(["WIN", "cash", "###", "$$$"]) + rng.choice(["!!", "***"]) for _ in range(rng.randrange(5, 60)))


def prose(rng):
    return " ".join(rng.choice(["the", "river", "runs", "quietly", "home"]) for _ in range(rng.randrange(5, 60))).capitalize() + "."


def rows(n=400):
    rng = random.Random(4)
    labels = [rng.randrange(2) for _ in range(n)]
    return [(i, prose(rng) if y else junk(rng)) for i, y in enumerate(labels)], labels


def test_query_on_held_out_rows(run_op, frame, spark):
    docs, y = rows()
    extra = [(10_000, ""), (10_001, None), (10_002, "x"), (10_002, "x")]
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(y)] + [(0, 1 - y[0], 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = run_op("op7_quality", documents=frame(docs + extra), labels=labels).collect()
    assert len(got) == len(docs) + len(extra)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id < len(y)]
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) > 0.97


def test_held_out_labels_never_matter(run_op, frame, spark):
    docs, y = rows(120)

    def scores(flip):
        labels = [(i, 1 - q if flip and zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q in enumerate(y)]
        return sorted((r.doc_id, r.score) for r in run_op("op7_quality", documents=frame(docs), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())

    assert scores(False) == scores(True)


def test_columns_give_what_the_rules_give(frame):
    docs, y = rows(150)
    stats = quality.measure(frame(docs)).orderBy("doc_id")
    x = stats.select(*quality.STATISTICS).toPandas().to_numpy()
    model = quality.fit(x, np.array(y, float))
    assert model.rules and len(model.rules) < 150
    assert np.allclose(model.scores(x), [r.s for r in stats.select(model.score().alias("s")).collect()])


def test_no_labels_one_label_and_no_documents(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(["a", "b"])
    assert {r.score for r in quality.classify(docs, labels, F.lit(True)).collect()} == {0.5}
    ones = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], labels.schema)
    assert all(r.score > 0.7 for r in quality.classify(docs, ones, F.lit(True)).collect())
    assert quality.classify(docs.limit(0), ones, F.lit(True)).count() == 0


def test_clashing_columns(frame, spark):
    docs, y = rows(60)
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(y)], "doc_id long, quality int").selectExpr("*", "1 as upper", "2 as _label", "3 as text")
    assert quality.classify(frame(docs).selectExpr("*", "1 as upper", "2 as score"), labels, F.lit(True)).count() == 60


def test_sample_is_bounded_and_repeats_count_once(spark, frame):
    rows = spark.range(5000).selectExpr("id as doc_id", "id as x")
    assert 4000 < quality.sample(rows, 4990).count() <= 4990 and quality.sample(rows, 5000).count() == 5000
    assert quality.sample(rows.selectExpr("7L as doc_id", "x"), 100).count() == 100 and quality.sample(rows.limit(0), 5).count() == 0
    stats = quality.measure(frame([(i % 40, junk(random.Random(i % 40)) if i % 2 else "Good plain words stand here.") for i in range(400)] + [(None, "x"), (None, None)]))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert quality.train(stats, labels) == quality.train(stats.distinct(), labels)
