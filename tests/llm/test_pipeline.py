import hashlib
import random

import public_tokenizers as P
from pyspark.sql import functions as F
from test_decontam import brute as leaks
from test_linededup import brute as line_cut
from test_minmax import brute as groups
from test_quality import junk
from test_tokens import reference

import corpus_pipeline
from lectern.llm import quality
from lectern.llm.common import remainder


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, sentence(rng.randrange(8, 30))) for i in range(6)]
    texts, labels = [], []
    for i in range(220):
        if i % 5 == 0:
            text, good = junk(rng), 0
        elif i % 7 == 0 and texts:
            text, good = rng.choice([t for t, g in zip(texts, labels) if g]) + " " + word(), 1
        else:
            text, good = "\n".join(sentence(rng.randrange(20, 60)) for _ in range(3)), 1
            if i % 3 == 0:
                text += "\nShared footer of many pages."
            if i % 11 == 0:
                text += "\n" + rng.choice(items)[1]
        texts.append(text)
        labels.append(good)
    rows = [(i, t) for i, t in enumerate(texts)] + [(220, ""), (221, None), (222, texts[1]), (1, texts[1])]
    return rows, [(i, g, 0) for i, g in enumerate(labels)], items


def write(spark, frame, tmp_path):
    rows, labels, items = corpus()
    docs = frame(rows).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items


def test_run_against_plain_python(spark, frame, tmp_path):
    rows, items = write(spark, frame, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    judged = quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), remainder(F.col("doc_id"), 4) != 2)
    good = {r.doc_id for r in judged.collect() if r.predicted}
    kept = [(i, t) for i, t in rows if i in good]
    assert 100 < len(kept) < len(rows) - 20
    kept = [(i, text) for (i, _), (_, _, text) in zip(kept, line_cut([t for _, t in kept], 10))]
    one = dict(kept)
    component = groups(list(one.items()), 5, 80)
    kept = [(i, t) for i, t in one.items() if component[i][1] == i]
    bad = {d for d, *_ in leaks(kept, items, 5, 80)}
    assert bad and len(one) > len(kept) + 5
    kept = {i: t for i, t in kept if i not in bad}
    enc = reference()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(kept)
    for r in got:
        ids = enc.encode_ordinary(kept[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()


def test_stages_keep_the_columns(spark, frame, tmp_path):
    write(spark, frame, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_dedup_keeps_one_row_of_repeated_ids(spark, frame):
    docs = frame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (3, "")])
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 1, 3]


CLASHES = ["row", "a", "b", "t", "id", "key", "k0", "pos", "lines", "dropped", "_text", "statistics", "_statistics", "_dropped", "_key", "_gone", "kept", "rows", "component", "n_lines", "hash", "label"]


def test_stages_with_clashing_columns(spark, frame, tmp_path):
    """Columns named as anything the stages use inside pass through with their values."""
    write(spark, frame, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    wide = docs.select("*", *(F.concat(F.lit(c), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, plain = stage(spark, wide, str(tmp_path)), stage(spark, docs, str(tmp_path))
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHES if r.doc_id is not None), name
        assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in plain.collect()), name


def test_very_long_texts(spark, frame):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = frame([(1, long), (2, long + " end"), (3, "short one of five words"), (4, "x" * 500_000), (5, "l\n" * 200_000)])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 4, 5]
    cut = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert cut[1] == long and cut[5] == "l\n" * 200_000
