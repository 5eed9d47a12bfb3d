import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lectern.llm import lm

PATH = P.path("byte_bpe_50k.tiktoken")


def texts(n=120, seed=12):
    rng = random.Random(seed)
    words = ["the", "River", "runs", "under", "stone", "bridges", "Quietly,", "É"] + [f"w{i}x" for i in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(n)] + ["", None, " \n", "one\ttwo\x0bthree", "word " * 4000, "q" * 900]


def plain_base(docs):
    """n_tokens, n_known, N and base score of each document by the contract's formula."""
    split = {i: [w for w in (t or "").encode().lower().split()] + [b"\n"] for i, t in docs}
    counts = Counter(w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in split.items()}


@pytest.mark.parametrize("head_words", [lm.HEAD_WORDS, 5])
def test_base_score_and_gain(frame, head_words):
    docs = list(enumerate(texts()))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    got = {r.doc_id: r for r in lm.score(frame(docs), ~held_out, PATH, head_words=head_words).collect()}
    want = plain_base(docs)
    assert len(got) == len(docs)
    for i, (tokens, known, n, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score < 0
    # Where all words are known the model gains on the base.
    known = [r for r in got.values() if r.n_known == r.n_tokens]
    assert len(known) > 50 and sum(r.score for r in known) > sum(r.base_score - 0.1 * r.n_tokens for r in known)


def test_each_known_document_keeps_its_share(frame):
    docs = list(enumerate(texts()))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    known = [r for r in lm.score(frame(docs), ~held_out, PATH).collect() if r.n_known == r.n_tokens]
    # The base score counts a word met once twice; the text of three such words alone is left out.
    assert len(known) > 50 and all(r.score > r.base_score - 0.1 * r.n_tokens for r in known if docs[r.doc_id][1] != "one\ttwo\x0bthree")


def test_all_training_texts_move_the_head(frame, monkeypatch):
    docs, seen = list(enumerate(texts())), []

    def weights(train, *args, **kwargs):
        seen.extend(r.doc_id for r in train.select("doc_id").collect())
        return lm.initial()

    monkeypatch.setattr(lm, "train_weights", weights)
    lm.score(frame(docs), F.col("doc_id") % 3 != 0, PATH).count()
    assert sorted(seen) == [i for i, _ in docs if i % 3]


def test_the_weight_of_the_ids_is_learnt(frame):
    # Words that no other text has: their counts say nothing of them once the word itself is left out.
    unlike = frame([" ".join(f"k{i}z{j}" for j in range(40)) for i in range(30)])
    assert {r.weight for r in lm.score(unlike, F.lit(True), PATH, rounds=1).collect()} == {lm.WEIGHTS[-1]}
    # Broadcast counts and joined ones give the same.
    docs = frame(texts())
    all_head, few = ({r.doc_id: r for r in lm.score(docs, F.lit(True), PATH, rounds=1, head_words=n).collect()} for n in (lm.HEAD_WORDS, 5))
    assert {r.weight for r in all_head.values()} == {r.weight for r in few.values()}
    assert all(few[i].score == pytest.approx(r.score, rel=1e-6, abs=1e-3) for i, r in all_head.items())


def test_query(run_op, frame):
    docs = list(enumerate(texts(40)))
    rows = run_op("op2_lm_scoring", documents=frame(docs)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    assert len(rows) == len(docs)


def model(seed=1):
    rng = np.random.default_rng(seed)
    n = 400
    begins = rng.random(n) < 0.5
    begins[399] = True
    classes = lm.Classes(rng.integers(0, 50, n), begins)
    pairs = np.unique(np.stack([rng.integers(0, lm.START + 1, 900), rng.integers(0, n, 900)]), axis=1)
    by_class, by_input = np.zeros((lm.CLASSES + 1, n)), np.zeros((lm.START + 1, lm.CLASSES))
    np.add.at(by_class, (classes.class_of[pairs[0]], pairs[1]), 3)
    np.add.at(by_input, (pairs[0], classes.of[pairs[1]]), 3)
    some = pairs[:, ::2]  # the others have no counts of their own
    tables = lm.Tables(classes, by_class, by_input, rng.integers(0, 9, lm.START + 1).astype(float), *some, np.full(some.shape[1], 3.0))
    flat = lm.initial() + 0.3 * rng.standard_normal(len(lm.initial())).astype(np.float32)
    return classes, tables, flat, rng


class Fake(lm.Vocabulary):
    """Words are made of letters that stand for ids."""

    def __init__(self):
        self.attached, self.size, self.end = None, 399, 399
        self.reset()

    def spell(self, words):
        return np.concatenate([list(w) for w in words]).astype(np.int32), np.array([len(w) for w in words])


def spell(rng, lengths, most=3):
    """Texts of Fake, of so many words."""
    return [[bytes(rng.integers(128, 250, rng.integers(1, most + 1)).tolist()) for _ in range(n)] for n in lengths]


def test_tables_are_distributions():
    classes, tables, _, _ = model()
    assert np.allclose(np.exp(tables.bigram.astype(float)).sum(1), 1, atol=1e-5)
    for c in range(lm.CLASSES):
        ids = np.flatnonzero(classes.of == c)
        for before in (0, 5, lm.INPUTS + 3, lm.START, *range(40)):
            if len(ids):
                assert np.exp(tables.in_class(np.full(len(ids), before), ids).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_words_are_spelt_alike_alone_and_together():
    rng = random.Random(5)
    vocab = lm.Vocabulary(PATH)
    odd = "é日ñ\u00a0\u0085\u200b'st.,!09-"
    words = ["".join(rng.choice("abcst'.,!09-" + odd * (i % 2)) for _ in range(rng.randrange(1, 9))).encode() for i in range(400)]
    vocab.places(words[:150])
    vocab.places(words)
    for w in words:
        ids, _ = vocab.spelt(np.array([vocab[w]]))
        assert ids.tolist() == vocab.coder.encode_ordinary(" " + w.decode())


def test_words_go_to_the_coder_together():
    vocab, calls = lm.Vocabulary(PATH), []

    class Counted:
        def __init__(self, coder):
            self.coder = coder

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.coder, name)

    vocab.coder, vocab.joined = Counted(vocab.coder), Counted(vocab.joined)
    words = [f"{a}{i}".encode() for i in range(300) for a in ("w", "é", "日")]
    vocab.places(words)
    assert len(calls) <= 2
    # Words with white space of another kind go alone, and the others keep their places.
    odd = ["a", "é\u00a0b", "日", "\u2003", "\u00a0é", "é\u2003\u2003", "c"]
    ids, sizes = vocab.spell([w.encode() for w in odd])
    each = [vocab.coder.encode_ordinary(" " + w) for w in odd]
    assert ids.tolist() == sum(each, []) and sizes.tolist() == [len(e) for e in each]


def test_sums_of_rows_and_of_logarithms_by_text():
    rng = np.random.default_rng(2)
    for most in (1, 2, 11, 12, 13, 14, 60):
        sizes = rng.integers(1, most + 1, 50)
        rows = rng.standard_normal((sizes.sum(), 3))
        want = [part.sum(0) for part in np.split(rows, np.cumsum(sizes)[:-1])]
        assert np.allclose(lm.summed(rows, sizes), want)
    lengths = np.array([1, 15, 16, 17, 400])
    for values in (np.full(449, 1e-18), np.full(449, 1e18), 10 ** rng.uniform(-18, 18, 449)):
        want = [np.log10(part).sum() for part in np.split(values, np.cumsum(lengths)[:-1])]
        assert np.allclose(lm.logs(values, lm.groups(lengths)), want, rtol=1e-12)


@pytest.mark.parametrize("scale", [1, 50, 5000])
@pytest.mark.parametrize("first", [0, 8])
def test_attention_weights_near_and_far(scale, first):
    s = scale * np.random.default_rng(scale).standard_normal((5, lm.LENGTH - first, lm.LENGTH))
    want = np.exp(s + lm._MASK[first:] - (s + lm._MASK[first:]).max(2, keepdims=True))
    sums = lm.exponentials(s, first)
    assert np.allclose(s / sums[:, :, None], want / want.sum(2, keepdims=True), atol=1e-12)


def test_word_counts_against_a_counter(frame):
    docs = ["", None, " a  b\x0b\x0cA ", "É é\u00a0é x\x1cy\x85 z", "b\r\nB\tb"] * 3
    want = Counter(w for t in docs for w in [*(t or "").encode().lower().split(), b"\n"])
    rows = lm.word_counts(lm.documents(frame(docs))).collect()
    assert {bytes(r.word): r["count"] for r in rows} == want and len(rows) == len(want)


def test_each_word_is_scored_once_with_enough_context():
    for t in [*range(1, 120), 1000]:
        text, begin, first = lm.windows(np.array([t, 3]))
        places = [(b + p, p) for x, b, f in zip(text, begin, first) if x == 0 for p in range(f, lm.LENGTH) if b + p < t]
        assert sorted(p for p, _ in places) == list(range(t))
        assert all(p >= lm.LENGTH - lm.STRIDE or b == p for b, p in places)


def plain_scores(attention, classes, tables, texts):
    """Log probabilities of each word's classes and end, word by word."""
    w, out = attention.w, []
    for text in texts:
        words = [[399], *(list(x) for x in text), [399]]
        vectors = [w["e"][classes.inputs[x]].mean(0) for x in words]
        hs = []
        for t in range(len(words) - 1):
            begin = max(0, -(-(t - lm.LENGTH + 1) // lm.STRIDE)) * lm.STRIDE
            x = np.array(vectors[begin : t + 1]) + w["p"][: t + 1 - begin]
            a = (x[-1] @ w["q"]) @ (x @ w["k"]).T / np.sqrt(lm.WIDTH)
            a = np.exp(a - a.max())
            hs.append(x[-1] + (a / a.sum()) @ (x @ w["v"]))
        ended = []
        for t in range(1, len(words)):
            correction = np.clip(hs[t - 1] @ w["o"] + w["b"], -30, 30)
            before, total = words[t - 1][-1], 0.0
            for k, i in enumerate(words[t]):
                z = np.exp((correction + tables.bigram[classes.inputs[before]]).astype(float))
                if k == 0:
                    begins = z[classes.begins_word > 0].sum()
                    ended.append(np.log(begins / z.sum()))
                    total += np.log(z[classes.of[i]] / begins)
                else:
                    total += np.log(z[classes.of[i]] / z.sum())
                before = i
            out.append([total, 0.0])
            if t > 1:
                out[-2][1] = ended[-1]
    return [a + b for a, b in out]


def test_scores_against_one_word_at_a_time():
    classes, tables, flat, rng = model()
    attention = lm.Attention(flat, tables)
    texts = spell(rng, (0, 1, 5, 31, 32, 33, 90, 0, 7, 200))
    got = attention.score(lm.Batch(texts, Fake(), classes))
    want = plain_scores(attention, classes, tables, texts)
    assert len(got) == len(want) + 1 and np.allclose(got[1:], want, atol=5e-4)


def test_gradient_against_differences():
    classes, tables, flat, rng = model(4)
    flat, tables.bigram, tables.odds = flat.astype(np.float64), tables.bigram.astype(np.float64), np.exp(tables.bigram.astype(np.float64))
    texts = spell(rng, (50, 3))
    b = lm.Batch(texts, Fake(), classes)
    text, begin, _ = lm.windows(b.lengths, lm.LENGTH)
    places = np.arange(lm.LENGTH)
    words, kept = b.text_words[text, None] + begin[:, None] + places, places < (b.lengths[text] - begin)[:, None]

    def loss(f):
        a, total, n = lm.unpack(f), 0.0, 0
        vectors = np.stack([a["e"][b.inputs[i : i + k]].mean(0) for i, k in zip(b.begin, b.sizes)])
        for row, keep in zip(words, kept):
            row = row[keep]
            x = vectors[row - 1] + a["p"][: len(row)]
            s = (x @ a["q"]) @ (x @ a["k"]).T / np.sqrt(lm.WIDTH) + lm._MASK[: len(row), : len(row)]
            s = np.exp(s - s.max(1, keepdims=True))
            h = x + s / s.sum(1, keepdims=True) @ (x @ a["v"])
            for word, corr in zip(row, h @ a["o"] + a["b"]):
                for i in range(b.begin[word], b.begin[word] + b.sizes[word]):
                    z = corr + tables.bigram[b.before[i]]
                    total += np.log(np.exp(z).sum()) - z[b.target[i]]
                    n += 1
        return total / n

    g = lm.Attention(flat, tables).gradient(b, words, kept)
    for i in rng.choice(np.flatnonzero(g), 40, replace=False):
        e = np.zeros_like(flat)
        e[i] = 1e-5
        assert g[i] == pytest.approx((loss(flat + e) - loss(flat - e)) / 2e-5, rel=1e-3, abs=1e-7)


def test_training_lowers_the_loss():
    classes, tables, _, rng = model(5)
    texts = [spell(rng, (6,))[0] * 30 for _ in range(20)]
    batch = lm.Batch(texts, Fake(), classes)
    trainer = lm.Trainer(lm.initial(), tables)
    mean = lambda flat: lm.Attention(flat, tables).score(batch).mean()
    before = mean(trainer.flat)
    for k in range(20):
        trainer.take(batch, k)
    assert mean(trainer.flat) > before + 0.5


def languages(n=240, seed=3):
    """Texts in two languages that share their beginnings of words: only what came before tells which word comes."""
    rng = random.Random(seed)
    words = [[a + b for a in ("stone", "river", "light", "under") for b in ends] for ends in (("ing", "ly"), ("ova", "etta"))]
    return [" ".join(rng.choice(words[i % 2]) for _ in range(200)) for i in range(n)]


def test_without_the_head_held_out_texts_are_less_likely(frame, monkeypatch):
    docs, held_out = frame(languages()), F.col("doc_id") % 5 == 0
    mean = lambda: lm.score(docs, ~held_out, PATH, rounds=3).where(held_out).agg(F.avg(F.col("score") / F.col("n_tokens"))).first()[0]
    trained = mean()
    monkeypatch.setattr(lm, "train_weights", lambda *a, **k: lm.initial())  # the head's output is 0
    assert trained > mean() + 0.1


def test_whole_score_against_a_plain_version(frame, monkeypatch):
    """The composed score of every text: words one at a time, mixed with word shares, by the weight that was learnt."""
    docs = list(enumerate(texts(30)[:36]))
    kept = {}
    train, tabled = lm.train_weights, lm.make_tables
    monkeypatch.setattr(lm, "train_weights", lambda *a, **k: kept.setdefault("flat", train(*a, **k)))
    monkeypatch.setattr(lm, "make_tables", lambda *a, **k: kept.setdefault("tables", tabled(*a, **k)))
    got = {r.doc_id: r for r in lm.score(frame(docs), F.col("doc_id") % 7 != 2, PATH, head_words=5).collect()}
    tables, vocab = kept["tables"], lm.Vocabulary(PATH)
    classes, attention = tables.classes, lm.Attention(kept["flat"], kept["tables"])
    split = {i: (t or "").encode().lower().split() for i, t in docs}
    counts = Counter(w for i, ws in split.items() if i % 7 != 2 for w in [*ws, b"\n"])
    total = sum(counts.values())
    weight = got[0].weight
    for i, ws in split.items():
        seqs = [vocab.coder.encode_ordinary(" " + w.decode()) for w in ws] + [[vocab.end]]
        words = [[vocab.end], *seqs]
        w = attention.w
        vectors = [w["e"][classes.inputs[x]].mean(0) for x in words]
        logs, ended = [], []
        for t in range(1, len(words)):
            begin = max(0, -(-(t - lm.LENGTH) // lm.STRIDE)) * lm.STRIDE
            x = np.array(vectors[begin:t]) + w["p"][: t - begin]
            a = (x[-1] @ w["q"]) @ (x @ w["k"]).T / np.sqrt(lm.WIDTH)
            a = np.exp(a - a.max())
            correction = np.clip((x[-1] + (a / a.sum()) @ (x @ w["v"])) @ w["o"] + w["b"], -30, 30)
            before, log = words[t - 1][-1], 0.0
            for k, token in enumerate(words[t]):
                z = np.exp((correction + tables.bigram[classes.inputs[before]]).astype(float))
                norm = z[classes.begins_word > 0].sum() if k == 0 else z.sum()
                if k == 0:
                    ended.append(np.log(norm / z.sum()))
                inside = tables.in_class(np.array([lm.START if k == 0 else classes.inputs[before]]), np.array([token]))[0]
                log += np.log(z[classes.of[token]] / norm) + inside
                before = token
            logs.append(log)
        for t in range(len(logs) - 1):
            logs[t] += ended[t + 1]
        want = 0.0
        for word, log in zip([*ws, b"\n"], logs):
            sub = log / math.log(10)
            want += math.log10((1 - weight) * counts[word] / total + weight * 10**sub) if counts[word] else math.log10(weight) + sub
        assert got[i].score == pytest.approx(want, rel=1e-4, abs=5e-3), docs[i]


def test_null_ids_and_repeated_rows(frame):
    docs = frame([(1, "one two three"), (1, "one two three"), (None, "one two"), (None, None), (4, "three one")])
    rows = lm.score(docs, F.col("doc_id") != 4, PATH).collect()
    assert len(rows) == 5 and len({(r.score, r.base_score) for r in rows if r.doc_id == 1}) == 1
    assert sorted(r.n_tokens for r in rows if r.doc_id is None) == [1, 3]
    # Rows without an id are not admitted by a condition that is null for them.
    assert {r.train_tokens for r in rows} == {8}


def test_commonest_counts_by_histogram(spark):
    counted = spark.createDataFrame([(str(i), c) for i, c in enumerate([9, 9, 5, 3, 3, 3, 1, 1])], "word string, count long")
    for most, rows in ((8, 8), (7, 6), (3, 3), (2, 2), (1, 0)):
        assert counted.where(F.col("count") >= lm.at_least(counted, most)).count() == rows
    assert lm.at_least(counted.limit(0), 5) == 1


def test_no_training_rows_and_no_rows(frame):
    docs = frame(["a b", None]).selectExpr("*", "1 as score", "2 as known", "3 as tail")
    rows = lm.score(docs, F.lit(False), PATH).collect()
    assert {(r.n_known, r.train_tokens) for r in rows} == {(0, 0)} and all(r.base_score == 0 and r.score < 0 for r in rows)
    assert lm.score(docs.limit(0), F.lit(True), PATH).count() == 0


def test_no_row_is_admitted_by_a_condition_on_ids(frame):
    docs = frame(["a b", "c", None])
    assert lm.word_counts(lm.documents(docs).where("doc_id < 0")).count() == 0
    rows = lm.score(docs, F.col("doc_id") < 0, PATH).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in rows} == {(0, 0, 0.0)} and len(rows) == 3
