import random

import numpy as np
import pytest

from lectern.llm import bwtdedup


def corpus(seed=9, passages=(150, 399, 400, 401, 430, 700, 1500)):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghé \n") for _ in range(n))
    common = [noise(n) for n in passages]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(noise(rng.randrange(0, 500)))
            passage = list(rng.choice(common))
            if rng.random() < 0.4:
                passage[rng.randrange(len(passage))] = "#"
            cut = rng.randrange(0, 30)
            parts.append("".join(passage[cut:]))
        texts.append("".join(parts))
    texts += ["", None, "short", "short", texts[0], texts[0], "a" * 399, "b" * 400, "c" * 401, "d" * 1200, "xy" * 500, noise(900) * 2, texts[1][:500], "z" * 400]
    return texts


def test_query_against_brute_force(run_op, frame):
    texts = corpus()
    want = bwtdedup.brute_force([(t or "").encode() for t in texts], 400)
    got = {r.doc_id: r[1:] for r in run_op("op9_bwt_dedup", documents=frame(texts)).collect()}
    assert len(got) == len(texts)
    assert sum(w[1] > 0 for w in want) > 20
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i] and texts[i][:40])


@pytest.mark.parametrize("heavy", [0, 1, 3])
def test_heavy_buckets_other_lengths_and_many_keys(frame, heavy, monkeypatch):
    monkeypatch.setattr(bwtdedup, "KEYS", heavy)
    texts = corpus(11, (120, 128, 129, 160, 200))
    want = bwtdedup.brute_force([(t or "").encode() for t in texts], 130)
    found = bwtdedup.repeats(frame(texts), length=130, heavy=heavy)
    got = {r.doc_id: r[1:] for r in bwtdedup.digests(bwtdedup.remove(found, length=130)).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("keys", [0, 2_000_000])
def test_copies_of_a_hot_text_are_dealt_out(frame, keys, monkeypatch):
    monkeypatch.setattr(bwtdedup, "KEYS", keys)
    monkeypatch.setattr(bwtdedup, "COPIES", 2)
    texts = corpus(13)
    texts += [texts[3]] * 50 + [texts[7]] * 2 + [texts[5] + "x"] * 9
    want = bwtdedup.brute_force([(t or "").encode() for t in texts], 400)
    got = {r.doc_id: r[1:] for r in bwtdedup.digests(bwtdedup.remove(bwtdedup.repeats(frame(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_merge_against_comparing_all_pairs():
    rng = np.random.default_rng(0)
    n, d = 300, bwtdedup.SLICE - 1
    bucket = rng.integers(0, 12, n)
    before, after = rng.integers(0, 2, (n, d), dtype=np.uint8), rng.integers(0, 2, (n, d), dtype=np.uint8)
    before[:, : d // 2], after[:, : d // 2] = before[:, :1], after[:, :1]
    lo, hi = rng.integers(0, 40, n), rng.integers(30, 64, n)
    several = rng.random(n) < 0.05
    shard = rng.integers(0, 5, n)
    order = np.lexsort((*after.T[::-1], shard, bucket))
    bucket, shard, before, after, lo, hi, several = (x[order] for x in (bucket, shard, before, after, lo, hi, several))
    masks = bwtdedup.merge(bucket, shard, lo, hi, before, after, several)
    for i in range(n):
        want = 0
        for o in range(lo[i], hi[i] + 1):
            mates = (bucket == bucket[i]) & (lo <= o) & (o <= hi) & (before[:, :o] == before[i, :o]).all(1) & (after[:, : d - o] == after[i, : d - o]).all(1)
            if mates.sum() > 1 or several[i]:
                want |= 1 << o
        assert int(masks[i]) == want


@pytest.mark.parametrize("shards", [1, 2, 7, 400])
@pytest.mark.parametrize("letters", [1, 2, 200])
def test_interleaved_shards_are_sorted_with_common_prefixes(shards, letters):
    rng = np.random.default_rng(shards + letters)
    n, d = 400, bwtdedup.SLICE - 1
    bucket, shard = rng.integers(0, 4, n), rng.integers(0, shards, n)
    after = rng.integers(0, letters, (n, d), dtype=np.uint8)
    after[:, 3:] = after[rng.integers(0, 8, n), 3:]
    order = np.lexsort((*after.T[::-1], shard, bucket))
    bucket, shard, after = bucket[order], shard[order], after[order]
    order, common = bwtdedup.interleave(bucket, shard, after)
    want = sorted(range(n), key=lambda i: (bucket[i], after[i].tobytes(), shard[i], i))
    assert order.tolist() == want
    for i in range(n):
        a, b = want[i - 1], want[i]
        same = next((k for k in range(d) if after[a, k] != after[b, k]), d)
        assert common[i] == (same if i and bucket[a] == bucket[b] else -1)
    assert bwtdedup.interleave(bucket[:0], shard[:0], after[:0])[0].tolist() == []


def test_ids_repeat_columns_clash_and_tables_are_empty(frame):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(300))
    docs = frame([(1, text), (1, text), (None, text[:450]), (2, None)]).selectExpr("*", "1 as k1", "2 as places", "3 as base")
    got = bwtdedup.digests(bwtdedup.remove(bwtdedup.repeats(docs))).collect()
    assert sorted((r.doc_id or 0, r.n_bytes - r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 0)]
    assert bwtdedup.repeats(docs.limit(0)).count() == 0
