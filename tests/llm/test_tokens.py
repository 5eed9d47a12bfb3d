import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lectern.llm import bytebpe, tokencount

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n  \n", "Hello world's don't  we'll", "日本語 текст 😀👩‍👩‍👧 é́", "a" * 5000, "<|endoftext|> x<|endoftext|>", "  x\u0085y", "0123 456,78 ½ ²", "\x00\x01 tab\t\ttab", "word " * 3000, "word " * 3000, "a\u0558b \U00010940c\ua7ce 1\u088f"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(rng, n):
    kinds = ["abcde", "ABC", " \n\t", "0123", "é日😀ñ", "'st.,!", "<|endoftext|>"]
    return "".join(rng.choice(k) if (k := rng.choice(kinds)) != "<|endoftext|>" or rng.random() < 0.9 else k for _ in range(n))


def test_encode_is_what_tiktoken_gives_and_decodes(run_op, frame):
    rng, enc = random.Random(1), reference()
    texts = ODD + [noise(rng, rng.randrange(400)) for _ in range(200)]
    rows = {r.doc_id: r for r in run_op("op4_byte_bpe", documents=frame(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), sha), t
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        ends, begun = 0, 0
        for token in ids[:-1]:
            ends += len(enc.decode_single_token_bytes(token))
            begun += t.encode()[ends] & 0xC0 == 0x80
        assert (rows[i].n_chars, rows[i].n_split) == (len(t or ""), begun)


def test_offsets_and_split_characters(frame):
    docs = frame(["x 😀日 y", "", None])
    encoded = bytebpe.encode(docs, RANKS, P.PATTERN).orderBy("doc_id")
    first, empty, null = encoded.collect()
    assert empty.ids == null.ids == []
    text = "x 😀日 y"
    assert first.byte_end[-1] == len(text.encode())
    table = {r: t for t, r in bytebpe.read_ranks(RANKS).items()}
    begin = 0
    for i, s, e, end in zip(first.ids, first.char_start, first.char_end, first.byte_end):
        assert text.encode()[begin:end] == table[i]
        assert len(text[:s].encode()) <= begin and end <= len(text[:e].encode())
        begin = end
    decoded = bytebpe.decode(encoded, RANKS).orderBy("doc_id").collect()
    assert [d.text for d in decoded] == [text, "", ""]
    assert bytes(decoded[0].bytes) == text.encode()


def test_empty_table_and_clashing_columns(spark, frame):
    docs = frame(["a b"]).selectExpr("doc_id", "text", "1 as ids", "2 as n_tokens", "'x' as bytes", "null as `odd.name`")
    assert bytebpe.digests(bytebpe.round_trip(docs, RANKS, P.PATTERN)).count() == 1
    assert tokencount.count_tokens(docs, JSON, limit=1).first().over_limit
    none = docs.limit(0)
    assert bytebpe.round_trip(none, RANKS, P.PATTERN).count() == tokencount.count_tokens(none, JSON, limit=1).count() == 0


def test_an_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="no token"):
        bytebpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>").where("doc_id > 0"), RANKS).collect()


def test_chunked_counts_are_those_of_the_whole():
    rng, tok = random.Random(2), Tokenizer.from_file(JSON)
    texts = [noise(rng, rng.randrange(200, 3000)) for _ in range(150)] + ["a" * 4000, " " * 4000, "<|endoftext|>" * 300, "word " * 900, "x\n" * 2000, "é" * 3000, "ab " + " " * 1500 + "cd" * 700]
    for t in texts:
        want = len(tok.encode(t, add_special_tokens=False).ids)
        for chunk, overlap in ((140, 70), (400, 70), (1000, 200)):
            assert tokencount.count(tok, t, chunk, overlap) == want, (chunk, t[:80])


def test_token_count_query(run_op, frame):
    tok = Tokenizer.from_file(JSON)
    texts = ODD + ["The and of. " * 9000]
    for r in run_op("op5_token_counts", documents=frame(texts)).collect():
        t = texts[r.doc_id] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)


def test_byte_table_reversed():
    tokens = bytebpe.token_bytes(RANKS)
    for token, rank in bytebpe.read_ranks(RANKS).items():
        assert tokens.flat[tokens.first[rank] : tokens.first[rank] + tokens.length[rank]].tobytes() == token
    with pytest.raises(ValueError):
        list(tokens.of(bytebpe.np.array([len(tokens.length)]), bytebpe.np.array([0, 1])))


def test_repeated_rows_null_ids_and_forgetting(frame, monkeypatch):
    monkeypatch.setattr(bytebpe.Encoder, "REMEMBERED", 3)
    bytebpe.encoder.cache_clear()
    docs = frame([(1, "a b c d"), (1, "a b c d"), (None, "e f g h"), (None, None), (2, "long " * 20_000)])
    rows = bytebpe.digests(bytebpe.round_trip(docs, RANKS, P.PATTERN)).collect()
    bytebpe.encoder.cache_clear()
    assert sorted(r.n_tokens for r in rows) == sorted(len(reference().encode_ordinary(t)) for t in ("a b c d", "a b c d", "e f g h", "", "long " * 20_000))
    counts = tokencount.count_tokens(docs, JSON, limit=512).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in counts) == sorted((r.doc_id is None, r.n_tokens) for r in rows)
