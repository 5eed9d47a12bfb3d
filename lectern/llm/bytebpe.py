"""Byte-level BPE over Arrow batches (operator 4).

encode() gives ids with byte and character offsets, decode() gives bytes and text back, round_trip() all of it in one
pass. The model is built for the `tokenizers` library from a file of ranks: a token of more than one byte is the merge of the
two parts that lower ranks alone make of it, so merging by rank and merging by that list give the same ids. Its tokens are
strings of characters that stand for bytes; decoding reverses that table.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Batches, as_bytes, documents, one_worker_thread, record_batch, small_batches


def byte_characters() -> dict[int, str]:
    """The usual printable stand-in of each byte: itself where printable Latin-1, else 256 and on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge is the token, found by merging its bytes by lower ranks."""
    pieces, below = [bytes([b]) for b in token], ranks[token]
    while len(pieces) > 2:
        best = min(range(len(pieces) - 1), key=lambda i: ranks.get(pieces[i] + pieces[i + 1], below))
        if ranks.get(pieces[best] + pieces[best + 1], below) >= below:
            break
        pieces[best : best + 2] = [pieces[best] + pieces[best + 1]]
    if len(pieces) != 2:
        raise ValueError(f"no merge gives token {token!r}")
    return pieces[0], pieces[1]


@functools.lru_cache(maxsize=2)
def model(path: str):
    """A Tokenizer of the `tokenizers` library that merges by the ranks and cuts nothing by itself."""
    one_worker_thread()
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    shown = lambda token: "".join(chars[b] for b in token)
    ordered = sorted((t for t in ranks if len(t) > 1), key=ranks.get)
    tok = Tokenizer(models.BPE({shown(t): r for t, r in ranks.items()}, [tuple(map(shown, parts(t, ranks))) for t in ordered]))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tok


class Bytes:
    """The bytes of all tokens end to end: each token's characters, each read by the reversed table."""

    def __init__(self, path: str):
        of = {c: b for b, c in byte_characters().items()}
        vocabulary = model(path).get_vocab(with_added_tokens=False)
        self.length = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        pieces = [b""] * len(self.length)
        for token, i in vocabulary.items():
            pieces[i] = bytes(map(of.__getitem__, token))
            self.length[i] = len(pieces[i])
        self.flat, self.first = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(self.length) - self.length

    def of(self, ids: np.ndarray, edges: np.ndarray) -> Iterator[bytes]:
        """The bytes of the lists of ids between two edges each; an id without a token is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id has no token")
        sizes = self.length[ids]
        at = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.flat[np.arange(at[-1]) + np.repeat(self.first[ids] - at[:-1], sizes)].tobytes()
        ends = at[edges].tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield raw[a:b]


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> Bytes:
    """One for each worker process."""
    return Bytes(path)


class Encoder(dict):
    """Ids of texts by a rank file: matches of the pattern, each encoded once by the `tokenizers` library while it is remembered.

    As a dict: match -> its place in the arrays of ids. The pattern is matched by the `regex` module, whose Unicode classes
    are those of the rank files' own library for every code point; those of `tokenizers` differ for code points of the
    latest Unicode versions.
    """

    REMEMBERED = 500_000

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import regex

        self.tok = model(path)
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.first, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, match: str) -> int:
        self[match] = at = len(self.first) + len(self.new)
        self.new.append(match)
        return at

    def _learn(self) -> None:
        encoded = [e.ids for e in self.tok.encode_batch_fast(self.new, add_special_tokens=False)]
        length = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(encoded), np.int32, int(length.sum()))])
        self.new = []

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin and end."""
        if len(self) > self.REMEMBERED:
            self.forget()
        split = [self.split(t) for t in texts]
        places = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        if self.new:
            self._learn()
        sizes = self.length[places]
        at = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(at[-1]) + np.repeat(self.first[places] - at[:-1], sizes)]
        return ids, at[np.cumsum([0, *map(len, split)])].astype(np.int32)


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def spans(texts: list[bytes], flat: np.ndarray, edges: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """char_start, char_end and byte_end of each token of the texts."""
    starts, ends, stops = [], [], []
    for text, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
        stop = np.cumsum(lengths[flat[a:b]])
        begun = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # characters begun up to a byte
        starts.append(begun[np.concatenate([[0], stop[:-1]])] - 1 if b > a else stop)
        ends.append(begun[stop - 1] if b > a else stop)
        stops.append(stop)
    return [np.concatenate([np.empty(0, np.int64), *x]).astype(np.int32) for x in (starts, ends, stops)]


_SPANS = ("char_start", "char_end", "byte_end")


def _lists(edges: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values))


def encode(docs: DataFrame, path: str, pattern: str, *, offsets: bool = True, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; with `offsets`, the character spans and byte ends of the tokens; with `decoded`, the bytes of the ids.

    char_start and char_end are the span of characters a token has any byte of, so that the tokens of a
    split character share it; byte_end is where the token ends in the UTF-8 text. Null and empty texts have
    no ids. Repeated rows stay repeated; null ids stay null; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = documents(docs, id_col, text_col)
    spans_of = _SPANS if offsets else ()
    arrow = [(c, pa.list_(pa.int32())) for c in ("ids", *spans_of)] + [("bytes", pa.binary())] * decoded
    fields = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", *spans_of)] + [T.StructField("bytes", T.BinaryType())] * decoded

    def run(batches: Batches) -> Batches:
        encoded, tokens = encoder(path, pattern), token_bytes(path)
        for batch in batches:
            ids, edges = encoded(batch.column(1).to_pylist())
            columns = [_lists(edges, ids)]
            if offsets:
                columns += [_lists(edges, s) for s in spans(as_bytes(batch.column(1)), ids, edges, tokens.length)]
            if decoded:
                columns.append(list(tokens.of(ids, edges)))
            yield record_batch(pa.schema([batch.schema.field(0), *arrow]), [batch.column(0), *columns])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *fields]))


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes, text) of id lists by the reversed byte table.

    Bytes are joined before they are read as UTF-8, so characters split between tokens come back whole;
    what is no UTF-8 becomes U+FFFD in text only. A null list counts as empty; an id outside the table is an error.
    Repeated rows and null ids stay.
    """
    source = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Batches) -> Batches:
        tokens = token_bytes(path)
        for batch in batches:
            whole = pa.schema([batch.schema.field(0), ("bytes", pa.binary()), ("text", pa.string())])
            edges = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            ids = batch.column(1).flatten()
            if ids.null_count:
                raise ValueError("an id is null")
            out = list(tokens.of(ids.to_numpy(zero_copy_only=False), edges))
            yield record_batch(whole, [batch.column(0), out, [b.decode("utf-8", "replace") for b in out]])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("bytes", T.BinaryType()), T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, **names: str) -> DataFrame:
    """(doc_id, ids, char_start, char_end, byte_end, bytes): encode() and decode() in one pass; rows as in encode()."""
    return encode(docs, path, pattern, decoded=True, **names)


def digests(trip: DataFrame) -> DataFrame:
    """Of each row of round_trip(): n_tokens and the digests of ids and bytes; n_chars and n_split, the characters that the
    tokens span and the tokens that end inside a character. Texts without tokens have 0 of all."""
    ids = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256)
    split = F.filter("char_end", lambda end, i: end > F.get("char_start", i + 1))
    n_chars = F.coalesce(F.get("char_end", F.size("char_end") - 1), F.lit(0)).cast("long")
    return trip.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), n_chars.alias("n_chars"), F.size(split).cast("long").alias("n_split"))
