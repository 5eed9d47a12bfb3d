"""Token counts by overlap resynchronisation (operator 5).

A text up to `chunk` characters is encoded as one. A longer one is encoded in chunks that overlap, and two
neighbours are spliced where it is proven that the whole text would be cut the same way:

* The pre-tokens of the byte-level pattern are found from left to right, each from where the last ended, and
  none looks more than one character behind its end. So once two runs over the same characters both begin a
  pre-token at one place, they agree from there until a pre-token comes near the end of the earlier run.
* Merges never leave a pre-token, so the ids on either side of such a place are those of the whole text.
* A special string inside a text is cut out before this. It is at most `MARGIN` characters long, and a place
  at which both runs begin a pre-token lies inside no such string.

A splice thus needs a place that both runs begin a pre-token at, `MARGIN` characters or more before the end of the
earlier chunk. Where the overlap has none, it is doubled, in the last resort back to the whole text.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Batches, documents, one_worker_thread, record_batch, small_batches

CHUNK, OVERLAP, MARGIN = 16_384, 256, 64


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    one_worker_thread()
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(tok, text: str) -> tuple[dict[int, int], int]:
    """Where pre-tokens begin, with the number of tokens before each, and the number of all tokens."""
    encoding = tok.encode(text, add_special_tokens=False)
    starts: dict[int, int] = {}
    last = None
    for i, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:  # a special string is a word of its own
            starts[start] = i
        last = word
    return starts, len(encoding.ids)


def count(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, by chunks where it is longer than `chunk` characters."""
    if len(text) <= chunk:
        return len(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)
    total = begin = 0
    end, base = chunk, 0  # base: tokens of the current chunk that come before the place it counts from
    starts, n = pieces(tok, text[:end])
    while end < len(text):
        wide = overlap
        while True:
            at = max(end - wide, begin)
            if at == begin:  # no stable place in the whole chunk: lengthen the chunk itself
                end = min(len(text), end + (end - begin))
                starts, n = pieces(tok, text[begin:end])
                break
            until = min(len(text), at + chunk)
            following, m = pieces(tok, text[at:until])
            common = [p for p in following if p + at <= end - MARGIN and p + at - begin in starts]
            common = [p for p in common if starts[p + at - begin] >= base]
            if common:
                place = min(common)
                total += starts[place + at - begin] - base
                begin, end, starts, n, base = at, until, following, m, following[place]
                break
            wide *= 2
    return total + n - base


def count_tokens(docs: DataFrame, path: str, *, limit: int, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    Null and empty texts have 0 bytes and tokens; repeated rows stay; null ids stay null; other columns are ignored.
    """
    if overlap <= MARGIN or chunk < 2 * overlap:
        raise ValueError("an overlap must exceed MARGIN and be at most half a chunk")
    small_batches(docs.sparkSession)
    source = documents(docs, id_col, text_col)

    def run(batches: Batches) -> Batches:
        tok = tokenizer(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for i, e in zip(short, tok.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                n[i] = len(e.ids)
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    n[i] = count(tok, t, chunk, overlap)
            whole = pa.schema([batch.schema.field(0), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
            yield record_batch(whole, [batch.column(0), [len(t.encode()) for t in texts], n])

    counted = source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
