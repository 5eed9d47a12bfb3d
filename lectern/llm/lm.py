"""LM scoring by a causal self-attention model on subword ids (operator 2).

The model works on ids of a byte-level vocabulary, each word encoded with a blank before it, and one end a text, so that
the ids hold the words of the text without loss. An id's probability is that of its class times that of the id in the class:

* Classes: the commonest ids are classes of their own, the others share classes of about equal weight; a class holds ids
  that begin words or ids that don't, never both.
* Class probabilities: of classes after the id before, from counts over all training texts, corrected by one head of masked
  self-attention. Its places are words, each the mean of its ids' embeddings; what the head sees before a word corrects the
  classes of all ids of the word. It is trained in numpy by rounds of local steps in each partition, each over all training
  texts, and the weights of all partitions are averaged after each round.
* Ids in a class: counts after each id of the word over all training texts, backed off to those after its class and of the ids.
* Words: the product of their ids' probabilities and of the word's end, which is that of a class that begins words coming next.
  So the probabilities of all words after a text's beginning add up to 1. They are mixed with the word's share of all training
  words; the weight of the two is the one under which all training texts are likeliest, each word judged by the counts of the
  others (leave one out).

Texts are scored in windows that overlap, so that each word is scored once, with LENGTH - STRIDE words of context or more.
Word counts for the base score cover all training texts; the commonest words are broadcast, with a bound, and all others
are joined.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.bytebpe import read_ranks
from lectern.llm.common import Batches, as_bytes, checkpoint, documents, record_batch, small_batches

END = b"\n"  # no word has a line break
LENGTH, STRIDE = 32, 24  # words of a window, and between the beginnings of two
CLASSES, SINGLE, WIDTH, INPUTS = 96, 64, 16, 1024
START = INPUTS + CLASSES  # what stands before the first id of a word in the tables of ids in a class
HEAD_WORDS = 100_000  # words whose counts are broadcast, at most
PAIRS = 2_000_000  # pairs of ids with counts of their own, at most; others back off
ROUNDS = 1
BACKOFF = 20.0
WEIGHTS = np.array([0.1, 0.3, 0.5, 0.7, 0.85, 0.95, 0.98])  # of the ids' probability, to choose from
_LOG10 = 1 / np.log(10)
_FAR = 30.0  # corrections beyond do not count, so that no exponential overflows


# Words and ids --------------------------------------------------------------------------------


class Growing:
    """A growing array."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(need, 2 * self.n) - self.n, self.data.dtype)])
        self.data[self.n : need] = values
        self.n = need


class Vocabulary(defaultdict):
    """word (bytes) -> place in arrays of its ids and, where they are attached, of its count and more. Place 0 is the end."""

    LIMIT = 700_000

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        import tiktoken

        ranks = read_ranks(path)
        self.coder = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # Between words with one blank each there is no run of white space to look ahead in, and without looking ahead the library is faster.
        self.joined = tiktoken.Encoding("joined", pat_str=public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={})
        self.size = self.coder.n_vocab
        self.end = self.size  # an id of our own: the text's end, and what comes before its first id
        self.begins_word = np.zeros(self.size + 1, bool)
        self.begins_word[[r for t, r in ranks.items() if t.startswith(b" ")] + [self.end]] = True
        self.counts = self.model = self.attached = None
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.default_factory, self.done = count().__next__, 0
        self.ids, self.first, self.length = Growing(np.int32), Growing(np.int64), Growing(np.int32)
        self._detach()
        self[END]
        self._add([END], np.array([self.end]), np.array([1]))

    def _detach(self) -> None:
        self.count, self.key_a, self.key_b, self.inside = Growing(np.int64), Growing(np.int64), Growing(np.int64), Growing(np.float64)
        self.flat = Growing(np.float32)

    def attach(self, counts: dict[bytes, int], model: Attention, key: str) -> None:
        """From now on each word has its count, -1 and a 128-bit key where `counts` lacks it, the log probability of its ids in their classes and their mean embedding."""
        if self.attached != key:
            self.counts, self.model, self.attached = counts, model, key
            self._detach()
            words = list(self)
            for at in range(0, self.done, 50_000):
                self._tell(at, words[at : min(at + 50_000, self.done)])

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the words from `done` on."""
        self.first.extend(self.ids.n + np.cumsum(sizes) - sizes)
        self.length.extend(sizes)
        self.ids.extend(ids)
        self.done += len(sizes)
        if self.attached:
            self._tell(self.done - len(sizes), words)

    def _tell(self, first: int, words: list[bytes]) -> None:
        ids, sizes = self.spelt(np.arange(first, first + len(words)))
        begin, inputs = np.cumsum(sizes) - sizes, self.model.tables.classes.inputs[ids]
        before = np.concatenate([[START], inputs[:-1]])
        before[begin] = START
        self.inside.extend(np.add.reduceat(self.model.tables.in_class(before, ids).astype(np.float64), begin))
        self.flat.extend(self.model.means(inputs, sizes).ravel())
        counts = np.array([self.counts.get(w, -1) for w in words], np.int64)
        keys = np.zeros((len(words), 2), np.int64)
        rare = np.flatnonzero(counts < 0)
        keys[rare] = word_keys([words[i] for i in rare.tolist()])
        for column, values in ((self.count, counts), (self.key_a, keys[:, 0]), (self.key_b, keys[:, 1])):
            column.extend(values)

    def vectors(self, places: np.ndarray) -> np.ndarray:
        """The mean embeddings of words by their places."""
        return self.flat.data[: self.flat.n].reshape(-1, WIDTH).take(places, 0)

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words that need not be known."""
        # No match of the pattern goes from one word into the blank before the next, so that words without white space of another kind go through at once.
        alone = [i for i, w in enumerate(words) if not w.isascii() and (text := w.decode("utf-8", "replace")).split() != [text]]
        apart = set(alone)
        at_once = [w for i, w in enumerate(words) if i not in apart] if alone else words
        ids = self._encode(self.joined, b" ".join(at_once)) if at_once else np.empty(0, np.int32)
        begin = np.flatnonzero(self.begins_word[ids])
        if len(begin) != len(at_once):
            alone, at_once, ids, begin = range(len(words)), [], ids[:0], begin[:0]
        if not alone:
            return ids, np.diff(begin, append=len(ids))
        each = [self._encode(self.coder, words[i]) for i in alone]
        which = np.ones(len(words), bool)
        which[alone] = False
        order = np.concatenate([np.flatnonzero(which), np.array(alone)])
        some = np.concatenate([np.diff(begin, append=len(ids)), [len(i) for i in each]]).astype(np.int64)
        first, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        first[order], sizes[order] = np.cumsum(some) - some, some
        return np.concatenate([ids, *each])[ranges(first, sizes)], sizes

    def _encode(self, coder, words: bytes) -> np.ndarray:
        return coder.encode_to_numpy(" " + words.decode("utf-8", "replace"), disallowed_special=()).astype(np.int32)

    def places(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self) > self.done:
            new = [*islice(reversed(self), len(self) - self.done)][::-1]
            self._add(new, *self.spell(new))
        return out

    def spelt(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words by their places."""
        sizes = self.length.data[places].astype(np.int64)
        return self.ids.data[ranges(self.first.data[places], sizes)], sizes


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each size, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def summed(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of so many rows each, one after the other; for few rows a sum faster than reduceat."""
    order = by_length(sizes)[::-1]  # the longest first, so that those with a row k more are the first ones
    sizes, begin = sizes[order], (np.cumsum(sizes) - sizes)[order]
    longer = len(sizes) - np.cumsum(np.bincount(np.minimum(sizes, 13), minlength=14))
    out = rows.take(begin, 0)
    for k in range(1, 12):
        n = longer[k]
        if not n:
            break
        out[:n] += rows.take(begin[:n] + k, 0)
    if n := longer[12]:
        rest = sizes[:n] - 12
        out[:n] += np.add.reduceat(rows.take(ranges(begin[:n] + 12, rest), 0), np.cumsum(rest) - rest, axis=0)
    back = np.empty_like(out)
    back[order] = out
    return back


def by_length(sizes: np.ndarray) -> np.ndarray:
    """The stable order of sizes; small integers are sorted by radix."""
    return np.argsort(sizes.astype(np.int16 if sizes.max(initial=0) < 1 << 15 else np.int64), kind="stable")


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process, kept from task to task and from training to scoring."""
    return Vocabulary(path)


def words_of(texts: list[bytes]) -> list[list[bytes]]:
    return [t.lower().split() for t in texts]


# The model ------------------------------------------------------------------------------------


class Classes:
    """Classes of ids, from the counts of ids in all training texts."""

    def __init__(self, counts: np.ndarray, begins_word: np.ndarray):
        self.counts = counts.astype(np.float64)
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.of = np.empty(len(counts), np.int16)
        self.of[order[:SINGLE]] = np.arange(SINGLE)
        self.begins_word = np.zeros(CLASSES, np.float32)  # 1: a class of ids that begin words
        self.begins_word[:SINGLE][: len(order)] = begins_word[order[:SINGLE]]
        rest = order[SINGLE:]
        groups = CLASSES - SINGLE
        for start, first, n in ((True, SINGLE, groups // 2), (False, SINGLE + groups // 2, groups - groups // 2)):
            ids = rest[begins_word[rest] == start]
            self.begins_word[first : first + n] = start
            if len(ids):
                mass = np.cumsum(self.counts[ids] + 0.1)
                self.of[ids] = first + np.minimum((mass / mass[-1] * n).astype(int), n - 1)
        self.inputs = np.empty(len(counts), np.int32)  # rows of the embedding: common ids, then classes
        self.inputs[order] = np.arange(len(counts))
        rare = self.inputs >= INPUTS
        self.inputs[rare] = INPUTS + self.of[rare]
        self.class_of = np.full(START + 1, CLASSES)  # of an input; a word's start is a class of its own here
        common = np.flatnonzero(self.inputs < INPUTS)
        self.class_of[self.inputs[common]] = self.of[common]
        self.class_of[INPUTS:START] = np.arange(CLASSES)


class Tables:
    """Log probabilities from counts of ids after inputs: of classes after an input, and of ids in their class after an input.

    Each backs off: from an input to its class, and from the class to the counts of the ids alone.

    by_class: counts (CLASSES + 1, ids) of ids after classes of inputs; by_input: counts (START + 1, CLASSES) of classes after
    inputs, both in words; ends: counts of words by the input of their last id; previous, ids, counts: the pairs with counts of their own.
    """

    def __init__(self, classes: Classes, by_class: np.ndarray, by_input: np.ndarray, ends: np.ndarray, previous: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.classes = classes
        n = self.size = len(classes.of)
        class_of = classes.class_of
        totals = np.zeros((CLASSES + 1, CLASSES))
        np.add.at(totals.T, classes.of, by_class.T)
        own = classes.counts + 0.05
        alone = own / np.bincount(classes.of, own, CLASSES)[classes.of]
        inside = (by_class + BACKOFF * alone) / (totals[:, classes.of] + BACKOFF)
        self.inside = np.log(inside).astype(np.float32)
        # Counts that no pair holds add to the weight of the backoff.
        held = np.zeros_like(by_input)
        np.add.at(held, (previous, classes.of[ids]), counts)
        free = np.maximum(by_input - held, 0) + BACKOFF
        self.unmet = np.log(free / (by_input + BACKOFF)).astype(np.float32)
        key = previous.astype(np.int64) * n + ids
        order = np.argsort(key)
        self.key = key[order]
        met = (counts + free[previous, classes.of[ids]] * inside[class_of[previous], ids]) / (by_input[previous, classes.of[ids]] + BACKOFF)
        self.met = np.log(met).astype(np.float32)[order]
        # A word that ends is followed by a word's beginning.
        begins = (by_input[START] + 0.5) * classes.begins_word
        after = by_input[:START] + ends[:START, None] * (begins / max(begins.sum(), 1e-9))
        of_class = np.zeros((CLASSES + 1, CLASSES))
        np.add.at(of_class, class_of[:START], after)
        total = of_class.sum(0) + 0.5
        prior = (of_class + BACKOFF * total / total.sum()) / (of_class.sum(1, keepdims=True) + BACKOFF)
        self.bigram = np.log((after + BACKOFF * prior[class_of[:START]]) / (after.sum(1, keepdims=True) + BACKOFF)).astype(np.float32)
        self.odds = np.exp(self.bigram)

    def in_class(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log probability of ids in their class after inputs."""
        out = self.inside[self.classes.class_of[before], ids] + self.unmet[before, self.classes.of[ids]]
        if len(self.key):
            key = before.astype(np.int64) * self.size + ids
            order = np.argsort(key)  # in order they are found near each other
            key = key[order]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            found = self.key[at] == key
            out[order[found]] = self.met[at[found]]
        return out


SHAPES = {"e": (INPUTS + CLASSES, WIDTH), "p": (LENGTH, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, CLASSES), "b": (CLASSES,)}
_MASK = np.where(np.tril(np.ones((LENGTH, LENGTH), bool)), 0, -1e9).astype(np.float32)
_SEEN = np.tril(np.ones((LENGTH, LENGTH), np.float32))


def initial(seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    scale = {"e": 0.5, "p": 0.1, "q": 0.5, "k": 0.5, "v": 0.5, "o": 0.0, "b": 0.0}
    return np.concatenate([(rng.standard_normal(s) * scale[n] / (np.sqrt(WIDTH) if n in "qkv" else 1)).astype(np.float32).ravel() for n, s in SHAPES.items()])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def windows(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, first scored place) of the windows over texts of so many words; each word is scored in one of them."""
    n = 1 + np.maximum(0, -(-(lengths - LENGTH) // stride))
    text = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, number * stride, np.where(number > 0, LENGTH - stride, 0)


class Batch:
    """Texts laid end to end behind one end: word by word, and id by id."""

    def __init__(self, texts: list[list[bytes]], vocab: Vocabulary, classes: Classes):
        if len(vocab) > vocab.LIMIT:
            vocab.reset()
        self.lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.text_words = 1 + np.cumsum(self.lengths) - self.lengths  # first word of each text
        self.places = vocab.places([END, *chain.from_iterable(chain(t, (END,)) for t in texts)])
        ids, self.sizes = vocab.spelt(self.places)
        self.begin = np.cumsum(self.sizes) - self.sizes  # first id of each word
        self.inputs, self.target = classes.inputs[ids], classes.of[ids].astype(np.int64)
        self.before = np.concatenate([self.inputs[:1], self.inputs[:-1]])

    def by_size(self, words: np.ndarray, ids: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in `words`, places of their ids) of words of one size at a time, about so many ids: what fits a core's cache."""
        sizes = self.sizes[words]
        order = by_length(sizes)
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
        for first, last in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            size = int(sizes[order[first]])
            step = max(1, ids // size)
            for i in range(first, last, step):
                part = order[i : min(i + step, last)]
                yield part, self.begin[words[part], None] + np.arange(size)


def exponentials(s: np.ndarray, first: int = 0) -> np.ndarray:
    """Replaces rows of s, those of windows' places from `first` on, by what is in proportion to their softmax over the places up to their own; returns the sums of the rows."""
    rows, columns = s.shape[-2:]
    if s.size and max(s.max(), -s.min()) > 60:
        s += _MASK[first : first + rows, :columns]
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
    else:  # no exponential comes near the ends of the range, so that no row needs a level of its own
        np.exp(s, out=s)
        s *= _SEEN[first : first + rows, :columns]
    return (s.reshape(-1, columns) @ np.ones(columns, s.dtype)).reshape(s.shape[:-1])


class Attention:
    """One head over windows of words; corrections to the class bigrams."""

    def __init__(self, flat: np.ndarray, tables: Tables):
        self.w, self.tables = unpack(flat), tables
        self.scale = self.w["q"].dtype.type(1 / np.sqrt(WIDTH))

    def means(self, inputs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The mean embedding of so many inputs each, one after the other."""
        rows = self.w["e"].take(inputs, 0)
        return summed(rows, sizes) / sizes[:, None].astype(rows.dtype)

    def embedded(self, batch: Batch, words: np.ndarray) -> np.ndarray:
        """The mean embedding of the ids of each of these words."""
        sizes = batch.sizes[words]
        return self.means(batch.inputs[ranges(batch.begin[words], sizes)], sizes)

    def reaches_far(self, h: np.ndarray) -> bool:
        """Whether a correction may be beyond _FAR; by lengths of vectors, so that no correction is looked at."""
        longest = np.sqrt(np.einsum("nd,nd->n", h, h).max(initial=0) * np.square(self.w["o"]).sum(0).max())
        return bool(longest * 1.001 + np.abs(self.w["b"]).max() >= _FAR)

    def score(self, batch: Batch, step: int = 64, vectors: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of the classes of each word's ids and of its end; that of the first word, an end before all texts, is 0.

        vectors: the mean embeddings of all words but the last, where they are known.
        """
        n = len(batch.places)
        x = np.empty((n + LENGTH, WIDTH), np.float32)
        x[0], x[n:] = 0, 0
        x[1:n] = self.embedded(batch, np.arange(n - 1)) if vectors is None else vectors
        h = np.zeros((n + LENGTH, WIDTH), np.float32)
        text, begin, first = windows(batch.lengths)
        at = batch.text_words[text] + begin
        self._attend(x, h, at, LENGTH - STRIDE, LENGTH, step)
        # The first window of a text also scores the places before, which have no earlier window.
        self._attend(x, h, at[first == 0], 0, LENGTH - STRIDE, 2 * step)
        by_word, ended = np.empty(n), np.empty(n)
        bigram, odds, n_classes = self.tables.bigram.ravel(), self.tables.odds, self.tables.odds.shape[1]
        begins_word, far = self.tables.classes.begins_word, self.reaches_far(h)
        for part, rows in batch.by_size(np.arange(n)):
            correction = h.take(part, 0) @ self.w["o"]
            correction += self.w["b"]
            if far:
                np.clip(correction, -_FAR, _FAR, out=correction)
            before, target = batch.before.take(rows), batch.target.take(rows)
            chosen = bigram.take(before * n_classes + target)
            chosen += correction.ravel().take(np.arange(len(part))[:, None] * n_classes + target)
            factors = np.exp(correction, out=correction)
            z = odds.take(before, 0)
            total = np.log(np.einsum("nsc,nc->ns", z, factors))
            factors *= begins_word
            starts = np.log(np.einsum("nc,nc->n", z[:, 0], factors) + np.float32(1e-30))
            ended[part] = starts - total[:, 0]
            total[:, 0] = starts
            by_word[part] = (chosen - total).sum(1, dtype=np.float64)
        ended[batch.text_words] = 0  # what comes before is another text
        by_word[:-1] += ended[1:]
        by_word[0] = 0
        return by_word

    def _attend(self, x: np.ndarray, out: np.ndarray, begins: np.ndarray, first: int, last: int, step: int) -> None:
        """What the places from first to last of windows attend to; places past a text's end are written by their own windows later or not used."""
        w, places = self.w, np.arange(last)
        both = (w["q"] * self.scale) @ w["k"].T
        for i in range(0, len(begins), step):
            at = begins[i : i + step, None] + places
            np.minimum(at, len(x) - 1, out=at)
            own = x.take(at, 0)
            own += w["p"][:last]
            late = own[:, first:]
            s = np.matmul((late.reshape(-1, WIDTH) @ both).reshape(late.shape), own.swapaxes(1, 2))
            sums = exponentials(s, first)
            h = np.matmul(s, own).reshape(-1, WIDTH)
            h /= sums.reshape(-1, 1)
            out[at[:, first:]] = (h @ w["v"]).reshape(late.shape) + late

    def gradient(self, batch: Batch, words: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Of the mean negative log probability of the classes of all ids of the kept words of windows; both of shape (windows, LENGTH)."""
        w, at = self.w, np.flatnonzero(kept)
        flat_words = words.ravel().take(at)
        sizes = batch.sizes.take(flat_words - 1)
        rows = batch.inputs.take(ranges(batch.begin.take(flat_words - 1), sizes))
        own = self.means(rows, sizes)
        flat = np.zeros((kept.size, WIDTH), own.dtype)
        flat[at] = own
        x = flat.reshape(*words.shape, WIDTH)
        x += w["p"]
        q = w["q"] * self.scale
        both = q @ w["k"].T
        a = np.matmul((flat @ both).reshape(x.shape), x.swapaxes(1, 2))
        a /= exponentials(a)[:, :, None]
        seen = np.matmul(a, x).reshape(-1, WIDTH).take(at, 0)
        h = flat.take(at, 0)
        h += seen @ w["v"]
        order = by_length(batch.sizes.take(flat_words))  # words of one size stand together
        sorted_h = h.take(order, 0)
        raw = sorted_h @ w["o"]
        raw += w["b"]
        beyond = np.abs(raw) > _FAR if self.reaches_far(h) else None
        if beyond is not None:
            np.clip(raw, -_FAR, _FAR, out=raw)
        by_word = self._class_errors(batch, flat_words.take(order), raw)
        if beyond is not None:
            by_word[beyond] = 0
        g = {"b": np.ones(len(at), own.dtype) @ by_word, "o": sorted_h.T @ by_word}
        dh = np.empty_like(h)
        dh[order] = by_word @ w["o"].T
        dseen = dh @ w["v"].T
        g["v"] = seen.T @ dh
        du, level = np.zeros_like(x), np.zeros(kept.size, own.dtype)
        du.reshape(-1, WIDTH)[at] = dseen
        level[at] = np.einsum("nd,nd->n", dseen, seen)  # the mean of each place's da by its weights
        da = np.matmul(du, x.swapaxes(1, 2))
        da -= level.reshape(*kept.shape, 1)
        da *= a
        left, right = np.matmul(da, x).reshape(-1, WIDTH), np.matmul(da.swapaxes(1, 2), x).reshape(-1, WIDTH)
        dboth = flat.T @ left
        g |= {"q": dboth @ w["k"] * self.scale, "k": dboth.T @ q}
        dx = np.matmul(a.swapaxes(1, 2), du).reshape(-1, WIDTH)
        dx += left @ both.T
        dx += right @ both
        dx[at] += dh
        g["p"] = dx.reshape(x.shape).sum(0)
        by_id = (dx.take(at, 0) / sizes[:, None].astype(dx.dtype)).repeat(sizes, axis=0)
        g["e"] = np.zeros(w["e"].shape, dx.dtype)
        np.add.at(g["e"].ravel(), (rows[:, None] * WIDTH + np.arange(WIDTH)).ravel(), by_id.ravel())
        return np.concatenate([g[n].ravel() for n in SHAPES])

    def _class_errors(self, batch: Batch, words: np.ndarray, corrections: np.ndarray) -> np.ndarray:
        """The gradient of the mean loss by each word's corrections, which it changes; words come by their sizes."""
        out, factors = np.empty_like(corrections), np.exp(corrections, out=corrections)
        share = out.dtype.type(1 / batch.sizes[words].sum())
        odds, n_classes = self.tables.odds, corrections.shape[1]
        for part, rows in batch.by_size(words):
            here = slice(int(part[0]), int(part[-1]) + 1)
            z = odds.take(batch.before.take(rows), 0)
            total = np.einsum("nsc,nc->ns", z, factors[here])
            errors = np.einsum("nsc,ns->nc", z, share / total, out=out[here])
            errors *= factors[here]
            met, flat = batch.target.take(rows).T + np.arange(len(part)) * n_classes, errors.reshape(-1)
            for column in met:  # an id of each word, so that no place is met twice
                flat[column] -= share
        return out


class Trainer:
    """Adam steps from given weights over the windows of one partition; each word is in one window."""

    def __init__(self, flat: np.ndarray, tables: Tables, rate: float = 0.01, windows_a_step: int = 48):
        self.flat, self.tables, self.rate, self.size = flat.astype(np.float32).copy(), tables, rate, windows_a_step
        self.m, self.v, self.steps, self.seen = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, 0

    def take(self, batch: Batch, seed: int) -> None:
        text, begin, _ = windows(batch.lengths, LENGTH)
        at, left = batch.text_words[text] + begin, batch.lengths[text] - begin
        order = np.random.default_rng(seed).permutation(len(at))
        places = np.arange(LENGTH)
        for i in range(0, len(order), self.size):
            part = order[i : i + self.size]
            kept = places < left[part, None]
            g = Attention(self.flat, self.tables).gradient(batch, at[part, None] + places, kept).astype(np.float32)
            self.steps += 1
            self.seen += int(kept.sum())
            self.m += np.float32(0.1) * (g - self.m)
            self.v += np.float32(0.01) * (g * g - self.v)
            step = np.float32(self.rate / (1 - 0.9**self.steps)) * self.m
            step /= np.sqrt(self.v * np.float32(1 / (1 - 0.99**self.steps))) + np.float32(1e-8)
            self.flat = np.clip(self.flat - step, -4, 4)


# Spark ----------------------------------------------------------------------------------------


def word_counts(train: DataFrame) -> DataFrame:
    """(word, count) over all texts, the end of each included; summed in each task before the shuffle."""

    schema = pa.schema([("word", pa.binary()), ("count", pa.int64())])

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        ends = 0

        def total() -> list[pa.RecordBatch]:
            table = pa.Table.from_batches(held, schema).group_by("word", use_threads=False).aggregate([("count", "sum")])
            return table.rename_columns({"count_sum": "count"}).select(["word", "count"]).cast(schema).to_batches()

        for batch in batches:
            counted = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(1).cast(pa.string()))).flatten().value_counts()
            words, counts = counted.field(0).cast(pa.binary()), counted.field(1)
            some = pc.not_equal(pc.binary_length(words), 0)  # empty ones stand at the ends of texts
            held.append(record_batch(schema, [words.filter(some), counts.filter(some)]))
            ends += batch.num_rows
            if sum(x.num_rows for x in held) > 1_000_000:
                held = total()
                if sum(x.num_rows for x in held) > 500_000:
                    yield from held
                    held = []
        if ends:  # no training text, no word
            held.append(record_batch(schema, [[END], [ends]]))
            yield from total()

    return train.mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def larger(batches: Batches, rows: int = 100_000) -> Batches:
    """The rows of batches of words or ids, which are small, in batches of about so many rows."""
    held, n = [], 0
    for batch in chain(batches, (None,)):
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
        if n >= rows or batch is None and n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0


def added(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """Rows with the sums of the last column, one for each of the other columns' values."""
    batch, (*names, value) = record_batch(schema, columns), schema.names
    table = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([(value, "sum")])
    return record_batch(schema, [*(table[n].combine_chunks() for n in names), table[f"{value}_sum"].combine_chunks()])


def _spelt_words(batches: Batches, vocab: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, number of ids of each word, count of each word) of batches of counted words."""
    for batch in larger(batches):
        words = batch.column(0).to_pylist()
        counts = batch.column(1).to_numpy().astype(np.float64)
        if END in words:
            end = words.index(END)
            yield np.array([vocab.end], np.int32), np.array([1]), counts[end : end + 1]
            words, counts = words[:end] + words[end + 1 :], np.delete(counts, end)
        if words:
            yield *vocab.spell(words), counts


def at_least(counted: DataFrame, most: int) -> int:
    """The least count that at most `most` rows of `counted` reach; from a histogram of at most a few hundred bars."""
    bars = counted.groupBy(F.floor(F.log2("count") * 8).alias("bar")).agg(F.count(F.lit(1)).alias("rows"), F.min("count").alias("least")).orderBy(F.desc("bar")).collect()
    least, rows = None, 0
    for bar in bars:
        rows += bar.rows
        if rows > most:
            break
        least = bar.least
    return bars[0].least + 1 if least is None and bars else math.ceil(least or 1)


def make_classes(words: DataFrame, path: str) -> Classes:
    """From the counts of all ids in the training texts, which follow from those of the words."""

    def run(batches: Batches) -> Batches:
        vocab = vocabulary(path)
        total = np.zeros(vocab.size + 1)
        for ids, sizes, counts in _spelt_words(batches, vocab):
            total += np.bincount(ids, np.repeat(counts, sizes), len(total))
        at = np.flatnonzero(total)
        yield record_batch(pa.schema([("id", pa.int32()), ("count", pa.float64())]), [at.astype(np.int32), total[at]])

    rows = words.mapInArrow(run, "id int, count double").groupBy("id").agg(F.sum("count").alias("count")).toArrow()
    vocab = vocabulary(path)
    counts = np.zeros(vocab.size + 1)
    counts[rows["id"].to_numpy()] = rows["count"].to_numpy()
    return Classes(counts, vocab.begins_word)


def make_tables(words: DataFrame, classes: Classes, path: str, most_pairs: int = PAIRS) -> Tables:
    """Counts of each id after each input of its word, or at the word's start, and of the ends of words.

    To the driver come counts by classes (at most CLASSES + 1 times the vocabulary and START + 1 times the classes) and of
    the commonest pairs, `most_pairs` at most.
    """
    held = words.sparkSession.sparkContext.broadcast(classes)
    ended = -1  # in place of an id

    def run(batches: Batches) -> Batches:
        vocab, cls = vocabulary(path), held.value
        for ids, sizes, counts in _spelt_words(batches, vocab):
            last = np.cumsum(sizes) - 1
            inputs = cls.inputs[ids]
            previous = np.concatenate([[START], inputs[:-1]])
            previous[last - sizes + 1] = START
            both = [np.concatenate([previous, inputs[last]]), np.concatenate([ids, np.full(len(last), ended)])]
            yield added(pa.schema([("previous", pa.int32()), ("id", pa.int32()), ("count", pa.float64())]), [*(x.astype(np.int32) for x in both), np.concatenate([np.repeat(counts, sizes), counts])])

    pairs = checkpoint(words.mapInArrow(run, "previous int, id int, count double").groupBy("previous", "id").agg(F.sum("count").alias("count")))

    def by_classes(batches: Batches) -> Batches:
        cls, schema = held.value, pa.schema([("row", pa.int32()), ("column", pa.int32()), ("count", pa.float64())])
        for batch in larger(batches):
            previous, ids, counts = (batch.column(i).to_numpy() for i in range(3))
            inside = ids != ended
            # Rows below 0: after the class of an input, by id; others: after an input, by class.
            rows = np.concatenate([-1 - cls.class_of[previous[inside]], previous])
            columns = np.concatenate([ids[inside], np.where(inside, cls.of[ids], ended)])
            yield added(schema, [rows.astype(np.int32), columns.astype(np.int32), np.concatenate([counts[inside], counts])])

    summed = pairs.mapInArrow(by_classes, "row int, column int, count double").groupBy("row", "column").agg(F.sum("count").alias("count")).toArrow()
    row, column, count = (summed[c].to_numpy() for c in ("row", "column", "count"))
    by_class, by_input, ends = np.zeros((CLASSES + 1, len(classes.of)), np.float32), np.zeros((START + 1, CLASSES)), np.zeros(START + 1)
    of_class, of_end = row < 0, (row >= 0) & (column == ended)
    by_class[-1 - row[of_class], column[of_class]] = count[of_class]
    ends[row[of_end]] = count[of_end]
    rest = ~of_class & ~of_end
    by_input[row[rest], column[rest]] = count[rest]
    own = pairs.where(F.col("id") != ended)
    common = own.where(F.col("count") >= at_least(own, most_pairs)).toArrow()
    return Tables(classes, by_class, by_input, ends, common["previous"].to_numpy(), common["id"].to_numpy(), common["count"].to_numpy())


def train_weights(train: DataFrame, classes: Classes, tables: Tables, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after rounds of local steps in each partition; the partitions' weights are averaged in two levels."""
    flat, context = initial(), train.sparkSession.sparkContext
    held = context.broadcast((classes, tables))
    schema = pa.schema([("part", pa.int32()), ("seen", pa.float64()), ("weights", pa.list_(pa.float64()))])
    size = len(flat)
    for number in range(rounds):
        start = context.broadcast(flat)

        def run(batches: Batches, number=number, start=start) -> Batches:
            from pyspark import TaskContext

            vocab, (cls, tab), part = vocabulary(path), held.value, TaskContext.get().partitionId()
            trainer = Trainer(start.value, tab, rate=0.01 / (1 + number))
            for k, batch in enumerate(batches):
                if batch.num_rows:
                    trainer.take(Batch(words_of(as_bytes(batch.column(1))), vocab, cls), k)
            if trainer.seen:
                yield record_batch(schema, [[part], [float(trainer.seen)], [(trainer.flat * trainer.seen).astype(np.float64).tolist()]])

        partial = train.mapInArrow(run, "part int, seen double, weights array<double>")

        def add(batches: Batches) -> Batches:
            total, seen = np.zeros(size), 0.0
            for batch in batches:
                total += batch.column(2).flatten().to_numpy().reshape(-1, size).sum(0)
                seen += batch.column(1).to_numpy().sum()
            if seen:
                yield record_batch(schema, [[0], [seen], [total.tolist()]])

        # Some square root of the partitions, so that neither level adds up more than that.
        groups = max(1, math.isqrt(train.rdd.getNumPartitions()))
        sums = partial.repartition(groups, "part").mapInArrow(add, partial.schema).collect()
        seen = sum(r.seen for r in sums)
        if seen:
            flat = (np.sum([np.array(r.weights) for r in sorted(sums, key=lambda r: (r.seen, r.weights[0]))], 0) / seen).astype(np.float32)
    return flat


def word_keys(words: list[bytes]) -> np.ndarray:
    """128 bits of each word, as two integers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">i8").reshape(-1, 2).astype(np.int64)


def groups(lengths: np.ndarray, most: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each group, first group of each text): texts of so many words, one after the other, in groups of `most` words."""
    n = -(-lengths // most)
    first = np.cumsum(n) - n
    return np.repeat(np.cumsum(lengths) - lengths - first * most, n) + np.arange(int(n.sum())) * most, first


def logs(values: np.ndarray, grouped: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums by text of log10 of values from 1e-18 to 1e18: a logarithm for each group's product, which is exact to some 16 roundings."""
    return np.add.reduceat(np.log10(np.multiply.reduceat(values, grouped[0])), grouped[1])


def mixed(weights: list[float], count: np.ndarray, total: float, subword: np.ndarray, of_ids: np.ndarray, grouped: tuple[np.ndarray, np.ndarray], text_words: np.ndarray) -> np.ndarray:
    """For each text and weight, the sum of log10 of its words' probabilities, from their counts, that of all words and their ids' probabilities and log10 of these; words of a count below 0 add nothing."""
    unmet = count == 0
    left = np.add.reduceat(np.where(unmet, subword, 0), text_words)
    number = np.add.reduceat(unmet.astype(np.int64), text_words)
    share, kept = count / max(total, 1), count > 0
    return np.stack([logs(np.where(kept, (1 - w) * share + w * of_ids, 1.0), grouped) + number * math.log10(w) + left for w in weights], 1)


def mixture(weight: float, count: Column, total: float, subword: Column, of_ids: Column) -> Column:
    """log10 of a word's probability, as in mixed(), of columns."""
    seen = F.log10(F.lit((1 - weight) / max(total, 1)) * count + F.lit(weight) * of_ids)
    return F.when(count > 0, seen).otherwise(F.lit(float(np.log10(weight))) + subword)


def score(docs: DataFrame, learn_from: Column, path: str, *, rounds: int = ROUNDS, head_words: int = HEAD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, weight) of every row, learnt from the rows that `learn_from` (over doc_id) admits.

    Null and empty texts are one end. Without training rows the base score is that of unknown words, and the model
    knows nothing but its vocabulary. `weight` is that of the ids' probability, the same in all rows. Repeated rows count as often as they occur and get equal scores; null ids stay
    null; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    whole = documents(docs, id_col, text_col)
    train = whole.where(learn_from)
    words = checkpoint(word_counts(train))
    tokens, distinct, ends = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("count"))), F.lit(0))).first()
    classes = make_classes(words, path)
    tables = make_tables(words, classes, path)
    flat = train_weights(train, classes, tables, path, rounds)
    least = at_least(words, head_words)
    top = words.where(F.col("count") >= least).toArrow()
    held = spark.sparkContext.broadcast((classes, tables, flat, dict(zip(top["word"].to_pylist(), top["count"].to_pylist(), strict=True))))
    denominator = float(np.log10(tokens + distinct + 1))
    run_key = uuid.uuid4().hex
    tail_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("p", pa.float64())]))
    source_field = whole.schema["doc_id"]
    judged = whole.withColumn("learns", F.coalesce(learn_from, F.lit(False)))
    weights = [float(w) for w in WEIGHTS]

    def run(batches: Batches) -> Batches:
        cls, tab, trained, head = held.value
        vocab, model = vocabulary(path), Attention(trained, tab)
        vocab.attach(head, model, run_key)
        for batch in batches:
            texts = words_of(as_bytes(batch.column(1)))
            learns = batch.column(2).to_numpy(zero_copy_only=False)
            known, base, tail_sizes, tails, scores, left_out = [], [], [], [], [], []
            for i in range(0, len(texts), 64):
                b = Batch(texts[i : i + 64], vocab, cls)
                places, text_words, grouped = b.places[1:], b.text_words - 1, groups(b.lengths)
                by_word = model.score(b, vectors=vocab.vectors(b.places[:-1]))[1:] + vocab.inside.data[places]
                of_ids = np.exp(by_word.astype(np.float32)).astype(np.float64)
                by_word *= _LOG10
                counts = vocab.count.data[places]
                counts[places == 0] = ends
                head_word = counts >= 0
                known += np.add.reduceat((counts > 0).astype(np.int64), text_words).tolist()
                base += (logs(np.where(head_word, counts + 1.0, 1.0), grouped) - denominator * np.add.reduceat(head_word.astype(np.int64), text_words)).tolist()
                scores += mixed(weights, counts, tokens, by_word, of_ids, grouped, text_words).tolist()
                others = np.where(counts > 0, counts - 1, counts)
                left_out += (mixed(weights, others, tokens - 1, by_word, of_ids, grouped, text_words) * learns[i : i + 64, None]).tolist()
                tail_sizes.append(np.add.reduceat((~head_word).astype(np.int32), text_words))
                rare = places[~head_word]
                tails.append((vocab.key_a.data[rare], vocab.key_b.data[rare], by_word[~head_word]))
            edges = np.concatenate([[0], *tail_sizes]).cumsum().astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, kind), *(t[i] for t in tails)])) for i, kind in enumerate((np.int64, np.int64, np.float64))], ["a", "b", "p"])
            schema = pa.schema([batch.schema.field(0), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("tail", tail_type), ("scores", pa.list_(pa.float64())), ("left_out", pa.list_(pa.float64())), ("learns", pa.bool_())])
            yield record_batch(schema, [batch.column(0), [len(t) + 1 for t in texts], known, base, pa.ListArray.from_arrays(pa.array(edges), flat), scores, left_out, batch.column(2)])

    fields = "n_tokens long, known long, base double, tail array<struct<a:long,b:long,p:double>>, scores array<double>, left_out array<double>, learns boolean"
    scored = checkpoint(judged.mapInArrow(run, T.StructType([source_field, *T._parse_datatype_string(fields).fields])).withColumn("_row", F.monotonically_increasing_id()))
    tail = scored.select("_row", "learns", F.explode("tail").alias("t")).select("_row", "learns", "t.*")
    rare = words.where(F.col("count") < least).mapInArrow(_keys, "a long, b long, count long")
    # The weight is chosen from sums over all rows; sums by row under every weight would be many times larger than the scores.
    met = lambda df: df.join(rare.hint("shuffle_hash"), ["a", "b"], "left").withColumns({"c": F.coalesce("count", F.lit(0)), "of_ids": F.pow(F.lit(10.0), F.col("p"))})
    c, p, of_ids = F.col("c"), F.col("p"), F.col("of_ids")
    best = len(weights) - 1
    if tokens:
        by_head = scored.where("learns").agg(*(F.sum(F.col("left_out")[k]) for k in range(len(weights)))).first()
        by_tail = met(tail.where("learns").select("a", "b", "p")).agg(*(F.sum(mixture(w, F.greatest(c - 1, F.lit(0)), tokens - 1, p, of_ids)) for w in weights)).first()
        best = int(np.argmax([(h or 0.0) + (t or 0.0) for h, t in zip(by_head, by_tail, strict=True)]))
    weight = weights[best]
    of_tail = met(tail.drop("learns")).groupBy("_row").agg(F.sum((c > 0).cast("long")).alias("tail_known"), F.sum(F.log10(c + 1) - F.lit(denominator)).alias("tail_base"), F.sum(mixture(weight, c, tokens, p, of_ids)).alias("tail_score"))
    out = scored.withColumn("score", F.col("scores")[best]).drop("tail").join(of_tail, "_row", "left")
    whole_of = lambda column, of_tail: F.col(column) + F.coalesce(of_tail, F.lit(0).cast(out.schema[column].dataType))
    return out.select("doc_id", "n_tokens", whole_of("known", "tail_known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), whole_of("base", "tail_base").alias("base_score"), whole_of("score", "tail_score").alias("score"), F.lit(weight).alias("weight"))


def _keys(batches: Batches) -> Batches:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("count", pa.int64())])
    for batch in larger(batches, 20_000):
        keys = word_keys(batch.column(0).to_pylist())
        yield record_batch(schema, [keys[:, 0], keys[:, 1], batch.column(1)])
