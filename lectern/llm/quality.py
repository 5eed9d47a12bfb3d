"""Quality classifier as a sparse rule ensemble (operator 7).

Statistics of each text (shares of character classes, word and line measures) are computed once. On a bounded
sample of labelled rows, small boosted trees are grown; each path from a root is a conjunctive rule. A logistic model
with a lasso penalty keeps few of the rules, and those are compiled into one Column expression of the score.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Batches, as_bytes, checkpoint, documents, record_batch, small_batches, whole_rows

#: Length counts up to 256 bytes, where shares are uncertain, and no more: a long text is not bad for that.
STATISTICS = ["bytes_to_256", "upper", "digit", "blank", "breaks", "sentence_marks", "shouts", "bars", "symbols", "other_marks", "non_ascii", "entropy", "word_length", "long_words", "short_words", "capital_words", "marked_words", "repeated_words", "distinct_lines"]

#: Rules of less weight, in units of their standard deviation, are dropped.
LEAST_WEIGHT = 5e-3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\n\x0b\x0c\r",
    "breaks": b"\n",
    "sentence_marks": b".,;:?'\"()-",
    "shouts": b"!",
    "bars": b"|",
    "symbols": b"*#$%&@^~_=+<>\\{}[]",
    "other_marks": b"/`",
    "non_ascii": bytes(range(128, 256)),
}
_MASKS = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _MASKS[list(_members), _i] = 1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def statistics_of(text: bytes) -> list[float]:
    """One number for each of STATISTICS; all 0 for an empty text."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    p = counts[counts > 0] / n
    letter, blank = _LETTER[raw], (raw == 32) | ((raw >= 9) & (raw <= 13))
    word = ~blank
    begins = np.flatnonzero(word & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(word & np.concatenate([blank[1:], [True]])) + 1
    k = max(1, len(begins))
    sizes = ends - begins
    capital = (raw[begins] >= 65) & (raw[begins] <= 90)
    marked = ~letter[ends - 1]
    lines = text.split(b"\n")
    words = text.split()
    return [
        min(n, 256.0),
        *(counts @ _MASKS / n).tolist(),
        float(-(p * np.log2(p)).sum()),
        float(sizes.sum()) / k,
        float((sizes > 12).sum()) / k,
        float((sizes <= 3).sum()) / k,
        float(capital.sum()) / k,
        float(marked.sum()) / k,
        sum(map(operator.eq, words, words[1:])) / k,
        len(set(lines)) / len(lines),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one column for each of STATISTICS) of every whole text. Null texts count as empty."""
    small_batches(docs.sparkSession)
    source = documents(docs, id_col, text_col)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            table = np.array([statistics_of(t) for t in as_bytes(batch.column(1))], np.float64).reshape(-1, len(STATISTICS))
            whole = pa.schema([batch.schema.field(0), *((s, pa.float64()) for s in STATISTICS)])
            yield record_batch(whole, [batch.column(0), *(pa.array(table[:, i]) for i in range(len(STATISTICS)))])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *(T.StructField(s, T.DoubleType()) for s in STATISTICS)]))


Condition = tuple[int, bool, float]  # statistic, at most (else above), bound


@dataclasses.dataclass
class Ensemble:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self, of: Callable[[int], Column] = lambda i: F.col(STATISTICS[i])) -> Column:
        """The rules, compiled into one Column over the statistics."""
        terms = [F.lit(self.bias)]
        for conditions, weight in self.rules:
            holds = functools.reduce(operator.and_, (of(i) <= bound if at_most else of(i) > bound for i, at_most, bound in conditions))
            terms.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # in pairs, so that the expression stays shallow
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2 :]
        total = terms[0]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            total += weight * holds_in(x, conditions)
        return 1 / (1 + np.exp(-total))


def holds_in(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, at_most, bound in conditions:
        out &= x[:, i] <= bound if at_most else x[:, i] > bound
    return out


def _grow(x: np.ndarray, bins: np.ndarray, bounds: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int, path: tuple[Condition, ...], out: list[tuple[Condition, ...]], change: np.ndarray, least: int) -> None:
    """A least-squares tree on the residual; each node but the root adds its path, each leaf its step."""
    if path:
        out.append(path)
    best = (1e-9, -1, 0)
    if depth and len(rows) >= 2 * least:
        r = residual[rows]
        total, n = r.sum(), len(rows)
        for i, b in enumerate(bounds):
            if not len(b):
                continue
            of = bins[rows, i]
            sums, counts = np.bincount(of, r, len(b) + 1).cumsum()[:-1], np.bincount(of, minlength=len(b) + 1).cumsum()[:-1]
            ok = (counts >= least) & (n - counts >= least)
            gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, 0)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), i, j)
    if best[1] < 0:
        change[rows] += residual[rows].mean() if len(rows) else 0
        return
    _, i, j = best
    low = bins[rows, i] <= j
    for at_most, part in ((True, rows[low]), (False, rows[~low])):
        _grow(x, bins, bounds, residual, part, depth - 1, (*path, (i, at_most, float(bounds[i][j]))), out, change, least)


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, penalty: float = 2e-4, steps: int = 800, seed: int = 7) -> Ensemble:
    """Rules from boosted trees on random halves, then lasso logistic weights by accelerated proximal steps.

    Without rows the score is 0.5; with one label alone it is near that label.
    """
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1) if n else 0.5
    bias = math.log(prior / (1 - prior))
    if n < 4 or y.min() == y.max():
        return Ensemble(bias, [])
    rng = np.random.default_rng(seed)
    bounds = [np.unique(np.quantile(x[:, i], np.linspace(0.01, 0.99, 63)))[:-1] for i in range(x.shape[1])]
    bins = np.stack([np.searchsorted(b, x[:, i], "left") for i, b in enumerate(bounds)], 1)
    raw, paths = np.full(n, bias), []
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-raw))
        rows = np.sort(rng.choice(n, max(2, n // 2), replace=False))
        change = np.zeros(n)
        _grow(x, bins, bounds, residual, rows, depth, (), paths, change, max(1, n // 200))
        raw = raw + 1.0 * change
    rules = {}
    for path in dict.fromkeys(paths):
        held = holds_in(x, path)
        if 0 < held.sum() < n:
            same = held if held[0] else ~held
            rules.setdefault(same.tobytes(), (path, held))  # of rules alike on the sample, or each other's opposite, the first
    if not rules:
        return Ensemble(bias, [])
    paths, held = [p for p, _ in rules.values()], np.stack([h for _, h in rules.values()], 1).astype(np.float64)
    support = held.mean(0)
    scale = np.sqrt(support * (1 - support))
    design = (held - support) / scale
    w = v = np.zeros(design.shape[1])
    b = c = bias
    rate = 4 * n / np.linalg.norm(design, 2) ** 2
    momentum = 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(design @ v + c))) - y
        new_w = v - rate * (design.T @ error) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * penalty, 0)
        new_b = c - 2.0 * error.mean()
        new_momentum = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        v, c = new_w + (momentum - 1) / new_momentum * (new_w - w), new_b + (momentum - 1) / new_momentum * (new_b - b)
        w, b, momentum = new_w, new_b, new_momentum
    kept = np.flatnonzero(np.abs(w) > LEAST_WEIGHT)
    weights = w / scale
    return Ensemble(float(b - (weights[kept] * support[kept]).sum()), [(paths[i], float(weights[i])) for i in kept])


BARS = 1 << 16


def sample(rows: DataFrame, most: int) -> DataFrame:
    """The rows whose ids have the smallest hashes, at most `most`: a bound on the hash is read off a histogram, so that no more rows travel."""
    bar = F.shiftrightunsigned(F.xxhash64("doc_id"), 48)
    taken, bound = 0, 0
    for b in rows.groupBy(bar.cast("int").alias("bar")).count().orderBy("bar").collect():
        taken += b["count"]
        if taken > most:
            break
        bound = b.bar + 1
    # Where even the first bar is too long, it alone is sorted.
    return rows.where(bar < bound) if bound or not taken else rows.where(bar <= b.bar).orderBy(F.xxhash64("doc_id"), *rows.columns).limit(most)


def train(stats: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, label_col: str = "quality", **settings: float) -> Ensemble:
    """Fits on at most `max_rows` labelled rows, those with the smallest hash of the id.

    Repeated labels of a document count once, by their least value, and so do rows with one id and equal statistics; null ids
    and labels other than 0 and 1 don't count.
    """
    labels = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id")).agg(F.min(label_col).cast("double").alias("label"))
    labelled = checkpoint(stats.join(labels, "doc_id").select("doc_id", *STATISTICS, "label").distinct())
    rows = sample(labelled, max_rows).select(F.xxhash64("doc_id").alias("hash"), *STATISTICS, "label").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable").to_numpy(np.float64)
    return fit(rows[:, 1:-1], rows[:, -1], **settings)


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs, by an ensemble learnt from the labelled rows that `learn_from` (over doc_id) admits.

    Null and empty texts get the score of their all-zero statistics. Repeated rows stay, null ids stay null and
    are not learnt from, other columns are ignored.
    """
    stats = checkpoint(measure(docs, id_col, text_col))
    model = train(stats.where(learn_from), labels, **settings)
    return stats.select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: Column, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores `threshold` or more by a model learnt as in classify().

    Null and empty texts score as there; repeated rows and rows without an id stay or go by their texts. Columns pass through
    whatever their names.
    """
    model = train(checkpoint(measure(docs, id_col, text_col)).where(learn_from), labels, **settings)
    small_batches(docs.sparkSession)
    source = whole_rows(docs, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = np.array([statistics_of(t) for t in as_bytes(batch.column(1))], np.float64).reshape(-1, len(STATISTICS))
            numbers = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(STATISTICS), dtype=np.int32)), pa.array(rows.reshape(-1)))
            yield record_batch(pa.schema([batch.schema.field(0), ("statistics", numbers.type)]), [batch.column(0), numbers])

    measured = source.mapInArrow(run, T.StructType([source.schema["row"], T.StructField("statistics", T.ArrayType(T.DoubleType()))]))
    return measured.where(model.score(lambda i: F.get("statistics", F.lit(i))) >= threshold).select("row.*")
