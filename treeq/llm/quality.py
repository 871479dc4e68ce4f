"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log-ratio of their smoothed class counts,
then a linear hinge-loss model is fitted by dual coordinate descent (Wang and
Manning, ACL 2012; Hsieh et al., ICML 2008). N-grams are of one or two lower-cased
words, and of one to three shapes of words, such as ``Aa.`` or ``A!!``, with a mark of
its own for a word that repeats the one before; shapes carry over to words that the
model never saw. N-grams are hashed.

Fitting uses ``MAX_LABELLED`` labelled documents at most; scoring uses whole texts.

Defined cases: null and blank texts have no n-grams and get the score of the bias
alone; very long texts are scored whole. Labels other than 0 and 1 and labels of
unknown documents are ignored; with only one class, or none, every score is that
class's share, 0.5 without any. Repeated rows each get their score; other columns,
whatever their names, are ignored, and kept by the filter. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm.common import documents, fold, fresh, tidy
from treeq.llm.sample import DIMS, MAX_LABELLED, MEMO, labelled, platt

HELD_OUT = 1
FOLDS = 3
MARKS = ".,!?;:*#&%$\"'()"
_RUNS = re.compile(r"(?P<upper>[A-ZÀ-ÖØ-Þ]+)|(?P<digit>\d+)|(?P<letter>[^\W\d_]+)|(?P<mark>(.)\5?)\5*", re.S)
_MEMO: dict[str, int] = {}
_SHAPES: dict[str, int] = {}
#: What stands for the shape of a word that repeats the one before; other shapes have even numbers.
SAME = 1
#: Labelled documents that must have a term for it to weigh anything.
LEAST = 2


def shape(word: str) -> str:
    """The word with runs of letters and digits as one mark each, other marks twice at most."""
    parts = []
    for m in _RUNS.finditer(word):
        parts.append({"upper": "A", "digit": "9", "letter": "a"}.get(m.lastgroup or "", "") or m["mark"] or m[0][:2])
    return "".join(parts)


def code(word: str) -> int:
    """Two numbers in one: of the word's shape, and of the word in lower case without marks at its ends."""
    plain = word.strip(MARKS)
    tail = word[len(plain) :]
    if plain.isascii() and plain.isalpha() and word.startswith(plain) and (not tail or tail == tail[0] * len(tail)):
        # what ``shape`` gives, for most words
        if plain.islower():
            own = f"a{tail[:2]}"
        elif plain.isupper():
            own = f"A{tail[:2]}"
        else:
            own = f"Aa{tail[:2]}" if plain[0].isupper() and plain[1:].islower() else shape(word)
    else:
        own = shape(word)
    known = _SHAPES.get(own)
    if known is None:
        known = zlib.crc32(own.encode("utf-8", "surrogatepass")) & ~1
        if len(_SHAPES) < MEMO:
            _SHAPES[own] = known
    return known << 32 | zlib.crc32((plain.lower() or word).encode("utf-8", "surrogatepass"))


def grams(tag: int, *at: np.ndarray) -> np.ndarray:
    """The slots of n-grams, from the numbers of their parts (finishing steps of SplitMix64)."""
    x = np.full(len(at[0]), tag, dtype=np.uint64)
    for part in at:
        x = (x ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(44)).astype(np.int32) & np.int32(DIMS - 1)


def terms_of(text: str | None) -> np.ndarray:
    """Hashed distinct n-grams of a whole text, sorted."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, dtype=np.int32)
    if len(_MEMO) > MEMO:
        _MEMO.clear()
    for w in set(words).difference(_MEMO):
        _MEMO[w] = code(w)
    both = np.fromiter(map(_MEMO.__getitem__, words), dtype=np.uint64, count=len(words))
    s, w = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    s[1:][both[1:] == both[:-1]] = SAME
    found = np.concatenate([grams(1, s), grams(2, s[:-1], s[1:]), grams(3, s[:-2], s[1:-1], s[2:]), grams(4, w), grams(5, w[:-1], w[1:])])
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


class NaiveBayesSvm:
    """Weights by hashed n-gram, the bias, and the curve from margins to scores."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def margins(self, rows: Iterable[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[np.asarray(r, dtype=np.int64)].sum(dtype=np.float64) + self.bias for r in rows])

    def scores(self, rows: Iterable[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(rows) + self.b, -30, 30)))


def log_ratios(starts: np.ndarray, terms: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By slot, the log-ratio of its share of all indicators in class 1 and in class 0,
    counted from 1; 0 for slots that fewer than ``LEAST`` rows have."""
    kind = np.repeat(y.astype(np.int8), np.diff(starts))
    counts = [1.0 + np.bincount(terms[kind == k], minlength=DIMS) for k in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[counts[0] + counts[1] < 2 + LEAST] = 0.0
    return ratio


def descend(
    starts: np.ndarray, terms: np.ndarray, sign: np.ndarray, ratio: np.ndarray, c: float, epochs: int, least: float = 1e-3
) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and duals of the L1-loss SVM over scaled indicators, by dual coordinate descent.

    Maximizes ``sum(a) - |sum(a * sign * x)|^2 / 2`` for duals ``a`` from 0 to ``c``, the
    bias being one more indicator.
    """
    w, bias, n = np.zeros(DIMS), 0.0, len(sign)
    alpha = np.zeros(n)
    values = ratio[terms]
    norms = np.add.reduceat(np.append(values * values, 0.0), starts[:-1]) * (np.diff(starts) > 0) + 1.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(n):
            at, v = terms[starts[i] : starts[i + 1]], values[starts[i] : starts[i + 1]]
            gradient = sign[i] * (w[at] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c)
            if (move := (new - alpha[i]) * sign[i]) != 0.0:
                w[at] += move * v
                bias += move
                worst = max(worst, abs(move) * norms[i])
                alpha[i] = new
        if worst < least:
            break
    return w, bias, alpha


def part(starts: np.ndarray, terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some rows of a sparse layout, in a layout of their own."""
    sizes = np.diff(starts)[rows]
    ends = np.cumsum(sizes)
    at = np.repeat(starts[rows] - (ends - sizes), sizes) + np.arange(sizes.sum())
    return np.concatenate([[0], ends]), terms[at]


def fit(docs: DataFrame, labels: DataFrame, c: float = 0.1, epochs: int = 6, most: int = MAX_LABELLED) -> NaiveBayesSvm:
    """Learns only from rows whose id's fold isn't held out."""
    trainable = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    return fitted(*labelled(docs, labels, "quality", trainable, terms_of, most), c, epochs)


def fitted(starts: np.ndarray, terms: np.ndarray, y: np.ndarray, c: float = 0.1, epochs: int = 6) -> NaiveBayesSvm:
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return NaiveBayesSvm(np.zeros(DIMS, dtype=np.float32), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    ratio = log_ratios(starts, terms, y)
    telling = (ratio != 0.0)[terms]
    starts, terms = np.concatenate([[0], np.cumsum(telling)])[starts], terms[telling]
    # every fifth row is left to fit the curve
    fits = np.flatnonzero(np.arange(len(y)) % 5 != 4)
    held = np.flatnonzero(np.arange(len(y)) % 5 == 4)
    if len(set(y[held].tolist())) < 2:
        fits = held = np.arange(len(y))
    at, pick = part(starts, terms, fits)
    w, bias, _ = descend(at, pick, np.where(y[fits] == 1, 1.0, -1.0), ratio, c, epochs)
    model = NaiveBayesSvm((w * ratio).astype(np.float32), bias, 1.0, 0.0)
    model.a, model.b = platt(model.margins([terms[starts[i] : starts[i + 1]] for i in held]), y[held])
    return model


def score(docs: DataFrame, model: NaiveBayesSvm):
    """A column over ``docs``: the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.scores(terms_of(t) for t in batch))
        _MEMO.clear()  # the worker may go on with other work
        _SHAPES.clear()
        tidy()

    return of(docs["text"].cast("string"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    (name,) = fresh(docs, "score")
    return docs.withColumn(name, score(docs, fit(docs, labels))).filter(F.col(name) >= least).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    slim = docs.select("doc_id", "text")
    return slim.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score(slim, fit(docs, labels)).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
