"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words, their first four and five letters, and those beginnings
that two words or more of the document share. Each document is the set of its hashed
terms; the model adds a weight for each term and the inner
product of the factors of every two of them (Rendle, ICDM 2010), so an insult beside
a group's name can weigh more than both alone. A term's value in a document is its
strength, from 0 to 1, by what the fitting sample says for it: the likelihood ratio of
its presence, or of its presence together with another term. So weak terms need large
weights to matter, and long clean documents gather little noise, while no term of two
documents or more is left out. What is fitted to next to nothing is nothing.

Fitting uses ``MAX_LABELLED`` labelled documents at most; scoring uses whole texts.

Defined cases: null and blank texts have no terms and get the bias's score; very long
texts are scored whole. Labels other than 0 and 1 and labels of unknown documents are
ignored; with only one class every score is that class's share, 0 without any. Repeated
rows each get their score; other columns, whatever their names, are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm.common import documents, fold, tidy
from treeq.llm.sample import DIMS, MAX_LABELLED, MEMO, labelled, platt, slot

HELD_OUT = 2
FOLDS = 4
LEAST = 0.3
RANK = 8
#: Labelled documents that a term needs, and the likelihood ratio that gives it a quarter of full strength.
LEAST_DOCS, SURE = 2, 8.0
#: So many frequent terms get strength from pairs, too.
FREQUENT = 1024
#: A fitted weight, or length of factors, in a document, below which a term is nothing.
NOTHING = 0.01
#: Parts of the fitting sample, each scored by a model of the others to scale margins.
PARTS = 3
_WORD = re.compile(r"[^\W_]+")
#: A word's slot and those of its beginnings.
Word = tuple[int, tuple[int, ...]]
_MEMO: dict[str, tuple[Word, ...]] = {}


def _slots(piece: str) -> tuple[Word, ...]:
    return tuple((slot(f"w {w}"), tuple(slot(f"{n} {w[:n]}") for n in (4, 5) if len(w) > n)) for w in _WORD.findall(piece.lower()))


def shared(beginning: int) -> int:
    """The slot of a beginning that several words share."""
    return (beginning * 0x9E3779B1 + 0x7F4A7C15) & (DIMS - 1)


def gathered(words: set[Word]) -> set[int]:
    """The terms of a document from its distinct words."""
    once: set[int] = set()
    again: set[int] = set()
    for _, beginnings in words:
        for b in beginnings:
            (again if b in once else once).add(b)
    return once.union((w for w, _ in words), map(shared, again))


def terms_of(text: str | None) -> list[int]:
    """Hashed distinct terms of a whole text, sorted."""
    if len(_MEMO) > MEMO:
        _MEMO.clear()
    words: set[Word] = set()
    for piece in set((text or "").split()):
        found = _MEMO.get(piece)
        if found is None:
            found = _MEMO[piece] = _slots(piece)
        words.update(found)
    return sorted(gathered(words))


class FactorizationMachine:
    """A bias, and for each kept term a weight and ``RANK`` factors; ``place`` is by hash."""

    def __init__(self, place: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.place, self.bias, self.weights, self.factors = place, bias, weights, factors

    def margin(self, at: np.ndarray) -> float:
        v = self.factors[at]
        both = v.sum(axis=0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (both @ both - (v * v).sum()))

    def scaled(self, by: float, more: float) -> FactorizationMachine:
        """The machine whose margins are ``by`` times these and ``more``."""
        return FactorizationMachine(self.place, self.bias * by + more, self.weights * by, self.factors * by**0.5)

    def score(self, terms) -> float:
        at = self.place[np.asarray(terms, dtype=np.int64)]
        return self.of(at[at >= 0])

    def of(self, at) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(at), -30, 30))))

    def held(self) -> tuple[bytes, bytes]:
        """For each hash, whether the model holds it, and whether it does as a beginning, alone or shared."""
        own = self.place >= 0
        return own.tobytes(), (own | own[shared(np.arange(DIMS, dtype=np.int64))]).tobytes()

    def matters(self, piece: str, own: bytes, begins: bytes, known: dict[str, int]) -> tuple[Word, ...]:
        """The words of a piece of text with those beginnings that the model holds; ``known`` keeps beginnings."""
        out = []
        for word in _WORD.findall(piece.lower()):
            found = []
            for n in (4, 5):
                if len(word) > n:
                    b = known.get(word[:n])
                    if b is None:
                        b = slot(f"{n} {word[:n]}")
                        b = known[word[:n]] = b if begins[b] else -1
                    if b >= 0:
                        found.append(b)
            w = slot(f"w {word}")
            if found or own[w]:
                out.append((w, tuple(found)))
        return tuple(out)

    def texts(self, texts: pd.Series, memo: dict[str, tuple[Word, ...]]) -> list[float]:
        """Scores of whole texts; ``memo`` keeps what matters of a piece."""
        out, known = [], {}
        own, begins = self.held()
        for text in texts:
            words: set[Word] = set()
            for piece in set((text or "").split()):
                found = memo.get(piece)
                if found is None:
                    found = memo[piece] = self.matters(piece, own, begins, known)
                if found:
                    words.update(found)
            terms = gathered(words)
            out.append(self.score(np.sort(np.fromiter(terms, dtype=np.int64, count=len(terms)))))
            if len(memo) > MEMO:
                memo.clear()
                known.clear()
        return out


def likelihood_ratio(a: np.ndarray, b: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """Of presence against class: ``a`` of ``pos`` and ``b`` of ``neg`` documents have it."""
    both = (a + b) / (pos + neg)

    def part(k, n):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(n * both, 1e-12)), 0) + np.where(
            n - k > 0, (n - k) * np.log(np.maximum(n - k, 1e-12) / np.maximum(n * (1 - both), 1e-12)), 0
        )

    return 2 * (part(a, pos) + part(b, neg))


def strengths(row: np.ndarray, terms: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The strength of every hash, 0 if fewer than ``LEAST_DOCS`` documents have it.

    A pair counts by how much its likelihood ratio exceeds those of its terms, less what
    the best of as many pairs would reach by chance.
    """
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    a = np.bincount(terms[y[row] == 1], minlength=DIMS).astype(float)
    b = np.bincount(terms[y[row] == 0], minlength=DIMS).astype(float)
    own = likelihood_ratio(a, b, pos, neg)

    often = np.lexsort((np.arange(DIMS), -(a + b)))[:FREQUENT]
    often = often[(a + b)[often] >= LEAST_DOCS]
    where = np.full(DIMS, -1, dtype=np.int32)
    where[often] = np.arange(len(often))
    at = where[terms]
    has = np.zeros((len(y), len(often)), dtype=np.float32)
    has[row[at >= 0], at[at >= 0]] = 1
    together = [has[y == k].T @ has[y == k] for k in (1, 0)]
    gain = likelihood_ratio(together[0].astype(float), together[1].astype(float), pos, neg)
    gain -= np.maximum(own[often][:, None], own[often][None, :])
    np.fill_diagonal(gain, 0.0)
    if len(often) > 1:
        chance = 2 * np.log(len(often) * (len(often) - 1) / 2)
        own[often] = np.maximum(own[often], gain.max(axis=1) - chance)
    own[a + b < LEAST_DOCS] = 0
    return (own / (own + SURE)) ** 2


def fit(docs: DataFrame, labels: DataFrame, epochs: int = 5, rate: float = 0.5, decay: float = 1e-2, most: int = MAX_LABELLED) -> FactorizationMachine:
    """Learns only from rows whose id's fold isn't held out; AdaGrad on the logistic loss."""
    trainable = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    return fitted(*labelled(docs, labels, "toxic", trainable, terms_of, most), epochs, rate, decay)


def fitted(starts: np.ndarray, terms: np.ndarray, y: np.ndarray, epochs: int = 5, rate: float = 0.5, decay: float = 1e-2) -> FactorizationMachine:
    """A model of all documents whose margins are scaled by those of models that haven't seen the document.

    What a model has seen is explained in part by terms that occur there by chance, so its own
    margins are too sure of them, and too little is left for what would tell on other documents.
    """
    model, parts = once(starts, terms, y, epochs, rate, decay), np.arange(len(y)) % PARTS
    if not len(model.weights) or any(len(set(y[parts != k].tolist())) < 2 for k in range(PARTS)):
        return model
    margins, sizes = np.zeros(len(y)), np.diff(starts)
    for k in range(PARTS):
        seen = parts != k
        other = once(np.concatenate([[0], np.cumsum(sizes[seen])]), terms[np.repeat(seen, sizes)], y[seen], epochs, rate, decay)
        for i in np.flatnonzero(~seen):
            at = other.place[terms[starts[i] : starts[i + 1]]]
            margins[i] = other.margin(at[at >= 0])
    by, more = platt(margins, y)
    return model.scaled(by, more) if by > 0 else model


def once(starts: np.ndarray, terms: np.ndarray, y: np.ndarray, epochs: int, rate: float, decay: float) -> FactorizationMachine:
    place = np.full(DIMS, -1, dtype=np.int32)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return FactorizationMachine(place, float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0), np.zeros((0, RANK)))
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(starts))
    strong = strengths(row, terms, y)
    kept = np.flatnonzero(strong)
    place[kept] = np.arange(len(kept))
    x = strong[kept].astype(np.float32)
    rng = np.random.default_rng(8)
    w, v = np.zeros(len(kept), dtype=np.float32), rng.normal(0, 0.01, (len(kept), RANK)).astype(np.float32)
    bias = float(np.log((y == 1).sum() / (y == 0).sum()))
    gw, gv, gb = np.full(len(kept), 0.1, dtype=np.float32), np.full(len(kept), 0.1, dtype=np.float32), 0.1
    rows = []
    for i in range(len(y)):
        at = place[terms[starts[i] : starts[i + 1]]]
        rows.append(at[at >= 0])
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at = rows[i]
            own, u = x[at], v[at]
            f = u * own[:, None]
            both = f.sum(axis=0)
            m = float(bias + w[at] @ own + 0.5 * (both @ both - (f * f).sum()))
            g = 1 / (1 + np.exp(-min(30, max(-30, m)))) - y[i]
            gb += g * g
            bias -= 0.3 * rate * g / gb**0.5
            if len(at):
                # steps go by strength: what divides a factor's gradient holds none
                dw = g * own
                gw[at] += dw * dw
                w[at] -= rate * dw / np.sqrt(gw[at])
                dv = g * (both - f)
                gv[at] += (dv * dv).mean(axis=1)
                v[at] = u - rate * (own / np.sqrt(gv[at]))[:, None] * (dv + decay * u)
    w, v = (w * x).astype(float), (v * x[:, None]).astype(float)
    v[(v * v).sum(axis=1) < NOTHING**2] = 0
    w[np.abs(w) < NOTHING] = 0
    something = (w != 0) | v.any(axis=1)
    place[kept] = np.where(something, np.cumsum(something) - 1, -1)
    return FactorizationMachine(place, bias, w[something], v[something])


def score(docs: DataFrame, model: FactorizationMachine):
    """A column over ``docs``: the score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS places, as many weights and factors at most

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[Word, ...]] = {}
        for batch in texts:
            yield pd.Series(sent.value.texts(batch, memo), dtype="float64")
        memo.clear()  # the worker may go on with other work
        tidy()

    return of(docs["text"].cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    slim = docs.select("doc_id", "text")
    return slim.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score(slim, fit(docs, labels)).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= LEAST, 1).otherwise(0))
