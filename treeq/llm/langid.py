"""Language ID by rank-order profiles of n-grams.

A profile is the ``TOP`` most frequent letter n-grams of a language, in order. A
document's own most frequent n-grams are ranked the same way, and each language is
as far as the places by which they are out of order; an n-gram that a profile lacks
counts ``TOP`` places (Cavnar and Trenkle, SDAIR 1994). N-grams are of one to three
characters of lower-cased letters; what isn't a letter is one space between words.

Profiles are counted over all trainable documents: partitions count their own, and
Spark adds up the counts. Only profiles, ``TOP`` rows a language, reach the driver.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so
is every text if nothing can be learned. Null languages teach nothing. Equal counts
rank by code, equal distances by the language's code points. Very long texts are
ranked whole. Repeated rows each get their result; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeq.llm.common import documents, fold

HELD_OUT = 1
FOLDS = 3
TOP = 300
#: Characters of one language that are counted at once in a worker.
BLOCK = 1 << 21
_PLACES: list[np.ndarray] = []


def _places() -> np.ndarray:
    """By code point: 0 for what isn't a letter, else the letter's place among letters."""
    if not _PLACES:
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        _PLACES.append(np.where(letters, np.cumsum(letters), 0).astype(np.int64))
    return _PLACES[0]


def codes(text: str) -> np.ndarray:
    """One number for each n-gram of the text, longer ones above shorter ones."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = _places()[raw]
    c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])] if len(c) else c
    if not c.any():
        return np.zeros(0, dtype=np.int64)
    c = np.concatenate([[0] if c[0] else [], c, [0] if c[-1] else []]).astype(np.int64)
    two = c[:-1] << 18 | c[1:]
    three = two[:-1] << 18 | c[2:]
    return np.concatenate([c[c != 0], two | 1 << 58, three | 2 << 58])


def ranking(found: np.ndarray) -> np.ndarray:
    """The ``TOP`` most frequent codes, most frequent first."""
    kinds, n = np.unique(found, return_counts=True)
    return kinds[np.argsort(-n, kind="stable")[:TOP]]


def profiles(docs: DataFrame, trainable) -> dict[str, np.ndarray]:
    """The ranked codes of every language in the trainable rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                part: list[np.ndarray] = []
                size = 0
                for i, text in enumerate(own):
                    part.append(codes(text))
                    size += len(text)
                    if size >= BLOCK or i == len(own) - 1:
                        kinds, n = np.unique(np.concatenate(part), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds), pa.array(n)], ["lang", "code", "n"])
                        part, size = [], 0

    rows = docs.filter(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), "text")
    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counts.withColumn("place", place).filter(F.col("place") <= TOP).select("lang", "place", "code").collect()
    found: dict[str, list] = {}
    for r in sorted(best):
        found.setdefault(r["lang"], []).append(r["code"])
    return {lang: np.array(own, dtype=np.int64) for lang, own in sorted(found.items())}


class Profiles:
    def __init__(self, by_lang: dict[str, np.ndarray]):
        self.langs = list(by_lang)
        self.known = np.unique(np.concatenate(list(by_lang.values()))) if by_lang else np.zeros(0, dtype=np.int64)
        self.place = np.full((len(self.known) + 1, len(self.langs)), -1, dtype=np.int64)
        for j, own in enumerate(by_lang.values()):
            self.place[np.searchsorted(self.known, own), j] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranking(codes(text or ""))
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.known, own)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        place = self.place[at]
        out = np.where(place < 0, TOP, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(out.argmin())
        return self.langs[best], float(1 - out[best] / (TOP * len(own)))


def predict(docs: DataFrame, by_lang: dict[str, np.ndarray]):
    """A struct column ``lang_pred, score`` over ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(by_lang))  # TOP rows a language

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang_pred", "score"])

    return of("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = profiles(docs, fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    return docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), predict(docs, found).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )
