"""Benchmark decontamination with spaced seeds.

Only DataFrame operations. A seed looks at fixed positions of a stretch of words and
ignores the others (Ma, Tromp and Li, Bioinformatics 2002), so that a hit survives
substituted words at the ignored places. Hashes of the test items' seeds are joined
with those of every position of every document. Around each hit the item is laid
over the document's words; the overlap counts equal words in place, and a document
is contaminated if some ``window`` words of the item in a row (all, if it has fewer)
match to ``similarity``.

The masks follow from the length of what must match: whichever words of it may be
substituted, one mask fits somewhere between them, so no overlap is missed.

A document's words are hashed once, in its row; a position is a row only inside
the stage that looks its seeds up, and what leaves it are overlaps that hold. Thus
texts are never shuffled. The test side is broadcast if its counted seeds stay under a
bound, and joined by shuffles of seed hashes otherwise.

Defined cases: words are runs of letters and digits, lower-cased. Null and empty
texts hit nothing; very long texts are looked at whole. Items under ``MIN_WORDS``
words are no evidence and take no part. Equal items each report. Results are per
``doc_id`` and ``item_id``, nulls too: repeated rows give one result. Other columns,
whatever their names, are ignored by the search and kept by the filter; empty tables
give no findings.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm.common import BROADCAST_ROWS, Scratch, bounded, documents, fresh

MIN_WORDS = 5
WINDOW = 13
SIMILARITY = 0.8
#: Masks for one length at most, positions that one looks at, and cases that are tried one by one.
MASKS, WEIGHT, CASES = 4, 6, 2000


def needed(n: int, similarity: float) -> int:
    """Words of ``n`` that must match."""
    return math.ceil(n * similarity - 1e-9)


@lru_cache(maxsize=None)
def masks(n: int, lost: int) -> tuple[tuple[int, ...], ...]:
    """Masks of which one fits between any ``lost`` substituted words of ``n``.

    The widest look for which a greedy cover needs ``MASKS`` masks at most. Where
    there are too many cases to try, one of ``lost + 1`` equal parts is whole.
    """
    if math.comb(n, lost) > CASES:
        return (tuple(range(max(1, n // (lost + 1)))),)
    cases = set(itertools.combinations(range(n), lost))
    for weight in range(min(WEIGHT, n - lost), 0, -1):
        fits: dict[tuple[int, ...], set] = {}
        for rest in itertools.combinations(range(1, n), weight - 1):
            places = [{at, *(at + i for i in rest)} for at in range(n - (rest[-1] if rest else 0))]
            fits[0, *rest] = {c for c in cases if any(p.isdisjoint(c) for p in places)}
        chosen, left = [], set(cases)
        while left and len(chosen) < MASKS:
            best = max(fits, key=lambda m: (len(fits[m] & left), -m[-1], [-i for i in m]))
            chosen.append(best)
            left -= fits[best]
        if not left:
            return tuple(chosen)
    return ((0,),)


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds_at(hashes: str, looks: dict[tuple[int, ...], Column]) -> Column:
    """An array of the seed hashes at ``pos``, with null where a mask doesn't fit or its condition fails."""
    return F.array(
        *[
            F.when(
                where & (F.col("pos") + (mask[-1] + 1) <= F.size(hashes)),
                F.xxhash64(F.lit(str(mask)), *[F.get(hashes, F.col("pos") + i) for i in mask]),
            )
            for mask, where in looks.items()
        ]
    )


def findings(docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_hash, item_id, matched, overlap, item_words`` of contaminated documents.

    ``matched`` is the most words that match in one window, ``overlap`` in the whole item.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    tests = scratch.save(
        items.select("item_id", word_hashes(F.col("text")).alias("item")).filter(F.size("item") >= MIN_WORDS), "items"
    )
    length = F.least(F.lit(window), F.size("item"))
    lengths = sorted(r[0] for r in tests.select(length).distinct().collect())  # ``window`` at most
    asks: dict[tuple[int, ...], list[int]] = {}
    for n in lengths:
        for mask in masks(n, n - needed(n, similarity)):
            asks.setdefault(mask, []).append(n)
    planted = tests.select("item_id", F.size("item").alias("n"), "item", F.posexplode("item").alias("ipos", "word"))
    planted = planted.withColumn("pos", F.col("ipos"))
    planted = planted.select("item_id", "n", "ipos", F.explode(seeds_at("item", {m: length.isin(own) for m, own in asks.items()})).alias("seed"))
    planted = scratch.save(planted.filter("seed IS NOT NULL"), "seeds")
    few = planted.count() <= BROADCAST_ROWS

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), word_hashes(F.col("text")).alias("words"))
    # outer, as else a filter on the number of words is added below, which splits and hashes the text once more
    at = rows.select("doc_id", "text_hash", "words", F.posexplode_outer("words").alias("pos", "word"))
    probes = at.select("doc_id", "text_hash", "words", "pos", F.explode(seeds_at("words", dict.fromkeys(asks, F.lit(True)))).alias("probe"))
    diagonal = (F.col("pos") - F.col("ipos")).alias("diagonal")
    if few:
        hits = probes.join(F.broadcast(planted), F.col("probe") == F.col("seed")).select("doc_id", "text_hash", "item_id", "n", "words", diagonal)
    else:
        slim = probes.select("doc_id", "text_hash", "pos", "probe").join(planted, F.col("probe") == F.col("seed"))
        slim = scratch.save(slim.select("doc_id", "text_hash", "item_id", "n", diagonal).distinct(), "hits")
        again = rows.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
        hits = slim.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    # no more of the text leaves the lookup than the item covers, once for all seeds of an overlay
    covered = F.slice("words", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.greatest(F.col("n") + F.least(F.col("diagonal"), F.lit(0)), F.lit(0)))
    hits = hits.select("doc_id", "text_hash", "item_id", F.least(F.col("diagonal"), F.lit(0)).alias("shift"), covered.alias("covered")).distinct()
    tests = tests.select(F.col("item_id").alias("i"), "item")
    overlays = hits.join(F.broadcast(tests) if few else tests, F.col("item_id").eqNullSafe(F.col("i")))  # seeds bound the words of items

    # ``same`` is bound to a variable, as conditions on what follows from it are moved into the join
    same = F.transform("item", lambda w, k: F.when(F.get("covered", F.col("shift") + k) == w, 1).otherwise(0))
    n = F.least(F.lit(window), F.size("item"))
    least = F.ceil(n * similarity - 1e-9)

    def total(flags: Column) -> Column:
        return F.aggregate(flags, F.lit(0), lambda a, x: a + x)

    def best(flags: Column) -> Column:
        return F.array_max(F.transform(F.sequence(F.lit(1), F.size(flags) - n + 1), lambda s: total(F.slice(flags, s, n))))

    counted = F.transform(F.array(same), lambda flags: F.struct(total(flags).alias("overlap"), F.when(total(flags) >= least, best(flags)).alias("matched")))
    return (
        overlays.select("doc_id", "text_hash", "item_id", F.size("item").alias("item_words"), least.alias("least"), F.get(counted, F.lit(0)).alias("m"))
        .filter(F.col("m.matched") >= F.col("least"))
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max("m.matched").alias("matched"), F.max("m.overlap").alias("overlap"), F.max("item_words").alias("item_words"))
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without findings."""
    scratch = Scratch(docs.sparkSession, "decontam")
    doc, th = fresh(docs, "doc", "th")
    found = scratch.save(findings(docs, items).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(th)).distinct(), "found")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bounded(found), docs["doc_id"].eqNullSafe(F.col(doc)) & (key == F.col(th)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("matched").cast("long").alias("matched"), F.max("overlap").cast("long").alias("overlap"), F.max("item_words").cast("long").alias("item_words")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS item FROM benchmark),
i AS (SELECT *, least(13, len(item)) AS w FROM b WHERE len(item) >= 5),
p AS (SELECT item_id, w, generate_subscripts(item, 1) AS ipos, unnest(item) AS word FROM i),
q AS (SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM d),
h AS (SELECT doc_id, item_id, pos - ipos AS diagonal FROM q JOIN p USING (word)
      GROUP BY ALL HAVING count(*) >= ceil(any_value(w) * 0.8 - 1e-9)),
e AS (SELECT doc_id, item_id, w, list_transform(range(1, len(item) + 1), lambda j: CASE WHEN diagonal + j >= 1 AND words[diagonal + j] = item[j] THEN 1 ELSE 0 END) AS same
      FROM h JOIN d USING (doc_id) JOIN i USING (item_id)),
x AS (SELECT doc_id, item_id, w, list_sum(same) AS overlap, len(same) AS n,
             list_max(list_transform(range(1, len(same) - w + 2), lambda k: list_sum(same[k : k + w - 1]))) AS matched FROM e)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(overlap) AS BIGINT) AS overlap, CAST(max(n) AS BIGINT) AS item_words
FROM x WHERE matched >= ceil(w * 0.8 - 1e-9) GROUP BY doc_id, item_id
"""
