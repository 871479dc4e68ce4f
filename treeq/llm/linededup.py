"""Line dedup: a suffix array over line-ID sequences, by distributed prefix doubling.

Only DataFrame operations. Lines become IDs; IDs that occur once can't be part of a
repeated run, so they only end the runs of their neighbours. Suffixes start at the
lines that are left and stop at the next such end. Ranks by one line are doubled
(Manber and Myers, SIAM J. Comput. 1993): the pair of the rank at a line and the
rank ``2^k`` lines on gives the rank by ``2^(k+1)`` lines. Pairs are made distinct
before they are sorted, and the sort is by range partitions with counts added up
over partitions, so one frequent line is one row there and no task gets its copies.

A run counts once its lines hold ``min_words`` words. Suffixes next to each other in
the array whose longest common prefix reaches that far form an interval; its first
suffix in (doc_id, text hash, line) order is the original, all others are later
copies whose lines go. The interval needs no longer prefix than ``min_words`` lines,
as each holds a word at least, so doubling stops at that depth.

Maximal runs go whole, but are never put together: what a line of a repeated run needs
is a part of the run that counts and can't be shortened without losing the line or the
count. Such a part is either the shortest that counts from its first line on or the
shortest up to its last, so prefixes of these two kinds are compared, and the lines of
all later copies are the union of the maximal runs. Without ``closing``, only the first
kind is: a longer repeated run then keeps its closing lines in later copies, if those
hold under ``min_words`` words in all.

Defined cases: null and blank texts have no lines; very long ones are cut up whole,
into rows of one line each. Blank lines are no lines: they
separate nothing, are never deleted and have no number. Rows with equal ``doc_id``
and text count as one document, so repeated rows delete nothing from each other.
Null ids sort first. Other columns are kept as they are; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeq.llm.common import WORD, Scratch, before, documents, fresh, ordered

MIN_WORDS = 10
#: Suffixes whose neighbours are compared in one window.
STRETCH = 1 << 14
DOC = ["__doc", "__th"]


def with_lines(docs: DataFrame) -> DataFrame:
    """``__doc, __th, __lines``: the id, a hash of the text, the lines that hold a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").alias("__doc"),
        F.xxhash64(text).alias("__th"),
        F.transform(
            F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD))),
            lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("w")),
        ).alias("__lines"),
    )


def ranked(distinct: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``distinct`` rows with their place in the global order of ``keys`` as ``rank``."""
    return before(ordered(distinct, keys, scratch, "order"), {"rank": F.lit(1)}, keys)


def suffix_array(lines: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """Rows ``__doc, __th, seq, h, g, w, rank`` of all suffixes, by ``depth`` lines or more.

    ``lines`` is the output of ``with_lines``. Doubling stops at the first power of two
    from ``depth`` on: suffixes with equal ranks share as many lines, or end together.
    For the order of whole suffixes, ``depth`` is the length of the longest document.
    """
    rows = lines.select(*DOC, F.posexplode("__lines")).select(*DOC, F.col("pos").alias("seq"), "col.h", "col.g", "col.w")
    repeated = rows.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    ids = scratch.save(ranked(repeated, ["h", "g"], scratch), "ids")
    now = scratch.save(rows.join(ids, ["h", "g"]).dropDuplicates([*DOC, "seq"]), "suffixes")
    step = 1
    doc = Window.partitionBy(*DOC).orderBy("seq")
    while step < depth:
        on = F.when(F.lead("seq", step).over(doc) == F.col("seq") + step, F.lead("rank", step).over(doc))
        paired = scratch.save(now.withColumn("next", F.coalesce(on, F.lit(-1))), "pairs")
        pairs = paired.select(F.col("rank").alias("here"), "next").distinct()
        deeper = scratch.save(ranked(pairs, ["here", "next"], scratch).withColumnRenamed("rank", "deeper"), "ranks")
        scratch.drop(now)
        paired_up = paired.withColumnRenamed("rank", "here").join(deeper, ["here", "next"])
        now = scratch.save(paired_up.drop("here", "next").withColumnRenamed("deeper", "rank"), "suffixes")
        scratch.drop(paired)
        step *= 2
    return now


def later_copies(lines: DataFrame, min_words: int, scratch: Scratch, closing: bool = True) -> DataFrame:
    """``__doc, __th, seq, run`` of every suffix whose first ``run`` lines are a later copy."""
    suffixes = suffix_array(lines, min_words, scratch)
    ahead = Window.partitionBy(*DOC).orderBy("seq").rangeBetween(0, min_words - 1)
    window = F.collect_list(F.struct("seq", "h", "g", "w")).over(ahead)
    # the lines up to the first gap, and the words up to each of them
    unbroken = F.filter("ahead", lambda x, i: x["seq"] == F.col("seq") + i)
    words = F.transform(
        F.sequence(F.lit(1), F.size("lines")),
        lambda n: F.aggregate(F.slice("lines", F.lit(1), n), F.lit(0), lambda total, x: total + x["w"]),
    )
    enough = F.array_position(F.transform(words, lambda n: n >= min_words), True).cast("int")
    # a run that counts, as it is; suffixes too short for one are no part of an interval
    runs = suffixes.withColumn("ahead", window).withColumn("lines", unbroken).withColumn("run", enough).filter("run > 0")
    if closing:
        # also longer runs that would not count without their first line: one at most ends at a line
        first = F.get("lines", F.lit(0))["w"]
        longer = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda n: (n > F.col("run")) & (F.get(words, n - 1) - first < min_words))
        runs = runs.withColumn("run", F.explode(F.concat(F.array("run"), longer)))
    prefix = F.transform(F.slice("lines", F.lit(1), F.col("run")), lambda x: F.struct(x["h"], x["g"]))
    runs = runs.select(*DOC, "seq", "rank", "run", prefix.alias("prefix"))
    keys = [*(["run"] if closing else []), "rank", *DOC, "seq"]  # runs of one length each have an array
    placed = before(ordered(runs, keys, scratch, "array"), {"at": F.lit(1)}, keys)

    # neighbours meet in stretches of the array; the last of a stretch is also the first of the next
    stretch = F.floor(F.col("at") / STRETCH)
    spread = placed.withColumn("stretch", F.explode(F.array_distinct(F.array(stretch, F.floor((F.col("at") + 1) / STRETCH)))))
    along = Window.partitionBy("stretch").orderBy("at")
    previous = F.lag("prefix").over(along)
    common = F.size(F.filter(F.zip_with("prefix", previous, lambda a, b: a == b), lambda same: ~F.coalesce(same, F.lit(False))))
    apart = previous.isNull() | (F.size("prefix") != F.size(previous)) | (common > 0)
    array = scratch.save(
        spread.withColumn("opens", F.when(apart, F.col("at")))
        .filter(stretch == F.col("stretch"))
        .withColumn("start", F.last("opens", ignorenulls=True).over(along))
        .drop("prefix", "rank"),
        "intervals",
    )
    # an interval that opened in an earlier stretch: the last one to open there, looked up in two steps
    ends = array.groupBy("stretch").agg(F.max("opens").alias("last")).withColumn("block", F.floor(F.col("stretch") / STRETCH))
    prior = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = ends.groupBy("block").agg(F.max("last").alias("end")).withColumn("far", F.max("end").over(prior(Window.orderBy("block"))))
    near = F.max("last").over(prior(Window.partitionBy("block").orderBy("stretch")))
    carried = ends.withColumn("near", near).join(blocks.drop("end"), "block").select("stretch", F.coalesce("near", "far").alias("carried"))
    array = array.join(carried, "stretch").withColumn("interval", F.coalesce("start", "carried"))
    position = F.struct("__doc", "__th", "seq")
    intervals = array.select("interval", *DOC, "seq", "run")
    firsts = intervals.groupBy("interval").agg(F.min(position).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    firsts = scratch.save(firsts.select("interval", "first"), "firsts")
    return intervals.join(firsts, "interval").filter(~position.eqNullSafe(F.col("first"))).select(*DOC, "seq", "run")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, closing: bool = True) -> DataFrame:
    """``__doc, __th, __n, __deleted`` of each distinct document: its number of lines,
    and the sorted numbers, from 0, of those that a later copy covers."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(with_lines(docs), "lines")
    copies = later_copies(lines, min_words, scratch, closing)
    gone = copies.select(*DOC, F.explode(F.sequence("seq", F.col("seq") + F.col("run") - 1)).alias("seq")).distinct()
    gone = scratch.save(
        gone.groupBy(*DOC).agg(F.sort_array(F.collect_list("seq")).alias("__deleted")).withColumnsRenamed({"__doc": "__d", "__th": "__t"}), "deleted"
    )
    each = lines.select(*DOC, F.size("__lines").alias("__n"))
    return each.join(gone, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), "left").drop("__d", "__t")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, closing: bool = True) -> DataFrame:
    """``docs`` with the lines of later copies taken out of ``text``; other columns stay."""
    doc, th, deleted = fresh(docs, "doc", "th", "deleted")
    gone = deleted_lines(docs, min_words, closing).filter("__deleted IS NOT NULL").dropDuplicates(DOC)
    gone = gone.select(F.col("__doc").alias(doc), F.col("__th").alias(th), F.col("__deleted").alias(deleted))
    text = F.coalesce(F.col("text"), F.lit(""))

    def places(parts: Column) -> Column:
        return F.sequence(F.lit(0), F.size(parts) - 1)

    def without(parts: Column, lines: Column) -> Column:
        dropped = F.transform(F.col(deleted), lambda n: F.get(lines, n))
        return F.array_join(F.transform(F.array_except(places(parts), dropped), lambda i: F.get(parts, i)), "\n")

    # a text is split once, and its lines that hold a word are found once: both are bound to variables
    kept = F.transform(
        F.array(F.split(text, "\n", -1)),
        lambda parts: F.get(
            F.transform(
                F.array(F.filter(places(parts), lambda i: F.rlike(F.get(parts, i), F.lit(WORD)))), lambda lines: without(parts, lines)
            ),
            F.lit(0),
        ),
    )
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(th)), "left")
    return joined.withColumn("text", F.when(F.col(deleted).isNull(), F.col("text")).otherwise(F.get(kept, F.lit(0)))).drop(doc, th, deleted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_lines(documents(spark, sf_dir)).select(
        F.col("__doc").alias("doc_id"),
        F.col("__n").cast("long").alias("n_lines"),
        F.coalesce(F.size("__deleted"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.array_join("__deleted", ","), F.lit("")).alias("deleted_lines"),
    )


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, lines[n] AS line, n - 1 AS seq FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM (
    SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents))),
c AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
k AS (SELECT doc_id, seq, list(line) OVER ahead AS lines, list(w) OVER ahead AS ws FROM c
      WINDOW ahead AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
m AS (SELECT *, unnest(range(1, len(ws) + 1)) AS run FROM k),
p AS (SELECT doc_id, seq, run, lines[1:run] AS prefix FROM m
      WHERE list_sum(ws[1:run]) >= 10 AND (list_sum(ws[1:run]) - ws[run] < 10 OR list_sum(ws[1:run]) - ws[1] < 10)),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(seq) OVER o AS fs FROM p WINDOW o AS (PARTITION BY prefix ORDER BY doc_id, seq)),
g AS (SELECT DISTINCT doc_id, unnest(range(seq, seq + run)) AS seq FROM f WHERE NOT (doc_id = fd AND seq = fs)),
a AS (SELECT doc_id, count(*) AS n, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n, 0) AS n_deleted, coalesce(gone, '') AS deleted_lines
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id) USING (doc_id) LEFT JOIN a USING (doc_id)
"""
