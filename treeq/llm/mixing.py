"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to. Each such pattern
offers its words once at no cost and again at a rising (convex) cost for every
repetition; each source asks for its quota. The flow routes the words, and the
documents of a pattern are then taken in a seeded order until its flow is met: whole
passes over all of them, and one more pass over a prefix of the order. The prefix is
found from a histogram of 4096 ranges of the seeded hash, so only the one range in
which it ends is looked at document by document.

A pattern of one source that is in no other pattern has no choice: its flow is the
least of what it offers and what the source asks. Over ``MAX_PATTERNS`` patterns, all
quotas and such flows are computed as tables, and only what overlaps is routed on the
driver, up to ``MAX_ROUTED`` patterns; beyond that, ``mix`` raises.

Defined cases: a null text has no words and is taken zero times, very long texts are
counted whole; a null source is a source, the last one; repeated rows count each; the
seeded order falls back to the id and size, so equal rows are interchangeable. Other
columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeq.llm.common import WORD, Scratch, before, documents, ordered

#: The bounds of what the driver receives: patterns in all, and of those that overlap.
MAX_PATTERNS, MAX_ROUTED = 20_000, 200_000
SEED = "mix"
#: Weights of sources in the order of their names, again and again.
WEIGHTS = (3, 1, 2)


def quotas(sizes: dict, weights: dict, total: float, most: float = 2.0) -> dict:
    """Target words by source: ``total`` dealt by weight, none over ``most`` sizes.

    Dealing out anew what lies above the limits until none does settles at one
    level: sources in order of limit over weight are full until the rest, dealt by
    weight, stays below its limits.
    """
    order = sorted(sizes, key=lambda s: (most * sizes[s] / weights[s], str(s)))
    full, free = 0.0, float(sum(weights[s] for s in order))
    level = None
    for s in order:
        level = (total - full) / free
        if most * sizes[s] / weights[s] >= level:
            break
        full, free = full + most * sizes[s], free - weights[s]
    return {s: min(most * sizes[s], level * weights[s]) for s in sizes}


def route(supply: list[int], member: list[list[int]], demand: list[int], repeats: int) -> list[int]:
    """Words that each pattern gives, by min-cost flow.

    The r-th pass over a pattern costs r for each word and all else is free, so the
    cheapest flow that meets most demand is a maximum flow with first passes only,
    enlarged with second passes, and so on. Each is found by blocking flows along
    shortest paths (Dinic, 1970).
    """
    n, m = len(supply), len(demand)
    start, end = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room = [], []

    def edge(u: int, v: int, cap: int) -> None:
        for a, b, c in ((u, v, cap), (v, u, 0)):
            head[a].append(len(to))
            to.append(b)
            room.append(c)

    for i in range(n):
        edge(start, i, 0)
    for i in range(n):
        for s in member[i]:
            edge(i, n + s, supply[i] * repeats)
    for s in range(m):
        edge(n + s, end, demand[s])
    for _ in range(repeats):
        for i in range(n):
            room[2 * i] += supply[i]
        while (level := levels(head, to, room, start, end)) is not None:
            block(head, to, room, level, start, end)
    return [room[2 * i + 1] for i in range(n)]


def levels(head, to, room, start: int, end: int) -> list[int] | None:
    """Steps from the start by edges with room, or None if the end isn't reached."""
    level = [-1] * len(head)
    level[start], front = 0, [start]
    while front and level[end] < 0:
        after = []
        for u in front:
            for e in head[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    after.append(to[e])
        front = after
    return level if level[end] >= 0 else None


def block(head, to, room, level: list[int], start: int, end: int) -> None:
    """Fills paths that go one level on with each edge until none is left."""
    turn, path, u = [0] * len(head), [], start
    while True:
        if u == end:
            push = min(room[e] for e in path)
            full = next(k for k, e in enumerate(path) if room[e] == push)
            for e in path:
                room[e] -= push
                room[e ^ 1] += push
            u = to[path[full] ^ 1]
            del path[full:]
            continue
        while turn[u] < len(head[u]):
            e = head[u][turn[u]]
            if room[e] and level[to[e]] == level[u] + 1:
                break
            turn[u] += 1
        if turn[u] < len(head[u]):
            path.append(e)
            u = to[e]
        elif not path:
            return
        else:
            u = to[path.pop() ^ 1]
            turn[u] += 1


PLAN = "__of array<string>, __total long, __target double, __full long, __rest long"


def planned(found: list, names: list, target: dict, repeats: int) -> list[tuple]:
    """Rows of ``PLAN`` for patterns ``(sources, words)``, routed over their sources."""
    place = {s: i for i, s in enumerate(names)}
    found = sorted(found, key=lambda x: [place[s] for s in x[0]])
    flow = route([w for _, w in found], [[place[s] for s in of] for of, _ in found], [int(target[s]) for s in names], repeats)
    return [(of, w, target[of[0]] if len(of) == 1 else None, f // max(1, w), f % max(1, w)) for (of, w), f in zip(found, flow)]


def few(patterns: DataFrame, share: float, repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """The plan of at most ``MAX_PATTERNS`` patterns."""
    found = [(r["__pattern"], r["words"]) for r in patterns.collect()]
    names = sorted({s for of, _ in found for s in of}, key=lambda s: (s is None, s or ""))
    sizes = dict.fromkeys(names, 0)
    for of, w in found:
        for s in of:
            sizes[s] += w
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = quotas(sizes, weight, share * sum(w for _, w in found), float(repeats)) if names else {}
    return F.broadcast(patterns.sparkSession.createDataFrame(planned(found, names, target, repeats), PLAN))


def many(patterns: DataFrame, share: float, repeats: int, weights: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """The same plan from tables: quotas as in ``quotas``, only overlaps are routed on the driver."""
    each = patterns.select(F.explode("__pattern").alias("s"), "words", (F.size("__pattern") > 1).alias("shared"))
    sources = each.groupBy("s").agg(F.sum("words").alias("words"), F.max("shared").alias("shared")).withColumn("none", F.col("s").isNull())
    named = before(ordered(sources, ["none", "s"], scratch, "sources"), {"place": F.lit(1)}, ["none", "s"])
    cycle = F.array(*[F.lit(w) for w in weights])
    named = named.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))).withColumn("most", F.col("words") * float(repeats))
    named = named.withColumns({"ratio": F.col("most") / F.col("weight"), "name": F.coalesce("s", F.lit("None"))})
    by_level = before(ordered(named, ["ratio", "name"], scratch, "levels"), {"full": F.col("most"), "used": F.col("weight")}, ["ratio", "name"])
    by_level = scratch.save(by_level, "quotas")
    free = by_level.agg(F.sum("weight")).first()[0] or 0
    total = share * (patterns.agg(F.sum("words")).first()[0] or 0)
    level = (F.lit(total) - F.col("full")) / (F.lit(free) - F.col("used"))
    reached = by_level.select("ratio", "name", level.alias("level")).filter("ratio >= level").orderBy("ratio", "name").first()
    asked = F.least(F.col("most"), F.lit(reached["level"]) * F.col("weight")) if reached else F.col("most")
    target = scratch.save(by_level.select("s", "shared", asked.alias("target")), "targets")

    alone = patterns.filter(F.size("__pattern") == 1).withColumn("s", F.get("__pattern", F.lit(0)))
    t = target.withColumnRenamed("s", "t")
    alone = alone.join(t, F.col("s").eqNullSafe(F.col("t")))
    flow = F.least(F.col("words") * repeats, F.floor("target"))
    size = F.greatest(F.col("words"), F.lit(1))
    own = alone.filter("NOT shared").select(
        F.col("__pattern").alias("__of"), F.col("words").alias("__total"), F.col("target").alias("__target"),
        F.floor(flow / size).cast("long").alias("__full"), (flow % size).cast("long").alias("__rest"),
    )
    overlaps = patterns.filter(F.size("__pattern") > 1).select("__pattern", "words").unionByName(alone.filter("shared").select("__pattern", "words"))
    routed = [(r["__pattern"], r["words"]) for r in overlaps.limit(MAX_ROUTED + 1).collect()]
    if len(routed) > MAX_ROUTED:
        raise ValueError(f"over {MAX_ROUTED} overlapping membership patterns")
    if not routed:
        return scratch.save(own, "plan")
    asks = dict(target.filter("shared").select("s", "target").collect())  # sources of the patterns just bounded
    names = sorted(asks, key=lambda s: (s is None, s or ""))
    rows = patterns.sparkSession.createDataFrame(planned(routed, names, asks, repeats), PLAN)
    return scratch.save(own.unionByName(rows), "plan")


def sized(docs: DataFrame, sources: Column, seed: str = SEED) -> DataFrame:
    """Adds ``__size, __pattern, __order, __slot, __tie``: what ``mix`` decides by.

    ``sources`` is an array: the sources that a document counts for.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.withColumns(
        {
            "__size": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "__pattern": F.array_distinct(sources),
            "__order": order,
            "__slot": F.substring(order, 1, 3),
            "__tie": F.xxhash64("doc_id", text),
        }
    )


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Adds ``__copies``, and ``__total`` and ``__target`` of the row's pattern, to ``sized`` rows.

    ``weights`` go to the sources in the order of their names, again and again.
    ``__target`` is null for patterns of several sources. ``rows`` are read three
    times and only those of the last ranges move, so they may hold texts.
    """
    scratch = Scratch(rows.sparkSession, "mix")
    slots = scratch.save(rows.groupBy("__pattern", "__slot").agg(F.sum("__size").alias("__words")), "slots")
    patterns = scratch.save(slots.groupBy("__pattern").agg(F.sum("__words").alias("words")), "patterns")
    bounded = patterns.limit(MAX_PATTERNS + 1).count() <= MAX_PATTERNS
    plan = few(patterns, share, repeats, weights) if bounded else many(patterns, share, repeats, weights, scratch)
    earlier = Window.partitionBy("__pattern").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    # the range of the seeded hash in which each pattern's last pass ends
    ends = (
        slots.withColumn("__before", F.coalesce(F.sum("__words").over(earlier), F.lit(0)))
        .join(plan, F.col("__pattern").eqNullSafe(F.col("__of")))
        .filter("__before <= __rest AND __before + __words > __rest")
        .groupBy(F.col("__of").alias("__ends"))
        .agg(F.min(F.struct("__slot", "__before")).alias("__end"))
    )
    ends = scratch.save(ends, "ends")
    ends = F.broadcast(ends) if bounded else ends  # at most one row for each pattern
    joined = rows.join(plan, F.col("__pattern").eqNullSafe(F.col("__of"))).join(ends, F.col("__of").eqNullSafe(F.col("__ends")), "left")
    at_end = F.coalesce(F.col("__slot") == F.col("__end.__slot"), F.lit(False))
    within = Window.partitionBy("__pattern").orderBy("__order", F.col("doc_id").asc_nulls_first(), "__size", "__tie")
    prior = F.coalesce(F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__end.__before")
    sure = joined.filter(~at_end).withColumn("__more", F.coalesce(F.col("__slot") < F.col("__end.__slot"), F.lit(False)).cast("int"))
    edge = joined.filter(at_end).withColumn("__prior", prior)
    # a document goes in if that brings the words taken nearer to the flow
    edge = edge.withColumn("__more", (2 * F.col("__prior") + F.col("__size") <= 2 * F.col("__rest")).cast("int")).drop("__prior")
    copies = F.when(F.col("__size") > 0, F.col("__full") + F.col("__more")).otherwise(0).cast("int")
    return sure.unionByName(edge).withColumn("__copies", copies)


def mixed(docs: DataFrame, sources: Column) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), "doc_id", "text", sources.alias("__sources"))
    taken = mix(sized(packed, F.col("__sources")).drop("text"))
    again = F.explode(F.array_repeat(F.lit(1), F.col("__copies")))
    return taken.filter("__copies > 0").select("__row", again).select("__row.*")


def digest(docs: DataFrame) -> DataFrame:
    narrow = sized(docs.select("doc_id", "text", "source"), F.array(F.col("source").cast("string"))).drop("text")
    rows = Scratch(docs.sparkSession, "mix").save(narrow, "rows")
    taken = (F.col("__size") * F.col("__copies")).alias("taken")
    return mix(rows).select("doc_id", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), taken)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source),
w AS (SELECT source, words, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * words AS most, row_number() OVER (ORDER BY 2.0::DOUBLE * words / weight, coalesce(source, 'None')) AS k FROM w),
f AS (SELECT *, coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fullness,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
             1.5::DOUBLE * (sum(words) OVER ()) AS total FROM r),
l AS (SELECT (total - fullness) / free AS level FROM f WHERE most / weight >= (total - fullness) / free ORDER BY k LIMIT 1),
t AS (SELECT source, words, least(most, level * weight) AS target FROM f, l),
c AS (SELECT d.*, words, target, CAST(floor(target) AS BIGINT) AS flow,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target,
       CAST(CASE WHEN size = 0 THEN 0
                 ELSE size * (flow // words + CASE WHEN 2 * prior + size <= 2 * (flow % words) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM c
"""
