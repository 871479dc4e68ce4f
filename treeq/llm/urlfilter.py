"""URL filters: a blocked Bloom filter before an exact hash join.

The listed rules are canonical URLs, ``host`` and ``path``. A URL fits a rule of
its own host or of a parent domain if its path starts with the rule's, so it asks
for every pair of a host suffix and a path prefix whose length some rule has. Each
asked pair is first looked up in a Bloom filter made of 64-bit blocks (one hash
picks the block, the others set bits in it), and only what passes goes to the exact
join, which removes false positives. A filter of up to ``BROADCAST_ROWS`` blocks is part
of the plan and looked up in the URL's own row, so what it stops is never a row; a larger
one is joined by block.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
fits no rule; very long ones are looked at whole. A URL that fits no rule is allowed. Of the rules that fit, the one
with the longest text wins, then the one with the longer host. Repeated rows give
repeated rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm.common import BROADCAST_ROWS, Scratch, bounded, documents

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BITS = 6
#: Listed URLs that share a block on average: 64 bits for 5 URLs.
PER_BLOCK = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(tail, r"^[^?#]*", 0)


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(blocks))


def bits_of(key: Column) -> Column:
    """A 64-bit word with up to ``BITS`` bits set by the key's second hash."""
    h = F.xxhash64(F.lit(1), key)
    word = F.lit(0).cast("long")
    for i in range(BITS):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return word


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """``block, word`` of the filter over ``keys(key)``."""
    return keys.groupBy(block_of(F.col("key"), blocks).alias("block")).agg(F.bit_or(bits_of(F.col("key"))).alias("word"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages(page_id, url)``.

    ``rules`` has ``verdict, host, path``.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    listed = rules.select(F.col("verdict"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    listed = listed.withColumn("key", F.concat("rule_host", F.lit("\n"), "rule_path"))
    facts = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    blocks = max(1, facts["n"] // PER_BLOCK + 1)
    words = bloom(listed, blocks)

    host, path = host_and_path(F.col("url"))
    parsed = scratch.save(pages.select("page_id", host.alias("host"), path.alias("path")), "parsed")
    asked = parsed.select("host", "path").distinct().filter("host != ''")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(x) for x in facts["lengths"]]) if facts["lengths"] else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform("prefixes", lambda p: F.concat(h, F.lit("\n"), p))))
    asked = asked.withColumn("prefixes", prefixes)
    passes = lambda word, pair: word.bitwiseAND(bits_of(pair)) == bits_of(pair)
    if blocks <= BROADCAST_ROWS:
        dense = np.zeros(blocks, dtype=np.int64)
        for r in words.collect():  # one row for each block
            dense[r["block"]] = r["word"]
        table = F.lit(dense)
        possible = F.filter(pairs, lambda pair: passes(F.get(table, block_of(pair, blocks).cast("int")), pair))
        possible = asked.select("host", "path", F.explode(possible).alias("asked"))
    else:
        possible = asked.select("host", "path", F.explode(pairs).alias("asked")).withColumn("block", block_of(F.col("asked"), blocks))
        possible = possible.join(bounded(words), "block").filter(passes(F.col("word"), F.col("asked")))
    hits = possible.join(bounded(listed), F.col("asked") == F.col("key"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max_by(F.struct(rule.alias("rule"), "verdict"), F.struct(F.length(rule), F.length("rule_host"), rule, "verdict"))
    chosen = scratch.save(hits.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(best.alias("best")), "chosen")
    return parsed.join(chosen.hint("merge"), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(documents(spark, sf_dir, "pages"), rules)


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                    ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path,
  (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rhost || rpath)) FROM r
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM p
"""
