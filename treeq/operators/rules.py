"""Rulesets: many named queries over one forest.

Rules are decided together in one scan, a column for each rule's outcome. What they reach
from a node is joined once, and so is an axis: the quantifiers of all rules over it ask its nodes in
one join. A rule gets a plan of its own if it compares the nodes of an axis with one outside, counts
along an axis that the encoding doesn't count, or can raise on an axis. A node is reported once by a rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeq import language as L
from treeq.errors import ConfigError
from treeq.forest import NODE, Forest
from treeq.operators.reports import CATEGORIES
from treeq.plans.compiler import match, start


@dataclass(frozen=True)
class Rule:
    id: str
    message: str
    category: str
    query: str
    note: str | None = None

    def __post_init__(self) -> None:
        if self.category not in CATEGORIES:
            raise ConfigError(f"unknown category {self.category}")


@dataclass(frozen=True)
class RuleSet:
    id: str
    language: str
    rules: tuple[Rule, ...] = field(default=())

    def __post_init__(self) -> None:
        ids = [r.id for r in self.rules]
        for i in ids:
            if ids.count(i) > 1:
                raise ConfigError(f"two rules {i}", "DuplicateRule")

    @classmethod
    def read(cls, data: dict) -> RuleSet:
        try:
            rules = [Rule(r["id"], r["message"], r["category"], r["query"], r.get("note")) for r in data["rules"]]
            return cls(data["id"], data["language"], tuple(rules))
        except KeyError as e:
            raise ConfigError(f"a ruleset lacks {e}") from None


def shares(forest: Forest, pattern: L.QueryPattern) -> bool:
    """Whether a rule needs no join that only it could use."""
    plan, root = start(forest, {})
    plan.batches = {}
    plan.fits(root, pattern)
    return not plan.alone[0]


def check(forest: Forest, rulesets: list[RuleSet]) -> DataFrame:
    """Reports ``ruleset, rule_id, category, message, note`` with the node's key and place."""
    together, apart = [], []
    for s in rulesets:
        for r in s.rules:
            pattern = L.parse_query(r.query)
            (together if shares(forest, pattern) else apart).append((s, r, pattern))
    extra = [c for c in forest.nodes.columns if c not in NODE]

    def tag(s: RuleSet, r: Rule):
        note = F.lit(r.note).cast("string")
        return F.struct(F.lit(s.id).alias("ruleset"), F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.message).alias("message"), note.alias("note"))

    def shown(df: DataFrame) -> DataFrame:
        return df.select("hit.*", "tree", (F.col("hi") - F.col("depth")).cast("long").alias("node_id"), "kind", *extra)

    parts = []
    if together:
        plan, root = start(forest, {})
        plan.batches = {}
        hits = [F.when(plan.fits(root, pattern), tag(s, r)) for s, r, pattern in together]
        plan.flush()
        hits = F.array_compact(F.array(*hits))
        scanned = plan.df.select(*[F.col(f"v0_{c}").alias(c) for c in forest.nodes.columns], F.explode(hits).alias("hit"))
        parts.append(shown(scanned))
    parts += [shown(match(forest, r.query, {}).withColumn("hit", tag(s, r))) for s, r, _ in apart]
    if not parts:
        raise ConfigError("no rules")
    return reduce(DataFrame.unionByName, parts)


def by_language(rulesets: list[RuleSet]) -> dict[str, list[RuleSet]]:
    found: dict[str, list[RuleSet]] = {}
    for s in rulesets:
        found.setdefault(s.language, []).append(s)
    return found


def check_all(forests: dict[str, Forest], rulesets: list[RuleSet]) -> DataFrame:
    """``check`` of every language's forest by its own rulesets, with the language in ``language``."""
    parts = [check(forests[name], own).withColumn("language", F.lit(name)) for name, own in by_language(rulesets).items() if name in forests]
    if not parts:
        raise ConfigError("no rules")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
