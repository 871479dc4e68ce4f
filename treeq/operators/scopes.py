"""Name resolution over scopes.

Two forms of one search: breadth first from the scope of a reference along its
parents, stopping at the first level where any scope declares the name. A scope gives
its first declaration, and scopes that are reached twice at one level count twice. A
scope that an earlier level looked at without a hit isn't looked at again: what lies
behind it was reached before, so nothing is lost, and the search of a cycle ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeq.lineage import cut


def solve(edges: DataFrame, decls: DataFrame, refs: DataFrame) -> DataFrame:
    """``tree, ref, decl`` for all references; ``decl`` is null where nothing is found.

    ``edges`` has ``tree, scope, parent``, ``decls`` has ``tree, scope, name, node`` and
    ``refs`` has ``tree, scope, name, node``; the first declaration has the least node.
    A level is one join; references that are settled take no part in the next.
    """
    first = decls.groupBy("tree", "scope", "name").agg(F.min("node").alias("decl"))
    front = refs.select("tree", F.col("node").alias("ref"), "name", "scope")
    found: list[DataFrame] = []
    at = ["tree", "ref", "name", "scope"]
    seen: DataFrame | None = None
    while True:
        looked = front.join(first, ["tree", "scope", "name"], "left")
        any_hit = F.max(F.col("decl").isNotNull()).over(Window.partitionBy("tree", "ref"))
        looked = cut(looked.withColumn("hit", any_hit))
        found.append(looked.filter("decl IS NOT NULL").select("tree", "ref", "decl"))
        missed = looked.filter("NOT hit AND name IS NOT NULL")  # a null name is declared nowhere
        visited = missed.select(*at)
        if seen is not None:
            visited = visited.union(seen.join(missed.select("tree", "ref"), ["tree", "ref"], "left_semi").select(*at))
        seen = cut(visited.distinct())
        front = missed.join(edges, ["tree", "scope"]).select("tree", "ref", "name", F.col("parent").alias("scope"))
        front = front.join(seen, at, "left_anti")
        if front.isEmpty():
            break
    settled = found[0]
    for more in found[1:]:
        settled = settled.unionByName(more)
    keys = refs.select("tree", F.col("node").alias("ref")).distinct()
    return keys.join(settled, ["tree", "ref"], "left").select("tree", "ref", "decl")


def solve_flat(decls: DataFrame, refs: DataFrame) -> DataFrame:
    """``solve`` where every tree is one scope: one join, no search."""
    first = decls.groupBy("tree", "name").agg(F.min("node").alias("decl"))
    return refs.join(first, ["tree", "name"], "left").select("tree", F.col("node").alias("ref"), "decl")


@dataclass
class ScopeGraph:
    """The same search within one tree, for aspects written in Python."""

    parents: list[list[int]] = field(default_factory=lambda: [[]])
    decls: list[list[tuple[str, int]]] = field(default_factory=lambda: [[]])
    refs: list[tuple[int, str, int]] = field(default_factory=list)

    def add_scope(self, parent: int = 0) -> int:
        self.parents.append([parent])
        self.decls.append([])
        return len(self.parents) - 1

    def connect(self, scope: int, parent: int) -> None:
        self.parents[scope].append(parent)

    def add_decl(self, scope: int, name: str, node: int) -> None:
        self.decls[scope].append((name, node))

    def add_ref(self, scope: int, name: str, node: int) -> None:
        self.refs.append((scope, name, node))

    def lookup(self, scope: int, name: str) -> list[int]:
        level, seen = [scope], set()
        while level:
            found = [hit for s in level if (hit := next((n for k, n in self.decls[s] if k == name), None)) is not None]
            if found:
                return found
            seen.update(level)
            level = [p for s in level for p in self.parents[s] if p not in seen]
        return []

    def solve(self) -> list[tuple[int, int | None]]:
        """``(ref, decl)`` of all references but those in the root scope itself, which
        nothing ever marks for solving."""
        out: list[tuple[int, int | None]] = []
        for scope, name, node in self.refs:
            if scope:
                out += [(node, d) for d in self.lookup(scope, name)] or [(node, None)]
        return out
