"""Names as tables: what declares, refers and opens a scope is said by patterns.

A forest's references come from plans alone, with no function run on a tree. A node lies in the
innermost scope above it, or in its tree's own; a name means the first declaration,
in the order in which nodes end, of the innermost scope that declares it. Scopes
are intervals of places, so the search along all scopes above a reference is one join in bins, however
deep they nest.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeq import language as L
from treeq.errors import CompileError
from treeq.forest import Forest
from treeq.plans import compiler


@dataclass(frozen=True)
class Naming:
    """``declares`` and ``refers`` hold patterns with the expression that gives the name, such as
    ``("match Function f", "f.name.text")``; ``scopes`` holds patterns."""

    declares: tuple[tuple[str, str], ...]
    refers: tuple[tuple[str, str], ...]
    scopes: tuple[str, ...] = ()


#: What the built-in languages say without a script: an identifier means the first function of its name.
BUILTIN = {"python": Naming((("match FunctionDefinition f", "f.name.text"),), (("match Identifier i", "i.text"),))}


def named(forest: Forest, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """``tree, node, last, name``: the nodes that fit, the place in the order in which nodes end, and the name."""
    parts = []
    for query, expression in pairs:
        plan, root = compiler.start(forest, {})
        plan.where_pattern(root, L.parse_query(query))
        v = plan.value(L.parse_expr(expression))
        if v.kind != "string":
            raise CompileError(f"a name can't be a {v.kind}", "NameRes")
        parts.append(plan.df.select(root["tree"].alias("tree"), root["pre"].alias("node"), (root["hi"] - root["depth"]).alias("last"), v.col.alias("name")))
    return reduce(DataFrame.unionByName, parts)


def scopes_of(forest: Forest, queries: tuple[str, ...]) -> DataFrame | None:
    parts = [compiler.match(forest, q, {}).select("tree", "pre", "hi", "depth") for q in queries]
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def place(col):
    return F.floor(col / compiler.BIN)


def covered(df: DataFrame) -> DataFrame:
    """A row for each bin that a scope ``pre, hi`` covers below itself."""
    return df.withColumn("bin", F.explode(F.when(F.col("hi") > F.col("pre"), F.sequence(place(F.col("pre") + 1), place(F.col("hi"))))))


def within(nodes: DataFrame, scopes: DataFrame, on: list[str], side=lambda df: df) -> DataFrame:
    """``nodes`` with each scope above them that agrees on ``on``."""
    inside = (F.col("node") > F.col("pre")) & (F.col("node") <= F.col("hi"))
    return nodes.withColumn("bin", place(F.col("node"))).join(side(covered(scopes)), [*on, "bin"]).filter(inside).drop("bin")


def solve(scopes: DataFrame | None, decls: DataFrame, refs: DataFrame, side=lambda df: df) -> DataFrame:
    """``tree, ref, decl`` of all references; ``decl`` is null where nothing declares the name.

    ``scopes`` has ``tree, pre, hi, depth``, ``decls`` has ``tree, node, last, name`` and ``refs`` has ``tree, node, name``. A null name is
    declared nowhere. ``side`` is what a forest does to a side of a join.
    """
    decls, refs = decls.filter("name IS NOT NULL"), refs.select("tree", "node", "name").distinct()
    first = F.min_by("node", "last").alias("decl")
    if scopes is None:
        outer, found = decls.groupBy("tree", "name").agg(first), refs
    else:
        own = within(decls, scopes, ["tree"], side).groupBy("tree", "node").agg(F.max_by(F.struct("pre", "hi", "depth"), "depth").alias("scope"))
        placed = decls.join(side(own), ["tree", "node"], "left")
        outer = placed.filter("scope IS NULL").groupBy("tree", "name").agg(first)
        inner = placed.filter("scope IS NOT NULL").groupBy("tree", "name", "scope").agg(first).select("tree", "name", "scope.*", "decl")
        hits = within(refs, inner, ["tree", "name"], side).groupBy("tree", "node", "name").agg(F.max_by("decl", "depth").alias("near"))
        found = refs.join(side(hits), ["tree", "node", "name"], "left")
    near = F.col("near") if scopes is not None else F.lit(None).cast("bigint")
    return found.join(side(outer), ["tree", "name"], "left").select("tree", F.col("node").alias("ref"), F.coalesce(near, "decl").alias("decl"))


def resolve(forest: Forest, naming: Naming) -> Forest:
    """The forest with the references that the patterns make."""
    return replace(forest, refs=solve(scopes_of(forest, naming.scopes), named(forest, naming.declares), named(forest, naming.refers), forest.side))


def referring(forest: Forest) -> DataFrame:
    """``tree, decl, refs`` the other way round: for each declaration that is meant, by how many references; with
    ``forest.refs`` on ``tree, decl`` these are its rows."""
    if forest.refs is None:
        raise CompileError("the forest has no references", "NameRes")
    return forest.refs.filter("decl IS NOT NULL").groupBy("tree", "decl").agg(F.count("*").alias("refs"))
