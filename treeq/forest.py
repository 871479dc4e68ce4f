"""Forests: trees as rows with an interval encoding.

``pre`` numbers a tree's nodes from 0 in pre-order and ``hi`` is the last number in
a node's subtree, so ``d`` is below ``a`` exactly if ``a.pre < d.pre <= a.hi`` in one
tree: axes are joins, without recursion (Grust, SIGMOD 2002). ``node_id``, the place in
post-order, is ``hi - depth``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeq.lineage import Scratch, by_part_of_keys
from treeq.syntax import Syntax

NODE = {
    "tree": "bigint",
    "pre": "bigint",
    "hi": "bigint",
    "depth": "int",
    "parent": "bigint",
    "ord": "bigint",
    "n": "bigint",
    "field": "string",
    "kind": "string",
    "text": "string",
}


def nodes(df: DataFrame, tree, pre, hi, depth: int, parent, ord, n, kind, text=None, field=None) -> DataFrame:
    """One level of a forest, its columns cast; names and columns alike are taken."""
    given = {"tree": tree, "pre": pre, "hi": hi, "depth": depth, "parent": parent, "ord": ord, "n": n, "field": field, "kind": kind, "text": text}

    def column(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return df.select(*[column(x).cast(NODE[k]).alias(k) for k, x in given.items()])


@dataclass(frozen=True)
class Forest:
    """``nodes`` has the columns of ``NODE`` at least; others, such as positions, stay.

    ``refs`` has ``tree, ref, decl`` by ``pre``: ``decl`` is null for a reference that
    leads nowhere.
    """

    nodes: DataFrame
    syntax: Syntax
    name: str = "forest"
    refs: DataFrame | None = None
    strict: bool = True
    #: Whether ``nodes`` read scratch tables of trees. Their files are so much smaller than their rows that the
    #: optimizer would send millions of rows through the driver to broadcast them, so joins of such nodes are merge joins.
    large: bool = False

    def side(self, df: DataFrame) -> DataFrame:
        """``df`` as a side of a join of this forest's nodes."""
        return df.hint("merge") if self.large else df

    def query(self, text: str, bindings: dict | None = None) -> DataFrame:
        from treeq.plans.compiler import match

        return match(self, text, bindings or {})

    def lenient(self) -> Forest:
        """The same forest, where what would be an error makes a condition false."""
        return replace(self, strict=False)

    def written(self) -> Forest:
        """The same forest with its nodes written in the shared folder, for several queries."""
        return replace(self, nodes=Scratch(self.nodes.sparkSession, self.name).save(self.nodes, "nodes"), large=True)

    def bucketed(self, count: int | None = None, dealt: bool = False) -> Forest:
        """The same forest written in ``count`` buckets by tree, so that joins along axes need no exchange.

        That is for forests of many trees: a tree lies in one bucket, and so in one task.
        A large tree is better ``written``. With ``dealt``, the nodes come dealt out by tree (``lineage.deal``). Joins by tree and place may use the buckets from now on in this session.
        """
        spark = self.nodes.sparkSession
        by_part_of_keys(spark)
        count = count or int(spark.conf.get("spark.sql.shuffle.partitions"))
        own = self.nodes if dealt else self.nodes.repartition(count, "tree")
        return replace(self, nodes=Scratch(spark, self.name).bucketed(own, "nodes", ["tree"], count), large=True)
