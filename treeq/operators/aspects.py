"""Aspects: Python functions for kinds, run tree by tree on the executors."""

from __future__ import annotations

import ast
import os
import re
from dataclasses import replace

from pyspark.sql import functions as F

from treeq.errors import TreeqError
from treeq.forest import Forest
from treeq.operators.scopes import ScopeGraph
from treeq.plans.arrays import packed

#: What aspects see of a node.
USED = ("pre", "hi", "depth", "parent", "field", "kind", "text")


class Aspects:
    """Functions by kind and aspect. ``@aspects("Call", "sg_gen")`` adds one."""

    def __init__(self) -> None:
        self.by_kind: dict[tuple[str, str], object] = {}

    def __call__(self, kind: str, name: str):
        def add(function):
            if getattr(function, "__aspect__", None):
                raise TreeqError("a function has one aspect", "MultipleDecorators")
            function.__aspect__ = kind, name
            self.by_kind[kind, name] = function
            return function

        return add

    def names(self) -> set[str]:
        return {name for _, name in self.by_kind}


class Node:
    """A node as an aspect sees it."""

    def __init__(self, rows: list[dict], below: dict[int, list[int]], pre: int):
        self._rows, self._below, self._pre = rows, below, pre

    @property
    def pre(self) -> int:
        return self._pre

    @property
    def kind(self) -> str:
        return self._rows[self._pre]["kind"]

    @property
    def text(self) -> str:
        return self._rows[self._pre]["text"]

    @property
    def children(self) -> list[Node]:
        return [Node(self._rows, self._below, p) for p in self._below.get(self._pre, ())]

    def __getattr__(self, name: str) -> Node:
        for p in self._below.get(self._pre, ()):
            if self._rows[p]["field"] == name:
                return Node(self._rows, self._below, p)
        raise KeyError(name)


class Scope:
    def __init__(self, graph: ScopeGraph, at: int):
        self.graph, self.at = graph, at

    def add_decl(self, name: str, node: Node) -> None:
        self.graph.add_decl(self.at, name, node.pre)

    def add_ref(self, name: str, node: Node) -> None:
        self.graph.add_ref(self.at, name, node.pre)

    def add_scope(self) -> Scope:
        return Scope(self.graph, self.graph.add_scope(self.at))

    def lookup(self, name: str) -> list[int]:
        return self.graph.lookup(self.at, name)


class regex:
    """``re`` as scripts have it: ``match`` finds the pattern anywhere."""

    @staticmethod
    def compile(pattern: str):
        compiled = re.compile(pattern)
        return type("Pattern", (), {"match": staticmethod(compiled.search)})


class Script:
    """A script of aspects. ``@Call.sg_gen()`` above a function gives a kind its aspect;
    all other functions can be called by name. Scripts have ``path``, ``os``, ``re`` and ``yaml``."""

    def __init__(self, text: str):
        self.aspects = Aspects()
        module, marked = ast.parse(text), []
        for f in module.body:
            own = [d for d in getattr(f, "decorator_list", ()) if self.mark(d)]
            if len(own) > 1:
                raise TreeqError(f"{f.name} has several aspects", "MultipleDecorators")
            if own:
                marked.append((f.name, *self.mark(own[0])))
                f.decorator_list.remove(own[0])
        self.names = {"__name__": "script", "path": os.path, "os": os, "re": regex, "yaml": yaml_reader()}
        exec(compile(module, "<script>", "exec"), self.names)
        for name, kind, aspect in marked:
            self.aspects(kind, aspect)(self.names[name])

    @staticmethod
    def mark(d: ast.expr) -> tuple[str, str] | None:
        """The kind and the aspect of a decorator ``Kind.aspect()``."""
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name):
            return d.func.value.id, d.func.attr
        return None

    def call(self, name: str, *args):
        if not callable(self.names.get(name)):
            raise TreeqError(f"no function {name}", "UnknownFunction")
        return self.names[name](*args)


def yaml_reader():
    """``load`` of an open file and ``loads`` of a text."""

    class reader:
        @staticmethod
        def loads(text: str):
            import yaml

            return yaml.safe_load(text)

        load = staticmethod(lambda file: reader.loads(file.read()))

    return reader


def resolve(forest: Forest, aspects: Aspects) -> Forest:
    """The forest with the references that its ``sg_gen`` aspects make.

    A tree's aspects run bottom-up over its nodes and share one scope below the root;
    trees are independent, so each is one group.
    """
    by_kind = {k: f for (k, name), f in aspects.by_kind.items() if name == "sg_gen"}

    def one(rows: list[dict]) -> list[tuple[int, int | None]]:
        below: dict[int, list[int]] = {}
        for r in rows:
            if r["parent"] is not None:
                below.setdefault(r["parent"], []).append(r["pre"])
        graph = ScopeGraph()
        scope = Scope(graph, graph.add_scope(0))
        for r in sorted(rows, key=lambda r: r["hi"] - r["depth"]):
            if f := by_kind.get(r["kind"]):
                f(Node(rows, below, r["pre"]), scope)
        return graph.solve()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: tuple[list, list, list] = [], [], []
            for i in range(batch.num_rows):  # a tree at a time, so that only one is Python objects
                tree = batch.column("tree")[i].as_py()
                for ref, decl in one(batch.column("nodes")[i].as_py()):
                    for column, x in zip(out, (tree, ref, decl)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["tree", "ref", "decl"])

    # in a row, trees go to Python many at a time; a group each would start Python's machinery anew
    rows = packed(forest).rows.select("tree", F.transform("nodes", lambda x: F.struct(*[x[c].alias(c) for c in USED])).alias("nodes"))
    return replace(forest, refs=rows.mapInArrow(run, "tree bigint, ref bigint, decl bigint"))
