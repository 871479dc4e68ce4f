"""Queries over forests whose trees are rows: a tree's nodes as one array.

An axis is a part of the array and a quantifier a higher-order function over it, so a query has no join and no
exchange: it runs on streams as it is, and suits forests of many small trees. A tree
must fit a row; work grows with a tree's size times what its axes cover. For large trees, and
for conditions that filter much before they reach an axis, the row form (``plans.compiler``) is the one to choose.

Places count from 0 without gaps, so the node at place ``p`` is the array's ``p``-th element, and a subtree is a
slice. Meaning is that of the row form: what a strict forest raises on, raises here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeq import language as L
from treeq.errors import CompileError
from treeq.forest import NODE, Forest
from treeq.functions import text as fn
from treeq.plans.compiler import FAR, GENERATORS, bounds
from treeq.syntax import Syntax

OWN = [c for c in NODE if c != "tree"]
#: A row of the array form.
ROW = "tree bigint, nodes array<struct<" + ", ".join(f"{c}: {NODE[c]}" for c in OWN) + ">>"


@dataclass(frozen=True)
class Value:
    """``kind`` is one of node, list, bool, int, kind, string, null. ``col`` is a node's struct, or null for none; a list's is an array of these."""

    kind: str
    col: Column
    nullable: bool = False
    kinds: tuple[str, ...] | None = None
    axis: str = "children"
    #: Conditions, with messages, that use of the value raises without.
    checks: tuple[tuple[Column, str], ...] = ()


@dataclass
class Compiler:
    syntax: Syntax
    strict: bool
    nodes: Column
    names: dict[str, Value] = field(default_factory=dict)

    # nodes and axes

    def at(self, place: Column) -> Column:
        """The node at a place; none for a null place."""
        return F.get(self.nodes, place.cast("int"))

    def below(self, n: Column) -> Column:
        return F.slice(self.nodes, n["pre"].cast("int") + 2, (n["hi"] - n["pre"]).cast("int"))

    def family(self, n: Column) -> Column:
        """The children of the node's parent."""
        return self.children(self.at(n["parent"]))

    def children(self, n: Column) -> Column:
        return F.filter(self.below(n), lambda c: c["parent"] == n["pre"])

    def axis(self, n: Column, axis: str, least: int, most: int) -> Column:
        least = max(1, least)
        near = lambda steps: (steps >= least) & (steps <= most)
        if axis == "descendants":
            return F.filter(self.below(n), lambda x: near(x["depth"] - n["depth"]))
        if axis == "parents":
            return F.filter(F.slice(self.nodes, 1, n["pre"].cast("int")), lambda x: (x["hi"] >= n["pre"]) & near(n["depth"] - x["depth"]))
        steps = {"previous_siblings": lambda x: n["ord"] - x["ord"], "next_siblings": lambda x: x["ord"] - n["ord"], "siblings": lambda x: F.abs(x["ord"] - n["ord"])}[axis]
        again = (lambda x: near(steps(x)) | ((x["ord"] == n["ord"]) & (self.at(n["parent"])["n"] >= 2))) if axis == "siblings" and least <= 2 <= most else lambda x: near(steps(x))
        return F.coalesce(F.filter(self.family(n), again), F.array().cast(f"array<struct<{', '.join(f'{c}: {NODE[c]}' for c in OWN)}>>"))

    # checks

    def raising(self, message: str, kind: str, lenient: Column) -> Column:
        return F.raise_error(F.lit(message)).cast(kind) if self.strict else lenient

    def guarded(self, v: Value, col: Column) -> Column:
        for ok, message in reversed(v.checks) if self.strict else ():
            col = F.when(ok, col).otherwise(F.raise_error(F.lit(message)))
        return col

    # patterns

    def kinds_of(self, pattern: L.NodePattern) -> tuple[str, ...] | None:
        if any(o.kind is None for o in pattern.options):
            return None
        return tuple(sorted({k for o in pattern.options for k in self.syntax.closure(o.kind)}))

    def fits(self, n: Column, pattern: L.QueryPattern) -> Column:
        options = []
        for o in pattern.node.options:
            ok = n.isNotNull() if o.kind is None else F.coalesce(n["kind"].isin(*self.syntax.closure(o.kind)), F.lit(False))
            for f in o.fields:
                ok = then(ok, self.field_fits(n, f))
            options.append(ok)
        found = reduce(lambda a, b: a | b, options)
        if pattern.when is None:
            return found
        inside = dict(self.names)
        if pattern.node.name:
            inside[pattern.node.name] = Value("node", n, kinds=self.kinds_of(pattern.node))
        return then(found, replace(self, names=inside).bool(pattern.when))

    def field_fits(self, n: Column, f: L.FieldPattern) -> Column:
        if isinstance(f.at, int):
            child = F.get(self.children(n), F.lit(f.at))
            checks = ((child.isNotNull(), f"IndexError: no child {f.at}"),)
        else:
            child, checks = self.field(n, f.at), ()
        fits = F.coalesce(child["text"] == f.value, F.lit(False)) if isinstance(f.value, str) else self.fits(child, f.value)
        return self.guarded(Value("node", child, checks=checks), fits)

    def field(self, n: Column, name: str) -> Column:
        if name not in self.syntax.fields:
            raise CompileError(f"no kind has a field {name}", "InvalidPropertyName")
        return F.get(F.filter(self.below(n), lambda c: (c["parent"] == n["pre"]) & (c["field"] == name)), F.lit(0))

    # expressions

    def bool(self, x) -> Column:
        v = self.value(x)
        if v.kind != "bool":
            raise CompileError(f"a condition can't be a {v.kind}", "InvalidKind")
        return v.col

    def value(self, x) -> Value:
        return getattr(self, "_" + type(x).__name__.lower())(x)

    def _name(self, x: L.Name) -> Value:
        if x.text not in self.names:
            raise CompileError(f"unknown name {x.text}", "UnknownIdentifier")
        return self.names[x.text]

    def _literal(self, x: L.Literal) -> Value:
        if x.value is None:
            return Value("null", F.lit(None), True)
        return Value("int", F.lit(x.value).cast("long")) if isinstance(x.value, int) else Value("string", F.lit(x.value))

    def _not(self, x: L.Not) -> Value:
        return Value("bool", ~self.bool(x.of))

    def _is(self, x: L.Is) -> Value:
        v = self.value(x.of)
        if v.kind == "null":
            return Value("bool", F.lit(False))
        if v.kind != "node":
            raise CompileError(f"a {v.kind} has no kind", "InvalidKind")
        return Value("bool", self.guarded(v, F.coalesce(self.fits(v.col, x.pattern), F.lit(False))))

    def _quantified(self, q: L.Quantified) -> Value:
        v = self.value(q.of)
        if v.kind == "node":
            ok = F.coalesce(v.col["kind"] == "List", F.lit(False))
            v = replace(v, kind="list", col=self.children(v.col), checks=(*v.checks, (ok, "InvalidKind: only lists have elements")))
        if v.kind != "list":
            raise CompileError(f"a {v.kind} has no elements", "InvalidKind")
        over = F.forall if q.kind == "all" else F.exists
        found = F.coalesce(over(v.col, lambda x: F.coalesce(self.fits(x, q.pattern), F.lit(False))), F.lit(q.kind == "all"))
        return Value("bool", self.guarded(v, ~found if q.kind == "no" else found))

    def _binary(self, x: L.Binary) -> Value:
        if x.op == "&&":
            return Value("bool", then(self.bool(x.left), self.bool(x.right)))
        if x.op == "||":
            return Value("bool", F.when(self.bool(x.left), F.lit(True)).otherwise(self.bool(x.right)))
        a, b = self.value(x.left), self.value(x.right)
        if x.op in ("==", "!="):
            same = self.equal(a, b)
            return Value("bool", same if x.op == "==" else ~same)
        if a.kind != b.kind or a.kind not in ("int", "string"):
            raise CompileError(f"{x.op} can't compare {a.kind} and {b.kind}", "InvalidKind")
        less = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[x.op]
        return Value("bool", F.coalesce(less, self.raising(f"InvalidKind: {x.op} can't compare null", "boolean", F.lit(False))))

    def scalar(self, v: Value) -> Column:
        return self.guarded(v, v.col["pre"]) if v.kind == "node" else v.col

    def equal(self, a: Value, b: Value) -> Column:
        if "list" in (a.kind, b.kind):
            if a.kind == b.kind:
                raise CompileError("lists can't be compared", "InvalidKind")
            return F.lit(False)
        if {a.kind, b.kind} == {"node", "string"}:
            node, other = (a, b) if a.kind == "node" else (b, a)
            return self.guarded(node, node.col["text"].eqNullSafe(other.col))
        if a.kind == b.kind != "null":
            return self.scalar(a).eqNullSafe(self.scalar(b))
        missing = lambda v: F.lit(True) if v.kind == "null" else self.scalar(v).isNull() if v.nullable else F.lit(False)
        return missing(a) & missing(b)

    def node(self, x, what: str, safe: bool) -> Value:
        v = self.value(x)
        if v.kind != "node":
            raise CompileError(f"a {v.kind} has no {what}", "InvalidKind")
        return v if safe or not v.nullable else replace(v, checks=(*v.checks, (v.col.isNotNull(), f"InvalidKind: null has no {what}")))

    def _access(self, x: L.Access) -> Value:
        if x.name == "length":
            return self.length(x)
        v = self.node(x.of, x.name, x.safe)
        n = v.col
        if x.name in ("kind", "text"):
            return Value("kind" if x.name == "kind" else "string", self.guarded(v, n[x.name]), v.nullable)
        if x.name == "children":
            return Value("list", self.children(n), v.nullable, checks=v.checks)
        checks = v.checks
        if x.name == "parent":
            found = self.at(n["parent"])
        elif x.name == "next_sibling":
            after = self.at(n["hi"] + 1)
            found = F.when(after["parent"] == n["parent"], after)
        elif x.name == "previous_sibling":
            found = F.get(F.filter(self.family(n), lambda s: s["ord"] == n["ord"] - 1), F.lit(0))
        else:
            found, having = self.field(n, x.name), self.syntax.with_field(x.name)
            if v.kinds is None or not set(v.kinds) <= set(having):
                ok = n["kind"].isin(*having)
                checks = (*checks, (n.isNull() | ok if v.nullable else ok, f"InvalidField: {x.name}"))
        return Value("node", found, True, checks=checks)

    def _index(self, x: L.Index) -> Value:
        v, i = self.value(x.of), self.value(x.at)
        if i.kind != "int":
            raise CompileError(f"an index can't be a {i.kind}", "InvalidKind")
        if v.kind not in ("list", "node"):
            raise CompileError(f"a {v.kind} has no elements", "InvalidKind")
        if v.axis != "children":
            raise CompileError("only children have places", "IndexError")
        found = F.get(v.col if v.kind == "list" else self.children(v.col), i.col.cast("int"))
        return Value("node", found, True, checks=(*v.checks, (found.isNotNull(), "IndexError: no such element")))

    def length(self, x: L.Access) -> Value:
        v = self.value(x.of)
        if v.kind == "string":
            lenient = F.lit(None).cast("long")
            missing = lenient if x.safe or not v.nullable else self.raising("InvalidKind: null has no length", "long", lenient)
            return Value("int", F.when(v.col.isNull(), missing).otherwise(fn.byte_length(v.col)), v.nullable)
        if v.kind == "list":
            return Value("int", self.guarded(v, F.size(v.col)).cast("long"), v.nullable)
        if v.kind == "node":
            v = self.node(x.of, "length", x.safe)
            ok = F.coalesce(v.col["kind"] == "List", F.lit(v.nullable))
            v = replace(v, checks=(*v.checks, (ok, "InvalidKind: only lists have a length")))
            return Value("int", self.guarded(v, v.col["n"]).cast("long"), v.nullable)
        raise CompileError(f"a {v.kind} has no length", "InvalidKind")

    def _call(self, x: L.Call) -> Value:
        if x.name == "matches":
            if len(x.args) != 1:
                raise CompileError("matches takes one argument", "UnexpectedArity")
            pattern, v = x.args[0][1], self.value(x.of)
            if not (isinstance(pattern, L.Literal) and pattern.regex):
                raise CompileError("matches takes a regular expression", "UnexpectedArg")
            if v.kind != "string":
                raise CompileError(f"a {v.kind} can't match", "InvalidKind")
            missing = F.lit(False) if x.safe or not v.nullable else self.raising("InvalidKind: null can't match", "boolean", F.lit(False))
            return Value("bool", F.coalesce(fn.matches(v.col, pattern.value), missing))
        if x.name == "to_int":
            v = self.value(x.of)
            if x.args:
                raise CompileError("to_int takes no argument", "UnexpectedArity")
            if v.kind not in ("int", "string"):
                raise CompileError(f"a {v.kind} is no number", "InvalidKind")
            return v if v.kind == "int" else Value("int", fn.to_int(v.col, self.strict), True)
        if x.name == "referenced_decls":
            raise CompileError("references are joined: use the row form", "NameRes")
        v = self.node(x.of, x.name, x.safe)
        if x.name not in GENERATORS:
            raise CompileError(f"unknown method {x.name}", "InvalidPropertyName")
        least, most = bounds(x.args)
        return Value("list", self.axis(v.col, x.name, least, min(most, FAR)), v.nullable, axis=x.name, checks=v.checks)


def then(a: Column, b: Column) -> Column:
    return F.when(a, b).otherwise(F.lit(False))


@dataclass(frozen=True)
class Trees:
    """A forest in array form: ``rows`` has ``tree`` and ``nodes``, in order of ``pre``."""

    rows: DataFrame
    syntax: Syntax
    strict: bool = True

    def query(self, text: str) -> DataFrame:
        """The nodes that match, as rows like those of ``Forest.query``."""
        pattern = L.parse_query(text)
        compiler = Compiler(self.syntax, self.strict, F.col("nodes"))
        found: Callable[[Column], Column] = lambda n: F.coalesce(compiler.fits(n, pattern), F.lit(False))
        hits = self.rows.select("tree", F.explode(F.filter("nodes", found)).alias("x"))
        return hits.select("tree", *[F.col(f"x.{c}").alias(c) for c in OWN])


def packed(forest: Forest) -> Trees:
    """A forest's array form: each tree's nodes are gathered into its row, so trees must be small."""
    own = F.struct(*OWN)
    rows = forest.nodes.groupBy("tree").agg(F.array_sort(F.collect_list(own)).alias("nodes"))
    return Trees(rows, forest.syntax, forest.strict)
