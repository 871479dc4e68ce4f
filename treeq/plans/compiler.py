"""Queries to DataFrame plans.

Every node that an expression names is a set of columns with one prefix. An axis from
a node is a left join that adds the next set; the same axis from the same node is
joined once. Conditions are columns over those sets. Quantifiers are semi and anti
joins where they stand as a condition of their own, and existence flags below ``||``
or ``!``. What a pattern doesn't refer to is never part of its join: a pattern that
names nothing from outside is filtered before it meets the outer nodes.

Types are known while compiling, so comparisons and checks are chosen here. A strict
forest raises where the language says that evaluation fails; otherwise such a condition
is false. What a left side, a pattern's kinds and fields or an axis exclude raises
nothing: a condition that can raise holds these in one expression with itself, in a form
that the optimizer neither splits nor moves below the joins that it needs.
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

#: Axes from a node to those above and below it meet in bins of so many places of a tree.
#: A node lies in one bin, and its subtree covers as many as it has nodes over the width, and one.
BIN = 128
#: The most places that a bin has where they are bits of a row.
BITS = 128
GENERATORS = ("parents", "descendants", "siblings", "previous_siblings", "next_siblings")
FAR = 1 << 30
#: Methods that extensions add: name to a function of the plan, the value and the arguments.
METHODS: dict[str, Callable[[Plan, Value, tuple], Value]] = {}


@dataclass(frozen=True)
class Ref:
    """A node: the prefix of its columns, whether it can be missing, which kinds it can
    have if known, and the checks that its use must pass. One that a join added shares the tree
    of the node in ``home``, whose column the rows are dealt out by."""

    at: str
    nullable: bool = False
    kinds: tuple[str, ...] | None = None
    checks: tuple[tuple[Column, str], ...] = ()
    home: str | None = None

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.home if name == 'tree' and self.home else self.at}_{name}")

    @property
    def present(self) -> Column:
        return self["pre"].isNotNull()


@dataclass(frozen=True)
class Nodes:
    """A list of nodes: an axis from a node, by bounds on the number of steps."""

    of: Ref
    axis: str
    least: int = 1
    most: int = FAR


@dataclass(frozen=True)
class Value:
    """``kind`` is one of node, list, bool, int, kind, string, null."""

    kind: str
    col: Column | None = None
    node: Ref | None = None
    nodes: Nodes | None = None
    nullable: bool = False


@dataclass
class Batch:
    """Quantifiers over one axis from one node: what they ask of its nodes, decided in one plan and joined once."""

    nodes: Nodes
    x: Ref
    plan: Plan
    asks: list[Column] = field(default_factory=list)
    kinds: set[str] | None = field(default_factory=set)


@dataclass
class Plan:
    forest: Forest
    df: DataFrame
    names: dict[str, Ref]
    keys: list[str]  # prefixes that tell the rows of ``df`` apart
    joined: dict[tuple, str] = field(default_factory=dict)
    made: list[int] = field(default_factory=lambda: [0])
    #: How many conditions that can raise were compiled, in this plan and those inside it.
    raises: list[int] = field(default_factory=lambda: [0])
    #: What must hold before a condition of a filter or of a flag is looked at.
    guard: Column | None = None
    only: Column | None = None
    #: Flags that wait for their join, by node and axis; None if each quantifier gets a join of its own.
    batches: dict[tuple, Batch] | None = None
    #: How many joins were made for one quantifier or count only.
    alone: list[int] = field(default_factory=lambda: [0])

    # joins

    def fresh(self, hint: str = "v") -> str:
        self.made[0] += 1
        return f"{hint}{self.made[0]}"

    def named(self, at: str) -> DataFrame:
        return self.forest.nodes.select(*[F.col(c).alias(f"{at}_{c}") for c in NODE])

    def left(self, n: Ref, key: tuple, condition, only: Column | None = None) -> Ref:
        """The node that a left join adds, joined once for each node and key."""
        key = n.at, *key
        if key not in self.joined:
            at = self.fresh()
            right = self.named(at)
            if only is not None:
                right = right.filter(only_at(at, only))
            self.df = self.df.join(self.forest.side(right), condition(Ref(at)), "left")
            self.joined[key] = at
        return Ref(self.joined[key], True, home=n.home or n.at)

    def parent(self, n: Ref) -> Ref:
        return self.left(n, ("parent",), lambda p: (p["tree"] == n["tree"]) & (p["pre"] == n["parent"]))

    def sibling(self, n: Ref, step: int) -> Ref:
        same = lambda s: (s["tree"] == n["tree"]) & (s["parent"] == n["parent"]) & (s["ord"] == n["ord"] + step)
        return self.left(n, ("sibling", step), same)

    def child(self, n: Ref, place: Column, key) -> Ref:
        return self.left(n, ("child", key), lambda c: (c["tree"] == n["tree"]) & (c["parent"] == n["pre"]) & (c["ord"] == place))

    def field(self, n: Ref, name: str) -> Ref:
        if name not in self.forest.syntax.fields:
            raise CompileError(f"no kind has a field {name}", "InvalidPropertyName")
        below = lambda c: (c["tree"] == n["tree"]) & (c["parent"] == n["pre"])
        return self.left(n, ("field", name), below, only=F.lit(name))

    # conditions

    def guarded(self, ref: Ref | None, col: Column) -> Column:
        """The column, or an error if the node's checks fail where the forest is strict."""
        for ok, message in reversed(ref.checks) if ref and self.forest.strict else ():
            self.raises[0] += 1
            col = F.when(ok, col).otherwise(F.raise_error(F.lit(message)))
        return col

    def checked(self, ref: Ref, ok: Column, message: str) -> Ref:
        return replace(ref, checks=(*ref.checks, (ok, message)))

    def keep(self, condition: Column) -> None:
        """Filters the rows by a condition whose joins are in the plan by now."""
        self.df = self.df.filter(condition if self.guard is None else both(self.guard, condition, True))

    def raising(self, compile) -> bool:
        """Whether what ``compile`` does to a copy of this plan can raise."""
        if not self.forest.strict:
            return False
        before = self.raises[0]
        compile(replace(self, names=dict(self.names), joined=dict(self.joined)))
        found = self.raises[0] > before
        self.raises[0] = before
        return found

    def guarding(self, condition: Column) -> None:
        """Keeps the rows for which the condition holds, and looks at nothing else before."""
        self.keep(condition)
        self.guard = condition if self.guard is None else both(self.guard, condition, True)

    def where(self, x) -> None:
        """Keeps the rows for which the expression holds."""
        if isinstance(x, L.Binary) and x.op == "&&":
            if self.raising(lambda plan: plan.where(x.right)):
                self.guarding(self.bool(x.left))
            else:
                self.where(x.left)
            self.where(x.right)
        elif isinstance(x, L.Quantified):
            self.quantified(x, True)
        elif isinstance(x, L.Not) and isinstance(x.of, L.Quantified):
            opposite = {"any": "no", "no": "any"}.get(x.of.kind)
            if opposite:
                self.quantified(replace(x.of, kind=opposite), True)
            else:
                self.keep(~self.bool(x.of))
        else:
            self.keep(self.bool(x))

    def where_pattern(self, ref: Ref, pattern: L.QueryPattern) -> None:
        """Keeps the rows whose node fits the pattern, kinds first."""
        kinds = self.kinds_of(pattern.node)
        if kinds is not None:
            self.keep(ref["kind"].isin(*kinds))
        ref = replace(ref, kinds=kinds)
        outer = dict(self.names)
        if pattern.node.name:
            self.names[pattern.node.name] = ref
        if any(o.fields for o in pattern.node.options):
            named, self.names = self.names, outer
            fields = self.fits(ref, L.QueryPattern(replace(pattern.node, name=None), None))
            self.names = named
            if pattern.when is not None and self.raising(lambda plan: plan.where(pattern.when)):
                self.guarding(fields)
            else:
                self.keep(fields)
        if pattern.when is not None:
            self.where(pattern.when)

    def kinds_of(self, pattern: L.NodePattern) -> tuple[str, ...] | None:
        if any(o.kind is None for o in pattern.options):
            return None
        return tuple(sorted({k for o in pattern.options for k in self.forest.syntax.closure(o.kind)}))

    def fits(self, ref: Ref, pattern: L.QueryPattern) -> Column:
        """Whether the node is there and fits the pattern."""
        options = []
        for o in pattern.node.options:
            ok = ref.present if o.kind is None else F.coalesce(ref["kind"].isin(*self.forest.syntax.closure(o.kind)), F.lit(False))
            for f in o.fields:
                ok = self.then(ok, lambda: self.field_fits(ref, f))
            options.append(ok)
        found = reduce(lambda a, b: a | b, options)
        if pattern.when is not None or pattern.node.name:
            outer = dict(self.names)
            if pattern.node.name:
                self.names[pattern.node.name] = replace(ref, nullable=False, checks=(), kinds=self.kinds_of(pattern.node))
            if pattern.when is not None:
                found = self.then(found, lambda: self.bool(pattern.when))
            self.names = outer
        return found

    def then(self, first: Column, compile) -> Column:
        """Both ``first`` and what ``compile`` gives, which is looked at only where ``first`` holds."""
        before = self.raises[0]
        second = self.where_only(first, compile)
        return both(first, second, self.raises[0] > before)

    def where_only(self, holds: Column, compile) -> Column:
        """What ``compile`` gives, where flags need only be right for rows that ``holds``."""
        only = self.only
        self.only = holds if only is None else both(only, holds, True)
        found = compile()
        self.only = only
        return found

    def field_fits(self, ref: Ref, f: L.FieldPattern) -> Column:
        if isinstance(f.at, int):
            child = self.child(ref, F.lit(f.at), f.at)
            child = self.checked(child, child.present, f"IndexError: no child {f.at}")
        else:
            child = self.field(ref, f.at)
        if isinstance(f.value, str):
            found = F.coalesce(child["text"] == f.value, F.lit(False))
        else:
            found = self.fits(child, f.value)
        return self.guarded(child, found)

    # quantifiers

    def steps(self, n: Ref, x: Ref, axis: Nodes) -> Column | None:
        """Whether ``x`` is as many steps from ``n`` as the axis takes."""
        least = max(1, axis.least)
        place = {"parents": ("depth", -1), "descendants": ("depth", 1), "previous_siblings": ("ord", -1), "next_siblings": ("ord", 1)}.get(axis.axis)
        if place and axis.most == least:
            return x[place[0]] == n[place[0]] + place[1] * least  # a key of the join
        steps = F.abs(x["ord"] - n["ord"]) if axis.axis == "siblings" else place and (x[place[0]] - n[place[0]]) * place[1]
        return None if steps is None else (steps >= least) if axis.most == FAR else steps.between(least, axis.most)

    def covered(self, n: Ref, width: int) -> Column:
        """The bins that a node's subtree below it covers, a row for each."""
        return F.explode(F.when(n["hi"] > n["pre"], F.sequence(F.floor((n["pre"] + 1) / width), F.floor(n["hi"] / width))))

    def related(self, n: Ref, x: Ref, axis: Nodes) -> Column:
        """The join condition of ``x`` being on the axis from ``n``."""
        same = x["tree"] == n["tree"]
        near = self.steps(n, x, axis)
        if axis.axis == "children" or axis.axis == "descendants" and axis.most == 1:
            return same & (x["parent"] == n["pre"]) & F.lit(axis.least <= axis.most)
        if axis.axis == "parents" and axis.most == 1:
            return same & (x["pre"] == n["parent"]) & F.lit(axis.least <= axis.most)
        if axis.axis == "parents":
            place = (x["pre"] < n["pre"]) & (n["pre"] <= x["hi"])
        elif axis.axis == "descendants":
            place = (x["pre"] > n["pre"]) & (x["pre"] <= n["hi"])
        else:
            place = x["parent"] == n["parent"]
        if axis.axis == "siblings" and axis.least <= 2 <= axis.most:
            # the walk meets its origin again two steps on, if there is anyone to turn at
            others = self.parent(n)["n"] >= 2
            near = near | ((x["ord"] == n["ord"]) & others)
        return same & place & near

    def meeting(self, left: DataFrame, n: Ref, right: DataFrame, x: Ref, axis: Nodes) -> tuple[DataFrame, DataFrame, Column]:
        """Both sides and the condition under which ``x`` is on the axis from ``n``.

        Above and below, the sides meet on the tree and a bin of its places, so a large tree is dealt out
        over many tasks, and a node is compared with what shares or covers its bin. The
        side above has a row for each bin that it covers; a pair meets in one of them.
        """
        condition = self.related(n, x, axis)
        if axis.axis not in ("parents", "descendants") or axis.most <= 1:
            return left, right, condition
        at = self.fresh("bin")
        place = lambda col: F.floor(col / BIN)
        if axis.axis == "descendants":
            left, right = left.withColumn(f"{at}_n", self.covered(n, BIN)), right.withColumn(f"{at}_x", place(x["pre"]))
        else:
            left, right = left.withColumn(f"{at}_n", place(n["pre"])), right.withColumn(f"{at}_x", self.covered(x, BIN))
        return left, right, (F.col(f"{at}_n") == F.col(f"{at}_x")) & condition

    def quantified(self, q: L.Quantified, filters: bool) -> Column | None:
        """Filters the rows, or gives a flag column, by what the quantifier says."""
        nodes, own = self.list_of(q.of), q.pattern.node.name
        n = nodes.of
        if not filters and self.batches is not None:
            flag = self.batched(q, nodes)
            if flag is not None:
                return flag
        self.alone[0] += 1
        if filters and n.checks and self.forest.strict:
            self.keep(self.guarded(n, F.lit(True)))
        outer = {name for name in L.names_in(q.pattern) if name in self.names and name != own}
        at = self.fresh()
        x = Ref(at, False, self.kinds_of(q.pattern.node))
        inside = dict(self.names)
        if own:
            inside[own] = x
        condition = None if nodes.axis == "referenced_decls" else self.related(n, x, nodes)
        alone = Plan(self.forest, self.named(at), inside, [at], {}, self.made, self.raises)
        # what can raise is looked at for nodes on the axis only
        if outer or condition is None or alone.raising(lambda plan: plan.select(x, q)):
            keys = [(f"{k}_{c}", f"{at}k{i}{c}") for i, k in enumerate(self.keys) for c in ("tree", "pre")]
            start = self.df if self.only is None else self.df.filter(self.only)
            if condition is None:
                refs = self.refs().select(*[F.col(c).alias(f"{at}r_{c}") for c in ("tree", "ref", "decl")])
                leads = (F.col(f"{at}r_tree") == n["tree"]) & (F.col(f"{at}r_ref") == n["pre"])
                start = start.join(self.forest.side(refs), leads)
                condition = (x["tree"] == F.col(f"{at}r_tree")) & (x["pre"] == F.col(f"{at}r_decl"))
                joined = start.join(self.forest.side(self.named(at)), condition)
            else:
                start, other, meets = self.meeting(start, n, self.named(at), x, nodes)
                joined = start.join(self.forest.side(other), meets)
            inner = Plan(self.forest, joined, inside, [*self.keys, at], dict(self.joined), self.made, self.raises)
            if inner.raising(lambda plan: plan.select(x, q)):
                inner.guard = condition
            inner.select(x, q)
            found = inner.df.select(*[F.col(a).alias(b) for a, b in keys])
            meets = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in keys])
            flag_keys = [b for _, b in keys]
        else:
            alone.select(x, q)
            found = alone.df.select(*[f"{at}_{c}" for c in NODE])
            by_parent = nodes.axis == "children" or nodes.axis == "descendants" and nodes.most == 1 >= nodes.least
            flag_keys = [f"{at}_tree", f"{at}_parent"] if by_parent else None
            if nodes.axis in ("next_siblings", "previous_siblings") and nodes.most == FAR:
                # the last or first of a family's nodes that fit stands for all of them
                end, least = (F.max if nodes.axis == "next_siblings" else F.min), max(1, nodes.least)
                found = found.groupBy(f"{at}_tree", f"{at}_parent").agg(end(f"{at}_ord").alias(f"{at}_ord"))
                meets = (x["tree"] == n["tree"]) & (x["parent"] == n["parent"])
                meets = meets & (x["ord"] >= n["ord"] + least if nodes.axis == "next_siblings" else x["ord"] <= n["ord"] - least)
                left = self.df
            elif by_parent and filters:
                # parents of nodes that fit, so that a large family meets its parent as one row
                found, left, meets = found.select(*flag_keys).distinct(), self.df, self.related(n, x, nodes)
            else:
                left, found, meets = self.meeting(self.df, n, found, x, nodes)
            if left is not self.df and nodes.axis == "descendants":
                # rows of this plan lie in several bins: their keys come back once
                keys = [(f"{k}_{c}", f"{at}k{i}{c}") for i, k in enumerate(self.keys) for c in ("tree", "pre")]
                found = left.join(self.forest.side(found), meets, "left_semi").select(*[F.col(a).alias(b) for a, b in keys])
                meets = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in keys])
                flag_keys = [b for _, b in keys]
                left = self.df
            if filters:
                self.df = left.join(self.forest.side(found), meets, "left_semi" if q.kind == "any" else "left_anti")
                return None
            if flag_keys is None:
                # which rows of this plan have a match, by their keys
                rows = left.join(self.forest.side(found), meets, "left_semi")
                keys = [(f"{k}_{c}", f"{at}k{i}{c}") for i, k in enumerate(self.keys) for c in ("tree", "pre")]
                found = rows.select(*[F.col(a).alias(b) for a, b in keys])
                meets = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in keys])
                flag_keys = [b for _, b in keys]
        if filters:
            self.df = self.df.join(self.forest.side(found), meets, "left_semi" if q.kind == "any" else "left_anti")
            return None
        # a count, as the optimizer would see through a literal and drop what the flag guards
        flags = found.groupBy(*flag_keys).agg(F.count("*").alias(f"{at}_any"))
        self.df = self.df.join(self.forest.side(flags), meets, "left")
        flag = F.coalesce(F.col(f"{at}_any"), F.lit(0)) > 0
        return self.guarded(n, flag if q.kind == "any" else ~flag)

    def batched(self, q: L.Quantified, nodes: Nodes) -> Column | None:
        """The flag of a quantifier that shares its join, unless it names something outside or can raise."""
        own = q.pattern.node.name
        if nodes.axis == "referenced_decls" or any(name in self.names and name != own for name in L.names_in(q.pattern)):
            return None
        key = nodes.of.at, nodes.axis, nodes.least, nodes.most
        if key not in self.batches:
            at = self.fresh("s")
            plan = Plan(self.forest, self.named(at), {}, [at], {}, self.made, self.raises, batches={}, alone=self.alone)
            self.batches[key] = Batch(nodes, Ref(at), plan)
        batch, before = self.batches[key], self.raises[0]
        asked = F.coalesce(batch.plan.fits(batch.x, q.pattern), F.lit(False))
        if self.raises[0] > before:
            self.alone[0] += 1  # for the rule; what was compiled here is of no use
            return F.lit(False)
        batch.asks.append(~asked if q.kind == "all" else asked)
        kinds = None if q.kind == "all" else self.kinds_of(q.pattern.node)
        batch.kinds = None if kinds is None or batch.kinds is None else batch.kinds | set(kinds)
        i, at = len(batch.asks) - 1, batch.x.at
        if nodes.axis in ("next_siblings", "previous_siblings") and nodes.most == FAR:
            # the last or first of a family's nodes that fit tells for each of its members
            reach = F.col(f"{at}_any{i}")
            flag = reach >= nodes.of["ord"] + max(1, nodes.least) if nodes.axis == "next_siblings" else reach <= nodes.of["ord"] - max(1, nodes.least)
            flag = F.coalesce(flag, F.lit(False))
        else:
            flag = F.coalesce(F.col(f"{at}_any{i}"), F.lit(0)) > 0
        return self.guarded(nodes.of, flag if q.kind == "any" else ~flag)

    def flush(self) -> None:
        """Joins the flags of all batches: one join for a node and axis, however many conditions ask."""
        by_family = ("children", "next_siblings", "previous_siblings")
        # what pairs nodes starts from this plan, so it goes before the others join it
        for batch in sorted((self.batches or {}).values(), key=lambda b: b.nodes.axis in by_family):
            if not batch.asks:
                continue
            batch.plan.flush()
            x, nodes, n = batch.x, batch.nodes, batch.nodes.of
            found = batch.plan.df
            if batch.kinds is not None:
                found = found.filter(x["kind"].isin(*sorted(batch.kinds)))
            found = found.filter(reduce(lambda a, b: a | b, batch.asks))
            counts = [F.count_if(a).alias(f"{x.at}_any{i}") for i, a in enumerate(batch.asks)]
            family = [F.col(f"{x.at}_{c}").alias(f"{x.at}f_{c}") for c in ("tree", "parent")]
            near = (F.col(f"{x.at}f_tree") == n["tree"]) & (F.col(f"{x.at}f_parent") == n["parent"])
            if nodes.axis == "children" or nodes.axis == "descendants" and nodes.least <= 1 == nodes.most:
                found = found.groupBy(*family).agg(*counts)
                near = (F.col(f"{x.at}f_tree") == n["tree"]) & (F.col(f"{x.at}f_parent") == n["pre"])
            elif nodes.axis in ("next_siblings", "previous_siblings") and nodes.most == FAR:
                end = F.max if nodes.axis == "next_siblings" else F.min
                found = found.groupBy(*family).agg(*[end(F.when(a, x["ord"])).alias(f"{x.at}_any{i}") for i, a in enumerate(batch.asks)])
            else:
                keys = [(f"{k}_{c}", f"{x.at}k{i}{c}") for i, k in enumerate(self.keys) for c in ("tree", "pre")]
                left, right, meets = self.meeting(self.df, n, found, x, nodes)
                found = left.join(self.forest.side(right), meets).groupBy(*[F.col(a).alias(b) for a, b in keys]).agg(*counts)
                near = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in keys])
            self.df = self.df.join(self.forest.side(found), near, "left")

    def select(self, x: Ref, q: L.Quantified) -> None:
        """Keeps the nodes that decide the quantifier: for ``all``, those that don't fit."""
        if q.kind == "all":
            self.keep(~F.coalesce(self.fits(x, q.pattern), F.lit(False)))
        else:
            self.where_pattern(x, q.pattern)

    def refs(self) -> DataFrame:
        if self.forest.refs is None:
            raise CompileError("the forest has no references", "NameRes")
        return self.forest.refs

    def list_of(self, x) -> Nodes:
        v = self.value(x)
        if v.kind == "list":
            return v.nodes
        if v.kind == "node":
            is_list = F.coalesce(v.node["kind"] == "List", F.lit(False))
            return Nodes(self.checked(v.node, is_list, "InvalidKind: only lists have elements"), "children")
        raise CompileError(f"a {v.kind} has no elements", "InvalidKind")

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
        ref = self.names[x.text]
        return Value("node", node=ref, nullable=ref.nullable)

    def _literal(self, x: L.Literal) -> Value:
        if x.value is None:
            return Value("null", F.lit(None), nullable=True)
        if isinstance(x.value, int):
            return Value("int", F.lit(x.value).cast("long"))
        return Value("string", F.lit(x.value))

    def _not(self, x: L.Not) -> Value:
        if isinstance(x.of, L.Quantified) and x.of.kind in ("any", "no"):
            return Value("bool", self.quantified(replace(x.of, kind={"any": "no", "no": "any"}[x.of.kind]), False))
        return Value("bool", ~self.bool(x.of))

    def _quantified(self, x: L.Quantified) -> Value:
        return Value("bool", self.quantified(x, False))

    def _is(self, x: L.Is) -> Value:
        v = self.value(x.of)
        if v.kind == "null":
            return Value("bool", F.lit(False))
        if v.kind != "node":
            raise CompileError(f"a {v.kind} has no kind", "InvalidKind")
        return Value("bool", self.guarded(v.node, F.coalesce(self.fits(replace(v.node, checks=()), x.pattern), F.lit(False))))

    def _binary(self, x: L.Binary) -> Value:
        if x.op in ("&&", "||"):
            a = self.bool(x.left)
            if x.op == "&&":
                return Value("bool", self.then(a, lambda: self.bool(x.right)))
            return Value("bool", F.when(a, F.lit(True)).otherwise(self.where_only(~F.coalesce(a, F.lit(False)), lambda: self.bool(x.right))))
        if x.op in ("==", "!="):
            missing = self.absent(x)
            if missing is not None:
                return Value("bool", missing if x.op == "==" else ~missing)
        a, b = self.value(x.left), self.value(x.right)
        if x.op in ("==", "!="):
            same = self.equal(a, b)
            return Value("bool", same if x.op == "==" else ~same)
        if a.kind != b.kind or a.kind not in ("int", "string"):
            raise CompileError(f"{x.op} can't compare {a.kind} and {b.kind}", "InvalidKind")
        less = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[x.op]
        return Value("bool", F.coalesce(less, self.never(F.lit(False), f"InvalidKind: {x.op} can't compare null")))

    def never(self, lenient: Column, message: str) -> Column:
        self.raises[0] += self.forest.strict
        return F.raise_error(F.lit(message)).cast("boolean") if self.forest.strict else lenient

    def absent(self, x: L.Binary) -> Column | None:
        """Whether a parent or previous sibling that is compared with null is missing: the encoding tells, without a join."""
        sides = [x.left, x.right]
        null = next((s for s in sides if isinstance(s, L.Literal) and s.value is None and not s.regex), None)
        of = next((s for s in sides if isinstance(s, L.Access) and s.name in ("parent", "previous_sibling")), None)
        if null is None or of is None:
            return None
        n = self.node(of.of, of.name, of.safe)
        return self.guarded(n, n["parent"].isNull() if of.name == "parent" else ~F.coalesce(n["ord"] > 0, F.lit(False)))

    def scalar(self, v: Value) -> Column:
        """A column to compare by; for a node, its place in its tree."""
        if v.kind == "node":
            return self.guarded(v.node, F.when(v.node.present, F.struct(v.node["tree"], v.node["pre"])))
        return v.col

    def equal(self, a: Value, b: Value) -> Column:
        if "list" in (a.kind, b.kind):
            other = b if a.kind == "list" else a
            if other.kind == "list":
                raise CompileError("lists can't be compared", "InvalidKind")
            return F.lit(False)
        if {a.kind, b.kind} == {"node", "string"}:
            node, other = (a, b) if a.kind == "node" else (b, a)
            return self.guarded(node.node, node.node["text"].eqNullSafe(other.col))
        if a.kind == b.kind != "null":
            return self.scalar(a).eqNullSafe(self.scalar(b))
        # of different kinds: equal only if both are null
        return self.missing(a) & self.missing(b)

    def missing(self, v: Value) -> Column:
        if v.kind == "null":
            return F.lit(True)
        return self.scalar(v).isNull() if v.nullable else F.lit(False)

    def node(self, x, what: str, safe: bool) -> Ref:
        v = self.value(x)
        if v.kind != "node":
            raise CompileError(f"a {v.kind} has no {what}", "InvalidKind")
        return v.node if safe or not v.nullable else self.checked(v.node, v.node.present, f"InvalidKind: null has no {what}")

    def _access(self, x: L.Access) -> Value:
        name = x.name
        if name == "length":
            return self.length(x)
        n = self.node(x.of, name, x.safe)
        nullable = n.nullable
        if name == "kind":
            return Value("kind", self.guarded(n, n["kind"]), nullable=nullable)
        if name == "text":
            return Value("string", self.guarded(n, n["text"]), nullable=nullable)
        if name == "children":
            return Value("list", nodes=Nodes(n, "children"))
        if name == "parent":
            found = self.parent(n)
        elif name in ("previous_sibling", "next_sibling"):
            found = self.sibling(n, -1 if name == "previous_sibling" else 1)
        else:
            found = self.field(n, name)
            having = self.forest.syntax.with_field(name)
            if n.kinds is None or not set(n.kinds) <= set(having):
                ok = n["kind"].isin(*having)
                n = self.checked(n, ~n.present | ok if n.nullable else ok, f"InvalidField: {name}")
        found = replace(found, checks=n.checks)
        return Value("node", node=found, nullable=True)

    def _index(self, x: L.Index) -> Value:
        v, i = self.value(x.of), self.value(x.at)
        if i.kind != "int":
            raise CompileError(f"an index can't be a {i.kind}", "InvalidKind")
        if v.kind == "list" and v.nodes.axis != "children":
            raise CompileError("only children have places", "IndexError")
        if v.kind not in ("list", "node"):
            raise CompileError(f"a {v.kind} has no elements", "InvalidKind")
        n = v.nodes.of if v.kind == "list" else v.node
        found = self.child(n, i.col, x.at)
        return Value("node", node=self.checked(replace(found, checks=n.checks), found.present, "IndexError: no such element"))

    def length(self, x: L.Access) -> Value:
        v = self.value(x.of)
        if v.kind == "string":
            fail = self.forest.strict and v.nullable and not x.safe
            self.raises[0] += fail
            bad = F.raise_error(F.lit("InvalidKind: null has no length")).cast("long") if fail else F.lit(None).cast("long")
            return Value("int", F.when(v.col.isNull(), bad).otherwise(fn.byte_length(v.col)), nullable=v.nullable)
        if v.kind == "list":
            return Value("int", self.guarded(v.nodes.of, self.count(v.nodes)).cast("long"), nullable=v.nodes.of.nullable)
        if v.kind == "node":
            n = self.node(x.of, "length", x.safe)
            n = self.checked(n, F.coalesce(n["kind"] == "List", F.lit(n.nullable)), "InvalidKind: only lists have a length")
            return Value("int", self.guarded(n, n["n"]).cast("long"), nullable=n.nullable)
        raise CompileError(f"a {v.kind} has no length", "InvalidKind")

    def count(self, nodes: Nodes) -> Column:
        """The number of nodes on an axis; most follow from the encoding alone."""
        n, least, most = nodes.of, max(1, nodes.least), nodes.most
        within = lambda far: F.greatest(F.least(far, F.lit(most)) - (least - 1), F.lit(0))
        if nodes.axis == "children":
            return n["n"]
        if nodes.axis == "parents":
            return within(n["depth"])
        if nodes.axis == "previous_siblings":
            return F.coalesce(within(n["ord"]), F.lit(0))
        if nodes.axis in ("next_siblings", "siblings"):
            all_of = self.parent(n)["n"]
            after = F.coalesce(within(all_of - 1 - n["ord"]), F.lit(0))
            if nodes.axis == "next_siblings":
                return after
            again = F.when((all_of >= 2) & F.lit(nodes.least <= 2 <= most), 1).otherwise(0)
            return F.coalesce(within(n["ord"]), F.lit(0)) + after + again
        if nodes.axis == "descendants" and least == 1 and most == FAR:
            return n["hi"] - n["pre"]
        if nodes.axis == "referenced_decls":
            at = self.fresh()
            self.alone[0] += 1
            found = self.refs().groupBy(F.col("tree").alias(f"{at}_tree"), F.col("ref").alias(f"{at}_pre")).agg(F.count("decl").alias(f"{at}_count"))
            self.df = self.df.join(self.forest.side(found), (F.col(f"{at}_tree") == n["tree"]) & (F.col(f"{at}_pre") == n["pre"]), "left")
            self.raises[0] += self.forest.strict
            fail = F.raise_error(F.lit("InvalidKind: null has no length")).cast("long") if self.forest.strict else F.lit(None).cast("long")
            return F.coalesce(F.col(f"{at}_count"), fail)
        if most < least:
            return F.lit(0)
        if most == 1:
            return F.coalesce(n["n"], F.lit(0))
        return self.count_below(nodes)

    def count_below(self, nodes: Nodes) -> Column:
        """The number of descendants between two depths. The nodes of one depth in a bin are a row with a bit for each
        place, made before anything is exchanged, so a tree's nodes neither meet one by one nor are sorted."""
        n, at = nodes.of, self.fresh()
        x, at_bin = Ref(at), f"{at}_bin"
        self.alone[0] += 1
        width = min(BIN, BITS)
        words = range(-(-width // 64))
        spot = x["pre"] % width
        bit = lambda w: F.when(F.floor(spot / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int")))
        places = self.named(at).groupBy(f"{at}_tree", f"{at}_depth", F.floor(x["pre"] / width).alias(at_bin))
        places = places.agg(*[F.coalesce(F.bit_or(bit(w)), F.lit(0).cast("long")).alias(f"{at}_places{w}") for w in words])

        def within(w: int) -> Column:
            """The bits of places below the node."""
            first = F.col(f"{at_bin}_n") * width + w * 64
            a, b = F.greatest(n["pre"] + 1 - first, F.lit(0)).cast("int"), F.least(n["hi"] + 1 - first, F.lit(64)).cast("int")
            ones = F.lit(-1).cast("long")
            return F.when(a < b, F.call_function("shiftleft", ones, a).bitwiseAND(F.call_function("shiftrightunsigned", ones, F.lit(64) - b))).otherwise(F.lit(0).cast("long"))

        left = self.df.withColumn(f"{at_bin}_n", self.covered(n, width))
        meets = (x["tree"] == n["tree"]) & (F.col(at_bin) == F.col(f"{at_bin}_n")) & self.steps(n, x, nodes)
        keys = [(f"{k}_{c}", f"{at}k{i}{c}") for i, k in enumerate(self.keys) for c in ("tree", "pre")]
        fit = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{at}_places{w}").bitwiseAND(within(w))) for w in words])
        found = left.join(self.forest.side(places), meets).groupBy(*[F.col(a).alias(b) for a, b in keys]).agg(F.sum(fit).alias(f"{at}_count"))
        self.df = self.df.join(self.forest.side(found), reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in keys]), "left")
        return F.coalesce(F.col(f"{at}_count"), F.lit(0))

    def _call(self, x: L.Call) -> Value:
        if x.name == "matches":
            if len(x.args) != 1:
                raise CompileError("matches takes one argument", "UnexpectedArity")
            pattern = x.args[0][1]
            if not (isinstance(pattern, L.Literal) and pattern.regex):
                raise CompileError("matches takes a regular expression", "UnexpectedArg")
            v = self.value(x.of)
            if v.kind != "string":
                raise CompileError(f"a {v.kind} can't match", "InvalidKind")
            found = fn.matches(v.col, pattern.value)
            return Value("bool", F.coalesce(found, F.lit(False) if x.safe or not v.nullable else self.never(F.lit(False), "InvalidKind: null can't match")))
        if x.name == "to_int":
            if x.args:
                raise CompileError("to_int takes no argument", "UnexpectedArity")
            v = self.value(x.of)
            if v.kind == "int":
                return v
            if v.kind != "string":
                raise CompileError(f"a {v.kind} is no number", "InvalidKind")
            self.raises[0] += self.forest.strict
            return Value("int", fn.to_int(v.col, self.forest.strict), nullable=True)
        if x.name in METHODS:
            return METHODS[x.name](self, self.value(x.of), x.args)
        n = self.node(x.of, x.name, x.safe)
        if x.name == "referenced_decls":
            self.refs()
            return Value("list", nodes=Nodes(n, "referenced_decls"))
        if x.name not in GENERATORS:
            raise CompileError(f"unknown method {x.name}", "InvalidPropertyName")
        least, most = bounds(x.args)
        return Value("list", nodes=Nodes(n, x.name, least, most))


def only_at(at: str, name: Column) -> Column:
    return F.col(f"{at}_field") == name


def both(a: Column, b: Column, whole: bool = False) -> Column:
    """``a`` and ``b``, where ``b`` is looked at only if ``a`` holds.

    As a condition of a filter, the optimizer makes this an ``AND`` and moves its sides
    apart, unless it must stay ``whole``.
    """
    return F.coalesce(F.when(a, b), F.lit(False)) if whole else F.when(a, b).otherwise(F.lit(False))


def bounds(args) -> tuple[int, int]:
    """Least and most steps of an axis. Of two arguments, the second is the most,
    whatever its name."""
    if len(args) > 2:
        raise CompileError("an axis takes two arguments at most", "UnexpectedArity")
    numbers = []
    for name, x in args:
        if name is None or not isinstance(x, L.Literal) or not isinstance(x.value, int):
            raise CompileError("an axis takes named integers", "UnexpectedArg")
        numbers.append(x.value)
    if not args:
        return 1, FAR
    first = args[0][0]
    if len(args) == 2:
        if first != "min_depth":
            raise CompileError(f"unexpected {first}", "UnexpectedArg")
        return numbers[0], numbers[1]
    if first == "depth":
        return numbers[0], numbers[0]
    if first == "min_depth":
        return numbers[0], FAR
    if first == "max_depth":
        return 1, numbers[0]
    raise CompileError(f"unexpected {first}", "UnexpectedArg")


def start(forest: Forest, bindings: dict) -> tuple[Plan, Ref]:
    columns = forest.nodes.columns
    df = forest.nodes.select(*[F.col(c).alias(f"v0_{c}") for c in columns])
    plan, root = Plan(forest, df, {}, ["v0"]), Ref("v0")
    for name, (tree, pre) in bindings.items():  # one node each
        at = plan.fresh("b")
        row = plan.named(at).filter((F.col(f"{at}_tree") == tree) & (F.col(f"{at}_pre") == pre))
        plan.df = plan.df.join(F.broadcast(row), F.lit(True), "left")
        plan.names[name] = Ref(at)
    return plan, root


def match(forest: Forest, text: str, bindings: dict) -> DataFrame:
    """The nodes that match, as rows with the forest's own columns."""
    pattern = L.parse_query(text)
    plan, root = start(forest, bindings)
    plan.where_pattern(root, pattern)
    return plan.df.select(*[F.col(f"v0_{c}").alias(c) for c in forest.nodes.columns])
