"""Parsing by a grammar: an Earley recogniser over text, then one tree.

There is no separate lexer. At each place only the terminals that some rule can take
there compete: the longest wins, and a literal beats a pattern of its length. Ignored
text and comments are passed over only where nothing fits. Of several trees, levels
and sides rule some out, and then the first alternative and the longest part win.
A comment is a child of the innermost node that holds the token before it, or of the
root if there is none.

Trees are put together by generators that ask for their parts, on a stack of our own,
so nesting is as deep as memory allows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

from treeq.spec.meta import Alternative, Grammar, Part


@dataclass
class Tree:
    kind: str
    label: str | None
    start: int
    end: int  # of its last token
    children: list = field(default_factory=list)


@dataclass(frozen=True)
class Report:
    code: str
    at: int
    message: str


class Scanner:
    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.patterns = {n: re.compile(t.regex) for n, t in grammar.terminals.items() if t.regex}
        self.nested = {n: tuple(map(re.compile, t.nested)) for n, t in grammar.terminals.items() if t.nested}

    def match(self, name: str, text: str, at: int) -> int | None:
        """Where the terminal ends if it starts here."""
        t = self.grammar.terminals[name]
        if t.literal is not None:
            return at + len(t.literal) if t.literal and text.startswith(t.literal, at) else None
        if t.regex:
            m = self.patterns[name].match(text, at)
            return m.end() if m and m.end() > at else None
        first, last = self.nested[name]
        if not (m := first.match(text, at)):
            return None
        at, depth = m.end(), 1
        while depth:
            # an opener counts only right behind what was matched before
            if m := first.match(text, at):
                depth, at = depth + 1, m.end()
            elif m := last.search(text, at):
                depth, at = depth - 1, m.end()
            else:
                return None
        return at

    def best(self, names, text: str, at: int) -> dict[str, int]:
        found = {n: e for n in names if (e := self.match(n, text, at)) is not None}
        if not found:
            return {}
        far = max(found.values())
        longest = {n for n, e in found.items() if e == far}
        literal = {n for n in longest if self.grammar.terminals[n].literal is not None}
        return dict.fromkeys(literal or longest, far)

    def passed(self, text: str, at: int) -> tuple[int, bool]:
        """The end of ignored text or a comment that starts here, and whether it is a comment."""
        for names in (self.grammar.ignored, self.grammar.comments):
            ends = [e for n in names if (e := self.match(n, text, at)) is not None]
            if ends:
                return max(ends), names is self.grammar.comments
        return at, False


def settled(request):
    """The result of a generator that yields the generators whose results it needs."""
    stack, value = [request], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


class Parser:
    """A grammar made ready: alternatives as productions, lists as productions too."""

    def __init__(self, grammar: Grammar, start: str = "main"):
        self.grammar, self.start = grammar, start
        self.scanner = Scanner(grammar)
        self.first: State | None = None
        self.held = 0
        self.choosers: dict[frozenset, Chooser] = {}
        # (kind, name) -> productions: (parts, alternative)
        self.productions: dict[tuple[str, str], list[tuple[tuple[tuple[str, str], ...], Alternative | None]]] = {}
        for rule, alternatives in grammar.rules.items():
            own = self.productions.setdefault(("rule", rule), [])
            for a in alternatives:
                variants: list[tuple] = [()]
                for p in a.parts:
                    kept = [(*v, (p.kind, p.what)) for v in variants]
                    variants = kept + variants if p.optional else kept
                own.extend((v, a) for v in dict.fromkeys(variants))
        for key, (element, separators, empty, trailing) in grammar.lists.items():
            me, one = ("list", key), ("list", f"{key} items")
            e = ("rule", element)
            between = [(("term", s),) for s in separators] or [()]
            self.productions[one] = [((e,), None), *[((one, *s, e), None) for s in between]]
            self.productions[me] = [((one,), None)] + ([((), None)] if empty else [])
            if trailing:
                self.productions[me] += [((one, *s), None) for s in between]
        self.nullable: set = set()
        while True:
            more = {s for s, ps in self.productions.items() if s not in self.nullable and any(all(x in self.nullable for x in p) for p, _ in ps)}
            if not more:
                break
            self.nullable |= more
        self.through = {r: self._through(r) for r in grammar.rules}

    def _through(self, rule: str) -> set[str]:
        """Rules that ``rule`` can stand for by plain references."""
        seen, todo = set(), [rule]
        while todo:
            r = todo.pop()
            if r not in seen:
                seen.add(r)
                todo += [a.parts[0].what for a in self.grammar.rules[r] if a.node is None]
        return seen

    def parse(self, text: str) -> tuple[Tree | None, list[Report]]:
        shape, marks, wrong = self.read(text)
        return shape and shape.tree(marks), wrong

    def read(self, text: str) -> tuple[Shape | None, list[int], list[Report]]:
        """The shape of the text's tree, the places of its marks and behind these where each mark's trail ends, and what is wrong.

        What a text's tree looks like follows from its tokens alone, so recognised prefixes are
        kept and each shape is made once; texts of one shape differ by the places of their marks.
        """
        if self.first is None or self.held > HELD:
            self.held, self.first = 0, self.state(((("rule", self.start), i, 0, 0) for i in range(len(self.productions["rule", self.start]))), [])
        state, place, passed = self.first, 0, self.scanner.passed
        path, marks, trails, at, gaps = [state], [0], [0], [0], []
        while True:
            comments = 0
            while not (found := state.chooser.best(text, place))[0]:
                after, comment = passed(text, place)
                if after == place:
                    break
                if comment:
                    comments += 1
                    marks += (place, after)
                    trails += (place, after)
                place = after
            trail = place
            while (after := passed(text, trail)[0]) > trail:
                trail = after
            trails[at[-1]] = trail
            marks.append(place)
            trails.append(place)
            gaps.append(comments)
            taken, end = found
            if not taken:
                break
            following = state.next.get(taken)
            if following is None:
                names = (taken,) if isinstance(taken, str) else taken
                following = state.next[taken] = self.state(((s, i, d + 1, o) for n in names for s, i, d, o in state.wanted[n]), path)
            state = following
            path.append(state)
            at.append(len(marks))
            marks.append(end)
            trails.append(end)
            place = end
        whole = (("rule", self.start), 0) in state.ended and place == len(text)
        wrong = []
        if not whole:
            wrong = [Report("unexpected_eof", len(text), "unexpected end of file") if place >= len(text) else Report("unexpected_token", place, f"unexpected {text[place]!r}")]
        return self.shape(path, tuple(gaps), whole, [marks[i] for i in at]), marks + trails, wrong

    def state(self, items, path: list[State]) -> State:
        """What is recognised behind the tokens that lead to the items; the states before it are the path."""
        productions, nullable, at = self.productions, self.nullable, len(path)
        seen, waiting, ended, wanted = set(), {}, set(), {}
        todo = list(items)
        while todo:
            item = todo.pop()
            if item in seen:
                continue
            seen.add(item)
            symbol, i, dot, origin = item
            parts = productions[symbol][i][0]
            if dot == len(parts):
                if (symbol, origin) not in ended:
                    ended.add((symbol, origin))
                    before = waiting if origin == at else path[origin].waiting
                    for s, j, d, o in list(before.get(symbol, ())):
                        todo.append((s, j, d + 1, o))
                continue
            want = parts[dot]
            if want[0] == "term":
                wanted.setdefault(want[1], []).append(item)
                continue
            if want not in waiting:
                waiting[want] = set()
                todo.extend((want, j, 0, at) for j in range(len(productions[want])))
            if item not in waiting[want]:
                waiting[want].add(item)
                if want in nullable or (want, at) in ended:
                    ended.add((want, at))
                    todo.append((symbol, i, dot + 1, origin))
        self.held += len(seen) + 1
        names = frozenset(wanted)
        if names not in self.choosers:
            self.choosers[names] = Chooser(self.scanner, wanted)
        return State(waiting, ended, wanted, self.choosers[names])

    def shape(self, path: list[State], gaps: tuple[int, ...], whole: bool, ends: list[int]) -> Shape | None:
        """The tree's shape, by the tokens of the path, the number of comments in each gap, and where tokens end."""
        last, run = path[-1], None
        if whole:
            spans = [(self.start, 0, len(path) - 1)]
        else:
            # what was read: the widest part that is whole, the last of equal ones
            if last.spans is None:
                last.spans = [(s[1], o, e) for e, state in enumerate(path) for s, o in state.ended if s[0] == "rule"]
                self.held += len(last.spans)
            spans = sorted(last.spans, key=lambda x: (ends[x[1]] - ends[x[2]], -ends[x[1]], x[0]))
        for span in spans:
            key = gaps, span
            if key not in last.shapes:
                run = run or Run(self, path)
                found = settled(run.rule(*span, None, frozenset()))
                if found:
                    found = run.placed(found, gaps)
                    self.held += len(found.kind)
                last.shapes[key] = found
                self.held += 1
            if last.shapes[key]:
                return last.shapes[key]
        return None


#: States and nodes of shapes that a parser keeps.
HELD = 300_000


@dataclass(slots=True)
class State:
    """An Earley set: what waits for a symbol, what ends here, and the items that want a token."""

    waiting: dict
    ended: set
    wanted: dict
    chooser: Chooser
    next: dict = field(default_factory=dict)
    shapes: dict = field(default_factory=dict)
    spans: list | None = None


class Chooser:
    """``Scanner.best`` of the same names again and again: literals are looked up by their first character."""

    def __init__(self, scanner: Scanner, wanted):
        self.scanner, self.wanted = scanner, set(wanted)
        names = [*dict.fromkeys([*wanted, *scanner.grammar.comments])]
        literal = {n: t for n in names if (t := scanner.grammar.terminals[n].literal) is not None}
        self.others = [n for n in names if n not in literal]
        self.literals: dict[str, list] = {}
        for n, t in sorted(literal.items(), key=lambda x: -len(x[1])):
            if t:
                self.literals.setdefault(t[0], []).append((n, t))

    def best(self, text: str, at: int) -> tuple:
        """A wanted name, or the set of several, and where it ends; a name of None if there is none."""
        far, found = at, []
        for n, t in self.literals.get(text[at : at + 1], ()):
            if at + len(t) < far:
                break
            if text.startswith(t, at):
                far = at + len(t)
                found.append(n)
        literal = bool(found)
        for n in self.others:
            e = self.scanner.match(n, text, at)
            if e is not None and (e > far or e == far and not literal):
                if e > far:
                    far, found, literal = e, [], False
                found.append(n)
        found = [n for n in found if n in self.wanted]
        if not found:
            return None, at
        return found[0] if len(found) == 1 else frozenset(found), far


class Shape:
    """A tree without its text: a list for each column, in pre-order, with the numbers of the marks at which nodes start,
    end, and end with what is passed over behind them."""

    def __init__(self, tree: Tree, marks: int | None = None):
        self.hi, self.depth, self.parent, self.ord, self.n, self.field, self.kind, self.start, self.end = flat(tree)
        self.marks = marks
        self.trail = self.end if marks is None else [e + marks if e > s and k != "Comment" else e for s, e, k in zip(self.start, self.end, self.kind)]

    def tree(self, marks: list[int]) -> Tree:
        made: list[Tree] = []
        for label, kind, parent, s, e in zip(self.labels, self.kind, self.parent, self.start, self.end):
            made.append(Tree(kind, label, marks[s], marks[e], []))
            if parent is not None:
                made[parent].children.append(made[-1])
        return made[0]


class Run:
    """One tree of a recognised text. Places are numbers of tokens, and in trees numbers of marks: for each gap between
    tokens the end of the token before, starts and ends of comments, and the start of the token behind."""

    def __init__(self, parser: Parser, path: list[State]):
        self.p, self.path = parser, path
        self.ends: dict[tuple, set[int]] = {}
        for at, state in enumerate(path):
            for key in state.ended:
                self.ends.setdefault(key, set()).add(at)
        self.edges: list[dict[str, int]] = []
        for at, (state, after) in enumerate(zip(path, path[1:])):
            taken = next(k for k, x in state.next.items() if x is after)
            self.edges.append(dict.fromkeys((taken,) if isinstance(taken, str) else taken, at + 1))
        self.memo: dict = {}

    def token(self, at: int) -> dict[str, int]:
        return self.edges[at] if at < len(self.edges) else {}

    def placed(self, tree: Tree, gaps: tuple[int, ...]) -> Shape:
        """The shape, with marks for places and with its comments. Before, a tree has the even number ``2 * i`` for the end of
        the token before the ``i``-th gap and the odd one behind it for the gap's end."""
        left, right, number = [], [], 0
        for comments in gaps:
            left.append(number)
            number += 1 + 2 * comments
            right.append(number)
            number += 1
        root, todo = None, [(tree, None)]
        while todo:
            t, above = todo.pop()
            own = Tree(t.kind, t.label, *[(right if x % 2 else left)[x // 2] for x in (t.start, t.end)], [])
            if above is None:
                root = own
            else:
                above.children.append(own)
            todo.extend((c, own) for c in reversed(t.children))
        for i, comments in enumerate(gaps):
            for c in range(comments):
                self.comment(root, left[i], left[i] + 1 + 2 * c)
        found = Shape(root, number)
        found.labels = labels(root)
        return found

    @staticmethod
    def comment(root: Tree, before: int, at: int) -> None:
        """Adds a comment if it lies in or behind the tree's tokens."""
        t = root
        if root.start < before <= root.end:
            while True:
                i = bisect_right(t.children, before - 1, key=lambda c: c.start) - 1
                if i < 0 or not t.children[i].start < before <= t.children[i].end:
                    break
                t = t.children[i]
        elif before or at > root.start:
            return  # behind another part of a text that wasn't read whole
        place = bisect_right(t.children, at, key=lambda c: c.start)
        t.children.insert(place, Tree("Comment", None, at, at + 1))

    def spot(self, at: int) -> int:
        return 2 * at + 1

    # what follows yields requests to ``settled``

    def rule(self, name: str, start: int, end: int, label: str | None, barred: frozenset):
        key = name, start, end, barred
        if key not in self.memo:
            self.memo[key] = None  # a rule that stands for itself gives no tree
            self.memo[key] = yield self._rule(name, start, end, barred)
        found = self.memo[key]
        return found and Tree(found.kind, label, found.start, found.end, found.children)

    def _rule(self, name: str, start: int, end: int, barred: frozenset):
        for a in self.p.grammar.rules[name]:
            if a.node is None:
                if end in self.ends.get((("rule", a.parts[0].what), start), ()) and (t := (yield self.rule(a.parts[0].what, start, end, None, barred))):
                    return t
            elif (a.rule, a.place) not in barred:
                children = yield self.split(a, 0, start, end)
                if children is not None:
                    return node(a.node, None, self.spot(start), children)
        return None

    def split(self, a: Alternative, i: int, at: int, end: int):
        """Children and tokens of the alternative's parts from ``i`` on."""
        if i == len(a.parts):
            return [] if at == end else None
        key = a.rule, a.place, i, at, end
        if key in self.memo:
            return self.memo[key]
        self.memo[key] = None
        p: Part = a.parts[i]
        for stop in self.stops(p, at):
            if stop > end:
                continue
            rest = yield self.split(a, i + 1, stop, end)
            if rest is None:
                continue
            if p.kind == "term":
                own = [(self.spot(at), 2 * stop)]
            elif p.kind == "list":
                t = yield self.items(p, at, stop)
                own = [t] if t else None
            else:
                t = yield self.rule(p.what, at, stop, p.field, self.barred(a, i))
                own = [t] if t else None
            if own is not None:
                self.memo[key] = own + rest
                return self.memo[key]
        if p.optional:
            self.memo[key] = yield self.split(a, i + 1, at, end)
        return self.memo[key]

    def stops(self, p: Part, at: int) -> list[int]:
        if p.kind == "term":
            e = self.token(at).get(p.what)
            return [] if e is None else [e]
        return sorted(self.ends.get(((p.kind, p.what), at), ()), reverse=True)

    def items(self, p: Part, at: int, end: int):
        """The list node over the span; elements one after the other, with a way back."""
        element, separators, empty, trailing = self.p.grammar.lists[p.what]
        if at == end:
            return Tree("List", p.field, self.spot(at), self.spot(at), []) if empty else None
        ends = lambda o: sorted(self.ends.get((("rule", element), o), ()), reverse=True)
        path: list[tuple] = []
        todo = [(0, at, None, [], e) for e in reversed([e for e in ends(at) if at < e <= end])]
        while todo:
            depth, o, _, gap, e = todo.pop()
            del path[depth:]
            t = yield self.rule(element, o, e, None, frozenset())
            if t is None:
                continue
            path.append((gap, t))
            if e == end:
                break
            jumps = [(e, [])] if not separators else [(x, [(self.spot(e), 2 * x)]) for s in separators if (x := self.token(e).get(s))]
            if trailing and any(x == end for x, _ in jumps):
                path.append((jumps[0][1], None))
                break
            for x, gap2 in jumps:
                todo.extend((depth + 1, x, None, gap2, e2) for e2 in reversed([y for y in ends(x) if x < y <= end]))
        else:
            return None
        children = [c for gap, t in path for c in (*gap, t) if c is not None]
        return node("List", p.field, self.spot(at), children)

    def barred(self, a: Alternative, i: int) -> frozenset:
        return barred(self.p, a, i)


@lru_cache(maxsize=None)
def barred(p: Parser, a: Alternative, i: int) -> frozenset:
    """Alternatives that can't fill the part: those of a lower level, and on the side
    that the alternative doesn't lean to, those that would lean the same way."""
    out = set()
    every = [b for alternatives in p.grammar.rules.values() for b in alternatives if b.node]
    if a.level is not None:
        out |= {(b.rule, b.place) for b in every if b.level is not None and b.level < a.level}
    recursive = [j for j, x in enumerate(a.parts) if x.kind == "rule" and (a.rule in p.through[x.what] or x.what in p.through[a.rule])]
    if a.side and len(recursive) >= 2 and i == recursive[-1 if a.side == "left" else 0]:
        out |= {(b.rule, b.place) for b in every if b.side == a.side and (b.level is None or a.level is None or b.level <= a.level)}
    return frozenset(out)


def node(kind: str, label: str | None, start: int, parts: list) -> Tree:
    """A node over its parts: trees and the spans of tokens."""
    ends = [(x[0], x[1]) if isinstance(x, tuple) else (x.start, x.end) for x in parts]
    full = [(s, e) for s, e in ends if e > s]
    first, last = (full[0][0], full[-1][1]) if full else (start, start)
    return Tree(kind, label, first, last, [x for x in parts if isinstance(x, Tree)])


def rows(tree: Tree, text: str, parser: Parser) -> list[dict]:
    """The tree's nodes in pre-order, with the columns of a parsed forest."""
    lines = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    sizes = None if text.isascii() else [0, *accumulate(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in text)]
    trails: dict[int, int] = {}

    def position(at: int) -> tuple[int, int]:
        line = bisect_right(lines, at) - 1
        return line + 1, at - lines[line] + 1

    def offset(at: int) -> int:
        return at if sizes is None else sizes[at]

    def trailing(end: int) -> int:
        """The end of ignored text and comments behind a token."""
        if end not in trails:
            at = end
            while (after := parser.scanner.passed(text, at)[0]) > at:
                at = after
            trails[end] = at
        return trails[end]

    out: list[dict] = []
    for hi, depth, parent, place, n, label, kind, start, end in zip(*flat(tree)):
        trail = trailing(end) if end > start and kind != "Comment" else end
        a, b = position(start), position(max(start, trail - 1))
        out.append(
            {
                "pre": len(out), "hi": hi, "depth": depth, "parent": parent, "ord": place, "n": n, "field": label, "kind": kind,
                "text": text[start:end], "start_line": a[0], "start_col": a[1], "start_off": offset(start), "end_line": b[0], "end_col": b[1], "end_off": offset(trail),
            }
        )
    return out


def flat(tree: Tree) -> tuple[list, ...]:
    """``hi, depth, parent, ord, n, field, kind, start, end`` of the tree's nodes in pre-order, a list each."""
    out: list[tuple] = []
    todo: list[tuple] = [(tree, None, 0, 0, tree.label)]
    while todo:
        t, parent, depth, place, label = todo.pop()
        me, seen, below = len(out), set(), []
        out.append((depth, parent, place, len(t.children), label, t.kind, t.start, t.end))
        for i, c in enumerate(t.children):
            below.append((c, me, depth + 1, i, c.label if c.label and c.label not in seen else None))
            seen.add(c.label)
        todo.extend(reversed(below))
    depth, parent, place, n, label, kind, start, end = map(list, zip(*out))
    hi = list(range(len(out)))
    for i in range(len(out) - 1, 0, -1):
        hi[parent[i]] = max(hi[parent[i]], hi[i])
    return hi, depth, parent, place, n, label, kind, start, end


def labels(tree: Tree) -> list[str | None]:
    """The nodes' labels in pre-order, those that repeat one of a sibling too."""
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        out.append(t.label)
        todo.extend(reversed(t.children))
    return out
