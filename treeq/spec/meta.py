"""Language specifications: ``node``, ``term`` and ``rule`` declarations to a grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from treeq.errors import SpecError
from treeq.syntax import BUILT_IN, Kind, Syntax


@dataclass(frozen=True)
class Terminal:
    name: str
    literal: str | None = None
    regex: str | None = None
    nested: tuple[str, str] | None = None


@dataclass(frozen=True)
class Part:
    """A component: ``what`` is a terminal's name, a rule's, or a list's key."""

    kind: str  # term, rule or list
    what: str
    field: str | None = None
    optional: bool = False


@dataclass(frozen=True)
class Alternative:
    rule: str
    place: int
    node: str | None
    parts: tuple[Part, ...]
    level: int | None = None
    side: str | None = None


@dataclass
class Grammar:
    syntax: Syntax
    terminals: dict[str, Terminal] = field(default_factory=dict)
    ignored: list[str] = field(default_factory=list)
    comments: list[str] = field(default_factory=list)
    rules: dict[str, list[Alternative]] = field(default_factory=dict)
    #: key: (element's rule, separator terminals, may be empty, may end with a separator)
    lists: dict[str, tuple[str, tuple[str, ...], bool, bool]] = field(default_factory=dict)


_TOKEN = re.compile(
    r"(?P<skip>[ \t\r\n]+|\#[^\n]*)|(?P<regex>`(?:\\`|[^`])+`)|(?P<literal>'[^']*')|(?P<name>[^\W\d_]\w*)|(?P<int>[0-9]+)|(?P<mark>[{}()\[\]<>:|,=@?*+])", re.S
)
# List components. Name: (may be empty, separated, may end with a separator).
LISTS = {
    "many": (True, False, False),
    "some": (False, False, False),
    "sepBy": (True, True, False),
    "sepBy1": (False, True, False),
    "sepByTr": (True, True, True),
    "sepByTr1": (False, True, True),
}


class SpecParser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SpecError(f"unexpected {text[at]!r} on line {text.count(chr(10), 0, at) + 1}", "Syntax")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0
        self.kinds: dict[str, Kind] = {k: Kind(k) for k in BUILT_IN}
        self.grammar: Grammar | None = None
        self.terminals: dict[str, Terminal] = {}
        self.ignored: list[str] = []
        self.comments: list[str] = []
        self.rules: dict[str, list[Alternative]] = {}
        self.lists: dict[str, tuple] = {}

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def type(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def eat(self, token: str) -> bool:
        if self.peek() == token:
            self.at += 1
            return True
        return False

    def need(self, token: str) -> None:
        if not self.eat(token):
            raise SpecError(f"expected {token!r}, not {self.peek()!r}", "Syntax")

    def name(self) -> str:
        if self.type() != "name":
            raise SpecError(f"expected a name, not {self.peek()!r}", "Syntax")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self) -> Grammar:
        while self.at < len(self.tokens):
            word = self.name()
            if word == "node":
                self.node()
            elif word in ("term", "ignore", "comment"):
                if word != "term":
                    self.need("term")
                own = self.name()
                self.need("=")
                if own in self.terminals:
                    raise SpecError(f"{own} is declared twice", "MultipleDecl")
                self.terminals[own] = self.content(own)
                {"ignore": self.ignored, "comment": self.comments}.get(word, []).append(own)
            elif word == "rule":
                self.rule()
            else:
                raise SpecError(f"unexpected {word}", "Syntax")
        return self.checked()

    def checked(self) -> Grammar:
        if "main" not in self.rules:
            raise SpecError("no rule main", "MissingDecl")
        for alternatives in self.rules.values():
            for a in alternatives:
                if a.node and a.node not in self.kinds:
                    raise SpecError(f"unknown node {a.node}", "MissingDecl")
                for p in a.parts:
                    known = {"term": self.terminals, "rule": self.rules, "list": self.lists}[p.kind]
                    if p.what not in known:
                        raise SpecError(f"unknown {p.kind} {p.what}", "MissingDecl")
        for element, separators, *_ in self.lists.values():
            for s in separators:
                if s not in self.terminals:
                    raise SpecError(f"unknown term {s}", "MissingDecl")
            if element not in self.rules:
                raise SpecError(f"unknown rule {element}", "MissingDecl")
        return Grammar(Syntax(self.kinds), self.terminals, self.ignored, self.comments, self.rules, self.lists)

    def node(self) -> None:
        name = self.name()
        parent = self.name() if self.eat(":") else None
        if name in self.kinds and name not in BUILT_IN:
            raise SpecError(f"{name} is declared twice", "MultipleDecl")
        fields = []
        self.need("{")
        while not self.eat("}"):
            if self.eat(","):
                continue
            fields.append(self.name())
            self.need(":")
            self.types()
        self.kinds[name] = Kind(name, parent, tuple(fields))

    def types(self) -> None:
        while True:
            self.name()
            if self.eat("<"):
                self.types()
                while self.eat(","):
                    self.types()
                self.need(">")
            if not self.eat("|"):
                return

    def content(self, name: str | None) -> Terminal:
        kind, text = self.type(), self.peek()
        if kind == "literal":
            self.at += 1
            return Terminal(name or text, literal=text[1:-1])
        if kind == "regex":
            self.at += 1
            pattern = text[1:-1].replace("\\`", "`")
            if re.compile(pattern).match(""):
                raise SpecError(f"{pattern!r} matches the empty text", "Regex")
            return Terminal(name or text, regex=pattern)
        call, args = self.name(), {}
        self.need("(")
        while not self.eat(")"):
            if self.eat(","):
                continue
            key = self.name()
            self.need("=")
            inner = self.content(None)
            args[key] = inner.regex if inner.regex else re.escape(inner.literal or "")
        if call != "nested" or set(args) != {"start", "end"}:
            raise SpecError(f"unknown terminal {call}", "InvalidCall")
        return Terminal(name or f"nested({args['start']},{args['end']})", nested=(args["start"], args["end"]))

    def terms(self) -> tuple[str, ...]:
        """One terminal, or alternatives in brackets."""
        if self.eat("["):
            found = [*self.terms()]
            while self.eat(","):
                found += self.terms()
            self.need("]")
            return tuple(found)
        if self.type() == "name" and not (self.peek(1) == "(" and self.peek() == "nested"):
            return (self.name(),)
        t = self.content(None)
        self.terminals.setdefault(t.name, t)
        return (t.name,)

    def rule(self) -> None:
        name = self.name()
        if name in self.rules:
            raise SpecError(f"{name} is declared twice", "MultipleDecl")
        self.need("=")
        found: list[Alternative] = []
        while True:
            self.alternative(name, found)
            if not self.eat("|"):
                break
        self.rules[name] = found

    def alternative(self, rule: str, found: list[Alternative]) -> None:
        level = side = None
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                if self.type() == "int":
                    level = int(self.peek())
                else:
                    side = self.peek()
                self.at += 1
        name = self.name()
        if not self.eat("{"):
            found.append(Alternative(rule, len(found), None, (Part("rule", name),)))
            return
        choices: list[list[Part]] = [[]]
        while not self.eat("}"):
            parts = self.part()
            choices = [[*c, p] for c in choices for p in parts]
        for c in choices:
            found.append(Alternative(rule, len(found), name, tuple(c), level, side))

    def part(self) -> list[Part]:
        """The component, once for each alternative terminal."""
        if self.type() == "name" and self.peek(1) == "@":
            label = self.name()
            self.need("@")
            what = self.name()
            if self.eat("("):
                if what == "opt":
                    inner = self.name()
                    self.need(")")
                    return [Part("rule", inner, label, True)]
                if what not in LISTS:
                    raise SpecError(f"unknown component {what}", "InvalidCall")
                empty, separated, trailing = LISTS[what]
                separators: tuple[str, ...] = ()
                if separated:
                    separators = self.terms()
                    self.need(",")
                inner = self.name()
                self.need(")")
                return [self.list(label, inner, separators, empty, trailing)]
            if self.eat("?"):
                return [Part("rule", what, label, True)]
            if self.eat("*"):
                return [self.list(label, what, (), True, False)]
            if self.eat("+"):
                return [self.list(label, what, (), False, False)]
            return [Part("rule", what, label)]
        if self.type() == "name" and not self.peek()[0].isupper() and not (self.peek() == "nested" and self.peek(1) == "("):
            return [Part("rule", self.name())]
        return [Part("term", t) for t in self.terms()]

    def list(self, label: str, element: str, separators: tuple, empty: bool, trailing: bool) -> Part:
        key = repr((element, separators, empty, trailing))
        self.lists[key] = (element, separators, empty, trailing)
        return Part("list", key, label)


def read_spec(text: str) -> Grammar:
    return SpecParser(text).parse()
