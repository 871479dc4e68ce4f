"""Kinds, their hierarchy and their fields: the schema of a forest."""

from __future__ import annotations

from dataclasses import dataclass, field

from treeq.errors import CompileError, SpecError

# The kinds that every syntax has.
BUILT_IN = ("Comment", "List", "Error", "Unknown")


@dataclass
class Kind:
    name: str
    parent: str | None = None
    fields: tuple[str, ...] = ()


@dataclass
class Syntax:
    kinds: dict[str, Kind] = field(default_factory=dict)

    @classmethod
    def of(cls, **kinds: tuple) -> Syntax:
        """``Syntax.of(Turn=("role", "body"), Customer=("Party",))``: fields in lower case, a parent in upper."""
        made = {name: Kind(name, next((x for x in own if x[0].isupper()), None), tuple(x for x in own if x[0].islower())) for name, own in kinds.items()}
        return cls(made)

    def __post_init__(self) -> None:
        for name in BUILT_IN:
            self.kinds.setdefault(name, Kind(name))
        for k in self.kinds.values():
            if k.parent and k.parent not in self.kinds:
                raise SpecError(f"{k.name} has an unknown parent {k.parent}", "MissingDecl")
        self.by_parent: dict[str, list[str]] = {}
        for k in self.kinds.values():
            if k.parent:
                self.by_parent.setdefault(k.parent, []).append(k.name)
        self.fields = {f for k in self.kinds.values() for f in k.fields}

    def closure(self, name: str) -> list[str]:
        """The kind and all kinds below it."""
        if name not in self.kinds:
            raise CompileError(f"unknown kind {name}", "InvalidKind")
        found, todo = [], [name]
        while todo:
            found.append(k := todo.pop())
            todo += [x for x in self.by_parent.get(k, ()) if x not in found]
        return sorted(found)

    def with_field(self, name: str) -> list[str]:
        return sorted(k.name for k in self.kinds.values() if name in k.fields)
