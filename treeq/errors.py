"""Errors by stage. ``code`` is the name that the query language gives them."""

from __future__ import annotations


class TreeqError(Exception):
    code = "Error"

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        if code:
            self.code = code


class QuerySyntaxError(TreeqError):
    code = "SyntaxError"


class CompileError(TreeqError):
    """Kinds, names, properties and arguments that a query can't use."""


class SpecError(TreeqError):
    """A language specification that contradicts itself."""


class ConfigError(TreeqError):
    """A project or ruleset file that can't be used."""
