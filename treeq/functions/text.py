"""Regular expressions and numbers in text, with the query language's rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_regex(pattern: str) -> str:
    """The pattern for Java's engine: Unicode classes, ``.`` stops at line feeds only,
    ``$`` is the very end unless ``(?m)`` is on, named groups in Java's spelling."""
    out, i, in_class, multiline = [], 0, False, bool(re.search(r"\(\?[a-z]*m", pattern))
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif not in_class and c == "$" and not multiline:
            c = r"\z"
        elif not in_class and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        out.append(c)
        i += 1
    return "(?Ud)" + "".join(out)


def matches(text: Column, pattern: str) -> Column:
    """True where the pattern is found anywhere in the text."""
    return F.rlike(text, F.lit(java_regex(pattern)))


def to_int(text: Column, strict: bool) -> Column:
    """A signed decimal number of 64 bits; anything else is an error, or null."""
    bad = F.raise_error(F.concat(F.lit("NotAnInt: "), text)).cast("long") if strict else F.lit(None).cast("long")
    number = F.when(F.rlike(text, F.lit(r"^[+-]?[0-9]+\z")), text.try_cast("long"))
    return F.when(text.isNull(), F.lit(None).cast("long")).otherwise(F.coalesce(number, bad))


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")
