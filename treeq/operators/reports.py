"""Reports as rows, their severity, and how nodes, trees and reports are written."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories in ascending order, with their severities.
CATEGORIES = {"style": "help", "smell": "warning", "deprecated": "warning", "bug": "bug", "error": "error"}


def severity(category: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, level in CATEGORIES.items():
        found = F.when(category == name, level).otherwise(found)
    return found


def rank(category: Column) -> Column:
    found = F.lit(None).cast("int")
    for i, name in enumerate(CATEGORIES):
        found = F.when(category == name, i).otherwise(found)
    return found


def ordered(reports: DataFrame) -> DataFrame:
    """Worst first, then by ruleset and node, all descending."""
    return reports.orderBy(rank(F.col("category")).desc(), F.col("ruleset").desc(), F.col("tree").desc(), F.col("node_id").desc())


def listing(nodes: DataFrame, path: Column) -> DataFrame:
    """``[Kind path:line:col-line:col]`` of every node of a parsed forest, as ``line``."""
    at = F.format_string("[%s %s:%d:%d-%d:%d]", "kind", path, "start_line", "start_col", "end_line", "end_col")
    return nodes.select("tree", (F.col("hi") - F.col("depth")).alias("node_id"), at.alias("line"))


def pretty(rows: list) -> str:
    """The tree of ``rows``, in pre-order, one node a line; leaves show their text."""
    out: list[str] = []
    closing: list[int] = []
    for r in rows:
        while closing and closing[-1] >= r["depth"]:
            out.append(". " * closing.pop() + "}")
        label = f"● {r['field']}: " if r["field"] else ""
        head = f"{'. ' * r['depth']}{label}{r['kind']} {{"
        if r["n"]:
            out.append(head)
            closing.append(r["depth"])
        else:
            out.append(f"{head} {r['text']} }}" if r["text"] else f"{head} }}")
    while closing:
        out.append(". " * closing.pop() + "}")
    return "\n".join(out)


def pretty_trees(nodes: DataFrame) -> DataFrame:
    """``tree, rendered`` of every tree, as ``pretty`` writes it: a node gives the line that opens it, where it lies, and if it has
    children the line that closes it, behind its subtree's last; of those that end together, the deepest first."""
    indent = F.repeat(F.lit(". "), F.col("depth"))
    label = F.when(F.length("field") > 0, F.concat(F.lit("● "), "field", F.lit(": "))).otherwise("")
    shown = F.when(F.length("text") > 0, F.concat(F.lit(" "), "text")).otherwise("")
    head = F.concat(indent, label, "kind", F.lit(" {"), F.when(F.col("n") > 0, "").otherwise(F.concat(shown, F.lit(" }"))))
    line = lambda place, rank, text: F.struct(place.alias("place"), rank.cast("int").alias("rank"), text.alias("line"))
    opening, closing = line(F.col("pre"), F.lit(-1 << 30), head), line(F.col("hi"), -F.col("depth"), F.concat(indent, F.lit("}")))
    lines = nodes.select("tree", F.explode(F.when(F.col("n") > 0, F.array(opening, closing)).otherwise(F.array(opening))).alias("x"))
    written = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]))
    return lines.groupBy("tree").agg(written.alias("rendered"))


def diagnostic(report: dict, source: str, path: str) -> str:
    """One report with the line it points at."""
    lines = source.split("\n")
    line = lines[report["start_line"] - 1] if 0 < report["start_line"] <= len(lines) else ""
    gutter = len(str(report["start_line"]))
    last = report["end_col"] if report["end_line"] == report["start_line"] else len(line)
    marks = " " * (report["start_col"] - 1) + "^" * max(1, last - report["start_col"] + 1)
    out = [
        f"{CATEGORIES[report['category']]}[{report['rule_id']}]: {report['message']}",
        f"{' ' * gutter} ┌─ {path}:{report['start_line']}:{report['start_col']}",
        f"{' ' * gutter} │",
        f"{report['start_line']} │ {line}",
        f"{' ' * gutter} │ {marks}",
    ]
    return "\n".join(out + ([f"{' ' * gutter} = {report['note']}"] if report.get("note") else []))


def diagnostics(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """``tree, node_id, rule_id, shown``: every report with its line, worst first.

    ``sources`` has ``tree, path, text``. A report meets its line on the executors.
    """

    @F.pandas_udf("string")
    def shown(report: pd.DataFrame, text: pd.Series, path: pd.Series) -> pd.Series:
        rows = report.astype(object).where(report.notna(), None).to_dict("records")
        return pd.Series([diagnostic(r, t, p) for r, t, p in zip(rows, text, path)], dtype=object)

    fields = F.struct("rule_id", "category", "message", "note", "start_line", "start_col", "end_line", "end_col")
    joined = reports.join(sources.select("tree", "path", "text"), "tree").withColumn("shown", shown(fields, F.col("text"), F.col("path")))
    return ordered(joined).select("tree", "node_id", "rule_id", "shown")


def records(reports: DataFrame, path: Column) -> DataFrame:
    """What a dashboard takes: one nested record a report, for ``write.json``."""
    place = lambda side: F.struct(F.col(f"{side}_line").alias("line"), F.col(f"{side}_col").alias("column"))
    return reports.select(
        F.col("rule_id").alias("code"), F.upper("category").alias("kind"), severity(F.col("category")).alias("severity"),
        path.alias("file_path"), place("start").alias("start"), place("end").alias("end"), "message", "note",
    )


def failed(reports: DataFrame) -> int:
    """The exit code: 1 if there is any report."""
    return int(not reports.isEmpty())
