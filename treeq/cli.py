"""Commands: ``init``, ``check``, ``parse``, ``query`` and ``ruleset run``; ``query -i`` is a prompt."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from treeq.errors import TreeqError
from treeq.operators import reports, rules
from treeq.session import Session
from treeq.sources import files, parsed, project

def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="treeq")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("init").add_argument("folder", nargs="?", default=".")
    commands.add_parser("check").add_argument("--config")
    parse = commands.add_parser("parse")
    parse.add_argument("--spec", required=True)
    parse.add_argument("--file", required=True)
    parse.add_argument("--rule", default="main")
    for p in (commands.add_parser("query"), commands.add_parser("ruleset").add_subparsers(dest="sub", required=True).add_parser("run")):
        p.add_argument("-f", "--files", action="append", required=True)
        p.add_argument("-e", "--exclude", action="append", default=[])
    query, run = commands.choices["query"], commands.choices["ruleset"]._subparsers._group_actions[0].choices["run"]
    query.add_argument("-l", "--language", required=True)
    query.add_argument("-q", "--query")
    query.add_argument("-i", "--interactive", action="store_true")
    run.add_argument("--rulesets", nargs="+", required=True)
    return top


def listed(found, sources):
    joined = found.join(sources.select("tree", "path"), "tree")
    lines = reports.listing(joined.orderBy("path", F.col("hi") - F.col("depth")), F.col("path"))
    return (r["line"] for r in lines.toLocalIterator())


def write_reports(found, sources) -> int:
    shown = reports.diagnostics(found.drop("path") if "path" in found.columns else found, sources)
    for r in shown.toLocalIterator():
        print(r["shown"], end="\n\n")
    return reports.failed(found)


def init(folder: str) -> int:
    """Writes a configuration with the projects that are found."""
    out = ["projects:" if (found := project.detect(folder)) else "projects: []"]
    for p in found:
        lead = "  - "
        for key, value in p.items():
            shown = json.dumps(value)  # also YAML
            out.append(f"{lead}{key}: {shown}")
            lead = "    "
    (Path(folder) / project.CONFIG[0]).write_text("\n".join(out) + "\n")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    if a.command == "init":
        return init(a.folder)
    spark = SparkSession.builder.appName("treeq").getOrCreate()
    session = Session(spark)
    try:
        if a.command == "parse":
            text = Path(a.file).read_text()
            shown, wrong = session.parse(text, a.spec, a.rule)
            for r in wrong:
                print(f"{r.code}: {r.message}")
            print(shown)
            return int(bool(wrong))
        if a.command == "check":
            config = a.config or project.discover()
            if not config:
                print("no configuration", file=sys.stderr)
                return 2
            wrong = 0
            for r in session.errors(str(config)).toLocalIterator():
                print(f"{r['code']}: {r['path']}:{r['line']}:{r['col']}: {r['message']}")
                wrong = 1
            found = session.check(str(config)).persist()
            paths = [r["path"].removeprefix("file:") for r in found.select("path").distinct().toLocalIterator()]
            return max(wrong, write_reports(found, files.sources(spark, paths)) if paths else 0)
        sources = files.sources(spark, a.files, a.exclude)
        if a.command == "ruleset":
            sets = [project.read_ruleset(r) for r in a.rulesets]
            codes = []
            for language in sorted({s.language for s in sets}):
                forest = parsed.forest(sources, session.language(language)).written()
                codes.append(write_reports(rules.check(forest, [s for s in sets if s.language == language]), sources))
            return max(codes)
        forest = parsed.forest(sources, session.language(a.language)).written()
        if a.interactive:
            return prompt(session, forest, sources)
        for line in listed(forest.query(a.query), sources):
            print(line)
        return 0
    except TreeqError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 2


def tree_at(sources, path: str) -> int:
    """The tree of the one file whose path ends so."""
    found = sources.filter(F.col("path").endswith(path)).select("tree").limit(2).collect()
    if len(found) != 1:
        raise TreeqError(f"{path}: {len(found) or 'no'} such files")
    return found[0]["tree"]


def prompt(session: Session, forest, sources, lines=sys.stdin) -> int:
    """``match ...`` lists and numbers nodes; ``:print``, ``:print_ast`` show one, or a file; else an expression."""
    for line in lines:
        line = line.strip().rstrip(";")
        try:
            if line in (":quit", ":q"):
                break
            if line.startswith((":print_ast ", ":print ")):
                word, name = line.split(None, 1)
                tree, pre = session.cache.nodes()[name] if name.startswith("$") else (tree_at(sources, name), 0)
                rows = forest.nodes.filter((F.col("tree") == tree) & (F.col("pre") >= pre)).orderBy("pre")
                top = rows.first()
                if word == ":print":
                    print(top["text"])
                else:
                    below = [r.asDict() | {"depth": r["depth"] - top["depth"]} for r in rows.filter(F.col("pre") <= top["hi"]).toLocalIterator()]
                    print(reports.pretty(below))
            elif line.startswith("match"):
                keys = forest.query(line, session.cache.nodes()).select("tree", "pre", "kind", "start_line", "start_col").orderBy("tree", "pre")
                rows = list(keys.toLocalIterator())
                for i, r in zip(session.cache.add([(r["tree"], r["pre"]) for r in rows]), rows):
                    print(f"${i}: [{r['kind']} {r['start_line']}:{r['start_col']}]")
            elif line:
                print(session.eval(forest, line))
        except (TreeqError, KeyError) as e:
            print(f"error: {e}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
