"""The library's front door: sources, languages, queries and checks in one place."""

from __future__ import annotations

from collections import OrderedDict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq import language as L
from treeq.forest import Forest
from treeq.operators import aspects, names, reports, rules
from treeq.plans.compiler import start
from treeq.sources import files, parsed, project
from treeq.spec.parse import rows


class Session:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.cache = Cache()

    def language(self, name: str) -> str:
        """The text of a specification: a built-in name, a local file or a stem that names one."""
        try:
            return parsed.builtin_spec(name)
        except FileNotFoundError:
            pass
        path = project.local_path(name)
        return project.stem(path).spec if path.suffix in (".yml", ".yaml") else path.read_text()

    def resolved(self, forest: Forest, name: str) -> Forest:
        """The forest with the references of a built-in language, or those that the aspects of a language's stem make."""
        if name in names.BUILTIN:
            return names.resolve(forest, names.BUILTIN[name])
        for script in project.stem(project.local_path(name)).aspects:
            forest = aspects.resolve(forest, aspects.Script(script).aspects)
        return forest

    def files(self, include: list[str], language: str, exclude: list[str] = (), root: str | None = None) -> Forest:
        found = files.sources(self.spark, list(include), list(exclude), root)
        return parsed.forest(found, self.language(language))

    def parse(self, text: str, language: str, start_rule: str = "main") -> tuple[str, list]:
        """One text's tree, written out, and what went wrong."""
        parser, _ = parsed.made_ready(self.language(language), start_rule)
        tree, wrong = parser.parse(text)
        return reports.pretty(rows(tree, text, parser)) if tree else "", wrong

    def check(self, config: str) -> DataFrame:
        """Reports of all projects of a configuration file, worst first."""
        found = None
        for sources, spec, sets in self.projects(config):
            own = rules.check(parsed.forest(sources, spec).written(), sets)
            own = own.join(sources.select("tree", "path"), "tree")
            found = own if found is None else found.unionByName(own)
        return reports.ordered(found)

    def errors(self, config: str) -> DataFrame:
        """``path, code, message, line, col`` of what couldn't be parsed in the projects of a configuration file."""
        found = None
        for sources, spec, _ in self.projects(config):
            own = parsed.reports(sources, spec).join(sources.select("tree", "path"), "tree")
            found = own if found is None else found.unionByName(own)
        return found.select("path", "code", "message", "line", "col").distinct().orderBy("path", "line", "col")

    def projects(self, config: str):
        """The sources, specification and rulesets of every project of a configuration file."""
        folder = Path(config).parent
        for p in project.projects(project.load_yaml(config)):
            root = str(folder / p.root) if p.root else str(folder)
            language = str(folder / p.language) if (folder / p.language).exists() else p.language
            sources = files.sources(self.spark, list(p.include), list(p.exclude), root)
            yield sources, self.language(language), [project.read_ruleset(project.local_path(r, folder)) for r in p.rulesets]

    def eval(self, forest: Forest, text: str):
        """The value of an expression over remembered nodes (``$0``), as text."""
        return evaluate(forest, text, self.cache.nodes())


class Cache:
    """Remembered result nodes by number; those of old results are forgotten."""

    KEPT = 10

    def __init__(self) -> None:
        self.generations: OrderedDict[int, list[int]] = OrderedDict()
        self.by_number: dict[int, tuple[int, int]] = {}
        self.next = 0

    def add(self, found: list[tuple[int, int]]) -> list[int]:
        """Numbers for the nodes of one result; the least free numbers are used first."""
        numbers, i = [], 0
        for key in found:
            while i in self.by_number:
                i += 1
            self.by_number[i] = key
            numbers.append(i)
        self.generations[self.next] = numbers
        self.next += 1
        while len(self.generations) > self.KEPT:
            for n in self.generations.popitem(last=False)[1]:
                del self.by_number[n]
        return numbers

    def nodes(self) -> dict[str, tuple[int, int]]:
        return {f"${i}": key for i, key in self.by_number.items()}


def evaluate(forest: Forest, text: str, bindings: dict) -> str:
    tree = L.parse_expr(text)
    used = {k: v for k, v in bindings.items() if k in L.names_in(tree)}
    plan, _ = start(forest, used)
    plan.df = plan.df.limit(1)
    v = plan.value(tree)
    if v.kind == "list":
        n = v.nodes.of
        at = plan.fresh()
        from treeq.plans.compiler import Ref

        x = Ref(at)
        condition = plan.related(n, x, v.nodes)
        found = plan.df.join(plan.named(at), condition).orderBy(x["pre"]).select(x["kind"], x["pre"]).collect()
        return "[" + ", ".join(f"{k}:{p}" for k, p in found) + "]"
    if v.kind == "node":
        row = plan.df.select(F.when(v.node.present, F.format_string("%s:%d", v.node["kind"], v.node["pre"]))).first()
    else:
        row = plan.df.select(v.col.cast("string")).first()
    return "null" if row is None or row[0] is None else row[0]
