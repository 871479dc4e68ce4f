"""Rulesets, reports, scopes, files, the session, the command line and streams."""

import json
import time

import pytest

from treeq import cli
from treeq.errors import ConfigError
from treeq.operators import reports, rules, scopes
from treeq.operators.aspects import Aspects, regex, resolve
from treeq.session import Cache, Session
from treeq.sources import files, parsed, project
from treeq.streaming import matches as streams

RULES = """
id: house_style
language: json
rules:
  - {id: shouting, message: all capitals, category: style, query: "match Text|Key s when s.text.matches(`^\\\"[A-Z]+\\\"$`)"}
  - {id: big_number, message: a large value, category: bug, query: "match Whole n when n.parent is Entry && n.text.to_int() > 1000"}
  - {id: mixed_list, message: several kinds, category: error, note: keep one kind, query: "match Array s when any s.data match Whole && any s.data match Text"}
"""
GOOD, BAD = '{"city": "Oslo", "size": 12}', '[{"city": "OSLO", "size": 4096},\n [1, "a"] ]'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "rules.yaml").write_text(RULES)
    (tmp_path / "good.json").write_text(GOOD)
    (tmp_path / "bad.json").write_text(BAD)
    return tmp_path


def config(folder, *include):
    (folder / "treeq.yaml").write_text(json.dumps([{"language": "json", "include": list(include), "rulesets": ["rules.yaml"]}]))
    return str(folder / "treeq.yaml")


def test_check(spark, folder, capsys):
    assert cli.main(["check", "--config", config(folder, "good.json")]) == 0
    assert cli.main(["check", "--config", config(folder, "*.json")]) == 1
    out = capsys.readouterr().out
    assert [line.split(":")[0] for line in out.splitlines() if "[" in line and "]:" in line] == ["error[mixed_list]", "bug[big_number]", "help[shouting]"]
    assert "bad.json:2:2" in out and "= keep one kind" in out and '2 │  [1, "a"] ]' in out
    (folder / "open.json").write_text('{"a": ')
    assert cli.main(["check", "--config", config(folder, "open.json")]) == 1
    assert "unexpected_eof: " in (out := capsys.readouterr().out) and "open.json:1:7: unexpected end of file" in out
    found = Session(spark).check(config(folder, "bad.json"))
    assert [r["rule_id"] for r in found.collect()] == ["mixed_list", "big_number", "shouting"] and reports.failed(found) == 1
    assert json.loads(reports.records(found, found["path"]).toJSON().first())["severity"] == "error"


def test_command_line(spark, folder, capsys, monkeypatch):
    assert cli.main(["query", "-l", "json", "-f", f"{folder}/*.json", "-e", f"{folder}/bad.json", "-q", "match Entry"]) == 0
    assert [line.split("good.json")[1] for line in capsys.readouterr().out.splitlines()] == [":1:2-1:15]", ":1:18-1:27]"]
    (folder / "x.json").write_text('{"a": ')
    assert cli.main(["parse", "--spec", "json", "--file", f"{folder}/good.json"]) == 0
    assert ". . . ● key: Key { \"city\" }" in capsys.readouterr().out
    assert cli.main(["parse", "--spec", "json", "--file", f"{folder}/x.json"]) == 1
    assert cli.main(["ruleset", "run", "--rulesets", f"{folder}/rules.yaml", "-f", f"{folder}/bad.json"]) == 1
    assert cli.main(["query", "-l", "json", "-f", f"{folder}/good.json", "-q", "match Nothing"]) == 2
    assert cli.main(["init", str(folder)]) == 0 and project.projects(project.load_yaml(folder / "treeq.yml"))[0].language == "json"
    assert project.discover(folder) == folder / "treeq.yml"
    for below in ("in/.treeq", "in/deep"):
        (folder / below).mkdir(parents=True)
    (folder / "in" / "treeq.yaml").write_text("[]")
    (folder / "in" / "deep" / "treeq.yaml").write_text("[]")
    assert project.discover(folder / "in" / "deep") == folder / "in" / "treeq.yaml"


def test_prompt(spark, capsys):
    forest = parsed.forest(spark.createDataFrame([(1, GOOD)], "tree long, text string"), parsed.builtin_spec("json"))
    lines = ["match Entry p;", "$0.key.text", "$0.key.text.length", "$0.parent.parent.parent", ":print $1", ":print_ast $1", ":print other.json", "$0.next_sibling == $1", "bad bad", ":quit", "never"]
    cli.prompt(Session(spark), forest, spark.createDataFrame([(1, "a/good.json", GOOD)], "tree long, path string, text string"), [*lines[:5], ":print good.json", *lines[5:]])
    out = capsys.readouterr().out.splitlines()
    assert out[:6] == ["$0: [Entry 1:2]", "$1: [Entry 1:18]", '"city"', "6", "null", '"size": 12']
    assert out[6] == GOOD and out[7:] == ["Entry {", '. ● key: Key { "size" }', '. ● datum: Whole { 12 }', "}", "error: other.json: no such files", "true", "error: expected the end at 1:5"]


def test_cache_forgets_and_fills_gaps():
    c = Cache()
    assert c.add([(1, 1), (1, 2)]) == [0, 1]
    for i in range(Cache.KEPT):
        c.add([(2, i)])
    assert "$0" not in c.nodes() and c.add([(3, 3)]) == [0]


def test_rulesets(spark, sf_dir):
    with pytest.raises(ConfigError):
        rules.RuleSet("x", "json", (rules.Rule("a", "", "bug", "match _"),) * 2)
    with pytest.raises(ConfigError):
        rules.Rule("a", "", "nonsense", "match _")
    with pytest.raises(ConfigError):
        rules.RuleSet.read({"id": "x"})


def test_files(spark, folder):
    found = files.sources(spark, ["*.json", "none/*.x"], ["bad*"], str(folder))
    assert [r["text"] for r in found.collect()] == [GOOD]
    assert files.sources(spark, ["none/*.x"], root=str(folder)).count() == 0
    assert project.location("repo.git#a/b.yaml")[0] == "git" and project.location("@me/set:1.2") == ("registry", "me", "set", "1.2") and project.location("a.yaml") == ("local", "a.yaml")
    for bad in ("rules.json", "@me/set"):
        with pytest.raises(ConfigError):
            project.load_yaml(project.local_path(bad, folder))
    (folder / "broken.yaml").write_text("a: [1,\nb: }")
    with pytest.raises(ConfigError, match=r"broken.yaml:2:"):
        project.load_yaml(folder / "broken.yaml")


def graph():
    g = scopes.ScopeGraph()
    a, b = g.add_scope(0), g.add_scope(0)
    c = g.add_scope(a)
    g.connect(c, b)
    g.add_decl(0, "x", 1)
    g.add_decl(a, "x", 2)
    g.add_decl(a, "x", 3)
    g.add_decl(b, "y", 4)
    g.add_decl(a, "y", 5)
    g.add_decl(0, "z", 6)
    return g, a, b, c


def test_scopes():
    g, a, b, c = graph()
    assert g.lookup(c, "x") == [2] and g.lookup(b, "x") == [1] and g.lookup(c, "y") == [5, 4] and g.lookup(c, "z") == [6, 6] and g.lookup(c, "w") == []
    g.add_ref(c, "x", 7)
    g.add_ref(c, "w", 8)
    g.add_ref(0, "x", 9)
    assert g.solve() == [(7, 2), (8, None)]


def test_scopes_as_tables(spark):
    g, a, b, c = graph()
    edges = [(t, s, p) for t in (1, 2) for s, ps in enumerate(g.parents) for p in ps]
    decls = [(t, s, k, n) for t in (1, 2) for s, own in enumerate(g.decls) for k, n in own]
    refs = [(1, s, k, 100 + 10 * s + i) for s in (a, b, c) for i, k in enumerate("xyzw")]
    got = scopes.solve(spark.createDataFrame(edges, "tree long, scope int, parent int"), spark.createDataFrame(decls, "tree long, scope int, name string, node int"), spark.createDataFrame(refs, "tree long, scope int, name string, node int"))
    want = [(1, n, d) for _, s, k, n in refs for d in (g.lookup(s, k) or [None])]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_scopes_deep_and_in_cycles(spark):
    g, last = scopes.ScopeGraph(), 0
    g.add_decl(0, "x", 1)
    for _ in range(67):
        last = g.add_scope(last)
    g.connect(last - 1, last)
    assert g.lookup(last, "x") == [1] and g.lookup(last, "w") == []
    edges = [(1, s, p) for s, ps in enumerate(g.parents) for p in ps]
    refs = [(1, last, "x", 7), (1, last, "w", 8), (1, last, None, 9)]
    got = scopes.solve(spark.createDataFrame(edges, "tree long, scope int, parent int"), spark.createDataFrame([(1, 0, "x", 1)], "tree long, scope int, name string, node int"), spark.createDataFrame(refs, "tree long, scope int, name string, node int"))
    assert sorted(map(tuple, got.collect())) == [(1, 7, 1), (1, 8, None), (1, 9, None)]


def test_aspects(spark):
    aspects = Aspects()

    @aspects("Entry", "sg_gen")
    def declare(node, scope):
        scope.add_decl(node.key.text, node)

    @aspects("Text", "sg_gen")
    def refer(node, scope):
        scope.add_ref(node.text, node)

    with pytest.raises(Exception):
        aspects("String", "other")(refer)
    f = parsed.forest(spark.createDataFrame([(1, '{"a": "b", "b": "c"}')], "tree long, text string"), parsed.builtin_spec("json"))
    found = resolve(f, aspects).query("match Text s when any s.referenced_decls() match { Entry m when m.datum.text == '\"c\"' }").collect()
    assert [r["text"] for r in found] == ['"b"']
    assert resolve(f, aspects).query("match Text s when s.referenced_decls().length == 0").count() == 1
    assert regex.compile("b+").match("abbb")[0] == "bbb"


SCRIPT = """
@Entry.sg_gen()
def declare(node, scope):
    scope.add_decl(node.key.text, node)

@Key.sg_gen()
def refer(node, scope):
    scope.add_ref(node.text, node)

def joined(a, b):
    return path.join(a, b), re.compile("b").match("abc")[0], yaml.loads("[1]")
"""


def test_scripts():
    from treeq.errors import TreeqError
    from treeq.operators.aspects import Script

    s = Script(SCRIPT)
    assert set(s.aspects.by_kind) == {("Entry", "sg_gen"), ("Key", "sg_gen")} and s.call("joined", "a", "b") == ("a/b", "b", [1])
    with pytest.raises(TreeqError):
        Script("@A.x()\n@B.x()\ndef f(): pass")
    with pytest.raises(TreeqError):
        s.call("nothing")


def test_language_stems(spark, folder):
    (folder / "own.syl").write_text(parsed.builtin_spec("json"))
    (folder / "own.py").write_text(SCRIPT)
    (folder / "own.yaml").write_text("id: own\nspec: own.syl\naspects: [own.py]\n")
    session = Session(spark)
    f = session.files(["good.json"], str(folder / "own.yaml"), root=str(folder))
    assert f.query("match Entry").count() == 2
    assert session.resolved(f, str(folder / "own.yaml")).query("match Key s when any s.referenced_decls() match Entry").count() == 2
    (folder / "bad.yaml").write_text("id: own\n")
    with pytest.raises(ConfigError):
        session.language(str(folder / "bad.yaml"))


def test_projects_are_detected(tmp_path):
    for name in ("a/setup.py", "a/sub/x.py", "a/sub/setup.py", "web/package.json", "web/src/i.js", "web/node_modules/m/package.json", "web/node_modules/m/i.js", "docs/c.yaml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    assert [(p["language"], p.get("root")) for p in project.detect(tmp_path)] == [("json", None), ("python", "a"), ("javascript", "web"), ("yaml", None)]
    assert cli.main(["init", str(tmp_path)]) == 0
    made = project.projects(project.load_yaml(tmp_path / "treeq.yml"))
    assert [(p.language, p.root) for p in made] == [("json", None), ("python", "a"), ("javascript", "web"), ("yaml", None)] and made[1].include == ("**/*.py",)


def test_methods_can_be_added(spark):
    from pyspark.sql import functions as F

    from treeq.plans import compiler

    compiler.METHODS["upper"] = lambda plan, value, args: compiler.Value("string", F.upper(value.col))
    try:
        f = parsed.forest(spark.createDataFrame([(1, GOOD)], "tree long, text string"), parsed.builtin_spec("json"))
        assert [r["text"] for r in f.query("match Key s when s.text.upper() == '\"CITY\"'").collect()] == ['"city"']
    finally:
        del compiler.METHODS["upper"]


def test_trees_written_out(spark):
    f = parsed.forest(spark.createDataFrame([(1, "[1, null]"), (2, "[]")], "tree long, text string"), parsed.builtin_spec("json"))
    out = {r["tree"]: r["rendered"] for r in reports.pretty_trees(f.nodes).collect()}
    assert out[1] == "Array {\n. ● data: List {\n. . Whole { 1 }\n. . Absent { null }\n. }\n}" and out[2] == "Empty { [] }"
    wrong = parsed.reports(spark.createDataFrame([(1, "[1"), (2, "[]"), (3, None)], "tree long, text string"), parsed.builtin_spec("json")).collect()
    assert [(r["tree"], r["code"], r["col"]) for r in wrong] == [(1, "unexpected_eof", 3)]


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("[1, 22, 3]")
    stream = spark.readStream.text(str(tmp_path / "in"), wholetext=True).select(F.xxhash64("value").alias("tree"), F.col("value").alias("text"))
    found = streams.matches(stream, parsed.builtin_spec("json"), "match Whole n when n.text.length > 1")
    q = found.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.txt").write_text("[44]")
    time.sleep(0.1)
    q.processAllAvailable()
    q.stop()
    assert sorted(r["text"] for r in spark.table("hits").collect()) == ["22", "44"]
    with pytest.raises(Exception):
        streams.matches(stream, parsed.builtin_spec("json"), "match Whole n when n.next_sibling != null")
    nested = streams.matches(stream, parsed.builtin_spec("json"), "match Whole n when any n.next_siblings() match { Whole m when m.text.to_int() > n.text.to_int() } && any n.parents() match Array", arrays=True)
    assert "Exchange" not in nested._jdf.queryExecution().analyzed().toString()
    q = nested.writeStream.format("memory").queryName("nested").option("checkpointLocation", str(tmp_path / "e")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["text"] for r in spark.table("nested").collect()) == ["1"]
    got = []
    q = streams.by_batches(stream, parsed.builtin_spec("json"), "match Whole n when n.next_sibling != null", lambda df, n: got.extend(r["text"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == ["1", "22"]


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_trees_are_neither_broadcast_nor_exchanged(spark, sf_dir):
    from treeq import catalogue

    for name in ("q66_partial_trees", "q85_python_names", "q76_aspects", "q55_guarded_by_axis"):
        plan = plan_of(catalogue.QUERIES[name](spark, sf_dir))
        assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    assert "Exchange" not in plan_of(catalogue.QUERIES["q66_partial_trees"](spark, sf_dir))


def test_one_large_tree_is_not_broadcast(spark, sf_dir):
    from treeq import catalogue

    for name in ("q79_parents_one_tree", "q81_count_above", "q78_descendants_one_tree", "q80_no_descendant_one_tree"):
        assert "BroadcastHashJoin" not in plan_of(catalogue.QUERIES[name](spark, sf_dir)), name


def test_trees_are_written_without_a_group_in_python_each(spark, sf_dir):
    from treeq.operators.reports import pretty, pretty_trees
    from treeq.sources import parsed

    texts = ['{"a": [1, {}, {"b": [[]]}], "c": {"d": null}}', "[]", '{"k": 1', "[[[]], [1]]"]
    made = parsed.forest(spark.createDataFrame(list(enumerate(texts)), "tree long, text string"), parsed.builtin_spec("json")).nodes
    written = pretty_trees(made)
    assert "InPandas" not in plan_of(written).replace("MapInPandas", "")
    rows = {}
    for r in made.orderBy("tree", "pre").collect():
        rows.setdefault(r["tree"], []).append(r.asDict())
    assert {r["tree"]: r["rendered"] for r in written.collect()} == {tree: pretty(own) for tree, own in rows.items()}


def test_aspects_get_many_trees_at_once(spark, sf_dir):
    from treeq import catalogue

    assert "FlatMapGroupsInPandas" not in plan_of(catalogue.QUERIES["q76_aspects"](spark, sf_dir))


def test_names_of_documents_exchange_no_words(spark, sf_dir):
    from treeq import catalogue

    for name in ("q83_names_as_tables", "q84_references_of_declarations"):
        assert "Exchange" not in plan_of(catalogue.QUERIES[name](spark, sf_dir)), name


def test_references_of_documents_exchange_whole_documents_only(spark, sf_dir):
    from treeq import catalogue

    for name in ("q40_unresolved", "q50_any_declaration"):
        plan = plan_of(catalogue.QUERIES[name](spark, sf_dir))
        assert all("doc_id" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line), name


def test_large_tables_are_dealt_out_in_bounded_shares(spark, tmp_path):
    from treeq.lineage import deal, shares

    spark.range(20_000).selectExpr("id", "uuid() AS text").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert shares(df, 1 << 30) == 4 < shares(df, 50_000) < 100
    assert deal(df, "id", shares(df, 50_000)).rdd.getNumPartitions() == shares(df, 50_000)


def test_excluded_files_are_told_by_their_path(spark, tmp_path):
    for name in ("r/a/x.json", "r/a/b+c d%/x.json", "r/a/b+c d%/y.json", "r/a/_in/.z.json", "r/a/[q]/x.json", "r/u.json", "r/v.txt", "s/k/p=1/x.json", "s/k/p=2/x.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    every = {"r": ["*", "a/*/*.json"], "s": ["k/*/*.json"]}
    for root, globs in {
        "r": ("*", "?.json", "{u,v}.*", "a/*/x.json", "a/b+*", "a/\\[q\\]/*", "*/[!k]*/[xy].json", "a", "{a/x,u}.json", "none*", "**/*", "[t-v].{json,txt}"),
        "s": ("k", "k/p=1", "*/p=2/*", "*/*/y*"),
    }.items():
        whole = {r["text"] for r in files.read(spark, files.rooted(str(tmp_path / root), every[root])).collect()}
        assert len(whole) == (6 if root == "r" else 2)
        for glob in globs:
            out = {r["text"] for r in files.read(spark, files.rooted(str(tmp_path / root), [glob])).collect()}
            assert {r["text"] for r in files.sources(spark, every[root], [glob], str(tmp_path / root)).collect()} == whole - out, glob
    assert [r["text"] for r in files.sources(spark, ["u.json", "?.json"], root=str(tmp_path / "r")).collect()] == ["r/u.json"]


def test_files_by_globs_are_neither_joined_nor_exchanged(spark, sf_dir):
    from treeq import catalogue

    plan = plan_of(catalogue.QUERIES["q86_glob_scan"](spark, sf_dir))
    assert "Exchange" not in plan and "Join" not in plan


def test_repeated_and_odd_pages_are_files_of_their_own(spark, tmp_path):
    from treeq import catalogue

    rows = [(5, "a"), (5, "a"), (5, "é"), (-3, None), (12, "no"), (None, "no"), (0, "")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = sorted(tuple(r) for r in catalogue.QUERIES["q86_glob_scan"](spark, str(tmp_path)).collect())
    assert found == [(-3, 1), (0, 1), (5, 2), (5, 2), (5, 3)]


def test_descendants_are_counted_before_they_are_exchanged(spark, sf_dir):
    from treeq import catalogue

    lines = plan_of(catalogue.QUERIES["q78_descendants_one_tree"](spark, sf_dir)).splitlines()
    # the words, last of the plan, meet no exchange before they are bits
    last = max(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert "partial_bit_or" in lines[last + 1] and any("posexplode(words" in line for line in lines[last:])


def test_counted_descendants_at_the_edges_of_bins(spark):
    from treeq.forest import Forest
    from treeq.syntax import Syntax

    rows = []

    def grow(depth: int, parent: int | None, place: int, sizes: tuple) -> int:
        """Node for node in pre-order; returns the last place."""
        own = len(rows)
        rows.append(None)
        wide = sizes[0][place % len(sizes[0])] if sizes else 0
        for i in range(wide):
            grow(depth + 1, own, i, sizes[1:])
        rows[own] = (0, own, len(rows) - 1, depth, parent, place, wide, None, "N", None)

    grow(0, None, 0, ((9,), (1, 62, 63, 64, 0, 65, 127), (0, 3, 130)))
    df = spark.createDataFrame(rows, "tree long, pre long, hi long, depth int, parent long, ord long, n long, field string, kind string, text string")
    f = Forest(df, Syntax.of(N=()))
    for bounds, least, most in (("depth = 1", 1, 1), ("depth = 2", 2, 2), ("depth = 3", 3, 3), ("max_depth = 2", 1, 2), ("min_depth = 2", 2, 9), ("min_depth = 3, max_depth = 2", 3, 2), ("max_depth = 0", 1, 0)):
        below = {n[1]: sum(n[1] < x[1] <= n[2] and least <= x[3] - n[3] <= most for x in rows) for n in rows if n[3] < 2}
        for wanted in {0, *list(below.values())[:3]}:
            found = f.query(f"match N n when n.descendants({bounds}).length == {wanted} && n.parents().length < 2")
            assert sorted(r["pre"] for r in found.select("pre").collect()) == [k for k, v in below.items() if v == wanted], (bounds, wanted)


def test_documents_are_put_in_one_tree_in_bounded_shares(spark, sf_dir, monkeypatch):
    from treeq.sources import tables

    docs = tables.table(spark, sf_dir, "documents")
    place = lambda made: sorted(map(tuple, made["documents"].select("doc_id", "base", "place", "size").collect()))
    whole = place(tables.shelved(docs))
    monkeypatch.setattr(tables, "SHELF", 20_000)
    frames, own = [], tables.ordered
    monkeypatch.setattr(tables, "ordered", lambda *a: frames.append(own(*a)) or frames[-1])
    assert place(tables.shelved(docs)) == whole and len(frames[0].inputFiles()) > 4


def test_repeated_documents_are_in_order_of_their_texts_in_one_tree(spark, sf_dir, monkeypatch):
    from treeq.lineage import Scratch
    from treeq.sources import tables

    long = "é" * 40
    rows = [(7, f"{long}{chr(122 - i)} w" if i % 2 else f"{i} {long}") for i in range(20)] + [(i, "a\nb") for i in range(5)] + [(None, "n"), (3, None)]
    docs = Scratch(spark, "docs").save(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    monkeypatch.setattr(tables, "SHELF", 200)
    made = tables.shelved(docs)
    by_place = [tuple(r) for r in made["documents"].orderBy("place").select("doc_id", "text", "place", "base").collect()]
    kept = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    base, wanted = 1, []
    for place, (doc_id, text) in enumerate(kept):
        wanted.append((doc_id, text, place, base))
        base += 1 + sum(1 + len(line.split(" ")) for line in text.split("\n"))
    assert by_place == wanted and tuple(made["root"].first()) == (len(kept), base - 1)


def test_excluded_documents_are_told_by_id_and_text(spark, duck, same, tmp_path):
    from treeq import catalogue

    name, at = "q38_include_exclude", str(tmp_path / "documents.parquet")
    rows = [(1, "a", "src1"), (1, "a", "src1"), (1, "b", "src0"), (2, "a", "src0"), (2, "a", "src1"), (2, "a", None), (3, None, "src0"), (3, None, "src2"), (4, None, "src2")]
    rows += [(4, "", "src0"), (5, "é", None), (5, "é", "src2"), (None, "a", "src0"), (None, "a", "src1"), (None, "b", "src1"), (None, None, "src1"), (6, "x" * 100000, "src1"), (7, "A", "src0"), (7, "A ", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(at)
    own = duck.cursor()
    own.sql(f"CREATE TEMP VIEW documents AS SELECT * FROM read_parquet('{at}/*.parquet')")
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    same(found, own.sql(catalogue.ORACLE_SQL[name]))
    assert found.count() == 7
    assert plan_of(found).count("Exchange hashpartitioning") == 1
