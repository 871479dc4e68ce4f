"""Queries over forests: small goldens, errors, and the catalogue against SQL."""

import pytest
from pyspark.sql import functions as F

from treeq import catalogue
from treeq.errors import CompileError
from treeq.functions.text import java_regex
from treeq.sources import parsed

SUITES = {
    # accounts with an owner and signed movements, an account to a line
    "ledger": (
        "node Ledger { accounts: List<Account> } node Account { owner: Owner, moves: List<Move> } node Owner { } node Move { } node Credit: Move { } node Debit: Move { }\n"
        "term NAME = `[A-Z][a-zé]*`\nterm AMOUNT = `[0-9]+`\nignore term GAP = ` +`\n"
        "rule main = Ledger { accounts@sepBy1(`\\n`, account) }\nrule account = Account { owner@owner ':' moves@some(move) }\nrule owner = Owner { NAME }\nrule move = Credit { '+' AMOUNT } | Debit { '-' AMOUNT }",
        "Ann: +20 -5 -5\nBé: -7\nCy: +10 +300",
    ),
    # boxes within boxes, a size in front; a lid is optional
    "boxes": (
        "node Box { size: Size, inside: Box, lid: Lid } node Size { } node Lid { }\nterm DIGITS = `[0-9]+`\n"
        "rule main = box\nrule box = Box { '(' size@size inside@box? lid@lid? ')' }\nrule size = Size { DIGITS }\nrule lid = Lid { '~' }",
        "(40(30(2)~))",
    ),
    "notes": ("node Sum { left: Num, right: Num } node Num { }\nterm DIGITS = `[0-9]+`\nignore term GAP = `\\s+`\ncomment term NOTE = `#[^\\n]*`\nrule main = Sum { left@num '+' right@num }\nrule num = Num { DIGITS }", "# top\n1 # one\n+ # plus\n2"),
}
GOLDEN = [
    # text, by value, order and bytes
    ("ledger", "match Debit d when d == '-5'", ["Debit 1:10-1:12", "Debit 1:13-1:14"]),
    ("ledger", "match Owner o when o.text >= 'B' && o.text < 'C'", ["Owner 2:1-2:2"]),
    ("ledger", "match Owner o when o.text.length == 3", ["Owner 1:1-1:3", "Owner 2:1-2:2"]),
    ("ledger", "match Move m when m.text.matches(`00?$`) && m.kind == m.previous_sibling?.kind", ["Credit 3:9-3:12"]),
    # lists and places in them
    ("ledger", "match Account a when a.moves.length < a.parent.length", ["Account 2:1-2:6", "Account 3:1-3:12"]),
    ("ledger", "match Account a when a.moves[0] is Debit", ["Account 2:1-2:6"]),
    ("ledger", "match Account a when a.moves.length > 1 && a[1][0].text.length < a[1][1].text.length", ["Account 3:1-3:12"]),
    # quantifiers, one inside the other and beside others
    ("ledger", "match Owner o when o.parent is { Account a when no a.moves match { Credit c when c.text.length > 2 } }", ["Owner 2:1-2:2"]),
    ("ledger", "match Account a when all a.moves match { Move m when m.next_sibling == null || m.next_sibling.text.length >= m.text.length }", ["Account 2:1-2:6", "Account 3:1-3:12"]),
    ("ledger", "match Ledger l when any l.accounts match { Account a when all a.moves match { Debit d when d.previous_sibling == null } }", ["Ledger 1:1-3:12"]),
    ("ledger", "match Debit d when any d.siblings() match { Move m when m.text == d.text }", ["Debit 1:10-1:12", "Debit 1:13-1:14"]),
    # what isn't there
    ("boxes", "match Box b when b.inside == null", ["Box 1:7-1:9"]),
    ("boxes", "match Box(lid: '~')", ["Box 1:4-1:11"]),
    ("boxes", "match Box b when b.inside?.lid?.text?.length == 1", ["Box 1:1-1:12"]),
    # up and down by steps
    ("boxes", "match Size s when any s.parents(min_depth = 2) match { Box b when b.size.text == '30' }", ["Size 1:8-1:8"]),
    ("boxes", "match Box b when b.descendants(depth = 2).length == 1", ["Box 1:4-1:11"]),
    ("boxes", "match Box b when b.parents().length == 1 && no b.descendants(max_depth = 1) match { Size s when s.text.length < 2 }", ["Box 1:4-1:11"]),
    ("boxes", "match Lid l when l.previous_sibling?.inside == null && l.parent.parent.lid == null", ["Lid 1:10-1:10"]),
    ("notes", "match Comment", ["Comment 1:1-1:5", "Comment 2:3-2:7", "Comment 3:3-3:8"]),
    ("notes", "match Comment c when c.parent is Num", ["Comment 2:3-2:7"]),
    ("notes", "match Sum s when s.children.length == 4 && s.left.children[0] == '# one'", ["Sum 2:1-4:1"]),
]

def forest(spark, suite):
    spec, text = SUITES[suite]
    return parsed.forest(spark.createDataFrame([(1, text), (2, None)], "tree long, text string"), spec)


def listed(df):
    at = F.format_string("%s %d:%d-%d:%d", "kind", "start_line", "start_col", "end_line", "end_col")
    return [r[0] for r in df.orderBy(F.col("hi") - F.col("depth")).select(at).collect()]


@pytest.mark.parametrize(("suite", "query", "want"), GOLDEN)
def test_golden(spark, suite, query, want):
    assert listed(forest(spark, suite).query(query)) == want


@pytest.mark.parametrize(
    ("query", "code"),
    [
        ("match Crate", "InvalidKind"), ("match List<Size>", "InvalidKind"), ("match Size s when t == 1", "UnknownIdentifier"), ("match Size s when s.weight == 1", "InvalidPropertyName"),
        ("match Size s when s.open()", "InvalidPropertyName"), ("match Size s when s.text.matches()", "UnexpectedArity"), ("match Size s when s.text.to_int(1) == 1", "UnexpectedArity"),
        ("match Size s when s.parents(1).length == 1", "UnexpectedArg"), ("match Size s when s.parents(depth = 1, b = 2, c = 3).length == 1", "UnexpectedArity"),
        ("match Size s when s.parents()[0] == null", "IndexError"), ("match Size s when s.text < 1", "InvalidKind"), ("match Size s when s.text", "InvalidKind"), ("match Size s when any s.text match Size", "InvalidKind"),
        ("match Size s when any s.children match { Lid inner } && inner == null", "UnknownIdentifier"),
    ],
)
def test_compile_errors(spark, query, code):
    with pytest.raises(CompileError) as e:
        forest(spark, "boxes").query(query)
    assert e.value.code == code


@pytest.mark.parametrize(
    "query",
    ["match Box b when b.lid.text == '~'", "match Size s when s.lid == null", "match Box b when b[2] == '~'", "match Lid l when l.text.to_int() == 1", "match Size s when s.length == 1", "match Box([2]: Lid)"],
)
def test_strict_forests_fail_and_lenient_ones_do_not(spark, query):
    f = forest(spark, "boxes")
    with pytest.raises(Exception, match="InvalidKind|InvalidField|IndexError|NotAnInt"):
        f.query(query).collect()
    f.lenient().query(query).collect()


def test_left_sides_guard_right_sides(spark):
    assert listed(forest(spark, "boxes").query("match Box b when b.lid != null && b.lid.text == '~'")) == ["Box 1:4-1:11"]
    assert len(listed(forest(spark, "boxes").query("match Box b when b.lid == null || b.lid.text == '~'"))) == 3


@pytest.mark.parametrize(
    ("query", "texts"),
    [
        ("match Scalar|Key n when n.parent is List && n.text.to_int() > 1", ["2"]),
        ("match Scalar|Key n when any n.parents() match Array && n.text.to_int() > 1", ["2"]),
        ("match Scalar|Key n when n.parent is List && n.text.to_int() > 0 && n.previous_sibling != null", ["2"]),
        ("match Scalar|Key n when n.parent is Entry || n.text.to_int() == 2", ['"j"', '"k"', '"x"', "2"]),
        ("match Array s when any s.data match { _ n when n.text.to_int() == 2 }", ["[1, 2]"]),
        ("match Entry p when p.datum is Array && any p.datum.children match { _ l when any l.children match { _ n when n.text.to_int() == 2 } }", ['"k": [1, 2]']),
        ("match Entry(datum: Array) p when all p.datum.data match { _ n when n.text.to_int() < 3 }", ['"k": [1, 2]']),
    ],
)
def test_what_is_excluded_raises_nothing(spark, query, texts):
    f = parsed.forest(spark.createDataFrame([(1, '{"k": [1, 2], "j": "x"}')], "tree long, text string"), parsed.builtin_spec("json"))
    assert sorted(r["text"] for r in f.query(query).collect()) == texts


def test_rules_guard_too(spark):
    from treeq.operators.rules import Rule, RuleSet, check

    f = parsed.forest(spark.createDataFrame([(1, '{"k": [1, 2], "j": "x"}')], "tree long, text string"), parsed.builtin_spec("json"))
    rules = RuleSet("r", "json", (Rule("far", "far", "bug", "match Scalar|Key n when any n.parents() match Array && n.text.to_int() > 1"), Rule("here", "here", "bug", "match Scalar|Key n when n is Whole && n.text.to_int() > 1")))
    assert [(r["rule_id"], r["kind"]) for r in check(f, [rules]).orderBy("rule_id").collect()] == [("far", "Whole"), ("here", "Whole")]


def test_second_depth_argument_is_the_most(spark):
    f = forest(spark, "ledger")
    assert f.query("match Credit c when c.parents(min_depth = 2, foo = 3).length == 2").count() == 3


def random_tree(spark, size, seed):
    """A forest of one tree whose nodes hang at random on earlier ones on the way to the last, so that it gets deep."""
    import random

    from treeq.forest import NODE, Forest
    from treeq.syntax import Syntax

    rng = random.Random(seed)
    path, rows = [0], [[1, 0, 0, 0, None, None, 0, None, "A", "0"]]
    for pre in range(1, size):
        path = path[: rng.randrange(max(1, len(path) - 3), len(path) + 1)]
        up = rows[path[-1]]
        rows.append([1, pre, pre, len(path), path[-1], up[6], 0, None, rng.choice("ABC"), str(pre % 7)])
        up[6] += 1
        for p in path:
            rows[p][2] = pre
        path.append(pre)
    schema = ", ".join(f"{k} {v}" for k, v in NODE.items())
    return Forest(spark.createDataFrame([tuple(r) for r in rows], schema), Syntax.of(A=(), B=(), C=()), "random", strict=False)


AXES = [
    "match A a when any a.descendants() match { B b when b.text == '3' }", "match A a when no a.descendants(depth = 2) match C", "match B b when all b.parents() match { A|C n when n.text != '5' }",
    "match C c when any c.parents(min_depth = 2, max_depth = 5) match { A a when a.text == c.text }", "match A a when any a.descendants(max_depth = 3) match { _ n when n.text == a.text && n.kind != a.kind }",
    "match _ n when n.descendants(min_depth = 2).length > 3 || any n.parents(depth = 1) match C", "match _ n when n.descendants(max_depth = 4).length == 6", "match _ n when !any n.parents(depth = 3) match A || any n.descendants(depth = 1) match B",
    "match B b when any b.parents(min_depth = 3) match { A a when any a.descendants(depth = 4) match C }", "match _ n when any n.descendants(min_depth = 3, max_depth = 2) match _",
]


@pytest.mark.parametrize("query", AXES)
def test_bins_change_nothing(spark, query, monkeypatch):
    """One bin for a whole tree is the plain join of all pairs in it."""
    from treeq.plans import compiler

    f = random_tree(spark, 400, 3)
    answers = []
    for width in (1 << 40, 128, 5, 1):
        monkeypatch.setattr(compiler, "BIN", width)
        answers.append(sorted(r["pre"] for r in f.query(query).select("pre").collect()))
    assert all(a == answers[0] for a in answers)


@pytest.mark.parametrize("strict", [False, True])
def test_rules_together_find_what_each_finds_alone(spark, strict):
    """All rules in one plan against a plan for each."""
    from dataclasses import replace

    from treeq.operators.rules import Rule, RuleSet, check

    f = replace(random_tree(spark, 300, 8), strict=strict)
    queries = [*AXES, "match B b when any b.next_siblings() match { C c when any c.children match A }", "match _ n when no n.previous_siblings(min_depth = 2) match B && any n.children match { A a when a.text != '0' }",
               "match A|B n when all n.children match { _ c when c.next_sibling == null || any c.next_siblings() match C }", "match C c when any c.siblings() match { A a when a.text == '1' } || c.parent?.parent?.text == '2'"]
    found = check(f, [RuleSet("r", "random", tuple(Rule(str(i), "m", "bug", q) for i, q in enumerate(queries)))])
    alone = [(str(i), r["hi"] - r["depth"]) for i, q in enumerate(queries) for r in f.query(q).select("hi", "depth").collect()]
    assert sorted((r["rule_id"], r["node_id"]) for r in found.select("rule_id", "node_id").collect()) == sorted(alone)


@pytest.mark.parametrize("query", AXES)
def test_array_form(spark, query):
    from treeq.plans.arrays import packed

    f = random_tree(spark, 250, 6)
    key = lambda df: sorted(r["pre"] for r in df.select("pre").collect())
    assert key(packed(f).query(query)) == key(f.query(query))


@pytest.mark.parametrize(("suite", "query", "want"), [g for g in GOLDEN if g[0] != "notes"])
def test_golden_in_array_form(spark, suite, query, want):
    from treeq.plans.arrays import packed

    f = forest(spark, suite)
    assert packed(f).query(query).count() == len(want)
    plan = packed(f).query(query)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_array_form_raises_where_rows_do(spark):
    from dataclasses import replace

    from treeq.plans.arrays import packed

    trees = packed(forest(spark, "boxes"))
    for query in ("match Box b when b.lid.text == '~'", "match Size s when s.lid == null", "match Box b when b[2] == '~'", "match Lid l when l.text.to_int() == 1", "match Box([2]: Lid)"):
        with pytest.raises(Exception, match="InvalidKind|InvalidField|IndexError|NotAnInt"):
            trees.query(query).collect()
        replace(trees, strict=False).query(query).collect()


def test_rules_join_an_axis_once(spark, sf_dir):
    plan = catalogue.order_reports(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # children, their field, the next and the upper ones, the rule's own field
    assert sum(line.strip(" :+-").startswith("Join") for line in plan.splitlines()) <= 7


def test_a_large_tree_is_dealt_out(spark):
    """A tree of a million nodes: pairs that meet stay in proportion, and many tasks have a part."""
    from treeq.forest import NODE, Forest
    from treeq.syntax import Syntax

    n = 1_000_000  # a root, thousands below it with 9 each, and 10 leaves below each of these
    i = F.col("id")
    leaf = (i % 111) - 1
    kind = F.when(i == n, "R").when(i % 111 == 0, "A").when(leaf % 11 == 0, "B").otherwise("C")
    pre = F.when(i == n, 0).otherwise(i + 1)
    hi = F.when(i == n, n).when(kind == "A", F.least(i + 111, F.lit(n))).when(kind == "B", F.least(i + 11, F.lit(n))).otherwise(i + 1)
    depth = F.when(i == n, 0).when(kind == "A", 1).when(kind == "B", 2).otherwise(3)
    parent = F.when(i == n, None).when(kind == "A", 0).when(kind == "B", i - i % 111 + 1).otherwise(i - leaf % 11 + 1)
    given = {"tree": F.lit(1), "pre": pre, "hi": hi, "depth": depth, "parent": parent, "ord": F.lit(0), "n": F.lit(0), "field": F.lit(None), "kind": kind, "text": F.lit("")}
    f = Forest(spark.range(n + 1).select(*[given[k].cast(v).alias(k) for k, v in NODE.items()]), Syntax.of(R=(), A=(), B=(), C=()), "large").written()
    assert f.query("match A a when any a.descendants(depth = 2) match C").count() == n // 111  # the last has no leaves
    assert f.query("match C c when any c.parents() match A").count() == f.nodes.filter("kind = 'C'").count()
    plan = f.query("match C c when any c.parents() match A")._jdf.queryExecution().executedPlan().toString()
    assert "bin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_places_beyond_32_bits(spark):
    from treeq.forest import NODE, Forest
    from treeq.syntax import Syntax

    far = 1 << 33
    rows = [(1, 0, far + 3, 0, None, None, 2, None, "A", "a"), (1, far, far + 1, 1, 0, 0, 1, None, "B", "b"), (1, far + 1, far + 1, 2, far, 0, 0, None, "C", "c"), (1, far + 2, far + 3, 1, 0, 1, 1, None, "B", "d"), (1, far + 3, far + 3, 2, far + 2, 0, 0, None, "C", "e")]
    f = Forest(spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in NODE.items())), Syntax.of(A=(), B=(), C=()), "far")
    assert [r["text"] for r in f.query("match B b when any b.descendants() match { C c when c.text == 'e' }").collect()] == ["d"]
    assert f.query("match C c when c.parent.parent.descendants().length > 8589934590 && any c.parents(depth = 1) match B").count() == 2


def test_kept_tables_belong_to_a_plan(spark, tmp_path):
    spec = parsed.builtin_spec("json")
    spark.createDataFrame([(i, f"[{i}]") for i in range(6)], "tree long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    read = lambda: spark.read.parquet(str(tmp_path / "t"))
    numbers = lambda df: sorted(int(r["text"]) for r in parsed.once(df, spec, "x").query("match Whole").collect())
    assert numbers(read().filter("tree < 2")) == [0, 1]
    assert numbers(read().filter("tree >= 2")) == [2, 3, 4, 5]  # another plan over the same file
    assert numbers(read().selectExpr("tree", "'[7]' AS text").limit(1)) == [7]
    assert numbers(spark.createDataFrame([(1, "[1]")], "tree long, text string")) == [1]
    assert numbers(spark.createDataFrame([(1, "[1,2,3]")], "tree long, text string")) == [1, 2, 3]  # frames without files
    first, again = (parsed.once(read().filter("tree < 2"), spec, "x").nodes.inputFiles() for _ in range(2))
    assert first == again


def test_regex_dialect(spark):
    ask = lambda p, text: spark.range(1).select(F.rlike(F.lit(text), F.lit(java_regex(p)))).first()[0]
    assert not ask("a$", "a\n") and ask("a$", "ba") and ask(r"^\w\z", "é") and ask("(?m)a$", "a\nb") and ask("(?P<x>a)", "a") and ask("[$]", "$") and ask(r"\$", "$") and ask("a(?=b)", "ab")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, sf_dir, duck, same, name):
    same(catalogue.QUERIES[name](spark, sf_dir), duck.sql(catalogue.ORACLE_SQL[name]))


def test_kinds_prune_the_scan(spark, sf_dir):
    plan = catalogue.tables.conversations(spark, sf_dir).query("match Turn(role: 'user')")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "PushedFilters" in plan


def test_names_in_deep_scopes(spark):
    """Ten thousand scopes, one in the other: a reference on each level means the nearest declaration above it."""
    from treeq.operators.names import solve

    n = 10_000
    i = F.col("id")
    # level i: scope at 3i, its declaration at 3i + 1 and its reference at 3i + 2; each scope ends with the last node
    scopes = spark.range(n).select(F.lit(1).cast("long").alias("tree"), (3 * i).alias("pre"), F.lit(3 * n).cast("long").alias("hi"), i.cast("int").alias("depth"))
    decls = spark.range(n).filter("id % 100 = 7 OR id = 0").select(F.lit(1).cast("long").alias("tree"), (3 * i + 1).alias("node"), i.alias("last"), F.when(i == 0, "top").otherwise("x").alias("name"))
    refs = spark.range(n).select(F.lit(1).cast("long").alias("tree"), (3 * i + 2).alias("node"), F.when(i % 2 == 0, "x").when(i % 3 == 0, "top").otherwise("none").alias("name"))
    context = spark.sparkContext
    context.setJobGroup("names", "names")
    got = {(r["ref"] - 2) // 3: r["decl"] for r in solve(scopes, decls, refs).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("names"))
    context.setJobGroup("", "")
    for level in range(n):
        nearest = (level - 7) // 100 * 100 + 7
        want = 1 if level % 2 and level % 3 == 0 else 3 * nearest + 1 if level % 2 == 0 and nearest > 0 else None
        assert got[level] == want, level
    assert jobs < 20


def test_names_against_the_search_by_levels(spark):
    """Random scopes: one join against the breadth-first search along parents."""
    from treeq.operators import names, scopes

    f = random_tree(spark, 500, 4)
    naming = names.Naming((("match B b", "b.text"),), (("match C c", "c.text"), ("match B b when b.text == '3'", "b.text")), ("match A",))
    got = names.resolve(f, naming)
    nodes = [r.asDict() for r in f.nodes.orderBy("pre").collect()]
    above = lambda r: next((p for p in iter_up(nodes, r) if nodes[p]["kind"] == "A"), -1)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = frame([(1, r["pre"], above(r)) for r in nodes if r["kind"] == "A"], "tree long, scope long, parent long")
    last = lambda r: r["hi"] - r["depth"]
    decls = frame([(1, above(r), r["text"], last(r)) for r in nodes if r["kind"] == "B"], "tree long, scope long, name string, node long")
    refs = frame([(1, above(r), r["text"], r["pre"]) for r in nodes if r["kind"] == "C" or r["kind"] == "B" and r["text"] == "3"], "tree long, scope long, name string, node long")
    by_last = {last(r): r["pre"] for r in nodes}
    want = sorted((r["ref"], by_last.get(r["decl"], -1)) for r in scopes.solve(edges, decls, refs).collect())
    assert sorted((r["ref"], -1 if r["decl"] is None else r["decl"]) for r in got.refs.collect()) == want
    counts = {r["decl"]: r["refs"] for r in names.referring(got).collect()}
    assert sum(counts.values()) == sum(d >= 0 for _, d in want)


def iter_up(nodes, row):
    while row["parent"] is not None:
        yield row["parent"]
        row = nodes[row["parent"]]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_buckets_need_no_exchange(spark, sf_dir):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("q20_any", "q22_all", "q23_nested_any", "q27_descendants_depth"):
            assert exchanges(catalogue.QUERIES[name](spark, sf_dir)) == 0
        f = catalogue.tables.conversations(spark, sf_dir).bucketed(4)
        for name in ("q13_parent_is", "q14_previous_sibling", "q24_outer_reference", "q44_negated_any"):
            found = f.query(catalogue.PATTERNS[name][1])
            assert exchanges(found) == 0
            assert sorted(catalogue.found(found).collect()) == sorted(catalogue.QUERIES[name](spark, sf_dir).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_missing_parent_or_previous_sibling_needs_no_join(spark, sf_dir):
    from treeq.sources import tables

    forest = tables.documents(spark, sf_dir)
    for text, kind, least in (("match _ n when n.parent == null", "Document", 0), ("match Word w when null != w.previous_sibling", "Word", 1)):
        made = forest.query(text)
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
        want = forest.nodes.filter(f"kind = '{kind}'").filter("parent IS NULL" if not least else "ord > 0")
        assert made.count() == want.count() > 0
    turns = tables.conversations(spark, sf_dir)
    assert turns.lenient().query("match Turn t when t.parent.previous_sibling == null").count() == turns.query("match Turn").count()
    assert turns.query("match Conversation c when c.parent?.previous_sibling == null").count() == turns.query("match Conversation").count()
    with pytest.raises(Exception, match="null has no previous_sibling"):
        turns.query("match Conversation c when c.parent.previous_sibling == null").count()
