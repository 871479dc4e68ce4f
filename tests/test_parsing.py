"""Specifications, scanning and trees."""

import pytest

from treeq.errors import SpecError
from treeq.sources.parsed import builtin_spec, columns, forest, made_ready, trees
from treeq.spec.meta import read_spec
from treeq.spec.parse import Parser, Scanner, rows

SUMS = """
node E { }  node Num: E { }  node Bin: E { left: E, right: E }
term NUM = `[0-9]+`
ignore term SPACE = `[ \\n]+`
comment term NOTE = nested(start='(*', end='*)')
rule main = expr
rule expr = [1,left] Bin { left@expr ['+','-'] right@expr } | [2,right] Bin { left@expr ['*','/'] right@expr } | Num { NUM } | inner
rule inner = E { '(' expr ')' }
"""


def shape(parser, text):
    tree, wrong = parser.parse(text)
    assert not wrong

    def show(t):
        parts = [show(c) for c in t.children if c.kind != "Comment"]
        return f"[{' '.join(parts)}]" if parts else text[t.start : t.end]

    return show(tree)


def test_levels_and_sides():
    p = Parser(read_spec(SUMS))
    cases = {"1+2+3": "[[1 2] 3]", "1*2*3": "[1 [2 3]]", "1+2*3": "[1 [2 3]]", "1*2+3": "[[1 2] 3]", "(1+2)*3": "[[[1 2]] 3]", "1 - 2 (* no *) - 3*4": "[[1 2] [3 4]]"}
    for text, want in cases.items():
        assert shape(p, text) == want


def lists(component):
    return Parser(read_spec(f"node P {{ xs: List<X> }} node X {{ }} term A = `a`\nrule main = P {{ xs@{component} }}\nrule x = X {{ A }}"))


@pytest.mark.parametrize(
    ("component", "good", "bad"),
    [
        ("sepBy(',', x)", {"": 0, "a": 1, "a,a,a": 3}, ["a,", ",a"]),
        ("sepBy1(',', x)", {"a": 1, "a,a": 2}, ["", "a,"]),
        ("sepByTr(',', x)", {"": 0, "a": 1, "a,": 1, "a,a,": 2}, [",", "a,,"]),
        ("sepByTr1([',', ';'], x)", {"a": 1, "a;": 1, "a,a;a": 3}, ["", ","]),
        ("many(x)", {"": 0, "aaa": 3}, ["b"]),
        ("some(x)", {"a": 1, "aaa": 3}, [""]),
        ("x*", {"": 0, "aa": 2}, ["ab"]),
        ("x+", {"aa": 2}, [""]),
    ],
)
def test_lists(component, good, bad):
    p = lists(component)
    for text, n in good.items():
        tree, wrong = p.parse(text)
        assert not wrong and tree.children[0].kind == "List" and len(tree.children[0].children) == n
    for text in bad:
        assert p.parse(text)[1]


def test_optionals():
    p = Parser(read_spec("node B { first: A, second: A } node A { }\nrule main = B { first@a second@a? 'x' }\nrule a = A { 'a' }"))
    one, two = p.parse("ax")[0], p.parse("aax")[0]
    assert [c.label for c in one.children] == ["first"] and [c.label for c in two.children] == ["first", "second"]


def test_literals_beat_patterns_and_longer_wins():
    s = Scanner(read_spec("node X { } term ID = `[a-z]+`\nterm IF = 'if'\nrule main = X { IF } | X { ID }"))
    assert s.best(["ID", "IF"], "if x", 0) == {"IF": 2} and s.best(["ID", "IF"], "iffy", 0) == {"ID": 4}


def test_nested_openers_count_right_behind_a_match():
    s = Scanner(read_spec("node X { } comment term C = nested(start='(*', end='*)')\nrule main = X { 'x' }"))
    assert s.match("C", "(*(* a *) b *) c", 0) == 14
    assert s.match("C", "(* a (* b *) c *)", 0) == 12
    assert s.match("C", "(* open", 0) is None


def test_positions():
    p = Parser(read_spec(SUMS))
    text = "1 +\n 22  "
    first, left, right = rows(p.parse(text)[0], text, p)
    assert (first["text"], first["start_col"], first["end_line"], first["end_col"], first["end_off"]) == ("1 +\n 22", 1, 2, 5, 9)
    assert (left["field"], left["end_col"], right["field"], right["start_line"], right["start_col"], right["start_off"]) == ("left", 2, "right", 2, 2, 5)


def test_errors():
    p = Parser(read_spec(builtin_spec("json")))
    tree, wrong = p.parse('{"a": 1')
    assert wrong[0].code == "unexpected_eof" and tree.kind == "Entry"
    assert p.parse('{"a": }')[1][0].at == 6
    for bad, code in (
        ("node A { } node A { } rule main = A { 'x' }", "MultipleDecl"),
        ("rule main = A { 'x' }", "MissingDecl"),
        ("node A { } rule main = A { b }", "MissingDecl"),
        ("node A { } rule other = A { 'x' }", "MissingDecl"),
        ("term X = `a*`", "Regex"),
        ("node A { } rule main = A { x@wrong(a) }", "InvalidCall"),
    ):
        with pytest.raises(SpecError) as e:
            read_spec(bad)
        assert e.value.code == code


def test_a_long_list():
    text = "[" + ",".join(map(str, range(3000))) + "]"
    p = Parser(read_spec(builtin_spec("json")))
    assert rows(p.parse(text)[0], text, p)[0]["hi"] == 3001


def test_deep_nesting():
    text = "[" * 10_000 + "]" * 10_000
    p = Parser(read_spec(builtin_spec("json")))
    assert rows(p.parse(text)[0], text, p)[-1]["depth"] == 19_998


def test_comments_are_children():
    p = Parser(read_spec(SUMS))
    text = "(* é *) 1 (* one *) + (2 (* two *) * 3) (* end *)"
    found = rows(p.parse(text)[0], text, p)
    notes = [(r["text"], found[r["parent"]]["kind"], r["ord"], r["start_off"], r["end_off"]) for r in found if r["kind"] == "Comment"]
    assert notes == [("(* é *)", "Bin", 0, 0, 8), ("(* one *)", "Num", 0, 11, 20), ("(* two *)", "Num", 0, 26, 35), ("(* end *)", "E", 1, 41, 50)]
    assert [r["n"] for r in found if r["kind"] == "Bin"] == [3, 2]


JAVASCRIPT = [
    ("a + b * c ** d ** e - f", "[[a + [b * [c ** [d ** e]]]] - f]"),
    ("a && b || c ?? d", "[[[a && b] || c] ?? d]"),
    ("x = y ? z : w", "[x [y z w]]"),
    ("!a.b(c)[d]", "[! [[[a b] [[c]]] d]]"),
    ("new T(1).x", "[[T [[1]]] x]"),
    ("(a, b) => a < b", "[[[a b]] [a < b]]"),
]


@pytest.mark.parametrize(("text", "want"), JAVASCRIPT)
def test_javascript_expressions(text, want):
    parser = Parser(read_spec(builtin_spec("javascript")))
    tree, wrong = parser.parse(text)
    show = lambda t: f"[{' '.join(map(show, t.children))}]" if t.children else text[t.start : t.end]
    assert not wrong and show(tree) == f"[[[{want}]]]"


def test_javascript_program():
    """Every statement of the grammar, with nested lists."""
    text = """
import d from 'm'; import { a as b, c, } from "n"; export function f(x = 1, [y, { z: w }], ...r) { return x + r[0] /* r */; }
export default class_; // a name
class K extends f.g { constructor(a) { super(a); } static s() { } get v() { return this.x; } q = 1; }
let i = 0, { j, k: [l] } = o; var m; const t = `${i}`;
if (i === 1) { } else if (j) ; else { throw new E('x'); }
for (let n = 0; n < 3; n++) { continue; } for (const p of s) { break; }
while (!i) { i += 1; } do { j--; } while (j >= 0);
switch (i) { case 1: f(); default: g(...h, y => ({ a: 1, b, [c]: 2, d() { }, ...e })); }
try { a?.b; } catch (e) { } finally { debugger; }
outer: while (true) { break outer; }
"""
    parser = Parser(read_spec(builtin_spec("javascript")))
    tree, wrong = parser.parse(text)
    found = rows(tree, text, parser)
    kinds = {r["kind"] for r in found}
    assert not wrong and len(parser.grammar.rules) > 70 and sum(map(len, parser.grammar.rules.values())) > 200
    assert {"ImportStatement", "ExportStatement", "ClassDeclaration", "MethodDefinition", "ForInStatement", "SwitchDefault", "FinallyClause", "LabeledStatement", "RestPattern", "SpreadElement", "Comment"} <= kinds
    assert [r["n"] for r in found if r["kind"] == "List" and r["parent"] == 0] == [16]


def test_python_trees():

    language, syntax = made_ready("builtin:python", "main")
    text = "class A(B):\n    def f(self, é=1):  # note\n        return not é.x[0] == -y\n"
    tree, wrong = language.parse(text)
    found = rows(tree, text, language)
    assert not wrong and {r["kind"] for r in found} <= set(syntax.kinds)
    assert [(r["kind"], r["text"]) for r in found if r["field"] == "name"] == [("Identifier", "A"), ("Identifier", "f")]
    assert [r["text"] for r in found if r["kind"] in ("Comment", "Attribute", "UnaryOperator")] == ["# note", "not é.x[0] == -y", "é.x", "-y"]
    assert language.parse("def (:")[1][0].code == "unexpected_token"


def test_yaml_trees():
    pytest.importorskip("yaml")

    language, syntax = made_ready("builtin:yaml", "main")
    text = "a: {b: 'x', c: [1, 2.5]}\nd:\n- true\n- é\n---\n|\n  lines\n"
    found = rows(language.parse(text)[0], text, language)
    assert {r["kind"] for r in found} <= set(syntax.kinds)
    assert [(r["kind"], r["text"]) for r in found if r["kind"].endswith("Scalar") and r["n"] == 0 and r["field"] is None][:4] == [("StringScalar", "a"), ("StringScalar", "b"), ("SingleQuoteScalar", "'x'"), ("StringScalar", "c")]
    assert sum(r["kind"] == "Document" for r in found) == 2 and language.parse("a: [1")[1]


def python_tree(text):
    language = made_ready("builtin:python", "main")[0]
    tree, wrong = language.parse(text)
    return (rows(tree, text, language) if tree else []), wrong


@pytest.mark.parametrize(
    ("name", "text"), [("yaml", "[" * 600 + "]" * 600), ("yaml", "*nothing"), ("python", "a" + ".b" * 20_000), ("python", "(" * 300 + "1" + ")" * 300), ("python", "x = '\x00'"), ("python", "-" * 100_000 + "1")]
)
def test_no_text_fails_a_job(name, text):
    tree, wrong = made_ready(f"builtin:{name}", "main")[0].parse(text)
    assert tree is None and wrong[0].code == "unexpected_token" or not wrong


def test_aliases_are_leaves():
    language = made_ready("builtin:yaml", "main")[0]
    for text, aliases in (("&a [*a]", ["*a"]), ("x: &k [1, 2]\ny: *k\nz: [*k, *k]\n", ["*k"] * 3)):
        tree, wrong = language.parse(text)
        assert not wrong and [r["text"] for r in rows(tree, text, language) if r["kind"] == "Alias"] == aliases


@pytest.mark.parametrize("end", [" ", "\x0c", "\x85", "\x1c"])
def test_lines_end_where_python_ends_them(end):
    found, _ = python_tree(f'x = "a{end}b"\nnext = 1  # note\n')
    named = {r["text"]: (r["start_line"], r["start_col"]) for r in found if r["kind"] in ("Identifier", "Comment")}
    assert named["next"] == (2, 1) and named["# note"] == (2, 11)


def test_lines_of_other_systems():
    found, _ = python_tree("a = 1\r\nbc = 2\rdef f(): # x\r\n  return bc")
    assert [r["text"] for r in found if r["kind"] in ("Identifier", "Comment")] == ["a", "bc", "f", "# x", "bc"]


def test_operators_are_tokens():
    for text, at in (("(x # a + b\n + y)", 12), ("x['+'] + y", 7), ("(x) + y", 4), ("x += '+'", 2)):
        found, _ = python_tree(text)
        assert [r["start_off"] for r in found if r["field"] == "operator"] == [at]


def test_a_long_program_takes_its_time_once():
    import time

    text = "".join(f"def f{i}(x):  # note {i}\n    return x + {i}  # more\n" for i in range(4000))
    began = time.perf_counter()
    found, wrong = python_tree(text)
    assert not wrong and sum(r["kind"] == "Comment" for r in found) == 8000
    assert time.perf_counter() - began < 8  # a program of half the length took 30 s when each node was searched for from its place on


MANY = {
    "json": ['{"k": 76}', '{"k": 7', '[1, {"\u00e9": [true, null, "x\\n"]}]', "", "  [ ] ", '{"\U0001d11e": 1,\n "b": {}}\n'],
    "javascript": ["f(1,1,2) /* a */\nifs = 1 + 2 * 2 - 1; // b", "// one\n/* two */ x = 3 // \u00fc\n", "/* only */", "if (a) { b = c ? 1 : 2; } // d", "f(", "a = ;"],
    "python": ["def f(x):\n    # note\n    return x + 1\n", "a = b", "a ="],
    "yaml": ["a: 1\nb:\n  c: \u00e9\n", "- x\n- y", "{"],
}


@pytest.mark.parametrize("name", MANY)
def test_columns_hold_what_rows_hold(name):
    parser = made_ready(builtin_spec(name), "main")[0]
    texts = MANY[name] * 2
    read = [(text, *parser.read(text)) for text in texts]
    read = [x for x in read if x[1]]
    counts, made = columns([x[0] for x in read], [x[1] for x in read], [x[2] for x in read], True)
    own = [rows(parser.parse(x[0])[0], x[0], parser) for x in read]
    assert counts.tolist() == [len(x) for x in own]
    want = [r | ({} if r["depth"] else {"ord": None}) for x in own for r in x]
    assert [dict(zip(made, values)) for values in zip(*(made[c].to_pylist() for c in made))] == [{c: r[c] for c in made} for r in want]


def test_texts_of_one_shape_are_recognised_once():
    p = Parser(read_spec(builtin_spec("javascript")))
    first = p.parse("f(1,2) /* a */\nb = 10 + 2 * 3; // c")[0]
    held = p.held
    second = p.parse("gg(11,5)/* and more */  bb = 7 + 22 * 8;// d")[0]
    assert p.held == held and [c.kind for c in first.children] == [c.kind for c in second.children]


def test_a_parser_that_holds_too_much_starts_anew(monkeypatch):
    from treeq.spec import parse

    p = Parser(read_spec(builtin_spec("json")))
    texts = ["[" * n + "]" * n for n in range(1, 30)]
    want = [p.parse(t)[0] for t in texts]
    monkeypatch.setattr(parse, "HELD", 50)
    assert [p.parse(t)[0] for t in texts] == want and p.held < 10_000


def test_texts_of_one_file_are_dealt_out(spark):
    sources = spark.range(40).coalesce(1).selectExpr("id AS tree", "'[1]' AS text")
    for made in (forest(sources, builtin_spec("json")).nodes, trees(sources, builtin_spec("json")).rows):
        assert made.rdd.getNumPartitions() > 1
