"""The registered queries: each operator of the language over a forest of the tables,
with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeq.sources import tables

#: name: (forest, query, SQL). Queries return ``tree, node_id, kind``; the SQL too.
PATTERNS: dict[str, tuple] = {}


def add(name: str, forest, query: str, sql: str | None) -> None:
    PATTERNS[name] = forest, query, sql


def found(df: DataFrame) -> DataFrame:
    return df.select("tree", (F.col("hi") - F.col("depth")).cast("long").alias("node_id"), "kind")


# node ids of the conversation forest, as numbered by its adapter
TURN = "SELECT conv_id AS tree, 3 * turn + 2 AS node_id, 'Turn' AS kind FROM conversations"
ROLE = "SELECT conv_id AS tree, 3 * turn AS node_id, 'Role' AS kind FROM conversations"
BODY = "SELECT conv_id AS tree, 3 * turn + 1 AS node_id, 'Body' AS kind FROM conversations"
CONV = "SELECT conv_id AS tree, 3 * count(*) AS node_id, 'Conversation' AS kind FROM conversations GROUP BY conv_id"
WINDOWED = (
    "SELECT tree, node_id, kind FROM (SELECT *, conv_id AS tree, 3 * turn + 2 AS node_id, 'Turn' AS kind, lag(role) OVER w AS before, lead(turn) OVER w AS after, "
    "count(*) OVER (PARTITION BY conv_id) AS turns, lead(role) OVER w AS role_after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
)
c = tables.conversations
add("q01_kind", c, "match Turn", TURN)
add("q02_wildcard", c, "match _", f"{TURN} UNION ALL {ROLE} UNION ALL {BODY} UNION ALL {CONV}")
add("q05_byte_length", c, "match Body b when b.text.length > 200", f"{BODY} WHERE strlen(text) > 200")
add("q10_field_text", c, "match Turn(role: 'user')", f"{TURN} WHERE role = 'user'")
add("q11_field_nested", c, "match Turn(body: Body b when b.text.matches(`x`))", f"{TURN} WHERE regexp_matches(text, 'x')")
add("q12_positional", c, "match Conversation c when c[0].role == 'system'", f"{CONV} HAVING bool_or(turn = 0 AND role = 'system')")
add("q12b_positional_pattern", c, "match Turn([1]: Body b when b.text.length > 300)", f"{TURN} WHERE strlen(text) > 300")
add("q13_parent_is", c, "match Role r when r.parent is { Turn t when t.body.text.length > 300 }", f"{ROLE} WHERE strlen(text) > 300")
add("q14_previous_sibling", c, "match Turn t when t.previous_sibling?.role?.text == 'system'", f"{WINDOWED} WHERE before = 'system'")
add("q15_next_sibling_null", c, "match Turn t when t.next_sibling == null", f"{WINDOWED} WHERE after IS NULL")
add("q16_safe_navigation", c, "match _ n when n.parent?.parent == null", f"{TURN} UNION ALL {CONV}")
add("q24_outer_reference", c, "match Turn t when any t.next_siblings() match { Turn u when u.role.text == t.role.text }", f"{TURN} t WHERE EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = t.conv_id AND u.turn > t.turn AND u.role = t.role)")
add("q30_previous_siblings", c, "match Turn t when t.previous_siblings(max_depth = 2).length == 2", f"{TURN} WHERE turn >= 2")
add("q31_siblings", c, "match Turn t when t.siblings().length == 4", f"{WINDOWED} WHERE turns = 4")
add("q32_near_siblings", c, "match Turn t when any t.siblings(depth = 1) match { Turn u when u.role.text == 'system' }", f"{WINDOWED} WHERE before = 'system' OR role_after = 'system'")
add("q43_next_siblings", c, "match Turn t when t.next_siblings(min_depth = 2).length > 1", f"{WINDOWED} WHERE turns - 1 - turn >= 3")
add("q44_negated_any", c, "match Turn t when !any t.previous_siblings() match { Turn u when u.role == 'system' } && t.role != 'system'", f"{TURN} t WHERE role <> 'system' AND NOT EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = t.conv_id AND u.turn < t.turn AND u.role = 'system')")
add("q45_flag_under_or", c, "match Conversation c when c.children.length > 6 || any c.children match { Turn t when t.role == 'system' }", f"{CONV} HAVING count(*) > 6 OR bool_or(role = 'system')")
add("q46_ordering_null_safe", c, "match Turn t when t.previous_sibling is Turn && t.previous_sibling.body.text < t.body.text", "SELECT tree, node_id, kind FROM (SELECT conv_id AS tree, 3 * turn + 2 AS node_id, 'Turn' AS kind, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before < text")

g = tables.geography
PARTY = (
    "SELECT n_regionkey AS region, nk, kind, name, row_number() OVER (PARTITION BY nk ORDER BY kind DESC, key) AS party, lead(kind) OVER (PARTITION BY nk ORDER BY kind DESC, key) AS after FROM ("
    "SELECT s_nationkey AS nk, 'Supplier' AS kind, s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_nationkey, 'Customer', c_custkey, c_name FROM customer) JOIN nation ON nk = n_nationkey"
)
PLACED = (
    "WITH p AS (" + PARTY + "), k AS (SELECT n_regionkey, n_nationkey, n_name, (SELECT count(*) FROM p WHERE p.nk = n_nationkey) AS parties FROM nation), "
    "a AS (SELECT *, 2 + coalesce(sum(parties + 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM k), "
    "party AS (SELECT CAST(region AS BIGINT) AS tree, CAST(spot + 1 + party - 2 AS BIGINT) AS node_id, p.kind, after, region FROM p JOIN a ON p.nk = a.n_nationkey), "
    "region_node AS (SELECT CAST(r_regionkey AS BIGINT) AS tree, CAST(1 + coalesce(sum(parties + 2), 0) AS BIGINT) AS node_id, 'Region' AS kind FROM region LEFT JOIN k ON n_regionkey = r_regionkey GROUP BY r_regionkey), "
    "nation_node AS (SELECT CAST(n_regionkey AS BIGINT) AS tree, CAST(spot + 1 + parties - 1 AS BIGINT) AS node_id, 'Nation' AS kind, n_name FROM a) "
)
add("q03_sub_kind", g, "match Party", PLACED + "SELECT tree, node_id, kind FROM party")
add("q04_alternation", g, "match Region | Nation", PLACED + "SELECT tree, node_id, kind FROM region_node UNION ALL SELECT tree, node_id, kind FROM nation_node")
add("q17_kind_equality", g, "match Party p when p.next_sibling?.kind == p.kind", PLACED + "SELECT tree, node_id, kind FROM party WHERE after = kind")
add("q29_parents_depth", g, "match Party p when any p.parents(min_depth = 2) match { Region r when r.name.text == 'ASIA' }", PLACED + "SELECT tree, node_id, party.kind FROM party JOIN region ON region = r_regionkey WHERE r_name = 'ASIA'")
add("q47_field_string", g, "match Nation(name: 'CHINA') | Region(name: 'EUROPE')", PLACED + "SELECT tree, node_id, kind FROM nation_node WHERE n_name = 'CHINA' UNION ALL SELECT tree, node_id, kind FROM region_node JOIN region ON tree = r_regionkey WHERE r_name = 'EUROPE'")

o = tables.orders
ORDER = (
    "WITH s AS (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders), "
    "a AS (SELECT *, 1 + coalesce(sum(1 + 3 * lines) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM s), "
    "ord AS (SELECT o_custkey AS tree, CAST(spot + 3 * lines - 1 AS BIGINT) AS node_id, 'Order' AS kind, lines, o_orderkey FROM a), "
    "cust AS (SELECT c_custkey AS tree, CAST(coalesce(sum(1 + 3 * lines), 0) AS BIGINT) AS node_id, 'Customer' AS kind, coalesce(sum(lines), 0) AS all_lines, count(o_orderkey) AS all_orders FROM customer LEFT JOIN s ON o_custkey = c_custkey GROUP BY c_custkey), "
    "line AS (SELECT o_custkey AS tree, CAST(spot + 1 + 3 * (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1) AS BIGINT) AS node_id, 'Lineitem' AS kind, l_returnflag, l_linestatus, l_orderkey FROM lineitem JOIN a ON o_orderkey = l_orderkey) "
)
PICK = "SELECT tree, node_id, kind FROM "
FLAGGED = "SELECT l_orderkey FROM lineitem WHERE l_returnflag "
add("q18_children_count", o, "match Order o when o.children.length > 5", ORDER + PICK + "ord WHERE lines > 5")
add("q19_no_children", o, "match Order o when o.children.length == 0", ORDER + PICK + "ord WHERE lines = 0")
add("q20_any", o, "match Order o when any o.children match { Lineitem l when l.returnflag == 'R' }", ORDER + PICK + f"ord WHERE o_orderkey IN ({FLAGGED} = 'R')")
add("q21_no", o, "match Order o when no o.children match { Lineitem l when l.returnflag == 'R' }", ORDER + PICK + f"ord WHERE o_orderkey NOT IN ({FLAGGED} = 'R')")
add("q22_all", o, "match Order o when all o.children match { Lineitem l when l.returnflag == 'R' }", ORDER + PICK + f"ord WHERE o_orderkey NOT IN ({FLAGGED} <> 'R')")
add("q23_nested_any", o, "match Customer c when any c.children match { Order o when any o.children match { Lineitem l when l.returnflag == 'R' } }", ORDER + PICK + f"cust WHERE tree IN (SELECT o_custkey FROM orders WHERE o_orderkey IN ({FLAGGED} = 'R'))")
add("q25_two_levels_out", o, "match Customer c when any c.children match { Order o when any o.children match { Lineitem l when l.kind != c.kind && l.returnflag == 'A' } }", ORDER + PICK + f"cust WHERE tree IN (SELECT o_custkey FROM orders WHERE o_orderkey IN ({FLAGGED} = 'A'))")
add("q26_descendants", o, "match Customer c when c.descendants().length > 60", ORDER + PICK + "cust WHERE all_orders + 3 * all_lines > 60")
add("q27_descendants_depth", o, "match Customer c when c.descendants(depth = 2).length > 40", ORDER + PICK + "cust WHERE all_lines > 40")
add("q28_parents", o, "match Lineitem l when l.parents().length == 2", ORDER + PICK + "line")
add("q48_any_descendant", o, "match Customer c when no c.descendants() match { Returnflag r when r.text == 'R' }", ORDER + PICK + f"cust WHERE tree NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey IN ({FLAGGED} = 'R'))")
add("q49_two_fields", o, "match Lineitem(returnflag: 'N', linestatus: 'F')", ORDER + PICK + "line WHERE l_returnflag = 'N' AND l_linestatus = 'F'")

d = tables.documents
DOC = (
    "WITH l AS (SELECT doc_id, n - 1 AS place, lines[n] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))), "
    "s AS (SELECT *, string_split(line, ' ') AS words FROM l), "
    "p AS (SELECT *, 1 + coalesce(sum(1 + len(words)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM s), "
    "line AS (SELECT doc_id AS tree, CAST(spot + len(words) - 1 AS BIGINT) AS node_id, 'Line' AS kind, line AS text, place FROM p), "
    "word AS (SELECT doc_id AS tree, CAST(spot + n - 2 AS BIGINT) AS node_id, 'Word' AS kind, words[n] AS text, n, place FROM (SELECT doc_id, place, spot, words, unnest(range(1, len(words) + 1)) AS n FROM p)) "
)
add("q06_regex", d, "match Line l when l.text.matches(`^The `)", DOC + PICK + "line WHERE regexp_matches(text, '^The ')")
add("q07_string_compare", d, "match Word w when w.text >= 'th'", DOC + PICK + "word WHERE text >= 'th'")
add("q08_not", d, "match Line l when !l.text.matches(`e`)", DOC + PICK + "line WHERE NOT regexp_matches(text, 'e')")
add("q09_right_associative", d, "match Word w when w.text == 'a' && w.text != 'b' || w.text == 'c'", DOC + PICK + "word WHERE text = 'a' AND (text <> 'b' OR text = 'c')")


def run(name: str):
    forest, text, _ = PATTERNS[name]
    return lambda spark, sf_dir: found(forest(spark, sf_dir).query(text))


QUERIES = {name: run(name) for name in PATTERNS}
ORACLE_SQL = {name: sql for name, (_, _, sql) in PATTERNS.items() if sql}


def properties_query(text: str):
    from treeq.sources import parsed

    return lambda spark, sf_dir: found(parsed.properties(spark, sf_dir).query(text))


# the trees of {"k": n}: Record, List, Entry, Key and Whole have the ids 4, 3, 2, 0 and 1
EVENT = "SELECT event_id AS tree, {id} AS node_id, '{kind}' AS kind FROM events"
VALUE = "CAST(json_extract(props, '$.k') AS BIGINT)"
JSON = {
    "q33_json_member": ("match Entry e when e.key.text == '\"k\"'", EVENT.format(id=2, kind="Entry")),
    "q34_to_int": ("match Whole w when w.text.to_int() > 50", f"{EVENT.format(id=1, kind='Whole')} WHERE {VALUE} > 50"),
    "q35_nested_fields": ("match Entry(key: '\"k\"', datum: Number n when n.text.length == 2)", f"{EVENT.format(id=2, kind='Entry')} WHERE {VALUE} BETWEEN 10 AND 99"),
    "q36_list_node": ("match List l when l.length == 1", EVENT.format(id=3, kind="List")),
    "q51_any_of_list": ("match Container c when any c.entries match Entry", EVENT.format(id=4, kind="Record")),
    "q52_index_of_list": ("match Record r when r.entries[0].datum is { Whole w when w.text == '7' }", f"{EVENT.format(id=4, kind='Record')} WHERE {VALUE} = 7"),
    # strict: the left side keeps keys away from to_int
    "q53_guarded_by_parent": ("match Scalar|Key n when n.parent is { Entry e when e.datum is Whole } && n.previous_sibling is Key && n.text.to_int() > 50", f"{EVENT.format(id=1, kind='Whole')} WHERE {VALUE} > 50"),
    "q54_guarded_by_any": ("match Scalar|Key n when any n.previous_siblings() match Key && n.text.to_int() < 7", f"{EVENT.format(id=1, kind='Whole')} WHERE {VALUE} < 7"),
    "q55_guarded_by_axis": ("match Entry e when any e.children match { Whole w when w.text.to_int() == 7 }", f"{EVENT.format(id=2, kind='Entry')} WHERE {VALUE} = 7"),
}
for name, (text, sql) in JSON.items():
    QUERIES[name] = properties_query(text)
    ORACLE_SQL[name] = sql


def positions(spark, sf_dir):
    from treeq.sources import parsed

    numbers = parsed.properties(spark, sf_dir).query("match Whole")
    return numbers.select("tree", *[F.col(c).cast("long") for c in ("start_line", "start_col", "start_off", "end_col", "end_off")])


QUERIES["q37_positions"] = positions
ORACLE_SQL["q37_positions"] = (
    "SELECT event_id AS tree, CAST(1 AS BIGINT) AS start_line, strpos(props, ' ') + 1 AS start_col, strpos(props, ' ') AS start_off, "
    "CAST(length(props) - 1 AS BIGINT) AS end_col, CAST(length(props) - 1 AS BIGINT) AS end_off FROM events"
)


def difference(spark, sf_dir):
    from treeq.sources import files

    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "source")
    kept = files.difference(docs.select("path", "text"), docs.filter("source = 'src0'").select("path", "text"))
    return kept.select("path", F.octet_length("text").cast("long").alias("bytes"))


QUERIES["q38_include_exclude"] = difference
ORACLE_SQL["q38_include_exclude"] = (
    "SELECT path, strlen(text) AS bytes FROM (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents EXCEPT "
    "SELECT CAST(doc_id AS VARCHAR), text FROM documents WHERE source = 'src0')"
)


#: Bytes of documents whose words one task sorts.
WORDS = 1 << 20


def resolved(spark, sf_dir):
    """The document forest where the first word of a line declares and others refer."""
    from dataclasses import replace

    from treeq.lineage import deal, shares
    from treeq.operators.scopes import solve_flat

    # whole documents are dealt out, so that joins by tree exchange no words
    docs = tables.table(spark, sf_dir, "documents")
    forest = tables.texts(deal(docs, "doc_id", shares(docs, WORDS)))
    words = forest.nodes.filter("kind = 'Word'").select("tree", F.col("text").alias("name"), F.col("pre").alias("node"), "ord")
    return replace(forest, refs=solve_flat(words.filter("ord = 0"), words.filter("ord > 0")))


NAMES = DOC + ", decl AS (SELECT tree, text, min(node_id) AS decl FROM word WHERE n = 1 GROUP BY tree, text), ref AS (SELECT word.tree, node_id, kind, decl FROM word LEFT JOIN decl ON decl.tree = word.tree AND decl.text = word.text WHERE n > 1) "
QUERIES["q39_references"] = lambda spark, sf_dir: (
    resolved(spark, sf_dir).refs.filter("decl IS NOT NULL").select("tree", (F.col("ref") - 2).cast("long").alias("ref"), (F.col("decl") - 2).cast("long").alias("decl"))
)
ORACLE_SQL["q39_references"] = NAMES + "SELECT tree, node_id AS ref, decl FROM ref WHERE decl IS NOT NULL"
QUERIES["q40_unresolved"] = lambda spark, sf_dir: found(resolved(spark, sf_dir).lenient().query("match Word w when w.referenced_decls().length == 0"))
ORACLE_SQL["q40_unresolved"] = NAMES + "SELECT tree, node_id, kind FROM ref WHERE decl IS NULL"
QUERIES["q50_any_declaration"] = lambda spark, sf_dir: found(resolved(spark, sf_dir).query("match Word w when any w.referenced_decls() match { Word d when d.text == w.text }"))
ORACLE_SQL["q50_any_declaration"] = NAMES + "SELECT tree, node_id, kind FROM ref WHERE decl IS NOT NULL"


def ruleset():
    from treeq.operators.rules import Rule, RuleSet

    return RuleSet(
        "turns",
        "conversations",
        (
            Rule("long_body", "a long turn", "style", "match Body b when b.text.length > 300"),
            Rule("system_turn", "a system turn", "smell", "match Turn(role: 'system')"),
            Rule("no_answer", "a last turn of the user", "bug", "match Turn t when t.next_sibling == null && t.role == 'user'", "nobody answers"),
        ),
    )


def rule_reports(spark, sf_dir):
    from treeq.operators.rules import check

    return check(tables.conversations(spark, sf_dir), [ruleset()])


QUERIES["q41_ruleset"] = lambda spark, sf_dir: rule_reports(spark, sf_dir).select("rule_id", "category", "tree", "node_id", "note")
HITS = (
    f"SELECT 'long_body' AS rule_id, 'style' AS category, tree, node_id, NULL AS note FROM ({BODY} WHERE strlen(text) > 300) UNION ALL "
    f"SELECT 'system_turn', 'smell', tree, node_id, NULL FROM ({TURN} WHERE role = 'system') UNION ALL "
    f"SELECT 'no_answer', 'bug', tree, node_id, 'nobody answers' FROM ({WINDOWED} WHERE after IS NULL AND role = 'user')"
)
ORACLE_SQL["q41_ruleset"] = HITS


def severities(spark, sf_dir):
    from treeq.operators.reports import severity

    return rule_reports(spark, sf_dir).groupBy(severity(F.col("category")).alias("severity")).agg(F.count("*").alias("reports"))


QUERIES["q42_severities"] = severities
ORACLE_SQL["q42_severities"] = (
    f"SELECT CASE category WHEN 'style' THEN 'help' WHEN 'bug' THEN 'bug' WHEN 'error' THEN 'error' ELSE 'warning' END AS severity, count(*) AS reports FROM ({HITS}) GROUP BY 1"
)


# what is made of found nodes and reports

PROPS = "SELECT event_id AS tree, strpos(props, ' ') + 1 AS first, length(props) - 1 AS last, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


def lines(spark, sf_dir):
    from treeq.operators.reports import listing
    from treeq.sources import parsed

    numbers = parsed.properties(spark, sf_dir).query("match Whole")
    return listing(numbers, F.format_string("events/%d.json", "tree")).select("tree", "line")


QUERIES["q56_listing"] = lines
ORACLE_SQL["q56_listing"] = f"SELECT tree, format('[Whole events/{{}}.json:1:{{}}-1:{{}}]', tree, first, last) AS line FROM ({PROPS})"


def written_trees(spark, sf_dir):
    from treeq.operators.reports import pretty_trees
    from treeq.sources import parsed

    return pretty_trees(parsed.properties(spark, sf_dir).nodes)


QUERIES["q57_pretty_trees"] = written_trees
ORACLE_SQL["q57_pretty_trees"] = (
    "SELECT tree, concat_ws(chr(10), 'Record {', '. ● entries: List {', '. . Entry {', '. . . ● key: Key { \"k\" }', format('. . . ● datum: Whole {{ {} }}', k), '. . }', '. }', '}') AS rendered "
    f"FROM ({PROPS})"
)


def large_values():
    from treeq.operators.rules import Rule, RuleSet

    return RuleSet("values", "json", (Rule("large", "a large value", "bug", "match Whole w when w.parent is Entry && w.text.to_int() > 90", "below 91"), Rule("zero", "no value", "style", "match Whole w when w == '0'")))


def value_reports(spark, sf_dir):
    from treeq.operators.rules import check
    from treeq.sources import parsed

    return check(parsed.properties(spark, sf_dir), [large_values()])


def shown(spark, sf_dir):
    from treeq.operators.reports import diagnostics

    events = tables.table(spark, sf_dir, "events")
    sources = events.select(F.col("event_id").alias("tree"), F.format_string("%d.json", "event_id").alias("path"), F.col("props").alias("text"))
    return diagnostics(value_reports(spark, sf_dir), sources)


QUERIES["q58_diagnostics"] = shown
ORACLE_SQL["q58_diagnostics"] = (
    "SELECT tree, CAST(1 AS BIGINT) AS node_id, rule AS rule_id, concat_ws(chr(10), level || '[' || rule || ']: ' || message, format('  ┌─ {}.json:1:{}', tree, first), '  │', '1 │ ' || props, "
    "'  │ ' || repeat(' ', CAST(first - 1 AS BIGINT)) || repeat('^', CAST(last - first + 1 AS BIGINT)), note) AS shown FROM ("
    "SELECT *, 'large' AS rule, 'bug' AS level, 'a large value' AS message, '  = below 91' AS note FROM p WHERE k > 90 UNION ALL "
    "SELECT *, 'zero', 'help', 'no value', NULL FROM p WHERE k = 0)"
)
ORACLE_SQL["q58_diagnostics"] = f"WITH p AS (SELECT p.*, props FROM ({PROPS}) p JOIN events ON tree = event_id) " + ORACLE_SQL["q58_diagnostics"]


def nested_records(spark, sf_dir):
    from treeq.operators.reports import records

    made = records(value_reports(spark, sf_dir), F.format_string("%d.json", "tree"))
    return made.select("code", "kind", "severity", "file_path", F.col("start.column").cast("long").alias("first"), F.col("end.column").cast("long").alias("last"), "message", "note")


QUERIES["q59_records"] = nested_records
ORACLE_SQL["q59_records"] = (
    f"SELECT 'large' AS code, 'BUG' AS kind, 'bug' AS severity, tree || '.json' AS file_path, first, last, 'a large value' AS message, 'below 91' AS note FROM ({PROPS}) WHERE k > 90 UNION ALL "
    f"SELECT 'zero', 'STYLE', 'help', tree || '.json', first, last, 'no value', NULL FROM ({PROPS}) WHERE k = 0"
)


def worst(spark, sf_dir):
    from treeq.operators.reports import ordered

    return ordered(rule_reports(spark, sf_dir)).select("rule_id", "tree", "node_id").limit(25)


QUERIES["q60_worst_reports"] = worst
ORACLE_SQL["q60_worst_reports"] = (
    f"SELECT rule_id, tree, node_id FROM ({HITS}) ORDER BY CASE category WHEN 'error' THEN 4 WHEN 'bug' THEN 3 WHEN 'deprecated' THEN 2 WHEN 'smell' THEN 1 ELSE 0 END DESC, tree DESC, node_id DESC LIMIT 25"
)


def exit_codes(spark, sf_dir):
    from treeq.operators.reports import failed

    found = rule_reports(spark, sf_dir)
    return spark.createDataFrame([("all", failed(found)), ("none", failed(found.filter("rule_id = 'nothing'")))], "reports string, exit_code long")


QUERIES["q61_exit_codes"] = exit_codes
ORACLE_SQL["q61_exit_codes"] = f"SELECT 'all' AS reports, CAST(count(*) > 0 AS BIGINT) AS exit_code FROM ({HITS}) UNION ALL SELECT 'none', 0"


def both_languages(spark, sf_dir):
    from treeq.operators.rules import check_all
    from treeq.sources import parsed

    found = check_all({"json": parsed.properties(spark, sf_dir), "conversations": tables.conversations(spark, sf_dir)}, [ruleset(), large_values()])
    return found.groupBy("language", "ruleset").agg(F.count("*").alias("reports"))


QUERIES["q62_by_language"] = both_languages
ORACLE_SQL["q62_by_language"] = (
    f"SELECT 'conversations' AS language, 'turns' AS ruleset, count(*) AS reports FROM ({HITS}) UNION ALL SELECT 'json', 'values', count(*) FROM ({PROPS}) WHERE k > 90 OR k = 0"
)
QUERIES["q63_bound_node"] = lambda spark, sf_dir: found(tables.conversations(spark, sf_dir).query("match Turn t when t.parent == $0", {"$0": (1, 0)}))
ORACLE_SQL["q63_bound_node"] = f"{TURN} WHERE conv_id = 1"
add("q64_escapes", d, r"match Line l when l.text.matches(`[\`,]`) && l.text != 'it\'s'", DOC + PICK + "line WHERE (contains(text, '`') OR contains(text, ',')) AND text <> 'it''s'")

# parsing

BROKEN = "SELECT event_id AS tree, substr(props, 1, length(props) - 1) AS text FROM events"


def broken(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("tree"), F.expr("substr(props, 1, length(props) - 1)").alias("text"))


def parse_errors(spark, sf_dir):
    from treeq.sources import parsed

    made = parsed.reports(broken(spark, sf_dir), parsed.builtin_spec("json"))
    return made.select("tree", "code", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), F.col("off").cast("long").alias("off"))


QUERIES["q65_parse_errors"] = parse_errors
ORACLE_SQL["q65_parse_errors"] = f"SELECT tree, 'unexpected_eof' AS code, CAST(1 AS BIGINT) AS line, length(text) + 1 AS col, length(text) AS off FROM ({BROKEN})"


def partial_trees(spark, sf_dir):
    from treeq.sources import parsed

    made = parsed.once(broken(spark, sf_dir), parsed.builtin_spec("json"), "broken")
    return found(made.query("match _ n when n.parent == null"))


QUERIES["q66_partial_trees"] = partial_trees
ORACLE_SQL["q66_partial_trees"] = f"SELECT tree, CAST(2 AS BIGINT) AS node_id, 'Entry' AS kind FROM ({BROKEN})"

# small programs, one for each event: a call with a list, a sum with a product, comments of both kinds, a keyword and a name that begins like it


def programs(spark, sf_dir):
    from treeq.sources import parsed

    e = tables.table(spark, sf_dir, "events")
    items = F.expr("concat(repeat('1,', cast(event_id % 3 as int)), '2')")
    text = F.format_string("f(%s) /* %s */\nifs = %d + %d * 2 - 1; // %s", items, "event_type", "event_id", "user_id", "event_type")
    return parsed.once(e.select(F.col("event_id").alias("tree"), text.alias("text")), parsed.builtin_spec("javascript"), "programs")


def program_query(text: str, *columns):
    return lambda spark, sf_dir: programs(spark, sf_dir).query(text).select("tree", "text", *columns)


PROGRAMS = {
    "q67_comments": ("match Comment", "SELECT event_id AS tree, '/* ' || event_type || ' */' AS text FROM events UNION ALL SELECT event_id, '// ' || event_type FROM events"),
    "q68_precedence": ("match BinaryExpression b when b.operator is Mul", "SELECT event_id AS tree, user_id || ' * 2' AS text FROM events"),
    "q69_left_side": ("match BinaryExpression b when b.operator is Sub && b.left is BinaryExpression", "SELECT event_id AS tree, event_id || ' + ' || user_id || ' * 2 - 1' AS text FROM events"),
    "q70_longest_token": ("match AssignmentExpression(left: Identifier i when i.text.length == 3)", "SELECT event_id AS tree, 'ifs = ' || event_id || ' + ' || user_id || ' * 2 - 1' AS text FROM events"),
    "q71_separated_list": ("match List l when l.parent is Arguments && l.length == 3", "SELECT event_id AS tree, '1,1,2' AS text FROM events WHERE event_id % 3 = 2"),
    "q72_optional_absent": ("match Program p when no p.descendants() match { IfStatement|ElseClause|EmptyStatement }", "SELECT event_id AS tree, 'f(' || repeat('1,', CAST(event_id % 3 AS INT)) || '2) /* ' || event_type || ' */' || chr(10) || 'ifs = ' || event_id || ' + ' || user_id || ' * 2 - 1;' AS text FROM events"),
}
for name, (text, sql) in PROGRAMS.items():
    QUERIES[name] = program_query(text)
    ORACLE_SQL[name] = sql


def python_calls(spark, sf_dir):
    from treeq.sources import parsed

    e = tables.table(spark, sf_dir, "events")
    text = F.format_string("def handle(x):\n    # %s\n    return x + %d\n", "event_type", "user_id")
    made = parsed.once(e.select(F.col("event_id").alias("tree"), text.alias("text")), parsed.builtin_spec("python"), "python")
    return made.query("match BinaryOperator b when b.operator is Add && any b.parents() match { FunctionDefinition f when f.name == 'handle' }").select("tree", "kind", "text", F.col("start_col").cast("long").alias("col"))


QUERIES["q73_python"] = python_calls
ORACLE_SQL["q73_python"] = "SELECT event_id AS tree, 'BinaryOperator' AS kind, 'x + ' || user_id AS text, CAST(12 AS BIGINT) AS col FROM events"


def yaml_pairs(spark, sf_dir):
    from treeq.sources import parsed

    e = tables.table(spark, sf_dir, "events")
    text = F.format_string("type: %s\nuser:\n  id: %d\n", "event_type", "user_id")
    made = parsed.once(e.select(F.col("event_id").alias("tree"), text.alias("text")), parsed.builtin_spec("yaml"), "yaml")
    return made.query("match BlockMappingPair(key: 'id')").select("tree", "text")


QUERIES["q74_yaml"] = yaml_pairs
ORACLE_SQL["q74_yaml"] = "SELECT event_id AS tree, 'id: ' || user_id AS text FROM events"

# names


def answered(spark, sf_dir):
    """Each turn is a scope in that of the turn before it and declares its role; a turn asks for the next turn's role."""
    from treeq.operators.scopes import solve

    t = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree"), F.col("turn").alias("scope"), F.col("role").alias("name"))
    edges = t.filter("scope > 0").select("tree", "scope", (F.col("scope") - 1).alias("parent"))
    refs = t.filter("scope > 0").select("tree", (F.col("scope") - 1).alias("scope"), "name", F.col("scope").alias("node"))
    return solve(edges, t.withColumn("node", F.col("scope")), refs)


QUERIES["q75_nested_scopes"] = answered
ORACLE_SQL["q75_nested_scopes"] = (
    "SELECT conv_id AS tree, turn AS ref, (SELECT max(u.turn) FROM conversations u WHERE u.conv_id = t.conv_id AND u.turn < t.turn AND u.role = t.role) AS decl FROM conversations t WHERE turn > 0"
)


def declared(spark, sf_dir):
    """Pairs declare their names in a scope for each tree, numbers refer to the name ``k``."""
    from treeq.operators.aspects import Script, resolve
    from treeq.sources import parsed

    script = Script(
        """
@Entry.sg_gen()
def declare(node, scope):
    if re.compile("k").match(node.key.text):
        scope.add_decl("k", node)

@Whole.sg_gen()
def refer(node, scope):
    scope.add_ref("k" if int(node.text) % 2 else "other", node)
"""
    )
    forest = resolve(parsed.properties(spark, sf_dir), script.aspects)
    return found(forest.query("match Whole w when any w.referenced_decls() match { Entry e when e.datum == w }"))


QUERIES["q76_aspects"] = declared
ORACLE_SQL["q76_aspects"] = f"{EVENT.format(id=1, kind='Whole')} WHERE {VALUE} % 2 = 1"


def remembered(spark, sf_dir):
    """Numbers of the nodes that a session remembers after twelve results of one node each."""
    from treeq.session import Cache

    cache = Cache()
    two = tables.conversations(spark, sf_dir).query("match Turn t when t.previous_siblings().length < 2").filter("tree = 0").orderBy("pre").select("tree", "pre").collect()
    for turn in range(12):
        cache.add([tuple(two[turn % 2])])
    return spark.createDataFrame([(name, tree, pre) for name, (tree, pre) in cache.nodes().items()], "name string, tree long, pre long")


QUERIES["q77_remembered"] = remembered
ORACLE_SQL["q77_remembered"] = (
    "SELECT '$' || (CASE n WHEN 11 THEN 0 ELSE n END) AS name, conv_id AS tree, CAST(1 + 3 * turn AS BIGINT) AS pre FROM conversations JOIN (SELECT unnest(range(2, 12)) AS n) ON n % 2 = turn WHERE conv_id = 0"
)
QUERIES["q64_escapes"] = run("q64_escapes")
ORACLE_SQL["q64_escapes"] = PATTERNS["q64_escapes"][2]

# one tree of all documents: axes on a tree that no task holds

b = tables.library
SHELF = DOC.replace("SELECT *, 1 + coalesce(sum(1 + len(words)) OVER (PARTITION BY doc_id ORDER BY place ", "SELECT *, 1 + dense_rank() OVER (ORDER BY doc_id) + coalesce(sum(1 + len(words)) OVER (ORDER BY doc_id, place ")
SHELF = SHELF.replace("line AS (SELECT doc_id AS tree", "line AS (SELECT CAST(0 AS BIGINT) AS tree, doc_id").replace("word AS (SELECT doc_id AS tree", "word AS (SELECT CAST(0 AS BIGINT) AS tree, doc_id")
SHELF = SHELF.replace("CAST(spot + len(words) - 1 AS BIGINT) AS node_id, 'Line'", "CAST(spot + len(words) - 2 AS BIGINT) AS node_id, len(words) AS n, 'Line'").replace("CAST(spot + n - 2 AS BIGINT)", "CAST(spot + n - 3 AS BIGINT)")
SHELF += ", last AS (SELECT doc_id, max(node_id) + 1 AS node_id, sum(n) AS words FROM line GROUP BY doc_id) "
LAST = "SELECT CAST(0 AS BIGINT) AS tree, node_id, 'Document' AS kind FROM last"
ONE_TREE = {
    "q78_descendants_one_tree": ("match Document d when d.descendants(depth = 2).length > 500", SHELF + LAST + " WHERE words > 500"),
    "q79_parents_one_tree": ("match Word w when any w.parents() match { Line l when l.text.matches(`^The `) } && w.text.length > 9", SHELF + PICK + "word WHERE strlen(text) > 9 AND EXISTS (SELECT 1 FROM line WHERE line.doc_id = word.doc_id AND line.place = word.place AND regexp_matches(line.text, '^The '))"),
    "q80_no_descendant_one_tree": ("match Document d when no d.descendants() match { Word w when w.text.matches(`^[A-Z]`) }", SHELF + LAST + " WHERE doc_id NOT IN (SELECT doc_id FROM word WHERE regexp_matches(text, '^[A-Z]'))"),
    "q81_count_above": ("match Line l when l.parents(min_depth = 2).length == 1 && l.descendants(max_depth = 2).length > 90", SHELF + PICK + "line WHERE n > 90"),
}
for name, (text, sql) in ONE_TREE.items():
    add(name, b, text, sql)
    QUERIES[name], ORACLE_SQL[name] = run(name), sql

# ten rules over two axes: one scan, one join for each axis


def order_rules():
    from treeq.operators.rules import Rule, RuleSet

    line = lambda quantifier, flag: f"match Order o when {quantifier} o.children match {{ Lineitem l when l.returnflag == '{flag}' }}"
    rules = [Rule(f"{q}_{f}", f"{q} {f}", "style", line(q, f)) for q in ("any", "all", "no") for f in "ANR"]
    return RuleSet("lines", "orders", (*rules, Rule("open_last", "an open line", "bug", "match Lineitem l when l.linestatus == 'O' && no l.next_siblings() match Lineitem && any l.parents() match Customer")))


def order_reports(spark, sf_dir):
    from treeq.operators.rules import check

    return check(tables.orders(spark, sf_dir), [order_rules()]).select("rule_id", "tree", "node_id")


QUERIES["q82_rules_share_axes"] = order_reports
ORACLE_SQL["q82_rules_share_axes"] = (
    ORDER + "SELECT word || '_' || flag AS rule_id, tree, node_id FROM ord, (VALUES ('any'), ('all'), ('no')) q(word), (VALUES ('A'), ('N'), ('R')) f(flag) WHERE CASE word "
    "WHEN 'any' THEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = flag) "
    "WHEN 'no' THEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = flag) "
    "ELSE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> flag) END "
    "UNION ALL SELECT 'open_last', tree, node_id FROM line l WHERE l_linestatus = 'O' AND node_id = (SELECT max(node_id) FROM line m WHERE m.l_orderkey = l.l_orderkey)"
)

# names as tables: a line is a scope that its first word is declared in; the first line stands for its own first word in the whole document


def line_names(spark, sf_dir):
    from treeq.lineage import deal, shares
    from treeq.operators.names import Naming, resolve

    naming = Naming(
        declares=(("match Word w when w.previous_sibling == null", "w.text"), ("match Line l when l.previous_sibling == null", "l[0].text")),
        refers=(("match Word w when w.previous_sibling != null", "w.text"),),
        scopes=("match Line",),
    )
    # dealt out as whole documents and kept in buckets, so that no join exchanges words
    docs = tables.table(spark, sf_dir, "documents")
    count = shares(docs, WORDS)
    return resolve(tables.texts(deal(docs, "doc_id", count)).bucketed(count, dealt=True), naming)


def nested_names(spark, sf_dir):
    forest = line_names(spark, sf_dir)
    declared = forest.nodes.select("tree", F.col("pre").alias("decl"), (F.col("hi") - F.col("depth")).cast("long").alias("decl_id"), F.col("kind").alias("decl_kind"))
    return forest.refs.filter("decl IS NOT NULL").join(forest.side(declared), ["tree", "decl"]).select("tree", (F.col("ref") - 2).cast("long").alias("ref_id"), "decl_id", "decl_kind")


MEANT = DOC + (
    ", f AS (SELECT tree, place, text, node_id FROM word WHERE n = 1), z AS (SELECT l.tree, l.node_id, f.text FROM line l JOIN f ON l.tree = f.tree AND l.place = 0 AND f.place = 0), "
    "m AS (SELECT w.tree, w.node_id AS ref_id, CASE WHEN f.text = w.text THEN f.node_id WHEN z.text = w.text THEN z.node_id END AS decl_id, CASE WHEN f.text = w.text THEN 'Word' ELSE 'Line' END AS decl_kind "
    "FROM word w JOIN f ON f.tree = w.tree AND f.place = w.place JOIN z ON z.tree = w.tree WHERE w.n > 1) "
)
QUERIES["q83_names_as_tables"] = nested_names
ORACLE_SQL["q83_names_as_tables"] = MEANT + "SELECT tree, ref_id, decl_id, decl_kind FROM m WHERE decl_id IS NOT NULL"


def meant_by(spark, sf_dir):
    from treeq.operators.names import referring

    forest = line_names(spark, sf_dir)
    declared = forest.nodes.select("tree", F.col("pre").alias("decl"), (F.col("hi") - F.col("depth")).cast("long").alias("decl_id"))
    return referring(forest).join(forest.side(declared), ["tree", "decl"]).select("tree", "decl_id", "refs")


QUERIES["q84_references_of_declarations"] = meant_by
ORACLE_SQL["q84_references_of_declarations"] = MEANT + "SELECT tree, decl_id, count(*) AS refs FROM m WHERE decl_id IS NOT NULL GROUP BY tree, decl_id"


def declared_functions(spark, sf_dir):
    """The built-in names of Python, without a script of the user's."""
    from treeq.operators.names import BUILTIN, resolve
    from treeq.sources import parsed

    e = tables.table(spark, sf_dir, "events")
    text = F.format_string("def f%d(x):\n    return x\n\nf%d(f%d(1))\n", F.col("event_id") % 3, F.col("user_id") % 3, F.col("event_id") % 3)
    made = parsed.once(e.select(F.col("event_id").alias("tree"), text.alias("text")), parsed.builtin_spec("python"), "functions")
    found = resolve(made, BUILTIN["python"]).query("match Identifier i when i.parent is Call && any i.referenced_decls() match FunctionDefinition")
    return found.select("tree", "text", F.col("start_col").cast("long").alias("col"))


QUERIES["q85_python_names"] = declared_functions
ORACLE_SQL["q85_python_names"] = (
    "SELECT event_id AS tree, 'f' || (event_id % 3) AS text, CAST(4 AS BIGINT) AS col FROM events UNION ALL "
    "SELECT event_id, 'f' || (user_id % 3), CAST(1 AS BIGINT) FROM events WHERE user_id % 3 = event_id % 3"
)

# the array form: the same queries without a join


def array_form(name: str):
    forest, text, _ = PATTERNS[name]

    def ask(spark, sf_dir):
        from treeq.plans.arrays import packed

        return found(packed(forest(spark, sf_dir)).query(text))

    return ask


for name in ("q24_outer_reference", "q44_negated_any", "q32_near_siblings", "q11_field_nested", "q14_previous_sibling", "q22_all", "q27_descendants_depth"):
    QUERIES[f"{name}_arrays"], ORACLE_SQL[f"{name}_arrays"] = array_form(name), PATTERNS[name][2]


def parsed_arrays(spark, sf_dir):
    from treeq.sources import parsed

    e = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("tree"), F.col("props").alias("text"))
    return found(parsed.trees(e, parsed.builtin_spec("json")).query(JSON["q53_guarded_by_parent"][0]))


QUERIES["q53_guarded_by_parent_arrays"], ORACLE_SQL["q53_guarded_by_parent_arrays"] = parsed_arrays, JSON["q53_guarded_by_parent"][1]

# files by globs below a root, and a method of an extension


#: Bytes of pages that one task writes as files.
PAGES = 2 << 20


def scanned(spark, sf_dir):
    """Pages written as a file each, read back by globs."""
    from treeq.lineage import Scratch, deal, shares
    from treeq.sources import files

    at = Scratch(spark, "pages").path("pages")
    pages = tables.table(spark, sf_dir, "pages")
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("text"))
    rows = deal(pages.select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit("\n")).alias("text")), "page_id", shares(pages, PAGES))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    files.write(rows.select(F.concat(F.lit("page_id="), name, F.lit("/part-"), nth.cast("string")).alias("path"), "text"), at)
    found = files.sources(spark, ["*/part-*"], ["page_id=1*/part-*", "page_id=__HIVE_DEFAULT_PARTITION__/part-*"], root=at)
    return found.select(F.regexp_extract("path", r"page_id=(-?\d+)/", 1).cast("long").alias("page_id"), F.octet_length("text").cast("long").alias("bytes"))


QUERIES["q86_glob_scan"] = scanned
ORACLE_SQL["q86_glob_scan"] = "SELECT page_id, strlen(coalesce(html, '')) + 1 AS bytes FROM pages WHERE NOT starts_with(CAST(page_id AS VARCHAR), '1')"


def extended(spark, sf_dir):
    """A method that an extension adds while the query is compiled."""
    from treeq.plans import compiler

    compiler.METHODS["upper"] = lambda plan, value, args: compiler.Value("string", F.upper(value.col), nullable=value.nullable)
    try:
        return found(tables.conversations(spark, sf_dir).query("match Role r when r.text.upper() == 'USER'"))
    finally:
        del compiler.METHODS["upper"]


QUERIES["q87_method_of_an_extension"] = extended
ORACLE_SQL["q87_method_of_an_extension"] = f"{ROLE} WHERE upper(role) = 'USER'"
