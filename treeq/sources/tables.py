"""Forests made from relational tables.

Each level of a tree is a branch of a union whose kind and field are literals, so a
query that names kinds or fields reads only their branches: Catalyst folds the
others away. Where levels are numbered by windows or joins, that is done once in a
session and written, so a query that names a level several times only reads it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeq.forest import Forest, nodes
from treeq.lineage import Scratch, before, deal, kept, ordered, shares
from treeq.syntax import Syntax


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


CONVERSATIONS = Syntax.of(Conversation=(), Turn=("role", "body"), Role=(), Body=())


def conversations(spark: SparkSession, sf_dir: str) -> Forest:
    """``Conversation > Turn(role: Role, body: Body)``; turns are numbered from 0."""
    t = table(spark, sf_dir, "conversations")
    c = t.groupBy("conv_id").agg(F.count("*").alias("turns"))
    at = 1 + 3 * F.col("turn")
    leaf = lambda i, kind, text: nodes(t, F.col("conv_id"), at + i, at + i, 2, at, i - 1, 0, kind, F.col(text), kind.lower())
    parts = [
        nodes(c, F.col("conv_id"), 0, 3 * F.col("turns"), 0, None, None, F.col("turns"), "Conversation"),
        nodes(t, F.col("conv_id"), at, at + 2, 1, 0, F.col("turn"), 2, "Turn"),
        leaf(1, "Role", "role"),
        leaf(2, "Body", "text"),
    ]
    return Forest(union(parts), CONVERSATIONS, "conversations")


#: Bytes of order lines that one task sorts.
LINES = 2 << 20
ORDERS = Syntax.of(Customer=(), Order=(), Lineitem=("returnflag", "linestatus"), Returnflag=(), Linestatus=())


def orders(spark: SparkSession, sf_dir: str) -> Forest:
    """``Customer > Order > Lineitem(returnflag, linestatus)``, a tree for each customer."""
    o, li, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    # a customer's tree is small, so buckets by customer leave axis joins without exchanges
    by = {"customers": "c_custkey", "placed": "o_custkey", "lines": "o_custkey"}
    count = shares(li, LINES)
    made = kept(spark, "orders", [o, li, c], lambda: numbered(o, deal(li, "l_orderkey", count), c), by, count)
    customers, placed, lines = made["customers"], made["placed"], made["lines"]
    at = F.col("at") + 1 + 3 * F.col("line")
    leaf = lambda i, kind: nodes(lines, F.col("o_custkey"), at + i, at + i, 3, at, i - 1, 0, kind, F.col("l_" + kind.lower()), kind.lower())
    parts = [
        nodes(customers, F.col("c_custkey"), 0, F.coalesce("below", F.lit(0)), 0, None, None, F.coalesce("orders", F.lit(0)), "Customer"),
        nodes(placed, F.col("o_custkey"), F.col("at"), F.col("at") + 3 * F.col("lines"), 1, 0, F.col("place"), F.col("lines"), "Order"),
        nodes(lines, F.col("o_custkey"), at, at + 2, 2, F.col("at"), F.col("line"), 2, "Lineitem"),
        leaf(1, "Returnflag"),
        leaf(2, "Linestatus"),
    ]
    return Forest(union(parts), ORDERS, "orders", large=True)


def numbered(o: DataFrame, li: DataFrame, c: DataFrame) -> dict[str, DataFrame]:
    """The levels of ``orders``, each row with its place in its tree."""
    line_order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    by_order = Window.partitionBy("l_orderkey")
    lines = li.select("l_orderkey", "l_returnflag", "l_linestatus", (F.row_number().over(by_order.orderBy(*line_order)) - 1).alias("line"))
    sizes = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    placed = o.select("o_custkey", "o_orderkey").join(sizes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    placed = placed.select("o_custkey", "o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    earlier = F.sum(1 + 3 * F.col("lines")).over(by_customer.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumns({"at": 1 + F.coalesce(earlier, F.lit(0)), "place": F.row_number().over(by_customer) - 1})
    scratch = Scratch(o.sparkSession, "placed")
    placed = scratch.save(placed, "placed")
    roots = placed.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(1 + 3 * F.col("lines")).alias("below"))
    customers = c.select("c_custkey").join(roots, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    lines = lines.join(placed.select("o_custkey", "o_orderkey", "at"), F.col("l_orderkey") == F.col("o_orderkey"))
    return {"customers": customers, "placed": placed, "lines": lines.drop("l_orderkey", "o_orderkey")}


GEOGRAPHY = Syntax.of(Region=("name",), Nation=("name",), Name=(), Party=(), Supplier=("Party",), Customer=("Party",))


def geography(spark: SparkSession, sf_dir: str) -> Forest:
    """``Region(name) > Nation(name) > Supplier, Customer``; both of the last are a ``Party``.

    The levels above parties are a few rows in number, by the schema.
    """
    r, n, s, c = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    made = kept(spark, "geography", [r, n, s, c], lambda: located(r, n, s, c))
    top, placed, own = made["top"], made["placed"], made["own"]
    at = F.col("at") + 1 + F.col("party")
    parts = [
        nodes(top, F.col("r_regionkey"), 0, 1 + F.coalesce("below", F.lit(0)), 0, None, None, 1 + F.coalesce("nations", F.lit(0)), "Region"),
        nodes(r, F.col("r_regionkey"), 1, 1, 1, 0, 0, 0, "Name", F.col("r_name"), "name"),
        nodes(placed, F.col("n_regionkey"), F.col("at"), F.col("at") + 1 + F.col("parties"), 1, 0, F.col("place"), 1 + F.col("parties"), "Nation"),
        nodes(placed, F.col("n_regionkey"), F.col("at") + 1, F.col("at") + 1, 2, F.col("at"), 0, 0, "Name", F.col("n_name"), "name"),
        nodes(own.filter("kind = 'Supplier'"), F.col("n_regionkey"), at, at, 2, F.col("at"), F.col("party"), 0, "Supplier", F.col("name")),
        nodes(own.filter("kind = 'Customer'"), F.col("n_regionkey"), at, at, 2, F.col("at"), F.col("party"), 0, "Customer", F.col("name")),
    ]
    return Forest(union(parts), GEOGRAPHY, "geography")


def located(r: DataFrame, n: DataFrame, s: DataFrame, c: DataFrame) -> dict[str, DataFrame]:
    """The levels of ``geography``. Parties are numbered over range partitions, so that
    no task gets a whole nation's."""
    scratch = Scratch(r.sparkSession, "parties")
    columns = lambda x, kind, level: [F.col(f"{x}_nationkey").alias("nk"), F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.col(f"{x}_{'supp' if x == 's' else 'cust'}key").alias("key"), F.col(f"{x}_name").alias("name")]
    parties = s.select(*columns("s", "Supplier", 0)).unionByName(c.select(*columns("c", "Customer", 1)))
    keys = ["nk", "level", "key"]
    ranked = scratch.save(before(ordered(parties, keys, scratch, "parties"), {"rank": F.lit(1)}, keys), "ranked")
    counts = ranked.groupBy("nk").agg(F.count("*").alias("parties"), F.min("rank").alias("first"))
    placed = n.join(counts, F.col("nk") == F.col("n_nationkey"), "left").withColumn("parties", F.coalesce("parties", F.lit(0)))
    by_region = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    earlier = F.sum(F.col("parties") + 2).over(by_region.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumns({"at": 2 + F.coalesce(earlier, F.lit(0)), "place": F.row_number().over(by_region)}).drop("nk")
    placed = scratch.save(placed, "placed")
    roots = placed.groupBy("n_regionkey").agg(F.sum(F.col("parties") + 2).alias("below"), F.count("*").alias("nations"))
    top = r.join(roots, F.col("r_regionkey") == F.col("n_regionkey"), "left").drop("n_regionkey")
    own = ranked.join(F.broadcast(placed.select("n_nationkey", "n_regionkey", "at", "first")), F.col("nk") == F.col("n_nationkey"))  # a row for each nation
    own = own.select("n_regionkey", "at", "kind", "name", (F.col("rank") - F.col("first") + 1).alias("party"))
    return {"top": top, "placed": placed, "own": own}


DOCUMENTS = Syntax.of(Document=(), Line=(), Word=())


def levels(docs: DataFrame, tree: str | int, depth: int) -> list[DataFrame]:
    """``Document > Line > Word`` over ``docs(doc_id, text, base, parent, place)``, whose documents lie at ``base`` in a tree:
    lines end at line feeds, words at single spaces. Positions are computed in the document's own row."""
    lines = F.split("text", "\n", -1)
    sized = docs.select("doc_id", "text", "base", "parent", "place", lines.alias("lines")).filter("text IS NOT NULL")
    words = F.transform("lines", lambda x: F.size(F.split(x, " ", -1)))
    starts = F.aggregate(words, F.array(F.lit(1)), lambda own, n: F.concat(own, F.array(F.element_at(own, -1) + n + 1)))
    sized = sized.withColumn("starts", starts).withColumn("total", F.element_at("starts", -1) - 1)
    # exploded without posexplode, which Catalyst keeps above what a query drops: a level without rows would part the union from its exchange
    numbered_lines = F.transform("lines", lambda x, i: F.struct(i.alias("nth"), x.alias("line")))
    line = sized.select("doc_id", "base", "starts", F.explode(numbered_lines).alias("one")).select("doc_id", "base", "starts", "one.nth", "one.line")
    line = line.select("doc_id", "base", "nth", "line", (F.get("starts", F.col("nth")) + F.col("base")).alias("at"), F.split("line", " ", -1).alias("words"))
    word = line.select("doc_id", "at", F.posexplode("words").alias("w", "word"))
    of = F.col(tree) if isinstance(tree, str) else F.lit(tree)
    at = F.col("at") + 1 + F.col("w")
    return [
        nodes(sized, of, F.col("base"), F.col("base") + F.col("total"), depth, F.col("parent"), F.col("place"), F.size("lines"), "Document", F.col("text")),
        nodes(line, of, F.col("at"), F.col("at") + F.size("words"), depth + 1, F.col("base"), F.col("nth"), F.size("words"), "Line", F.col("line")),
        nodes(word, of, at, at, depth + 2, F.col("at"), F.col("w"), 0, "Word", F.col("word")),
    ]


def texts(docs: DataFrame) -> Forest:
    """A tree for each row of ``docs(doc_id, text)``."""
    none = F.lit(None).cast("long")
    own = docs.select("doc_id", "text", F.lit(0).cast("long").alias("base"), none.alias("parent"), none.alias("place"))
    return Forest(union(levels(own, "doc_id", 0)), DOCUMENTS, "documents")


def documents(spark: SparkSession, sf_dir: str) -> Forest:
    return texts(table(spark, sf_dir, "documents"))


#: Bytes of documents that one task sorts while they are put in one tree.
SHELF = 4 << 20
LIBRARY = Syntax.of(Library=(), Document=(), Line=(), Word=())


def library(spark: SparkSession, sf_dir: str) -> Forest:
    """``Library > Document > Line > Word``: all documents in one tree, by id."""
    docs = table(spark, sf_dir, "documents")
    made = kept(spark, "library", [docs], lambda: shelved(docs))
    root = nodes(made["root"], 0, 0, F.col("hi"), 0, None, None, F.col("n"), "Library")
    return Forest(union([root, *levels(made["documents"], 0, 1)]), LIBRARY, "library", large=True)


def shelved(docs: DataFrame) -> dict[str, DataFrame]:
    """Documents with their places in one tree; equal rows are in any order. Sums go over range
    partitions of bounded size, so no task holds the tree or a share that grows with it."""
    size = F.aggregate(F.split("text", "\n", -1), F.lit(1).cast("long"), lambda n, x: n + 1 + F.size(F.split(x, " ", -1)))
    sized = docs.filter("text IS NOT NULL").select("doc_id", "text", size.alias("size"))
    scratch, keys, count = Scratch(docs.sparkSession, "library"), ["doc_id", "text"], shares(docs, SHELF)
    borders = [F.col("doc_id"), F.substring("text", 1, 32)]
    shelf = ordered(sized, keys, scratch, "documents", count, borders)
    placed = before(shelf, {"at": F.col("size"), "place": F.lit(1)}, keys, count)
    placed = placed.select("doc_id", "text", (F.col("at") + 1).alias("base"), F.lit(0).cast("long").alias("parent"), "place", "size")
    return {"documents": placed, "root": shelf.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("hi"))}
