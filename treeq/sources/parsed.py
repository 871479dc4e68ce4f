"""Forests from parsed texts: one text in, the rows of its tree out."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import replace
from hashlib import sha256
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.forest import NODE, Forest
from treeq.lineage import deal, kept, shares
from treeq.plans.arrays import OWN, ROW, Trees
from treeq.spec.builtin import LANGUAGES
from treeq.spec.meta import read_spec
from treeq.spec.parse import Parser

POSITIONS = {k: "int" for k in ("start_line", "start_col", "start_off", "end_line", "end_col", "end_off")}
PARSED = ", ".join(f"`{k}` {v}" for k, v in {**NODE, **POSITIONS}.items())
REPORTS = "tree bigint, code string, message string, line int, col int, off int"
#: Equal texts of so many characters at most are parsed once while a worker remembers them.
REMEMBERED, SHORT = 4096, 1024
#: Nodes, and eight times as many characters, that are put into columns at once.
PORTION = 20_000
#: Bytes of files whose texts one task parses; tables of short texts are much smaller than their trees.
UNFOLDED = 256 << 10
_READY: dict = {}


def builtin_spec(name: str) -> str:
    """The specification of a built-in language, or ``builtin:`` and its name where Python has its parser."""
    if name in LANGUAGES:
        return f"builtin:{name}"
    return (Path(__file__).parent.parent / "spec" / f"{name}.syl").read_text()


def made_ready(spec: str, start: str):
    """What parses texts of a language, and its syntax."""
    if spec.startswith("builtin:"):
        language = LANGUAGES[spec.removeprefix("builtin:")]()
        return language, language.syntax
    grammar = read_spec(spec)
    return Parser(grammar, start), grammar.syntax


def ready(spec: str, start: str):
    """The parser of a specification and its memory, once in each worker."""
    if (spec, start) not in _READY:
        _READY[spec, start] = made_ready(spec, start)[0], OrderedDict()
    return _READY[spec, start]


def parsed(spec: str, start: str, text: str):
    """The shape of a text's tree, the places of its marks, and reports."""
    parser, memory = ready(spec, start)
    if text in memory:
        return memory[text]
    shape, places, wrong = parser.read(text)
    reports = [(r.code, r.message, text.count("\n", 0, r.at) + 1, r.at - text.rfind("\n", 0, r.at), len(text[: r.at].encode())) for r in wrong]
    found = shape, places, list(dict.fromkeys(reports))
    if len(text) <= SHORT:
        memory[text] = found
        if len(memory) > REMEMBERED:
            memory.popitem(last=False)
    return found


def portions(batches: Iterator[pa.RecordBatch], spec: str, start: str) -> Iterator[tuple]:
    """Texts that have a tree, a bounded number of nodes at once: trees, texts, shapes and places, a list each."""
    trees, texts, shapes, places, size = [], [], [], [], 0
    for batch in batches:
        for tree, text in zip(batch.column("tree").to_pylist(), batch.column("text").to_pylist()):
            shape, own, _ = parsed(spec, start, text)
            if shape is None:
                continue
            trees.append(tree)
            texts.append(text)
            shapes.append(shape)
            places.append(own)
            size += len(shape.kind) + len(text) // 8
            if size >= PORTION:
                yield trees, texts, shapes, places
                trees, texts, shapes, places, size = [], [], [], [], 0
    if trees:
        yield trees, texts, shapes, places


def table(shapes: list) -> dict[int, tuple]:
    """The columns of each shape as arrays, by the shape's identity; kinds and fields as places in a list of names."""
    made = {}
    for shape in shapes:
        if id(shape) not in made:
            numbers = [np.array([-1 if x is None else x for x in column], np.int64) for column in (shape.hi, shape.depth, shape.parent, shape.ord, shape.n, shape.start, shape.end, shape.trail)]
            made[id(shape)] = (*numbers, shape.field, shape.kind)
    return made


def columns(texts: list[str], shapes: list, places: list[list[int]], positions: bool) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The number of nodes of each text and the columns of all, text by text."""
    made = table(shapes)
    own = [made[id(x)] for x in shapes]
    hi, depth, parent, ord, n, start, end, trail = (np.concatenate(x) for x in list(zip(*own))[:8])
    counts = np.array([len(x[0]) for x in own])
    first = np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    marks = np.fromiter(chain.from_iterable(places), np.int64)
    base = np.repeat(np.concatenate([[0], np.cumsum([len(x) for x in places])[:-1]]), counts)
    start, end, trail = (marks[base + x] for x in (start, end, trail))
    spans = zip(start.tolist(), end.tolist())
    strings = [text[a:b] for text, count in zip(texts, counts.tolist()) for a, b in islice(spans, count)]
    out = {
        "pre": pa.array(np.arange(len(hi)) - first),
        "hi": pa.array(hi),
        "depth": pa.array(depth.astype(np.int32)),
        "parent": pa.array(parent, mask=depth == 0),
        "ord": pa.array(ord, mask=depth == 0),
        "n": pa.array(n),
        "field": names(own, 8),
        "kind": names(own, 9),
        "text": pa.array(strings, pa.string()),
    }
    if positions:
        # all texts one behind the other: where lines begin, and the bytes before each character
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts])
        origin = np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), counts)
        sizes = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
        feeds = np.flatnonzero(codes == 10)
        before = np.concatenate([[-1], feeds])
        for side, at, byte in (("start", start, start), ("end", np.maximum(start, trail - 1), trail)):
            passed = np.searchsorted(feeds, origin + at)
            line = passed - np.searchsorted(feeds, origin)
            col = np.where(line > 0, origin + at - before[passed], at + 1)
            out |= {f"{side}_line": pa.array((line + 1).astype(np.int32)), f"{side}_col": pa.array(col.astype(np.int32)), f"{side}_off": pa.array((sizes[origin + byte] - sizes[origin]).astype(np.int32))}
    return counts, out


def names(own: list[tuple], i: int) -> pa.Array:
    """The strings of one column of shapes, each shape's numbered once."""
    known: dict = {}
    codes: dict[int, np.ndarray] = {}
    for x in own:
        if id(x) not in codes:
            codes[id(x)] = np.array([-1 if k is None else known.setdefault(k, len(known)) for k in x[i]], np.int32)
    taken = np.concatenate([codes[id(x)] for x in own])
    return pa.array([*known], pa.string()).take(pa.array(taken, mask=taken < 0))


def spread(sources: DataFrame) -> DataFrame:
    """``tree, text`` of the texts that aren't null, dealt out by tree: few small files hold many texts, and parsing is the larger work. A
    stream stays as it is."""
    own = sources.select(F.col("tree").cast("long"), "text").filter("text IS NOT NULL")
    return own if sources.isStreaming else deal(own, "tree", shares(sources, UNFOLDED))


def forest(sources: DataFrame, spec: str, start: str = "main", name: str = "parsed") -> Forest:
    """The forest of ``sources(tree, text)``; null texts have no tree."""
    syntax = made_ready(spec, start)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trees, texts, shapes, places in portions(batches, spec, start):
            counts, made = columns(texts, shapes, places, True)
            made["tree"] = pa.array(trees, pa.int64()).take(pa.array(np.repeat(np.arange(len(trees)), counts)))
            yield pa.RecordBatch.from_arrays([made[c] for c in (*NODE, *POSITIONS)], names=[*NODE, *POSITIONS])

    rows_of = spread(sources).mapInArrow(run, PARSED)
    return Forest(rows_of, syntax, name)


def trees(sources: DataFrame, spec: str, start: str = "main") -> Trees:
    """The same forest in array form, a row for each text that has a tree; no exchange of a stream, so ``sources`` may be one."""
    syntax = made_ready(spec, start)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trees, texts, shapes, places in portions(batches, spec, start):
            counts, made = columns(texts, shapes, places, False)
            nodes = pa.StructArray.from_arrays([made[c] for c in OWN], names=OWN)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int64()), pa.ListArray.from_arrays(ends, nodes)], names=["tree", "nodes"])

    rows_of = spread(sources).mapInArrow(run, ROW)
    return Trees(rows_of, syntax)


def reports(sources: DataFrame, spec: str, start: str = "main") -> DataFrame:
    """What went wrong while parsing, by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("tree").to_pylist(), batch.column("text").to_pylist())
            out = [(tree, *r) for tree, text in pairs for r in parsed(spec, start, text)[2]]
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tree", "code", "message", "line", "col", "off"])

    return spread(sources).mapInArrow(run, REPORTS)


def properties(spark: SparkSession, sf_dir: str) -> Forest:
    """The JSON trees of ``events.props``, parsed once in a session."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return once(events.select(F.col("event_id").alias("tree"), F.col("props").alias("text")), builtin_spec("json"), "properties")


def once(sources: DataFrame, spec: str, name: str) -> Forest:
    """``forest`` with its nodes written in buckets by tree, so that a query reads them as often as it likes, and joins along axes need no exchange."""
    lazy = forest(sources, spec, name=name)
    label = f"{name}-{sha256(spec.encode()).hexdigest()}"
    made = kept(sources.sparkSession, label, [sources], lambda: {"nodes": lazy.nodes}, {"nodes": "tree"}, shares(sources, UNFOLDED), dealt=True)
    return replace(lazy, nodes=made["nodes"], large=True)
