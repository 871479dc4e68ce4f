"""Queries over a stream of sources.

Parsing and patterns that look at nodes by themselves keep no state, so they run on
each batch as it comes. Patterns with axes do so in array form, where a tree is a row and
an axis no join: that is for sources whose trees are small. In row form they join a forest with
itself, batch by batch, as all nodes of a tree come in one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from treeq.errors import CompileError
from treeq.lineage import Scratch
from treeq.sources import parsed


def matches(sources: DataFrame, spec: str, query: str, arrays: bool = False) -> DataFrame:
    """The streaming frame of matching nodes; ``sources`` streams ``tree, text``.

    With ``arrays``, trees are held whole in a row and patterns may have axes.
    """
    if arrays:
        return parsed.trees(sources, spec).query(query)
    found = parsed.forest(sources, spec).query(query)
    if "Join" in found._jdf.queryExecution().analyzed().toString():
        raise CompileError("the pattern has axes: take the array form or write it by batches", "Streaming")
    return found


def by_batches(sources: DataFrame, spec: str, query: str, write) -> DataStreamWriter:
    """Any query, batch by batch; ``write(matches, number)`` takes each result. A batch is parsed once."""

    def one(batch: DataFrame, number: int) -> None:
        made = parsed.forest(batch, spec).written()
        write(made.query(query), number)
        Scratch(batch.sparkSession, "streamed").drop(made.nodes)

    return sources.writeStream.foreachBatch(one)
