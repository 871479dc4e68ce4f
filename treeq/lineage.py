"""Cutting lineage in the folder that all executors share, and order over partitions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One of its own is set only on a single machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"{tempfile.gettempdir()}/treeq-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder, without what it was made of."""
    return Scratch(df.sparkSession, "cut").save(df, "cut")


class Scratch:
    """Tables written in the shared folder, so that lost executors lose no work.

    A written table also fixes what depends on the run: sampled range borders
    and partition numbers. What isn't deleted before goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        if not self.made:
            path, fs = self.file_system(self.root)
            fs.mkdirs(path)
            fs.deleteOnExit(path)  # only of what is there
        self.made += 1
        return f"{self.root}/{name}-{self.made}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def bucketed(self, df: DataFrame, name: str, keys: list[str], count: int | None = None) -> DataFrame:
        """Like ``save``, in ``count`` buckets by ``keys`` and sorted by them.

        Joins, windows and groups by ``keys`` then need no exchange. ``df`` comes
        dealt out by ``keys`` into as many partitions, so that each writes one file.
        """
        at, table = self.path(name), f"treeq_{uuid.uuid4().hex}"
        count = count or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("path", at).option("compression", "zstd").bucketBy(count, *keys).sortBy(*keys).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that ``save`` made, once nothing reads it."""
        if files := df.inputFiles():
            self.delete(files[0].rsplit("/", 1)[0])

    def delete(self, at: str) -> None:
        path, fs = self.file_system(at)
        fs.delete(path, True)

    def file_system(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())


def shares(df: DataFrame, size: int) -> int:
    """In how many partitions rows that unfold are dealt out: one for each ``size`` bytes of the files read, but not under the session's number."""
    scratch, own = Scratch(df.sparkSession, "shares"), 0
    for file in df.inputFiles():
        path, fs = scratch.file_system(file)
        own += fs.getFileStatus(path).getLen()
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own // size))


def deal(df: DataFrame, key: str, count: int) -> DataFrame:
    """``df`` dealt out by ``key``; joins by ``key`` and more then need no exchange of what each row unfolds into."""
    by_part_of_keys(df.sparkSession)
    return df.repartition(count, key)


def by_part_of_keys(spark: SparkSession) -> None:
    """Lets joins use buckets by some of their keys, such as the tree of a tree and a place."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


#: Label and input files to the frames and tables of the last builds.
_KEPT: dict[tuple, list[tuple[list[DataFrame], dict[str, DataFrame]]]] = {}
#: Builds of one label over the same files, of different plans, that are remembered.
_PLANS = 16


def kept(
    spark: SparkSession, label: str, inputs: list[DataFrame], build: Callable[[], dict[str, DataFrame]], buckets: dict[str, str] | None = None, count: int | None = None,
    dealt: bool = False,
) -> dict[str, DataFrame]:
    """The tables that ``build`` gives, written once in a session for the same plans over the same input files.

    ``buckets`` names a column for each table that is written in ``count`` buckets; with ``dealt``, its rows come dealt out so (``deal``).

    Frames that read no files, such as local rows, can't be told apart by these, so
    what is built from them is written each time. Tables whose input files have changed are forgotten;
    their files stay until the application ends, as frames may still read them.
    """
    scratch = Scratch(spark, re.sub(r"\W+", "-", label)[:60])

    def written() -> dict[str, DataFrame]:
        by, number, out = buckets or {}, count or int(spark.conf.get("spark.sql.shuffle.partitions")), {}
        if by:
            by_part_of_keys(spark)
        for name, df in build().items():
            out[name] = scratch.bucketed(df if dealt else df.repartition(number, by[name]), name, [by[name]], number) if name in by else scratch.save(df, name)
        return out

    paths = [df.inputFiles() for df in inputs]
    if not all(paths):
        return written()
    stamps = []
    for file in sorted({f for own in paths for f in own}):
        path, fs = scratch.file_system(file)
        status = fs.getFileStatus(path)
        stamps.append((file, status.getModificationTime(), status.getLen()))
    session = spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), label
    key = *session, tuple(stamps)
    for old in [k for k in _KEPT if k[:3] == session and k != key and {x[0] for x in k[3]} == {x[0] for x in stamps}]:
        del _KEPT[old]
    known = _KEPT.setdefault(key, [])
    for frames, tables in known:
        if len(frames) == len(inputs) and all(a.sameSemantics(b) for a, b in zip(frames, inputs)):
            return tables
    tables = written()
    known.append((inputs, tables))
    del known[:-_PLANS]
    return tables


def ordered(df: DataFrame, keys: list[str], scratch: Scratch, name: str, parts: int | None = None, borders: list[Column] | None = None) -> DataFrame:
    """``df`` in global order of ``keys`` with its partition, of ``parts``, in ``__part``, written.

    ``borders`` are short columns in the same order, such as beginnings of texts: the driver gets a sample of them, of some hundred rows for each part.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(k).asc_nulls_first() for k in keys]
    return scratch.save(
        df.repartitionByRange(parts, *([c.asc_nulls_first() for c in borders] if borders else cols)).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*cols), name
    )


def before(df: DataFrame, sums: dict[str, Column], keys: list[str], parts: int | None = None) -> DataFrame:
    """Adds sums over all rows that come before, in ``ordered`` order, by their names.

    Each range partition sums its own rows; what precedes a partition is added from
    a table with one row for each partition. ``parts`` is their number if it isn't the session's.
    """
    if parts:
        df = df.repartition(parts, "__part")
    prior = Window.unboundedPreceding, -1
    within = Window.partitionBy("__part").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(*prior)
    over = Window.orderBy("__part").rowsBetween(*prior)
    totals = df.groupBy("__part").agg(*[F.sum(x).alias(f"__{k}") for k, x in sums.items()])
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__{k}").over(over), F.lit(0)).alias(f"__{k}") for k in sums])
    summed = df.withColumns({k: F.coalesce(F.sum(x).over(within), F.lit(0)) for k, x in sums.items()})
    joined = summed.join(F.broadcast(offsets), "__part")  # one row for each range partition
    return joined.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__part", *[f"__{k}" for k in sums])
