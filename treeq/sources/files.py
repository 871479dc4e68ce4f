"""Files as sources, through Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks for each core that look up the files that a glob fits; Spark by itself makes one for each file, up to 10,000.
LISTS = 16


def rooted(root: str | None, globs: list[str]) -> list[str]:
    return [f"{root.rstrip('/')}/{g}" if root else g for g in globs]


def read(spark: SparkSession, globs: list[str]) -> DataFrame:
    """``path, text`` of every file; a glob that fits nothing gives nothing."""
    found, tasks = None, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    for g in globs:
        try:
            spark.conf.set(tasks, str(min(int(before), LISTS * spark.sparkContext.defaultParallelism)))
            df = spark.read.text(g, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        finally:
            spark.conf.set(tasks, before)
        found = df if found is None else found.unionByName(df)
    return found if found is not None else spark.createDataFrame([], "path string, text string")


def fits(spark: SparkSession, glob: str) -> Column:
    """Whether ``path``, as ``read`` gives it, is one that ``read`` finds by the glob: a file that fits, or one in a
    folder that fits, which may lie in folders of partitions. It needs no list of files, and keeps others from being opened."""
    hadoop, found = spark._jvm.org.apache.hadoop.fs, F.lit(False)
    at = F.regexp_replace("path", "^file:/+", "file:///")
    for one in hadoop.GlobExpander.expand(glob):
        path = hadoop.Path(one)
        uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
        store = f"{uri.getScheme()}://{uri.getAuthority() or ''}"
        names = uri.getPath().split("/")[1:]
        # the paths of files are encoded as those of URIs, where a plus is itself
        parts = F.split(F.url_decode(F.replace(F.substring(at, len(store) + 2, 1 << 30), F.lit("+"), F.lit("%2B"))), "/", -1)
        ok = at.startswith(f"{store}/") & (F.size(parts) >= len(names))
        for i, name in enumerate(names):
            ok = ok & F.get(parts, F.lit(i)).rlike(f"^(?s:{hadoop.GlobPattern(name).compiled().toString()})$")
        below = F.slice(parts, len(names) + 1, F.greatest(F.size(parts) - len(names) - 1, F.lit(0)))
        found = found | ok & F.forall(below, lambda name: name.contains("="))
    return F.coalesce(found, F.lit(False))


def sources(spark: SparkSession, include: list[str], exclude: list[str] = (), root: str | None = None) -> DataFrame:
    """``tree, path, text``: files by globs, numbered by a hash of their path. Those that ``exclude`` fits aren't opened."""
    found = read(spark, rooted(root, include))
    for g in rooted(root, exclude):
        found = found.filter(~fits(spark, g))
    # one glob gives a file once
    if len(include) > 1 or any("{" in g for g in include):
        found = found.dropDuplicates(["path"])
    return found.select(F.xxhash64("path").alias("tree"), "path", "text")


def difference(include: DataFrame, exclude: DataFrame) -> DataFrame:
    """Distinct sources of ``include`` that aren't in ``exclude``, by path and text, where a null is like another.

    Texts are exchanged once; an anti join and ``distinct`` would do so each.
    """
    sides = [df.select("path", "text", F.lit(out).alias("out")) for df, out in ((include, False), (exclude, True))]
    return sides[0].unionByName(sides[1]).groupBy("path", "text").agg(F.max("out").alias("out")).filter("NOT out").select("path", "text")


def write(df: DataFrame, at: str) -> None:
    """Writes each row of ``df(path, text)`` as a file of its own below ``at``, a folder on a file system of ``pyarrow.fs``.

    Paths must differ. Spark's writers start several processes for each file on a local disk; here a file is
    one stream. A task that runs again writes the same files.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treeq.llm.warc import located

        fs, root = located(at)
        for batch in batches:
            for path, text in zip(*batch.columns):
                to = f"{root}/{path.as_py()}"
                fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(to, compression=None) as out:
                    out.write(text.as_buffer())
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    texts = df.select("path", F.col("text").cast("string").cast("binary").alias("text"))
    texts.mapInArrow(written, "files long").write.format("noop").mode("overwrite").save()
