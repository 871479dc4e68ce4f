"""A training corpus from raw documents, stage by stage.

Each stage takes the session, the documents its predecessor kept and the folder of
the tables, and returns documents with the same columns; the last returns what it
reads back from the token store.

Defined cases: a null or blank text has the score of the classifier's bias; if it stays,
all such texts are one near-duplicate group, hit no benchmark item, hold no words, so
the mix takes none, and the store gets none. Rows with null ids are kept like others.
Of repeated rows one stays, until the mix repeats rows. Texts are looked at whole,
however long. Ties go by smaller id, then text hash. Other columns stay as they are,
whatever their names. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm import decontam, mixing, quality, simhash, tokenstore
from treeq.llm.common import Scratch, documents


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, documents(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, F.array(F.col("source").cast("string")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenstore.store_and_read(docs)


STAGES = [
    ("quality classifier", good),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("token store", tokens),
]

#: The trained classifier and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
