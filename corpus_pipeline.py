"""A corpus pipeline of five operators, each stage working on all that its predecessor kept.

Defined results of every stage: an empty table gives an empty one; only the columns of ``COLUMNS`` are returned, so other
columns may have any name; texts of any length are read whole.

* quality: a null text counts as empty and is scored; repeated rows are all kept or all dropped.
* near_duplicates: of rows with equal ids all are kept or all dropped; rows without an id are kept; null and wordless texts are
  near duplicates of nothing.
* decontaminate: a null text has no words and is kept.
* mix: a null source is a source; rows without tokens stay once; repeated rows are taken equally often.
* shard: repeated rows are rows of their own; rows with equal texts share a shard unless they are larger than one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import read_table, written
from siltstone.llm.decontaminate import find_benchmark, with_verdict
from siltstone.llm.mixing import mixed_rows
from siltstone.llm.near import near_classes
from siltstone.llm.quality import THRESHOLD, accepted, learned
from siltstone.llm.sharding import pack_shards

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, learned on the corpus' labels, rejects."""
    return accepted(docs, learned(spark, docs, sf_dir), THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates (and rows without id)."""
    gone = near_classes(docs).where("class_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which benchmark windows cover at least a twentieth."""
    found = with_verdict(find_benchmark(docs, read_table(spark, sf_dir, "benchmark")))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights; a document may stay, go or be repeated."""
    return mixed_rows(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents into 24 shards of near equal bytes, tokens and rows."""
    return pack_shards(docs.select(*COLUMNS))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Tree growing and greedy packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
