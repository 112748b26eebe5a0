"""Exact deduplication by SHA-256 fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ids import dense_id, places, running_sum


def with_fingerprint(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("fp", F.sha2("content", 256))


def with_ids(rows: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Chunks with an id each, in the order of files and places; nothing is removed.  Places in a file are dense, so only
    the files' numbers of chunks are summed up; the content is not sorted."""
    counts = fingerprints.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n"))
    base = running_sum(counts, ["file_id"], "_n", "_first").select("file_id", "_first")
    return rows.join(base, "file_id").withColumn("chunk_id", F.col("_first") + F.col("seq")).drop("_first")


def first_occurrences(fingerprints: DataFrame) -> DataFrame:
    """(fp, file_id, seq, chunk_id): where each fingerprint is first; ids are dense in that order."""
    first = fingerprints.groupBy("fp").agg(F.min(F.struct("file_id", "seq")).alias("at")).select("fp", "at.file_id", "at.seq")
    return dense_id(first, ["file_id", "seq"], "chunk_id")


def unique_chunks(chunks: DataFrame, firsts: DataFrame) -> DataFrame:
    """The first occurrences with their content."""
    return chunks.join(firsts.select("fp", "file_id", "seq", "chunk_id"), ["file_id", "seq"]).select("chunk_id", "fp", "file_id", "seq", "size", "content")


def recipes(fingerprints: DataFrame, firsts: DataFrame) -> DataFrame:
    """(file_id, seq, chunk_id) of every chunk, repeats included.  A fingerprint with very many chunks is one
    of the keys that Spark splits in this join."""
    return fingerprints.join(firsts.select("fp", "chunk_id"), "fp").select("file_id", "seq", "chunk_id")


def fp_index(chunks: DataFrame) -> DataFrame:
    """(fp, place, chunk_id): the chunks of each fingerprint by id, in long form, since one fingerprint may have
    any number of them."""
    return places(chunks.select("fp", "chunk_id"), ["fp"], ["chunk_id"])


def survivors(chunks: DataFrame) -> DataFrame:
    """The chunk with the smallest id of each fingerprint."""
    return chunks.groupBy("fp").agg(F.min("chunk_id").alias("chunk_id"))


def duplicates(chunks: DataFrame) -> DataFrame:
    """All others, with the chunk that they repeat."""
    keep = survivors(chunks).withColumnRenamed("chunk_id", "first_id")
    return chunks.select("fp", "chunk_id").join(keep, "fp").where("chunk_id <> first_id").select("chunk_id", "first_id")


def occurrence_histogram(fingerprints: DataFrame) -> DataFrame:
    """How many fingerprints occur how often."""
    return fingerprints.groupBy("fp").agg(F.count(F.lit(1)).alias("occurrences")).groupBy("occurrences").agg(F.count(F.lit(1)).alias("frequency"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: an index in which later entries replace earlier ones."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")
