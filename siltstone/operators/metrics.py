"""Sizes, ratios and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 4)


def size_histogram(groups: DataFrame, stage: str) -> DataFrame:
    """(stage, group_size, frequency) of groups of (grp, chunk_id)."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("frequency")).select(F.lit(stage).alias("stage"), "group_size", "frequency")


def size_report(compressed: DataFrame) -> DataFrame:
    """(group_size, logical_size, compressed_size, ratio) over all groups of a size."""
    rows = compressed.select(F.size("chunk_ids").cast("long").alias("group_size"), "orig_size", "comp_size")
    sums = rows.groupBy("group_size").agg(F.sum("orig_size").alias("logical_size"), F.sum("comp_size").alias("compressed_size"))
    return sums.withColumn("ratio", ratio("logical_size", "compressed_size"))


def grouping_quality(groups: DataFrame) -> DataFrame:
    """One row: groups (single chunks included), chunks, the share of chunks that are alone in percent, and the mean number of
    chunks of a group."""
    sizes = groups.groupBy("members").agg(F.count(F.lit(1)).alias("chunks"))  # a row for each size
    sums = sizes.agg(F.round(F.sum(F.col("chunks") / F.col("members"))).cast("long").alias("groups"), F.sum("chunks").alias("chunks"), F.coalesce(F.sum(F.when(F.col("members") == 1, F.col("chunks"))), F.lit(0)).alias("alone"))
    return sums.select("groups", "chunks", F.round(F.try_divide(100.0 * F.col("alone"), "chunks"), 1).alias("alone_percent"), F.round(F.try_divide("chunks", "groups"), 2).alias("mean_chunks"))


def feature_counts(features: DataFrame) -> DataFrame:
    """Counts of the features: chunks, chunks without any sampled hash, distinct buckets."""
    zero = F.forall("features", lambda x: x == 0)
    return features.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(zero).alias("zero_chunks"), F.count_distinct(F.get("sf", 0)).alias("first_keys"), F.count_distinct("hsf.a").alias("max_features"))


def dedup_summary(fingerprints: DataFrame) -> DataFrame:
    """One row: chunks and bytes before and after deduplication.  Sums by fingerprint first, so that no list of
    distinct fingerprints is needed."""
    each = fingerprints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("size").cast("long").alias("size"))
    sums = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"),
        F.count(F.lit(1)).alias("unique_chunks"),
        F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("logical_size"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("unique_size"),
    )
    return sums.withColumn("dedup_ratio", ratio("logical_size", "unique_size"))


def run_summary(compressed: DataFrame, dedup: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: groups, sizes, ratios and throughput of a run."""
    sums = compressed.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("comp_size"), F.lit(0)).cast("long").alias("compressed_size"))
    out = dedup.select("logical_size", "unique_size").crossJoin(sums)  # one row and one row
    out = out.withColumns({"overall_ratio": ratio("logical_size", "compressed_size"), "unique_ratio": ratio("unique_size", "compressed_size")})
    if seconds is not None:
        out = out.withColumns({"seconds": F.lit(seconds), "throughput_mib_s": F.round(F.col("logical_size") / (F.lit(seconds) * (1 << 20)), 3)})
    return out
