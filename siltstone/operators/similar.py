"""Indexes of features: buckets, similar records, co-occurrence."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import written


def first_key_index(features: DataFrame) -> DataFrame:
    """Bucket sizes by the first super-feature."""
    return features.groupBy(F.get("sf", 0).alias("key")).agg(F.count(F.lit(1)).alias("members"))


def max_feature_index(features: DataFrame) -> DataFrame:
    return features.groupBy(F.col("hsf.a").alias("key")).agg(F.count(F.lit(1)).alias("members"))


def feature_index(features: DataFrame) -> DataFrame:
    """(feature, chunk_id) of every distinct feature of a chunk."""
    return features.select("chunk_id", F.explode(F.array_distinct("features")).alias("feature"))


def features_by_bucket_size(features: DataFrame) -> DataFrame:
    """Features by ascending number of chunks that have them."""
    return feature_index(features).groupBy("feature").agg(F.count(F.lit(1)).alias("members")).orderBy("members", "feature")


def similar_count(features: DataFrame) -> DataFrame:
    """The number of chunks in buckets of more than one."""
    return first_key_index(features).where("members > 1").agg(F.coalesce(F.sum("members"), F.lit(0)).alias("similar_chunks"))


def _keys(features: DataFrame) -> DataFrame:
    return features.select("chunk_id", F.posexplode("sf").alias("pos", "key"))


def similar_record(features: DataFrame, last: bool = False) -> DataFrame:
    """(chunk_id, similar_id): another chunk that shares a super-feature, the first super-feature that has
    any counts; of its chunks the smallest id (``last``: the largest), null without any.

    Only the two smallest (largest) ids of a bucket can be the answer for any member, so a bucket is
    reduced to them before the join, however many members it has."""
    keys = _keys(features)
    best = keys.groupBy("pos", "key").agg(F.max("chunk_id").alias("x") if last else F.min("chunk_id").alias("x"))
    rest = keys.join(best, ["pos", "key"]).where("chunk_id <> x").groupBy("pos", "key").agg(F.max("chunk_id").alias("y") if last else F.min("chunk_id").alias("y"))
    ends = best.join(rest, ["pos", "key"])  # buckets of one have no answer
    other = F.when(F.col("chunk_id") == F.col("x"), F.col("y")).otherwise(F.col("x"))
    hits = keys.join(ends, ["pos", "key"]).select("chunk_id", "pos", other.alias("other"))
    found = hits.groupBy("chunk_id").agg(F.min_by("other", "pos").alias("similar_id"))
    return features.select("chunk_id").join(found, "chunk_id", "left")


def probe(features: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, similar_id) for probes (probe_id, sf): the smallest id of the first super-feature that is
    in the index."""
    index = _keys(features).groupBy("pos", "key").agg(F.min("chunk_id").alias("other"))
    asked = probes.select("probe_id", F.posexplode("sf").alias("pos", "key"))
    hits = asked.join(index, ["pos", "key"]).groupBy("probe_id").agg(F.min_by("other", "pos").alias("similar_id"))
    return probes.select("probe_id").join(hits, "probe_id", "left")


def cooccurrence(features: DataFrame) -> DataFrame:
    """(f1, f2, chunks): how many chunks have both of two different features.  Twelve features a chunk give
    at most 132 pairs, made from its own array."""
    distinct = features.select(F.array_distinct("features").alias("f"))
    pairs = distinct.select("f", F.explode("f").alias("f1")).select("f1", F.explode(F.array_remove("f", F.col("f1"))).alias("f2"))
    return pairs.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("chunks"))


def most_correlated(features: DataFrame) -> DataFrame:
    """For each feature the one that most chunks have with it (the smallest on ties)."""
    return cooccurrence(features).groupBy("f1").agg(F.max_by("f2", F.struct("chunks", -F.col("f2").cast("decimal(20,0)"))).alias("f2"), F.max("chunks").alias("chunks"))


def without(features: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without some chunks."""
    return features.join(gone, "chunk_id", "left_anti")


def _smallest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` smallest chunk ids of each key; ranges are limited before they are dealt out, however many rows a key has."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("chunk_id"))).where(F.col("_n") <= n).drop("_n")


def top_pairs(features: DataFrame, n: int = 20) -> DataFrame:
    """(i, j, shared): the ``n`` pairs of chunks with the most features in common, then by i and j.

    Pairs that share at least s features meet in the bucket of one of their subsets of s features.  From s = 12 down,
    a bucket's first ``n`` pairs by (i, j) are enough, since any pair before another one in a bucket shares as many;
    they lie within its n + 1 smallest ids.  The pairs found for a larger s are complete while they are fewer than
    ``n``, so whatever a bucket adds shares s exactly.  Buckets are thus never paired out."""
    sets = features.select("chunk_id", F.array_sort(F.array_distinct("features")).alias("f"))
    most = sets.agg(F.max(F.size("f"))).first()[0] or 0
    rows, pruned = sets, False
    found: dict[tuple[int, int], int] = {}
    for s in range(most, 0, -1):
        if s < most and not pruned:
            # equal sets count as one, features of one chunk are in no pair
            rows = written(_smallest(sets, "f", n + 1), "sets")
            flat = rows.select("chunk_id", F.explode("f").alias("feature"))
            common = flat.groupBy("feature").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("feature")
            rows = written(flat.join(common, "feature").groupBy("chunk_id").agg(F.array_sort(F.collect_list("feature")).alias("f")), "sets")
            pruned = True
        subsets = F.array(*(F.array(*map(F.lit, c)) for c in combinations(range(most), s)))
        of_row = F.transform(F.filter(subsets, lambda c: F.element_at(c, -1) < F.size("f")), lambda c: F.transform(c, lambda k: F.get("f", k)))
        keyed = rows.where(F.size("f") >= s).select("chunk_id", F.explode(of_row).alias("key"))
        ids = _smallest(keyed, "key", n + 1).groupBy("key").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids")).where("size(ids) > 1")
        each = F.transform("ids", lambda a, k: F.transform(F.slice("ids", k + 2, n), lambda b: F.struct(a.alias("i"), b.alias("j"))))
        pairs = ids.select(F.explode(F.slice(F.flatten(each), 1, n)).alias("p")).select("p.*").distinct()
        for r in pairs.orderBy("i", "j").limit(n + len(found)).collect():
            if len(found) < n:
                found.setdefault((r.i, r.j), s)
        if len(found) >= n:
            break
    out = sorted(((i, j, s) for (i, j), s in found.items()), key=lambda x: (-x[2], x[0], x[1]))
    return features.sparkSession.createDataFrame(out, "i long, j long, shared long")
