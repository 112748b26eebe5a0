"""Connected components of a graph of links, by alternating large and small stars.

Ids with very many links (hubs) are few: at most ``2 * links / limit``.  Their links are not gathered by id; the
smallest neighbour of a hub comes from partial minima, and is broadcast to its links where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import written

#: Links of an id above which it is a hub, at least; and hubs at most.
HUB_LINKS, MOST_HUBS = 256, 5000


def _with_least(links: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, m) for each link, m: the smallest v of u; and (u, m)."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))  # at most MOST_HUBS rows
    light = links.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return light.select("u", "v", "m").unionByName(links.join(hubs, "u").select("u", "v", "m")), least.select("u", "m")


def _large_star(links: DataFrame, limit: int) -> DataFrame:
    both = links.union(links.select("v", "u"))
    near, _ = _with_least(both, limit)
    return near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(links: DataFrame, limit: int) -> DataFrame:
    near, least = _with_least(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), limit)
    moved = near.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(``id``, ``component``: the smallest id) for every id of a link between two different ids.  Each
    round is written to the shared folder; rounds grow with the logarithm of the components' size."""
    now = written(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == tuple(row):
            break
        state = tuple(row)
        limit = max(HUB_LINKS, -(-2 * row[0] // MOST_HUBS))
        large = written(_large_star(now, limit), "links")
        now = written(_small_star(large, limit), "links")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
