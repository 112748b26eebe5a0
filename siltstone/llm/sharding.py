"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows with equal texts form a group, and every group is placed where the dot product of its sizes with the
residual capacity is highest.

1. Groups over ``1 / (shards * large)`` of the whole in any measure are large; there are at most three times
   ``shards * large`` of them, so the driver places them, the largest first.  A group that fits into a
   shard stays whole; only one that is larger than a shard is cut, by a hash of its row ids.
2. All other groups are dealt to buckets by their hash.  The room that the large groups left in each shard is dealt to the
   buckets in proportion to their sizes, and each bucket's groups are placed in one task, the largest first.  Buckets
   grow with the number of groups (up to ``MOST_BUCKETS``), so that a task's memory is bounded by the groups of
   a bucket, 40 bytes each.

Only sums move for this.  Rows then move once, to the places of their groups, where they are numbered; rows of large groups
are dealt to pieces by a hash of their ids for that, each of at most about a ``PIECES``-th of a shard.

Defined results: a null text counts as empty; a null id is hashed like a value; repeated rows are
rows of their own; rows with equal ids and texts get their slots in any order; an empty table gives an empty result;
columns of the input that have the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, fresh, read_table, written

#: How much bytes, tokens and rows count in the dot product; bytes most, as they are what has to be near equal (law `bytes`).
WEIGHTS = (16.0, 1.0, 1.0)
#: Groups of a bucket, about.
BUCKET_GROUPS = 1 << 14
MOST_BUCKETS = 2048
#: Pieces of a large group that has a shard of its own.
PIECES = 64


def pack(items: np.ndarray, room: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The shard of each item (a row of sizes): largest first, to the highest dot product with the residual
    capacity, the lowest shard on ties.  ``room``: the capacity of each shard, which is reduced; sizes and
    room count in ``unit``."""
    scale = np.sqrt(WEIGHTS) / np.where(unit > 0, unit, 1)
    share, left = items * scale, room * scale
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.sum(axis=1))):
        out[i] = k = int(np.argmax(left @ share[i]))
        left[k] -= share[i]
    room -= np.stack([np.bincount(out, items[:, m], len(room)) for m in range(items.shape[1])], axis=1) if len(items) else 0
    return out


def _starts(shard: np.ndarray, rows: np.ndarray, shards: int) -> np.ndarray:
    """The number of rows placed in the same shard before each item."""
    out = np.zeros(len(shard), np.int64)
    for k in range(shards):
        own = shard == k
        out[own] = np.cumsum(rows[own]) - rows[own]
    return out


def _place(table: pa.Table, room: np.ndarray, unit: np.ndarray, total: np.ndarray) -> pa.Table:
    """Places the groups of one bucket into its part of the room."""
    table = table.sort_by("group")
    items = np.stack([table.column(c).to_numpy() for c in ("bytes", "tokens", "rows")], axis=1).astype(np.float64)
    part = np.divide(items.sum(axis=0), total, out=np.zeros(3), where=total > 0)
    turn = table.column("bucket")[0].as_py() % len(room)  # so that ties do not favour one shard in all buckets
    shard = (pack(items, np.roll(room * part, -turn, axis=0), unit * part) + turn) % len(room)
    start = _starts(shard, table.column("rows").to_numpy(), len(room))
    return pa.table({"bucket": table.column("bucket"), "group": table.column("group"), "rows": table.column("rows"), "shard": pa.array(shard, pa.int32()), "start": start})


def _numbered(groups: DataFrame, first: np.ndarray) -> DataFrame:
    """Groups with the first slot of their own: ``start`` counts within (bucket, shard), ``first`` are slots in use."""
    spark = groups.sparkSession
    used = spark.createDataFrame([(k, int(n)) for k, n in enumerate(first)], "shard int, used long")
    counts = groups.groupBy("shard", "bucket").agg(F.sum("rows").alias("n"))
    order = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    # at most MOST_BUCKETS rows for each shard
    before = before.join(F.broadcast(used), "shard").select("shard", "bucket", (F.col("before") + F.col("used")).alias("before"))
    return groups.join(F.broadcast(before), ["shard", "bucket"]).select("group", "shard", (F.col("start") + F.col("before")).alias("start"))


def pack_shards(
    df: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    large: int = 256,
    measures: tuple[str, str, str] | None = None,
    bucket_groups: int = BUCKET_GROUPS,
) -> DataFrame:
    """``df`` with ``shard`` and a gapless ``slot`` in it.  ``measures`` names columns that already
    hold a row's bytes, tokens and group, so that ``df`` needs no text."""
    spark = df.sparkSession
    bounded_batches(spark)
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    g, piece, start = (fresh(df, f"_{x}") for x in ("group", "piece", "start"))
    text = F.coalesce(F.col(text_col), F.lit("")) if measures is None else None
    values: list[Column] = (
        [F.octet_length(text).cast("long"), F.regexp_count(text, F.lit(r"\S+")).cast("long"), F.xxhash64(text)]
        if measures is None
        else [F.col(c).cast("long") for c in measures]
    )
    slim = df.select(F.col(id_col).alias("id"), values[2].alias("group"), *(F.coalesce(v, F.lit(0)).alias(n) for n, v in zip(("bytes", "tokens"), values)))
    if measures is None:
        slim = written(slim, "sizes")  # texts are measured once
    sums = (F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = written(slim.groupBy("group").agg(*sums), "groups")
    n_groups, *total = groups.agg(F.count(F.lit(1)), F.sum("bytes"), F.sum("tokens"), F.sum("rows")).first()
    if not n_groups:
        return df.select(*kept).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    total = np.array([float(x or 0) for x in total])
    weight = F.greatest(*(F.col(c) / F.lit(max(1.0, x)) for c, x in zip(("bytes", "tokens", "rows"), total))) * shards  # 1: a shard
    is_large = weight > 1 / large
    pieces = F.least(F.ceil(weight * PIECES), F.col("rows")).cast("long").alias("pieces")
    big = F.broadcast(written(groups.where(is_large).select("group", pieces, (weight <= 1).alias("whole")), "large"))  # at most 3 * shards * large rows
    of = F.pmod(F.xxhash64("id", F.lit(6)), F.col("pieces")).alias("piece")
    parts = slim.join(big, "group").groupBy("group", of, "whole").agg(*sums).collect()  # at most that many, and 3 * shards * PIECES
    parts.sort(key=lambda r: (r["group"], r["piece"]))
    sizes = np.array([[r["bytes"], r["tokens"], r["rows"]] for r in parts], np.float64).reshape(-1, 3)
    units = {u: k for k, u in enumerate(dict.fromkeys((r["group"], -1 if r["whole"] else r["piece"]) for r in parts))}
    unit = np.array([units[r["group"], -1 if r["whole"] else r["piece"]] for r in parts], np.int64)
    items = np.stack([np.bincount(unit, sizes[:, m], len(units)) for m in range(3)], axis=1)
    room = np.tile(total / shards, (shards, 1))
    shard = pack(items, room, total / shards)[unit]
    count = sizes[:, 2].astype(np.int64)
    used = np.bincount(shard, count, shards).astype(np.int64)
    table = spark.createDataFrame(
        [(r["group"], r["piece"], int(k), int(o)) for r, k, o in zip(parts, shard, _starts(shard, count, shards))], f"`{g}` long, `{piece}` long, shard int, `{start}` long"
    )
    rest = total - items.sum(axis=0)
    n_buckets = min(MOST_BUCKETS, max(1, -(-n_groups // bucket_groups)))
    small = groups.where(~is_large).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(n_buckets)).cast("int"))
    placed = small.groupBy("bucket").applyInArrow(lambda x: _place(x, room, total / shards, rest), "bucket int, group long, rows long, shard int, start long")
    small = _numbered(written(placed, "placed"), used).select(F.col("group").alias(g), F.lit(-1).cast("long").alias(piece), "shard", F.col("start").alias(start))
    rows = df.select(*kept, values[2].alias(g)).join(big.select(F.col("group").alias(g), F.struct("pieces").alias(piece)), g, "left")
    rows = rows.withColumn(piece, F.coalesce(F.pmod(F.xxhash64(F.col(id_col), F.lit(6)), F.col(f"{piece}.pieces")), F.lit(-1)))
    # one exchange by (group, piece) for the join and for the numbers
    order = Window.partitionBy(g, piece).orderBy(F.col(id_col))
    rows = rows.join(small.unionByName(table).hint("merge"), [g, piece])
    return rows.withColumn("slot", F.col(start) + F.row_number().over(order) - 1).select(*kept, "shard", "slot")


def op6_vector_sharding(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = written(
        read_table(spark, sf_dir, "documents").select(
            "doc_id",
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
            F.xxhash64(text).alias("grp"),
        ),
        "sizes",
    )
    return pack_shards(slim, measures=("size", "tokens", "grp")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
