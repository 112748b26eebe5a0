"""Dense ids and places in a global order, without putting all rows in one partition.

Rows are dealt to ranges of the order, which also cuts a key that holds many rows; each range is numbered on
its own and written; the ranges' sizes (a row for each partition) give their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import written

_LOCAL = (1 << 33) - 1


def ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` in ranges of ``order``, with ``_part`` and the row's place in it, ``_at``."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(_LOCAL)}), "ranged")


def offsets(parts: DataFrame) -> DataFrame:
    """(``_part``, ``_before``: rows in the ranges before); at most a row for each partition."""
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))


def dense_id(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with ids from ``start`` in the order given (which must tell all rows apart)."""
    parts = ranged(df, order)
    return parts.join(F.broadcast(offsets(parts)), "_part").withColumn(name, F.col("_at") + F.col("_before") + start).drop("_part", "_at", "_before")


def running_sum(rows: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before, in the order given: sums within ranges and
    one offset for each range."""
    parts = ranged(rows, order)
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("s"))
    before = F.sum("s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    out = parts.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(base), "_part")
    return out.withColumn(name, F.col("_base") + F.col("_own")).drop("_part", "_at", "_own", "_base")


def places(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 0, among the rows of its key."""
    numbered = dense_id(df, [*keys, *order], "_g")
    first = numbered.groupBy(*keys).agg(F.min("_g").alias("_first"))
    return numbered.join(first, keys).withColumn(name, F.col("_g") - F.col("_first")).drop("_g", "_first")
