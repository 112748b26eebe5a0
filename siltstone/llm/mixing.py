"""Mixing sources to target weights: hash-random keys, range buckets of keys within each source,
distributed prefix sums of token counts, and a cut at each source's exact budget.

Keys are uniform, so key ranges of equal width hold about equal numbers of rows, without a sample.  A
source has about the square root of its rows as buckets, so neither the sums of buckets nor the
rows of the one bucket with the cut gather much in a task, however large a source is.  The cut is a
key for each source; rows are then taken or not by comparison, and texts are never shuffled.

Defined results: a null size counts as 0, a null source is a source of its own (the last); rows with
equal keys (repeated rows) share what is left of the budget equally; an empty table gives an empty
result; columns of the input that have the names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import read_table, written

OUT = ("source_size", "target", "taken")
#: Plans of up to so many sources are broadcast (a few MB); larger ones are joined by shuffles.
BROADCAST_SOURCES = 50_000
#: Words as the mix counts them.
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"


def text_size(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def random_key(id_, seed: int):
    """60 bits of a hash of the seed and the id, uniform and the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """A row for each source: targets by water-filling.  Sources in the order of limit/weight are
    capped until the level that the rest would get is below the next one's limit."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    all_ = Window.partitionBy()
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumns({"place": place, "weight": weight})
        .withColumns({"limit": F.col("source_size") * F.lit(float(most)), "goal": F.sum("source_size").over(all_) * F.lit(float(share))})
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumns({"capped": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "used": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
        .withColumn("level", F.try_divide(F.col("goal") - F.col("capped"), F.sum("weight").over(all_) - F.col("used")))
        .withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place"))).over(all_))
        .withColumn("target", F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("weight")), F.col("limit")))
        .select("source", "place", "n", "source_size", "target")
    )


def mix_sources(
    df: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 8, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size"
) -> DataFrame:
    """``df`` with ``source_size``, ``target`` and ``taken``: the tokens that the mix takes of a row."""
    kept = [c for c in df.columns if c.lower() not in OUT]
    rows = df.select(
        F.col(source_col).alias("source"),
        F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"),
        random_key(F.col(id_col), seed).alias("key"),
        F.struct(*kept).alias("row"),
    )
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, share, most).withColumn("buckets", F.ceil(F.sqrt("n")))
    budget = F.floor(F.col("target"))
    plan = plan.withColumn("epochs", F.coalesce(F.try_divide(budget, F.col("source_size")), F.lit(0)).cast("long"))
    plan = written(plan.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "plan")
    small = plan.select("source", "place", "buckets", "rest")
    if plan.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    bucket = F.least(F.floor(F.col("key") / F.lit(2.0**60) * F.col("buckets")), F.col("buckets") - 1)
    keyed = (
        rows.select(F.col("source").alias("own"), "size", "key")
        .join(small, F.col("own").eqNullSafe(F.col("source")))
        .select("place", "rest", bucket.alias("bucket"), "key", "size")
    )
    order = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        keyed.groupBy("place", "bucket", "rest")
        .agg(F.sum("size").alias("sum"))
        .withColumn("before", F.coalesce(F.sum("sum").over(order), F.lit(0)))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("sum")))
        .select("place", "bucket", "before")
    )
    order = Window.partitionBy("place").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        keyed.join(at, ["place", "bucket"])
        .groupBy("place", "key", "rest", "before")
        .agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("rows"))
        .withColumn("before", F.col("before") + F.coalesce(F.sum("sum").over(order), F.lit(0)))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("sum")))
        .select("place", F.col("key").alias("cut_key"), F.floor((F.col("rest") - F.col("before")) / F.col("rows")).alias("cut_part"))
    )
    cuts = written(plan.join(cut, "place", "left").select(F.col("source").alias("of"), "source_size", "target", "epochs", "cut_key", "cut_part"), "cuts")
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    last = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.least("size", "cut_part"))
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("of"))).select(
        "row.*", "source_size", "target", (F.col("epochs") * F.col("size") + F.coalesce(last, F.lit(0))).cast("long").alias("taken")
    )


def mixed_rows(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix as rows: each as often as its tokens were taken, rounded to whole rows (half up); rows
    without tokens stay once.  Columns as in ``df``."""
    sized = df.select(F.struct(*df.columns).alias("row"), F.col(options.pop("id_col", "doc_id")).alias("id"), F.col(options.pop("source_col", "source")).alias("source"), text_size(text_col).alias("size"))
    mixed = mix_sources(sized, id_col="id", **options)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def op8_mixing(spark, sf_dir):
    slim = written(read_table(spark, sf_dir, "documents").select("doc_id", "source", text_size().alias("size")), "sizes")
    return mix_sources(slim).select("doc_id", "size", "source_size", "target", "taken")
