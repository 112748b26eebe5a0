"""From compressed groups back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.arrow import unlz4
from siltstone.session import prepare


def decompressed(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chunk_id, content) of every chunk of compressed groups: each group is decoded on its own, and chunks
    are cut out at the sums of the sizes before them."""
    prepare(groups.sparkSession)
    raw = groups.select("group_id", "chunk_ids", unlz4(F.col("payload"), F.col("codec"), F.col("orig_size")).alias("raw"))
    rows = raw.select("group_id", F.posexplode("chunk_ids").alias("at", "chunk_id"))
    listed = rows.join(sizes.select("chunk_id", "size"), "chunk_id").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("s"))
    start = F.aggregate(F.slice("s", F.lit(1), F.col("at")), F.lit(0), lambda t, x: t + x["size"])
    chunk = raw.join(listed, "group_id").select("raw", "s", F.posexplode("chunk_ids").alias("at", "chunk_id"))
    return chunk.select("chunk_id", F.substring(F.col("raw"), start + 1, F.get("s", F.col("at"))["size"]).alias("content"))


def restored_parts(recipes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, seq, content) of every part of every file; no row holds more than a chunk."""
    return recipes.join(chunks.select("chunk_id", "content"), "chunk_id").select("file_id", "seq", "content")


def restored(recipes: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, length, sha256, content) of every file, from its recipe; files without chunks are empty.  A
    file's chunks meet in one row, as its content must; files of any size: ``restored_parts``."""
    whole = restored_parts(recipes, chunks).groupBy("file_id").agg(F.expr("listagg(content) WITHIN GROUP (ORDER BY seq)").alias("c"))
    out = files.select("file_id").join(whole, "file_id", "left").select("file_id", F.coalesce("c", F.lit(b"")).alias("content"))
    return out.select("file_id", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"), "content")
