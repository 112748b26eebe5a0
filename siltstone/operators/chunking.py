"""Files to chunks, fixed or content-defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions.arrow import cut_ends
from siltstone.session import prepare


def fixed_chunks(files: DataFrame, size: int) -> DataFrame:
    """(file_id, seq, size, content) of chunks of ``size`` bytes, the last one shorter; none of empty files.  A row is a
    file, or, with a column ``start``, a range of one that starts at a multiple of ``size``."""
    n = F.octet_length("content")
    first = F.floor(F.col("start") / size).cast("int") if "start" in files.columns else F.lit(0)
    rows = files.where(n > 0).select("file_id", "content", first.alias("first"), F.explode(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)).alias("at"))
    part = F.substring(F.col("content"), F.col("at") * size + 1, F.lit(size))
    return rows.select("file_id", (F.col("first") + F.col("at")).alias("seq"), part.alias("content")).select("file_id", "seq", F.octet_length("content").alias("size"), "content")


def pieces(content: Column, ends: Column) -> Column:
    """(seq, start, end) of pieces from their ends."""
    return F.transform(ends, lambda e, i: F.struct(i.alias("seq"), F.when(i == 0, 0).otherwise(F.get(ends, i - 1)).alias("start"), e.alias("end")))


def cdc_chunks(files: DataFrame, average: int) -> DataFrame:
    """(file_id, seq, size, content) of content-defined chunks."""
    prepare(files.sparkSession)
    cut = files.select("file_id", "content", cut_ends(F.col("content"), average).alias("ends"))
    rows = cut.select("file_id", "content", F.explode(pieces(F.col("content"), F.col("ends"))).alias("p"))
    size = (F.col("p.end") - F.col("p.start")).alias("size")
    return rows.select("file_id", F.col("p.seq").alias("seq"), size, F.substring(F.col("content"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("content"))


def chunks(files: DataFrame, config: Config) -> DataFrame:
    if config.chunking == "fixed":
        return fixed_chunks(files, config.chunk_size)
    if config.chunking == "cdc":
        if "start" in files.columns:
            raise ValueError("content-defined chunks need whole files")
        return cdc_chunks(files, config.chunk_size)
    raise ValueError(f"chunking is 'fixed' or 'cdc', not {config.chunking!r}")
