"""Representative sub-chunks: the piece of a chunk that stands for it when leftovers are regrouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.arrow import cut_ends
from siltstone.operators.chunking import pieces
from siltstone.session import prepare

CHOICES = ("largest", "min_hash", "largest_inner", "min_hash_inner")


def _largest(p: Column) -> Column:
    return F.array_max(F.transform(p, lambda x: F.struct((x["end"] - x["start"]).alias("size"), (-x["start"]).alias("before"), x["start"], x["end"])))


def _min_hash(p: Column, content: Column) -> Column:
    return F.array_min(F.transform(p, lambda x: F.struct(F.sha2(F.substring(content, x["start"] + 1, x["end"] - x["start"]), 256).alias("fp"), x["start"], x["end"])))


def representatives(chunks: DataFrame, average: int, choice: str = "min_hash") -> DataFrame:
    """(chunk_id, sub_start, sub_end, sub): the largest piece or the one with the smallest fingerprint, the
    first on ties; ``_inner``: of those that are not the first or last piece, or else the largest."""
    prepare(chunks.sparkSession)
    p, content, size = F.col("p"), F.col("content"), F.octet_length("content")
    cut = chunks.select("chunk_id", "content", cut_ends(content, average).alias("ends")).select("chunk_id", "content", pieces(content, F.col("ends")).alias("p"))
    inner = F.filter(p, lambda x: (x["seq"] > 0) & (x["end"] < size))
    spans = {
        "largest": lambda: _largest(p),
        "min_hash": lambda: _min_hash(p, content),
        "largest_inner": lambda: F.coalesce(_span(_largest(inner)), _span(_largest(p))),
        "min_hash_inner": lambda: F.coalesce(_span(_min_hash(inner, content)), _span(_largest(p))),
    }
    found = cut.where(F.size("p") > 0).select("chunk_id", "content", spans[choice]().alias("s"))
    start, end = F.col("s.start"), F.col("s.end")
    return found.select("chunk_id", start.alias("sub_start"), end.alias("sub_end"), F.substring(content, start + 1, end - start).alias("sub"))


def _span(s: Column) -> Column:
    return F.when(s.isNotNull(), F.struct(s["start"].alias("start"), s["end"].alias("end")))
