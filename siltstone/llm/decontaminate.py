"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of 13 consecutive words of the items (an item with fewer is one pattern).  For
each pattern length there is a table of shifts, indexed by a hash of the last two words seen: how
far the search may move on without missing an occurrence.  Where the shift is 0, the hashes of the suffix and the
prefix select a bucket of patterns, and words are compared directly.  The search runs many cursors in
lockstep, one for each stretch of 64 words, so that numpy does the shifting.

Patterns are places in the items' words, 24 bytes each, and the table of shifts grows with their number (8 to 16
slots each).  Tables are broadcast for items of at most ``ITEM_BYTES`` of distinct text, and take about ten times
that; beyond it the items are searched in slices of that size, one pass after the other, each adding to the
hits of the previous one.

Defined results: a null or empty text has no words and no hits; an item without words has no
windows; items with equal texts are searched once, and all their ids are found; rows of equal id are one item; words of
an item without an id are hit, but the item is not listed; an empty benchmark gives no hits; an empty table
gives an empty one; columns with the results' names are replaced, all others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import bounded_batches, mix64, read_table, steps, text_bytes, written
from siltstone.llm.words import Words

WINDOW = 13
ITEM_BYTES = 16 << 20
STRETCH = 64


def _pairs(h: np.ndarray) -> np.ndarray:
    """A hash of each word and its predecessor."""
    out = h * np.uint64(0xFF51AFD7ED558CCD)
    out[1:] += h[:-1]
    return out * np.uint64(0xC4CEB9FE1A85EC53)


class Patterns:
    """Shift table and buckets of patterns of one length (in words).  A pattern is the place of its first word in
    ``words``, the words of all items; ``item`` tells the item of each."""

    def __init__(self, length: int, words: Words, start: np.ndarray, item: np.ndarray):
        self.length, self.block = length, min(2, length)
        self.raw, self.word_start, self.word_end = words.lower, words.start, words.end  # shared by all lengths
        self.hash = words.hash
        codes = self.code(words.hash)
        # a pattern that an item has several times counts once
        whole = np.zeros(len(start), np.uint64)
        for k in range(length):
            whole = mix64(whole + words.hash[start + k]) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((item, whole))
        new = np.ones(len(order), bool)
        new[1:] = (whole[order][1:] != whole[order][:-1]) | (item[order][1:] != item[order][:-1])
        start, item = start[order[new]], item[order[new]]
        self.bits = min(26, max(12, int(8 * max(1, len(start))).bit_length()))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int8 if length < 100 else np.int32)
        for end in range(self.block, length + 1):
            np.minimum.at(self.shift, self.slot(codes[start + end - 1]), length - end)
        key = self.key(codes, start)
        order = np.argsort(key, kind="stable")
        self.sorted_key, self.start, self.item = key[order], start[order].astype(np.int32), item[order].astype(np.int32)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - self.bits)).astype(np.int64)

    def code(self, h: np.ndarray) -> np.ndarray:
        return _pairs(h) if self.block == 2 else h * np.uint64(0xC4CEB9FE1A85EC53)

    def key(self, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hash of the suffix and the prefix of the patterns that would start there."""
        return codes[start + self.length - 1] + codes[start + self.block - 1] * np.uint64(0x9E3779B97F4A7C15)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts (in words) of occurrences, and the item of each; never across two texts."""
        n, m = len(words), self.length
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        codes = self.code(words.hash)
        shift_at = self.shift[self.slot(codes)]  # by the word that ends the block
        at = np.arange(m - 1, n, STRETCH)
        stop = np.minimum(at + STRETCH, n)
        found = []
        while len(at):
            s = shift_at[at]
            hit = at[s == 0]
            if len(hit):
                found.append(hit)
            at = at + np.maximum(s, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return none, none
        end = np.sort(np.concatenate(found))
        start = end - m + 1
        inside = np.searchsorted(words.first, start, "right") == np.searchsorted(words.first, end, "right")
        start = start[inside]
        key = self.key(codes, start)
        lo = np.searchsorted(self.sorted_key, key, "left")
        size = np.searchsorted(self.sorted_key, key, "right") - lo
        which = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start = np.repeat(start, size)
        for k in range(m):  # most of what is left of a bucket goes with the first words
            same = words.hash[start + k] == self.hash[self.start[which] + k]
            start, which = start[same], which[same]
        ok = np.array([self._equal(words, s, w) for s, w in zip(start.tolist(), self.start[which].tolist())], bool)
        return start[ok], self.item[which[ok]]

    def _equal(self, words: Words, start: int, own: int) -> bool:
        return all(
            words.lower[words.start[start + k] : words.end[start + k]].tobytes() == self.raw[self.word_start[own + k] : self.word_end[own + k]].tobytes() for k in range(self.length)
        )


def build(texts: list[str | None], window: int = WINDOW) -> list[Patterns]:
    """The patterns of items, for each length."""
    data = pa.array(texts, pa.large_string())
    raw, offsets = text_bytes(data)
    words = Words(raw, offsets)
    count = np.diff(words.first)
    out = []
    for m in np.unique(np.minimum(count[count > 0], window)).tolist():
        own = np.flatnonzero(np.minimum(count, window) == m)
        n = count[own] - m + 1
        start = np.repeat(words.first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append(Patterns(m, words, start, np.repeat(own, n)))
    return out


def _search(batches: Iterator[pa.RecordBatch], tables, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds (or extends) the columns ``names``: number of words, hit runs (starts, ends) and the
    ids of items found, as strings."""
    patterns, ids = tables.value
    n_col, run_col, item_col = names
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        had = item_col in batch.schema.names
        old_runs = batch.column(run_col).to_pylist() if had else None
        old_items = batch.column(item_col).to_pylist() if had else None
        count = np.zeros(len(batch), np.int64)
        runs: list[list] = [[] for _ in range(len(batch))]
        items: list[set] = [set() for _ in range(len(batch))]
        for i, j in steps(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            count[i:j] = np.diff(words.first)
            for p in patterns:
                start, which = p.find(words)
                row = np.searchsorted(words.first, start, "right") - 1
                for r, s, k in zip(row.tolist(), (start - words.first[row]).tolist(), which.tolist()):
                    runs[i + r].append((s, s + p.length))
                    items[i + r].update(ids[k])
        for r in range(len(batch)) if had else ():
            runs[r] += [(x["start"], x["end"]) for x in old_runs[r]]
            items[r].update(old_items[r])
        arrays = [
            pa.array(count),
            pa.array([[{"start": a, "end": b} for a, b in _joined(x)] for x in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        ]
        kept = [c for c in batch.schema.names if c not in names]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + arrays, names=kept + names)


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_benchmark(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_col: str = "text", window: int = WINDOW, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """``df`` with ``n_words``, ``hit_runs`` (runs of hit words, end exclusive) and ``hit_items``
    (ids as strings, sorted); columns of these names are replaced."""
    spark = df.sparkSession
    bounded_batches(spark)
    names = ["n_words", "hit_runs", "hit_items"]
    # equal texts are one item with several ids
    items = written(
        benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(item_col).alias("text")).where("text is not null").groupBy("text").agg(F.array_sort(F.collect_set("id")).alias("ids")),
        "items",
    )
    size = F.octet_length("text") + F.aggregate("ids", F.lit(0), lambda s, x: s + F.octet_length(x) + 16)
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    slices = max(1, -(-total // item_bytes))
    out = df.drop(*[c for c in df.columns if c.lower() in names])
    fields = T.StructType(
        [*out.schema.fields, *T.DataType.fromDDL("n_words long, hit_runs array<struct<start:long,end:long>>, hit_items array<string>").fields]
    )
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k)
        got = part.collect()  # about item_bytes
        tables = spark.sparkContext.broadcast((build([r.text for r in got], window), [r.ids for r in got]))
        out = out.mapInArrow(lambda b, t=tables: _search(b, t, text_col, names), fields)
    return out


def with_verdict(found: DataFrame) -> DataFrame:
    """``n_hit`` and ``contaminated``: any hit word, and hit words at least a twentieth of all."""
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op7_wu_manber(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, read_table(spark, sf_dir, "benchmark")).drop("text")
    return with_verdict(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
