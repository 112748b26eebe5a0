"""Groups of similar chunks.  A group is named by its smallest chunk id until the end."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import combinations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ids import places
from siltstone.session import prepare, written


def pack(rows: DataFrame, keys: list[str], order: list, cap: int) -> DataFrame:
    """(grp, chunk_id, size_of_group): each key's rows in order, cut after every ``cap``.  A key may hold any share of the
    rows: places come from a range partitioning, which cuts it too."""
    placed = places(rows, keys, order).withColumn("pack", F.floor(F.col("place") / cap))
    return _named(placed, [*keys, "pack"])


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(grp, chunk_id, members) of groups by ``keys``; a group has at most cap rows, so this window's partitions are tiny."""
    same = Window.partitionBy(*keys)
    return rows.select(F.min("chunk_id").over(same).alias("grp"), "chunk_id", F.count(F.lit(1)).over(same).alias("members"))


def by_first_key(features: DataFrame, cap: int) -> DataFrame:
    """Buckets of the first super-feature, packed by chunk id."""
    return pack(features.select("chunk_id", F.get("sf", 0).alias("key")), ["key"], ["chunk_id"], cap)


def by_hierarchy(features: DataFrame, cap: int, descending: bool = False) -> DataFrame:
    """Buckets of the largest feature, by the finer keys (ascending: both; descending: as one rank), then id."""
    rows = features.select("chunk_id", "hsf.*")
    finer = [F.desc("b"), F.desc("c")] if descending else ["b", "c"]
    return pack(rows, ["a"], [*finer, "chunk_id"], cap)


def in_order(chunks: DataFrame, cap: int, dense: bool = False) -> DataFrame:
    """All chunks packed by id; ``dense``: ids are 0, 1, ... without gaps, so that nothing has to move."""
    if dense:
        n = chunks.agg(F.count(F.lit(1))).first()[0]
        first = F.floor(F.col("chunk_id") / cap) * cap
        return chunks.select(first.cast("long").alias("grp"), "chunk_id", F.least(F.lit(cap), F.lit(n) - first).cast("long").alias("members"))
    return pack(chunks.select("chunk_id", F.lit(0).alias("key")), ["key"], ["chunk_id"], cap)


def real(groups: DataFrame) -> DataFrame:
    return groups.where("members > 1")


def singles(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """Chunks that are in no group, each one a group of its own."""
    left = chunks.select("chunk_id").join(groups.select("chunk_id"), "chunk_id", "left_anti")
    return left.select(F.col("chunk_id").alias("grp"), "chunk_id", F.lit(1).cast("long").alias("members"))


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Merges the pair whose union is the largest that fits, the first one on ties, until none fits;
    returns the positions in each set."""
    sets, size = [[i] for i in range(len(sizes))], list(sizes)
    while True:
        best, pair = 0, None
        for i, j in combinations(range(len(sets)), 2):
            if best < size[i] + size[j] <= cap:
                best, pair = size[i] + size[j], (i, j)
                if best == cap:
                    break
        if pair is None:
            return sets
        i, j = pair
        sets[i] += sets.pop(j)
        size[i] += size.pop(j)


def next_fit(sizes: list[int], cap: int) -> list[int]:
    """The bin of each item: a new one whenever the next does not fit."""
    out, fill, bin_ = [], 0, -1
    for n in sizes:
        if bin_ < 0 or fill + n > cap:
            bin_, fill = bin_ + 1, 0
        out.append(bin_)
        fill += n
    return out


class FirstFit:
    """Puts each item into the first bin with room for it; bins are kept by their room, full ones are forgotten, so
    any number of items can come."""

    def __init__(self, cap: int):
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(cap + 1)]
        self.cap, self.bins = cap, 0

    def add(self, item: int, size: int) -> int:
        """The name of the bin: its first item."""
        room = min((r for r in range(size, self.cap) if self.open[r]), key=lambda r: self.open[r][0], default=None)
        if room is None:
            room, bin_ = self.cap, (self.bins, item)
            self.bins += 1
        else:
            bin_ = heappop(self.open[room])
        if room > size:
            heappush(self.open[room - size], bin_)
        return bin_[1]


def first_fit(sizes: list[int], cap: int) -> list[int]:
    """The bin of each item: every bin in turn takes all later items that still fit."""
    out, bin_ = [-1] * len(sizes), 0
    for i, n in enumerate(sizes):
        if out[i] >= 0:
            continue
        out[i], fill = bin_, n
        for j in range(i + 1, len(sizes)):
            if out[j] < 0 and fill + sizes[j] <= cap:
                out[j] = bin_
                fill += sizes[j]
                if fill == cap:
                    break
        bin_ += 1
    return out


def _bins(batches: Iterator[pa.RecordBatch], cap: int, fit: str) -> Iterator[pa.RecordBatch]:
    """Packs the items of each key, which come in order.  First fit keeps the bins with room, so a key may have any
    number of items; best fit holds the items of a key."""
    key, first = None, FirstFit(cap)
    held: list[tuple[int, int]] = []

    def flush() -> list[tuple[int, int]]:
        sizes = [n for _, n in held]
        merged = best_fit(sizes, cap)
        bins, at = [0] * len(held), next_fit([sum(sizes[i] for i in s) for s in merged], cap)
        for s, b in zip(merged, at):
            for i in s:
                bins[i] = b
        names: dict[int, int] = {}
        for (item, _), b in zip(held, bins):
            names[b] = min(item, names.get(b, item))
        return [(item, names[b]) for (item, _), b in zip(held, bins)]

    for batch in batches:
        out: list[tuple[int, int]] = []
        for k, item, size in zip(*(batch.column(c).to_pylist() for c in ("key", "item", "size"))):
            if k != key:
                out += flush() if held else []
                held, key, first = [], k, FirstFit(cap)
            if fit == "first":
                out.append((item, first.add(item, size)))
            else:
                held.append((item, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["item", "bin"])
    if held:
        out = flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["item", "bin"])


def _next_fit_range(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Next fit over one range of the order (key, rank, item).  The first key may go on from the range before, so its items
    are left open (``bin`` null); the last row (``item`` null) says how the range passes on the fill of a bin."""
    part, at = TaskContext.get().partitionId(), 0
    first = key = bin_ = None
    fill, seen = 0, False
    passed = {f: (f, None) for f in range(cap + 1)}  # fill at the start of the first key: fill and bin now
    for batch in batches:
        out: list[tuple] = []
        for k, item, size in zip(*(batch.column(c).to_pylist() for c in ("key", "item", "size"))):
            if not seen:
                seen, first = True, k
            if k == first:
                for f, (old, b) in passed.items():
                    passed[f] = (size, item) if old + size > cap else (old + size, b)
                out.append((item, None, part, at, size, None))
            else:
                if k != key or fill + size > cap:
                    bin_, fill = item, 0
                fill += size
                out.append((item, bin_, part, at, size, None))
            key = k
            at += 1
        yield _range_rows(out)
    if seen:
        state = {"first": first, "last": key, "one": key == first, "fill": fill, "bin": bin_, "passed": [[f, *passed[f]] for f in passed]}
        yield _range_rows([(None, None, part, at, None, json.dumps(state))])


def _range_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["item", "bin", "part", "at", "size", "state"])


def _go_on(table: pa.Table, cap: int) -> pa.Table:
    """The open items of a range, from the fill and bin with which it starts."""
    table = table.sort_by("at")
    fill, bin_, out = table.column("fill")[0].as_py(), table.column("carried")[0].as_py(), []
    for item, size in zip(table.column("item").to_pylist(), table.column("size").to_pylist()):
        if fill + size > cap:
            bin_, fill = item, 0
        out.append(bin_)
        fill += size
    return pa.table({"item": table.column("item"), "bin": pa.array(out, pa.int64())})


def next_fit_bins(items: DataFrame, cap: int) -> DataFrame:
    """(item, bin) of next fit within each key.  Ranges of the order are packed at the same time, whatever share of the
    items one key has: a range hands on a fill between 0 and ``cap``, so what it does to each possible fill (one row for a
    range) is enough to tell where the next one starts."""
    rows = items.select("key", "rank", "item", "size").repartitionByRange("key", "rank", "item").sortWithinPartitions("key", "rank", "item")
    schema = "item long, bin long, part int, at long, size int, state string"
    packed = written(rows.mapInArrow(lambda b: _next_fit_range(b, cap), schema), "next_fit")
    starts, last, fill, bin_ = [], None, cap, None
    for r in packed.where("item is null").select("part", "state").orderBy("part").collect():  # a row for each range
        state = json.loads(r["state"])
        if state["first"] != last or not starts:
            fill, bin_ = cap, None
        starts.append((r["part"], fill, bin_))
        if state["one"]:
            _, fill, opened = state["passed"][fill]
            bin_ = bin_ if opened is None else opened
        else:
            fill, bin_ = state["fill"], state["bin"]
        last = state["last"]
    entry = F.broadcast(items.sparkSession.createDataFrame(starts, "part int, fill int, carried long"))
    left = packed.where("item is not null and bin is null").join(entry, "part")
    gone_on = left.groupBy("part").applyInArrow(lambda t: _go_on(t, cap), "item long, bin long")
    return packed.where("bin is not null").select("item", "bin").unionByName(gone_on)


def fit_bins(items: DataFrame, cap: int, fit: str = "next", limit: int = 1000) -> DataFrame:
    """(item, bin) for items (key, rank, item, size), packed within each key in the order of rank and item.
    ``fit``: "next", "best" (best-fit merges, then next fit; keys with more than ``limit`` items are packed by
    next fit) or "first" (one rank only).  Sizes are 1 to ``cap``."""
    prepare(items.sparkSession)
    if fit == "next":
        return next_fit_bins(items, cap)
    large = None
    if fit == "best":
        hot = items.groupBy("key").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") > limit).select("key")
        if not hot.isEmpty():
            large, items = items.join(hot, "key", "left_semi"), items.join(hot, "key", "left_anti")
    dealt = items.select("key", "rank", "item", "size").repartition("key").sortWithinPartitions("key", "rank", "item")
    out = dealt.mapInArrow(lambda b: _bins(b, cap, fit), "item long, bin long")
    return out if large is None else out.unionByName(next_fit_bins(large, cap))


def regroup(groups: DataFrame, bins: DataFrame) -> DataFrame:
    """Groups put together as ``bins`` (item: a group's name) says."""
    return _named(groups.join(bins.withColumnRenamed("item", "grp"), "grp"), ["bin"])
