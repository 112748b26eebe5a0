"""The methods: how chunks become groups.  Each is a plan of the operators, and all share one frame."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions.arrow import gear_features
from siltstone.functions.keys import hierarchy, super_features
from siltstone.operators import chunking, compress, dedup, grouping, metrics, represent, restore
from siltstone.operators.grouping import by_first_key, by_hierarchy, fit_bins, in_order, real, regroup, singles
from siltstone.session import prepare, written
from siltstone.sources.files import first_files


class Corpus:
    """Files and what is derived from them; every part is computed once and written to the shared folder."""

    def __init__(self, files: DataFrame, config: Config = Config(), parts: DataFrame | None = None):
        """``parts``: the files' content as ranges (file_id, start, content); without, files have it themselves."""
        self.config = config
        self.files = first_files(files, config.files)
        self.parts = self.files if parts is None else parts.join(self.files.select("file_id"), "file_id", "left_semi")

    @cached_property
    def chunks(self) -> DataFrame:
        """Every chunk with its content.  Fixed chunks are cut out of the files whenever they are read, so that content is
        only written once, for unique chunks; content-defined ones are searched for once and written."""
        rows = chunking.chunks(self.parts, self.config)
        return dedup.with_fingerprint(rows if self.config.chunking == "fixed" else written(rows, "chunks"))

    @cached_property
    def fingerprints(self) -> DataFrame:
        return written(self.chunks.select("file_id", "seq", "size", "fp"), "fingerprints")

    @cached_property
    def firsts(self) -> DataFrame:
        return dedup.first_occurrences(self.fingerprints)  # reads ranges that are written already

    @cached_property
    def unique(self) -> DataFrame:
        return written(dedup.unique_chunks(self.chunks.drop("fp"), self.firsts), "unique")

    @cached_property
    def all(self) -> DataFrame:
        """Every chunk with an id of its own (for methods without deduplication)."""
        return dedup.with_ids(self.chunks, self.fingerprints)

    @cached_property
    def all_fingerprints(self) -> DataFrame:
        return dedup.with_ids(self.fingerprints, self.fingerprints)

    @cached_property
    def recipes(self) -> DataFrame:
        return dedup.recipes(self.fingerprints, self.firsts)

    def featured(self, chunks: DataFrame) -> DataFrame:
        prepare(chunks.sparkSession)
        f = chunks.select("chunk_id", gear_features(F.col("content"), self.config.sample_bits).alias("features"))
        return written(f.select("chunk_id", "features", super_features(F.col("features")).alias("sf"), hierarchy(F.col("features")).alias("hsf")), "features")

    @cached_property
    def features(self) -> DataFrame:
        return self.featured(self.unique)

    @cached_property
    def all_features(self) -> DataFrame:
        return self.featured(self.all)


@dataclass
class Grouped:
    """Groups (grp, chunk_id, members) over ``chunks``; ``stages``: groups after each stage, for histograms;
    ``recipes``: files as lists of these chunks."""

    groups: DataFrame
    chunks: DataFrame
    recipes: DataFrame
    stages: dict[str, DataFrame]


def _done(c: Corpus, groups: DataFrame, chunks: DataFrame, recipes: DataFrame, **stages: DataFrame) -> Grouped:
    groups = written(groups, "groups")
    return Grouped(groups, chunks, recipes, stages | {"final": groups})


def _plus_singles(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    return groups.unionByName(singles(chunks, groups))


def _with_packed_singles(c: Corpus, chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of more than one; all other chunks are packed in the order of their ids."""
    kept = real(groups)
    left = chunks.select("chunk_id").join(kept.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(in_order(left, c.config.cap))


def lz4(c: Corpus) -> Grouped:
    chunks = c.all
    each = c.all_fingerprints.select(F.col("chunk_id").alias("grp"), "chunk_id", F.lit(1).cast("long").alias("members"))
    return _done(c, each, chunks, c.all_fingerprints.select("file_id", "seq", "chunk_id"))


def sf(c: Corpus) -> Grouped:
    packs = written(real(by_first_key(c.features, c.config.cap)), "packs")
    return _done(c, _plus_singles(c.unique, packs), c.unique, c.recipes)


def hsf(c: Corpus) -> Grouped:
    packs = written(real(by_hierarchy(c.features, c.config.cap)), "packs")
    return _done(c, _plus_singles(c.unique, packs), c.unique, c.recipes)


def hsf_rank(c: Corpus) -> Grouped:
    packs = written(real(by_hierarchy(c.features, c.config.cap, descending=True)), "packs")
    return _done(c, _plus_singles(c.unique, packs), c.unique, c.recipes)


def leftovers(c: Corpus, groups: DataFrame, choice: str = "min_hash") -> DataFrame:
    """Items for bins: every group below the cap, singles first, keyed by its smallest chunk's
    representative (the first super-feature of that sub-chunk, from features in their own order)."""
    items = groups.where(F.col("members") < c.config.cap).groupBy("grp").agg(F.count(F.lit(1)).cast("int").alias("size"))
    heads = c.unique.select("chunk_id", "content").join(items.select(F.col("grp").alias("chunk_id")), "chunk_id", "left_semi")
    reps = represent.representatives(heads, c.config.sub_avg, choice)
    reps = reps.select("chunk_id", gear_features(F.col("sub"), c.config.sample_bits).alias("features"))
    keyed = reps.select(F.col("chunk_id").alias("grp"), F.get(super_features(F.col("features")), 0).alias("key"))
    return written(items.join(keyed, "grp").select("key", (F.col("size") > 1).cast("int").alias("rank"), F.col("grp").alias("item"), "size"), "items")


def _rebinned(c: Corpus, groups: DataFrame, fit: str) -> DataFrame:
    """All groups, those below the cap put together by their representatives."""
    bins = fit_bins(leftovers(c, groups), c.config.cap, fit, c.config.merge_limit)
    full = groups.where(F.col("members") >= c.config.cap)
    return full.unionByName(regroup(groups, written(bins, "bins")))


def hsf_rank_bib(c: Corpus) -> Grouped:
    first = written(_plus_singles(c.unique, real(by_hierarchy(c.features, c.config.cap, descending=True))), "first")
    return _done(c, _rebinned(c, first, "next"), c.unique, c.recipes, first=first)


def sf_bib(c: Corpus) -> Grouped:
    first = written(_plus_singles(c.unique, real(by_first_key(c.features, c.config.cap))), "first")
    third = written(_rebinned(c, first, "best"), "third")
    return _done(c, _with_packed_singles(c, c.unique, third), c.unique, c.recipes, first=first, third=third)


def hsf_bib(c: Corpus) -> Grouped:
    first = written(_plus_singles(c.unique, real(by_hierarchy(c.features, c.config.cap, descending=True))), "first")
    third = written(_rebinned(c, first, "next"), "third")
    return _done(c, _with_packed_singles(c, c.unique, third), c.unique, c.recipes, first=first, third=third)


def fp_only(c: Corpus) -> Grouped:
    return _done(c, in_order(c.unique.select("chunk_id"), c.config.cap, dense=True), c.unique, c.recipes)


def sf_nodedup(c: Corpus) -> Grouped:
    chunks = c.all
    packs = written(real(by_first_key(c.all_features, c.config.cap)), "packs")
    return _done(c, _with_packed_singles(c, c.all_fingerprints, packs), chunks, c.all_fingerprints.select("file_id", "seq", "chunk_id"), first=packs)


def fp_sf(c: Corpus) -> Grouped:
    """Fingerprints first: ids count all chunks, the smallest of each fingerprint survives, then as in ``sf``."""
    keep = written(dedup.survivors(c.all_fingerprints), "survivors")
    chunks = c.all.join(keep.select("chunk_id"), "chunk_id", "left_semi")
    features = c.all_features.join(keep.select("chunk_id"), "chunk_id", "left_semi")
    packs = written(real(by_first_key(features, c.config.cap)), "packs")
    recipes = c.all_fingerprints.select("file_id", "seq", "fp").join(keep, "fp").select("file_id", "seq", "chunk_id")
    return _done(c, _with_packed_singles(c, chunks, packs), chunks, recipes, first=packs)


def fp_affinity(c: Corpus) -> Grouped:
    """Equal chunks stay together: sets of one fingerprint in packs of 16, their rests combined within
    buckets of the largest feature (first fit), then single chunks by the largest feature of their largest
    sub-chunk, then by id.  Nothing is removed."""
    cap, chunks = 2 * c.config.cap, c.all
    packs = written(grouping.pack(c.all_fingerprints.select("chunk_id", "fp"), ["fp"], ["chunk_id"], cap), "fp_packs")
    full = packs.where(F.col("members") >= cap)
    rest = packs.where(F.col("members") < cap)
    a = c.all_features.select(F.col("chunk_id").alias("grp"), F.col("hsf.a").alias("key"))
    items = rest.groupBy("grp").agg(F.count(F.lit(1)).cast("int").alias("size")).join(a, "grp").select("key", F.lit(0).alias("rank"), F.col("grp").alias("item"), "size")
    zero = F.lit("0" * 20)
    items = written(items, "items")
    bins = fit_bins(items.where(F.col("key") != zero), cap, "first").unionByName(fit_bins(items.where(F.col("key") == zero), cap, "next"))
    second = written(full.unionByName(regroup(rest, written(bins, "bins"))), "second")
    left = second.where("members = 1").select("chunk_id")
    heads = chunks.select("chunk_id", "content").join(left, "chunk_id", "left_semi")
    reps = represent.representatives(heads, c.config.sub_avg, "largest")
    reps = reps.select("chunk_id", gear_features(F.col("sub"), c.config.sample_bits).alias("features"))
    keyed = written(reps.select("chunk_id", hierarchy(F.col("features"))["a"].alias("key")), "keyed")
    third = real(second).unionByName(real(grouping.pack(keyed, ["key"], ["chunk_id"], cap)))
    third = written(third, "third")
    rest = c.all_fingerprints.select("chunk_id").join(third.select("chunk_id"), "chunk_id", "left_anti")
    return _done(c, third.unionByName(in_order(rest, cap)), chunks, c.all_fingerprints.select("file_id", "seq", "chunk_id"), first=packs, second=second, third=third)


def greedy_merge(contents: list[bytes], cap: int) -> list[list[int]]:
    """Merges the pair of groups that saves the most bytes when compressed together, the first pair on
    ties, until no pair that fits saves any."""
    import pyarrow as pa

    codec = pa.Codec("lz4_raw")

    def packed(data: bytes) -> int:
        return min(len(data), codec.compress(data).size) if data else 0

    groups: dict[int, list[int]] = {i: [i] for i in range(len(contents))}
    joined = dict(enumerate(contents))
    cost = {i: packed(d) for i, d in joined.items()}
    version = dict.fromkeys(groups, 0)
    heap: list[tuple[int, int, int, int, int]] = []

    def pair(a: int, b: int) -> Iterator[tuple[int, int, int, int, int]]:
        """The saving of two groups as they are now, if they fit and save any."""
        if len(groups[a]) + len(groups[b]) <= cap and (s := cost[a] + cost[b] - packed(joined[a] + joined[b])) > 0:
            yield -s, a, b, version[a], version[b]

    for a, b in combinations(groups, 2):
        heap.extend(pair(a, b))
    heapify(heap)
    while heap:
        _, i, j, vi, vj = heappop(heap)
        if version.get(i) != vi or version.get(j) != vj:
            continue  # one of them has changed since
        groups[i] = sorted(groups[i] + groups.pop(j))
        joined[i] = b"".join(contents[k] for k in groups[i])
        del joined[j], version[j]
        cost[i] = packed(joined[i])
        version[i] += 1
        for k in groups:
            if k != i:
                for entry in pair(min(i, k), max(i, k)):
                    heappush(heap, entry)
    return list(groups.values())


def greedy(c: Corpus) -> Grouped:
    """The first ``greedy_limit`` chunks, grouped by pairwise savings: a yardstick on a bounded number of
    chunks (the limit is part of the method), hence one task."""
    cap, limit = c.config.cap, c.config.greedy_limit
    chunks = c.unique.where(F.col("chunk_id") < limit)

    def run(table):
        import pyarrow as pa

        table = table.sort_by("chunk_id")
        ids = table.column("chunk_id").to_pylist()
        rows = [(ids[g[0]], ids[k], len(g)) for g in greedy_merge(table.column("content").to_pylist(), cap) for k in g]
        return pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("grp", "chunk_id", "members"))})

    prepare(chunks.sparkSession)
    groups = chunks.select("chunk_id", "content", F.lit(0).alias("one")).groupBy("one").applyInArrow(run, "grp long, chunk_id long, members long")
    return _done(c, groups, chunks, c.recipes.join(chunks.select("chunk_id"), "chunk_id", "left_semi"))


METHODS: dict[str, Callable[[Corpus], Grouped]] = {
    "lz4": lz4,
    "sf": sf,
    "hsf": hsf,
    "hsf_rank": hsf_rank,
    "hsf_rank_bib": hsf_rank_bib,
    "sf_bib": sf_bib,
    "hsf_bib": hsf_bib,
    "greedy": greedy,
    "sf_nodedup": sf_nodedup,
    "fp_sf": fp_sf,
    "fp_affinity": fp_affinity,
    "fp_only": fp_only,
}


@dataclass
class Run:
    """The results of a method: compressed groups, and reports over them."""

    corpus: Corpus
    grouped: Grouped
    compressed: DataFrame
    seconds: float

    def histogram(self) -> DataFrame:
        parts = [metrics.size_histogram(g, stage) for stage, g in self.grouped.stages.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def report(self) -> DataFrame:
        return metrics.size_report(self.compressed)

    def summary(self) -> DataFrame:
        return metrics.run_summary(self.compressed, metrics.dedup_summary(self.corpus.fingerprints), self.seconds)

    def quality(self) -> DataFrame:
        """One row: groups, the share of chunks that are alone, and the mean number of chunks of a group."""
        return metrics.grouping_quality(self.grouped.groups)

    def restored(self) -> DataFrame:
        chunks = restore.decompressed(self.compressed, self.grouped.chunks)
        return restore.restored(self.grouped.recipes, chunks, self.corpus.files)

    def restored_parts(self) -> DataFrame:
        """The files as (file_id, seq, content), for files of any size."""
        return restore.restored_parts(self.grouped.recipes, restore.decompressed(self.compressed, self.grouped.chunks))


def run(files: DataFrame, method: str, config: Config = Config(), parts: DataFrame | None = None) -> Run:
    """Chunks, groups and compresses files by a method of ``METHODS``."""
    began = time.monotonic()
    corpus = Corpus(files, config, parts)
    grouped = METHODS[method](corpus)
    compressed = compress.laid_out(compress.compress_groups(grouped.groups, grouped.chunks))
    return Run(corpus, grouped, compressed, time.monotonic() - began)
