"""The registered queries: each applies one operator to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions.arrow import cut_ends, finesse_features, ntransform_features
from siltstone.functions.keys import strided_super_features, super_features, unsigned, xxh64
from siltstone.operators import chunking, compress, dedup, grouping, metrics, represent, similar
from siltstone.operators.ids import dense_id, places
from siltstone.plans.methods import METHODS, Corpus, run
from siltstone.session import prepare, shared_dir, written
from siltstone.sources.files import files_from_table, first_files, natural_key
from siltstone.streaming.ingest import Index, distinct_fingerprints, ingest

Query = Callable[[SparkSession, str], DataFrame]

#: Documents are short, hence smaller chunks, sub-chunks and a denser sampling than for files.
CONFIG = Config(chunk_size=1024, sub_avg=256, sample_bits=2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_from_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(files(spark, sf_dir), CONFIG)


QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def on_corpus(name: str):
    """A query that needs nothing but the corpus of documents."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(corpus(spark, sf_dir))
        return f

    return add


# Sources


@query("S1_directory_scan")
def _(spark, sf_dir):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(sf_dir)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("S2_natural_order")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", natural_key(F.col("url")).alias("k"))
    return dense_id(pages, ["k", "url", "page_id"], "place").select("page_id", "place")


@query("S3_first_files")
def _(spark, sf_dir):
    return first_files(table(spark, sf_dir, "pages").select("url"), 20, "url")


@query("S4_files_from_table")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", "length", F.sha2("content", 256).alias("sha256"))


# Chunks and deduplication


@query("C1_fixed_chunks")
def _(spark, sf_dir):
    return dedup.with_fingerprint(chunking.fixed_chunks(files(spark, sf_dir), CONFIG.chunk_size)).select("file_id", "seq", "size", "fp")


@query("C5_cdc_chunks")
def _(spark, sf_dir):
    return dedup.with_fingerprint(chunking.cdc_chunks(files(spark, sf_dir), CONFIG.chunk_size)).select("file_id", "seq", "size", "fp")


for _choice in represent.CHOICES:

    @on_corpus(f"C6_C9_representative_{_choice}")
    def _(c, choice=_choice):
        return represent.representatives(c.unique, CONFIG.sub_avg, choice).select("chunk_id", "sub_start", "sub_end", F.sha2("sub", 256).alias("fp"))


@query("D1_unique_chunks")
def _(spark, sf_dir):
    return corpus(spark, sf_dir).unique.select("chunk_id", "fp", "file_id", "seq", "size")


@on_corpus("D1_recipes")
def _(c):
    return c.recipes


@on_corpus("D2_duplicates")
def _(c):
    return dedup.duplicates(c.all_fingerprints)


@on_corpus("D3_occurrence_histogram")
def _(c):
    return dedup.occurrence_histogram(c.fingerprints)


@on_corpus("D4_dense_ids")
def _(c):
    return dense_id(c.fingerprints, ["file_id", "seq"], "chunk_id").select("file_id", "seq", "chunk_id")


@on_corpus("I1_fp_index")
def _(c):
    return dedup.fp_index(c.all_fingerprints).select("fp", "place", "chunk_id")


# Features and indexes


@on_corpus("F4_features")
def _(c):
    strip = lambda j: F.conv(F.hex(F.get("features", j)), 16, 10).alias(f"f{j}")
    return c.features.select("chunk_id", *(strip(j) for j in range(12)))


@on_corpus("F7_F8_keys")
def _(c):
    return c.features.select("chunk_id", *(F.get("sf", i).alias(f"sf{i}") for i in range(3)), "hsf.*")


@on_corpus("F9_ntransform")
def _(c):
    prepare(c.unique.sparkSession)
    f = c.unique.select("chunk_id", ntransform_features(F.col("content")).alias("f"))
    return f.select("chunk_id", F.array_join(strided_super_features(F.transform("f", lambda x: x.bitwiseAND(0xFFFFFFFF))), ",").alias("keys"))


@on_corpus("F10_finesse")
def _(c):
    prepare(c.unique.sparkSession)
    f = c.unique.select("chunk_id", finesse_features(F.col("content")).alias("f"))
    return f.select("chunk_id", F.array_join(strided_super_features(F.col("f"), sort=True), ",").alias("keys"))


@on_corpus("I2_first_key_index")
def _(c):
    return similar.first_key_index(c.features)


@on_corpus("I3_max_feature_index")
def _(c):
    return similar.max_feature_index(c.features)


@on_corpus("I4_hierarchy_sets")
def _(c):
    """The finer keys below each largest feature."""
    below = c.features.select("hsf.a", F.concat_ws(".", "hsf.b", "hsf.c").alias("bc")).distinct()
    return below.groupBy("a").agg(F.array_join(F.array_sort(F.collect_list("bc")), ",").alias("keys"))


@on_corpus("I5_index_after_delete")
def _(c):
    """The first-key index after the chunks of even number are deleted."""
    return similar.first_key_index(similar.without(c.features, c.features.select("chunk_id").where("chunk_id % 2 = 0")))


@on_corpus("I6_similar_count")
def _(c):
    return similar.similar_count(c.features)


@on_corpus("I7_similar_record")
def _(c):
    return similar.similar_record(c.features)


@on_corpus("I8_probe")
def _(c):
    """Documents that share chunks ask for similar ones: every chunk probes with its own keys."""
    return similar.probe(c.features, c.features.select(F.col("chunk_id").alias("probe_id"), "sf"))


@on_corpus("I11_I12_last_similar_record")
def _(c):
    return similar.similar_record(c.features, last=True)


@on_corpus("I9_features_by_bucket_size")
def _(c):
    return similar.features_by_bucket_size(c.features).select(unsigned(F.col("feature")).cast("decimal(20,0)").cast("string").alias("feature"), "members")


@on_corpus("I10_cooccurrence")
def _(c):
    return similar.cooccurrence(c.features)


@on_corpus("F7_sorted_super_features")
def _(c):
    keys = super_features(F.col("features"), sort=True)
    return c.features.select("chunk_id", F.array_join(keys, ",").alias("keys"))


@on_corpus("F2_xxh64_keys")
def _(c):
    keys = super_features(F.col("features"), key=xxh64)
    return c.features.select("chunk_id", *(F.get(keys, k).alias(f"key{k}") for k in range(3)))


def _last_similar(c: Corpus, features: Column, keys: Callable[[Column], Column]) -> DataFrame:
    prepare(c.unique.sparkSession)
    f = c.unique.select("chunk_id", features.alias("f"))
    return similar.similar_record(written(f.select("chunk_id", keys(F.col("f")).alias("sf")), "keys"), last=True)


@on_corpus("I11_last_similar_by_ntransform")
def _(c):
    return _last_similar(c, ntransform_features(F.col("content")), lambda f: strided_super_features(F.transform(f, lambda x: x.bitwiseAND(0xFFFFFFFF))))


@on_corpus("I12_last_similar_by_finesse")
def _(c):
    return _last_similar(c, finesse_features(F.col("content")), lambda f: strided_super_features(f, sort=True))


@on_corpus("A7_feature_counts")
def _(c):
    return metrics.feature_counts(c.features)


# Groups


@on_corpus("G1_by_first_key")
def _(c):
    return grouping.real(grouping.by_first_key(c.features, CONFIG.cap))


@on_corpus("G2_by_hierarchy")
def _(c):
    return grouping.real(grouping.by_hierarchy(c.features, CONFIG.cap))


@on_corpus("G3_by_rank")
def _(c):
    return grouping.real(grouping.by_hierarchy(c.features, CONFIG.cap, descending=True))


def _groups(method: str) -> Query:
    return lambda spark, sf_dir: METHODS[method](corpus(spark, sf_dir)).groups


QUERIES |= {
    "G4_hsf_rank_bib": _groups("hsf_rank_bib"),
    "G7_sf_bib": _groups("sf_bib"),
    "G8_hsf_bib": _groups("hsf_bib"),
    "G9_fp_only": _groups("fp_only"),
    "G10_final_merge": _groups("sf"),
    "G11_fp_affinity": _groups("fp_affinity"),
    "G12_greedy": _groups("greedy"),
}


@query("A5_grouping_quality")
def _(spark, sf_dir):
    """Groups, lonely chunks and mean sizes of the four grouping methods."""
    c = corpus(spark, sf_dir)
    return reduce(DataFrame.unionAll, (metrics.grouping_quality(METHODS[m](c).groups).select(F.lit(m).alias("method"), "*") for m in ("sf", "hsf", "hsf_rank", "hsf_rank_bib")))


@query("G4_default_parameters")
def _(spark, sf_dir):
    """The flagship's groups with the parameters for large files: chunks of 8 KiB, a 32nd of the hashes."""
    return METHODS["hsf_rank_bib"](Corpus(files(spark, sf_dir), Config())).groups


@query("G6_next_fit")
def _(spark, sf_dir):
    """Line items as items of 1 to 7, in bins of 8 for each supplier."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.lit(0).alias("rank"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 7).alias("item"), (F.col("l_quantity").cast("int") % 7 + 1).alias("size")
    )
    return grouping.fit_bins(items, 8)


@query("G5_best_fit")
def _(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit(0).alias("rank"), F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("size"))
    return grouping.fit_bins(items, 8, "best")


@on_corpus("G13_most_correlated")
def _(c):
    return similar.most_correlated(c.features)


@on_corpus("A5_size_histogram")
def _(c):
    return metrics.size_histogram(grouping.by_first_key(c.features, CONFIG.cap), "first")


# Compression, layout, restore


@on_corpus("P1_chunk_sizes")
def _(c):
    return compress.compress_chunks(c.unique)


def _run(method: str) -> Callable:
    return lambda spark, sf_dir: run(files(spark, sf_dir), method, CONFIG)


@query("P2_compressed_groups")
def _(spark, sf_dir):
    got = _run("hsf_rank")(spark, sf_dir).compressed
    return got.select("group_id", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"), "orig_size", "comp_size", "comp_offset", "codec")


@query("P2_group_recipes")
def _(spark, sf_dir):
    """The groups as they are compressed: their chunks in order, their bytes before."""
    got = _run("hsf_rank")(spark, sf_dir).compressed
    return got.select("group_id", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"), "orig_size")


@query("A6_size_report")
def _(spark, sf_dir):
    return _run("hsf_rank")(spark, sf_dir).report()


@query("A9_run_summary")
def _(spark, sf_dir):
    return _run("hsf_rank_bib")(spark, sf_dir).summary().drop("seconds", "throughput_mib_s")


@on_corpus("P5_containers")
def _(c):
    return compress.containers(c.unique, 65536)


@on_corpus("P6_chunk_offsets")
def _(c):
    return compress.chunk_offsets(METHODS["fp_only"](c).groups, c.unique).select("grp", "chunk_id", "size", "re_offset")


@on_corpus("P7_group_offsets")
def _(c):
    sizes = METHODS["fp_only"](c).groups.join(c.unique.select("chunk_id", "size"), "chunk_id").groupBy("grp").agg(F.sum("size").alias("orig_size"))
    slim = dense_id(sizes, ["grp"], "group_id")
    return compress.running_sum(slim, ["group_id"], "orig_size", "comp_offset").select("group_id", "orig_size", "comp_offset")


def _restore(method: str) -> Query:
    return lambda spark, sf_dir: _run(method)(spark, sf_dir).restored().select("file_id", "length", "sha256")


QUERIES |= {f"T4_restore_{m}": _restore(m) for m in METHODS if m != "greedy"}


# Relational pieces


@on_corpus("A1_A4_dedup_summary")
def _(c):
    return metrics.dedup_summary(c.fingerprints)


@on_corpus("J3_recipe_sizes")
def _(c):
    sizes = c.recipes.join(c.unique.select("chunk_id", "size"), "chunk_id")
    return sizes.groupBy("file_id").agg(F.sum("size").alias("length"), F.count(F.lit(1)).alias("chunks"))


def _repeated(c: Corpus) -> DataFrame:
    return c.fingerprints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@on_corpus("J4_never_repeated")
def _(c):
    return c.fingerprints.join(_repeated(c), "fp", "left_anti").select("file_id", "seq")


@on_corpus("J5_repeated")
def _(c):
    return c.fingerprints.join(_repeated(c), "fp", "left_semi").select("file_id", "seq")


@on_corpus("J8_theta_pairs")
def _(c):
    """The pairs i < j of the chunks that the greedy method looks at (their number is its limit), i being the smaller one:
    for each i, how many there are and the bytes of the largest j."""
    limit = Config().greedy_limit
    few = F.broadcast(c.unique.where(F.col("chunk_id") < limit).select("chunk_id", "size"))
    i, j = few.select(F.col("chunk_id").alias("i"), F.col("size").alias("a")), few.select(F.col("chunk_id").alias("j"), F.col("size").alias("b"))
    return i.join(j, (F.col("i") < F.col("j")) & (F.col("a") < F.col("b"))).groupBy("i").agg(F.count(F.lit(1)).alias("pairs"), F.max("b").alias("largest"))


@query("A8_collected_sets")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    return rows.agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count(F.lit(1)).alias("n"))


@on_corpus("A10_extremes")
def _(c):
    return c.fingerprints.groupBy("file_id").agg(F.min_by("seq", "fp").alias("min_hash_seq"), F.min("fp").alias("min_hash"), F.max_by("seq", F.struct("size", -F.col("seq"))).alias("largest_seq"))


@query("U1_U4_sets")
def _(spark, sf_dir):
    c = corpus(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "source")
    # two halves of the sources, by a hash
    half = F.when(F.md5(F.coalesce("source", F.lit("")).cast("binary")) < "8", 0).otherwise(1)
    s = written(c.fingerprints.join(sources, "file_id").select(half.alias("half"), "fp").distinct(), "sets")
    a, b = (s.where(F.col("half") == x).select("fp") for x in (0, 1))
    ops = {"union": a.union(b).distinct(), "append": a.union(b), "difference": a.subtract(b), "intersection": a.intersect(b)}
    return reduce(DataFrame.unionAll, (rows.select(F.lit(name).alias("op"), "fp") for name, rows in ops.items()))


@query("E_functions")
def _(spark, sf_dir):
    p, url = F.col("page_id"), F.encode("url", "UTF-8")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.element_at(F.split("url", "/"), -1).alias("basename"),
        F.substring(F.lower(F.hex(url)), 1, 16).alias("head"),
        F.ceil(F.octet_length("html") / 1000).alias("blocks"),
        F.least(F.greatest(p, F.lit(10)), F.lit(100)).alias("clamped"),
        F.round(F.log2(p + 1)).cast("int").alias("bits"),
        F.shiftleft(p, 3).bitwiseAND(255).alias("masked"),
    )


@on_corpus("O8_top_pairs")
def _(c):
    """The 20 pairs of chunks with the most features in common."""
    return similar.top_pairs(c.features)


@on_corpus("W_places")
def _(c):
    """Place of every chunk among the chunks of its size."""
    return places(c.fingerprints, ["size"], ["file_id", "seq"]).select("file_id", "seq", "place")


# Streaming


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents")
    # the stream source wants a folder; a file name works as a pattern of one
    read = spark.readStream.schema(source.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    stream = read.parquet(f"{sf_dir}/documents.parque[t]")
    return files_from_table(stream.select("doc_id", "text"), "doc_id", "text")


@query("L3_stream_recipes")
def _(spark, sf_dir):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    ingest(_stream(spark, sf_dir), f"{base}/index", f"{base}/checkpoint", CONFIG).awaitTermination()
    return Index(spark, f"{base}/index").numbered()[1]


@query("L3_stream_fingerprints")
def _(spark, sf_dir):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = distinct_fingerprints(_stream(spark, sf_dir), CONFIG).writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    out.start(f"{base}/out", format="parquet").awaitTermination()
    return spark.read.schema("fp string, size int").parquet(f"{base}/out")


def cut_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut points of each document, as text."""
    prepare(spark)
    ends = files(spark, sf_dir).select("file_id", cut_ends(F.col("content"), CONFIG.chunk_size).alias("e"))
    return ends.select("file_id", F.array_join(F.transform("e", lambda x: x.cast("string")), ",").alias("ends"))


QUERIES["C3_cut_points"] = cut_positions


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes of the ranked hierarchy with representatives, before and after regrouping."""
    return run(files(spark, sf_dir), "hsf_rank_bib", CONFIG).histogram().orderBy("stage", "group_size")


QUERIES["flagship"] = flagship
