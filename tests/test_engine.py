import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siltstone import cli
from siltstone.config import Config
from siltstone.functions.keys import random_id, super_features, xxh64
from siltstone.operators import chunking, compress, dedup, grouping, metrics, represent, restore, similar
from siltstone.operators.ids import dense_id, places
from siltstone.plans.methods import METHODS, Corpus, run
from siltstone.plans.oracle import SQL
from siltstone.plans.queries import QUERIES
from siltstone.sources import sinks
from siltstone.sources.files import byte_ranges, files_from_dir, files_from_table, files_in_ranges, first_files, natural_key
from siltstone.streaming.ingest import Index, ingest

SMALL = Config(chunk_size=64, sub_avg=16, sample_bits=0, greedy_limit=40)


def content(seed, n):
    import random

    rng = random.Random(seed)
    return bytes(rng.choice(b"abcdefgh \n\0") for _ in range(n))


@pytest.fixture(scope="module")
def files(spark):
    base = content(0, 640)
    rows = [(1, base), (2, b""), (3, base[:64] * 3), (4, content(1, 129)), (5, content(2, 128)), (6, bytes(base[:300]) + content(3, 100)), (7, None), (8, bytes(os.urandom(200))), (9, base[:640])]
    rows += [(20 + k, base[:200] + bytes([65 + k]) * 3 + base[203:500]) for k in range(12)]
    return files_from_table(spark.createDataFrame(rows, "id long, data binary"), "id", "data")


def test_fixed_chunks(files):
    got = {}
    for r in chunking.fixed_chunks(files, 64).collect():
        got.setdefault(r.file_id, []).append((r.seq, r.size, r.content))
    want = {r.file_id: bytes(r.content) for r in files.collect()}
    assert set(got) == {k for k, v in want.items() if v}
    for k, rows in got.items():
        rows.sort()
        assert b"".join(bytes(c) for _, _, c in rows) == want[k]
        assert [s for s, _, _ in rows] == list(range(len(rows)))
        assert all(n == 64 for _, n, _ in rows[:-1]) and 0 < rows[-1][1] <= 64
    assert [len(got[k]) for k in (4, 5)] == [3, 2]


def test_cdc_chunks_cover_files(files):
    got = {}
    for r in chunking.cdc_chunks(files, 64).collect():
        got.setdefault(r.file_id, []).append((r.seq, bytes(r.content)))
    for r in files.collect():
        assert b"".join(c for _, c in sorted(got.get(r.file_id, []))) == bytes(r.content)
        assert all(32 <= len(c) <= 128 for _, c in sorted(got.get(r.file_id, []))[:-1])
    with pytest.raises(ValueError):
        chunking.chunks(files, Config(chunking="none"))


def test_ids_are_dense_and_do_not_depend_on_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 37 % 1000).alias("x"), (F.col("id") % 3 == 0).alias("hot"))
    for n in (1, 7):
        got = {r.x: r.i for r in dense_id(df.repartition(n), ["x"], "i").collect()}
        assert got == {x: x for x in range(1000)}
    at = {r.x: r.place for r in places(df, ["hot"], ["x"]).collect()}
    hot = {r.x: r.hot for r in df.collect()}
    for flag in (True, False):
        assert [at[x] for x in sorted(x for x in hot if hot[x] == flag)] == list(range(sum(h == flag for h in hot.values())))


@pytest.mark.parametrize("method", [m for m in METHODS])
def test_methods_restore_and_keep_invariants(files, method):
    got = run(files, method, SMALL)
    groups = got.grouped.groups.collect()
    chunks = {r.chunk_id: r.size for r in got.grouped.chunks.select("chunk_id", "size").collect()}
    cap = 16 if method == "fp_affinity" else 8
    assert sorted(g.chunk_id for g in groups) == sorted(chunks)  # every chunk in exactly one group
    by = {}
    for g in groups:
        by.setdefault(g.grp, []).append(g)
    for k, rows in by.items():
        assert len(rows) == rows[0].members <= cap and k == min(r.chunk_id for r in rows)
    packed = got.compressed.collect()
    assert sorted(r.group_id for r in packed) == list(range(len(by)))
    at = 0
    for r in sorted(packed, key=lambda r: r.group_id):
        assert r.comp_offset == at and r.comp_size <= r.orig_size == sum(chunks[c] for c in r.chunk_ids)
        assert (r.codec == "raw") == (r.comp_size == r.orig_size) and list(r.chunk_ids) == sorted(r.chunk_ids)
        at += r.comp_size
    if method != "greedy":
        want = {r.file_id: bytes(r.content) for r in files.collect()}
        assert {r.file_id: bytes(r.content) for r in got.restored().collect()} == want
    summary = got.summary().first()
    assert summary.groups == len(by) and summary.compressed_size == at
    assert summary.logical_size >= summary.unique_size
    sizes = {r.group_size: r.frequency for r in got.histogram().where("stage = 'final'").collect()}
    assert sum(k * v for k, v in sizes.items()) == len(chunks)
    assert sum(r.logical_size for r in got.report().collect()) == sum(chunks.values())


def test_designs_compare(files):
    c = Corpus(files, SMALL)
    sizes = {m: sorted(r.group_size for r in metrics.size_histogram(METHODS[m](c).groups, m).selectExpr("explode(array_repeat(group_size, int(frequency))) as group_size").collect()) for m in ("hsf", "hsf_rank", "hsf_rank_bib")}
    assert sizes["hsf"] == sizes["hsf_rank"]
    assert len(sizes["hsf_rank_bib"]) <= len(sizes["hsf_rank"])


def test_shuffled_input_gives_the_same(spark, files):
    a = METHODS["sf_bib"](Corpus(files, SMALL)).groups.collect()
    b = METHODS["sf_bib"](Corpus(files.repartition(7, F.rand(3)), SMALL)).groups.collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("n,want", [(1, []), (2, [2]), (7, [7]), (8, [8]), (9, [8]), (16, [8, 8]), (17, [8, 8])])
def test_pack_sizes(spark, n, want):
    rows = spark.range(n).select(F.col("id").alias("chunk_id"), F.lit("k").alias("key"))
    got = grouping.real(grouping.pack(rows, ["key"], ["chunk_id"], 8)).select("grp", "members").distinct().collect()
    assert sorted(r.members for r in got) == sorted(want)


def test_dedup_ids(spark):
    files = files_from_table(spark.createDataFrame([(1, "aa" * 32 + "aa" * 32 + "b"), (2, "aa" * 32)], "i long, t string"), "i", "t")
    c = Corpus(files, SMALL)
    assert sorted(tuple(r) for r in c.recipes.collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, 0)]
    assert sorted((r.chunk_id, r.size) for r in c.unique.collect()) == [(0, 64), (1, 1)]
    assert sorted(tuple(r) for r in dedup.duplicates(c.all).collect()) == [(1, 0), (3, 0)]
    index = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, o long")
    assert sorted(tuple(r) for r in dedup.latest(index, "k", "o").collect()) == [("a", 3), ("b", 2)]


def test_containers_carry_over_ranges(spark):
    import random

    rng = random.Random(4)
    sizes = [rng.randrange(1, 60) for _ in range(700)]
    chunks = spark.createDataFrame(list(enumerate(sizes)), "chunk_id long, size int").repartition(5)
    for limit in (60, 200, 100000):
        want, c, fill = [], 0, 0
        for k, n in enumerate(sizes):
            if fill + n > limit:
                c, fill = c + 1, 0
            want.append((k, n, c, fill))
            fill += n
        assert sorted(tuple(r) for r in compress.containers(chunks, limit).collect()) == want


def test_similar_records(spark):
    rows = [(1, ["a", "x", "p"]), (2, ["a", "y", "q"]), (3, ["b", "y", "r"]), (4, ["c", "z", "s"])]
    f = spark.createDataFrame(rows, "chunk_id long, sf array<string>")
    assert {r.chunk_id: r.similar_id for r in similar.similar_record(f).collect()} == {1: 2, 2: 1, 3: 2, 4: None}
    asked = spark.createDataFrame([(9, ["n", "y", "s"])], "probe_id long, sf array<string>")
    assert similar.probe(f, asked).first().similar_id == 2
    assert similar.without(f, spark.createDataFrame([(1,)], "chunk_id long")).count() == 3


def test_representatives(spark):
    data = content(9, 400)
    c = spark.createDataFrame([(0, data), (1, b"xy")], "chunk_id long, content binary")
    for choice in represent.CHOICES:
        got = {r.chunk_id: r for r in represent.representatives(c, 32, choice).collect()}
        assert (got[1].sub_start, got[1].sub_end) == (0, 2)
        r = got[0]
        assert bytes(r["sub"]) == data[r.sub_start : r.sub_end]
        if choice.endswith("inner"):
            assert r.sub_start > 0 and r.sub_end < 400


def test_natural_order(spark):
    names = ["a2", "a10", "A1", "1b", "b", "a02", ""]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n").collect()]
    assert got == ["", "1b", "A1", "a02", "a2", "a10", "b"]


def test_directories_ranges_and_sinks(spark, tmp_path):
    for k, name in enumerate(["f10.bin", "f2.bin", "sub/f1.bin"]):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content(k, 100 * k + 10))
    got = files_from_dir(spark, str(tmp_path / "in"), "*.bin").orderBy("file_id").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["f2.bin", "f10.bin", "f1.bin"]
    assert [r.length for r in got] == [110, 10, 210]
    assert first_files(spark.createDataFrame([("b",), ("a",)], "path string"), 5).count() == 2
    whole = {}
    for r in byte_ranges(spark, str(tmp_path / "in"), 64).collect():
        whole.setdefault(r.path.rsplit("/", 1)[1], []).append((r.start, bytes(r.content)))
    assert {n: b"".join(c for _, c in sorted(v)) for n, v in whole.items()} == {"f10.bin": content(0, 10), "f2.bin": content(1, 110), "f1.bin": content(2, 210)}
    out = run(files_from_dir(spark, str(tmp_path / "in")), "hsf_rank_bib", SMALL)
    placed = compress.containers(out.grouped.chunks, 256).join(out.grouped.chunks.select("chunk_id", "content"), "chunk_id")
    sinks.write_containers(placed, str(tmp_path / "containers"))
    assert sinks.read_chunk(spark, str(tmp_path / "containers"), 1).count() == 1
    sinks.write_groups(out.compressed, str(tmp_path / "groups"), "hsf_rank_bib")
    sinks.write_restored(out.restored(), str(tmp_path / "restored"))
    sinks.write_report(out.summary(), str(tmp_path / "report"))
    sinks.append_histogram(out.histogram(), str(tmp_path / "histogram"))
    sinks.append_histogram(out.histogram(), str(tmp_path / "histogram"))
    assert spark.read.option("header", True).csv(str(tmp_path / "histogram")).count() == 2 * out.histogram().count()


def test_large_files_in_ranges(spark, tmp_path):
    """A file over many ranges, through a method and back, byte for byte; by the command line, too."""
    data = {"a/big.bin": content(1, 5000) + content(1, 3000), "a/b/f10": content(2, 64 * 7), "f2": content(3, 65), "empty": b"", "one": b"x"}
    for name, raw in data.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    files, parts = files_in_ranges(spark, str(tmp_path / "in"), 64, size=300)
    assert [r.path.rsplit("/", 1)[1] for r in files.orderBy("file_id").collect()] == ["f10", "big.bin", "empty", "f2", "one"]
    assert parts.groupBy("file_id").count().agg(F.max("count")).first()[0] == 32
    got = run(files, "hsf_rank_bib", SMALL, parts)
    pieces = {}
    for r in got.restored_parts().collect():
        pieces.setdefault(r.file_id, []).append((r.seq, bytes(r.content)))
    names = {r.file_id: r.path.split("/in/")[1] for r in files.collect()}
    assert {names[k]: b"".join(c for _, c in sorted(v)) for k, v in pieces.items()} == {n: c for n, c in data.items() if c}
    whole = {names[r.file_id]: bytes(r.content) for r in got.restored().collect()}
    assert whole == data
    with pytest.raises(ValueError):
        Corpus(files, SMALL.but(chunking="cdc"), parts).chunks
    cli.execute(spark, cli.parsed(["-i", str(tmp_path / "in"), "-m", "4", "-k", "64", "-s", "16", "-d", "1", "-r", "-o", str(tmp_path / "out")]))
    back = {str(p.relative_to(tmp_path / "out/restored")).split("/in/")[1]: p.read_bytes() for p in (tmp_path / "out/restored").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert back == data
    for name in ("groups/hsf_rank_bib", "summary", "report", "histogram", "containers"):
        assert any((tmp_path / "out" / name).iterdir()), name
    kept = sinks.read_chunks(spark, str(tmp_path / "out/containers"))
    c = Corpus(files, SMALL, parts)
    assert {names[r.file_id]: bytes(r.content) for r in restore.restored(c.recipes, kept, files).collect()} == data
    assert cli.parsed(["-i", "x", "-o", "y", "-m", "fp_only", "-c", "1", "-n", "3"]).method == "fp_only"
    for wrong in (["-i", "x", "-o", "y", "-m", "99"], ["-i", "x", "-o", "y", "-c", "2"]):
        with pytest.raises(SystemExit):
            cli.parsed(wrong)


def test_next_fit_of_a_hot_key(spark):
    """One key holds nine tenths of the items, over many ranges; every bin is that of a single pass."""
    import random

    rng = random.Random(3)
    items = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(30)}", rng.randrange(2), k, rng.randrange(1, 9)) for k in range(3000)]
    df = spark.createDataFrame(items, "key string, rank int, item long, size int").repartition(3)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            for fit, limit in (("next", 1000), ("best", 100)):
                got = {r.item: r.bin for r in grouping.fit_bins(df, 8, fit, limit).collect()}
                want = {}
                for key in {i[0] for i in items}:
                    own = sorted((r, k, n) for x, r, k, n in items if x == key)
                    if fit == "best" and len(own) <= limit:
                        continue
                    for (_, k, _), b in zip(own, grouping.next_fit([n for _, _, n in own], 8)):
                        want.setdefault((key, b), []).append(k)
                for members in want.values():
                    assert {got[k] for k in members} == {members[0]}
                assert got.keys() == {k for _, _, k, _ in items}
        assert grouping.fit_bins(df.limit(0), 8).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_keys_and_ids(spark):
    import struct

    import xxhash

    rows = [([5, -1, 3, 2**62, 7, 7, -9, 0, 1, 2, 3, 4],), (list(range(12)),)]
    df = spark.createDataFrame(rows, "f array<long>")
    got = df.select("f", super_features(F.col("f"), key=xxh64).alias("x"), super_features(F.col("f"), sort=True, key=xxh64).alias("s"), super_features(F.col("f"), per=1).alias("one")).collect()
    for r in got:
        ordered = sorted(r.f, key=lambda v: v % 2**64)
        for k in range(3):
            for keys, values in ((r.x, r.f), (r.s, ordered)):
                want = xxhash.xxh64_intdigest(struct.pack("<4q", *values[4 * k : 4 * k + 4]), 42)
                assert keys[k] % 2**64 == want
        assert r.one == [f"{v % 2**64:020d}" for v in r.f]
    ids = [r[0] for r in spark.range(50).select(random_id(7)).collect()]
    assert len(set(ids)) == 50 and ids == [r[0] for r in spark.range(50).select(random_id(7)).collect()]
    assert spark.range(50).select(random_id().alias("u")).distinct().count() == 50


def test_grouping_quality(spark):
    groups = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (3, 3, 1), (4, 4, 1)], "grp long, chunk_id long, members long")
    assert tuple(metrics.grouping_quality(groups).first()) == (3, 4, 50.0, 1.33)


@pytest.mark.parametrize("limit", [0, 1 << 17])
def test_stream_in_batches_and_replay(spark, tmp_path, files, monkeypatch, limit):
    monkeypatch.setattr("siltstone.streaming.ingest.BROADCAST_CHUNKS", limit)
    rows = files.select("file_id", "content").orderBy("file_id").collect()
    index = Index(spark, str(tmp_path / "index"))
    for k in range(3):
        spark.createDataFrame(rows[k::3], "file_id long, content binary").write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("file_id long, content binary").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in" / "*"))
    ingest(stream, str(tmp_path / "index"), str(tmp_path / "checkpoint"), SMALL).awaitTermination()
    unique, recipes = index.numbered()
    want = Corpus(files, SMALL)
    assert unique.count() == want.unique.count() and recipes.count() == want.chunks.count()
    before = sorted((r.file_id, r.seq, r.fp) for r in index.recipes().collect())
    again = spark.createDataFrame(rows[:4], "file_id long, content binary")
    index.add(again, 99, SMALL)
    index.add(again, 99, SMALL)
    assert index.unique().where("batch = 99").count() == 0
    assert sorted((r.file_id, r.seq, r.fp) for r in index.recipes().where("batch <> 99").collect()) == before


def test_empty_input(spark):
    none = files_from_table(spark.createDataFrame([], "i long, t string"), "i", "t")
    for method in ("sf", "hsf_rank_bib", "fp_only"):
        got = run(none, method, SMALL)
        assert got.compressed.count() == 0 and got.restored().count() == 0
        assert got.summary().first().logical_size == 0


def test_clean(spark):
    from siltstone.session import clean, written

    kept = written(spark.range(3).toDF("x"), "gone")
    assert kept.count() == 3 and clean(spark) >= 1 and clean(spark) == 0
    with pytest.raises(Exception):
        kept.count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("seed,features,chunks", [(0, 6, 30), (1, 40, 150), (2, 400, 150), (3, 2, 200), (4, 3, 1), (5, 100000, 40)])
def test_top_pairs_of_all_chunks(spark, seed, features, chunks):
    """Chunks after the first 96, equal sets, hot features and sparse tables, against all pairs."""
    import random
    from itertools import combinations

    rng = random.Random(seed)
    pool = [rng.sample(range(features), min(4, features)) for _ in range(5)]
    sets = [rng.choice(pool) if k % 3 == 0 else [rng.randrange(features) - 1 for _ in range(4)] for k in range(chunks)]
    want = [(-n, i, j) for i, j in combinations(range(chunks), 2) if (n := len(set(sets[i]) & set(sets[j])))]
    df = spark.createDataFrame([(k, f) for k, f in enumerate(sets)], "chunk_id long, features array<long>").repartition(3)
    assert [(-r.shared, r.i, r.j) for r in similar.top_pairs(df).collect()] == sorted(want)[:20]
    assert similar.top_pairs(df.limit(0)).count() == 0


def test_top_pairs_query_sees_chunks_after_the_first_96(spark):
    from siltstone.plans.queries import corpus

    sf = "/root/testdata/sf0.001"
    sets = sorted((r.chunk_id, frozenset(r.features)) for r in corpus(spark, sf).features.select("chunk_id", "features").collect())
    want = sorted((-n, i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if (n := len(a & b)))[:20]
    assert [(-r.shared, r.i, r.j) for r in QUERIES["O8_top_pairs"](spark, sf).collect()] == want
    assert max(j for _, _, j in want) >= 96


def test_greedy_query_takes_1024_chunks(spark):
    ids = sorted(r.chunk_id for r in QUERIES["G12_greedy"](spark, "/root/testdata/sf0.01").collect())
    assert ids == list(range(1024))
