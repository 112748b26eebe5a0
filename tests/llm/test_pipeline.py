import math
from collections import Counter

import duckdb

import corpus_pipeline
from siltstone.llm.quality import NAMES, THRESHOLD, learned
from siltstone.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near import brute as near
from tests.llm.test_quality import statistics

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    clean, bad = ({k for k, q in labels.items() if q == v} for v in (1, 0))
    assert len(clean - kept) <= 0.01 * len(clean) and len(bad & kept) <= 0.05 * len(bad)

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    once = stages["near_duplicates"](spark, docs, SF)
    assert once.columns == docs.columns
    assert sorted(r.doc_id for r in once.collect()) == sorted(k for k, root, _ in near(rows) if k == root)

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    pure = stages["decontaminate"](spark, docs, SF)
    assert pure.columns == docs.columns
    assert sorted(r.doc_id for r in pure.collect()) == sorted(r[0] for r in contaminated(rows, items) if not r[5])

    mixed = stages["mix"](spark, docs, SF)
    assert mixed.columns == docs.columns
    out = stages["shard"](spark, mixed, SF)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() == mixed.count()


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and {r.shard for r in rows} == set(range(24))
    assert corpus_pipeline.ORACLE_SQL is None
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


def test_chain_by_brute_force(spark):
    """The documents of the whole pipeline, in Python and in SQL of the mix, each stage on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learned(spark, docs, SF)

    def good(text):
        value = dict(zip(NAMES, statistics(text)))
        logit = model.intercept + sum(u.weight for u in model.rules if all((value[n] <= at) == upper for n, upper, at in u.conditions))
        return 1 / (1 + math.exp(-logit)) >= THRESHOLD

    rows = {r.doc_id: r for r in docs.collect() if good(r.text)}
    rows = {k: rows[k] for k, root, _ in near([(k, r.text) for k, r in rows.items()]) if k == root}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in contaminated([(k, r.text) for k, r in rows.items()], items) if r[5]}
    rows = {k: r for k, r in rows.items() if k not in dirty}
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(k, r.text, r.source) for k, r in rows.items()])
    want = Counter()
    for doc_id, size, taken in con.sql(ORACLE_SQL["op8_mixing"]).select("doc_id, size, taken").fetchall():
        want[doc_id] = 1 if size == 0 else math.floor(taken / size + 0.5)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == +want
    assert all(tuple(r)[:5] == tuple(rows[r.doc_id]) for r in got)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    size = [sum(len(r.text.encode()) for r in v) for v in shards.values()]
    assert len(size) == 24 and (max(size) - min(size)) / (sum(size) / 24) < 0.1
    assert all(len({r.shard for r in got if r.doc_id == k}) == 1 for k in list(want)[:50] if want[k])


def test_other_columns_and_very_long_texts(spark):
    long = " ".join(f"word{i % 997}x{i}" for i in range(100_000))
    rows = [(1, long, "en", "a", 5, 0.5, "x", 3), (2, long + " end", "en", "a", 5, 0.5, "x", 3), (3, None, None, None, None, None, None, None), (4, "", "en", "b", 0, 1.0, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, class_id string, shard int")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.columns == [*corpus_pipeline.COLUMNS, *(["shard", "slot"] if name == "shard" else [])]
        texts = {r.doc_id: r.text for r in got.collect()}
        assert all(texts[k] == rows[k - 1][1] for k in texts)
        assert set(texts) == {"near_duplicates": {1, 3, 4}, "decontaminate": {1, 2, 3, 4}, "mix": {1, 2, 3, 4}, "shard": {1, 2, 3, 4}}.get(name, set(texts))


def test_rows_without_ids_and_repeated_rows(spark):
    rows = [(1, "some words that are here", "en", "a", 1), (1, "some words that are here", "en", "a", 1), (2, "some words that are here", "en", "a", 1), (None, "more", None, None, None), (3, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "3", "None"]
