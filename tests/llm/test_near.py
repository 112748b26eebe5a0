import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.near import _bands, _groups, _sketch, intersections, least_matches, near_classes, op5_jaccard_join
from siltstone.llm.oracle import ORACLE_SQL
from siltstone.llm.words import words_of


def shingles(text, size=5):
    w = words_of((text or "").encode())
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, threshold=0.8):
    sets = {k: shingles(t) for k, t in docs}
    where = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    links = {k: set() for k in sets}
    for a, b in {p for ks in where.values() for p in combinations(sorted(set(ks)), 2)}:
        both = len(sets[a] & sets[b])
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a].add(b)
            links[b].add(a)
    root = {}
    for k in sorted(sets):
        if k not in root:
            work = [k]
            while work:
                x = work.pop()
                if x not in root:
                    root[x] = k
                    work += links[x]
    return {(k, root[k], len(links[k])) for k in sets}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {tuple(r) for r in near_classes(docs).collect()}
    want = brute([tuple(r) for r in docs.collect()])
    assert got == want
    assert any(r[2] > 1 for r in got)


def test_whole_table_in_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = set(con.sql(ORACLE_SQL["op5_jaccard_join"]).select("doc_id, class_id, n_links").fetchall())
    assert {tuple(r) for r in op5_jaccard_join(spark, sf).collect()} == want


def test_large_group_in_blocks(spark):
    rng = random.Random(5)
    base = [f"word{rng.randrange(500)}" for _ in range(120)]
    docs = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"other{k}{rng.random()}"
        docs.append((k * 3, " ".join(w)))
    docs += [(1000 + k, " ".join(f"x{rng.random()}" for _ in range(50))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for block, bucket in ((16, 8192), (40, 30), (256, 100)):  # buckets in blocks, too
        assert {tuple(r) for r in near_classes(df, block=block, bucket=bucket).collect()} == brute(docs)


def test_pairs_that_only_share_a_band_are_not_grouped(spark):
    """Half of the words are boilerplate: similar at a third, hence in common buckets by chance, but not connected."""
    rng = random.Random(6)
    plate = " ".join(f"plate{i}" for i in range(60))
    docs = [(k, plate + " " + " ".join(f"own{k}x{i}" for i in range(50))) for k in range(300)]
    docs += [(1000 + k, docs[k][1] + " end") for k in range(0, 300, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    reps = df.select(F.col("doc_id").alias("id"), "text").mapInArrow(lambda b: _sketch(b, 5), "id long, d1 long, d2 long, bytes long, signature binary").withColumnRenamed("id", "rep")
    keys = reps.select("rep", "signature").mapInArrow(_bands, "id long, key long").groupBy("key").count()
    assert keys.agg(F.max("count")).first()[0] > 2
    groups = {}
    for r in _groups(reps, 0.8, 1e-6, 64).collect():
        groups.setdefault(r.component, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[k, 1000 + k] for k in range(0, 300, 7)]
    assert {tuple(r) for r in near_classes(df).collect()} == brute(docs)


@pytest.mark.parametrize("size", [1, 5, 300, 2000])
def test_components_with_hubs(spark, size):
    """Stars around a few hubs (more links than a hub needs), chains between them, in any numbering."""
    rng = random.Random(size)
    name = list(range(5 * size + 10))
    rng.shuffle(name)
    links = [(name[c * size], name[c * size + i]) for c in range(5) for i in range(1, size)]
    links += [(name[0], name[size]), (name[5 * size], name[5 * size + 1]), (name[5 * size + 1], name[5 * size + 2]), (3, 3)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    rng.shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {k: m for k, m in root.items() if any(k in x and x[0] != x[1] for x in links)}


def test_very_long_text(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:-5000])), (3, " ".join(words[100_000:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in near_classes(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 3, 0)}


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "!!"), (4, "one two"), (5, "One, two"), (6, "one two three"), (None, "one two"), (7, "ü"), (8, "Ü"), (4, "one two")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, ID int, class_id string")
    got = sorted((tuple(r) for r in near_classes(df).collect()), key=str)
    want = [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 0), (None, None, 0), (7, 7, 0), (8, 8, 0), (4, 4, 1)]
    assert got == sorted(want, key=str)
    assert near_classes(df.limit(0)).count() == 0


def test_intersections_in_parts():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 300, 80)).astype(np.uint64) for _ in range(20)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    i, j = np.triu_indices(20, 1)
    want = [len(set(lists[a].tolist()) & set(lists[b].tolist())) for a, b in zip(i, j)]
    for limit in (50, 1 << 20):
        assert intersections(np.concatenate(lists), first, i, j, limit).tolist() == want


def test_pruning_bound():
    need = least_matches(0.8, 1e-6)
    assert need == sorted(need) and 0 < need[-1] < 0.8 * 96
