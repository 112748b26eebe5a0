import hashlib
import pickle
import random
import re

import pytest

from siltstone.llm.decontaminate import build, find_benchmark, op7_wu_manber, with_verdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=13):
    patterns = {}
    for k, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).update([] if k is None else [str(k)])
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for m, table in patterns.items():
            for i in range(len(w) - m + 1):
                if (ids := table.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def test_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = {tuple(r) for r in op7_wu_manber(spark, sf).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == set(brute(docs, items))
    assert any(r[5] for r in got)


@pytest.mark.parametrize("item_bytes", [1 << 20, 60])
def test_edges(spark, item_bytes):
    long = " ".join(f"w{i}" for i in range(40))
    docs = [(1, None), (2, ""), (3, "Ünï CODE x"), (4, long), (4, long), (5, "w3 w4 " + long.upper() + "-" + long), (6, "a b c"), (7, "a b"), (8, "c a b c. A,b;C"), (None, "a b c")]
    items = [(1, long), (2, "a b c"), (3, "A b C!"), (4, None), (5, ""), (6, "x"), (10, "ünï"), (11, "Ünï"), (None, "x"), (None, "b c"), (2, "a b c"), (2, "w3 w4")]
    left = spark.createDataFrame([(*d, "k", 5) for d in docs], "doc_id long, text string, item_id string, N_words int")
    right = spark.createDataFrame(items, "item_id long, text string")
    found = with_verdict(find_benchmark(left, right, item_bytes=item_bytes))
    got = sorted(
        ((r.doc_id, r.n_words, r.n_hit, len(r.hit_items), hashlib.sha256(",".join(r.hit_items).encode()).hexdigest(), r.contaminated) for r in found.collect()),
        key=str,
    )
    assert got == sorted(brute(docs, items), key=str)
    assert found.columns[:3] == ["doc_id", "text", "item_id"]


def test_empty_tables(spark):
    left = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_benchmark(left, none).first().hit_items == []
    assert find_benchmark(left.limit(0), none).count() == 0


def test_many_items_and_long_texts(spark):
    """Items that overlap, repeat and are sliced; a text of a megabyte; tables stay small."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 12, 13, 14, 40])))) for k in range(150)]
    items += [(1000 + k, items[k % 20][1]) for k in range(200)]
    long = " ".join(rng.choices(vocabulary + ["other"] * 300, k=150_000))
    docs = [(1, long + " " + items[5][1]), (2, " ".join(t for _, t in items[:40])), (3, "nothing")]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(r[:4] for r in brute(docs, items))
    for item_bytes in (1 << 20, 3000):
        found = with_verdict(find_benchmark(left, right, item_bytes=item_bytes))
        assert sorted((r.doc_id, r.n_words, r.n_hit, len(r.hit_items)) for r in found.collect()) == want
    texts = [" ".join(rng.choices([f"w{i}" for i in range(5000)], k=400)) for _ in range(500)]
    tables = pickle.dumps(build(texts))
    assert len(tables) < 20 * sum(map(len, texts))
