import math
from collections import Counter

import duckdb
import numpy as np

from siltstone.llm.oracle import ORACLE_SQL
from siltstone.llm.search import BLOCK_DOCS, TILE_BLOCKS, Index, op10_bm25_wand, search
from siltstone.llm.words import words_of


def scores(docs, queries, k1=1.2, b=0.75):
    """For each query the score of every document (by place) that shares a word with it."""
    bags = [(d, Counter(words_of((t or "").encode()))) for d, t in docs]
    n = len(bags)
    mean = sum(sum(c.values()) for _, c in bags) / n
    df = Counter(w for _, c in bags for w in c)
    lists = {}
    for i, (_, c) in enumerate(bags):
        norm = k1 * (1 - b + b * sum(c.values()) / mean)
        for w, tf in c.items():
            lists.setdefault(w, []).append((i, tf * (k1 + 1) / (tf + norm)))
    for q, text in queries:
        score = Counter()
        for w, tf in Counter(words_of((text or "").encode())).items():
            if w in lists:
                idf = math.log1p((n - df[w] + 0.5) / (df[w] + 0.5))
                for i, x in lists[w]:
                    score[i] += tf * idf * x
        yield q, score


def brute(docs, queries, k=10):
    for q, score in scores(docs, queries):
        best = sorted((-round(s, 6), docs[i][0]) for i, s in score.items() if docs[i][0] is not None)[:k]
        yield from ((q, r + 1, d, -s) for r, (s, d) in enumerate(best))


def close(got, docs, queries, k=10):
    """Every document found has its true score, is found once, and no score is missing at any rank; documents whose scores
    differ by less than the last digit may change places."""
    rows = {}
    for q, r, d, s in sorted(map(tuple, got)):
        rows.setdefault(q, []).append((r, d, s))
    place = {d: i for i, (d, _) in enumerate(docs)}
    for q, score in scores(docs, queries):
        best = sorted((s for s in score.values()), reverse=True)[:k]
        own = rows.pop(q, [])
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1))
        assert len({d for _, d, _ in own}) == len(own)
        for (_, d, s), t in zip(own, best):
            assert abs(s - t) < 2e-6 and abs(s - score[place[d]]) < 2e-6, (q, d)
    assert not rows


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    close(op10_bm25_wand(spark, sf).collect(), docs, [d for d in docs if d[0] % 50 == 0])


def test_sql(spark):
    """Ranks, ids and scores are those of a plain scan over all documents."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op10_bm25_wand"])
    assert sorted(map(tuple, op10_bm25_wand(spark, sf).select(*want.columns).collect())) == sorted(want.fetchall())


def test_edges_and_query_blocks(spark):
    docs = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 12))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (7, docs[7][1]), (None, "w1 w2"), (1002, "w5 " * 3000), (1003, "?")]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, SCORE int").repartition(3)
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, None), (3, "nothing"), (4, docs[9][1]), (None, "w1")], "q long, t string")
    want = list(brute(docs, [(1, "w1 w2 w2"), (4, docs[9][1])], k=5))
    for block in (5, 1 << 20):
        got = search(df, asked, k=5, query_id="q", query_text="t", block_terms=block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert search(df.limit(0), asked, query_id="q", query_text="t").count() == 0
    assert search(df, asked.limit(0), query_id="q", query_text="t").count() == 0


def test_more_queries_are_not_more_passes(spark):
    """Blocks of queries are asked of the same index: documents are read as often for many blocks as for one."""
    docs = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 12))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got, passes = [], []
    for block in (20, 1 << 20):
        found = search(df, df.where("doc_id % 20 = 0"), k=5, block_terms=block)
        passes.append(found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        got.append(sorted(map(tuple, found.collect())))
    assert passes[0] == passes[1]
    assert got[0] == got[1] == sorted(brute(docs, [d for d in docs if d[0] % 20 == 0], k=5))


def test_tiles_of_other_documents_are_skipped(monkeypatch):
    """Two kinds of documents without common terms, mixed: no tile of the other kind is scored, and results are those of all
    scores; with and without thresholds, for frequent and rare terms that occur once or more."""
    rng, n, k = np.random.default_rng(5), 8000, 7
    bags = [np.sort(rng.choice(rng.zipf(1.2, 60) % 3000, 40)).astype(np.uint64) * np.uint64(2) + np.uint64(i % 2) for i in range(n)]
    each = [np.unique(b, return_counts=True) for b in bags]
    terms, counts = np.concatenate([t for t, _ in each]), np.concatenate([c for _, c in each]).astype(np.uint32)
    index = Index(np.arange(n) * 3, np.full(n, 40.0), terms, counts, np.array([len(t) for t, _ in each]), 40.0)
    asked = [index.doc_term[index.doc_first[d] : index.doc_first[d + 1]].astype(np.int64) for d in range(0, 60, 2)]
    query, places = np.repeat(np.arange(len(asked)), [len(t) for t in asked]), np.concatenate(asked)
    weights = 1.0 + 1.0 / np.diff(index.first)[places]
    every = np.zeros((len(asked), n))
    for q, t, w in zip(query, places, weights):
        docs = np.flatnonzero(index.doc_term == t)
        count = counts[docs].astype(float)
        every[q, np.searchsorted(index.doc_first, docs, "right") - 1] += w * count * 2.2 / (count + 1.2)
    best = np.argsort(-np.round(every, 9), axis=1, kind="stable")[:, :k]
    scores = np.take_along_axis(every, best, 1)
    seen, near = [], Index._near
    monkeypatch.setattr(Index, "_near", lambda self, own, score, need, low: (seen.append(need), near(self, own, score, need, low))[1])
    for least in (np.zeros(len(asked)), scores[:, -1]):
        q, d, s = index.search(query, places, weights, len(asked), k, least)
        assert (q == np.repeat(np.arange(len(asked)), k)).all()
        assert np.allclose(s.reshape(-1, k), scores) and (np.sort(d.reshape(-1, k)) == np.sort(best)).mean() > 0.99
    width = BLOCK_DOCS * TILE_BLOCKS
    assert index.tiles == -(-n // width)
    for need in seen:
        assert need.any(axis=0).sum() <= index.tiles // 2 + 7  # tiles at the edges of the eight groups have both kinds
