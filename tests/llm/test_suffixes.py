import hashlib
import random

import numpy as np
import pytest

from siltstone.llm.bwt import Segments, merge
from siltstone.llm.suffixes import op2_suffix_merge, remove_repeats


def brute(docs, length=100):
    """Texts by id; every later occurrence of a window marks its bytes."""
    seen, out = set(), {}
    for k in sorted(docs):
        raw = (docs[k] or "").encode()
        hit = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = hashlib.blake2b(raw[s : s + length], digest_size=12).digest()
            if w in seen:
                hit[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out[k] = (len(raw), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_merge_of_transforms():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 60))) for _ in range(12)]
    texts += texts[:2]
    size = np.array([len(t) for t in texts])
    seg = Segments(np.frombuffer(b"".join(texts), np.uint8), size)
    length = 8
    for shards in ([slice(0, 14)], [slice(0, 5), slice(5, 9), slice(9, 14)], [slice(i, i + 1) for i in range(14)]):
        order, common, first = merge(seg, shards, length)
        rot = [(texts[seg.row[p]] + b"\0")[p - seg.start[seg.row[p]] :] + (texts[seg.row[p]] + b"\0")[: p - seg.start[seg.row[p]]] for p in order]
        cut = [(r * 3)[:length] for r in rot]
        assert cut == sorted(cut)
        assert first.tolist() == [i for i in range(len(cut)) if i == 0 or cut[i] != cut[i - 1]]
        for i in range(1, len(cut)):
            same = next((k for k in range(length) if cut[i][k] != cut[i - 1][k]), length)
            assert common[i] == same - same % 4


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in op2_suffix_merge(spark, sf).collect()}
    want = brute(docs)
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not wrong, list(wrong.items())[:3]
    assert sum(v[1] for v in want.values()) > 10000


@pytest.mark.parametrize("merge_bytes, hot", [(10, 1 << 14), (300, 3), (1 << 20, 1 << 14), (1 << 20, 1)])
def test_many_small_repeats(spark, merge_bytes, hot):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [word(n) for n in (40, 60, 70, 90, 99, 100, 101, 120, 150, 200, 300)]
    docs = {}
    for k in range(120):
        parts = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            parts.append(p if rng.random() < 0.7 else p[rng.randrange(20) : len(p) - rng.randrange(20)])
            parts.append(word(rng.randrange(60)))
        docs[k] = "".join(parts)
    docs |= {200: "a" * 5000, 201: "a" * 99, 202: "a" * 100, 203: "ab" * 300, 204: None, 205: "", 206: docs[5], 207: docs[5] + "x", 208: "a" * 4000 + word(100) + "a" * 150}
    rows = [*docs.items(), (5, docs[5]), (None, docs[5])]
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, ID2 int, kept binary").repartition(6)
    got = remove_repeats(df, merge_bytes=merge_bytes, hot=hot).collect()
    want = brute(docs)
    for r in got:
        if r.doc_id is None:
            assert (r.n_removed, r.kept.decode()) == (0, docs[5])
            continue
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert sum(x["end"] - x["start"] for x in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    assert len(got) == len(rows)
    assert remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 2, 3, 100])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_decisions_do_not_depend_on_batches(size, hot):
    import pyarrow as pa

    from siltstone.llm.suffixes import _decide

    rng = random.Random(11)
    rows = sorted({(rng.randrange(12), rng.randrange(3), rng.randrange(6), rng.choice([-1, 0, 1, 2])) for _ in range(120)} | {(99, 0, 1, 0)})
    rows += rows[:0]
    rows = sorted(rows * 2)  # repeated rows stand for repeated ids
    names = ("h", "c", "id", "pos")
    cols = {n: [r[k] for r in rows] for k, n in enumerate(names)} | {"start": [r[3] * 10 for r in rows], "size": [7] * len(rows)}
    types = {"h": pa.int64(), "c": pa.int64(), "id": pa.int64(), "pos": pa.int32(), "start": pa.int32(), "size": pa.int32()}
    table = pa.table({n: pa.array(cols[n], t) for n, t in types.items()})
    got = [tuple(r.values()) for b in _decide(iter(table.to_batches(max_chunksize=size)), hot) for r in b.to_pylist()]
    real = [r for r in rows if r[3] >= 0]
    classes, first = {}, {}
    for h, c, i, p in real:
        classes.setdefault(h, set()).add(c)
        first.setdefault((h, c), (i, p))
    want = [(i, p * 10, 7, -1) for h, c, i, p in rows if p < 0]
    later = {(h, c, i, p) for h, c, i, p in real if (i, p) != first[h, c]}
    undecided = [(i, p * 10, 7, p if len(classes[h]) <= hot else -2 - p) for (h, c), (i, p) in first.items() if len(classes[h]) > 1]
    assert sorted(g for g in got if g[3] != -1) == sorted(undecided)
    assert {g for g in got if g[3] == -1} == set(want) | {(i, p * 10, 7, -1) for _, _, i, p in later}


def test_one_id_with_several_texts(spark):
    """Only one of its texts takes part; the others are left as they are, like rows without an id."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(3)]
    rows = [(1, texts[0]), (1, texts[1] + texts[2]), (1, texts[0]), (2, texts[1] + "x" + texts[0]), (3, texts[2]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
    results = []
    for own in (0, 1):
        want = brute({1: rows[own][1], 2: rows[3][1], 3: rows[4][1]})
        all_ = {(k, v[0]): v[1:] for k, v in want.items()}
        for k, other in ((1, rows[1 - own][1]), (None, texts[0])):
            all_[k, len(other)] = (0, 0, hashlib.sha256(other.encode()).hexdigest())
        results.append(all_)
    assert got in results and len(remove_repeats(df).collect()) == len(rows)


def test_very_long_text(spark):
    rng = random.Random(9)
    block = "".join(rng.choice("abcdefghij é") for _ in range(300_000))
    docs = {1: block, 2: block[150_000:] + "|" + block[:1000], 3: "q" * 400_000}
    got = {r.doc_id: tuple(r)[1:5] for r in remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute(docs)
