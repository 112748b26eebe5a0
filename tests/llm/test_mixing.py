from siltstone.llm.mixing import mix_sources, mixed_rows, op8_mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares by weight; what is above a limit is shared again among the others, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            got |= {s: level * w[s] for s in open_}
            break
        for s in full:
            got[s] = most * sizes[s]
            left -= got[s]
        open_ -= full
    return got


def check(rows, sizes):
    want = targets(sizes)
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return taken, want


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = op8_mixing(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    rows = rows.join(docs, "doc_id").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    taken, want = check(rows, sizes)
    assert all(want[s] - 1 < taken[s] <= want[s] for s in taken)
    again = {r.doc_id: r.taken for r in op8_mixing(spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_edges(spark):
    rows = [(k, f"s{k % 3}", (k * 7) % 50) for k in range(200)] + [(900, None, 5), (901, None, None), (902, "z", 0), (903, "big", 10**6), (7, "s1", 49), (7, "s1", 49), (None, "s2", 3), (None, "s2", 3)]
    df = spark.createDataFrame([(*r, "keep", 1.0) for r in rows], "doc_id long, source string, size long, KEY string, TARGET double").repartition(6)
    got = mix_sources(df)
    assert got.columns == ["doc_id", "source", "size", "KEY", "source_size", "target", "taken"]
    out = [r.asDict() | {"size": r["size"] or 0} for r in got.collect()]
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]

    class Row:
        def __init__(self, d):
            self.__dict__ = d

    taken, want = check([Row(r) for r in out], sizes)
    assert all(want[s] - 4 < taken[s] <= want[s] for s in taken)  # equal keys share what is left
    assert mix_sources(df.limit(0)).count() == 0


def test_rows(spark):
    docs = [(k, f"s{k % 2}", "w " * (k % 5 + 1)) for k in range(400)] + [(1000, "s0", None), (1001, "s1", "")]
    df = spark.createDataFrame([(*d, "row") for d in docs], "doc_id long, source string, text string, row string")
    got = mixed_rows(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id >= 1000) == [1000, 1001]
    words = sum(len((r.text or "").split()) for r in rows)
    total = sum(len((t or "").split()) for _, _, t in docs)
    assert abs(words - 1.5 * total) <= 6
