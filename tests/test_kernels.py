"""Kernels against straightforward sequential versions."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions import gear
from siltstone.operators.grouping import best_fit, first_fit, next_fit
from siltstone.plans.methods import greedy_merge

M64 = (1 << 64) - 1
CONTENT = st.lists(st.binary(max_size=600), min_size=1, max_size=6)


def parts(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def features_one(text, bits):
    h, out = 0, [0] * 12
    for b in text:
        h = ((h << 1) + int(gear.GEAR[b])) & M64
        if not h & gear.SAMPLE_MASKS[bits]:
            for j in range(12):
                out[j] = max(out[j], (h * int(gear.MULTIPLY[j]) + int(gear.ADD[j])) & M64)
    return out


@settings(max_examples=40, deadline=None)
@given(CONTENT, st.sampled_from([5, 2, 0]))
def test_features(texts, bits):
    got = gear.features(*parts(texts), bits)
    assert [[int(x) for x in r] for r in got] == [features_one(t, bits) for t in texts]


def cuts_one(text, average):
    least, most, mask = gear.cut_parameters(average)
    at, out = 0, []
    while at < len(text):
        n = len(text) - at
        i, fp, end = min(n, least), 0, None
        while i < min(most, n):
            fp = ((fp >> 1) + int(gear.CUT_GEAR[text[at + i]])) & 0xFFFFFFFF
            i += 1
            if not fp & mask:
                end = i
                break
        at += end or i
        out.append(at)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5), st.sampled_from([16, 64, 256]))
def test_cut_points(texts, average):
    assert [c.tolist() for c in gear.cut_points(*parts(texts), average)] == [cuts_one(t, average) for t in texts]


def test_cut_parameters():
    assert gear.cut_parameters(2048) == (1024, 4096, 1023)


@settings(max_examples=20, deadline=None)
@given(CONTENT)
def test_ntransform(texts):
    got = gear.ntransform(*parts(texts))
    for t, row in zip(texts, got):
        fps = [sum(b * pow(257, 63 - k, 1 << 64) for k, b in enumerate(t[i : i + 64])) & M64 for i in range(len(t) - 64)]
        for j in range(12):
            best, target = 0, 0
            for f in fps:
                v = (f * int(gear.MULTIPLY[j]) + int(gear.ADD[j])) & 0xFFFFFFFF
                if v > best:
                    best, target = v, f
            assert int(row[j]) == target


def test_finesse():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 100, 600, 1000, 1024)]
    got = gear.finesse(*parts(texts))
    for t, row in zip(texts, got):
        bounds = [len(t) * b // 12 for b in range(13)]
        for b in range(12):
            want = 0
            if bounds[1] >= 48:
                for i in range(bounds[b], bounds[b + 1] - 47):
                    fp = 0
                    for x in t[i : i + 48]:
                        fp = (fp * 37 + x) % 1_000_000_007
                    want = max(want, fp)
            assert row[b] == want


def test_packers():
    assert next_fit([1, 1, 3, 5, 7], 8) == [0, 0, 0, 1, 2]
    assert sorted(map(sorted, best_fit([5, 3, 2, 6], 8))) == [[0, 1], [2, 3]]
    assert first_fit([10, 9, 6, 7], 16) == [0, 1, 0, 1]
    assert next_fit([], 8) == [] and best_fit([], 8) == []


@given(st.integers(0, 40))
@settings(max_examples=41, deadline=None)
def test_best_fit_of_single_chunks_is_packing_in_order(n):
    sets = [sorted(s) for s in best_fit([1] * n, 8)]
    assert sets == [list(range(k, min(n, k + 8))) for k in range(0, n, 8)]


@given(st.lists(st.integers(1, 8), max_size=20))
@settings(max_examples=60, deadline=None)
def test_bins_keep_the_cap(sizes):
    for bins in (next_fit(sizes, 8), first_fit(sizes, 8)):
        for b in set(bins):
            assert sum(n for n, x in zip(sizes, bins) if x == b) <= 8
    merged = best_fit(sizes, 8)
    assert sorted(i for s in merged for i in s) == list(range(len(sizes)))


def test_greedy_saves_bytes():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, 400, dtype=np.uint8).tobytes()
    other = rng.integers(0, 256, 400, dtype=np.uint8).tobytes()
    groups = greedy_merge([base, other, base, base[:300], other], 3)
    assert sorted(map(sorted, groups)) == [[0, 2, 3], [1, 4]]
    assert len(greedy_merge([base] * 5, 2)) == 3


def test_lz4_round_trip():
    codec = pa.Codec("lz4_raw")
    raw = b"abc" * 500
    assert codec.decompress(codec.compress(raw, asbytes=True), len(raw), asbytes=True) == raw


def test_bins_do_not_depend_on_batches(monkeypatch):
    import json
    from types import SimpleNamespace

    from siltstone.operators import grouping
    from siltstone.operators.grouping import _bins, _go_on, _next_fit_range

    monkeypatch.setattr(grouping, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))

    def next_bins(batches):
        """One range: its first key starts with a new bin."""
        rows = pa.Table.from_batches(list(_next_fit_range(batches, 8)))
        items = rows.filter(pa.compute.is_valid(rows["item"]))
        assert json.loads([x for x in rows["state"].to_pylist() if x][0])["first"] == "k0"
        left = items.filter(pa.compute.is_null(items["bin"]))
        left = left.append_column("fill", pa.array([8] * len(left))).append_column("carried", pa.array([None] * len(left), pa.int64()))
        done = items.filter(pa.compute.is_valid(items["bin"])).select(["item", "bin"])
        return [*done.to_batches(), *_go_on(left, 8).to_batches()]

    rng = np.random.default_rng(8)
    keys = np.sort(rng.integers(0, 6, 200))
    table = pa.table({"key": pa.array([f"k{k}" for k in keys]), "item": pa.array(np.arange(200)), "size": pa.array(rng.integers(1, 8, 200))})
    for fit in ("next", "best", "first"):
        results = set()
        for size in (1, 3, 1000):
            batches = iter(table.to_batches(max_chunksize=size))
            packed = next_bins(batches) if fit == "next" else _bins(batches, 8, fit)
            results.add(tuple(sorted((r["item"], r["bin"]) for b in packed for r in b.to_pylist())))
        assert len(results) == 1
        (rows,) = results
        fill = {}
        for item, bin_ in rows:
            fill.setdefault(bin_, []).append(item)
            assert keys[item] == keys[bin_]
        assert all(sum(table["size"][i].as_py() for i in items) <= 8 and min(items) == b for b, items in fill.items())


def test_first_fit_of_a_key_of_any_size():
    import random

    from siltstone.operators.grouping import _bins

    rng = random.Random(7)
    sizes = [rng.randrange(1, 16) for _ in range(3000)]
    columns = {"key": ["k"] * 3000, "item": list(range(3000)), "size": sizes}
    batches = pa.Table.from_pydict(columns).to_batches(max_chunksize=700)
    got = [b for batch in _bins(iter(batches), 16, "first") for b in batch.column("bin").to_pylist()]
    bins = first_fit(sizes, 16)
    assert got == [bins.index(b) for b in bins]


def test_containers_of_blocks_of_ranges():
    """Tables of ranges, put together, say the same as one pass over all sizes."""
    import random

    from siltstone.operators.compress import _composed, _passed, _run, _starts, _tables, _transitions

    rng = random.Random(9)
    for _ in range(200):
        limit = rng.choice([10, 40, 1000])
        ranges = [[rng.randrange(1, 10) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 7))]
        parts = []
        for p, sizes in enumerate(ranges):
            t = _transitions(pa.table({"_part": pa.array([p] * len(sizes), pa.int32()), "_at": list(range(len(sizes))), "size": sizes}), limit)
            parts.append(t.append_column("block", pa.array([0] * len(t), pa.int32())))
        table = pa.concat_tables(parts)
        block = _tables(zip(*(_composed(table).column(c).to_pylist() for c in ("block", "entry", "opened", "fill"))))[0]
        for fill in {0, limit, rng.randrange(limit + 1)}:
            whole = [n for sizes in ranges for n in sizes]
            bins, _, end = _run(whole, fill, limit)
            assert _passed(block, fill) == (bins[-1], end)
            started = _starts(table.append_column("c", pa.array([5] * len(table))).append_column("f", pa.array([fill] * len(table))))
            before = 0
            for row, sizes in zip(started.to_pylist(), ranges):
                bins, _, now = _run(whole[:before], fill, limit)
                assert (row["c"], row["f"]) == (5 + (bins[-1] if bins else 0), now)
                before += len(sizes)
