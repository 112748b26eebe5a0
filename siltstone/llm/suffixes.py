"""Removal of repeated strings: every byte covered by a string of ``length`` bytes that also starts earlier.

1. Anchors.  In each window of ``length`` bytes the 24-gram with the smallest hash is an anchor (winnowing),
   so equal windows share an anchor at the same place.  An anchor's context holds the windows that have it.  Contexts that are equal form a class; of a class only the first occurrence can be new, and all
   others are repeated as a whole.  A task does this for its own rows before anything is shuffled, so an
   anchor or a context with very many copies reaches the shuffle once for each task.
2. First occurrences of classes whose anchor has several classes are undecided (an edit, or the end of a
   passage).  Each is cut into its windows with the anchor far in and those with it near the start, keyed
   by the bytes that all these windows share.
3. For each key, the segments are split into shards; each shard's Burrows-Wheeler transform is built, and
   the transforms are merged by interleave refinement.  Intervals with a common prefix of ``length`` bytes are
   the repeated strings; all their occurrences but the first are removed.

4. An anchor with more than ``hot`` different contexts (the edge of a passage that very many documents hold) would give
   keys with as many segments.  Each of its windows is a key of its own instead, of 128 bits without the bytes, so
   no key ever has more than ``hot`` different segments, which bounds the memory of a merge.

Text goes through one shuffle, by id; the exchange serves both the cutting and the removal.

Defined results: ids are integers; a null text counts as empty; matches never cross documents; rows with equal ids are
one document (so repeated rows get the same result, and none is a copy of the other); if their texts differ, the
document is the text with the smallest hash, and rows with other texts of that id, like those without an id, are not
compared with others and lose nothing; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bwt import Segments, merge
from siltstone.llm.common import RangeHash, bounded_batches, mix64, read_table, steps, text_bytes, written

LENGTH = 100
GRAM = 24
#: Bytes of segments that are merged at once, and bytes of a shard.
MERGE_BYTES = 1 << 20
SHARD_BYTES = 256 << 10
#: Different contexts of an anchor whose segments are merged, at most (of up to 138 bytes each).
HOT = 1 << 14
_hash, _second = RangeHash(21), RangeHash(31)

ANCHOR = "h long, c long, id long, pos int, start int, size int"
RANGES = "id long, start int, size int, pos int"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, place in the data, and hash of the anchors of all windows; and where the windows that have an
    anchor start and end."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, np.zeros(0, np.uint64), none, none
    grams = _hash.grams(_hash.prefix(data), GRAM)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(packed, length - GRAM + 1)
    last = np.maximum(offsets[1:] - length + 1, offsets[:-1])  # the windows of a row start before it
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, offsets[:-1], 1)
    np.add.at(edge, last, -1)
    window = np.flatnonzero(np.cumsum(edge)[: len(least)] > 0)
    at = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(at) - 1]]) if len(at) else first
    at = at[first]
    return np.searchsorted(offsets, at, "right") - 1, at, grams[at], window[first], window[last] + length


def merged_ranges(id_: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges of each id."""
    if not len(id_):
        return id_, start, size
    order = np.lexsort((start, id_))
    i, s = id_[order], start[order].astype(np.int64)
    e = s + size[order]
    group = np.concatenate([[0], np.cumsum(i[1:] != i[:-1])])
    span = int(e.max()) + 2
    reach = np.maximum.accumulate(e + group * span) - group * span  # running maximum within each id
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (s[1:] > reach[:-1])
    first = np.flatnonzero(new)
    end = reach[np.concatenate([first[1:] - 1, [len(i) - 1]])]
    return i[first], s[first], end - s[first]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _anchor_rows(h, c, id_, pos, start, size) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(h), 1 << 16):
        part = slice(k, k + (1 << 16))
        yield _batch(h=h[part].view(np.int64), c=c[part].view(np.int64), id=id_[part], pos=pos[part].astype(np.int32), start=start[part].astype(np.int32), size=size[part].astype(np.int32))


def _classes(h, c, id_, pos):
    """Order by class and place; masks over it: first of a class; a later one (not the same place again)."""
    order = np.lexsort((pos, id_, c, h))
    h, c, id_, pos = h[order], c[order], id_[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    again = np.zeros(len(h), bool)
    again[1:] = ~new[1:] & (id_[1:] == id_[:-1]) & (pos[1:] == pos[:-1])
    return order, new, ~new & ~again


def _find(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Anchors of a task's rows, one for each class (``pos`` >= 0); and what is repeated in the task (``pos`` -1)."""
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for i, j in steps(offsets):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            row, at, h, start, end = anchors(d, o, length)
            if not len(at):
                continue
            shape = ((at - start) * (2 * length) + (end - start)).astype(np.uint64)
            c = mix64(_second.ranges(_second.prefix(d), start, end) + shape)
            for p, v in zip(parts, (h, c, ids[i + row], at - o[row], start - o[row], end - start)):
                p.append(v)
    if not parts[0]:
        return
    h, c, id_, pos, start, size = (np.concatenate(p) for p in parts)
    order, first, later = _classes(h, c, id_, pos)
    r_id, r_start, r_size = merged_ranges(*(x[order[later]] for x in (id_, start, size)))
    yield from _anchor_rows(*(x[order[first]] for x in (h, c, id_, pos, start, size)))
    key = mix64(r_id.astype(np.uint64))
    yield from _anchor_rows(key, np.zeros(len(r_id), np.uint64), r_id, np.full(len(r_id), -1), r_start, r_size)


def _decide(batches: Iterator[pa.RecordBatch], hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """From rows ordered by (h, c, id, pos): repeated ranges (``pos`` -1) and undecided anchors (``pos``, or -2 - ``pos`` for
    anchors with more than ``hot`` classes).  Of the last anchor seen, the first places of at most ``hot`` classes are
    kept back, until it is known how many there are."""
    last_h = last_c = last_place = None
    held = [np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int32)]
    passed = 0  # classes of the last anchor that are out already
    for batch in batches:
        if not len(batch):
            continue
        h, c, id_, pos, start, size = (batch.column(x).to_numpy() for x in ("h", "c", "id", "pos", "start", "size"))
        done = pos < 0  # repeated already; passed on
        keep = np.flatnonzero(~done)
        out = [(id_[done], start[done], size[done], pos[done])]
        if len(keep):
            kh, kc, ki, kp = h[keep], c[keep], id_[keep], pos[keep]
            new_h = np.ones(len(keep), bool)
            new_h[1:] = kh[1:] != kh[:-1]
            new_h[0] = kh[0] != last_h
            new_c = new_h.copy()
            new_c[1:] |= kc[1:] != kc[:-1]
            new_c[0] |= kc[0] != last_c
            same = np.zeros(len(keep), bool)
            same[1:] = (ki[1:] == ki[:-1]) & (kp[1:] == kp[:-1])
            same[0] = (ki[0], kp[0]) == last_place
            later = keep[~new_c & ~same]
            out.append((id_[later], start[later], size[later], np.full(len(later), -1, np.int32)))
            firsts = keep[new_c]
            group = np.concatenate([np.zeros(len(held[0]), np.int64), np.cumsum(new_h)[new_c]])  # 0: the anchor of the batch before
            first = [np.concatenate([old, x[firsts]]) for old, x in zip(held, (id_, start, size, pos))]
            last = int(new_h.sum())
            count = np.bincount(group, minlength=last + 1)
            count[0] += passed
            many = count[group] > hot
            ready = np.where(group == last, many, count[group] > 1)
            out.append((*(x[ready] for x in first[:3]), np.where(many, -2 - first[3], first[3])[ready]))
            held = [x[(group == last) & ~many] for x in first]
            passed = int(count[last]) if count[last] > hot else 0
            last_h, last_c, last_place = kh[-1], kc[-1], (ki[-1], kp[-1])
        i, s, n, p = (np.concatenate(x) for x in zip(*out))
        yield _batch(id=i, start=s.astype(np.int32), size=n.astype(np.int32), pos=p.astype(np.int32))
    if len(held[0]) > 1:
        yield _batch(id=held[0], start=held[1], size=held[2], pos=held[3])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Segments of undecided anchors by key; segments equal to an earlier one of the task are only ranges
    (null bytes).  ``places``: anchors of each text, with their contexts.  Windows of anchors with very many
    contexts have a second hash of eight bytes for a segment."""
    half = (length - GRAM) // 2
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids = batch.column("id").to_numpy()
        places = batch.column("places")
        first = np.concatenate([[0], np.cumsum(np.diff(places.offsets.to_numpy()))])
        flat = places.flatten()
        pos, start, size = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
        for i, j in steps(offsets):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            part = slice(first[i], first[j])
            row = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
            begin = o[row] + start[part]
            stop = begin + size[part]
            prefix, prefix2 = _hash.prefix(d), _second.prefix(d)
            many = pos[part] < 0
            at = o[row] + np.where(many, -2 - pos[part], pos[part])
            n = (stop - begin - length + 1)[many]  # windows, each of them a key
            lone = np.repeat(begin[many] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows, keys, starts, ends = [np.repeat(row[many], n)], [_hash.ranges(prefix, lone, lone + length) + np.uint64(2)], [lone], [lone + length]
            row, at, begin, stop = (x[~many] for x in (row, at, begin, stop))
            for side, (k0, k1, s, e) in enumerate(
                # key, and the windows that have the anchor at least half a gap in; the others
                ((at - half, at + GRAM, begin, np.minimum(stop, at - half + length)), (at, at + length - half + 1, np.maximum(begin, at - half + 1), stop))
            ):
                ok = e - s >= length  # these windows hold the key
                rows.append(row[ok])
                keys.append(_hash.ranges(prefix, k0[ok], k1[ok]) + np.uint64(side))
                starts.append(s[ok])
                ends.append(e[ok])
            row, key, s, e = (np.concatenate(x) for x in (rows, keys, starts, ends))
            short = np.arange(len(row)) < len(lone)
            if not len(row):
                continue
            whole = mix64(_second.ranges(prefix2, s, e) + (e - s).astype(np.uint64))
            order, new, later = _classes(key, whole, ids[i + row], s - o[row])
            l_id, l_start, l_size = merged_ranges(*(x[order[later]] for x in (ids[i + row], s - o[row], e - s)))
            kept = order[new]
            raw = d.tobytes()
            text = [w.tobytes() if x else raw[a:b] for a, b, w, x in zip(s[kept].tolist(), e[kept].tolist(), whole[kept], short[kept].tolist())]
            yield _batch(
                key=np.concatenate([key[kept].view(np.int64), mix64(l_id.astype(np.uint64)).view(np.int64)]),
                id=np.concatenate([ids[i + row[kept]], l_id]),
                start=np.concatenate([(s - o[row])[kept], l_start]).astype(np.int32),
                size=np.concatenate([(e - s)[kept], l_size]).astype(np.int32),
                segment=pa.array(text + [None] * (len(l_id)), pa.binary()),
            )


def repeated(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray, length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (id, start, size) of the segments' windows that also are at an earlier place."""
    seg = Segments(data, sizes)
    cuts = [0]
    for k, end in enumerate(np.cumsum(seg.size)):
        if end - (seg.start[cuts[-1]]) >= shard_bytes and k + 1 < len(sizes):
            cuts.append(k + 1)
    shards = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(sizes)])]
    order, _, first = merge(seg, shards, length)
    row = seg.row[order]
    offset = order - seg.start[row]
    place = starts[row] + offset
    rank = np.searchsorted(np.unique(ids), ids)[row] * (1 << 32) + place
    valid = offset + length <= sizes[row]
    least = np.minimum.reduceat(np.where(valid, rank, np.iinfo(np.int64).max), first)
    size = np.diff(np.concatenate([first, [len(order)]]))
    hit = valid & (rank > np.repeat(least, size))
    return merged_ranges(ids[row[hit]], place[hit], np.full(hit.sum(), length))


def _resolve(batches: Iterator[pa.RecordBatch], length: int, merge_bytes: int) -> Iterator[pa.RecordBatch]:
    """Ranges that are repeated, from segments ordered by key."""

    def out(id_, start, size):
        return _batch(id=id_, start=start.astype(np.int32), size=size.astype(np.int32))

    def collapsed(tables: list[pa.Table]) -> tuple[pa.Table, tuple[np.ndarray, ...]]:
        """Of equal segments of a key the first one (rows come by key and place), and the ranges of the others,
        which are repeated as a whole."""
        table = pa.concat_tables(tables)
        key = table.column("key").to_numpy()
        segment = table.column("segment").combine_chunks()
        if isinstance(segment, pa.ChunkedArray):
            segment = pa.concat_arrays(segment.chunks)
        ids, starts, sizes = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "start", "size"))
        order, new, later = _classes(key, segment.dictionary_encode().indices.to_numpy(), ids, starts)
        done = order[later]
        return table.take(pa.array(np.sort(order[new]))), (ids[done], starts[done], sizes[done])

    def work(tables: list[pa.Table]) -> pa.RecordBatch | None:
        table, done = collapsed(tables)
        found = [done]
        table = table.filter(pc.equal(pc.binary_length(table.column("segment")), table.column("size")))  # the others are single windows
        _, inverse, count = np.unique(table.column("key").to_numpy(), return_inverse=True, return_counts=True)
        table = table.take(pa.array(np.flatnonzero(count[inverse] > 1)))  # a key of its own decides nothing
        if len(table):
            ids, starts, sizes = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "start", "size"))
            data = np.frombuffer(b"".join(table.column("segment").to_pylist()), np.uint8)
            found.append(repeated(ids, starts, sizes, data, length))
        got = merged_ranges(*(np.concatenate(x) for x in zip(*found)))
        return out(*got) if len(got[0]) else None

    held: list[pa.Table] = []  # whole keys, but for the last one
    total, last, most = 0, None, 16 * merge_bytes
    for batch in batches:
        table = pa.Table.from_batches([batch])
        done = pc.is_null(table.column("segment"))
        ready = table.filter(done)
        if len(ready):
            yield out(*(ready.column(c).to_numpy() for c in ("id", "start", "size")))
        table = table.filter(pc.invert(done))
        if not len(table):
            continue
        key = table.column("key").to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        size = np.concatenate([[0], np.cumsum(table.column("size").to_numpy().astype(np.int64))])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if total >= merge_bytes and key[a] != last:
                got = work(held)
                if got is not None:
                    yield got
                held, total, most = [], 0, 16 * merge_bytes
            held.append(table.slice(a, b - a))
            total += int(size[b] - size[a])
            last = key[a]
            if total >= most:  # a key with very many segments: only different ones are kept
                kept, again = collapsed(held)
                if len(again[0]):
                    yield out(*merged_ranges(*again))
                held, total = [kept], int(pc.sum(kept.column("size")).as_py())
                most = max(most, 2 * total)
    if held:
        got = work(held)
        if got is not None:
            yield got


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        raw = data.tobytes()
        ranges = batch.column("ranges")
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        cols: dict[str, list] = {n: [] for n in names}
        spans = []
        for r in range(len(batch)):
            text = raw[offsets[r] : offsets[r + 1]]
            got = ranges[r].as_py() or []
            one = np.zeros(len(got), np.int64)
            _, start, size = merged_ranges(one, np.array([x["start"] for x in got], np.int64), np.array([x["size"] for x in got], np.int64))
            kept, at, runs = [], 0, []
            for a, n in zip(start.tolist(), size.tolist()):
                kept.append(text[at:a])
                runs.append({"start": a, "end": a + n})
                at = a + n
            kept.append(text[at:])
            rest = b"".join(kept)
            for name, v in zip(names, (len(text), int(size.sum()), len(runs), hashlib.sha256(rest).hexdigest(), rest)):
                cols[name].append(v)
            spans.append(runs)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(cols[n], t) for n, t in zip(names, types)), pa.array(spans, span)], names=["id", *names, "spans"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, merge_bytes: int = MERGE_BYTES, hot: int = HOT) -> DataFrame:
    """For each row: its id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (the remaining
    bytes) and ``spans`` (the removed runs)."""
    if length % 4 or length < GRAM + 8:
        raise ValueError(f"length must be a multiple of 4 and at least {GRAM + 8}")
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named, lone = docs.where("id is not null"), docs.where("id is null")
    hashes = named.groupBy("id").agg(F.min(F.xxhash64("text")).alias("t"), F.max(F.xxhash64("text")).alias("most"))
    odd = written(hashes.where("t <> most").select("id", "t"), "odd")
    if not odd.isEmpty():
        marked = named.join(odd, "id", "left")
        other = F.col("t").isNotNull() & (F.xxhash64("text") != F.col("t"))
        named, lone = marked.where(~other).select("id", "text"), lone.unionByName(marked.where(other).select("id", "text"))
    found = named.mapInArrow(lambda b: _find(b, length), ANCHOR).repartition("h").sortWithinPartitions("h", "c", "id", "pos")
    decided = written(found.mapInArrow(lambda b: _decide(b, hot), RANGES), "anchors")
    places = decided.where("pos <> -1").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("pos", "start", "size"))).alias("places"))
    # texts always move by a sort-merge join: one exchange of them for both joins, at every size
    cut = named.join(places.hint("merge"), "id").mapInArrow(lambda b: _cut(b, length), "key long, id long, start int, size int, segment binary")
    cut = cut.repartition("key").sortWithinPartitions("key", "id", "start")
    resolved = cut.mapInArrow(lambda b: _resolve(b, length, merge_bytes), "id long, start int, size int")
    ranges = decided.where("pos = -1").select("id", "start", "size").union(resolved)
    ranges = ranges.groupBy("id").agg(F.collect_list(F.struct("start", "size")).alias("ranges"))
    out = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"
    with_ranges = named.join(ranges.hint("merge"), "id", "left").unionByName(lone.withColumn("ranges", F.lit(None).cast("array<struct<start:int,size:int>>")))
    return with_ranges.mapInArrow(_removed, out).withColumnRenamed("id", id_col)


def op2_suffix_merge(spark, sf_dir):
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
