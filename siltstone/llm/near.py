"""Near-duplicate join on the Jaccard similarity of word n-grams, with Bayesian candidate pruning.

1. Equal word sequences are one class from the start; only its smallest id, the representative, goes on.
2. MinHash values in bands give buckets of representatives; of buckets with the same members one is kept.  Inside
   a bucket, MinHash values are compared 16 at a time, and a pair is dropped once the posterior probability
   (uniform prior) that its similarity reaches the threshold is below ``tolerance``.  Pairs are never
   written: a bucket only gives, for each member, the smallest one that surviving pairs connect it with, and pairs that
   are connected already are not compared.  A bucket of more than a 16th of ``bucket`` members is cut into
   blocks of at most ``bucket`` by a hash of the id, and pairs of blocks are compared, so that no task sees all of it.
3. The connected components of these links are groups.  Every pair that survived is inside one of them; documents
   that share a band by chance, or some boilerplate, are not.
4. A group is cut into blocks as well; in pairs of blocks, pairs that share a band and survive the same pruning
   are verified exactly on their n-gram sets.  A block pair gives each document's number of links and its local
   component.  Counting all links of a group of n different near copies takes n^2 / 2 comparisons by
   definition; a text is read once for each block of its group.

At a similarity of 0.8 a pair shares none of 24 bands of 4 values with a probability of 3e-6, and less
above it; ``tolerance`` is 1e-6.

Defined results: a text with fewer words than the n-gram has, but some, is one n-gram; a null text or one
without words has no links and is its own class; rows with equal ids are one document; a null id
gets a null class, and its links are not counted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, mix64, read_table, seeded, steps, text_bytes, written
from siltstone.llm.components import components
from siltstone.llm.words import Words

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
CHUNK = 16
_a = (seeded(51, HASHES) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
_b = (seeded(52, HASHES) >> np.uint64(20)).astype(np.uint32)
_band_salt = seeded(53, BANDS * (ROWS + 1)).reshape(BANDS, ROWS + 1)


def minhash(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values of each text that has shingles (rows), from its place in ``first``."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.zeros((len(starts), HASHES), np.uint32)
    if len(starts):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(x * _a[k] + _b[k], starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    s = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    return mix64((s * _band_salt[None, :, :ROWS]).sum(axis=2) + _band_salt[None, :, ROWS])


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each multiple n of CHUNK: the fewest equal values of n with which the posterior probability
    of a similarity of ``threshold`` or more is at least ``tolerance`` (uniform prior)."""
    out = []
    for n in range(CHUNK, HASHES + 1, CHUNK):
        below, m = 0.0, 0
        while True:  # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance or m == n:
                break
            m += 1
        out.append(m)
    return out


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """id, two digests of the word sequence (null without words), bytes, and the MinHash values."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids = batch.column("id")
        for i, j in steps(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            shingles, first = words.shingles(size)
            has = np.diff(first) > 0
            digest = np.zeros((2, j - i), np.uint64)
            values = np.zeros((j - i, HASHES), np.uint32)
            if has.any():
                place = (np.arange(len(words), dtype=np.uint64) - np.repeat(words.first[:-1], np.diff(words.first)).astype(np.uint64))
                starts = words.first[:-1][has]
                for k, salt in enumerate(seeded(54, 2)):
                    digest[k, has] = np.add.reduceat(mix64(words.hash + (place + np.uint64(1)) * salt), starts)
                values[has] = minhash(shingles, first)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(i, j - i),
                    *(pa.array(d.view(np.int64), mask=~has) for d in digest),
                    pa.array(np.diff(offsets[i : j + 1])),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * HASHES), j - i, [None, pa.py_buffer(values)]).cast(pa.binary()),
                ],
                names=["id", "d1", "d2", "bytes", "signature"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key) for each band."""
    for batch in batches:
        keys = band_keys(_signatures(batch.column("signature")))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS)), pa.array(keys.ravel().view(np.int64))], names=["id", "key"])


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _survivors(signature: np.ndarray, i: np.ndarray, j: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are left after comparing MinHash values part by part."""
    matches = np.zeros(len(i), np.int64)
    for k, least in enumerate(need):
        part = slice(k * CHUNK, (k + 1) * CHUNK)
        for c in range(0, len(i), 1 << 18):
            own = slice(c, c + (1 << 18))
            matches[own] += (signature[i[own], part] == signature[j[own], part]).sum(axis=1)
        ok = matches >= least
        i, j, matches = i[ok], j[ok], matches[ok]
    return i, j


def _connect(table: pa.Table, threshold: float, tolerance: float) -> pa.Table:
    """(id, root) for the members of a block pair, or of several small buckets, that surviving pairs connect."""
    table = table.sort_by([("key", "ascending"), ("id", "ascending")])
    ids, key, side = (table.column(c).to_numpy() for c in ("id", "key", "side"))
    across = table.column("x")[0].as_py() != table.column("y")[0].as_py()
    signature = _signatures(table.column("signature"))
    need = least_matches(threshold, tolerance)
    n = len(ids)
    root = np.arange(n)
    end = np.searchsorted(key, key, "right")  # of each one's bucket
    lo, rows = 0, 16
    while lo < n:  # few rows first: they connect most of a group, whose pairs need not be compared any more
        hi = min(n, lo + rows)
        size = end[lo:hi] - np.arange(lo, hi) - 1
        while hi > lo + 1 and size[: hi - lo].sum() > 1 << 22:
            hi = lo + max(1, (hi - lo) // 2)
        size = size[: hi - lo]
        i = np.repeat(np.arange(lo, hi), size)
        j = i + 1 + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ok = root[i] != root[j]
        if across:
            ok &= side[i] != side[j]
        i, j = _survivors(signature, i[ok], j[ok], need)
        if len(i):
            root = local_roots(n, np.concatenate([root, i]), np.concatenate([np.arange(n), j]))
        lo, rows = hi, 2 * rows
    moved = root != np.arange(n)
    return pa.table({"id": ids[moved], "root": ids[root[moved]]})


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted within each text, and the place of each text's first."""
    shingles, first = words.shingles(size)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((shingles, row))
    s, r = shingles[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[new], np.searchsorted(r[new], np.arange(len(first)), "left")


def intersections(sets: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int = 32 << 20) -> np.ndarray:
    """Sizes of the intersections of the sets of pairs, by bit sets over the shingles that two of them share."""
    rows, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
    size = np.diff(first)[rows]
    at = np.repeat(first[:-1][rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
    _, ids, count = np.unique(sets[at], return_inverse=True, return_counts=True)
    shared = count > 1
    width = int(shared.sum())
    if len(rows) * width // 8 > limit and len(i) > 1:
        half = len(i) // 2
        return np.concatenate([intersections(sets, first, i[:half], j[:half], limit), intersections(sets, first, i[half:], j[half:], limit)])
    new_id = np.cumsum(shared) - 1
    keep = shared[ids]
    column, owner = new_id[ids[keep]], np.repeat(np.arange(len(rows)), size)[keep]
    words = width // 64 + 1
    bits = np.zeros(len(rows) * words, np.uint64)
    np.bitwise_or.at(bits, owner * words + column // 64, np.uint64(1) << (column % 64).astype(np.uint64))
    bits = bits.reshape(len(rows), words)
    a, b = inverse[: len(i)], inverse[len(i) :]
    out = np.zeros(len(i), np.int64)
    step = max(1, (1 << 21) // words)
    for k in range(0, len(i), step):
        out[k : k + step] = np.bitwise_count(bits[a[k : k + step]] & bits[b[k : k + step]]).sum(axis=1)
    return out


def similar_pairs(sets: np.ndarray, first: np.ndarray, side: np.ndarray | None, threshold: float, tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j with the similarity, a few rows at a time.  With ``side``, only pairs of
    different sides count."""
    n = len(first) - 1
    size = np.diff(first)
    signature = minhash(sets, first)
    keys = band_keys(signature)
    need = least_matches(threshold, tolerance)
    rows = max(1, (1 << 22) // max(1, n))
    for lo in range(0, n, rows):
        hi = min(n, lo + rows)
        mask = np.zeros((hi - lo, n), bool)
        for band in range(BANDS):
            mask |= keys[lo:hi, band][:, None] == keys[:, band][None, :]
        if side is not None:
            mask &= side[lo:hi][:, None] != side[None, :]
        mask &= np.arange(lo, hi)[:, None] < np.arange(n)[None, :]
        i, j = np.nonzero(mask)
        i, j = _survivors(signature, i + lo, j, need)
        if len(i):
            both = intersections(sets, first, i, j)
            ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
            yield i[ok], j[ok]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(table: pa.Table, size: int, threshold: float, tolerance: float) -> pa.Table:
    table = table.sort_by([("id", "ascending"), ("text", "ascending")])
    ids = table.column("id").to_numpy()
    table = table.take(pa.array(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))))
    data, offsets = text_bytes(table.column("text"))
    ids = table.column("id").to_numpy()
    weight = table.column("copies").to_numpy()
    across = table.column("x")[0].as_py() != table.column("y")[0].as_py()
    side = table.column("side").to_numpy() if across else None
    sets, first = shingle_sets(Words(data, offsets), size)
    links = np.zeros(len(ids), np.int64)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    root = np.arange(len(ids))
    for i, j in similar_pairs(sets, first, side, threshold, tolerance):
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        found_i, found_j = [root, i], [np.arange(len(ids)), j]  # earlier pairs are in the roots
        root = local_roots(len(ids), np.concatenate(found_i), np.concatenate(found_j))
    keep = links > 0
    return pa.table({"id": ids[keep], "root": ids[root[keep]], "links": links[keep]})


def _groups(reps: DataFrame, threshold: float, tolerance: float, bucket: int) -> DataFrame:
    """(id, component) of the representatives that surviving pairs connect."""
    spark = reps.sparkSession
    keyed = reps.select("rep", "signature").mapInArrow(_bands, "id long, key long")
    # buckets with the same members are one
    shared = keyed.groupBy("key").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("s1"), F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 24)).alias("s2")).where("n > 1")
    shared = written(shared.groupBy("m", "n", "s1", "s2").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    small = 64
    bins = max(1, -(-(shared.where(F.col("n") <= small).agg(F.sum("n")).first()[0] or 0) // 512))
    most = F.least(F.greatest(F.ceil(F.col("n") / 8), F.lit(bucket // 16)), F.lit(bucket))
    blocks = F.ceil(F.col("n") / most).cast("int")
    # sort-merge joins at every size, so that a small test shuffles what a large run will
    member = keyed.join(shared.hint("merge"), "key").select("id", "key", "n", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"))
    rows = member.join(reps.select(F.col("rep").alias("id"), "signature").hint("merge"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "id",
        "key",
        "signature",
        F.when(F.col("n") <= small, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("key")).alias("part"),
        F.least("own", "other").alias("x"),
        F.greatest("own", "other").alias("y"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    found = rows.groupBy("part", "x", "y").applyInArrow(lambda t: _connect(t, threshold, tolerance), "id long, root long")
    bounded_batches(spark)
    return components(found, "id", "root")


def near_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 256, bucket: int = 8192
) -> DataFrame:
    """For each row of ``df``: its id, ``class_id`` (the smallest id of its near-duplicate class) and
    ``n_links`` (documents with at least the similarity, copies included)."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = written(docs.mapInArrow(lambda b: _sketch(b, size), "id long, d1 long, d2 long, bytes long, signature binary"), "sketch")
    # copies of a text have equal values; only representatives go on
    reps = written(
        sketch.where("id is not null and d1 is not null")
        .groupBy("d1", "d2")
        .agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.first("bytes").alias("bytes"), F.min("signature").alias("signature")),
        "reps",
    )
    coarse = _groups(reps, threshold, tolerance, bucket)
    one = reps.groupBy(F.col("rep").alias("id")).agg(F.max("copies").alias("copies"), F.max("bytes").alias("bytes"))
    member = written(one.join(coarse, "id"), "members")
    total = member.count()
    group = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all")).where("n > 1")
    per = F.least(F.greatest(F.ceil(F.col("n") / 16), F.lit(block)), F.lit(32 * block))
    blocks = group.select("component", F.greatest(F.ceil(F.col("n") / per), F.ceil(F.col("all") / (8 << 20))).cast("int").alias("blocks"))
    bins = max(1, -(-total // block))
    member = member.join(blocks, "component").select(
        "id",
        "copies",
        "blocks",
        F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"),
        # small groups are compared several at a time: pairs need a band in common anyway
        F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("part"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = (
        docs.where("id is not null")
        .join(member.hint("merge"), "id")
        .select("id", "copies", "text", "own", "part", other)
        .select("id", "copies", "text", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    )
    compared = written(
        rows.groupBy("part", "x", "y").applyInArrow(lambda t: _compare(t, size, threshold, tolerance), "id long, root long, links long"),
        "links",
    )
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(compared, "id", "root")
    known = reps.select("d1", "d2", "rep", "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("d1", "d2", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return sketch.select("id", "d1", "d2").join(known.hint("merge"), ["d1", "d2"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
    )


def op5_jaccard_join(spark, sf_dir):
    return near_classes(read_table(spark, sf_dir, "documents"))
