"""Compression of chunks and groups, layout of the compressed stream, and placement in containers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.arrow import lz4
from siltstone.operators.ids import ranged, running_sum
from siltstone.session import prepare, written

CONTAINER_BYTES = 4 << 20
#: Ranges whose tables are put together in a task.
BLOCK = 64


def compress_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, size, comp_size): every chunk on its own, raw if it does not get smaller."""
    prepare(chunks.sparkSession)
    packed = chunks.select("chunk_id", "size", lz4(F.col("content")).alias("p"))
    return packed.select("chunk_id", "size", F.coalesce(F.octet_length("p"), "size").alias("comp_size"))


def compress_groups(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """(grp, chunk_ids, orig_size, comp_size, codec, payload): each group's chunks one after the other, by
    ascending id.  A group has at most cap chunks, so its list is bounded."""
    prepare(chunks.sparkSession)
    rows = groups.select("grp", "chunk_id").join(chunks.select("chunk_id", "content"), "chunk_id")
    joined = rows.groupBy("grp").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"), F.expr("listagg(content) WITHIN GROUP (ORDER BY chunk_id)").alias("raw"))
    packed = joined.withColumn("p", lz4(F.col("raw")))
    return packed.select(
        "grp",
        "chunk_ids",
        F.octet_length("raw").alias("orig_size"),
        F.octet_length(F.coalesce("p", "raw")).alias("comp_size"),
        F.when(F.col("p").isNull(), "raw").otherwise("lz4").alias("codec"),
        F.coalesce("p", "raw").alias("payload"),
    )


def laid_out(compressed: DataFrame) -> DataFrame:
    """Groups numbered by their smallest chunk, with their offset in the compressed stream.  Numbers and
    offsets come from the same ranges: their rows and bytes are summed in one small table."""
    compressed = written(compressed, "compressed")  # compression runs once, not again for the sampling of ranges
    parts = ranged(compressed.select("grp", "comp_size"), ["grp"])
    sums = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum("comp_size").alias("s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n", "s")))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("comp_size").over(within), F.lit(0))
    placed = parts.withColumn("_own", own).join(F.broadcast(base), "_part")
    placed = placed.select("grp", (F.col("_n") + F.col("_at")).alias("group_id"), (F.col("_s") + F.col("_own")).alias("comp_offset"))
    return compressed.join(placed, "grp").select("group_id", "chunk_ids", "orig_size", "comp_size", "comp_offset", "codec", "payload")


def chunk_offsets(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """(grp, chunk_id, size, re_offset): where each chunk is in the stream of all groups, uncompressed."""
    rows = groups.select("grp", "chunk_id").join(chunks.select("chunk_id", "size"), "chunk_id")
    return running_sum(rows, ["grp", "chunk_id"], "size", "re_offset")


def containers(chunks: DataFrame, limit: int = CONTAINER_BYTES) -> DataFrame:
    """(chunk_id, size, container_id, offset): chunks in order, a new container whenever the next one does
    not fit.  The carry is sequential, but what a range does to each fill with which it may start is a small table; the
    tables of ``BLOCK`` ranges are put together in a task, and only those of blocks are followed by the driver."""
    parts = ranged(chunks.select("chunk_id", "size"), ["chunk_id"])
    prepare(chunks.sparkSession)
    ordered = parts.repartition("_part").sortWithinPartitions("_part", "_at")
    ends = ordered.groupBy("_part").applyInArrow(lambda t: _transitions(t, limit), "_part int, entry long, opened long, fill long")
    ends = written(ends.withColumn("block", F.floor(F.col("_part") / BLOCK).cast("int")), "transitions")
    blocks = ends.groupBy("block").applyInArrow(_composed, "block int, entry long, opened long, fill long").collect()
    start, container, fill = [], -1, limit
    tables = _tables((r["block"], r["entry"], r["opened"], r["fill"]) for r in blocks)
    for b in sorted(tables):
        start.append((b, container, fill))
        opened, fill = _passed(tables[b], fill)
        container += opened
    begun = chunks.sparkSession.createDataFrame(start, "block int, c long, f long")
    states = ends.join(F.broadcast(begun), "block").groupBy("block").applyInArrow(_starts, "_part int, c long, f long")  # a row for each range
    rows = ordered.join(F.broadcast(states), "_part")
    return rows.groupBy("_part").applyInArrow(lambda t: _placed(t, limit), "chunk_id long, size int, container_id long, offset long")


def _tables(rows: Iterable[tuple]) -> dict[int, list[tuple[int, int, int]]]:
    out: dict[int, list] = {}
    for p, *row in rows:
        out.setdefault(p, []).append(tuple(row))
    return {p: sorted(t) for p, t in out.items()}


def _passed(table: list[tuple[int, int, int]], fill: int) -> tuple[int, int]:
    """(containers opened, fill at the end) of a range that starts with ``fill``."""
    _, opened, end = max(e for e in table if e[0] <= fill)
    return opened, end if end >= 0 else fill - end - 1


def _by_part(table) -> dict[int, list[tuple[int, int, int]]]:
    return _tables(zip(*(table.column(c).to_pylist() for c in ("_part", "entry", "opened", "fill"))))


def _composed(table):
    """The table of a block of ranges, in the form of a range's own."""
    import pyarrow as pa

    parts = [t for _, t in sorted(_by_part(table).items())]
    entries, before = set(), 0
    for t in parts:  # as long as nothing may have been opened, later ranges tell fills apart, too
        entries |= {max(0, e - before) for e, _, _ in t}
        kept = [-end - 1 for _, _, end in t if end < 0]
        if not kept:
            break
        before += kept[0]
    rows = []
    for entry in sorted(entries):
        opened, fill = 0, entry
        for t in parts:
            more, fill = _passed(t, fill)
            opened += more
        rows.append((entry, opened, fill if opened else -1 - (fill - entry)))
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array([block] * len(rows), pa.int32()), **{n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("entry", "opened", "fill"))}})


def _starts(table):
    """Container and fill with which each range of a block starts."""
    import pyarrow as pa

    container, fill, rows = table.column("c")[0].as_py(), table.column("f")[0].as_py(), []
    for part, t in sorted(_by_part(table).items()):
        rows.append((part, container, fill))
        opened, fill = _passed(t, fill)
        container += opened
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("_part", pa.int32()), ("c", pa.int64()), ("f", pa.int64())))})


def _run(sizes, fill: int, limit: int) -> tuple[list[int], list[int], int]:
    opened, bins, offsets_ = 0, [], []
    for n in sizes:
        if fill + n > limit:
            opened, fill = opened + 1, 0
        bins.append(opened)
        offsets_.append(fill)
        fill += n
    return bins, offsets_, fill


def _transitions(table, limit: int):
    """(range, smallest entry fill, containers opened, fill at the end) for each class of entry fills: they differ only
    in when the first new container opens; a range that never opens one has the fill -1 - its bytes."""
    import numpy as np
    import pyarrow as pa

    table = table.sort_by("_at")
    sizes = table.column("size").to_numpy().astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    opened, end = [0] * (n + 1), [0] * (n + 1)  # from a container that is opened at i
    for i in range(n - 1, -1, -1):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        opened[i], end[i] = (1, int(total[n] - total[i])) if j >= n else (1 + opened[j], end[j])
    # entering with fill f, the first container opens at the first i with f + total[i + 1] > limit
    rows = [(0, 0, -1 - int(total[n]))] if total[n] <= limit else []
    for i in range(n):
        rows.append((max(0, limit - int(total[i + 1]) + 1), opened[i], end[i]))
        if rows[-1][0] == 0:
            break
    part = table.column("_part")[0].as_py()
    columns = [pa.array([part] * len(rows), pa.int32()), *(pa.array([x[k] for x in rows], pa.int64()) for k in range(3))]
    return pa.table(dict(zip(("_part", "entry", "opened", "fill"), columns)))


def _placed(table, limit: int):
    import pyarrow as pa

    table = table.sort_by("_at")
    bins, at, _ = _run(table.column("size").to_pylist(), table.column("f")[0].as_py(), limit)
    c = table.column("c")[0].as_py()
    return pa.table({"chunk_id": table.column("chunk_id"), "size": table.column("size").cast(pa.int32()), "container_id": pa.array([c + b for b in bins], pa.int64()), "offset": pa.array(at, pa.int64())})

