"""WARC archives with an index that is merged externally.

Writing: every task writes one archive (a gzip member per record) with its records sorted by URL key
and timestamp: a capture run.  Its index entries name the archive, offset and length of each record.
A payload that an earlier record (smaller page id) has is written as a revisit of it.

Index merge: entries are dealt to ranges of (URL key, timestamp, page id), so a hot host or URL is
cut as well.  A range only puts the entries of each run back into the order in which the run lists them, which is
the order of its archive; the order of keys comes from the k-way loser tree that merges these sorted slices (and raises
an error if a run is not in order).  The result is ordered within ranges and across them.

Reading follows the merged index: since runs are sorted, a range reads each archive front to back.

Archives lie in the shared folder (``file:`` paths through the file system, others through
``pyarrow.fs``), under names of their own for each attempt of a task; only the entries of successful
attempts are in the index, so lost executors leave at most unused files.

Defined results: a null payload counts as empty; a null URL has the key ""; of equal payloads of at
least ``min_bytes``, all rows with the smallest page id (repeated rows) are responses; a null page id
never is the smallest unless all are null; times are in UTC whatever the session's time zone; a null time or one
outside of the years 1 to 9999, which a WARC date cannot express, is the fixed epoch; without a timestamp column the
capture time is the epoch plus the page id in seconds, modulo a thousand years; an empty table gives an empty index;
other columns of the input are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, read_table, shared_dir, written

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = 1577836800  # 2020-01-01 in seconds
#: Years 1 to 9999, in seconds; and a thousand years.
FIRST_SECOND, LAST_SECOND, MILLENNIUM = -62135596800, 253402300799, 31556952000
ENTRY = "key string, ts string, page_id long, run string, offset long, length long, record_type string, payload_digest string"
ENTRY_SCHEMA = pa.schema([(c, pa.int64() if t == "long" else pa.string()) for c, t in (x.split() for x in ENTRY.split(", "))])
#: Index entries that a range of the merge holds, about.
RANGE_ROWS = 20000


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: reversed host, port, path and query, in lower case; without scheme and www."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    out = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{out}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, ts: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """A record, not compressed; ``first`` is the page that a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first is None else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else "urn:no-url"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {ts}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}", f"X-Refers-To-Page-Id: {first}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-Id"),
        "url": fields["WARC-Target-URI"],
        "ts": fields["WARC-Date"],
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("X-Refers-To-Page-Id"),
        "payload": payload if kind == "response" else None,
    }


class Store:
    """Files by URI, on the machine's file system or through pyarrow."""

    def __init__(self, uri: str):
        scheme = uri.partition(":")[0] if ":" in uri else "file"
        if scheme == "file":
            self.fs, self.base = None, re.sub(r"^file:/*", "/", uri)
        else:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(uri)

    def create(self, name: str):
        path = f"{self.base}/{name}"
        if self.fs is not None:
            self.fs.create_dir(os.path.dirname(path))
            return self.fs.open_output_stream(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")

    def read(self, name: str, offset: int, length: int, handles: dict) -> bytes:
        if name not in handles:
            if len(handles) >= 64:
                handles.pop(next(iter(handles))).close()
            path = f"{self.base}/{name}"
            handles[name] = self.fs.open_input_file(path) if self.fs is not None else open(path, "rb")
        f = handles[name]
        f.seek(offset)
        return f.read(length)


def _write(batches: Iterator[pa.RecordBatch], base: str) -> Iterator[pa.RecordBatch]:
    """One archive for the task's sorted rows; its index entries."""
    task = TaskContext.get()
    name = f"run-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
    out, at = None, 0
    for batch in batches:
        entries: dict[str, list] = {c: [] for c in ENTRY_SCHEMA.names}
        for page_id, url, key, ts, payload, digest, first in zip(*(batch.column(c) for c in ("page_id", "url", "key", "ts", "payload", "digest", "first"))):
            page, refers = page_id.as_py(), first.as_py()
            sha = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
            packer = zlib.compressobj(4, zlib.DEFLATED, 31)
            raw = record(page, url.as_py(), ts.as_py(), payload.as_py(), sha, refers)
            member = packer.compress(raw) + packer.flush()
            if out is None:
                out = Store(base).create(name)
            out.write(member)
            for c, v in zip(entries, (key.as_py(), ts.as_py(), page, name, at, len(member), "response" if refers is None else "revisit", sha)):
                entries[c].append(v)
            at += len(member)
        if entries["key"]:
            yield pa.RecordBatch.from_pydict(entries, schema=ENTRY_SCHEMA)
    if out is not None:
        out.close()


def _url_keys(urls: pa.Array) -> pa.Array:
    return pa.array([url_key(u) for u in urls.to_pylist()], pa.string())


def _utc(seconds: Column) -> Column:
    """A WARC date from seconds, by calendar arithmetic alone, so that the session's time zone has no part in it."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    clock = F.pmod(seconds, F.lit(86400))
    parts = (F.floor(clock / 3600), F.floor(clock / 60) % 60, clock % 60)
    return F.concat(F.lpad(F.date_format(day, "yyyy"), 4, "0"), F.date_format(day, "-MM-dd"), F.lit("T"), F.concat_ws(":", *(F.lpad(x.cast("string"), 2, "0") for x in parts)), F.lit("Z"))


def write_archive(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts_col: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes the archives under ``base``; returns the runs' index entries."""
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    id_ = F.col(id_col).cast("long")
    seconds = F.unix_seconds(F.col(ts_col).cast("timestamp")) if ts_col else F.lit(EPOCH) + F.pmod(F.coalesce(id_, F.lit(0)), F.lit(MILLENNIUM))
    rows = pages.select(
        id_.alias("page_id"),
        F.col(url_col).alias("url"),
        _utc(F.when(seconds.between(FIRST_SECOND, LAST_SECOND), seconds).otherwise(EPOCH)).alias("ts"),
        payload.alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    firsts = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    runs = rows.join(firsts, "digest", "left").withColumn("first", first).withColumn("key", F.arrow_udf(_url_keys, "string")("url")).sortWithinPartitions("key", "ts", "page_id")
    return written(runs.mapInArrow(lambda b: _write(b, base), ENTRY), "cdx-runs")


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so that the next
    smallest item takes one match per level."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        k = max(1, len(self.runs))
        self.head = [self._next(i) for i in range(len(self.runs))] or [None]
        self.k = k
        self.loser = [-1] * k
        for i in range(k):
            self._replay(i)

    def _next(self, i: int):
        return next(self.runs[i], None)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.loser[node]
            if other == -1:
                self.loser[node] = winner
                return  # the match waits for its other side
            if self._less(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self):
        while True:
            w = self.loser[0]
            if self.head[w] is None:
                return
            yield self.head[w]
            self.head[w] = self._next(w)
            self._replay(w)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's entries, which come run by run in the order of the run, merged by a loser tree."""
    got = [b for b in batches if len(b)]
    if not got:
        return
    table = pa.Table.from_batches(got)
    cols = {c: table.column(c).to_pylist() for c in table.column_names}
    runs: dict[str, list[int]] = {}
    for i, r in enumerate(cols["run"]):
        runs.setdefault(r, []).append(i)

    def listed(name: str, rows: list[int]) -> Iterator[tuple]:
        last = None
        for i in rows:
            own = (cols["key"][i], cols["ts"][i], cols["page_id"][i] is not None, cols["page_id"][i] or 0)
            if last is not None and own < last:
                raise ValueError(f"{name} is not in order")
            last = own
            yield (*own, name, cols["offset"][i], i)

    merged = [x[-1] for x in LoserTree(listed(name, rows) for name, rows in runs.items())]
    yield from table.take(pa.array(merged, pa.int64())).combine_chunks().to_batches(max_chunksize=4096)


def merge_index(entries: DataFrame) -> DataFrame:
    """Capture histories: the entries of all runs in the order of URL key, timestamp and page id."""
    bounded_batches(entries.sparkSession)
    n = max(8, -(-entries.count() // RANGE_ROWS))
    ranged = entries.repartitionByRange(n, "key", "ts", "page_id", "run", "offset").sortWithinPartitions("run", "offset")
    return ranged.mapInArrow(_merge, ENTRY)


def _read(batches: Iterator[pa.RecordBatch], base: str, payload: bool) -> Iterator[pa.RecordBatch]:
    store, handles = Store(base), {}
    names = ["page_id", "url", "ts", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            rows = []
            for run, offset, length in zip(*(part.column(c).to_pylist() for c in ("run", "offset", "length"))):
                got = parse(zlib.decompress(store.read(run, offset, length, handles), wbits=31))
                rows.append(got if payload else got | {"payload": None})
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
    for f in handles.values():
        f.close()


def read_archive(index: DataFrame, base: str, payload: bool = False) -> DataFrame:
    """The records that ``index`` lists, parsed and checked, in its order."""
    bounded_batches(index.sparkSession)
    return index.mapInArrow(lambda b: _read(b, base, payload), "page_id long, url string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op9_warc(spark, sf_dir):
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = merge_index(write_archive(read_table(spark, sf_dir, "pages"), base))
    return read_archive(index, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
