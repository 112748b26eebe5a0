import base64
import gzip
import hashlib
import random
from datetime import datetime, timedelta

import pytest

from siltstone.llm.common import shared_dir
from siltstone.llm.warc import ENTRY, LoserTree, Store, merge_index, op9_warc, parse, read_archive, record, sha1_base32, url_key, write_archive


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html.encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    got = {r.page_id: tuple(r)[1:] for r in op9_warc(spark, sf).collect()}
    assert got == {k: (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first[h] == k else "revisit", None if first[h] == k else first[h]) for k, h in pages.items()}


def test_loser_tree():
    rng = random.Random(1)
    for k in range(12):
        runs = [sorted((rng.randrange(30), i) for _ in range(rng.randrange(9))) for i in range(k)]
        assert list(LoserTree(map(iter, runs))) == sorted(x for r in runs for x in r)


def test_history_is_ordered_and_read_back(spark):
    rng = random.Random(2)
    rows = [(k, f"http://h{rng.randrange(3)}.example.com/{rng.randrange(4)}", f"<p>{rng.randrange(40)}</p>" * rng.randrange(3), k % 2 == 0) for k in range(300)]
    rows += [(301, None, None, True), (302, "http://x y\n/", "", True), (5, rows[5][1], rows[5][2], True), (None, "http://a.b", "null id", True)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, DIGEST boolean").repartition(7)
    base = shared_dir(spark) + "/warc-test"
    index = merge_index(write_archive(pages, base))
    keys = [(r.key, r.ts, -1 if r.page_id is None else r.page_id) for r in index.collect()]
    assert keys == sorted(keys) and len(keys) == len(rows)
    got = read_archive(index, base, payload=True).collect()
    want = {}
    for k, _, html, _ in rows:
        if k is not None:
            want[html or ""] = min(k, want.get(html or "", k))
    for r in got:
        if r.page_id is None:
            continue
        html = next(h for k, _, h, _ in rows if k == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html), sha1_base32(html.encode()))
        if want[html] == r.page_id:
            assert r.record_type == "response" and bytes(r.payload).decode() == html and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.refers_to == want[html]
    again = merge_index(write_archive(pages, base + "-min", min_bytes=6))
    kinds = {(r.record_type, r.payload_bytes >= 6) for r in read_archive(again, base + "-min").collect()}
    assert ("revisit", False) not in kinds and ("revisit", True) in kinds
    assert merge_index(write_archive(pages.limit(0), base + "-none")).count() == 0


def test_times(spark):
    """Large ids, dates out of range and other time zones."""
    ids = [1, 300_000_000_000, 2**63 - 1, -5, None]
    pages = spark.createDataFrame([(k, "http://a.b/", f"page {k}") for k in ids], "page_id long, url string, html string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", z)
            index = merge_index(write_archive(pages, f"{shared_dir(spark)}/warc-times-{z[:2]}"))
            got = {r.page_id: r.ts for r in index.collect()}
            assert got[1] == "2020-01-01T00:00:01Z" and got[None] == "2020-01-01T00:00:00Z" and set(got) == set(ids)
            for k in ids[:-1]:
                second = k % (1000 * 31556952)
                assert got[k] == (datetime(2020, 1, 1) + timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%SZ")
            assert [r.ts for r in index.collect()] == sorted(got.values())
            stamped = spark.sql("SELECT 1L AS page_id, 'u' AS url, 'x' AS html, timestamp_seconds(300000000000) AS t UNION ALL SELECT 2L, 'u', 'x', timestamp_seconds(-1) UNION ALL SELECT 3L, 'u', 'x', null")
            got = {r.page_id: r.ts for r in merge_index(write_archive(stamped, f"{shared_dir(spark)}/warc-stamps-{z[:2]}", ts_col="t")).collect()}
            assert got == {1: "2020-01-01T00:00:00Z", 2: "1969-12-31T23:59:59Z", 3: "2020-01-01T00:00:00Z"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_very_long_payload(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "x" * (3 << 20)), (2, "http://a.b/", "x" * (3 << 20)), (3, "http://a.b/" + "u" * 100000, "é" * (1 << 20))], "page_id long, url string, html string")
    base = shared_dir(spark) + "/warc-long"
    got = {r.page_id: r for r in read_archive(merge_index(write_archive(pages, base)), base, payload=True).collect()}
    assert (got[1].payload_bytes, got[2].refers_to, got[3].payload_bytes) == (3 << 20, 1, 2 << 20)
    assert bytes(got[3].payload).decode() == "é" * (1 << 20) and got[3].url.endswith("u" * 100000)


def test_runs_out_of_order_are_refused(spark):
    rows = [(f"{1000 - k}", "2020", k, "r", k, 1, "response", "x") for k in range(500)]
    with pytest.raises(Exception, match="not in order"):
        merge_index(spark.createDataFrame(rows, ENTRY)).collect()


def test_records_and_files(tmp_path):
    raw = record(3, "http://a.b/c", "2020-01-01T00:00:03Z", b"\r\n\r\nWARC/1.1", sha1_base32(b"\r\n\r\nWARC/1.1"), None)
    assert parse(raw)["payload"] == b"\r\n\r\nWARC/1.1" and parse(raw)["page_id"] == 3
    store = Store(f"file://{tmp_path}")
    with store.create("d/x") as f:
        f.write(gzip.compress(raw))
    assert gzip.decompress(store.read("d/x", 0, 10**6, {})) == raw
    assert url_key("https://WWW.Ex.org:8080/A?b") == "org,ex:8080)/a?b" and url_key(None) == ""
