"""WARC archives: payloads that look like records, copies, and byte ranges."""

from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from pagefleet.llm import warc
from pagefleet.session import scratch_dir

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nX-Page-ID: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (5, "http://a", "hello"), (3, "http://b", "hello"), (7, None, None), (8, "u", ""), (9, "u", "x" + RECORD + "y"),
    (10, "u", "WARC/1.1\r\n"), (11, "u", RECORD * 3), (12, "u", "a\r\n\r\nWARC/1.1\r\n" + RECORD), (None, "u", "hello"),
    (3, "http://b", "hello"), (13, "u\r\nX: 1", "é日\r\n\r\n" * 50 + "WARC/1.1\r\nContent-Length: 5\r\n\r\n"),
    (14, "u", "WARC/1.1\r\nContent-Length: 100000\r\n\r\nWARC/1.1\r\n"), (15, "u", "long " * 50_000)]
ROWS += [(100 + i, f"u{i}", f"body {i % 40}") for i in range(120)]


def brute(rows, least=0):
    key = lambda i, b: b if len(b) >= least else (i,)
    first: dict = {}
    data = [(html or "").encode() for _, _, html in rows]
    for i, (page, _, _) in enumerate(rows):
        k = key(i, data[i])
        first[k] = min(first.get(k, (True, 0, 1 << 60)), (page is None, page or 0, i))
    out = []
    for i, (page, _, _) in enumerate(rows):
        none, target, at = first[key(i, data[i])]
        out.append((page, len(data[i]), base64.b32encode(hashlib.sha1(data[i]).digest()).decode(),
                    "response" if at == i else "revisit", None if at == i or none else target))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compression,split,least", [("gzip", "128m", 0), ("none", "3000", 6)])
def test_round_trip(spark, compression, split, least):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, digest string, n long")
    path = warc.write_archives(pages.coalesce(1), scratch_dir(spark, "warc-test"), least=least, compression=compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sorted(map(tuple, warc.read_archives(spark, path).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == brute(ROWS, least)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived_pages(none).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_reads_packed_differently(spark, monkeypatch, compression):
    """Between the two reads of the archives, other partitions are made of the same files."""
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    joined = "spark.sql.adaptive.coalescePartitions.enabled"
    before, reachable = {k: spark.conf.get(k, None) for k in (*names, joined)}, warc.reachable

    def repacked(found):
        kept = reachable(found)
        for k, v in zip(names, ("2500", "1", "64")):
            spark.conf.set(k, v)
        return kept

    monkeypatch.setattr(warc, "reachable", repacked)
    try:
        spark.conf.set(joined, "false")  # several files
        path = warc.write_archives(pages, scratch_dir(spark, "warc-test"), compression=compression)
        for k, v in zip(names, ("128m", "4m", "1")):
            spark.conf.set(k, v)
        got = {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {r[:3] for r in brute(ROWS)}


@pytest.mark.parametrize("plan", ["repartition", "sort", "join", "union"])
def test_pages_of_any_plan(spark, plan):
    """Pages whose order changes with the columns read and with every run of their plan."""
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    if plan == "repartition":
        pages = pages.repartition(7)
    elif plan == "sort":
        pages = pages.orderBy(F.rand())
    elif plan == "join":
        pages = pages.join(spark.createDataFrame([(u,) for u in {r[1] for r in ROWS}], "u string"), F.col("url").eqNullSafe(F.col("u")))
    else:
        pages = pages.where("page_id % 2 = 0").unionByName(pages.where("page_id IS NULL OR page_id % 2 = 1"))
    assert sorted(map(tuple, warc.archived_pages(pages).collect()), key=repr) == brute(ROWS)
