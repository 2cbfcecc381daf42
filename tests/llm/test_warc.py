"""WARC round trips with tiny read ranges and magic inside payloads."""

import base64
import hashlib

from textlake.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_round_trip(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = [(1, "u1", "same"), (2, "u\r\n2", "same"), (3, None, None), (4, "u4", f"x{FAKE}y"), (5, "u5", ""), (6, "u6", "WARC/1.1\r\n" * 3), (7, "u7", "é" * 200 + "WARC/1.1\r\n"), (None, "u8", "p"), (9, "u9", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n"), (10, "a", "same")]
        rows += [(i, "q", f"t{i % 7}" * (i % 30)) for i in range(11, 45)]
        pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
        out = {r.page_id: r for r in warc.round_trip(pages.repartition(2)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(out) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), i if i is not None else -1)
    for i, _, h in rows:
        data, r = (h or "").encode(), out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        head = last[h or ""] in (i, -1)
        assert (r.record_type, r.refers_to) == (("response", None) if head else ("revisit", last[h or ""]))
    assert out[3].url is None and out[2].url == "u 2"


def test_payloads_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", f"a{FAKE}"), (2, "v", "b")], "page_id long, url string, html string")
    warc.write(warc.records(pages), f"file://{tmp_path}/w")
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, f"file://{tmp_path}/w").collect()} == {1: f"a{FAKE}", 2: "b"}
    assert warc.round_trip(pages.limit(0)).count() == 0
