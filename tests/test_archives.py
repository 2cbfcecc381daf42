"""Archives in ranges of gzip members."""

import gzip
import random
import tracemalloc
import zlib

import pytest

from textlake.sources import archives as A
from textlake.sources import documents as S


def page(k, n=60):
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + f"<title>T{k}</title><p>{'word%d ' % k * n}".encode()


def loaded(spark, path, **options):
    A.register(spark)
    return spark.read.format("textlake_warc").options(path=str(path), **options).load()


@pytest.mark.parametrize("range_bytes", [300, 1000, 1 << 20])
def test_every_record_once_whatever_the_ranges(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    members = [A.member(f"u{k}", page(k, rng.randint(1, 400)) + rng.randbytes(rng.choice([0, 500])), rng.choice(["response", "request"])) for k in range(60)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    df = loaded(spark, tmp_path, range_bytes=range_bytes)
    assert df.rdd.getNumPartitions() == -(-sum(map(len, members)) // range_bytes)
    got = sorted(df.collect(), key=lambda r: r.member)
    want = [next(A.records(iter([gzip.decompress(m)]))) for m in members]
    assert [(r.kind, r.url, r.date, r.length, bytes(r.http)) for r in got] == want
    assert [r.member for r in got] == [sum(map(len, members[:k])) for k in range(60)]
    assert loaded(spark, tmp_path, kind="request").count() == sum(w[0] == "request" for w in want)


def test_a_broken_member_loses_only_itself(spark, tmp_path):
    members = [bytearray(A.member(f"u{k}", page(k))) for k in range(9)]
    members[3][40:60] = b"\0" * 20
    members[8] = members[8][:-20]
    # the payload of one holds what looks like a member, and one holds no record
    members[5] = A.member("u5", page(5) + zlib.compress(b"x") + A.MAGIC + b"no member")
    members[6] = gzip.compress(b"no record at all")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    for size in (200, 1 << 20):
        assert sorted(r.url for r in loaded(spark, tmp_path, range_bytes=size).collect()) == ["u0", "u1", "u2", "u4", "u5", "u7"]


def test_memory_is_bounded(tmp_path):
    path = tmp_path / "a.warc.gz"
    with path.open("wb") as f:
        for k in range(40):
            f.write(A.member(f"u{k}", bytes(4 << 20), "metadata" if k % 2 else "response"))
        f.write(A.member("long", bytes(100 << 20)))
    tracemalloc.start()
    with path.open("rb") as f:
        rows = A.batches(A.read_range(f, "a", 0, path.stat().st_size, most=8 << 20), 1 << 20)
        seen = [(u, n, x is None) for b in rows for u, n, x in zip(*(b.column(i).to_pylist() for i in (4, 6, 7)), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen[:-1] == [(f"u{k}", 4 << 20, False) for k in range(40)] and seen[-1] == ("long", 100 << 20, True)
    assert peak < 40 << 20  # of 260 MB inflated


def test_written_archives_read_back(spark, tmp_path):
    A.register(spark)
    rows = [(f"u{k}", page(k, 30), "response" if k % 5 else "request") for k in range(50)] + [("x", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n" + b"p" * 400, "response")]
    out = spark.createDataFrame(rows, "url string, http binary, kind string").repartition(3)
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        out.write.format("textlake_warc").mode(mode).save(str(tmp_path / "w"))
        assert sorted((r.url, bytes(r.http), r.kind) for r in loaded(spark, tmp_path / "w").collect()) == sorted(rows * times)
    assert [p.name for p in (tmp_path / "w").iterdir() if p.is_dir()] == []
    docs = S.from_common_crawl(spark, str(tmp_path / "w")).collect()
    assert sorted(r.url for r in docs) == sorted(u for u, _, k in rows[:-1] if k == "response") and all(r.metadata["file"].endswith(".warc.gz") for r in docs)
    assert loaded(spark, tmp_path / "w" / "*none*").count() == 0
