"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: every page is one record, written by Spark's text sink (a task's part file is an archive). Of records with
equal payloads one is a `response`, the others are `revisit` records that carry their payload too and name it.

Reading: archives are split at the magic line, so tasks read ranges of a file and hold one piece at a time. Every
magic is a candidate record start, inside payloads too; from its headers a task computes the offset of the record's
successor. Within a read range, every candidate's chain is followed to where it leaves the range; the places that such chains come in at
are few. Pointer jumping from each file's start keeps those of them that the chain of records reaches: in round k the places
reached are joined with jumps over 2**k ranges. The ranges' own links from there on give the records. Candidates inside payloads are not on
the chain and drop out. The few payloads that hold magic themselves are put together from their pieces.

Defined results: null payloads are empty; rows that repeat a page_id are records of their own (all with the largest page_id
of equal payloads are responses); a null page_id is written without a name and read back as null. Extra columns are
ignored. An empty table gives no records. Bytes after a broken record of a file are not reached.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import drop_at_exit, keyed_join, limit_batches, materialise, release, scratch_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads of at least this many bytes are checked for equals.
REVISIT_FROM = 0
#: Records in an archive, at most.
RECORDS = 50_000

_FIELDS = "type string, page_id long, uri string, digest string, refers_to long, length long"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits in four groups of 40."""
    hexes = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, digest, type and refers_to of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    equal = rows.where(F.octet_length("payload") >= revisit_from).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    equal = materialise(equal, "equal", rows.count())
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return keyed_join(rows, equal, "digest", "left").select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("last")).alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write(found: DataFrame, path: str, per_file: int = RECORDS) -> None:
    """Write records() as archives below path."""
    line = lambda c: F.regexp_replace(F.col(c), r"[\r\n]+", " ")
    head = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.col("type")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        _header("WARC-Target-URI", line("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", F.octet_length("payload").cast("string")),
        F.lit("\r\n"),
    )
    # the sink's line end closes the record
    found.select(F.concat(F.encode(head, "UTF-8"), F.col("payload")).cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def _parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def _page(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _candidates(with_payload: bool):
    """Rows (value, file, block) in file order -> a candidate for every piece after a magic.

    at and next are relative to the block's first piece, whose place in the file the block sizes tell.
    """
    magic = len(MAGIC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, place = None, 0
        for batch in batches:
            out = []
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = value or b""
                if (file, block) != where:
                    where, place = (file, block), 0
                at, size = place - magic, len(value) + magic
                place += size
                cut = value.find(b"\r\n\r\n")
                fields = _parse(value[:cut]) if cut >= 0 else {}
                length = fields.get("content-length", "")
                follows, whole, payload = None, False, None
                if length.isascii() and length.isdigit():
                    follows = at + magic + cut + 4 + int(length) + len(END)
                    body = value[cut + 4 : cut + 4 + int(length)]
                    whole = len(body) == int(length)
                    payload = body if whole else None
                out.append((
                    file, block, size, at, follows, cut + 4, whole, fields.get("warc-type"), _page(fields.get("warc-record-id")), fields.get("warc-target-uri"),
                    digest_of(payload) if whole else None, _page(fields.get("warc-refers-to")), int(length) if follows is not None else None, payload if with_payload else None,
                ))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)

    return run


_SCHEMA = f"file string, block long, size long, at long, next long, head long, whole boolean, {_FIELDS}, payload binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.schema("value string").option("lineSep", MAGIC).text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def reached(candidates: DataFrame) -> DataFrame:
    """(file, at) of the candidates (file, at, next) on the chain from each file's start, by pointer jumping."""
    n = candidates.count()
    jump = candidates.where("next is not null").select("file", "at", "next")
    front = candidates.where("at = 0").select("file", "at")
    done, used = front, []
    while True:
        new = materialise(done.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).join(candidates.select("file", "at"), ["file", "at"], "left_semi"), "reached", n)
        if new.isEmpty():
            release(new, *used)
            return done
        done = done.unionByName(new)
        twice = jump.join(jump.select("file", F.col("at").alias("next"), F.col("next").alias("far")), ["file", "next"]).select("file", "at", F.col("far").alias("next"))
        jump = materialise(twice, "jump", n)
        used.append(jump)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, end, links) -> for every candidate of a read range, where its chain leaves the range; null if it breaks off."""
    for batch in batches:
        out = []
        for file, block, end, links in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            leaves: dict[int, int | None] = {}
            for link in sorted(links, key=lambda x: -x["at"]):  # a successor comes later in the file
                after = link["next"]
                leaves[link["at"]] = after if after >= end else leaves.get(after)
            out += [(file, block, at, to) for at, to in leaves.items()]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), *[pa.int64()] * 3), strict=True)], ["file", "block", "at", "next"])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, links, entries) -> the candidates of a read range that its entries lead to."""
    for batch in batches:
        files, places = [], []
        for file, links, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            after, met = {x["at"]: x["next"] for x in links}, set()
            for at in entries:
                while at in after and at not in met:
                    met.add(at)
                    at = after[at]
            files += [file] * len(met)
            places += met
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64())], ["file", "at"])


def on_chain(placed: DataFrame) -> DataFrame:
    """(file, at) of the candidates (file, block, end, at, next) on the chain from each file's start; a block's links are one row."""
    local = materialise(placed.groupBy("file", "block", "end").agg(F.collect_list(F.struct("at", "next")).alias("links")), "links")
    exits = materialise(local.mapInArrow(_exits, "file string, block long, at long, next long"), "exits")
    targets = exits.where("next is not null").select("file", F.col("next").alias("at")).distinct()
    entries = exits.where("at = 0").unionByName(exits.where("at <> 0").join(targets, ["file", "at"], "left_semi"))
    entries = materialise(entries, "entries")
    kept = reached(entries.select("file", "at", "next")).join(entries.select("file", "at", "block"), ["file", "at"])
    starts = kept.groupBy("file", "block").agg(F.collect_set("at").alias("entries"))
    out = materialise(local.join(starts, ["file", "block"]).select("file", "links", "entries").mapInArrow(_follow, "file string, at long"), "chain")
    release(local, exits, entries)
    return out


def _joined_payload(spark: SparkSession, path: str, broken: DataFrame, base: DataFrame) -> DataFrame:
    """(file, at, payload) of the records whose payloads hold magic: their files are read again and the pieces put together."""
    limit_batches(spark)
    files = broken.select("file").distinct()
    # offsets are counted in file order, before any join
    rows = _pieces(spark, path).mapInArrow(_raw, "file string, block long, at long, value binary").join(files, "file", "left_semi")
    rows = rows.join(base, ["file", "block"]).select("file", (F.col("at") + F.col("base")).alias("at"), "value")
    starts = rows.select("file", "at").join(broken.select("file", "at", F.lit(True).alias("is_start"), "next"), ["file", "at"], "left")
    order = Window.partitionBy("file").orderBy("at")  # offsets only; of files with such records
    owner = starts.withColumn("of", F.last(F.when(F.col("is_start"), F.struct("at", "next")), True).over(order)).where("at < of.next").select("file", "at", F.col("of.at").alias("start"))
    parts = rows.join(owner, ["file", "at"]).groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    whole = F.expr("aggregate(slice(parts, 2, size(parts)), parts[0].value, (s, p) -> concat(s, cast('WARC/1.1\\r\\n' as binary), p.value))")
    return broken.join(parts.select("file", F.col("start").alias("at"), whole.alias("value")), ["file", "at"]).select("file", "at", F.expr("substring(value, cast(head + 1 as int), cast(length as int))").alias("joined"))


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    where, place, magic = None, 0, len(MAGIC)
    for batch in batches:
        out = []
        for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != where:
                where, place = (file, block), 0
            out.append((file, block, place - magic, value))
            place += len(value or b"") + magic
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "block", "at", "value"])


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """file, at and fields of every record of the archives below path; digest is computed from the payload that was read."""
    limit_batches(spark)
    found = materialise(_pieces(spark, path).mapInArrow(_candidates(with_payload), _SCHEMA), "candidates")
    sizes = found.groupBy("file", "block").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each read range
    base = materialise(sizes.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), "size"), "base")
    base = base.withColumn("end", F.col("base") + F.col("size") - len(MAGIC)).drop("size")
    n_base = base.count()
    placed = keyed_join(found, base, ["file", "block"], "inner", n_base).withColumn("at", F.col("at") + F.col("base")).withColumn("next", F.col("next") + F.col("base")).where("at >= 0 and next is not null")
    chain = on_chain(placed.select("file", "block", "end", "at", "next"))
    out = placed.join(chain, ["file", "at"], "left_semi").select("file", "at", "next", "head", "whole", *(x.split()[0] for x in _FIELDS.split(", ")), "payload")
    broken = materialise(out.where("not whole").select("file", "at", "next", "head", "length"), "broken")
    if not broken.isEmpty():
        out = out.join(_joined_payload(spark, path, broken, base), ["file", "at"], "left")
        out = out.withColumn("digest", F.coalesce("digest", base32_sha1(F.col("joined"))))
        out = out.withColumn("payload", F.coalesce("payload", "joined") if with_payload else F.col("payload")).drop("joined")
    return out.drop("next", "head", "whole")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back: page_id and the digest columns."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(records(pages), path)
    drop_at_exit(spark, path)
    return read(spark, path, with_payload=False).select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", F.col("uri").alias("url"))
