"""MinHash near-duplicates by an LSH forest.

A document's set holds the hashes of its distinct shingles of width words (A-Z lower-cased), 3 unless asked for; with fewer words
the whole sequence is one shingle. Documents with equal sets are one class. Classes get a MinHash signature,
and the forest orders them by several permutations of it (the trees). In every tree, a region is the classes that share a
prefix of the order: it is deepened where it is crowded, so each ends with at most REGION classes, which are those
with the longest common prefixes. Candidates come in three rounds: first neighbours in the sorted order
and every crowded region's hub, then each class's best match in other components of its regions, then all members of
a region that are in different components still; signatures must agree. Links are confirmed on full sets. Work per class and tree is bounded by REGION.

What that bound leaves out is made up for last: classes that meet in regions crowded at the first depth are a family, and in
every family with more than one component, the classes outside its largest component are joined with all of its classes by a prefix filter:
of each set, only its rarest shingles (by a table of bucket loads), so many that two sets that are alike share one, meet, in
cells of about CELL rows a side; pairs whose sizes, places and signature bits allow a link are confirmed on full sets.
So pairs of one family are no candidates of the third round.

A set that more than HOT rows share is given its component by broadcast (there are at most rows / HOT such sets), rows without a set need none,
and only the others are joined, so no key of that join has more than HOT rows.

Defined results: null or blank text -> n_shingles 0, linked with nothing, component_id its own doc_id. Rows that
repeat a doc_id are one document: they share a component (n_shingles is of the row). A null doc_id gets
component_id null and is kept, but takes no part in linking. Extra columns are ignored. An empty table gives no rows.
keep_one() lets rows of null id take part, as a document for each distinct text, and keeps one row of each document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .store import keyed_join, limit_batches, materialise, release
from .words import chunks, grams, hashed, mix

VALUES, TREES, REGION = 128, 32, 192
#: Rows from which a set is common.
HOT = 50_000
#: Rows on each side of a cell of the last round, buckets of shingles in its order by rarity, parts of every token's rows.
CELL, BUCKETS, SALTS = 2_048, 1 << 18, 8
#: Depths at which a crowded region is cut; the last is the whole signature.
DEPTHS = (4, 8, 14, 24, 40, 128)
#: Trees whose neighbours and hubs make the first round of candidates.
FIRST_TREES = 4
#: How far below the threshold the estimated similarity of a pair of the later rounds may be: a true pair is lost with under 1e-10.
SLACK = 0.24

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_ORDERS = [np.concatenate([own := np.arange(t * 4, t * 4 + 4), _rng.permutation(np.setdiff1d(np.arange(VALUES), own))]) for t in range(TREES)]


def shingle_sets(texts: list[bytes], width: int = 3) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for i, j in chunks(texts):
        _, _, _, value, first = hashed(texts[i:j], lower=True)
        long = grams(value, width)
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if b - a >= width:
                yield np.unique(long[a : b - width + 1])
            elif b > a:
                yield mix(grams(value[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 512):
        np.minimum(out, (h[None, i : i + 512] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for s in shingle_sets(_utf8(batch.column(1)), width):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(_utf8(batch.column(1)), width)], pa.binary())], ["doc_id", "shingles"])

    return run


def _regions(depth: int):
    """Rows (doc, tree) -> the tree's prefix of that depth as a key, and the order below it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, VALUES)
            mask = batch.column(2).to_numpy(zero_copy_only=False)
            for t in range(TREES):
                of = np.flatnonzero((mask >> t) & 1)
                if not len(of):
                    continue
                order = _ORDERS[t]
                key = np.full(len(of), t * 1000 + depth, np.uint64)
                for v in order[:depth]:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[of, v])
                below = np.zeros(len(of), np.uint64) if depth + 2 > VALUES else (sig[of, order[depth]].astype(np.uint64) << np.uint64(32)) | sig[of, order[depth + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc[of]), pa.array(np.full(len(of), t, np.int32)), pa.array((below >> np.uint64(1)).astype(np.int64))], ["region", "doc", "tree", "below"])

    return emit


def _across(threshold: float, best: bool):
    """Rows (region, doc, comp, family, sig), sorted by region -> pairs from different components whose signatures agree; best: each document's
    best only, else all but those of one family."""

    def pairs(doc: np.ndarray, comp: np.ndarray, family: np.ndarray, sig: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(len(doc)):
            other = np.flatnonzero(comp != comp[i]) if best else i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & (family[i + 1 :] != family[i]))
            if len(other):
                alike = (sig[other] == sig[i]).mean(axis=1)
                other = other[alike >= threshold] if not best else other[alike >= max(threshold, alike.max())][:1]
                yield np.stack([np.minimum(doc[i], doc[other]), np.maximum(doc[i], doc[other])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in _then_none(batches):
            if batch is None:
                ready, rest = rest, None
            else:
                now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)] + [np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(-1, VALUES)]
                if rest is not None:
                    now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
                cut = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
                ready, rest = [x[:cut] for x in now], [x[cut:] for x in now]
            if ready is None or not len(ready[0]):
                continue
            edge = np.flatnonzero(np.diff(ready[0])) + 1
            found = [p for a, b in zip([0, *edge], [*edge, len(ready[0])], strict=True) for p in pairs(*(x[a:b] for x in ready[1:]))]
            if found:
                both = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return run


def _then_none(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingles) -> how many of them fall into each bucket."""
    held = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for s in batch.column(0).to_pylist():
            held += np.bincount((np.frombuffer(s, np.uint64) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(held)
    for i in range(0, len(at), 1 << 14):
        part = at[i : i + (1 << 14)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part])], ["bucket", "held"])


def _prefixes(grade: np.ndarray, percent: int):
    """Rows (family, doc, comp, rest, shingles) -> a row for each of the set's rarest shingles, enough that two sets that are alike share one:
    their places in the order by rarity, and a bit of every signature value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, doc, comp, rest, sets = (batch.column(k).to_pylist() for k in range(5))
            for k, own in enumerate(np.frombuffer(s, np.uint64) for s in sets):
                n = len(own)
                first = np.lexsort((own, grade[(own % np.uint64(BUCKETS)).astype(np.int64)]))[: n - -(-percent * n // 100) + 1]
                bits = np.packbits((signature(own) * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8)).view(np.int64)
                same = [np.full(len(first), x, np.int64) for x in (family[k], doc[k], comp[k], n, bits[0], bits[1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[first].view(np.int64)), pa.array(np.arange(len(first))), pa.array(np.full(len(first), rest[k], bool)), *map(pa.array, same)],
                    ["shingle", "place", "rest", "family", "doc", "comp", "size", "bits", "more_bits"],
                )

    return run


def bit_slack(percent: int) -> int:
    """Signature bits in which two sets of that similarity differ at most, but for a chance under 1e-10: bits of unequal values differ half the time."""
    p = (1 - percent / 100) / 2
    tail, k = 0.0, VALUES
    while k and (tail := tail + math.comb(VALUES, k) * p**k * (1 - p) ** (VALUES - k)) < 1e-10:
        k -= 1
    return k


def _families(crowded: DataFrame, comps: DataFrame) -> DataFrame | None:
    """(doc, family) of the classes that meet in crowded regions (region, doc) with more than one component; None if there are none.

    comps: (node, comp), of linked classes at least.
    """
    crowded = crowded.join(comps.select(F.col("node").alias("doc"), "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    mixed = crowded.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("region")
    crowded = materialise(crowded.join(mixed, "region").select("region", "doc"), "crowded")
    n = crowded.count()
    if not n:
        return None
    hubs = crowded.groupBy("region").agg(F.min("doc").alias("hub"))
    families = components(crowded.join(hubs, "region").where("doc <> hub").select(F.col("doc").alias("u"), F.col("hub").alias("v")), n)
    release(crowded)
    return families.select(F.col("node").alias("doc"), F.col("comp").alias("family"))


def _settle(docs: DataFrame, families: DataFrame, comps: DataFrame, tested: DataFrame, percent: int, width: int) -> DataFrame | None:
    """Links (a, b) between components of a family, by full sets; None if no family has two components. tested: pairs that need no second look."""
    n = families.count()
    named = families.join(comps.select(F.col("node").alias("doc"), "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    parts = named.groupBy("family", "comp").agg(F.count("*").alias("held"))
    mixed = parts.groupBy("family").agg(F.max_by("comp", F.struct("held", "comp")).alias("largest"), F.count("*").alias("k")).where("k > 1").select("family", "largest")
    mixed = materialise(mixed, "mixed", n)
    k = mixed.count()
    if not k:
        return None
    named = materialise(keyed_join(named, mixed, "family", "inner", k).select("family", "doc", "comp", (F.col("comp") != F.col("largest")).alias("rest")), "families", n)
    ids = named.select(F.col("doc").alias("doc_id"))
    sets = keyed_join(docs.select("doc_id", "text"), ids, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, shingles binary")
    # rows that repeat an id can have several sets
    sets = materialise(sets.where(F.length("shingles") > 0).dropDuplicates(["doc_id", "shingles"]).withColumnRenamed("doc_id", "doc"), "sets")
    loads = sets.select("shingles").mapInArrow(_loads, "bucket int, held long").groupBy("bucket").agg(F.sum("held").alias("held")).toArrow()
    grade = np.zeros(BUCKETS, np.uint8)  # any order gives the same links; rare shingles first give few candidates
    grade[loads.column(0).to_numpy()] = np.minimum(8 * np.log2(loads.column(1).to_numpy()), 255)
    held = "shingle long, place long, rest boolean, family long, doc long, comp long, size long, bits long, more_bits long"
    rows = named.join(sets, "doc").select("family", "doc", "comp", "rest", "shingles").mapInArrow(_prefixes(grade, percent), held)
    rows = materialise(rows.withColumn("token", F.xxhash64("family", "shingle")).drop("shingle", "family"), "prefixes")
    pairs = materialise(_meet(rows, percent).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    out = confirm(docs, pairs, percent, width)
    release(mixed, named, sets, rows, pairs)
    return out


def _meet(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows that share a token and whose sizes, places and bits allow the similarity, one of them at least outside the largest component.

    What two sets share from their first common shingle on is no more than either holds from there. A token's rows are cut
    into cells of about CELL rows a side.
    """
    tokens = rows.groupBy("token").agg(F.count("*").alias("all"), F.count_if("rest").alias("some"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("some > 0 and low <> high")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    tokens = tokens.select("token", F.ceil(F.col("some") / CELL).cast("int").alias("rests"), F.ceil(F.col("all") / CELL).cast("int").alias("others"), spread)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc", F.lit(2)), F.lit(SALTS)).cast("int")).join(tokens, ["token", "salt"])
    cell = lambda which, seed: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(which)).cast("int")
    span = lambda which: F.explode(F.sequence(F.lit(0), F.col(which) - 1))
    cols = ["doc", "comp", "size", (F.col("size") - F.col("place")).alias("left"), "bits", "more_bits", "rest"]
    one = rows.where("rest").select("token", cell("rests", 0).alias("mine"), span("others").alias("theirs"), *cols)
    two = rows.select("token", span("rests").alias("mine"), cell("others", 1).alias("theirs"), *cols)
    keyed = lambda side, name: side.select(F.xxhash64("token", "mine", "theirs").alias("cell"), F.struct("doc", "comp", "size", "left", "bits", "more_bits", "rest").alias(name))
    met = keyed(one, "x").join(keyed(two, "y"), "cell").where(
        f"""x.comp <> y.comp and (not y.rest or x.doc < y.doc) and least(x.left, y.left) * {100 + percent} >= {percent} * (x.size + y.size)
        and bit_count(x.bits ^ y.bits) + bit_count(x.more_bits ^ y.more_bits) <= {bit_slack(percent)}"""
    )
    return met.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))


def confirm(docs: DataFrame, pairs: DataFrame, percent: int, width: int = 3) -> DataFrame:
    """The pairs (a, b) of documents whose full shingle sets have that similarity."""
    n = pairs.count()
    ids = materialise(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids", 2 * n)
    sets = materialise(keyed_join(docs.select("doc_id", "text"), ids, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, shingles binary"), "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    out = materialise(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"), "links", 10 * n)
    release(ids, sets)
    return out


def _joined(comps: DataFrame, links: DataFrame | None, ties: DataFrame | None = None) -> DataFrame:
    edges, n = comps.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v")), comps.count()
    if links is not None:
        edges, n = edges.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), n + links.count()
    return components(edges, n) if ties is None else components(edges.unionByName(ties))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    limit_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialise(docs.mapInArrow(_sketch(width), "doc_id long, n_shingles long, set_key binary, sig binary"), "sketches")
    known = sketches.where("doc_id is not null and set_key is not null")
    n = sketches.count()
    classes = materialise(known.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "classes", n)
    heads = materialise(known.join(classes.select("set_key", F.col("doc").alias("doc_id")), ["set_key", "doc_id"], "left_semi").select(F.col("doc_id").alias("doc"), "sig"), "heads", 4 * n)

    # the forest's regions, deepened where more than REGION classes share a prefix
    todo, levels = heads.withColumn("mask", F.lit((1 << TREES) - 1)), []
    for depth in DEPTHS:
        rows = todo.select("doc", "sig", "mask").mapInArrow(_regions(depth), "region long, doc long, tree int, below long")
        sizes = rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
        levels.append(materialise(rows.join(sizes, "region"), f"regions{depth}", TREES * n))
        crowded = levels[-1].where(F.col("n") > REGION)
        if crowded.isEmpty():
            break
        masks = crowded.groupBy("doc").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("mask"))
        todo = heads.join(masks, "doc")
    live = reduce(DataFrame.unionByName, levels)
    n_live = live.count()
    members, crowded = live.where(F.col("n") <= REGION), live.where((F.col("n") > REGION) & (F.col("tree") < 2 * FIRST_TREES))
    hub = crowded.groupBy("region").agg(F.min_by("doc", F.struct("below", "doc")).alias("hub"))
    first = crowded.join(hub, "region").where("doc <> hub").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"))
    order = Window.partitionBy("region").orderBy("below", "doc")  # REGION rows at most
    near = members.where(F.col("tree") < FIRST_TREES).withColumn("before", F.lag("doc").over(order)).where("before <> doc")
    first = first.unionByName(near.select(F.least("doc", "before").alias("a"), F.greatest("doc", "before").alias("b")))
    first = materialise(first.distinct(), "first", n_live)
    links = confirm(docs, first, percent, width)
    comps = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), links.count())
    # rows that repeat an id with other words tie their classes
    twice = known.groupBy("doc_id").agg(F.count_distinct("set_key").alias("k")).where("k > 1").select("doc_id")
    ties = known.join(twice, "doc_id", "left_semi").join(classes.select("set_key", "doc"), "set_key").where("doc_id <> doc").select(F.col("doc_id").alias("u"), F.col("doc").alias("v"))

    tested = first
    families = None
    for best in (True, False):
        named = members.select("region", "doc").join(comps.select(F.col("node").alias("doc"), "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        if not best:
            families = _families(levels[0].where(F.col("n") > REGION).select("region", "doc"), comps)
        named = named.withColumn("family", F.col("doc")) if families is None else named.join(families, "doc", "left").withColumn("family", F.coalesce("family", "doc"))
        named = materialise(named, "named", n_live)
        mixed = named.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("family").alias("one"), F.max("family").alias("two")).where("low <> high and one <> two").select("region")
        rows = named.join(mixed, "region").join(heads, "doc").repartition("region").sortWithinPartitions("region", "doc").select("region", "doc", "comp", "family", "sig")
        pairs = rows.mapInArrow(_across(percent / 100 - SLACK, best), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs", n_live)
        more = confirm(docs, pairs, percent, width)
        tested = tested.unionByName(pairs)
        # a component so far is a star around its smallest member
        comps = _joined(comps, more)
    more = None if families is None else _settle(docs, families, comps, tested, percent, width)
    comps = _joined(comps, more, ties)

    release(heads, *levels, first, links, more)
    by_class = classes.join(comps.select(F.col("node").alias("doc"), "comp"), "doc", "left").select("set_key", "copies", F.coalesce("comp", "doc").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    rows = sketches.select("doc_id", "n_shingles", "set_key")
    common = by_class.where(F.col("copies") > HOT)
    marked = rows.where("set_key is not null").join(F.broadcast(common.select("set_key", F.col("component_id").alias("common_id"))), "set_key", "left")
    out = (
        rows.where("set_key is null").withColumn("component_id", F.lit(None).cast("long"))
        .unionByName(marked.where("common_id is not null").withColumnRenamed("common_id", "component_id"))
        .unionByName(marked.where("common_id is null").drop("common_id").join(by_class.where(F.col("copies") <= HOT).drop("copies"), "set_key", "left"))
    )
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85, width: int = 3) -> DataFrame:
    """The rows of docs but those linked to a document of a smaller id, with all their columns.

    A row of null id counts as a document whose id follows from its text and is larger than all others; of rows that are one
    document, by a repeated id or as equal texts of null id, the one whose columns hash lowest, as JSON, stays. Columns may be of any name and type.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    extra = "near_dup_id"
    while extra in map(str.lower, docs.columns):
        extra += "_"
    late = F.shiftrightunsigned(F.xxhash64("text"), 3) + (1 << 61)
    rows = docs.withColumn(extra, F.coalesce(F.col("doc_id").cast("long"), late))
    marks = near_duplicates(rows.select(F.col(extra).alias("doc_id"), "text"), percent, width)
    gone = materialise(marks.where("not kept").select(F.col("doc_id").alias(extra)).distinct(), "gone", docs.count())
    kept = keyed_join(rows, gone, extra, "left_anti")
    again = materialise(rows.groupBy(extra).agg(F.count("*").alias("n")).where("n > 1").select(extra), "again")
    n = again.count()
    if n:
        whole = F.to_json(F.struct(*own))  # maps have no hash
        mark = F.struct(F.xxhash64(whole), F.xxhash64(F.lit(1), whole), whole)
        one = keyed_join(kept, again, extra, "left_semi", n).groupBy(extra).agg(F.min_by(F.struct(*own), mark).alias("row")).select("row.*")
        return keyed_join(kept, again, extra, "left_anti", n).select(*own).unionByName(one)
    return kept.select(*own)
