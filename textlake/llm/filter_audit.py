"""Which filter removes what, for every order of the filters, by inclusion and exclusion.

Each document has five failure flags. For every set T of filters, the number of documents that fail all of T is a sum of flag products: 32
sums, taken for all documents, good ones and toxic ones. Möbius inversion gives all the rest: documents that no filter of S removes are
kept(S) = sum over T within S of (-1)^|T| joint(T), so an order's steps are differences of kept; a filter's unique failures are the
alternating sum over the sets that hold it; and (-1)^(|T|+1) joint(T) is the Harsanyi dividend of T in the game "documents removed",
which its members share alike, so 120 orders give a filter the sum of 120 / |T| dividends: whole numbers throughout.

Filter E compares texts over the whole table. Rows are pre-aggregated by (id, text) and then by (text, part, labels), where equal texts
become a row each, so that no text, however often copied, is joined or sorted by its copies.

Defined results: a null text is empty, and so equal to empty texts; a null lang is the part of the empty string. Rows that repeat an id are
documents of their own, and none is a copy of a smaller id by the other. A null id is neither smaller nor larger than another: such
rows neither fail E nor make others fail it, and have no labels. Several labels of an id count if one says 1. Extra columns are
ignored. An empty table gives no rows, empty labels give zeros.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import keyed_join

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WEIGHTS = ("n", "good", "toxic")


def own_failures(text: Column) -> Column:
    """Bits of the failures of A to D; E needs the other rows."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def bits(w: Column) -> Column:
        n, letters = F.size(w), F.length(text)
        capitals = letters - F.length(F.translate(text, CAPITALS, ""))
        failed = (n < 200, 100 * F.size(F.array_distinct(w)) < 50 * n, 100 * capitals > 3 * letters, text.rlike(r"[#$%&*|]"))
        return sum((f.cast("int") * (1 << k) for k, f in enumerate(failed)), F.lit(0))

    return F.transform(F.array(words), bits)[0]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): how many documents, good ones and toxic ones have failed the filters of the bits in `failed`.

    One row or two for each text and part; see the module for the way.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), own_failures(text).alias("failed"))
    rows = rows.groupBy("id", "part", "key", "failed").agg(F.count("*").alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("at")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where("good = 1 or toxic = 1").withColumn("known", F.lit(True))
    # rows without an id match nothing and are spread by their text
    rows = keyed_join(rows.withColumn("at", F.coalesce("id", F.xxhash64("key"))).withColumn("known", F.col("id").isNotNull()), marks, ["at", "known"], "left")
    rows = rows.select("id", "part", "key", "failed", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    texts = rows.groupBy("key", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.lit(0)).alias("known"), first)
    least = F.min("first.id").over(Window.partitionBy("key"))
    kept = F.when(F.col("first.id") == least, F.col("first.n")).otherwise(F.lit(0))
    texts = texts.withColumn("copies", F.col("known") - kept)
    cells = texts.select("part", "good", "toxic", F.inline(F.array(F.struct("failed", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("failed") + 16).alias("failed"), F.col("copies").alias("n")))))
    return cells.where("n > 0").select("part", "failed", "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))


def joint_failures(cells: DataFrame) -> DataFrame:
    """(part, n, good, toxic), each an array by the bits of T: documents that fail all filters of T, as sums of flag products."""
    flags = [F.getbit(F.col("failed"), F.lit(k)).cast("long") for k in range(len(FILTERS))]

    def product(within: int) -> Column:
        out = F.lit(1).cast("long")
        for k, flag in enumerate(flags):
            if within >> k & 1:
                out = out * flag
        return out

    sums = [F.sum(product(t) * F.col(w)).alias(f"{w}{t}") for w in WEIGHTS for t in range(SETS)]
    return cells.groupBy("part").agg(*sums).select("part", *(F.array(*(f"{w}{t}" for t in range(SETS))).alias(w) for w in WEIGHTS))


def _within(t: Column, s: Column) -> Column:
    return t.bitwiseAND(s) == t


def _signed(joint: Column, chosen, weight=lambda size: 1) -> Column:
    """The sum over the chosen sets T of (-1)^|T| weight(|T|) joint(T)."""
    terms = F.transform(F.filter(F.sequence(F.lit(0), F.lit(SETS - 1)), chosen), lambda t: F.when(F.bit_count(t) % 2 == 0, 1).otherwise(-1) * weight(F.bit_count(t)) * F.element_at(joint, t + 1))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)


def _survivors(joint: Column) -> Column:
    """By the bits of S: what no filter of S removes."""
    return F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda s: _signed(joint, lambda t: _within(t, s)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with what the step's filter removes; docs: doc_id, text, lang."""
    joint = joint_failures(failures(docs, labels))
    inverted = joint.select("part", F.col("n").alias("joint"), *(_survivors(F.col(w)).alias(f"{w}_kept") for w in WEIGHTS))
    orders = inverted.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("before", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1))).withColumn("bit", bits(F.substr("filter_order", F.col("step"), F.lit(1))))
    at = lambda values, s: F.element_at(values, s + 1)
    lost = lambda w: at(f"{w}_kept", F.col("before")) - at(f"{w}_kept", F.col("before") + F.col("bit"))
    holds = lambda t: _within(F.col("bit"), t)
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("n_kept", F.col("before") + F.col("bit")).alias("kept"),
        lost("n").alias("removed"),
        (at("joint", F.col("bit")) - lost("n")).alias("redundant"),
        (-_signed(F.col("joint"), holds)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        (-_signed(F.col("joint"), holds, lambda size: (len(ORDERS) / size).cast("long"))).alias("shapley"),
    )
