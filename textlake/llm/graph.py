"""Connected components of an edge table by alternating stars, with no state outside tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, release


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, comp) for every node of edges (u, v), comp the smallest node that is reachable.

    Each round hangs a node's larger neighbours on its smallest one, then its smaller neighbours likewise;
    the number of rounds grows with the logarithm of the longest path. Loops and repeats do no harm.
    rows: the edges at most, if known.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large", 2 * mark[0])
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialise(small.select("e.*").where("u <> v").distinct(), "edges", 2 * mark[0])
        was, mark = mark, _mark(new)
        release(now, large)
        now = new
        if mark == was:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return materialise(now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots).distinct(), "components", 2 * mark[0])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("v", "u") % 1_000_003), F.lit(0))).first())
