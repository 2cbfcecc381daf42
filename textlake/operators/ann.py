"""Approximate nearest neighbours: vectors in lists around centres, of which a query reads the nearest.

Centres are fitted by k-means on a bounded sample of the distinct vectors, at most PER_LIST * MAX_LISTS of them; every row is indexed, in a
folder for its list. How many lists a query probes is settled at the fit: the fewest that find `recall` of the true
neighbours within a sample of CALIBRATE vectors. Within the probed lists scores are exact, to 12 decimals.

Left out, as they have no cosine: rows of null id, and vectors that are null, of another length than most, zero or not finite. Repeated
rows are points of their own; of query rows of one id the smallest vector asks. No points give an empty index and no hits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import TOP_K
from ..plans.scratch import materialise, release
from .vectors import Best

MAX_LISTS, PER_LIST, CALIBRATE, ASKED = 4096, 64, 8192, 200
#: Queries and points of one list that meet in one group.
BLOCK, PIECE = 4000, 8192
RECALL = 0.95


def _cosines(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T) / np.sqrt((vectors**2).sum(axis=1))[:, None]


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _nearest(c: Column, centres: np.ndarray, n: int) -> Column:
    """The n lists of nearest centres, nearest first."""

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        order = np.argsort(-_cosines(_stack(vectors), centres), axis=1, kind="stable")[:, :n]
        return pd.Series(list(order.astype(np.int32)), index=vectors.index)

    return run(c)


def _sound(points: DataFrame, dim: int | None) -> DataFrame:
    """(vec_id, embedding) of the rows that have a cosine."""
    v = F.col("embedding")
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = points.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<float>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size(v) == F.lit(dim if dim else -9)) & (square > 0) & (square < float("inf")))  # a NaN is above all


def _calibrated(sample: np.ndarray, centres: np.ndarray, recall: float, k: int) -> int:
    """The fewest probes that find `recall` of the k nearest of the sample's first rows."""
    unit = sample / np.sqrt((sample**2).sum(axis=1))[:, None]
    asked = unit[:ASKED]
    score = asked @ unit.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(unit) - 1)]
    if not near.size:
        return len(centres)
    home = _cosines(unit, centres).argmax(axis=1)
    place = np.argsort(np.argsort(-_cosines(asked, centres), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


class VectorIndex:
    """A folder with `centres` (list, centre, probes) and `lists` (vec_id, embedding, by list)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def fit(self, points: DataFrame, lists: int | None = None, recall: float = RECALL, k: int = TOP_K, seed: int = 7) -> None:
        """Centres and number of probes, from a sample of points (vec_id, embedding); about sqrt(rows) lists unless given."""
        common = points.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        schema = "list int, centre array<double>, probes int"
        if not common or not common["dim"]:
            return self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/centres")
        lists = max(1, min(MAX_LISTS, lists or int(common["count"] ** 0.5)))
        share = min(1.0, lists * PER_LIST / common["count"])
        code = F.xxhash64("embedding")  # a vector that many rows share is one of the sample
        drawn = _sound(points, common["dim"]).where(F.pmod(code, F.lit(1 << 30)) < int(share * (1 << 30))).groupBy(code.alias("code")).agg(F.min("embedding").alias("embedding"))
        sample = materialise(drawn, "vectors")
        n = sample.count()
        if not n:
            return self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/centres")
        few = sample.coalesce(max(1, n // CALIBRATE))
        if lists == 1 or n <= lists:
            centres = _stack([r.embedding for r in few.limit(1).collect()])  # too few to tell regions apart
        else:
            fitted = KMeans(k=lists, distanceMeasure="cosine", maxIter=12, seed=seed).fit(few.select(array_to_vector("embedding").alias("features")))
            centres = np.array(fitted.clusterCenters(), np.float64)
        centres = centres / np.sqrt((centres**2).sum(axis=1))[:, None]
        some = _stack([r.embedding for r in sample.orderBy("code").limit(CALIBRATE).collect()])
        probes = _calibrated(some, centres, recall, k)
        release(sample)
        self.spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], schema).write.mode("overwrite").parquet(f"{self.path}/centres")

    def centres(self) -> tuple[np.ndarray | None, int]:
        rows = self.spark.read.schema("list int, centre array<double>, probes int").parquet(f"{self.path}/centres").orderBy("list").collect()  # MAX_LISTS at most
        return (_stack([r.centre for r in rows]), rows[0].probes) if rows else (None, 0)

    def add(self, points: DataFrame) -> None:
        """Index more points; a crowded list is split over several tasks and files."""
        centres, _ = self.centres()
        if centres is None:
            return
        placed = _sound(points, centres.shape[1]).withColumn("list", _nearest(F.col("embedding"), centres, 1)[0])
        placed.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int = TOP_K, probes: int | None = None, itself: bool = False) -> DataFrame:
        """(query_id, vec_id, score, rank) as vectors.knn() gives, from the probed lists: a query set (vec_id, embedding) against all points.

        Queries and points meet by list, in a shuffle: crowded lists in pieces of points, much asked ones in blocks of queries, so a group of either has a bounded size. Lists
        that nothing probes are not read; a group keeps k for each query, and the driver sees counts by list only.
        """
        schema = "query_id long, vec_id long, score double"
        centres, fitted = self.centres()
        if centres is None:
            return self.spark.createDataFrame([], schema + ", rank int")
        asked = _sound(queries, centres.shape[1]).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
        pairs = materialise(asked.withColumn("list", F.explode(_nearest(F.col("embedding"), centres, min(probes or fitted, len(centres))))), "probes")
        points = self.spark.read.schema("vec_id long, embedding array<float>, list int").parquet(f"{self.path}/lists")
        asking = pairs.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        crowded = points.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
        dealt = F.broadcast(asking.join(crowded, "list"))  # MAX_LISTS rows at most
        one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = points.join(dealt, "list").withColumn("piece", F.pmod(F.monotonically_increasing_id(), F.col("pieces")).cast("int")).withColumn("block", one("blocks"))
        right = pairs.join(dealt, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("piece", one("pieces"))
        key = ("list", "piece", "block")
        found = left.select(*key, "vec_id", "embedding").groupBy(*key).cogroup(right.select(*key, "query_id", "embedding").groupBy(*key)).applyInPandas(_scorer(k, itself), schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scorer(k: int, itself: bool):
    """For cogrouped points and queries of one list: the k best of each query."""

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        best = Best(queries.query_id.to_numpy(np.int64), _stack(queries.embedding) if len(queries) else np.empty((0, 1)), k, itself)
        if len(queries):
            best.add(points.vec_id.to_numpy(np.int64), points.embedding)
        return best.frame()

    return run
