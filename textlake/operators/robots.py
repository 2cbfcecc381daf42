"""Robots rules as a table: the longest matching prefix decides, everything is allowed without one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U


def parse_rules(files: DataFrame) -> DataFrame:
    """(origin, prefix, allow) for all agents, of (origin, status, body); files that were not found have no rules."""
    lines = files.where(F.col("status") == 200).select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    field = F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1)))
    value = F.trim(F.regexp_extract("line", r"^\s*[A-Za-z-]+\s*:\s*([^#]*)", 1))
    rows = lines.select("origin", "pos", field.alias("field"), value.alias("value"))
    agent = F.last(F.when(F.col("field") == "user-agent", F.col("value")), True).over(Window.partitionBy("origin").orderBy("pos"))
    return rows.withColumn("agent", agent).where("agent = '*' and field in ('allow', 'disallow') and value <> ''").select("origin", F.col("value").alias("prefix"), (F.col("field") == "allow").alias("allow"))


def allowed(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """pages with `allowed`: by the longest rule whose prefix the path starts with, allow before disallow on ties."""
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    rows = pages.withColumn("_origin", F.lower(U.authority(F.col("url")))).withColumn("_path", F.when(path == "", F.lit("/")).otherwise(path))
    hits = rows.join(rules, rows["_origin"] == rules["origin"]).where(F.col("_path").startswith(F.col("prefix")))
    best = hits.groupBy(key).agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allowed"))
    return rows.drop("_origin", "_path").join(best, key, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
