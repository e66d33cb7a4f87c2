"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import settled


def _to_least(pairs: DataFrame) -> DataFrame:
    """Each u's neighbours v with the least of u and its neighbours; a hot u is only ever aggregated and joined."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    return pairs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    near = _to_least(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return near.where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(near.select("u", F.col("least").alias("v")))


def components(links: DataFrame, per_task: int = 50_000) -> DataFrame:
    """(node, component) for every node in `links` (two long columns); component is its least reachable node.

    Steps repeat until the links no longer change, then every link leads from a node to its component.
    Links are never gathered in one place; each round is written to the shared checkpoint folder, by as many tasks
    as its links need, and at least 8, so that few links make few files.
    """
    a, b = links.columns
    links = settled(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    before, now = None, _digest(links)
    while now != before:
        tasks = max(8, now[0] // per_task)
        wide = _large_star(links.coalesce(tasks)).coalesce(tasks)
        links = settled(_small_star(wide).where("u <> v").distinct().coalesce(tasks))
        before, now = now, _digest(links)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())


def _digest(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
