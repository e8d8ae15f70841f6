"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round replaces links by links to the smallest neighbour; the rounds end when nothing changes. Everything is an aggregation
(with map-side partial results) or an equi-join that adaptive execution may split, so neither a large component nor a node
with very many links meets in one task, and nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import temporary, written


def _toward_smallest(links: DataFrame, large: bool) -> DataFrame:
    """``links``: a > b. Large star: every node hands its smallest neighbour to its larger ones; small star: to its smaller ones."""
    if large:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("_m", "a").alias("_m")), "cc-least")
        # for node u (b here) and its larger neighbour a: link a to the smallest of u
        out = links.join(least.select(F.col("a").alias("b"), "_m"), "b").select("a", F.col("_m").alias("b"))
        return out.where("a <> b").distinct()
    least = written(links.groupBy("a").agg(F.min("b").alias("_m")), "cc-least")
    out = links.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b")
    return out.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: two long columns a, b. Returns node, component (the smallest node reachable) for every node that has a link to another."""
    spark, before = links.sparkSession, None
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")
    while True:
        with temporary(spark) as keep:
            links = keep(written(_toward_smallest(_toward_smallest(links, True), False), "cc-links"))
        now = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if now == before or now[0] == 0:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
