"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octofold.llm.common import discard, hot_keys, spread_join, stored


def state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(a, b): each node a of a link (columns a, b) that is not the smallest of its component,
    with that smallest node b. Each round's edges are stored in the shared folder; the rounds
    (logarithmic in number) end when a round changes nothing. Minima per node are partial sums
    before their shuffle, and a hub's neighbours meet its minimum in several tasks."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    now = state(edges)
    while now != before and now[0]:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(both, least, "u", ["v"], hot_keys(both, "u")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u", ["v"], hot_keys(large, "u")).where("v <> m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
        fresh = stored(small.union(least.select("u", "m")).distinct(), "edges")
        discard(edges)
        discard(large)
        edges, before, now = fresh, now, state(fresh)
    return edges
