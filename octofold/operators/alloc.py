"""Allocation of sparse maps: key lists to nodes and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octofold.functions import keys as K


def prefixes(keyed: DataFrame, depth: int, top: int, key: str = "key") -> DataFrame:
    """Each key with all its ancestors from level ``top`` to its own level: columns key, up."""
    levels = F.explode(F.sequence(F.lit(top), K.level_of(key))).alias("l")
    return K.held(keyed.select(F.col(key).alias("key"), levels), "key", up=K.ancestor("key", "l", depth))


def filter_ancestors(keyed: DataFrame, depth: int) -> DataFrame:
    """Distinct keys that are no ancestor of another key. Every key names its strict
    ancestors; an anti-join removes those, so no global order (and no single task) is needed."""
    own = keyed.select("key").distinct()
    above = prefixes(own, depth, 0).where("up <> key").select(F.col("up").alias("key")).distinct()
    return own.join(above, "key", "left_anti")


def unique_multiscale(keyed: DataFrame, level: int) -> DataFrame:
    """A3: of keys at ``level`` or finer, one for each code, the deepest."""
    deep = keyed.where(K.level_of("key") >= level)
    return K.held(deep, "key", code=K.code_of("key")).groupBy("code").agg(F.max("key").alias("key"))


def levels(keyed: DataFrame, depth: int) -> DataFrame:
    """All octants (key, level) that allocating the keys creates: every ancestor below
    the root down to the key's own level, at most block level."""
    low = F.least(K.level_of("key"), F.lit(depth - K.BLOCK_LOG))
    each = keyed.select("key", F.explode(F.sequence(F.lit(1), low)).alias("level"))
    return K.held(each, "level", up=K.ancestor("key", "level", depth)).select(F.col("up").alias("key"), "level").distinct()


def allocate(keyed: DataFrame, present: DataFrame, depth: int) -> DataFrame:
    """Insert-if-absent; the octants (key, level) that are new to ``present`` (key)."""
    return levels(keyed, depth).join(present.select("key"), "key", "left_anti")


def empty_slots(octants: DataFrame, depth: int) -> DataFrame:
    """The places (key, level) below the root and below interior ``octants`` (key, level) that
    hold no child."""
    inner = octants.where(F.col("level") < depth - K.BLOCK_LOG).select("key", "level")
    root = octants.sparkSession.createDataFrame([(0, 0)], "key long, level int")
    span = K.power_of_two(3 * (F.lit(depth - 1) - F.col("level")))
    child = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("key") - F.col("level") + i * span).bitwiseOR(F.col("level").cast("long") + 1))
    every = inner.unionByName(root).select(F.explode(child).alias("key"), (F.col("level") + 1).alias("level"))
    return every.join(octants.select("key"), "key", "left_anti")


def children_mask(octants: DataFrame, depth: int) -> DataFrame:
    """A5: parent key and the bits of its present children."""
    bit = F.call_function("shiftleft", F.lit(1), K.child_id("key", depth))
    return K.held(octants, up=K.parent("key", depth), bit=bit).groupBy(F.col("up").alias("key")).agg(F.bit_or("bit").cast("int").alias("mask"))


def counts(octants: DataFrame, depth: int) -> DataFrame:
    """Leaves, and all nodes with leaves and root."""
    leaf = F.sum((F.col("level") == depth - K.BLOCK_LOG).cast("long"))
    return octants.agg(leaf.alias("leaves"), (F.count("*") + 1).alias("nodes"))


def voxels(points: DataFrame, depth: int) -> DataFrame:
    """Fused samples of a map: block key, slot, coordinates, weighted mean value, weight."""
    fused = points.groupBy("x", "y", "z").agg(F.sum(F.col("val") * F.col("w")).alias("s"), F.sum("w").cast("long").alias("weight"))
    named = K.held(fused, "x", "y", "z", "s", "weight", key=K.block_key("x", "y", "z", depth), slot=K.slot("x", "y", "z"))
    return named.select("key", "slot", "x", "y", "z", (F.col("s") / F.col("weight")).alias("value"), "weight")
