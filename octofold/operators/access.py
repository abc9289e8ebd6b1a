"""Reading and updating a sparse map's voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octofold.functions import keys as K


def get_fine(probes: DataFrame, voxels: DataFrame, blocks: DataFrame, depth: int, init: float) -> DataFrame:
    """The voxel's value where its block exists (``init`` if never written), else NULL."""
    at = K.held(probes, *probes.columns, key=K.block_key("x", "y", "z", depth), slot=K.slot("x", "y", "z"))
    there = blocks.select("key", F.lit(init).alias("init"))
    return at.join(there, "key", "left").join(voxels.select("key", "slot", "value"), ["key", "slot"], "left").withColumn("value", F.coalesce("value", "init")).drop("init", "key", "slot")


def get_hierarchical(probes: DataFrame, octants: DataFrame, depth: int) -> DataFrame:
    """For each probe (id, x, y, z) the deepest of ``octants`` (key, value) that holds it.
    The probe names its octant on every level, so the as-of lookup is an equi-join."""
    block = depth - K.BLOCK_LOG
    named = probes.select("id", F.explode(F.sequence(F.lit(1), F.lit(block))).alias("l"), "x", "y", "z")
    named = K.held(named, "id", key=K.encode("x", "y", "z", F.col("l"), depth))
    found = named.join(octants.select("key", "value"), "key").groupBy("id").agg(F.max(F.struct(K.level_of("key").alias("level"), "key", "value")).alias("m"))
    return probes.join(found, "id", "left").select("id", "m.key", F.col("m.level").alias("level"), "m.value")


def set_if_present(updates: DataFrame, blocks: DataFrame, depth: int) -> DataFrame:
    """Updates (x, y, z, value) take effect only where their block exists; one update a
    voxel, the largest value if several."""
    keyed = K.held(updates, *updates.columns, key=K.block_key("x", "y", "z", depth), slot=K.slot("x", "y", "z")).join(blocks.select("key"), "key", "left_semi")
    return keyed.groupBy("key", "slot").agg(F.max("value").alias("value"))


def block_update(blocks: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int], value: Column) -> DataFrame:
    """D7, P5 on blocks: every voxel of the blocks (key) in the half-open box [lo, hi)."""
    x, y, z = K.corner("key")
    near = K.held(blocks, "key", bx=x, by=y, bz=z).where(" and ".join(f"b{n} < {h} and b{n} + 8 > {low}" for n, low, h in zip("xyz", lo, hi)))
    for n in "xyz":
        near = near.withColumn(n, F.explode(F.sequence(F.col(f"b{n}"), F.col(f"b{n}") + 7)))
    inside = near.where(" and ".join(f"{n} >= {low} and {n} < {h}" for n, low, h in zip("xyz", lo, hi)))
    return inside.select("key", "x", "y", "z", value.alias("value"))


def node_update(nodes: DataFrame, depth: int, lo: tuple[int, int, int], hi: tuple[int, int, int], value: Column) -> DataFrame:
    """D6, D7, P5 on node slots: the child corners of interior nodes (key) in the closed box."""
    x, y, z = K.corner("key")
    half = K.side(K.level_of("key") + 1, depth)
    slots = K.held(nodes, "key", bx=x, by=y, bz=z, half=half).select("key", "bx", "by", "bz", "half", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("child"))
    place = [(F.col(f"b{n}") + F.shiftright("child", i).bitwiseAND(F.lit(1)) * F.col("half")).cast("int").alias(n) for i, n in enumerate("xyz")]
    inside = " and ".join(f"{n} >= {low} and {n} <= {h}" for n, low, h in zip("xyz", lo, hi))
    return slots.select("key", "child", *place).where(inside).withColumn("value", value)


def iterate(octants: DataFrame, depth: int) -> DataFrame:
    """Interior nodes (kind 0) and blocks (kind 1) with corner and edge."""
    x, y, z = K.corner("key")
    kind = (F.col("level") == depth - K.BLOCK_LOG).cast("int")
    return K.held(octants, "key", "level", x=x, y=y, z=z).select(kind.alias("kind"), "key", "x", "y", "z", K.side("level", depth).alias("side"))


def any_of(rows: DataFrame, *predicates: Column) -> DataFrame:
    """Rows that satisfy one predicate or more."""
    test = predicates[0]
    for p in predicates[1:]:
        test = test | p
    return rows.where(test)
