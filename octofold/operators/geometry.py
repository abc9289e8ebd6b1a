"""Boxes and rays against boxes and sparse maps. All joins have an equality on a coarse cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octofold.functions import keys as K


def cells(boxes: DataFrame, cell: int, prefix: str = "") -> DataFrame:
    """Adds cx, cy, cz: one row for each coarse cell that the closed box touches."""
    out = boxes
    for n in "xyz":
        lo, ext = F.col(f"{prefix}b{n}"), F.col(f"{prefix}e{n}")
        first, last = F.floor((lo - 1) / cell).cast("int"), F.floor((lo + ext + 1) / cell).cast("int")
        out = out.withColumn(f"c{n}", F.explode(F.sequence(first, last)))
    return out


def overlap(a: str, ea: str, b: str, eb: str) -> Column:
    """Centre distance against the halved edges, in integers: touching counts, and odd
    edges are halved down."""
    half = lambda e: F.floor(F.col(e) / 2).cast("int")
    return F.abs(F.col(b) + half(eb) - F.col(a) - half(ea)) <= F.floor((F.col(ea) + F.col(eb)) / 2)


def inside(a: str, ea: str, b: str, eb: str) -> Column:
    """B lies strictly within a."""
    return (F.col(a) < F.col(b)) & (F.col(a) + F.col(ea) > F.col(b) + F.col(eb))


#: Ids of equal boxes in a row at most: Spark holds what a row of two such lists makes until it is read,
#: so about 30 MB a task.
CHUNK = 512


def classes(boxes: DataFrame, shape: list[str], side: str) -> tuple[DataFrame, DataFrame]:
    """The different boxes with the number ``{side}_n`` of chunks that their ids are dealt to, and the chunks:
    ``{side}_chunk``, from 0, and ``{side}_ids``; one that holds too many ids is several rows, by ``{side}_part``."""
    own = [F.col(n).alias(f"{side}_{n}") for n in shape]
    boxes, shape = boxes.select("box_id", *own), [f"{side}_{n}" for n in shape]
    # chunks are filled to three quarters, so that only an id that comes many times makes several parts
    found = boxes.groupBy(*shape).agg(F.ceil(F.count("*") * 4 / (3 * CHUNK)).cast("int").alias(f"{side}_n"))
    chunk = F.pmod(F.xxhash64("box_id"), F.col(f"{side}_n")).cast("int").alias(f"{side}_chunk")
    # in structs, as a list of ids leaves nulls out; in order, as a task that runs again must cut the same parts
    ids = F.sort_array(F.collect_list(F.struct("box_id"))["box_id"])
    lists = boxes.join(found, shape).select("box_id", *shape, chunk).groupBy(*shape, f"{side}_chunk").agg(ids.alias("ids"))
    first = F.sequence(F.lit(1), F.size("ids"), F.lit(CHUNK))
    parts = lists.select(*shape, f"{side}_chunk", F.posexplode(F.transform(first, lambda i: F.slice("ids", i, CHUNK))).alias(f"{side}_part", f"{side}_ids"))
    return found, parts


def pairs(left: DataFrame, right: DataFrame, test, cell: int = 16) -> DataFrame:
    """Pairs of boxes that pass ``test`` on all axes. Different boxes meet in coarse cells, each pair
    that shares several cells in the first of them, so that the test runs once for all equal boxes.
    Each pair of chunks of their ids is then a row with two lists, and these rows are dealt out before
    the lists become pairs of ids: until then there is so little that it would stay in one task."""
    shape = [f"{c}{n}" for c in "be" for n in "xyz"]
    met, ok, sides = None, None, {s: classes(d, shape, s) for d, s in ((left, "a"), (right, "b"))}
    for s, (found, _) in sides.items():
        placed = cells(found, cell, f"{s}_")
        met = placed if met is None else met.join(placed, ["cx", "cy", "cz"])
    for n in "xyz":
        t = test(f"a_b{n}", f"a_e{n}", f"b_b{n}", f"b_e{n}")
        first = F.col(f"c{n}") == F.greatest(*[F.floor((F.col(f"{s}_b{n}") - 1) / cell).cast("int") for s in "ab"])
        ok = t & first if ok is None else ok & t & first
    met = met.where(ok).drop("cx", "cy", "cz")
    for s in sides:
        met = met.withColumn(f"{s}_chunk", F.explode(F.sequence(F.lit(0), F.col(f"{s}_n") - 1))).drop(f"{s}_n")
    key = met.columns
    for s, (_, parts) in sides.items():
        met = met.join(parts, [c for c in key if c.startswith(f"{s}_")])
    met = met.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "a_part", "b_part")
    for s in sides:
        met = met.withColumn(f"{s}_box_id", F.explode(f"{s}_ids")).drop(f"{s}_ids", f"{s}_chunk", f"{s}_part")
    return met


def touched(box: str, edge: str, side: Column | int) -> tuple[Column, Column]:
    """P6 solved for the other box: the first and last place, in units of ``side``, at which a box
    of that side overlaps or touches along an axis."""
    half = lambda c: F.floor(c / 2).cast("int")
    side = F.lit(side) if isinstance(side, int) else side
    middle, reach = F.col(box) + half(F.col(edge)) - half(side), half(F.col(edge) + side)
    return F.ceil((middle - reach) / side).cast("int"), F.floor((middle + reach) / side).cast("int")


def collide(boxes: DataFrame, slots: DataFrame, voxels: DataFrame, blocks: DataFrame, depth: int) -> DataFrame:
    """Per box the worst status (0 empty, 1 unseen, 2 occupied) of what it overlaps or
    touches: stored voxels (key, x, y, z, status), voxels of ``blocks`` (key) that were never
    written (unseen), and places without a child in the tree (``slots``: key, level, status).
    Boxes name the octants they touch on each level, so all joins are on the key; nothing touched
    is empty."""
    names = ["box_id", *[f"{c}{n}" for c in "be" for n in "xyz"]]
    named = boxes.select(*names, F.explode(F.sequence(F.lit(1), F.lit(depth - K.BLOCK_LOG))).alias("level")).withColumn("side", K.side("level", depth))
    for n in "xyz":
        first, last = touched(f"b{n}", f"e{n}", F.col("side"))
        first, last = F.greatest(F.lit(0), first), F.least((F.lit(1 << depth) / F.col("side") - 1).cast("int"), last)
        named = named.withColumns({f"f{n}": first, f"l{n}": last}).where(f"f{n} <= l{n}").withColumn(f"k{n}", F.explode(F.sequence(f"f{n}", f"l{n}")))
    named = K.held(named, *names, "level", key=K.encode(*[F.col(f"k{n}") * F.col("side") for n in "xyz"], F.col("level"), depth))
    missing = named.join(slots.select("key", "status"), "key").select("box_id", "status")
    here = named.where(F.col("level") == depth - K.BLOCK_LOG).join(blocks.select("key"), "key", "left_semi")
    inside, count = F.lit(True), F.lit(1)
    x, y, z = K.corner("key")
    here = K.held(here, *[c for c in here.columns if c != "level"], cx=x, cy=y, cz=z)
    for n in "xyz":
        first, last = touched(f"b{n}", f"e{n}", 1)
        inside = inside & F.col(n).between(first, last)
        count = count * (F.least(last, F.col(f"c{n}") + 7) - F.greatest(first, F.col(f"c{n}")) + 1)
    met = here.withColumn("n", count).join(voxels.select("key", "x", "y", "z", "status"), "key", "left")
    met = met.groupBy("box_id", "key", "n").agg(F.max(F.when(inside, F.col("status"))).alias("worst"), F.count(F.when(inside, 1)).alias("stored"))
    unseen = F.when(F.col("stored") < F.col("n"), 1).otherwise(0)
    leaves = met.select("box_id", F.greatest(F.coalesce("worst", F.lit(0)), unseen).alias("status"))
    worst = missing.unionByName(leaves).groupBy("box_id").agg(F.max("status").alias("worst"))
    name = F.element_at(F.array(*map(F.lit, ("empty", "unseen", "occupied"))), F.coalesce("worst", F.lit(0)) + 1)
    return boxes.select("box_id").join(worst, "box_id", "left").select("box_id", name.alias("status"))


def slab(lo: Column, hi: Column, o: Column, d: Column) -> tuple[Column, Column]:
    """Entry and exit along one axis; a still axis lets everything or nothing through."""
    a, b = F.try_divide(lo - o, d), F.try_divide(hi - o, d)
    free = (o >= lo) & (o <= hi)
    t_in = F.when(d == 0, F.when(free, F.lit(-1e9)).otherwise(F.lit(1e9))).otherwise(F.least(a, b))
    t_out = F.when(d == 0, F.when(free, F.lit(1e9)).otherwise(F.lit(-1e9))).otherwise(F.greatest(a, b))
    return t_in, t_out


#: Octants of a level that are sent to all tasks: a bound of the level itself, not of the map.
TOP = 4_096


def ray_blocks(rays: DataFrame, blocks: DataFrame, far: float | Column, depth: int, keep: tuple[str, ...] = ("ray_id",)) -> DataFrame:
    """Blocks (key, x, y, z) that each ray pierces within (0, far], with entry and exit and the
    ray's columns ``keep``. Rays go
    down the octree of the blocks level by level: each octant that a ray pierces is joined, on its
    place, with the children that it has. A ray pierces what its parent's closed box holds, so
    no block is lost, and each is met once."""
    far = F.lit(far) if isinstance(far, float) else far
    size = F.lit(1 << depth)
    inside = blocks.where(" and ".join(f"{n} >= 0" for n in "xyz")).where((F.col("x") < size) & (F.col("y") < size) & (F.col("z") < size))
    placed = inside.select("key", *[F.shiftright(n, 3).alias(n) for n in "xyz"])
    top = max(0, depth - K.BLOCK_LOG)
    levels = [placed]
    for _ in range(top):
        levels.append(levels[-1].select(*[F.shiftright(n, 1).alias(n) for n in "xyz"]).distinct())
    o = [f"{c}{n}" for c in "od" for n in "xyz"]
    front = rays.select(*keep, *o, far.alias("far"), *[F.lit(0).alias(f"p{n}") for n in "xyz"])
    # few rays make many rows: they are dealt out before they do
    front = front.repartition(int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions")), *o)
    for shift in reversed(range(top + 1)):
        last = shift == 0
        child = levels[shift].select(*(["key"] if last else []), *[F.col(n).alias(f"c{n}") for n in "xyz"], *[F.shiftright(n, 1).alias(f"p{n}") for n in "xyz"])
        child = F.broadcast(child) if 8 ** (top - shift) <= TOP else child
        side = float(8 << shift)
        t = [slab(F.col(f"c{n}") * side, F.col(f"c{n}") * side + side, F.col(f"o{n}"), F.col(f"d{n}")) for n in "xyz"]
        met = front.join(child, ["px", "py", "pz"])
        met = K.held(met, *met.columns, t_in=F.greatest(*[x[0] for x in t], F.lit(0.0)), t_out=F.least(*[x[1] for x in t]))
        met = met.where((F.col("t_in") <= F.col("t_out")) & (F.col("t_in") <= F.col("far")))
        front = met.select(*keep, "key", "t_in", "t_out") if last else met.select(*keep, *o, "far", *[F.col(f"c{n}").alias(f"p{n}") for n in "xyz"])
    return front
