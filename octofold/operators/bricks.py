"""Blocks of voxels as bricks: one row a block, its 512 values side by side.

A padded brick also holds what its neighbours have next to it, one voxel before and two behind, so
that whatever is read around a voxel of a block (eight corners of its cell, 32 for a gradient, a
ray's steps) lies inside one row. Bricks send each neighbour those layers, about one and a half times
their own values together, where a join would move eight or 32 rows for every point.

Values are doubles; NaN stands for a voxel that is not stored. Blocks are named by bx, by, bz: a
voxel's place divided by 8.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, LOW, HIGH = 8, 1, 2
WIDE = LOW + SIDE + HIGH
BLOCK = ("bx", "by", "bz")
#: Rows of an Arrow batch: a padded brick has 11 KB.
ROWS = 2_048
#: A block is crowded if it has over 1 / CROWDS of all points, and so many at least.
CROWDS, CROWD = 256, 10_000
#: Where a brick's values go in the neighbour at an offset: first and last, at the source and there.
SOURCE = {-1: (0, HIGH), 0: (0, SIDE), 1: (SIDE - LOW, SIDE)}
TARGET = {-1: (LOW + SIDE, WIDE), 0: (LOW, LOW + SIDE), 1: (0, LOW)}
OFFSETS = list(itertools.product((-1, 0, 1), repeat=3))


def in_block(df: DataFrame) -> DataFrame:
    """Adds the block of x, y, z."""
    return df.withColumns({f"b{n}": F.floor(F.col(n) / SIDE).cast("int") for n in "xyz"})


def _small(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows the different blocks, and the number of each row's block among them."""
    keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
    new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
    return keys[new], np.cumsum(new) - 1


def _grouped(build: Callable[[pa.RecordBatch, int, np.ndarray], np.ndarray]):
    """Makes one row a block of sorted rows: ``build`` fills the bricks of a batch, and a block that
    spans batches is put together."""

    def out(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(keys[:, k]) for k in range(3)), pa.array([v.tobytes() for v in values], pa.binary())], names=[*BLOCK, "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, number = _numbers(batch)
            values = build(batch, len(keys), number)
            if key is not None and (keys[0] == key).all():
                values[0] = np.where(np.isnan(values[0]), held, values[0])
            elif key is not None:
                yield out(key[None], held[None])
            key, held = keys[-1], values[-1]
            if len(keys) > 1:
                yield out(keys[:-1], values[:-1])
        if key is not None:
            yield out(key[None], held[None])

    return run


SCHEMA = "bx int, by int, bz int, values binary"


def packed(voxels: DataFrame) -> DataFrame:
    """bx, by, bz and values (x fastest) of voxels (x, y, z, value)."""
    _small(voxels)

    def build(batch: pa.RecordBatch, n: int, number: np.ndarray) -> np.ndarray:
        values = np.full((n, SIDE**3), np.nan)
        values[number, batch.column(3).to_numpy()] = batch.column(4).to_numpy(zero_copy_only=False)
        return values

    slot = sum(F.pmod(F.col(n), F.lit(SIDE)) * SIDE**k for k, n in enumerate("xyz")).cast("int").alias("slot")
    rows = in_block(voxels).select(*BLOCK, slot, F.col("value").cast("double").alias("value"))
    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(_grouped(build), SCHEMA)


def padded(voxels: DataFrame) -> DataFrame:
    """bx, by, bz and the values of all blocks of voxels (x, y, z, value) and of the blocks next to
    them, with LOW and HIGH layers more on each side."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(3).to_pylist())).reshape(-1, SIDE, SIDE, SIDE)
            keys = [batch.column(k).to_numpy() for k in range(3)]
            for code, offset in enumerate(OFFSETS):
                x, y, z = (slice(*SOURCE[o]) for o in offset)
                layers = own[:, z, y, x].reshape(len(own), -1)
                some = ~np.isnan(layers).all(axis=1)
                if some.any():
                    values = pa.array([v.tobytes() for v in layers[some]], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array(k[some] + np.int32(o)) for k, o in zip(keys, offset)), pa.array(np.full(some.sum(), code, np.int32)), values], names=[*BLOCK, "code", "values"])

    def build(batch: pa.RecordBatch, n: int, number: np.ndarray) -> np.ndarray:
        values = np.full((n, WIDE, WIDE, WIDE), np.nan)
        codes, parts = batch.column(3).to_numpy(), batch.column(4)
        for code in np.unique(codes):
            rows = np.nonzero(codes == code)[0]
            (x0, x1), (y0, y1), (z0, z1) = (TARGET[o] for o in OFFSETS[code])
            layers = np.frombuffer(b"".join(parts.take(pa.array(rows)).to_pylist())).reshape(-1, z1 - z0, y1 - y0, x1 - x0)
            values[number[rows], z0:z1, y0:y1, x0:x1] = layers
        return values.reshape(n, -1)

    sent = packed(voxels).mapInArrow(send, "bx int, by int, bz int, code int, values binary")
    return sent.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(_grouped(build), SCHEMA)


def crowded(points: DataFrame) -> list[tuple]:
    """The blocks with very many points and the tasks that they are dealt to; CROWDS at most."""
    counts = points.groupBy(*BLOCK).count()
    least = max(CROWD, (counts.agg(F.sum("count")).first()[0] or 0) // CROWDS)
    return [(r["bx"], r["by"], r["bz"], -(-r["count"] // least)) for r in counts.where(F.col("count") > least).collect()]


def read(points: DataFrame, bricks: DataFrame, work: Callable[[np.ndarray, np.ndarray, dict], list[pa.Array]], using: list[str], added: str) -> DataFrame:
    """The points (with x, y, z) and the columns ``added`` that ``work`` makes of them: it gets an
    array of padded bricks, the number of each point's brick, and the columns ``using``. Points and
    bricks meet by block, sorted, so a task holds a batch at a time; points of a block without
    brick read NaN."""
    _small(points)
    keep, spark = points.columns, points.sparkSession
    points = in_block(points)
    hot = crowded(points)
    parts = F.broadcast(spark.createDataFrame(hot, "bx int, by int, bz int, n long"))
    n = F.coalesce("n", F.lit(1))
    left = points.join(parts, [*BLOCK], "left").withColumn("part", F.pmod(F.xxhash64(*keep), n)).drop("n") if hot else points.withColumn("part", F.lit(0).cast("long"))
    right = bricks.join(parts, [*BLOCK], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("n") if hot else bricks.withColumn("part", F.lit(0).cast("long"))
    left = left.select(*BLOCK, "part", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("values"), F.struct(*keep).alias("point"))
    right = right.select(*BLOCK, "part", F.lit(0).alias("kind"), "values", F.lit(None).cast(left.schema["point"].dataType).alias("point"))
    both = left.unionByName(right).repartition(*BLOCK, "part").sortWithinPartitions(*BLOCK, "part", "kind")
    schema = T.StructType([*(points.schema[c] for c in keep), *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = np.full((1, 3), -(1 << 30)), np.full((1, WIDE**3), np.nan)
        none = np.full((1, WIDE**3), np.nan)
        for batch in batches:
            kind = batch.column(3).to_numpy()
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            fresh = kind == 0
            values = np.frombuffer(b"".join(batch.column(4).filter(pa.array(fresh)).to_pylist())).reshape(-1, WIDE**3)
            stack, names = np.concatenate([last, values, none]), np.concatenate([key, keys[fresh]])
            which = np.cumsum(fresh)
            which[(names[which] != keys).any(axis=1)] = len(stack) - 1
            key, last = names[-1:], stack[-2:-1]
            at = pa.array(~fresh)
            if fresh.all():
                continue
            point = batch.column(5).filter(at)
            columns = dict(zip(keep, point.flatten()))
            numbers = {c: columns[c].to_numpy(zero_copy_only=False) for c in using}
            yield pa.RecordBatch.from_arrays([*columns.values(), *work(stack, which[~fresh], numbers)], names=schema.names)

    return both.select(*BLOCK, "kind", "values", "point").mapInArrow(run, schema)


def places(x: np.ndarray, y: np.ndarray, z: np.ndarray, of: list[np.ndarray]) -> np.ndarray:
    """The place in its padded brick of the voxel x, y, z, read from the block of ``of``."""
    at = [(c - o // SIDE * SIDE + LOW) for c, o in zip((x, y, z), of)]
    return (at[2] * WIDE + at[1]) * WIDE + at[0]


def list_of(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(k)), pa.array(values.ravel()))


class Field:
    """Padded bricks looked up by place, for a walk through them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, empty: float):
        code = self.code(keys.astype(np.int64))
        order = np.argsort(code)
        self.codes = code[order]
        self.values = np.concatenate([values[order], np.full((1, WIDE**3), np.nan)])
        self.empty = empty

    @staticmethod
    def code(b: np.ndarray) -> np.ndarray:
        return ((b[:, 2] + (1 << 20) << 21) + b[:, 1] + (1 << 20) << 21) + b[:, 0] + (1 << 20)

    def rows(self, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The brick (the last one if none) and the place in it of voxels."""
        code = self.code(base // SIDE)
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        return np.where(known, at, len(self.codes)), places(*base.T, list(base.T))

    def get(self, points: np.ndarray) -> np.ndarray:
        """The voxel that a point lies in; NaN if it is not stored."""
        row, place = self.rows(np.floor(points).astype(np.int64))
        return self.values[row, place]

    def blend(self, points: np.ndarray, whole: bool) -> np.ndarray:
        """The trilinear mean at points: ``whole``: NaN unless all eight voxels are stored, else
        with ``empty`` for those that are not."""
        base = np.floor(points).astype(np.int64)
        row, place = self.rows(base)
        f = points - base
        out = np.zeros(len(points))
        for dx, dy, dz in itertools.product((0, 1), repeat=3):
            v = self.values[row, place + (dz * WIDE + dy) * WIDE + dx]
            w = 1.0
            for c, d in zip(f.T, (dx, dy, dz)):
                w = w * (c if d else 1.0 - c)
            out += w * (v if whole else np.where(np.isnan(v), self.empty, v))
        return out


def fixed(step: float, rising: bool) -> Callable[[Field, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Samples a ``step`` apart, where all eight voxels are stored: the first crossing of zero between
    two samples in a row, downward (distances) or upward (occupancies); a ray whose first
    sample lies behind a surface has none."""

    def walk(field: Field, origin: np.ndarray, direction: np.ndarray, far: np.ndarray) -> np.ndarray:
        out = np.full(len(origin), np.nan)
        most = int(np.floor(far.max(initial=0.0) / step + 1e-9)) + 1
        for low in range(0, len(origin), 64):
            o, d, end = (x[low : low + 64] for x in (origin, direction, far))
            k = np.arange(most)
            points = o[:, None, :] + (k * step)[None, :, None] * d[:, None, :]
            good = ((points >= 0).all(axis=2) & (k[None] * step <= end[:, None] + 1e-9 * step)).ravel()
            flat = np.full(len(good), np.nan)
            flat[good] = field.blend(points.reshape(-1, 3)[good], True)
            value = flat.reshape(len(o), most)
            side = (value <= 0) if rising else (value > 0)
            known = ~np.isnan(value)
            start = known.argmax(axis=1)
            begun = known.any(axis=1) & side[np.arange(len(o)), start]
            crossed = known[:, 1:] & known[:, :-1] & side[:, :-1] & ~side[:, 1:]
            at = crossed.argmax(axis=1) if most > 1 else np.zeros(len(o), int)
            r = np.nonzero(begun & (crossed.any(axis=1) if most > 1 else False))[0]
            v0, v1 = value[r, at[r]], value[r, at[r] + 1]
            out[low + r] = (at[r] + v0 / (v0 - v1)) * step
        return out

    return walk


def stepping(mu: float, step: float, large: float) -> Callable[[Field, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Steps by distance: ``large`` ones where nothing is stored, else as long as the value (in units
    of ``mu``) allows and ``step`` at least; close to a surface values are interpolated. A ray that
    starts behind a surface has no hit."""

    def walk(field: Field, origin: np.ndarray, direction: np.ndarray, far: np.ndarray) -> np.ndarray:
        out, t = np.full(len(origin), np.nan), np.zeros(len(origin))
        before = field.blend(origin, False) if len(origin) else t
        length = np.full(len(origin), large)
        go = np.nonzero((before > 0) & (t < far))[0]
        while len(go):
            points = origin[go] + t[go, None] * direction[go]
            value = field.get(points)
            seen = ~np.isnan(value)
            close = seen & (value <= 0.1) & (value >= -0.5)
            value[close] = field.blend(points[close], False)
            hit = seen & (value < 0)
            r, v = go[hit], value[hit]
            out[r] = t[r] + length[r] * v / (before[r] - v)
            length[go] = np.where(seen, np.maximum(value * mu, step), large)
            before[go] = np.where(seen, value, before[go])
            t[go] += length[go]
            go = go[~hit & (t[go] < far[go])]
        return out

    return walk


def walked(rays: DataFrame, bricks: DataFrame, met: DataFrame, walk: Callable, empty: float) -> DataFrame:
    """ray_id and t of the rays (bundle, ray_id, ox..oz, dx..dz, far) that ``walk`` finds a hit for.
    The rays of a bundle (a tile of pixels) go together and share the bricks (met: bundle, bx, by,
    bz) that any of them pierces, so a brick is sent once a bundle."""
    _small(rays)
    blocks = met.join(bricks, [*BLOCK]).select(F.col("bundle").alias("tile"), *BLOCK, "values")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.stack([right.column(c).to_numpy() for c in BLOCK], axis=1).reshape(-1, 3)
        values = np.frombuffer(b"".join(right.column("values").to_pylist())).reshape(-1, WIDE**3)
        o, d = (np.stack([left.column(f"{c}{n}").to_numpy() for n in "xyz"], axis=1).reshape(-1, 3) for c in "od")
        t = walk(Field(keys, values, empty), o, d, left.column("far").to_numpy())
        good = ~np.isnan(t)
        return pa.table({"ray_id": left.column("ray_id").filter(pa.array(good)), "t": t[good]})

    columns = ["bundle", "ray_id", *(f"{c}{n}" for c in "od" for n in "xyz"), "far"]
    left = rays.select(*columns).groupBy("bundle").cogroup(blocks.groupBy("tile"))
    return left.applyInArrow(run, "ray_id long, t double")
