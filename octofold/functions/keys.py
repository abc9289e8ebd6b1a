"""Spatial keys as Column expressions: Morton codes with the level in the low nine bits.

A key is the Morton code of an octant's corner (x in bit 0 of each triple, then y, z), cut to the
octant's level, or-ed with the level. Keys are BIGINT; of 63 code bits the sign is never used.
``depth`` is log2 of the map's edge, ``level`` counts from the root (0); a block of 8 voxels is
at ``depth - 3``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL_BITS, BLOCK_LOG = 511, 3
def col(c: Column | str | int) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, int) else c


def big(c) -> Column:
    return col(c).cast("long")


_tables: dict = {}


def _table(name: str) -> Column:
    """One literal array made by the rule: of seven bits spread to every third place (128), or of
    nine code bits taken apart, three for each axis at places 0, 21 and 42 (512)."""
    gateway = SparkContext._gateway
    if (name, gateway) not in _tables:
        spread = [sum((n >> i & 1) << 3 * i for i in range(7)) for n in range(128)]
        apart = [sum((n >> (3 * k + axis) & 1) << (21 * axis + k) for k in range(3) for axis in range(3)) for n in range(512)]
        _tables[name, gateway] = F.lit(np.array({"spread": spread, "apart": apart}[name], dtype=np.int64))
    return _tables[name, gateway]


def held(df: DataFrame, *keep: str, **new: Column) -> DataFrame:
    """df[keep] and the new columns, which are evaluated once, here: neither filters that Spark
    pushes down or infers nor later expressions repeat them. Key expressions are long."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


def expand(v) -> Column:
    """K1: the 21 low bits of v, each at three times its place, seven bits at a time by table:
    shorter than shift-and-mask steps, whose operands a Column expression would repeat."""
    parts = [F.shiftleft(F.get(_table("spread"), F.shiftrightunsigned(big(v), s).bitwiseAND(F.lit(127)).cast("int")), 3 * s) for s in (0, 7, 14)]
    return reduce(Column.bitwiseOR, parts)


def apart(code) -> Column:
    """K2: x, y and z of a code, at bits 0, 21 and 42 of one number."""
    parts = [F.shiftleft(F.get(_table("apart"), F.shiftrightunsigned(big(code), 9 * g).bitwiseAND(F.lit(511)).cast("int")), 3 * g) for g in range(7)]
    return reduce(Column.bitwiseOR, parts)


def morton(x, y, z) -> Column:
    """K3."""
    return expand(x).bitwiseOR(F.shiftleft(expand(y), 1)).bitwiseOR(F.shiftleft(expand(z), 2))


def unpack(code) -> tuple[Column, Column, Column]:
    """K4: the three coordinates as INT."""
    whole = apart(code)
    return tuple(F.shiftrightunsigned(whole, 21 * i).bitwiseAND(F.lit((1 << 21) - 1)).cast("int") for i in range(3))


def power_of_two(n: Column) -> Column:
    """1 << n for a column n."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), col(n).cast("int"))


def cut(code, level, depth: int) -> Column:
    """Clears the low 3 (depth - level) bits."""
    bits = (3 * (F.lit(depth) - col(level))).cast("int") if not isinstance(level, int) else F.lit(3 * (depth - level))
    return F.call_function("shiftleft", F.call_function("shiftright", big(code), bits), bits)


def encode(x, y, z, level, depth: int) -> Column:
    """K6."""
    return cut(morton(x, y, z), level, depth).bitwiseOR(big(level))


def block_key(x, y, z, depth: int) -> Column:
    """K8: the key of the block of a voxel."""
    return encode(x, y, z, depth - BLOCK_LOG, depth)


def code_of(key) -> Column:
    """K7."""
    return big(key) - big(key).bitwiseAND(F.lit(LEVEL_BITS))


def level_of(key) -> Column:
    """K7."""
    return big(key).bitwiseAND(F.lit(LEVEL_BITS)).cast("int")


def corner(key) -> tuple[Column, Column, Column]:
    """K7: corner coordinates."""
    return unpack(code_of(key))


def side(level, depth: int) -> Column:
    return power_of_two(F.lit(depth) - col(level)).cast("int")


def ancestor(key, level, depth: int) -> Column:
    """The key of the octant at ``level`` that holds the key's octant."""
    return cut(code_of(key), level, depth).bitwiseOR(big(level))


def parent(key, depth: int) -> Column:
    """K9: NULL at the root."""
    up = level_of(key) - 1
    return F.when(up >= 0, ancestor(key, up, depth))


def child_id(key, depth: int) -> Column:
    """X + 2 y + 4 z of the octant among its siblings."""
    shift = 3 * (F.lit(depth) - level_of(key))
    return F.call_function("shiftright", code_of(key), shift.cast("int")).bitwiseAND(F.lit(7)).cast("int")


def descendant(key, of, depth: int) -> Column:
    """Whether ``key`` lies in octant ``of`` (an octant is in itself)."""
    return cut(code_of(key), level_of(of), depth) == code_of(of)


def far_corner(key, depth: int) -> tuple[Column, Column, Column]:
    """The corner that no sibling shares."""
    bit = child_id(key, depth)
    edge = side(level_of(key), depth)
    return tuple((c + F.shiftright(bit, i).bitwiseAND(F.lit(1)) * edge).cast("int") for i, c in enumerate(corner(key)))


def face_neighbours(key, depth: int) -> Column:
    """Array of (face, x, y, z) in the order -x +x -y +y -z +z; not bounded by the map."""
    edge = side(level_of(key), depth)
    at = corner(key)
    rows = []
    for face in range(6):
        step = edge if face % 2 else -edge
        rows.append(F.struct(F.lit(face).alias("face"), *[(c + step if i == face // 2 else c).cast("int").alias(n) for i, (c, n) in enumerate(zip(at, "xyz"))]))
    return F.array(*rows)


def exterior_neighbours(df: DataFrame, key: str, depth: int) -> DataFrame:
    """Key, n (1 to 7) and neighbour: the keys around the far corner, one voxel outward; a
    step that would leave the cube is not taken, so keys can repeat. The steps are rows, so the
    key expression stands in the plan once."""
    bit, top = child_id(key, depth), (1 << depth) - 1
    far = df.select(F.col(key).alias("key"), level_of(key).alias("level"), bit.alias("bit"), *[c.alias(f"c{i}") for i, c in enumerate(corner(key))], F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n"))
    far = far.withColumn("edge", side("level", depth))
    for i in range(3):
        on = F.shiftright("bit", i).bitwiseAND(F.lit(1))
        far = far.withColumn(f"f{i}", F.col(f"c{i}") + on * F.col("edge")).withColumn(f"d{i}", (2 * on - 1) * F.shiftright("n", i).bitwiseAND(F.lit(1)))
        far = far.withColumn(f"m{i}", F.col(f"f{i}") + F.when((F.col(f"f{i}") + F.col(f"d{i}")).between(0, top), F.col(f"d{i}")).otherwise(0))
    code = far.withColumn("code", morton("m0", "m1", "m2"))
    return code.select("key", "n", cut("code", "level", depth).bitwiseOR(big("level")).alias("neighbour"))


def siblings(key, depth: int) -> Column:
    """The eight keys of the parent's children in child order."""
    level = level_of(key)
    up, span = cut(code_of(key), level - 1, depth), power_of_two(3 * (F.lit(depth) - level))
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (up + i * span).bitwiseOR(big(level)))


def slot(x, y, z) -> Column:
    """Place of a voxel in its block, x fastest."""
    return (F.pmod(col(x), F.lit(8)) + 8 * F.pmod(col(y), F.lit(8)) + 64 * F.pmod(col(z), F.lit(8))).cast("int")
