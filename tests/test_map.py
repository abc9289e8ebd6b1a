"""Keys and allocation on the small cases whose results are known."""

import random

from pyspark.sql import functions as F

from octofold.functions import keys as K
from octofold.operators import alloc


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def key(x, y, z, level, depth):
    code = sum(((c >> i) & 1) << (3 * i + k) for i in range(21) for k, c in enumerate((x, y, z)))
    span = 1 << 3 * (depth - level)
    return code - code % span | level


def test_round_trip_and_definition(spark):
    rng = random.Random(3)
    rows = [tuple(rng.randrange(1 << 21) for _ in range(3)) for _ in range(500)] + [(0, 0, 0), ((1 << 21) - 1,) * 3]
    df = spark.createDataFrame(rows, "x int, y int, z int").withColumn("code", K.morton("x", "y", "z"))
    out = df.select("x", "y", "z", "code", *[c.alias(f"u{i}") for i, c in enumerate(K.unpack("code"))]).collect()
    for r in out:
        assert (r.u0, r.u1, r.u2) == (r.x, r.y, r.z)
        assert r.code == sum(((c >> i) & 1) << (3 * i + k) for i in range(21) for k, c in enumerate((r.x, r.y, r.z)))


def test_parents_and_descendants(spark):
    k5 = key(112, 80, 160, 5, 8)
    p4 = one(spark, K.parent(F.lit(k5), 8))[0]
    assert p4 == key(112, 80, 160, 4, 8) and p4 & 511 == 4
    assert one(spark, K.parent(F.lit(p4), 8))[0] == key(96, 64, 160, 3, 8)
    child = F.lit(key(110, 80, 159, 5, 8))
    assert one(spark, K.descendant(child, F.lit(key(96, 64, 128, 3, 8)), 8), K.descendant(child, F.lit(key(128, 64, 64, 3, 8)), 8)) == (True, False)
    assert one(spark, K.parent(F.lit(0), 8))[0] is None


def test_far_corners_and_siblings(spark):
    for at, far in (((16, 16, 16), (16, 16, 16)), ((24, 16, 16), (32, 16, 16)), ((16, 24, 16), (16, 32, 16)), ((24, 24, 16), (32, 32, 16))):
        assert one(spark, *K.far_corner(F.lit(key(*at, 2, 5)), 5)) == far
    found = one(spark, K.siblings(F.lit(key(16, 16, 16, 2, 5)), 5))[0]
    assert set(found) == {key(16 + 8 * a, 16 + 8 * b, 16 + 8 * c, 2, 5) for a in (0, 1) for b in (0, 1) for c in (0, 1)}
    faces = one(spark, K.face_neighbours(F.lit(key(112, 80, 160, 5, 8)), 8))[0]
    assert [tuple(f)[1:] for f in faces] == [(104, 80, 160), (120, 80, 160), (112, 72, 160), (112, 88, 160), (112, 80, 152), (112, 80, 168)]


def test_ancestors_go(spark):
    rows = [(key(64, 0, 64, 4, 10),), (key(96, 0, 64, 5, 10),), (key(80, 0, 64, 5, 10),), (key(128, 24, 80, 5, 10),)]
    df = spark.createDataFrame(rows, "key long")
    assert alloc.filter_ancestors(df, 10).count() == 3
    assert alloc.unique_multiscale(df, 4).count() == 3
    assert alloc.filter_ancestors(df.limit(0), 10).count() == 0


def test_allocate_twice_adds_nothing(spark):
    df = spark.createDataFrame([(key(25, 65, 127, 5, 8),), (key(56, 12, 12, 5, 8),)], "key long")
    none = spark.createDataFrame([], "key long")
    first = alloc.allocate(df, none, 8)
    assert alloc.allocate(df, first, 8).count() == 0
    masks = alloc.children_mask(first, 8)
    assert masks.agg(F.sum(F.bit_count("mask"))).first()[0] == first.count()
