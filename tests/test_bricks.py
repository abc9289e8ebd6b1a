"""Bricks against plain dictionaries: halos, gathers, crowded blocks, and rays through a ball and a plane."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from octofold.operators import bricks, surface

VOXEL = "x int, y int, z int, value double"


def voxels(spark, field):
    return spark.createDataFrame([(*p, float(v)) for p, v in field.items()], VOXEL)


def test_padded_bricks_hold_their_neighbours(spark):
    rng = random.Random(1)
    field = {tuple(rng.randrange(-9, 26) for _ in range(3)): rng.uniform(-1, 1) for _ in range(6_000)}
    rows = bricks.padded(voxels(spark, field).repartition(5)).collect()
    blocks = {tuple(c // 8 for c in p) for p in field}
    assert len(rows) == len({(r.bx, r.by, r.bz) for r in rows}) and blocks <= {(r.bx, r.by, r.bz) for r in rows}
    for r in rows:
        values = memoryview(r["values"]).cast("d")
        for k, (z, y, x) in enumerate(itertools.product(range(-1, 10), repeat=3)):
            want = field.get((8 * r.bx + x, 8 * r.by + y, 8 * r.bz + z))
            assert math.isnan(values[k]) if want is None else values[k] == want


def test_corners_and_gradients(spark, monkeypatch):
    """Also with blocks that are dealt to several tasks, and bases in blocks that are not stored."""
    monkeypatch.setattr(bricks, "CROWD", 50)
    rng = random.Random(2)
    size = 20
    field = {p: rng.uniform(-1, 1) for p in itertools.product(range(size), repeat=3) if rng.random() < 0.4}
    v = voxels(spark, field)
    points = [(i, *(rng.uniform(0, 3) if i % 2 else rng.uniform(0, size) for _ in range(3))) for i in range(1_500)]
    df = spark.createDataFrame(points, "id long, px double, py double, pz double")
    base = surface.bases_of(df, "id")
    got = {r.id: r for r in surface.corner_values(base, v, 7.0).collect()}
    grad = {r.id: r for r in surface.gradient(df, v, 7.0, size, 1.0).collect()}
    assert len(got) == len(grad) == len(points) and bricks.crowded(bricks.in_block(base))
    for i, *p in points:
        b = [math.floor(c) for c in p]
        assert got[i].corners == [field.get(tuple(x + d for x, d in zip(b, o)), 7.0) for o in surface.CORNERS]
        f = [c - x for c, x in zip(p, b)]
        at = lambda o: field.get(tuple(min(size - 1, max(0, x + d)) for x, d in zip(b, o)), 7.0)
        for k, name in enumerate(("gx", "gy", "gz")):
            want = 0.0
            for o in itertools.product((0, 1), repeat=3):
                w = math.prod(f[j] if o[j] else 1 - f[j] for j in range(3))
                step = lambda s: at([c + s * (j == k) for j, c in enumerate(o)])
                want += w * (step(1) - step(-1))
            assert abs(grad[i][name] - want * 0.5 / size) < 1e-9


def plain_steps(field, o, d, far, mu, step, large):
    """One ray, one step after the other."""
    place = lambda t: [a + t * b for a, b in zip(o, d)]

    def blend(p):
        b = [math.floor(c) for c in p]
        return sum(field.get(tuple(x + e for x, e in zip(b, c)), 1.0) * math.prod(q - x if e else 1 - (q - x) for q, x, e in zip(p, b, c)) for c in itertools.product((0, 1), repeat=3))

    t, length, before = 0.0, large, blend(o)
    if before <= 0:
        return None
    while t < far:
        p = place(t)
        value = field.get(tuple(math.floor(c) for c in p))
        if value is None:
            length = large
        else:
            value = blend(p) if -0.5 <= value <= 0.1 else value
            if value < 0:
                return t + length * value / (before - value)
            length, before = max(value * mu, step), value
        t += length
    return None


def rays_at(size, n):
    rng = random.Random(n)
    out = []
    for i in range(n):
        o = [rng.uniform(1, size - 1), rng.uniform(1, size - 1), 0.25]
        to = [size / 2 + rng.uniform(-4, 4) - o[0], size / 2 + rng.uniform(-4, 4) - o[1], size / 2]
        norm = math.hypot(*to)
        out.append((i // 16, i, *o, *(c / norm for c in to)))
    return out


@pytest.mark.parametrize("shape", ["ball", "plane"])
def test_rays_find_the_surface(spark, shape):
    """Variable steps equal the plain version; the hits lie on the surface, also with the far side of
    the map as the only end, and fixed steps agree within a step."""
    size, mu = 32, 4.0
    inside = (lambda p: math.dist(p, (16, 16, 16)) - 7.3) if shape == "ball" else (lambda p: 24.4 - p[2] + 0.1 * p[0])
    field = {p: max(-1.0, min(1.0, inside(p) / mu)) for p in itertools.product(range(size), repeat=3) if abs(inside(p)) < 6}
    rays = rays_at(size, 160)
    df = spark.createDataFrame(rays, "bundle long, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    padded = bricks.padded(voxels(spark, field)).cache()
    got = {r.ray_id: r for r in surface.raycast(df, padded, 5, size, bricks.stepping(mu, 0.5, 2.0)).collect()}
    same = {r.ray_id: r.t for r in surface.raycast(df, padded, 5, size, bricks.fixed(0.5, False)).collect()}
    hits = 0
    for _, i, *r in rays:
        o, d = r[:3], r[3:]
        far = min(max(-a / b, (size - a) / b) for a, b in zip(o, d) if b)
        want = plain_steps(field, o, d, far, mu, 0.5, 2.0)
        assert (want is None) == (i not in got)
        if want is not None:
            hits += 1
            assert abs(got[i].t - want) < 1e-9 and abs(inside((got[i].x, got[i].y, got[i].z))) < 1.6
            assert i in same and abs(same[i] - want) < 2.5
    assert hits > 100
    normals = surface.with_normals(spark.createDataFrame([tuple(r) for r in got.values()], "ray_id long, t double, x double, y double, z double"), padded, 1.0, size, 1.0, inward=False).collect()
    if shape == "ball":
        good = [sum((r[c] - 16) * r[f"n{c}"] for c in "xyz") / math.dist((r.x, r.y, r.z), (16, 16, 16)) for r in normals]
        assert sorted(good)[len(good) // 2] > 0.98
    short = surface.raycast(df, padded, 5, size, bricks.stepping(mu, 0.5, 2.0), far=3.0)
    assert short.where("t > 6").count() == 0
    padded.unpersist()


def test_no_bricks(spark):
    none = bricks.padded(spark.createDataFrame([], VOXEL))
    rays = spark.createDataFrame(rays_at(8, 3), "bundle long, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert surface.raycast(rays, none, 3, 8, bricks.stepping(1.0, 0.5, 2.0)).count() == 0
    base = spark.range(3).select("id", *[F.lit(1).alias(n) for n in "xyz"])
    assert [r.corners for r in surface.corners(base, none, 2.0).collect()] == [[2.0] * 8] * 3
