"""Rays of every direction against a plain loop over all blocks."""

import random

from octofold.operators import geometry


def plain(ray, block, far):
    t_in, t_out = 0.0, 1e9
    for o, d, lo in zip(ray[1:4], ray[4:7], block[1:4]):
        if d == 0:
            if not lo <= o <= lo + 8:
                return None
            continue
        a, b = (lo - o) / d, (lo + 8 - o) / d
        t_in, t_out = max(t_in, min(a, b)), min(t_out, max(a, b))
    return (t_in, t_out) if t_in <= t_out and t_in <= far else None


def test_rays_of_every_direction(spark):
    rng = random.Random(7)
    blocks = [(i, *(8 * rng.randrange(32) for _ in range(3))) for i in range(2500)]
    places = [float(v) for v in (0, 32, 64, 256, -10, 270, 100, 133)]
    rays = [(i, *(rng.choice(places) if i % 2 else rng.uniform(-20, 276) for _ in range(3)), *(float(rng.randrange(-3, 4)) for _ in range(3))) for i in range(400)]
    rays += [(400 + i, *(float(c + 4) for c in b[1:]), 0.0, 0.0, 0.0) for i, b in enumerate(blocks[:3])]
    want = {(r[0], b[0]) for r in rays for b in blocks if plain(r, b, 60.0)}
    assert {r[0] for r in rays if r[6] < 0} & {r for r, _ in want} and {r[0] for r in rays if r[6] == 0} & {r for r, _ in want}
    left = spark.createDataFrame(rays, "ray_id int, ox double, oy double, oz double, dx double, dy double, dz double")
    right = spark.createDataFrame(blocks, "key long, x int, y int, z int")
    got = [(r.ray_id, r.key) for r in geometry.ray_blocks(left, right, 60.0, 8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
