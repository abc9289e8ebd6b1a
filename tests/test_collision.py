"""The five probes of a map with one block, and surfaces that close."""

from collections import Counter

from octofold.functions import keys as K
from octofold.operators import alloc, geometry, surface


def test_probes_of_one_block(spark):
    at = (56, 12, 254 - 254 % 8)
    block = K.held(spark.createDataFrame([at], "x int, y int, z int"), key=K.block_key("x", "y", "z", 8))
    octants = alloc.levels(block, 8)
    x, y, z = K.corner("key")
    slots = K.held(alloc.empty_slots(octants, 8), "key", "level", x=x, y=y, z=z)
    slots = slots.withColumn("status", slots.x.cast("int") * 0 + ((slots.x < 48) | (slots.z < 240)).cast("int"))
    cells = [(i, j, k) for i in range(at[0], at[0] + 8) for j in range(at[1] - at[1] % 8, at[1] - at[1] % 8 + 8) for k in range(at[2], at[2] + 8)]
    rows = [(i, j, k, 0 if i >= 60 else 2) for i, j, k in cells]
    voxels = K.held(spark.createDataFrame(rows, "x int, y int, z int, status int"), "x", "y", "z", "status", key=K.block_key("x", "y", "z", 8))
    boxes = [(0, 23, 0, 100, 2, 2, 2), (1, 47, 0, 239, 6, 6, 6), (2, 49, 1, 242, 1, 1, 1), (3, 54, 10, 249, 5, 5, 3), (4, 61, 13, 253, 2, 2, 2)]
    found = geometry.collide(spark.createDataFrame(boxes, "box_id int, bx int, by int, bz int, ex int, ey int, ez int"), slots, voxels, block, 8)
    assert {r.box_id: r.status for r in found.collect()} == {0: "unseen", 1: "unseen", 2: "empty", 3: "occupied", 4: "empty"}


def test_triangles_of_all_cases_fit_their_neighbours():
    """On every face, the segments of a case and of any neighbour that shares its corners are the
    same; so surfaces close. Each used edge has a sign change."""
    faces = {}
    for case in range(256):
        triangles = surface.case_triangles(case)
        assert {e for t in triangles for e in t} == {e for e, (a, b) in enumerate(surface.EDGES) if (case >> a & 1) != (case >> b & 1)}
        sides = Counter(frozenset((t[i], t[(i + 1) % 3])) for t in triangles for i in range(3))
        for axis in range(3):
            for side in (0, 1):
                corners = [i for i in range(8) if surface.CORNERS[i][axis] == side]
                flat = lambda e: frozenset(tuple(c for k, c in enumerate(surface.CORNERS[i]) if k != axis) for i in surface.EDGES[e])  # noqa: B023, E731
                own = {e for e, (a, b) in enumerate(surface.EDGES) if a in corners and b in corners}
                segments = frozenset(frozenset(map(flat, s)) for s, n in sides.items() if s <= own and n == 1)
                key = (axis, frozenset(tuple(c for k, c in enumerate(surface.CORNERS[i]) if k != axis) for i in corners if case >> i & 1))
                assert faces.setdefault(key, segments) == segments
    assert sum(len(surface.case_triangles(c)) for c in range(256)) == 820


def test_surface_of_a_ball_faces_outward(spark):
    size, r = 12, 3.3
    field = [(x + 256 * y + 65536 * z, x, y, z, ((x - 6) ** 2 + (y - 6) ** 2 + (z - 6) ** 2) ** 0.5 - r) for x in range(size) for y in range(size) for z in range(size)]
    v = spark.createDataFrame(field, "id int, x int, y int, z int, value double")
    cells = surface.case_index(surface.corner_values(v, v, 1.0), surface.inside_negative)
    rows = surface.triangles(cells, size).collect()
    sides = Counter()
    for t in rows:
        p = [tuple(round(c, 6) for c in v) for v in (t.v0, t.v1, t.v2)]
        a, b = ([q[k] - p[0][k] for k in range(3)] for q in p[1:])
        normal = [a[(k + 1) % 3] * b[(k + 2) % 3] - a[(k + 2) % 3] * b[(k + 1) % 3] for k in range(3)]
        assert sum(n * (c - 6) for n, c in zip(normal, p[0])) >= -1e-9
        sides.update((p[i], p[(i + 1) % 3]) for i in range(3))
    assert rows and all(n == 1 and sides[b, a] == 1 for (a, b), n in sides.items())
