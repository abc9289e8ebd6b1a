"""Neighbourhoods of voxels: interpolation, gradients and surface cells."""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octofold.operators import bricks, geometry, stats

#: Corners of a cell in the order of the surface construction; fixed values.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1), (0, 1, 0), (1, 1, 0), (1, 1, 1), (0, 1, 1))
#: The twelve edges as pairs of corners; fixed values.
EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))


def corners(bases: DataFrame, padded: DataFrame, empty: float) -> DataFrame:
    """The bases (with x, y, z) and the values of the eight voxels of their cells as an
    array in CORNERS order; ``empty`` where none is stored. All eight lie in the row of the base's
    brick."""

    def work(stack: np.ndarray, which: np.ndarray, at: dict) -> list[pa.Array]:
        own = [at[n] for n in "xyz"]
        place = [bricks.places(*(c + d for c, d in zip(own, o)), own) for o in CORNERS]
        found = stack[which[:, None], np.stack(place, axis=1)]
        return [bricks.list_of(np.where(np.isnan(found), empty, found))]

    return bricks.read(bases, padded, work, ["x", "y", "z"], "corners array<double>")


def corner_values(bases: DataFrame, voxels: DataFrame, empty: float) -> DataFrame:
    """J10, J11 of voxels (x, y, z, value)."""
    return corners(bases, bricks.padded(voxels), empty)


def blended(corners: Column) -> Column:
    """The trilinear mean of a cell's corners at fx, fy, fz, x fastest."""
    out = F.lit(0.0)
    for i, o in enumerate(CORNERS):
        w = F.lit(1.0)
        for c, n in zip(o, "xyz"):
            w = w * (F.col(f"f{n}") if c else 1.0 - F.col(f"f{n}"))
        out = out + w * corners[i]
    return out


def bases_of(points: DataFrame, *keep: str) -> DataFrame:
    """The cell x, y, z of points (px, py, pz in voxels; clamped at 0) and the place fx, fy, fz in it."""
    return points.select(*keep, *[F.greatest(F.lit(0), F.floor(f"p{n}")).cast("int").alias(n) for n in "xyz"], *[(F.col(f"p{n}") - F.floor(f"p{n}")).alias(f"f{n}") for n in "xyz"])


def trilinear(points: DataFrame, voxels: DataFrame, empty: float) -> DataFrame:
    """Values at points (id, px, py, pz in voxels)."""
    return corner_values(bases_of(points, "id"), voxels, empty).select("id", blended(F.col("corners")).alias("value"))


#: The 32 voxels around a cell that a gradient reads: at most one axis leaves {0, 1}.
STENCIL = [o for o in itertools.product((-1, 0, 1, 2), repeat=3) if sum(c in (-1, 2) for c in o) <= 1]


def gradients(points: DataFrame, padded: DataFrame, empty: float, size: int, dim: float) -> DataFrame:
    """At points (id, px, py, pz in voxels) central differences, weighted trilinearly over
    STENCIL, with indices clamped to the map; scaled by half a voxel's edge, as in the original."""

    def work(stack: np.ndarray, which: np.ndarray, at: dict) -> list[pa.Array]:
        own, f = [at[n] for n in "xyz"], [at[f"f{n}"] for n in "xyz"]
        linear = [{-1: 0.0 * c, 0: 1.0 - c, 1: c, 2: 0.0 * c} for c in f]
        across = [{-1: c - 1.0, 0: -c, 1: 1.0 - c, 2: c} for c in f]
        sums = [np.zeros(len(which)) for _ in range(3)]
        for o in STENCIL:
            value = stack[which, bricks.places(*(np.clip(c + d, 0, size - 1) for c, d in zip(own, o)), own)]
            value = np.where(np.isnan(value), empty, value)
            for k in range(3):
                w = across[k][o[k]]
                for j in range(3):
                    if j != k:
                        w = w * linear[j][o[j]]
                sums[k] += w * value
        return [pa.array(s * (0.5 * dim / size)) for s in sums]

    base = bases_of(points, "id")
    return bricks.read(base, padded, work, [*"xyz", "fx", "fy", "fz"], "gx double, gy double, gz double").select("id", "gx", "gy", "gz")


def gradient(points: DataFrame, voxels: DataFrame, empty: float, size: int, dim: float) -> DataFrame:
    """N6 of voxels (x, y, z, value)."""
    return gradients(points, bricks.padded(voxels), empty, size, dim)


def case_index(cells: DataFrame, inside) -> DataFrame:
    """Cells (id, corners: NULL where never observed) to the 8-bit case; 0 if a corner was
    never observed."""
    whole = ~F.exists("corners", lambda c: c.isNull())
    bits = F.lit(0)
    for i in range(8):
        bits = bits + F.when(inside(F.col("corners")[i]), 1 << i).otherwise(0)
    return cells.withColumn("case", F.when(whole, bits).otherwise(0).cast("int"))


def crossings(cells: DataFrame) -> DataFrame:
    """R7's vertices: per cell (id, x, y, z, corners, case) and edge with a sign change, the zero
    crossing on that edge."""
    edges = F.array(*[F.struct(F.lit(e).alias("edge"), F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.lit(float(CORNERS[a][k])).alias(f"s{n}") for k, n in enumerate("xyz")], *[F.lit(float(CORNERS[b][k] - CORNERS[a][k])).alias(f"d{n}") for k, n in enumerate("xyz")]) for e, (a, b) in enumerate(EDGES)])
    rows = cells.where("`case` > 0 and `case` < 255").select("id", "x", "y", "z", "corners", F.explode(edges).alias("e"))
    v1, v2 = F.element_at("corners", F.col("e.a") + 1), F.element_at("corners", F.col("e.b") + 1)
    rows = rows.withColumns({"v1": v1, "v2": v2}).where((F.col("v1") < 0) != (F.col("v2") < 0))
    t = (0.0 - F.col("v1")) / (F.col("v2") - F.col("v1"))
    return rows.select("id", "e.edge", *[(F.col(n) + F.col(f"e.s{n}") + t * F.col(f"e.d{n}")).alias(f"v{n}") for n in "xyz"])


def inside_negative(v: Column) -> Column:
    return v < 0


@cache
def case_triangles(case: int) -> list[tuple[int, int, int]]:
    """Triangles (triples of edges) of a case, by rule: on each face of the cell, edges with
    a sign change are joined around single inside corners, which gives closed loops; each loop is
    turned to face outward and cut into a fan. Neighbours agree, as a face decides alone."""
    inside = [bool(case >> i & 1) for i in range(8)]
    at = {frozenset(e): k for k, e in enumerate(EDGES)}
    beside: dict[int, list[int]] = {}
    for axis in range(3):
        for side in (0, 1):
            a, b = (k for k in range(3) if k != axis)
            ring = sorted((i for i in range(8) if CORNERS[i][axis] == side), key=lambda i: (CORNERS[i][a], CORNERS[i][b] if CORNERS[i][a] == 0 else 1 - CORNERS[i][b]))
            cut = [at[frozenset((ring[k], ring[(k + 1) % 4]))] if inside[ring[k]] != inside[ring[(k + 1) % 4]] else None for k in range(4)]
            used = [e for e in cut if e is not None]
            pairs = [used] if len(used) == 2 else [[cut[k - 1], cut[k]] for k in range(4) if inside[ring[k]]] if used else []
            for x, y in pairs:
                beside.setdefault(x, []).append(y)
                beside.setdefault(y, []).append(x)
    out, left = [], set(beside)
    while left:
        loop = [min(left)]
        before = None
        while True:
            step = next((e for e in beside[loop[-1]] if e != before and (e not in loop or e == loop[0] and len(loop) > 2)), None)
            before = loop[-1]
            if step is None or step == loop[0]:
                break
            loop.append(step)
        left -= set(loop)
        middle = [[(CORNERS[EDGES[e][0]][k] + CORNERS[EDGES[e][1]][k]) / 2 for k in range(3)] for e in loop]
        normal, outward = [0.0] * 3, [0.0] * 3
        for p, q in zip(middle, middle[1:] + middle[:1]):
            for k in range(3):
                i, j = (k + 1) % 3, (k + 2) % 3
                normal[k] += p[i] * q[j] - p[j] * q[i]
        for e in loop:
            a, b = EDGES[e] if inside[EDGES[e][0]] else EDGES[e][::-1]
            outward = [o + CORNERS[b][k] - CORNERS[a][k] for k, o in enumerate(outward)]
        if sum(n * o for n, o in zip(normal, outward)) < 0:
            loop = loop[:1] + loop[:0:-1]
        out += [(loop[0], loop[k], loop[k + 1]) for k in range(1, len(loop) - 1)]
    return out


def triangles(cells: DataFrame, size: int) -> DataFrame:
    """Id, tri and the corner points v0, v1, v2 of the surface triangles of cells
    (id, x, y, z, corners, case), in voxels; triangles with a coordinate of 0 or less, or past the
    map, go. The table of cases has a row a triangle and is broadcast."""
    rows = [(case, k, *t) for case in range(1, 255) for k, t in enumerate(case_triangles(case))]
    known = F.broadcast(cells.sparkSession.createDataFrame(rows, "`case` int, tri int, e0 int, e1 int, e2 int"))
    points = F.map_from_entries(F.collect_list(F.struct("edge", F.struct(*[F.col(f"v{n}").alias(n) for n in "xyz"]))))
    found = crossings(cells).groupBy("id").agg(points.alias("at"))
    met = cells.select("id", "case").join(known, "case").join(found, "id")
    out = met.select("id", "tri", *[F.element_at("at", F.col(f"e{k}")).alias(f"v{k}") for k in range(3)])
    for k in range(3):
        for n in "xyz":
            out = out.where((F.col(f"v{k}")[n] > 0) & (F.col(f"v{k}")[n] <= size))
    return out


def raycast(rays: DataFrame, padded: DataFrame, depth: int, size: int, walk, empty: float = 1.0, far: float | None = None) -> DataFrame:
    """ray_id, the distance t and place x, y, z of the hit of each ray (bundle, ray_id,
    ox..oz, dx..dz of length 1, in voxels) that ``walk`` (see ``bricks.fixed`` and ``bricks.stepping``)
    finds. Rays end where they leave the map of edge ``size``, or at ``far``; ``depth``: of the octree
    of the padded bricks."""
    leave = []
    for n in "xyz":
        o, d = F.col(f"o{n}"), F.col(f"d{n}")
        leave.append(F.when(d != 0, F.greatest(F.try_divide(-o, d), F.try_divide(size - o, d))))
    end = F.greatest(F.lit(0.0), F.coalesce(F.least(*leave), F.lit(0.0)))
    rays = rays.withColumn("far", end if far is None else F.least(end, F.lit(far)))
    blocks = padded.select(F.struct(*bricks.BLOCK).alias("key"), *[(F.col(f"b{n}") * bricks.SIDE).alias(n) for n in "xyz"])
    met = geometry.ray_blocks(rays, blocks, F.col("far"), depth, ("bundle",)).select("bundle", "key.*").distinct()
    found = bricks.walked(rays, padded, met, walk, empty)
    return found.join(rays, "ray_id").select("ray_id", "t", *[(F.col(f"o{n}") + F.col("t") * F.col(f"d{n}")).alias(n) for n in "xyz"])


def with_normals(hits: DataFrame, padded: DataFrame, empty: float, size: int, dim: float, inward: bool) -> DataFrame:
    """Surface normals of hits (ray_id, t, x, y, z); NULL where the field is flat."""
    g = gradients(hits.select(F.col("ray_id").alias("id"), *[F.col(n).alias(f"p{n}") for n in "xyz"]), padded, empty, size, dim)
    norm = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz")) * (-1.0 if inward else 1.0)
    return hits.join(g.select(F.col("id").alias("ray_id"), *[F.when(norm != 0, F.col(f"g{n}") / norm).alias(f"n{n}") for n in "xyz"]), "ray_id")


#: Pixels along an edge of the tile whose rays go together.
BUNDLE = 16


def pixel_rays(poses: DataFrame, camera) -> DataFrame:
    """The rays of all pixels of posed images (frame, POSE: world from camera): ray_id, bundle,
    frame, u, v, origin and direction of length 1, in metres."""
    pixels = poses.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(camera.width - 1)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(camera.height - 1))))
    x, y = (F.col("u") - camera.cx) / camera.fx, (F.col("v") - camera.cy) / camera.fy
    d = [F.col(f"m{r}0") * x + F.col(f"m{r}1") * y + F.col(f"m{r}2") for r in range(3)]
    pixels = pixels.withColumns({f"e{n}": c for n, c in zip("xyz", d)})
    norm = F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez"))
    ray = (F.col("frame").cast("long") * camera.height + F.col("v")) * camera.width + F.col("u")
    across, down = -(-camera.width // BUNDLE), -(-camera.height // BUNDLE)
    bundle = (F.col("frame").cast("long") * down + F.floor(F.col("v") / BUNDLE)) * across + F.floor(F.col("u") / BUNDLE)
    return pixels.select(ray.alias("ray_id"), bundle.alias("bundle"), "frame", "u", "v", *[F.col(f"m{r}3").alias(f"o{n}") for r, n in enumerate("xyz")], *[(F.col(f"e{n}") / norm).alias(f"d{n}") for n in "xyz"])


def triangle_attributes(triangles: DataFrame) -> DataFrame:
    """Id with the normal of length 1 (NULL if there is none), area and bounding box of
    triangles (id, v0, v1, v2: structs x, y, z)."""
    a, b = ({n: F.col(f"v{k}")[n] - F.col("v0")[n] for n in "xyz"} for k in (1, 2))
    cross = {"x": a["y"] * b["z"] - a["z"] * b["y"], "y": a["z"] * b["x"] - a["x"] * b["z"], "z": a["x"] * b["y"] - a["y"] * b["x"]}
    out = triangles.withColumns({f"k{n}": c for n, c in cross.items()})
    norm = F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky") + F.col("kz") * F.col("kz"))
    bounds = [f(*[F.col(f"v{k}")[n] for k in range(3)]).alias(f"{s}{n}") for s, f in (("lo_", F.least), ("hi_", F.greatest)) for n in "xyz"]
    return out.select("id", *[F.try_divide(F.col(f"k{n}"), norm).alias(f"n{n}") for n in "xyz"], (norm / 2.0).alias("area"), *bounds)


#: Multiplier, shift and modulus of the numbers in [0, 1) that sample k has: place, u and v.
DRAWS = ((7_919, 13, 10_007), (104_729, 7, 9_973), (1_299_709, 3, 9_949))


def surface_samples(triangles: DataFrame, n: int) -> DataFrame:
    """N points of a surface of triangles (id, v0, v1, v2: structs x, y, z), evenly by area: k, id
    and x, y, z. Sample k lies in the k-th n-th of the running area, at a place drawn by a
    rule; a triangle finds its own samples from where its area begins and ends, so nothing is
    joined. Inside a triangle the point is uniform: weights past the diagonal are turned back."""
    area = triangle_attributes(triangles).select("id", "area").where("area > 0")
    placed = stats.checkpointed(stats.running(area, "id", "area", "upto"))
    whole = placed.agg(F.max("upto").alias("whole"))
    rows = placed.crossJoin(F.broadcast(whole))  # one row
    k = F.col("k")
    draw = [((k * a + b) % m) / float(m) for a, b, m in DRAWS]
    low, high = (F.floor(c / F.col("whole") * n).cast("long") for c in (F.col("upto") - F.col("area"), F.col("upto")))
    rows = rows.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), low - 1), F.least(F.lit(n - 1), high + 1))))
    at = (k + draw[0]) / float(n) * F.col("whole")
    # the next triangle begins where this one ends, whatever the sums' last bits
    rows = rows.withColumn("from", F.col("upto") - F.col("area")).where((at >= F.col("from")) & (at < F.col("upto")))
    one = rows.groupBy("k").agg(F.min("id").alias("id"))
    u, v = draw[1], draw[2]
    turned = u + v > 1
    u, v = F.when(turned, 1.0 - u).otherwise(u), F.when(turned, 1.0 - v).otherwise(v)
    point = [(u * F.col("v0")[c] + v * F.col("v1")[c] + (1.0 - (u + v)) * F.col("v2")[c]).alias(c) for c in "xyz"]
    return one.join(triangles.select("id", "v0", "v1", "v2"), "id").select("k", "id", *point)
