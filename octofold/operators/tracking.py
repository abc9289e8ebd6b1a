"""Frame-to-model alignment: association, the 32 sums, and the small solve at the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octofold.operators import fusion

#: Shortest step, largest error and smallest share of pixels of a tracked pose.
LEAST, MOST_ERROR, LEAST_SHARE = 1e-5, 0.02, 0.15
#: T4: rounds on each level, from fine to coarse.
ROUNDS = (10, 5, 4)
VERTEX = ("x", "y", "z", "nx", "ny", "nz")


def associate(live: DataFrame, model: DataFrame, camera: fusion.Camera, far: float = 0.1, least_dot: float = 0.8, by: tuple[str, ...] = ()) -> DataFrame:
    """Live vertices and normals (u, v, x, y, z, nx, ny, nz), moved by the transform in
    their columns POSE into the model's space and projected with its camera, against the model's
    vertices and normals at that pixel: result 1 or the reason for rejection, the error and its
    six derivatives. ``by``: columns that name the pair of images."""
    place = fusion.moved([F.col(n) for n in "xyz"])
    normal = [F.col(f"m{r}0") * F.col("nx") + F.col(f"m{r}1") * F.col("ny") + F.col(f"m{r}2") * F.col("nz") for r in range(3)]
    at = live.select(*by, "u", "v", *[c.alias(f"p{n}") for c, n in zip(place, "xyz")], *[c.alias(f"q{n}") for c, n in zip(normal, "xyz")])
    at = at.withColumns({"fu": F.try_divide("px", "pz") * camera.fx + camera.cx + 0.5, "fv": F.try_divide("py", "pz") * camera.fy + camera.cy + 0.5})
    seen = F.col("fu").between(0, camera.width - 1) & F.col("fv").between(0, camera.height - 1)
    at = at.withColumns({f"r{n}": F.when(seen, F.floor(f"f{n}").try_cast("int")) for n in "uv"})
    m = model.select(*by, F.col("u").alias("ru"), F.col("v").alias("rv"), *[F.col(n).alias(f"m{n}") for n in ("x", "y", "z", "nx", "ny", "nz")])
    both = at.join(m, [*by, "ru", "rv"], "left")
    p, n = [F.col(f"p{k}") for k in "xyz"], [F.col(f"mn{k}") for k in "xyz"]
    d = [F.col(f"m{k}") - c for k, c in zip("xyz", p)]
    gap = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    dot = F.col("qx") * n[0] + F.col("qy") * n[1] + F.col("qz") * n[2]
    result = F.when(F.col("qx").isNull(), -1).when(F.col("ru").isNull(), -2).when(F.col("mnx").isNull(), -3).when(gap > far, -4).when(dot < least_dot, -5).otherwise(1)
    cross = [p[1] * n[2] - p[2] * n[1], p[2] * n[0] - p[0] * n[2], p[0] * n[1] - p[1] * n[0]]
    j = {f"j{i}": c for i, c in enumerate([*n, *cross])}
    return both.select(*by, "u", "v", result.alias("result"), (n[0] * d[0] + n[1] * d[1] + n[2] * d[2]).alias("e"), *[c.alias(k) for k, c in j.items()])


def reduce_sums(track: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A1: squared error, J'e (6), upper triangle of J'J (21), counts; one pass, partial sums."""
    ok = F.col("result") == 1
    s = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0.0))
    count = lambda c: F.count(F.when(c, 1))
    sums = [s(F.col("e") * F.col("e")).alias("ee")]
    sums += [s(F.col("e") * F.col(f"j{i}")).alias(f"b{i}") for i in range(6)]
    sums += [s(F.col(f"j{i}") * F.col(f"j{k}")).alias(f"a{i}{k}") for i in range(6) for k in range(i, 6)]
    sums += [count(ok).alias("n"), count(F.col("result") == -4).alias("n4"), count(F.col("result") == -5).alias("n5"), count((F.col("result") > -4) & ~ok).alias("n_other")]
    return track.groupBy(*by).agg(*sums)


def corrected(sums: DataFrame, poses: DataFrame, by: str) -> DataFrame:
    """M6, M7: each image's pose (by, POSE) after the step that its sums give, and the step's
    length; a small solve for each row, in tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for row in rows.to_dict("records"):
                x = solve(row)
                pose = np.eye(4)
                pose[:3] = np.array([row[c] for c in fusion.POSE], float).reshape(3, 4)
                out.append([row[by], *(exponential(x) @ pose)[:3].ravel(), float(np.linalg.norm(x))])
            yield pd.DataFrame(out, columns=[by, *fusion.POSE, "length"])

    return poses.join(sums, by).mapInPandas(run, f"{by} int, {', '.join(f'{c} double' for c in fusion.POSE)}, length double")


def coarse_to_fine(live: list[DataFrame], model: list[DataFrame], cameras: list[fusion.Camera], poses: DataFrame, rounds: list[int], by: str, checkpoint, **gates: float) -> DataFrame:
    """T4: aligns all pairs of images at once; lists go from fine to coarse. Each round is one
    join and one aggregate; a pair whose step got shorter than LEAST keeps its pose on that level.
    Returns by, POSE and the last sums' P12 verdict (tracked); who fails goes back to the first pose."""
    sums, first = None, poses
    for level in reversed(range(len(live))):
        open_ = poses.withColumn("length", F.lit(1.0))
        for _ in range(rounds[level]):
            placed = live[level].join(poses, by)
            sums = reduce_sums(associate(placed, model[level], cameras[level], by=(by,), **gates), (by,))
            fresh = corrected(sums, poses, by)
            still = open_.select(by, F.col("length").alias("before"))
            turn = fresh.join(still, by)
            kept = poses.select(by, *[F.col(c).alias(f"old_{c}") for c in fusion.POSE])
            choose = [F.when(F.col("before") >= LEAST, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in fusion.POSE]
            length = F.when(F.col("before") >= LEAST, F.col("length")).otherwise(0.0).alias("length")
            open_ = checkpoint(turn.join(kept, by).select(by, *choose, length))
            poses = open_.select(by, *fusion.POSE)
    pixels = cameras[0].width * cameras[0].height
    good = (F.col("n") > 0) & (F.sqrt(F.try_divide("ee", "n")) <= MOST_ERROR) & (F.col("n") >= LEAST_SHARE * pixels)
    done = poses.join(sums.select(by, "n", "ee"), by, "left").withColumn("tracked", F.coalesce(good, F.lit(False)))
    back = first.select(by, *[F.col(c).alias(f"old_{c}") for c in fusion.POSE])
    return done.join(back, by).select(by, *[F.when(F.col("tracked"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in fusion.POSE], "tracked")


def beside(levels: list[DataFrame], by: str, step: int) -> DataFrame:
    """Of the vertices and normals of all images (by, u, v, VERTEX), by level from fine to coarse, the
    rows of each pair of an image (side 0) and the one ``step`` before it (side 1), named by the
    former; every image is read once and sent to its two pairs."""
    out = None
    for level, rows in enumerate(levels):
        roles = F.explode(F.array(*[F.struct((F.col(by) + side * step).cast("int").alias(by), F.lit(side).alias("side")) for side in (0, 1)])).alias("r")
        part = rows.where("x is not null and nx is not null").select(roles, "u", "v", *VERTEX).select(f"r.{by}", "r.side", F.lit(level).alias("level"), "u", "v", *VERTEX)
        out = part if out is None else out.unionByName(part)
    return out


def step_of(live: np.ndarray, model: np.ndarray, pose: np.ndarray, camera: fusion.Camera, far: float, least_dot: float) -> tuple[np.ndarray, float, int]:
    """J3, A1, M7 of one pair: the six-vector, the squared error and the number of pixels that count;
    ``live``: rows of VERTEX, ``model``: VERTEX by row and column, NaN where there is none."""
    p = live[:, :3] @ pose[:3, :3].T + pose[:3, 3]
    q = live[:, 3:] @ pose[:3, :3].T
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = p[:, 0] / p[:, 2] * camera.fx + camera.cx + 0.5, p[:, 1] / p[:, 2] * camera.fy + camera.cy + 0.5
    seen = (u >= 0) & (u <= camera.width - 1) & (v >= 0) & (v <= camera.height - 1)
    p, q = p[seen], q[seen]
    met = model[np.floor(v[seen]).astype(int), np.floor(u[seen]).astype(int)]
    gap, n = met[:, :3] - p, met[:, 3:]
    good = (np.sqrt((gap**2).sum(axis=1)) <= far) & ((q * n).sum(axis=1) >= least_dot)
    p, gap, n = p[good], gap[good], n[good]
    error, j = (n * gap).sum(axis=1), np.concatenate([n, np.cross(p, n)], axis=1)
    return solved(j.T @ j, j.T @ error), float(error @ error), len(p)


def align(pairs: DataFrame, cameras: list[fusion.Camera], poses: DataFrame, by: str, rounds: tuple[int, ...] = ROUNDS, far: float = 0.1, least_dot: float = 0.8) -> DataFrame:
    """T4, P12 of all pairs (see ``beside``) from their first poses (by, POSE): by, POSE, tracked. A
    pair is a group of its own, no larger than its two images, so all rounds of all levels
    take one shuffle; a pair that fails P12 goes back to its first pose."""

    def run(images: pa.Table, start: pa.Table) -> pa.Table:
        out = []
        if start.num_rows:
            pose = np.eye(4)
            pose[:3] = np.array([start.column(c)[0].as_py() for c in fusion.POSE]).reshape(3, 4)
            level, side, u, v = (images.column(c).to_numpy() for c in ("level", "side", "u", "v"))
            rows = np.stack([images.column(c).to_numpy() for c in VERTEX], axis=1).reshape(-1, 6)
            first, error, n = pose, 0.0, 0
            for k in reversed(range(len(cameras))):
                model = np.full((cameras[k].height, cameras[k].width, 6), np.nan)
                at = (level == k) & (side == 1) & (u < cameras[k].width) & (v < cameras[k].height)
                model[v[at], u[at]] = rows[at]
                at = np.nonzero((level == k) & (side == 0))[0]
                live = rows[at[np.lexsort((u[at], v[at]))]]  # sums do not depend on the order of arrival
                for _ in range(rounds[k]):
                    x, error, n = step_of(live, model, pose, cameras[k], far, least_dot)
                    pose = exponential(x) @ pose
                    if np.linalg.norm(x) < LEAST:
                        break
            good = n > 0 and (error / n) ** 0.5 <= MOST_ERROR and n >= LEAST_SHARE * cameras[0].width * cameras[0].height
            out = [(start.column(by)[0].as_py(), *((pose if good else first)[:3].ravel().tolist()), bool(good))]
        cols = list(zip(*out)) or [[]] * 14
        return pa.table({by: pa.array(cols[0], pa.int32())} | {c: pa.array(x, pa.float64()) for c, x in zip(fusion.POSE, cols[1:13])} | {"tracked": pa.array(cols[13], pa.bool_())})

    schema = f"{by} int, {', '.join(f'{c} double' for c in fusion.POSE)}, tracked boolean"
    first = poses.select(F.col(by).alias("pair"), F.col(by), *fusion.POSE)
    return pairs.groupBy(by).cogroup(first.groupBy("pair")).applyInArrow(run, schema)


def solve(row) -> np.ndarray:
    """M7 of a row of sums."""
    a = np.zeros((6, 6))
    for i in range(6):
        for k in range(i, 6):
            a[i, k] = a[k, i] = row[f"a{i}{k}"]
    return solved(a, np.array([row[f"b{i}"] for i in range(6)]))


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """M7: the six-vector of the normal equations; zero if they are not positive definite."""
    try:
        low = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return np.zeros(6)
    return np.linalg.solve(low.T, np.linalg.solve(low, b))


def exponential(x: np.ndarray) -> np.ndarray:
    """M6: the rigid transform of a six-vector, translation part first."""
    t, w = x[:3], x[3:]
    angle = float(np.linalg.norm(w))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if angle < 1e-9:
        r, v = np.eye(3) + k, np.eye(3) + k / 2
    else:
        r = np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * k @ k
        v = np.eye(3) + (1 - np.cos(angle)) / angle**2 * k + (angle - np.sin(angle)) / angle**3 * k @ k
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, v @ t
    return out


def horn(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation that take points a to points b, from the cross-covariance
    w[i, k] = sum a_i b_k and the centroids."""
    u, _, vt = np.linalg.svd(w.T)
    s = np.eye(3)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        s[2, 2] = -1
    r = u @ s @ vt
    return r, b - r @ a
