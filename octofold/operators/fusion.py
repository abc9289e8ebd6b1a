"""Depth frames fused into voxels: projection, per-frame updates and folds over frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octofold.functions import keys


@dataclass(frozen=True)
class Camera:
    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int


#: The columns of a rigid transform, row by row: rotation, then translation.
POSE = [f"m{r}{c}" for r in range(3) for c in range(4)]


def moved(point: list[Column]) -> list[Column]:
    """A point under the transform in the columns POSE of its row."""
    return [F.col(f"m{r}0") * point[0] + F.col(f"m{r}1") * point[1] + F.col(f"m{r}2") * point[2] + F.col(f"m{r}3") for r in range(3)]


def inverse(poses: DataFrame) -> DataFrame:
    """M6: rigid transforms turned round; other columns are kept."""
    rotation = {f"m{r}{c}": F.col(f"m{c}{r}") for r in range(3) for c in range(3)}
    shift = {f"m{r}3": -(F.col(f"m0{r}") * F.col("m03") + F.col(f"m1{r}") * F.col("m13") + F.col(f"m2{r}") * F.col("m23")) for r in range(3)}
    return poses.select(*[c for c in poses.columns if c not in POSE], *[{**rotation, **shift}[c].alias(c) for c in POSE])


#: Small cells along an edge of a large one.
STRIDE = 4


def in_view(cells: DataFrame, camera: Camera, voxel_size: float, cell: int) -> DataFrame:
    """The cells (frame, POSE, cx, cy, cz) of ``cell`` voxels that reach into the view's four planes."""
    centre = moved([(F.col(f"c{n}") + 0.5) * (cell * voxel_size) for n in "xyz"])
    named = cells.select("frame", *POSE, "cx", "cy", "cz", *[c.alias(f"p{n}") for c, n in zip(centre, "xyz")])
    reach = cell * voxel_size * 3**0.5 / 2 + 2 * voxel_size
    near = F.col("pz") >= -reach
    for axis, f, c, size in (("px", camera.fx, camera.cx, camera.width), ("py", camera.fy, camera.cy, camera.height)):
        for edge in (c, c - size):
            inward = (F.col(axis) * f + F.col("pz") * edge) * (1 if edge == c else -1) * (1 if f > 0 else -1)
            near = near & (inward >= -reach * (f * f + edge * edge) ** 0.5)
    return named.where(near).drop("px", "py", "pz")


def seen_by(voxels: DataFrame, poses: DataFrame, camera: Camera, voxel_size: float, cell: int = 16) -> DataFrame:
    """Voxels with the frames (frame, POSE: camera from world) that may see them. A frame names
    the coarse cells that reach into the four planes of its view, large ones first; voxels meet it there."""
    span = voxels.agg(*[f(F.floor(F.col(n) / (STRIDE * cell))).cast("int").alias(f"{k}{n}") for n in "xyz" for k, f in (("lo", F.min), ("hi", F.max))])
    named = poses.crossJoin(F.broadcast(span.where("lox is not null")))  # one row
    for n in "xyz":
        named = named.withColumn(f"c{n}", F.explode(F.sequence(f"lo{n}", f"hi{n}")))
    named = in_view(named.select("frame", *POSE, "cx", "cy", "cz"), camera, voxel_size, STRIDE * cell)
    for n in "xyz":  # only where a large cell is in view, its small ones
        named = named.withColumn(f"c{n}", F.explode(F.sequence(F.col(f"c{n}") * STRIDE, F.col(f"c{n}") * STRIDE + STRIDE - 1)))
    named = in_view(named, camera, voxel_size, cell)
    placed = voxels.withColumns({f"c{n}": F.floor(F.col(n) / cell).cast("int") for n in "xyz"})
    return placed.join(named, ["cx", "cy", "cz"]).drop("cx", "cy", "cz")


def in_frustum(blocks: DataFrame, camera: Camera, voxel_size: float) -> DataFrame:
    """Blocks (x, y, z, POSE) whose corner's pixel, cut to whole numbers, lies in the image;
    as in the original, depth has no sign here."""
    p = moved([F.col(n) * voxel_size for n in "xyz"])
    at = blocks.withColumns({"pu": p[0] * camera.fx + p[2] * camera.cx, "pv": p[1] * camera.fy + p[2] * camera.cy, "pz": p[2]})
    at = at.withColumns({n: F.try_divide(f"p{n}", "pz").try_cast("int") for n in "uv"})
    return at.where(F.col("u").between(0, camera.width - 1) & F.col("v").between(0, camera.height - 1)).drop("pu", "pv", "pz")


def node_slots(nodes: DataFrame, depth: int) -> DataFrame:
    """The eight places (child, x, y, z) of interior nodes (key, x, y, z, level)."""
    half = F.call_function("shiftleft", F.lit(1), (F.lit(depth - 1) - F.col("level")).cast("int"))
    slots = nodes.select("key", "x", "y", "z", half.alias("half"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("child"))
    return slots.select("key", "child", *[(F.col(n) + F.shiftright("child", i).bitwiseAND(F.lit(1)) * F.col("half")).cast("int").alias(n) for i, n in enumerate("xyz")])


def project(voxels: DataFrame, camera: Camera, voxel_size: float) -> DataFrame:
    """Voxel corners (x, y, z as INT, with POSE if the camera is not at the origin) in camera space
    (px, py, pz in metres) with the pixel (u, v) they fall on; P4: in front of the camera and half
    a pixel inside the image."""
    place = [F.col(n) * voxel_size for n in "xyz"]
    place = moved(place) if "m00" in voxels.columns else place
    at = voxels.withColumns({f"p{n}": c for c, n in zip(place, "xyz")}).where("pz >= 1e-4")
    at = at.withColumns({f"f{n}": F.try_divide(F.col(f"p{a}") * f, "pz") + c + 0.5 for n, a, f, c in (("u", "x", camera.fx, camera.cx), ("v", "y", camera.fy, camera.cy))})
    seen = at.where(F.col("fu").between(0.5, camera.width - 1.5) & F.col("fv").between(0.5, camera.height - 1.5))
    return seen.withColumns({n: F.floor(f"f{n}").try_cast("int") for n in "uv"}).drop("fu", "fv")


def observe(voxels: DataFrame, image: DataFrame, camera: Camera, voxel_size: float, by: list[str] | None = None) -> DataFrame:
    """Voxels with the depth at their pixel; an equality join on the computed pixel."""
    return project(voxels, camera, voxel_size).join(image, [*(by or []), "u", "v"])


def observe_frames(voxels: DataFrame, poses: DataFrame, image: DataFrame, camera: Camera, voxel_size: float) -> DataFrame:
    """J4 for all frames of ``image`` (frame, u, v, depth) from their ``poses`` (frame, POSE): frames seen
    from one pose share its projection, so a voxel is projected once a pose, and each pixel is
    joined to what its pose sees there."""
    views = poses.groupBy(*POSE).agg(F.min("frame").alias("view"))
    seen = project(seen_by(voxels, views.withColumnRenamed("view", "frame"), camera, voxel_size), camera, voxel_size)
    pixels = image.join(poses.join(views, POSE).select("frame", "view"), "frame")
    return pixels.join(seen.withColumnRenamed("frame", "view").drop(*POSE), ["view", "u", "v"]).drop("view")


def distance_along_ray() -> Column:
    """Signed distance of the measured surface in front of the voxel."""
    x, y = F.col("px") / F.col("pz"), F.col("py") / F.col("pz")
    return (F.col("depth") - F.col("pz")) * F.sqrt(F.lit(1.0) + x * x + y * y)


def tsdf(diff: Column, mu: float) -> Column:
    return F.least(F.lit(1.0), diff / mu)


def sdf_step(x: Column, w: Column, sdf: Column, most: float = 100.0) -> tuple[Column, Column]:
    """The running mean with a saturating weight."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (w * x + sdf) / (w + 1.0))), F.least(w + 1.0, F.lit(most))


def fold_sdf(observations: DataFrame, by: list[str], order: str, mu: float, prior: DataFrame | None = None, most: float | None = 100.0) -> DataFrame:
    """Observations (diff) of each voxel folded in frame order from (1, 0), or from what the
    voxel has in ``prior`` (by, x, w), with weights of ``most`` at most. The list of a voxel holds one
    entry a frame; without a limit of weights the fold is the mean, whatever the order, and needs none."""
    kept = observations.where((F.col("depth") > 0) & (F.col("diff") > -mu))
    if most is None and prior is None:
        return kept.groupBy(*by).agg(F.avg(tsdf(F.col("diff"), mu)).alias("x"), F.count("*").cast("double").alias("w"))
    lists = kept.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, tsdf(F.col("diff"), mu).alias("s")))).alias("l"))

    def step(a: Column, o: Column) -> Column:
        x, w = sdf_step(a["x"], a["w"], o["s"], float("inf") if most is None else most)
        return F.struct(x.alias("x"), w.alias("w"))

    x, w = F.lit(1.0), F.lit(0.0)
    if prior is not None:
        lists = lists.join(prior.select(*by, F.col("x").alias("x0"), F.col("w").alias("w0")), by, "left")
        x, w = F.coalesce("x0", x), F.coalesce("w0", w)
    start = F.struct(x.alias("x"), w.alias("w"))
    return lists.select(*by, F.aggregate("l", start, step).alias("a")).select(*by, "a.x", "a.w")


def spline(t: Column) -> Column:
    """Cumulative cubic spline on [-3, 3]."""
    p = lambda c, k: F.pow(c, F.lit(float(k)))
    inner = F.when(t <= -1.0, p(3.0 + t, 3) / 48.0).when(t <= 1.0, 0.5 + t * (3.0 + t) * (3.0 - t) / 24.0).otherwise(1.0 - p(3.0 - t, 3) / 48.0)
    return F.when(t <= -3.0, 0.0).when(t >= 3.0, 1.0).otherwise(inner)


def occupancy(t: Column) -> Column:
    """Probability that the voxel is occupied, by the distance in noise units."""
    return spline(t) - 0.5 * spline(t - 3.0)


def noise(z: Column, voxel_size: float, factor: float = 0.01) -> Column:
    return F.greatest(F.lit(2.0 * voxel_size), F.least(z * z * factor, F.lit(0.05)))


def log_odds(s: Column) -> Column:
    """What an observation adds."""
    clamped = F.greatest(F.lit(0.03), F.least(F.lit(0.97), s))
    return F.log2(clamped / (1.0 - clamped))


def log_odds_step(x: Column, seconds: Column, odds: Column, tau: float = 4.0) -> Column:
    """Decay by the time since the last update, then add the log odds."""
    decayed = x * F.greatest(F.lit(0.5), 1.0 / (1.0 + seconds / tau))
    return F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), decayed + odds))


def fold_occupancy(observations: DataFrame, by: list[str], time: str) -> DataFrame:
    """D14 for occupancy: observations (time, s) folded in time order; s = 1/2 is no news."""
    kept = observations.where("s <> 0.5").select(*by, F.col(time).cast("double").alias("t"), log_odds(F.col("s")).alias("odds"))
    lists = kept.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t", "odds"))).alias("l"))

    def step(a: Column, o: Column) -> Column:
        gap = F.when(a["n"] == 0, 0.0).otherwise(o["t"] - a["t"])
        return F.struct(log_odds_step(a["x"], gap, o["odds"]).alias("x"), o["t"].alias("t"), (a["n"] + 1).alias("n"))

    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("t"), F.lit(0).alias("n"))
    return lists.select(*by, F.aggregate("l", start, step).alias("a")).select(*by, "a.x", "a.n")


def back_projected(image: DataFrame, camera: Camera) -> DataFrame:
    """The measured point of each pixel centre in camera space (wx, wy, wz) and its distance."""
    z = F.col("depth")
    hit = image.where("depth > 0").withColumns({"wx": (F.col("u") + 0.5 - camera.cx) / camera.fx * z, "wy": (F.col("v") + 0.5 - camera.cy) / camera.fy * z, "wz": z})
    return hit.withColumn("norm", F.sqrt(F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy") + F.col("wz") * F.col("wz")))


def on_ray(walk: DataFrame, behind: Column, voxel_size: float) -> list[Column]:
    """The voxel on a pixel's ray so far behind its measured point; with POSE (world from camera)
    in world space."""
    place = [F.col(f"w{n}") * (1.0 + behind / F.col("norm")) for n in "xyz"]
    place = moved(place) if "m00" in walk.columns else place
    return [F.floor(c / voxel_size).cast("int").alias(n) for c, n in zip(place, "xyz")]


def band_points(image: DataFrame, camera: Camera, voxel_size: float, mu: float) -> DataFrame:
    """Sample points of a band of 2 mu around each measured point, from its far end towards
    the camera in steps of a voxel: the image's columns, step and the voxel x, y, z (inside or
    outside a map)."""
    steps = int(-(-2 * mu // voxel_size))
    walk = back_projected(image, camera).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    keep = [c for c in image.columns if c not in POSE and c != "depth"]
    return walk.select(*keep, "step", *on_ray(walk, mu - F.col("step") * (2 * mu / steps), voxel_size))


def step_schedule(voxel_size: float, band: float, depth: int) -> tuple[list[tuple[float, int]], float]:
    """The (distance travelled, octree level) of the steps of a voxel within the band
    and of ten voxels within half a band more, and where the steps of thirty voxels begin. A
    place has the level of the step that led to it, at most block level."""
    out, travelled, level = [], 0.0, depth
    while travelled < 1.5 * band:
        out.append((travelled, min(level, depth - 3)))
        size, level = (1, depth) if travelled < band else (10, depth - 4)
        travelled += size * voxel_size
    out.append((travelled, min(level, depth - 3)))
    return out, travelled + 30 * voxel_size


def octant_points(image: DataFrame, camera: Camera, voxel_size: float, band: float, depth: int) -> DataFrame:
    """From half a band behind each measured point towards the camera in growing steps: the
    voxel x, y, z of each step and the level of the octant to allocate there."""
    hit = back_projected(image, camera)
    fixed, first = step_schedule(voxel_size, band, depth)
    stride = 30 * voxel_size
    near = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(level).alias("level")) for t, level in fixed])
    more = F.greatest(F.lit(-1), F.floor((F.col("norm") + band / 2 - first) / stride).cast("int"))
    far = F.when(more >= 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), more)), lambda k: F.struct((first + k * stride).alias("t"), F.lit(depth - 5).alias("level"))))
    walk = hit.withColumn("s", F.explode(F.concat(near, F.coalesce(far, F.slice(near, 1, 0))))).where(F.col("s.t") < F.col("norm") + band / 2)
    keep = [c for c in image.columns if c not in POSE and c != "depth"]
    return walk.select(*keep, "s.t", "s.level", *on_ray(walk, band / 2 - F.col("s.t"), voxel_size))


def visible_blocks(observed: DataFrame) -> DataFrame:
    """By block (key) and frame whether any of its voxels was seen: the new active flag."""
    return observed.groupBy("frame", "key").agg(F.count("*").alias("n_seen"))


def in_volume(size: int) -> Column:
    """P10."""
    return F.col("x").between(0, size - 1) & F.col("y").between(0, size - 1) & F.col("z").between(0, size - 1)


def integrated(frame: Column, rate: int) -> Column:
    """Every ``rate``-th frame, and the first four."""
    return (frame % rate == 0) | (frame <= 3)


def integrate(image: DataFrame, poses: DataFrame, back: DataFrame, camera: Camera, voxel_size: float, mu: float, depth: int, rate: int, prior: DataFrame | None = None, most: float | None = 100.0) -> DataFrame:
    """The frames (frame, u, v, depth) that the rate lets through allocate the blocks of their
    bands and then update, in order, every voxel of all blocks that they see: key, x, y, z, value
    and weight of these. ``poses``: camera from world by frame, ``back``: world from camera; ``prior``:
    the map so far, whose blocks are seen too; ``most``: the limit of weights."""
    image = image.where(integrated(F.col("frame"), rate))
    band = band_points(image.join(back, "frame"), camera, voxel_size, mu).where(in_volume(1 << depth))
    corner = [(F.col(n) - F.col(n) % 8).alias(f"b{n}") for n in "xyz"]
    block = band.select(*corner)
    block = (block if prior is None else block.unionByName(prior.select(*corner))).distinct()
    voxels = keys.held(block, "bx", "by", "bz", key=keys.block_key("bx", "by", "bz", depth))
    for n in "xyz":
        voxels = voxels.withColumn(n, F.explode(F.sequence(F.col(f"b{n}"), F.col(f"b{n}") + 7)))
    used = image.select("frame").distinct().join(poses, "frame")
    seen = observe_frames(voxels.select("key", "x", "y", "z"), used, image, camera, voxel_size)
    before = None if prior is None else prior.select("key", F.col("x").alias("vx"), "y", "z", F.col("value").alias("x"), F.col("weight").alias("w"))
    folded = fold_sdf(seen.withColumn("diff", distance_along_ray()).withColumnRenamed("x", "vx"), ["key", "vx", "y", "z"], "frame", mu, before, most)
    return folded.select("key", F.col("vx").alias("x"), "y", "z", F.col("x").alias("value"), F.col("w").alias("weight"))
