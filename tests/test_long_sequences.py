"""Sequences of so many frames that weights would saturate, against plain means."""

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from octofold.jobs import fusion_queries, registry
from octofold.operators import fusion


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    """The small tables with 300 times the events: 120 frames of full height, 30 a pose."""
    d = str(tmp_path_factory.mktemp("long"))
    n = spark.read.parquet(f"{SMALL}/events.parquet").count()
    events = spark.read.parquet(f"{SMALL}/events.parquet").crossJoin(spark.range(300_000 // n + 220_000 // n))
    events.withColumn("event_id", F.col("event_id") + F.col("id") * n).drop("id").write.parquet(f"{d}/events.parquet")
    spark.read.parquet(f"{SMALL}/lineitem.parquet").limit(300).write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["sdf_fold_frames", "integrate_frames", "sweep_runs"])
def test_means_past_a_hundred_frames(spark, long, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{long}/{t}.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = lambda rs: sorted(tuple(round(x, 3) for x in r) for r in rs)
    got, want = rows(registry.queries()[name](spark, long).select(*names).collect()), rows(want.fetchall())
    assert len(got) == len(want) > 0
    assert all(abs(x - y) < 2e-3 for g, w in zip(got, want) for x, y in zip(g, w))


def test_frames_of_one_pose_share_its_projection(spark):
    """200 frames from two poses: two projections, and each frame's own depth."""
    pose = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])
    frames = spark.range(200).select(F.col("id").cast("int").alias("frame"))
    poses = frames.select("frame", *[pose[i].alias(c) for i, c in enumerate(fusion.POSE[:11])], (F.col("frame") % 2).cast("double").alias("m23"))
    image = frames.crossJoin(spark.range(2500)).select("frame", (F.col("id") % 50).cast("int").alias("u"), F.floor(F.col("id") / 50).cast("int").alias("v"), (F.col("frame") + 0.5).alias("depth"))
    voxels = spark.range(20).select(F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("id") + 10).cast("int").alias("z"))
    camera = fusion.Camera(40.0, 40.0, 25.0, 25.0, 50, 50)
    seen = spark.sparkContext.accumulator(0)
    whole = fusion.project

    def counted(*args):
        out = whole(*args)

        def count(x, y):
            seen.add(1)
            return True

        return out.where(F.udf(count, "boolean").asNondeterministic()("px", "pz"))

    fusion.project = counted
    try:
        got = fusion.observe_frames(voxels, poses, image, camera, 0.05).select("frame", "z", "pz", "depth").collect()
    finally:
        fusion.project = whole
    assert len(got) == 200 * 20 and all(r.depth == r.frame + 0.5 and abs(r.pz - (r.z * 0.05 + r.frame % 2)) < 1e-9 for r in got)
    assert seen.value == 40


def test_rays_of_one_pose_are_cast_once(spark, long):
    """120 frames from four poses: 10,000 rays are cast, and every frame has its hits."""
    _, rays, shots = fusion_queries.pose_rays(spark, long)
    assert rays.count() == 4 * 2500 and shots.count() > 100
    hits = fusion_queries.raycast_steps(spark, long).collect()
    by = {}
    for r in hits:
        by.setdefault(r.ray_id // 2500 % 4, {}).setdefault(r.ray_id // 2500, set()).add((r.ray_id % 2500, r.t))
    assert by and all(len({frozenset(x) for x in f.values()}) == 1 and len(f) > 20 for f in by.values())
