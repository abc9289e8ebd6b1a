"""Tracking on a scene of a plane and a ball, against its true motion and against the join-based
loop; the stream of frames against one batch, also after a restart, out of order, and written twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from octofold.jobs import fusion_queries as Q
from octofold.operators import fusion, tracking
from octofold.sources import adapters
from octofold.streaming import loop

CAMERA = Q.CAMERA
HOME = np.array([[1, 0, 0, 6.4], [0, 1, 0, 6.4], [0, 0, 1, 1.0], [0, 0, 0, 1]], float)


def pose(k, side=1.0):
    """World from camera of frame k of a path."""
    a = 0.012 * k * side
    turn = np.array([[np.cos(a), 0, np.sin(a), 0], [0, 1, 0, 0], [-np.sin(a), 0, np.cos(a), 0], [0, 0, 0, 1]])
    shift = np.eye(4)
    shift[:3, 3] = [0.015 * k * side, 0.008 * k, 0.01 * k]
    return HOME @ shift @ turn


def depth_of(where):
    """Depths of a ball before a tilted wall, seen from a pose."""
    v, u = np.mgrid[0:50, 0:50]
    d = np.stack([(u - CAMERA.cx) / CAMERA.fx, (v - CAMERA.cy) / CAMERA.fy, np.ones_like(u, float)], axis=-1) @ where[:3, :3].T
    o = where[:3, 3]
    n = np.array([0.15, -0.1, -1.0])
    wall = ((np.array([6.4, 6.4, 4.2]) - o) @ n) / (d @ n)
    c, r = np.array([6.6, 6.3, 3.0]) - o, 0.7
    a, b = (d * d).sum(-1), d @ c
    root = b * b - a * (c @ c - r * r)
    ball = np.where(root > 0, (b - np.sqrt(np.maximum(root, 0))) / a, np.inf)
    return np.minimum(wall, ball)


def images(spark, poses):
    rows = []
    for frame, where in poses.items():
        z = depth_of(where)
        rows += [(frame, u, v, float(z[v, u])) for v in range(50) for u in range(50)]
    return spark.createDataFrame(rows, loop.IMAGE)


SETTINGS = loop.Settings(2, Q.levels_of, Q.CAMERAS, tuple(HOME[:3].ravel()), 0.1, 0.3, 7, far=0.3, least_dot=0.6)
#: Two sequences of four frames.
PATH = {2 * k + s: pose(k, 1.0 - 2 * s) for k in range(4) for s in (0, 1)}


@pytest.fixture(scope="module")
def table(spark):
    out = images(spark, PATH).cache()
    yield out
    out.unpersist()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def batch(spark, table):
    poses, cells = loop.whole(table, SETTINGS)
    return rows(poses), rows(cells)


def test_poses_follow_the_path(batch):
    for frame, *numbers, tracked in batch[0]:
        assert tracked == (frame > 1)
        assert np.abs(np.array(numbers).reshape(3, 4) - PATH[frame][:3]).max() < 0.03


def test_map_holds_the_surface(batch):
    """Voxels close to zero lie on the ball or the wall."""
    near = [(x * 0.1, y * 0.1, z * 0.1) for _, x, y, z, value, weight in batch[1] if abs(value) < 0.15 and weight >= 3]
    n = np.array([0.15, -0.1, -1.0])
    off = [min(abs(np.linalg.norm(np.subtract(p, (6.6, 6.3, 3.0))) - 0.7), abs((np.subtract(p, (6.4, 6.4, 4.2))) @ n) / np.linalg.norm(n)) for p in near]
    assert len(near) > 300 and np.quantile(off, 0.9) < 0.15


def test_groups_equal_joins(spark, table):
    """``align`` and the loop of joins give the same poses and verdicts, also for a pair that fails."""
    far_off = images(spark, {8: pose(0) @ np.diag([1.0, -1, -1, 1]), 9: pose(9)})
    image = table.unionByName(far_off)
    levels = [adapters.checkpointed(x) for x in Q.levels_of(image)]
    start = Q.with_views(image.select("frame").distinct().where("frame > 1"), [Q.turned(1.0, 0.0, 0, (0.001, 0.0, 0.0))])
    gates = {"far": 0.3, "least_dot": 0.6}
    one = {r.frame: r for r in tracking.align(tracking.beside(levels, "frame", 2), Q.CAMERAS, start, "frame", (3, 2, 2), **gates).collect()}
    model = [x.withColumn("frame", F.col("frame") + 2) for x in levels]
    two = {r.frame: r for r in tracking.coarse_to_fine(levels, model, Q.CAMERAS, start, [3, 2, 2], "frame", adapters.checkpointed, **gates).collect()}
    assert set(one) == set(two) and not one[8].tracked
    for k, r in one.items():
        assert r.tracked == two[k].tracked
        assert np.allclose([r[c] for c in fusion.POSE], [two[k][c] for c in fusion.POSE], atol=1e-9)
    assert [one[8][c] for c in fusion.POSE] == Q.turned(1.0, 0.0, 0, (0.001, 0.0, 0.0))


def files(table, folder, groups):
    for group in groups:
        table.where(F.col("frame").isin(group)).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_after_a_restart(spark, table, batch, tmp_path):
    """Frames in four batches, the streams stopped after two of them."""
    source, home = str(tmp_path / "in"), str(tmp_path / "home")
    files(table, source, [[0, 1], [2, 3]])
    loop.Loop(spark, source, home, SETTINGS).run()
    files(table, source, [[4, 5, 6], [7]])
    again = loop.Loop(spark, source, home, SETTINGS)
    again.run()
    assert rows(again.poses()) == batch[0] and rows(again.map()) == batch[1]
    again.track(table.where("frame in (4, 5, 6)"), 2)  # a batch that runs twice
    again.run()
    assert rows(again.poses().dropDuplicates(["frame"])) == batch[0] and rows(again.map()) == batch[1]


def test_frames_out_of_order(spark, table, batch, tmp_path):
    """Poses do not depend on the order in which frames come."""
    source, home = str(tmp_path / "in"), str(tmp_path / "home")
    files(table, source, [[4, 1], [0, 6]])
    out = loop.Loop(spark, source, home, SETTINGS)
    out.run()
    assert {r.frame for r in out.poses().collect()} == {0, 1}
    files(table, source, [[2, 3, 5, 7]])
    out.run()
    assert rows(out.poses()) == batch[0]
