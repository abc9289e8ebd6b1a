"""Queries without SQL against plain versions: errors over path lengths, rendering, alignment steps;
areas of surface samples, series of one value, and scales with rotation."""

import bisect
import math
import random
import statistics

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from octofold.jobs import fusion_queries as Q
from octofold.jobs import series_queries
from octofold.operators import fusion, stats, surface, tracking


def matrices(spark, src):
    rows = sorted((r.stamp, [r[c] for c in fusion.POSE]) for r in series_queries.posed(spark, SMALL, src).collect())
    out = []
    for stamp, m in rows:
        pose = np.eye(4)
        pose[:3] = np.array(m).reshape(3, 4)
        out.append((stamp, pose))
    return out


def nearest(keys, x):
    k = bisect.bisect_left(keys, x)
    near = [j for j in (k - 1, k) if 0 <= j < len(keys)]
    return min(near, key=lambda j: (abs(keys[j] - x), keys[j]))


def test_errors_over_metres(spark):
    est, true = matrices(spark, "est"), matrices(spark, "gt")
    along = [0.0]
    for (_, a), (_, b) in zip(est, est[1:]):
        along.append(along[-1] + float(np.linalg.norm((np.linalg.inv(a) @ b)[:3, 3])))
    stamps = [t for t, _ in true]
    limit = 2 * statistics.median(b - a for a, b in zip(stamps, stamps[1:]))
    want = {}
    for k, (stamp, pose) in enumerate(est):
        j = nearest(along, along[k] + 500.0)
        gi, gj = nearest(stamps, stamp), nearest(stamps, est[j][0])
        if j == len(est) - 1 or abs(stamps[gi] - stamp) > limit or abs(stamps[gj] - est[j][0]) > limit:
            continue
        e = np.linalg.inv(np.linalg.inv(est[j][1]) @ pose) @ (np.linalg.inv(true[gj][1]) @ true[gi][1])
        want[stamp, est[j][0]] = float(np.linalg.norm(e[:3, 3])), math.acos(max(-1, min(1, (np.trace(e[:3, :3]) - 1) / 2)))
    got = {(r.i_stamp, r.j_stamp): (r.trans, r.rot) for r in series_queries.rpe_metres(spark, SMALL).collect()}
    assert set(got) == set(want) and want
    assert all(abs(got[k][0] - want[k][0]) < 2e-4 and abs(got[k][1] - want[k][1]) < 1e-3 for k in want)


def test_rendered_pixels(spark):
    """Grey and normal of each pixel from its own ray, field and light."""
    edge, rays = Q.camera_rays(spark, SMALL)
    field = {(r.x, r.y, r.z): float(r.value) for r in Q.field(spark, SMALL, edge).collect()}
    hits = {r.ray_id: r.t for r in Q.raycast_sdf(spark, SMALL).collect()}
    got = {r.ray_id: r for r in Q.render_volume(spark, SMALL).collect()}
    shown = rays.collect()
    assert set(got) == {r.ray_id for r in shown} and hits
    at = lambda p: field.get(tuple(min(edge - 1, max(0, c)) for c in p), 1.0)
    off = 0
    for r in shown:
        if r.ray_id not in hits:
            assert got[r.ray_id].grey == 0 and got[r.ray_id].nx is None
            continue
        p = [r[f"o{n}"] + hits[r.ray_id] * r[f"d{n}"] for n in "xyz"]
        b = [max(0, math.floor(c)) for c in p]
        f = [c - math.floor(c) for c in p]
        g = []
        for k in range(3):
            total = 0.0
            for o in np.ndindex(2, 2, 2):
                step = lambda s: at([x + e + s * (j == k) for j, (x, e) in enumerate(zip(b, o))])
                total += math.prod(c if e else 1 - c for c, e in zip(f, o)) * (step(1) - step(-1))
            g.append(-total)
        d = [c - e for c, e in zip(p, (edge, edge, -1.0))]
        grey = math.floor(255 * min(1.0, max(0.0, sum(x * y for x, y in zip(g, d)) / math.hypot(*g) / math.hypot(*d)) + 0.1)) if any(g) else 0
        off += abs(got[r.ray_id].grey - grey) > 1  # t is rounded here
    assert off <= len(hits) // 100


def test_steps_of_frames(spark):
    """``icp_solve`` is the exponential of the solved sums before the guess; ``track_frames`` keeps the guess
    where it fails."""
    sums = {r.frame: r for r in tracking.reduce_sums(Q.tracked(spark, SMALL), ("frame",)).collect()}
    guess = np.eye(4)
    guess[:3] = np.array(Q.GUESS).reshape(3, 4)
    got = Q.icp_solve(spark, SMALL).collect()
    assert {r.frame for r in got} == {1, 2, 3}
    for r in got:
        x = tracking.solve(sums[r.frame].asDict())
        a = np.zeros((6, 6))
        for i in range(6):
            for k in range(i, 6):
                a[i, k] = a[k, i] = sums[r.frame][f"a{i}{k}"]
        b = np.array([sums[r.frame][f"b{i}"] for i in range(6)])
        assert np.allclose(a @ x, b, atol=1e-6 * max(1, np.abs(b).max())) or not x.any()
        assert np.allclose([r[c] for c in fusion.POSE], (tracking.exponential(x) @ guess)[:3].ravel(), atol=1e-6)
    for r in Q.track_frames(spark, SMALL).collect():
        assert r.tracked or [r[c] for c in fusion.POSE] == Q.GUESS


def test_samples_follow_the_area(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANGE_ROWS", 40)
    rng = random.Random(4)
    rows = [(i, *[tuple(rng.uniform(-1, 1) * (1 + i % 5) for _ in range(3)) for _ in range(3)]) for i in range(150)]
    rows.append((150, (1.0, 1.0, 1.0), (1.0, 1.0, 1.0), (2.0, 1.0, 1.0)))  # no area
    point = "struct<x: double, y: double, z: double>"
    t = spark.createDataFrame(rows, f"id long, v0 {point}, v1 {point}, v2 {point}")
    n = 20_000
    got = surface.surface_samples(t, n).collect()
    assert sorted(r.k for r in got) == list(range(n))
    area, inside = {}, {}
    for i, *v in rows:
        a, b, c = map(np.array, v)
        area[i] = float(np.linalg.norm(np.cross(b - a, c - a))) / 2
        inside[i] = (a, b, c)
    whole = sum(area.values())
    count, middle = {}, {}
    for r in got:
        count[r.id] = count.get(r.id, 0) + 1
        middle.setdefault(r.id, []).append((r.x, r.y, r.z))
        a, b, c = inside[r.id]
        w, *_ = np.linalg.lstsq(np.stack([a, b, c], axis=1), np.array([r.x, r.y, r.z]), rcond=None)
        assert (w > -1e-6).all() and abs(w.sum() - 1) < 1e-6
    assert all(abs(count.get(i, 0) - n * area[i] / whole) <= 2 for i in area) and 150 not in count
    large = max(area, key=area.get)
    size = max(np.linalg.norm(inside[large][0] - inside[large][k]) for k in (1, 2))
    assert np.linalg.norm(np.mean(middle[large], axis=0) - np.mean(inside[large], axis=0)) < 0.1 * size


def test_ranks_of_one_value(spark):
    """A value that makes up most of a series, and series of one value."""
    rows = [("a", 5.0)] * 3_000 + [("a", float(k)) for k in range(40)] + [("b", 1.0)] * 7 + [("c", 2.0)]
    got = {r.key: (r.low, r.high) for r in stats.at_ranks(spark.createDataFrame(rows, "key string, value double"), low=lambda n: F.floor((n - 1) * 0.01), high=lambda n: F.floor((n - 1) * 0.5)).collect()}
    for key in "abc":
        s = sorted(v for k, v in rows if k == key)
        assert got[key] == (s[int((len(s) - 1) * 0.01)], s[int((len(s) - 1) * 0.5)])


def test_greedy_pairs_of_dense_stamps(spark):
    """Ties and copies of stamps, with very many partners within reach."""
    rng = random.Random(6)
    a, b = ([round(rng.uniform(0, 20), 1) for _ in range(n)] for n in (400, 350))
    width = 3.05
    used, left, right = set(), set(), []
    for d, x, y, i, j in sorted((abs(x - y), x, y, i, j) for i, x in enumerate(sorted(a)) for j, y in enumerate(sorted(b)) if abs(x - y) < width):
        if i not in left and j not in used:
            left.add(i)
            used.add(j)
            right.append((x, y))
    got = stats.one_to_one(*[spark.createDataFrame([(x,) for x in s], "stamp double") for s in (a, b)], width)
    assert sorted((r.a_stamp, r.b_stamp) for r in got.collect()) == sorted(right)


def test_scale_with_rotation():
    """The section search finds the scale of a turned, scaled and shifted path."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(200, 3))
    turn = tracking.exponential(np.array([0, 0, 0, 0.4, -1.1, 0.7]))[:3, :3]
    b = 1.7 * a @ turn.T + 3
    ca, cb = a - a.mean(0), b - b.mean(0)
    w, aa, bb = ca.T @ cb / 200, (ca**2).sum() / 200, (cb**2).sum() / 200

    def error(k):
        r, _ = tracking.horn(k * w, np.zeros(3), np.zeros(3))
        return k * k * aa - 2 * k * float(np.trace(r @ w)) + bb

    k = series_queries.P.golden_section(0.0, 4.0, 1e-9, error)
    assert abs(k - 1.7) < 1e-4 and abs(error(k)) < 1e-6
