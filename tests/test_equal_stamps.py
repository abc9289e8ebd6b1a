"""Poses that share a stamp."""

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from octofold.jobs import series_queries as Q
from octofold.operators import poses, stats
from octofold.sources import adapters as A


def test_one_index_a_pose(spark):
    est = Q.posed(spark, SMALL, "est").limit(40).cache()
    n = est.count()
    for unit in ("m", "rad", "f", "s"):
        assert poses.indexed(est.union(est).union(est), unit).count() == 3 * n
    once, twice = (poses.indexed(x, "m").agg({"at": "max"}).first()[0] for x in (est, est.union(est)))
    assert abs(once - twice) < 1e-6 * once


def test_repeated_poses_give_each_pair_once(spark):
    """Two poses at each stamp: four errors for each of a pair of stamps, as in the SQL of stamps."""
    est, gt = Q.posed(spark, SMALL, "est"), Q.posed(spark, SMALL, "gt")
    one = sorted(map(tuple, poses.delta_errors(est, gt, 500.0, "m").collect()))
    assert one == sorted(map(tuple, poses.pair_errors(poses.delta_pairs(est, 500.0, "m"), gt).collect()))
    assert len(one) > 0 and poses.delta_errors(est.union(est), gt, 500.0, "m").count() == 4 * len(one)


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """The small events 8 times: 5 copies with the same stamps and other poses, 3 with equal poses."""
    d = str(tmp_path_factory.mktemp("copies"))
    events = spark.read.parquet(f"{SMALL}/events.parquet").crossJoin(spark.range(8))
    k = F.least("id", F.lit(4))
    events.withColumns({"event_id": F.col("event_id") + k * 1000, "user_id": F.col("user_id") + k * 15, "value": F.col("value") + k}).drop("id").write.parquet(f"{d}/events.parquet")
    return d


@pytest.fixture
def stored(monkeypatch):
    """The numbers of rows that are stored on the way."""
    out, whole = [], stats.checkpointed

    def counted(df):
        kept = whole(df)
        out.append(kept.count())
        return kept

    monkeypatch.setattr(stats, "checkpointed", counted)
    return out


def by_sql(d, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    got = con.execute(Q.ORACLE[name])
    names = [c[0] for c in got.description]
    return names, sorted(got.fetchall())


@pytest.mark.parametrize("name", ["remove_const_offset", "ate_no_align", "ate_moments", "best_scale", "best_scale_aligned"])
def test_equal_stamps_as_in_sql(spark, copies, stored, name):
    """All n * m pairs of a stamp count, but only rows of poses and stamps are stored."""
    names, want = by_sql(copies, name)
    if name == "remove_const_offset":  # which of the first poses of a stamp comes first is open
        first = min(r[0] for r in want)
        firsts = lambda rows: [r for r in rows if r[0] == first]
        got = sorted(map(tuple, Q.remove_const_offset(spark, copies).select(*names).collect()))
        shift = [x - y for x, y in zip(firsts(got)[0], firsts(want)[0])]
        want = sorted((r[0], *(x + s for x, s in zip(r[1:], shift[1:]))) for r in want)
    else:
        got = [tuple(r) for r in Q.QUERIES[name](spark, copies).select(*names).collect()]
    assert len(got) == len(want) > 0
    assert all(abs(x - y) <= 2e-3 + 1e-9 * abs(y) for g, w in zip(got, want) for x, y in zip(g, w))
    poses = sum(A.traj(spark, copies, s).count() for s in ("est", "gt"))
    assert max(stored) <= poses


def test_true_poses_repeat_rows(spark, copies):
    """The rows of remove_const_offset are repeated, not joined with every true pose."""
    assert "Generate explode" in Q.remove_const_offset(spark, copies)._jdf.queryExecution().optimizedPlan().toString()


def test_moments_of_very_many_pairs(spark):
    """A stamp with 200,000 poses on either side: 4e10 pairs are counted without being made."""
    side = lambda k: spark.range(200_000).select(F.lit(5.0).alias("stamp"), *[((F.col("id") * k + i) % 97 + 1e6).alias(n) for i, n in enumerate(stats.AXES)])
    a, b = side(3), side(5)
    near = spark.createDataFrame([(5.0, 5.0)], "a_stamp double, b_stamp double")
    got = stats.pair_moments(near, a, b).first()
    mean, var = a.agg(F.avg("tx"), F.var_pop("tx")).first()
    assert got["n"] == 200_000**2 and abs(got["atx"] - mean) < 1e-6 and abs(got["v_a_tx"] - var) < 1e-6 * var
    assert abs(got["w_tx_ty"]) < 1e-6 * got["n"]


def test_moments_as_of_pairs(spark, copies):
    near, est, gt = Q.matched_stamps(spark, copies)
    side = lambda rows, s: rows.select(*[F.col(c).alias(f"{s}_{c}") for c in ("stamp", *stats.AXES)])
    want = stats.moments(near.join(side(est, "a"), "a_stamp").join(side(gt, "b"), "b_stamp")).first().asDict()
    got = stats.pair_moments(near, est, gt).first()
    assert all(abs(got[c] - v) <= 1e-6 + 1e-9 * abs(v) for c, v in want.items())


@pytest.mark.parametrize("values", [[0.0], [0.0, 0.0, 3.5], [2.0, 1e-9, 1e9, 7.0], [5.25] * 9, [1.0 + k / 1e6 for k in range(800)]])
def test_weighted_errors(spark, values):
    rows = spark.createDataFrame([(v, 1 + k % 3) for k, v in enumerate(values)] + [(None, 4)], "e double, w long")
    flat = np.array([v for k, v in enumerate(values) for _ in range(1 + k % 3)])
    got = stats.error_stats(rows, weight="w").first()
    want = (len(flat), np.sqrt((flat**2).mean()), flat.mean(), np.median(flat), flat.std(), flat.min(), flat.max())
    assert all(abs(g - w) <= 1e-12 + 1e-9 * abs(w) for g, w in zip(got, want))
    assert stats.error_stats(rows.where("e IS NULL"), weight="w").first()[0] == 0


def test_rpe_steps_as_of_pairs_in_order(spark, copies):
    """The pairs of a stamp by pose of est, then of gt, each against the one before."""
    near = {r.a_stamp: r.b_stamp for r in Q.matched_stamps(spark, copies)[0].collect()}
    poses = {}
    for s in ("est", "gt"):
        for r in sorted(map(tuple, A.traj(spark, copies, s).collect())):
            poses.setdefault((s, r[0]), []).append(np.array(r[1:]))
    rows = [a - b for x in sorted(near) for a in poses["est", x] for b in poses["gt", near[x]]]
    e = np.array([np.linalg.norm(y - x) for x, y in zip(rows, rows[1:])])
    got = Q.rpe_stats(spark, copies).first()
    want = {"n": len(e), "rmse": np.sqrt((e**2).mean()), "mean": e.mean(), "median": np.median(e), "std": e.std(), "min": e.min(), "max": e.max()}
    assert all(abs(got[c] - v) <= 1e-4 for c, v in want.items())
