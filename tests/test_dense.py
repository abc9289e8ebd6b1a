"""Dense stamps and large runs: the work grows with the rows, not with the pairs within reach."""

import random
import time
from collections import Counter

import numpy as np
import pandas as pd
from conftest import SMALL
from pyspark.sql import functions as F

from octofold.jobs import series_queries
from octofold.operators import geometry, poses, stats


def stamps(spark, values):
    return spark.createDataFrame(pd.DataFrame({"stamp": np.asarray(values, float)}))


def test_open_ends_of_ranges_are_resolved_later(spark, monkeypatch):
    """Ties, copies and chains over the ends of many small ranges; the greedy result is unchanged."""
    monkeypatch.setattr(stats, "RANGE_ROWS", 30)
    monkeypatch.setattr(stats, "RUN_ROWS", 40)
    rng = random.Random(8)
    a, b = ([round(rng.uniform(0, 60), 1) for _ in range(n)] for n in (330, 300))
    a, b = a + [100.0 + k * (k + 1) / 9 for k in range(0, 60, 2)], b + [100.0 + k * (k + 1) / 9 for k in range(1, 60, 2)]
    width, used, left, want = 4.05, set(), set(), []
    for d, x, y, i, j in sorted((abs(x - y), x, y, i, j) for i, x in enumerate(sorted(a)) for j, y in enumerate(sorted(b)) if abs(x - y) < width):
        if i not in left and j not in used:
            left.add(i)
            used.add(j)
            want.append((x, y))
    got = stats.one_to_one(stamps(spark, a), stamps(spark, b), width)
    assert sorted((r.a_stamp, r.b_stamp) for r in got.collect()) == sorted(want)


def test_greedy_needs_no_pairs_within_reach(spark, monkeypatch):
    monkeypatch.setattr(stats, "RUN_ROWS", 1_000)
    rng = np.random.default_rng(4)
    a, b = (rng.uniform(0, 1_000, 20_000) for _ in "ab")
    began = time.time()
    n = stats.one_to_one(stamps(spark, a), stamps(spark, b), 500.0).count()
    assert 19_000 < n <= 20_000 and time.time() - began < 60


def test_nearest_of_many_within_reach(spark):
    """All within the width of each other, with copies of stamps: one row a stamp, no pairs."""
    rng = np.random.default_rng(3)
    a, b = (np.round(rng.uniform(0, 1_000, 30_000), 2) for _ in "ab")
    began = time.time()
    got = {r.a_stamp: r.b_stamp for r in stats.nearest(stamps(spark, a), stamps(spark, b), 5_000.0).collect()}
    assert time.time() - began < 60
    b = np.unique(b)
    for x in np.unique(a):
        near = b[max(0, np.searchsorted(b, x) - 1) :][:2]
        assert got.pop(x) == min((abs(x - y), y) for y in near)[1]
    assert not got


def test_closest_reads_each_range_once(spark):
    """One range of 120,000 rows; its following rows were read anew for every row."""
    t, p = (spark.range(60_000).select((F.col("id") * 3 + k).cast("double").alias(n)) for k, n in ((0, "at"), (1, "pos")))
    began = time.time()
    got = stats.closest(t, "at", p, "pos").select(F.count("*"), F.sum(F.col("near.pos") - F.col("at"))).first()
    assert tuple(got) == (60_000, 60_000.0) and time.time() - began < 30


def test_copies_of_stamps_are_all_compared(spark):
    """Poses that share a stamp are joined with each other, as in the SQL."""
    est, gt = (series_queries.posed(spark, SMALL, s) for s in ("est", "gt"))
    one = poses.pair_errors(poses.delta_pairs(est, 7200.0, "s"), gt).count()
    assert poses.pair_errors(poses.delta_pairs(est.union(est), 7200.0, "s"), gt).count() == 4 * one > 0


def test_equal_boxes_are_tested_once(spark):
    """2,000 boxes in one place: all pairs come out, from one test of a pair of shapes."""
    box = spark.range(2_000).select(F.col("id").alias("box_id"), *[F.lit(k).alias(n) for n, k in (("bx", 30), ("by", 31), ("bz", 32), ("ex", 4), ("ey", 4), ("ez", 4))])
    seen = spark.sparkContext.accumulator(0)

    def test(a, ea, b, eb):
        def count(x, y):
            seen.add(1)
            return True

        return geometry.overlap(a, ea, b, eb) & F.udf(count, "boolean")(F.col(a), F.col(b))

    assert geometry.pairs(box, box, test).count() == 4_000_000
    assert 0 < seen.value < 100


def test_pairs_of_equal_boxes_are_dealt_out(spark):
    """3,000 boxes in one place: their 9 million pairs were made in one task."""
    box = spark.range(3_000).select(F.col("id").alias("box_id"), *[F.lit(k).alias(n) for n, k in (("bx", 30), ("by", 31), ("bz", 32), ("ex", 4), ("ey", 4), ("ez", 4))])
    tasks = [r["count"] for r in geometry.pairs(box, box, geometry.overlap).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 9_000_000 and max(tasks) < sum(tasks) / 3


def test_pairs_of_repeated_and_missing_ids(spark, monkeypatch):
    """Lists of eight ids at most lose no pair and add none, also of ids that come often or are null."""
    monkeypatch.setattr(geometry, "CHUNK", 8)
    ids = [*range(40), *[7] * 30, *[None] * 20]
    rows = [(i, 20 + 2 * (k % 3), 30, 31, 3, 4, 5) for k, i in enumerate(ids)]
    box = spark.createDataFrame(rows, "box_id long, bx int, by int, bz int, ex int, ey int, ez int")
    assert geometry.classes(box, ["bx", "by", "bz", "ex", "ey", "ez"], "a")[1].agg(F.max(F.size("a_ids"))).first()[0] <= 8
    want = Counter((a[0], b[0]) for a in rows for b in rows if abs(b[1] - a[1]) <= 3)
    got = geometry.pairs(box, box, geometry.overlap).groupBy("a_box_id", "b_box_id").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == want
