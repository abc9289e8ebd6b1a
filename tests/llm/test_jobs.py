"""Steps that must not take a job for each shuffle partition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from octofold.llm.common import bitmap, hot_keys, marked


@pytest.fixture
def wide(spark):
    """Shuffle partitions that nothing merges, as on large tables."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def jobs_of(spark, name, f):
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        return f(), len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_bitmap_takes_few_jobs(wide):
    keys = wide.range(5000).select(F.xxhash64("id").alias("h"))
    bits, jobs = jobs_of(wide, "bitmap", lambda: bitmap(keys, "h"))
    assert jobs <= 4
    at = np.array([r.h for r in keys.collect()])
    assert marked(bits, at).all() and np.unpackbits(bits).sum() == len(np.unique(at % (1 << 24)))
    assert not bitmap(keys.where("h is null"), "h").any()


def test_no_hot_key_takes_one_pass(wide):
    rows = wide.range(20_000).select(F.when(F.col("id") % 10 < 9, F.col("id") % 5000).alias("key"))
    found, jobs = jobs_of(wide, "none", lambda: hot_keys(rows, "key"))
    assert found == [] and jobs <= 2
    assert hot_keys(rows.where("key is null"), "key") == []
    skewed = rows.union(wide.range(3000).select(F.lit(7).cast("long").alias("key")))
    least = max(500, skewed.where("key is not null").count() // 256)
    n = skewed.where("key = 7").count()
    assert hot_keys(skewed, "key") == [(7, -(-n // least))]
    weighted = wide.createDataFrame([(1, 499), (1, 4), (2, 500), (3, None)], "key long, n long")
    assert hot_keys(weighted, "key", "n") == [(1, 2)]
