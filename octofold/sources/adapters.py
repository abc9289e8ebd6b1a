"""The driver's tables read as points, boxes, images, trajectories, samples and rays."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, DEPTH, BLOCK_LEVEL = 256, 8, 5
EPOCH = "timestamp '2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and the master is local (tests), a
    new one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in a 256-cube: x, y, z, val, w."""
    place = lambda c: F.pmod(c, F.lit(SIZE)).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        place(31 * F.col("l_orderkey") + 7 * F.col("l_linenumber")).alias("x"),
        place(17 * F.col("l_partkey")).alias("y"),
        place(13 * F.col("l_suppkey")).alias("z"),
        F.col("l_quantity").alias("val"),
        F.col("l_linenumber").alias("w"),
    )


def mixed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("x", "y", "z", (1 + F.pmod("w", F.lit(5))).cast("int").alias("level"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = [F.element_at("embedding", i + 1).cast("double") for i in range(3)]
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", *[c.alias(f"p{n}") for c, n in zip(p, "xyz")], *[F.floor((c + 1.0) * 128.0).cast("int").alias(n) for c, n in zip(p, "xyz")], "label"
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = [F.pmod(k * F.col("p_partkey"), F.lit(240)).cast("int").alias(n) for k, n in ((37, "bx"), (41, "by"), (43, "bz"))]
    extent = [(1 + F.pmod(F.col("p_size") + k, F.lit(8))).cast("int").alias(n) for k, n in ((0, "ex"), (3, "ey"), (5, "ez"))]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("box_id"), *corner, *extent)


def _mm() -> Column:
    level = F.pmod(F.floor(F.col("value") * 100.0 + 0.5).cast("long"), F.lit(3600))
    return F.when(F.col("event_type") == "error", 0).otherwise(400 + level).cast("int")


def _grid(index: Column, width: int) -> list[Column]:
    return [F.pmod(index, F.lit(width)).cast("int").alias("u"), F.floor(index / width).cast("int").alias("v")]


def image(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    return table(spark, sf_dir, "events").select(*_grid(F.col("event_id"), width), _mm().alias("mm"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.pmod("event_id", F.lit(4)).cast("int").alias("frame"), *_grid(F.floor(F.col("event_id") / 4), 50), _mm().alias("mm"))


def seconds(ts: str = "ts") -> Column:
    """Seconds since 2024-01-01, as DOUBLE."""
    return (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.expr(EPOCH))) / 1e6


def traj(spark: SparkSession, sf_dir: str, src: str) -> DataFrame:
    """stamp, tx, ty, tz; src: gt (views) or est (clicks)."""
    kind = {"gt": "view", "est": "click"}[src]
    events = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return events.select(seconds().alias("stamp"), F.col("value").alias("tx"), F.col("user_id").cast("double").alias("ty"), F.pmod("event_id", F.lit(97)).cast("double").alias("tz"))


def poses(spark: SparkSession, sf_dir: str, src: str) -> DataFrame:
    """As ``traj``, with a quaternion qx..qw of small whole numbers."""
    kind = {"gt": "view", "est": "click"}[src]
    events = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    q = {"qx": F.pmod("user_id", F.lit(5)) - 2, "qy": F.pmod("event_id", F.lit(7)) - 3, "qz": F.pmod("event_id", F.lit(3)) - 1, "qw": 1 + F.pmod("event_id", F.lit(2))}
    return events.select(seconds().alias("stamp"), F.col("value").alias("tx"), F.col("user_id").cast("double").alias("ty"), F.pmod("event_id", F.lit(97)).cast("double").alias("tz"), *[c.cast("double").alias(n) for n, c in q.items()])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), "value")


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    o = [F.pmod(53 * k, F.lit(SIZE)).cast("double").alias("ox"), F.pmod(59 * k, F.lit(SIZE)).cast("double").alias("oy"), F.lit(-10.0).alias("oz")]
    d = [(F.pmod(k, F.lit(7)) - 3).cast("double").alias("dx"), (F.pmod(k, F.lit(5)) - 2).cast("double").alias("dy"), F.lit(5.0).alias("dz")]
    return table(spark, sf_dir, "customer").select(k.alias("ray_id"), *o, *d)
