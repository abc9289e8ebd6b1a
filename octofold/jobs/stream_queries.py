"""Streaming jobs run over all available input, each with the batch SQL as its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from octofold.jobs import fusion_queries
from octofold.jobs import sqltext as S
from octofold.sources import adapters as A
from octofold.streaming import frames, loop

QUERIES, ORACLE = {}, {}


def folder(spark) -> str:
    return f"{A.shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_rate_windows(spark, d):
    out = frames.run_to(frames.rates(frames.events(spark, d)), folder(spark), "complete")
    day = ((F.unix_micros(F.col("start").cast("timestamp")) - F.unix_micros(F.expr(A.EPOCH))) / 86_400_000_000).cast("long")
    return out.select(day.alias("day"), "key", "n", F.round("rate", 6).alias("rate"))


def stream_frame_delta(spark, d):
    out = frames.run_to(frames.in_frame_order(frames.events(spark, d)), folder(spark), "append")
    return out.select(F.col("idx").alias("event_id"), F.round("delta", 6).alias("delta"))


#: Files of whole frames that the frame loop reads one after the other.
FILES = 4


def fused(spark, d) -> loop.Loop:
    """The frame loop over all frames, in several batches."""
    home = folder(spark)
    image = fusion_queries.frames(spark, d)
    image.repartitionByRange(FILES, "frame").write.parquet(f"{home}/in")
    first = fusion_queries.turned(1.0, 0.0, 0, (6.4, 6.4, 1.0))  # in the middle of the map
    gates = {"far": 0.5, "least_dot": 0.2}
    out = loop.Loop(spark, f"{home}/in", home, loop.Settings(1, fusion_queries.levels_of, fusion_queries.CAMERAS, tuple(first), fusion_queries.VOXEL, fusion_queries.MU, 8, fusion_queries.RATE, **gates))
    out.run()
    return out


def stream_poses(spark, d):
    """The pose of every frame, with its verdict."""
    return fused(spark, d).poses().select("frame", *[F.round(f"m{r}3", 4).alias(f"t{n}") for r, n in enumerate("xyz")], "tracked")


def stream_map(spark, d):
    """The latest version of the map, by block."""
    m = fused(spark, d).map()
    return m.groupBy("key").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 3) + 0.0).alias("total"), F.sum("weight").alias("weight"))


QUERIES.update(stream_poses=stream_poses, stream_map=stream_map, stream_rate_windows=stream_rate_windows, stream_frame_delta=stream_frame_delta)
ORACLE["stream_rate_windows"] = f"SELECT CAST(floor({S.SECONDS}/86400e0) AS BIGINT) AS day, event_type AS key, count(*) AS n, round(count(*)/sum(value),6) AS rate FROM events GROUP BY 1, 2"
ORACLE["stream_frame_delta"] = "SELECT event_id, round(greatest(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0e0), 0e0), 6) AS delta FROM events"
