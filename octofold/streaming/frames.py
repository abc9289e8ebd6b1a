"""Streams of frames and samples: windowed rates, ordered per-key state, and map snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def rates(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Samples over their summed time in tumbling windows; rows later than ``late``
    behind the newest are dropped."""
    w = F.window("ts", width)
    grouped = stream.withWatermark("ts", late).groupBy(w.alias("w"), F.col("event_type").alias("key"))
    return grouped.agg(F.count("*").alias("n"), (F.count("*") / F.sum("value")).alias("rate")).select(F.col("w.start").alias("start"), "key", "n", "rate")


def in_frame_order(stream: DataFrame, key: str = "user_id", index: str = "event_id", value: str = "value") -> DataFrame:
    """Per key the increase of a value from frame to frame (0 when it falls), in
    frame order across micro-batches; frames at or before the last one seen are dropped."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, before = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values("idx").drop_duplicates("idx")
        out = []
        for i, v in zip(rows["idx"].tolist(), rows["val"].tolist()):
            if last is not None and i <= last:
                continue
            out.append((i, 0.0 if before is None else max(v - before, 0.0)))
            last, before = i, v
        if last is not None:
            state.update((last, before))
        yield pd.DataFrame(out, columns=["idx", "delta"])

    keyed = stream.select(F.col(key).alias("k"), F.col(index).alias("idx"), F.col(value).alias("val"))
    return keyed.groupBy("k").applyInPandasWithState(step, "idx long, delta double", "last long, before double", "append", "NoTimeout")


def run_to(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs all available input through the stream into Parquet under ``folder`` (snapshots are
    named by batch, so a repeated batch rewrites its own) and reads the result: the last
    snapshot in complete mode, all of them in append mode."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    if mode == "complete":
        done = done.where(F.col("batch") == done.agg(F.max("batch")).first()[0])
    return done.drop("batch")
