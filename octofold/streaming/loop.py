"""The loop over depth frames as two streams: tracking, then poses and the map.

The first stream keeps each batch of frames, and aligns frames with the ones before them in their
sequence: a frame's move is computed by the batch that brings the later of the two. The second
stream has the pose of each sequence's last frame as its state (moves that come before their turn
wait there) and folds the frames into the map. The map is a table of versions: a batch writes the
voxels that it changed under its own number, the latest version of a voxel counts, and a batch
that runs again, after a restart, replaces its own.

Frames are numbered through: with n sequences, frame k is number k // n of sequence k % n. What
arrives in order gives the map and the poses of one batch over all frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from octofold.operators import fusion, tracking

IMAGE = "frame int, u int, v int, depth double"
MOVE = f"frame int, {', '.join(f'{c} double' for c in fusion.POSE)}, tracked boolean"
#: The first frames of a sequence, which are fused whether tracked or not.
ALWAYS = 3


@dataclass(frozen=True)
class Settings:
    """Sequences, pyramid (vertices and normals of an image's levels, their cameras), gates, first pose
    (world from camera) and map of a run."""

    sequences: int
    levels: Callable[[DataFrame], list[DataFrame]]
    cameras: list
    first: tuple[float, ...]
    voxel: float
    mu: float
    depth: int
    rate: int = 1
    far: float = 0.1
    least_dot: float = 0.8
    rounds: tuple[int, ...] = tracking.ROUNDS


def matrix(numbers) -> np.ndarray:
    out = np.eye(4)
    out[:3] = np.array(numbers, float).reshape(3, 4)
    return out


def moves(image: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """MOVE of the frames in ``wanted``: into the camera space of the frame before, none for the first."""
    still = wanted.select("frame", *[F.lit(float(i % 5 == 0)).alias(c) for i, c in enumerate(fusion.POSE)])
    pairs = tracking.beside(s.levels(image), "frame", s.sequences)
    return tracking.align(pairs, s.cameras, still, "frame", s.rounds, s.far, s.least_dot)


def onward(before: np.ndarray, row: tuple) -> np.ndarray:
    """The pose after a move (frame, POSE, tracked)."""
    return before @ matrix(row[1:13])


class Poses(StatefulProcessor):
    """Of each sequence the number and pose of its last frame, and the moves that wait."""

    def __init__(self, sequences: int, first: tuple[float, ...]):
        self.sequences, self.first = sequences, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        pose = ", ".join(f"{c} double" for c in fusion.POSE)
        self.last = handle.getValueState("last", f"frame int, {pose}")
        self.early = handle.getMapState("early", "frame int", f"{pose}, tracked boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            frame, *numbers = self.last.get()
            pose = matrix(numbers)
        else:
            frame, pose = key[0] - self.sequences, matrix(self.first)
        waiting = {k[0]: tuple(v) for k, v in self.early.iterator()}
        old = set(waiting)
        for part in rows:
            for row in part.itertuples(index=False):
                if row.frame > frame:
                    waiting[row.frame] = tuple(getattr(row, c) for c in (*fusion.POSE, "tracked"))
        out = []
        while frame + self.sequences in waiting:
            frame += self.sequences
            move = (frame, *waiting.pop(frame))
            pose = onward(pose, move)
            out.append((frame, *pose[:3].ravel().tolist(), bool(move[13])))
        for k in old - set(waiting):
            self.early.removeKey((int(k),))
        for k, v in waiting.items():
            self.early.updateValue((int(k),), (*map(float, v[:12]), bool(v[12])))
        if out:
            self.last.update(tuple(out[-1][:13]))
        yield pd.DataFrame(out, columns=["frame", *fusion.POSE, "tracked"])

    def close(self) -> None:
        pass


def placed(moved: DataFrame, s: Settings) -> DataFrame:
    """MOVE as poses (world from camera) of one batch: each sequence passes once, in order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence, pose = None, None
        for rows in parts:
            out = []
            for row in rows[["frame", *fusion.POSE, "tracked"]].itertuples(index=False, name=None):
                if row[0] % s.sequences != sequence:
                    sequence, pose = row[0] % s.sequences, matrix(s.first)
                pose = onward(pose, row)
                out.append((row[0], *pose[:3].ravel().tolist(), row[13]))
            yield pd.DataFrame(out, columns=["frame", *fusion.POSE, "tracked"])

    by = (F.col("frame") % s.sequences).alias("sequence")
    return moved.select(by, "*").repartition("sequence").sortWithinPartitions("sequence", "frame").drop("sequence").mapInPandas(run, MOVE)


def fused(image: DataFrame, poses: DataFrame, s: Settings, prior: DataFrame | None = None) -> DataFrame:
    """The voxels that the frames change: those at the rate that were tracked, and the
    first of each sequence."""
    at = F.floor(F.col("frame") / s.sequences)
    good = poses.where((F.col("tracked") & fusion.integrated(at, s.rate)) | (at <= ALWAYS))
    back = good.select("frame", *fusion.POSE)
    return fusion.integrate(image.join(good.select("frame"), "frame", "left_semi"), fusion.inverse(back), back, s.cameras[0], s.voxel, s.mu, s.depth, 1, prior)


def whole(image: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Poses and map of all frames as one batch."""
    poses = placed(moves(image, image.select("frame").distinct(), s), s)
    return poses, fused(image, poses, s)


class Loop:
    """The two streams over the image files (IMAGE) of a folder; all that they keep is under ``home``
    in the shared folder."""

    def __init__(self, spark: SparkSession, source: str, home: str, s: Settings):
        self.spark, self.source, self.home, self.s = spark, source, home, s

    def kept(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """The table of a name, of batches up to ``before``; empty if there is none yet."""
        path = f"{self.home}/{name}"
        rows = self.spark.read.schema(f"{schema}, batch long")
        try:
            out = rows.parquet(path)
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out = self.spark.createDataFrame([], f"{schema}, batch long")
        return out if before is None else out.where(F.col("batch") <= before)

    def write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.home}/{name}/batch={batch}")

    def track(self, batch: DataFrame, number: int) -> None:
        n = self.s.sequences
        self.write(batch, "frames", number)
        new = self.kept("frames", IMAGE).where(F.col("batch") == number).select("frame").distinct()
        known = self.kept("frames", IMAGE, number).drop("batch")
        ids = known.select("frame").distinct()
        turn = new.unionByName(new.select((F.col("frame") + n).alias("frame"))).distinct().join(ids, "frame", "left_semi")
        wanted = turn.where(F.col("frame") < n).unionByName(turn.where(F.col("frame") >= n).withColumn("p", F.col("frame") - n).join(ids.withColumnRenamed("frame", "p"), "p", "left_semi").drop("p"))
        both = wanted.unionByName(wanted.select((F.col("frame") - n).alias("frame"))).distinct()
        self.write(moves(known.join(both, "frame", "left_semi"), wanted, self.s), "moves", number)

    def fuse(self, batch: DataFrame, number: int) -> None:
        self.write(batch, "poses", number)
        poses = self.kept("poses", MOVE).where(F.col("batch") == number).drop("batch")
        image = self.kept("frames", IMAGE).drop("batch").join(poses.select("frame"), "frame", "left_semi")
        self.write(fused(image, poses, self.s, self.map(number - 1)), "map", number)

    def map(self, before: int | None = None) -> DataFrame:
        """key, x, y, z, value, weight: of each voxel the latest version."""
        rows = self.kept("map", "key long, x int, y int, z int, value double, weight double", before)
        latest = rows.groupBy("key", "x", "y", "z").agg(F.max_by(F.struct("value", "weight"), "batch").alias("v"))
        return latest.select("key", "x", "y", "z", "v.value", "v.weight")

    def poses(self) -> DataFrame:
        return self.kept("poses", MOVE).drop("batch")

    def run(self, files: int = 1) -> None:
        """Everything that is there, ``files`` image files a batch; called again, what came since."""
        conf = "spark.sql.streaming.stateStore.providerClass"
        self.spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        image = self.spark.readStream.schema(IMAGE).option("maxFilesPerTrigger", files).parquet(self.source)
        self._start(image, self.track, "tracking").awaitTermination()
        # batches are folders: their number is part of a file's path alone
        moved = self.spark.readStream.schema(f"{MOVE}, batch long").option("maxFilesPerTrigger", 64).parquet(f"{self.home}/moves").drop("batch")
        keyed = moved.select((F.col("frame") % self.s.sequences).alias("sequence"), "*").groupBy("sequence")
        poses = keyed.transformWithStateInPandas(Poses(self.s.sequences, self.s.first), MOVE, "append", "None")
        # no more partitions of the state than sequences; what ``fuse`` does is planned by the session itself
        name = "spark.sql.shuffle.partitions"
        usual = self.spark.conf.get(name)
        self.spark.conf.set(name, str(min(int(usual), self.s.sequences)))
        try:
            query = self._start(poses, self.fuse, "poses")
        finally:
            self.spark.conf.set(name, usual)
        query.awaitTermination()

    def _start(self, stream: DataFrame, work: Callable[[DataFrame, int], None], name: str):
        return stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{self.home}/state/{name}").trigger(availableNow=True).start()
