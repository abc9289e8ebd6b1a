"""File formats: raw depth recordings, text trajectories, scene files, and mesh and map sinks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octofold.operators import stats


def record(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Frame and its record (headers, millimetres, black pixels) of depth images (frame, u, v,
    mm); pixels that are missing are 0. A record is one image, so a task holds one at a time."""
    cells = F.collect_list(F.struct((F.col("v") * width + F.col("u")).alias("i"), "mm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = struct.pack("<II", width, height)
        for batch in batches:
            out = []
            for pixels in batch.column(1).to_pylist():
                depth = np.zeros(width * height, "<u2")
                depth[[p["i"] for p in pixels]] = [p["mm"] for p in pixels]
                out.append(head + depth.tobytes() + head + bytes(3 * width * height))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["frame", "record"])

    return frames.groupBy("frame").agg(cells.alias("pixels")).select("frame", "pixels").mapInArrow(run, "frame int, record binary")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos (file, where its split begins, place in the split) and line of texts. Files are split
    among tasks; places grow within a split, and no line is counted."""
    rows = spark.read.text(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    return rows.select(at.alias("pos"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of texts with their file and their number in it, for small files whose lines are counted
    (configurations, lists of times): each is read whole by one task."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return whole.select("file", "n", F.trim("line").alias("line"))


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Stamp and pose columns; comments skipped, blanks, tabs and commas separate,
    the last row of a stamp wins, rows without a rotation or with NaN go."""
    names = ("stamp", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
    parts = F.split(F.trim(F.regexp_replace("line", r"[,\s]+", " ")), " ")
    rows = ordered_lines(spark, path).where("line <> '' and not startswith(line, '#')").select("pos", parts.alias("p")).where("size(p) >= 8")
    cols = rows.select("pos", *[F.expr(f"try_cast(p[{i}] as double)").alias(c) for i, c in enumerate(names)])
    last = cols.groupBy("stamp").agg(F.max_by(F.struct(*names[1:]), "pos").alias("r")).select("stamp", "r.*")
    ok = "qx * qx + qy * qy + qz * qz + qw * qw > 0"
    return last.where(ok).where(" and ".join(f"{c} is not null and not isnan({c})" for c in names))


def last_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Of each log the last line that begins with a brace, parsed."""
    rows = ordered_lines(spark, path).where("startswith(line, '{')")
    return rows.groupBy("pos.file").agg(F.max_by("line", "pos").alias("line")).select("file", F.from_json("line", schema).alias("r")).select("file", "r.*")


def timed_results(spark: SparkSession, results: str, times: str) -> DataFrame:
    """The i-th line of a file of times before the i-th row of a file of results, whose first
    column goes; the shorter file ends both."""
    rows = lines(spark, results).where("line <> ''").select("n", F.split("line", r"[,\s]+").alias("p")).select("n", F.slice("p", F.lit(2), F.size("p")).alias("fields"))
    stamp = lines(spark, times).where("line <> ''").select("n", F.col("line").alias("stamp"))
    return stamp.join(rows, "n").select("n", "stamp", "fields")


def power_report(spark: SparkSession, path: str) -> DataFrame:
    """A report with a row of names; comments skipped. Columns are DOUBLE."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#")
    return rows.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in rows.columns])


def energy(report: DataFrame, stamp: str = "Sample_time") -> DataFrame:
    """By column of a report the energy, its average power and the time."""
    rails = [c for c in report.columns if c != stamp]
    steps = stats.in_order(report, stamp).withColumn("dt", F.col(stamp) - F.col(f"p_{stamp}"))
    long = steps.select("dt", F.explode(F.array(*[F.struct(F.lit(c).alias("rail"), F.col(c).alias("p")) for c in rails])).alias("x")).select("dt", "x.rail", "x.p")
    return long.groupBy("rail").agg(F.sum(F.col("p") * F.col("dt")).alias("energy"), (F.sum(F.col("p") * F.col("dt")) / F.sum("dt")).alias("average"), F.sum("dt").alias("seconds"))


def scene(spark: SparkSession, path: str) -> DataFrame:
    """Key and value of a scene file; keys in lower case, quotes taken off."""
    rows = lines(spark, path).where("not startswith(line, '#') and contains(line, '=')")
    at = F.instr("line", "=")
    value = F.regexp_replace(F.trim(F.expr("substring(line, instr(line, '=') + 1)")), '^"(.*)"$', "$1")
    return rows.select("n", F.lower(F.trim(F.expr("substring(line, 1, instr(line, '=') - 1)"))).alias("key"), value.alias("value")).where(at > 1)


def scene_depth(image: DataFrame, fx: float = 481.2, fy: float = -480.0, u0: float = 319.5, v0: float = 239.5) -> DataFrame:
    """S3: ray lengths (u, v, length) to planar depth."""
    x, y = (F.col("u") - u0) / fx, (F.col("v") - v0) / fy
    return image.select("u", "v", (F.col("length") / F.sqrt(x * x + y * y + 1.0)).alias("depth"))


def save_map(octants: DataFrame, voxels: DataFrame, path: str) -> None:
    """Octants by level and voxels, both clustered by key."""
    octants.repartitionByRange("key").sortWithinPartitions("key").write.partitionBy("level").parquet(f"{path}/octants")
    voxels.repartitionByRange("key").sortWithinPartitions("key", "slot").write.parquet(f"{path}/voxels")


def load_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S10."""
    return spark.read.parquet(f"{path}/octants"), spark.read.parquet(f"{path}/voxels")


def obj_lines(triangles: DataFrame) -> DataFrame:
    """Triangles (id, v0, v1, v2: structs x, y, z) as numbered lines of an OBJ text: three
    fresh vertices each, then faces, which count from 1 in the order of ids. Ranks need dense
    ids from 0, so no global window is used."""
    corner = F.explode(F.arrays_zip(F.array(*map(F.lit, range(3))).alias("k"), F.array("v0", "v1", "v2").alias("v"))).alias("c")
    v = triangles.select("id", corner).select((3 * F.col("id") + F.col("c.k")).alias("n"), F.concat_ws(" ", F.lit("v"), "c.v.x", "c.v.y", "c.v.z").alias("line"))
    first = 3 * F.col("id") + 1
    f = triangles.select(F.col("id").alias("n"), F.concat_ws(" ", F.lit("f"), first, first + 1, first + 2).alias("line"))
    return v.select(F.lit(0).alias("part"), "n", "line").unionByName(f.select(F.lit(1).alias("part"), "n", "line"))


def vtk_lines(triangles: DataFrame) -> DataFrame:
    """Triangles (id dense from 0, v0, v1, v2) as numbered lines of a mesh text: three
    fresh points each."""
    n = triangles.count()
    spark = triangles.sparkSession
    head = ["# vtk DataFile Version 1.0", "mesh", "ASCII", "DATASET POLYDATA", f"POINTS {3 * n} FLOAT"]
    frame = spark.createDataFrame([(0, i, t) for i, t in enumerate(head)] + [(2, 0, f"POLYGONS {n} {4 * n}")], "part int, n long, line string")
    corner = F.explode(F.arrays_zip(F.array(*map(F.lit, range(3))).alias("k"), F.array("v0", "v1", "v2").alias("v"))).alias("c")
    points = triangles.select("id", corner).select(F.lit(1).alias("part"), (3 * F.col("id") + F.col("c.k")).alias("n"), F.concat_ws(" ", "c.v.x", "c.v.y", "c.v.z").alias("line"))
    first = 3 * F.col("id")
    faces = triangles.select(F.lit(2).alias("part"), (F.col("id") + 1).alias("n"), F.concat_ws(" ", F.lit(3), first, first + 1, first + 2).alias("line"))
    return frame.unionByName(points).unionByName(faces)


def cloud_lines(points: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
    """Points (id, x, y, z) less the first position."""
    return points.select("id", F.concat_ws(" ", *[F.col(n) - o for n, o in zip("xyz", origin)]).alias("line"))


def slice_3d(spark: SparkSession, voxels: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int], empty: float) -> DataFrame:
    """Every place of the half-open box with its value, numbered with z outermost."""
    at = spark.range(hi[2] - lo[2]).select((F.col("id") + lo[2]).cast("int").alias("z"))
    for n, k in (("y", 1), ("x", 0)):
        at = at.withColumn(n, F.explode(F.sequence(F.lit(lo[k]), F.lit(hi[k] - 1))))
    sizes = [h - low for low, h in zip(lo, hi)]
    number = ((F.col("z") - lo[2]).cast("long") * sizes[1] + F.col("y") - lo[1]) * sizes[0] + F.col("x") - lo[0]
    return at.join(voxels.select("x", "y", "z", "value"), ["x", "y", "z"], "left").select(number.alias("n"), "x", "y", "z", F.coalesce("value", F.lit(empty)).alias("value"))


def block_corners(blocks: DataFrame, side: int = 8) -> DataFrame:
    """The eight corner points of each block (key, x, y, z)."""
    corner = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("corner")
    return blocks.select("key", "x", "y", "z", corner).select("key", "corner", *[(F.col(n) + F.shiftright("corner", i).bitwiseAND(F.lit(1)) * side).cast("int").alias(n) for i, n in enumerate("xyz")])


def summary_lines(summary: DataFrame) -> DataFrame:
    """A summary's rows as JSON, numbers as text with four places."""
    text = [F.format_string("%.4f", F.col(c).cast("double")).alias(c) for c in ("mean", "std", "min", "max", "sum")]
    return summary.select("key", F.to_json(F.struct(*text)).alias("line"))
