"""Data sources that read and write files: parts, commits, aborts, growing recordings, OBJ texts, and
the sinks and readers that give lines or rows."""

import glob
import struct

import pytest
from pyspark.sql import functions as F

from octofold.sources import files, formats, obj

W, H = 5, 4


def images(spark, frames):
    return spark.createDataFrame([(k, u, v, 100 * k + v * W + u) for k in frames for u in range(W) for v in range(H)], "frame int, u int, v int, mm int")


def text(path):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))


def triangles(spark, n):
    corner = lambda k: F.struct(*[(F.col("id") * 10 + 3 * k + i + 0.5).alias(c) for i, c in enumerate("xyz")]).alias(f"v{k}")
    return spark.range(n).select("id", *[corner(k) for k in range(3)]).repartitionByRange(3, "id").sortWithinPartitions("id")


def write_recording(df, path, mode="append"):
    files.record(df, W, H).repartitionByRange(3, "frame").sortWithinPartitions("frame").write.format("raw_depth").mode(mode).save(path)


def test_recording_round_trip(spark, tmp_path):
    formats.register(spark)
    path = str(tmp_path / "raw")
    write_recording(images(spark, range(7)), path)
    back = spark.read.format("raw_depth").option("frames", "2").load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, images(spark, range(7)).collect()))
    with pytest.raises(Exception, match="files already"):
        write_recording(images(spark, range(2)), path)
    assert back.count() == 7 * W * H and not glob.glob(f"{path}/_*")
    write_recording(images(spark, range(2)), path, "overwrite")
    assert spark.read.format("raw_depth").load(path).count() == 2 * W * H


def test_an_abort_leaves_nothing(spark, tmp_path):
    formats.register(spark)
    path = str(tmp_path / "obj")
    bad = triangles(spark, 9).withColumn("v0", F.when(F.col("id") < 8, F.col("v0")))  # the last one cannot be written
    with pytest.raises(Exception):
        bad.write.format("obj_mesh").mode("append").save(path)
    assert not glob.glob(f"{path}/*")


def test_growing_recording_is_read_once(spark, tmp_path):
    formats.register(spark)
    path, home = tmp_path / "a.raw", str(tmp_path / "home")

    def add(frames):
        with open(path, "ab") as f:
            for k in frames:
                f.write(struct.pack("<II", W, H) + struct.pack(f"<{W * H}H", *[100 * k + i for i in range(W * H)]) + struct.pack("<II", W, H) + bytes(3 * W * H))

    def run():
        source = spark.readStream.format("raw_depth").load(str(path))
        query = source.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{home}/out/batch={n}")).option("checkpointLocation", f"{home}/state").start()
        query.processAllAvailable()
        add_more = list(more)
        more.clear()
        if add_more:  # while the stream runs
            add(add_more)
            query.processAllAvailable()
        query.stop()

    more = [3, 4]
    add(range(3))
    with open(path, "ab") as f:
        f.write(struct.pack("<II", W, H)[:0])
    run()
    add([5, 6])
    with open(path, "ab") as f:
        f.write(b"part of a frame")
    run()  # again, from the checkpoint
    got = spark.read.parquet(f"{home}/out").select("frame", "u", "v", "mm")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, images(spark, range(7)).collect()))


def test_meshes_as_text(spark, tmp_path):
    formats.register(spark)
    for kind in ("obj_mesh", "vtk_mesh"):
        triangles(spark, 5).write.format(kind).mode("append").save(str(tmp_path / kind))
    rows = [[10 * k + j + 0.5 for j in range(9)] for k in range(5)]
    points = [f"{r[3 * j]} {r[3 * j + 1]} {r[3 * j + 2]}" for r in rows for j in range(3)]
    assert text(tmp_path / "obj_mesh").splitlines() == ["# OBJ file format with ext .obj", "# vertex count = 15", "# face count = 5", *[f"v {p}" for p in points], *[f"f {3 * k + 1} {3 * k + 2} {3 * k + 3}" for k in range(5)]]
    vtk = text(tmp_path / "vtk_mesh").splitlines()
    assert vtk[4:20] == ["POINTS 15 FLOAT", *points] and vtk[20:] == ["POLYGONS 5 20", *[f"3 {3 * k} {3 * k + 1} {3 * k + 2}" for k in range(5)]]
    lines = [r.line for r in files.vtk_lines(triangles(spark, 5)).orderBy("part", "n").collect()]  # W2, W18 as rows
    assert lines == vtk
    spark.range(3).select((F.col("id") / 2).alias("x"), F.lit(1.0).alias("y"), F.lit(-1.5).alias("z")).coalesce(1).write.format("number_rows").mode("append").save(str(tmp_path / "cloud"))
    assert text(tmp_path / "cloud") == "0.0 1.0 -1.5\n0.5 1.0 -1.5\n1.0 1.0 -1.5\n"
    cloud = files.cloud_lines(spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 2.0, 2.5, 0.0)], "id int, x double, y double, z double"), (1.0, 2.0, 3.0))  # W4
    assert [r.line for r in cloud.orderBy("id").collect()] == ["0.0 0.0 0.0", "1.0 0.5 -3.0"]


def plain_obj(source):
    """One OBJ text, statement by statement."""
    v, out, material, group = [], [], None, None
    for line in source.splitlines():
        p = line.split()
        if not p:
            continue
        if p[0] == "v":
            v.append(tuple(float(c) for c in p[1:4]))
        elif p[0] == "usemtl":
            material = " ".join(p[1:])
        elif p[0] == "g":
            group = " ".join(p[1:])
        elif p[0] == "f":
            at = [int(c.split("/")[0]) for c in p[1:]]
            at = [c - 1 if c > 0 else len(v) + c for c in at]
            if len(at) > 2:
                out += [(k - 2, v[at[0]], v[at[k - 1]], v[at[k]], material, group) for k in range(2, len(at)) if all(0 <= c < len(v) for c in (at[0], at[k - 1], at[k]))]
    return out


def test_obj_reader(spark, tmp_path):
    """Several files, split among tasks, with all the forms of a face."""
    scenes = []
    for s in range(3):
        lines = ["# scene", "mtllib x.mtl", "v 0 0 0", "v 1\t0  0 1.0", "v 0 1 0", "f 1 2 3"]
        for k in range(40):
            lines += [f"v {k} {s} 0.5", f"v {k} {s} 1.5", "vn 0 0 1", "vt 0 1"]
            lines += [f"usemtl mat {k}"] * (k % 5 == 2) + [f"g part{k}  x"] * (k % 7 == 3)
            lines += ["f -1 -2 -3", "f 1/2 2//3 3/4/5 4", "f 1 2", "", "  f 1 2 3 -1 -2  ", "f 999 1 2", "o thing", "s off"]
        scenes.append("\r\n".join(lines) if s == 1 else "\n".join(lines))
        (tmp_path / f"s{s}.obj").write_text(scenes[-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = obj.load(spark, f"{tmp_path}/*.obj").orderBy("face", "tri").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {s: [(r.tri, tuple(r.v0), tuple(r.v1), tuple(r.v2), r.material, r.grp) for r in rows if r.file.endswith(f"s{s}.obj")] for s in range(3)}
    for s in range(3):
        assert got[s] == [(t, a, b, c, m, g and " ".join(g.split())) for t, a, b, c, m, g in plain_obj(scenes[s])]


def test_depths_and_times(spark, tmp_path):
    """S3: ray lengths to depths; S13: times beside the rows of a result."""
    one = spark.createDataFrame([(319, 239, 2.0), (0, 0, 2.0)], "u int, v int, length double")
    got = {(r.u, r.v): r.depth for r in files.scene_depth(one).collect()}
    x, y = (0 - 319.5) / 481.2, (0 - 239.5) / -480.0
    assert abs(got[0, 0] - 2.0 / (x * x + y * y + 1) ** 0.5) < 1e-12 and 1.99999 < got[319, 239] <= 2.0
    (tmp_path / "r.txt").write_text("9 1 2\n8 3 4\n7 5 6\n")
    (tmp_path / "t.txt").write_text("0.5\n1.5\n")
    rows = files.timed_results(spark, str(tmp_path / "r.txt"), str(tmp_path / "t.txt")).orderBy("n").collect()
    assert [(r.stamp, r.fields) for r in rows] == [("0.5", ["1", "2"]), ("1.5", ["3", "4"])]
