"""Files written from the given tables and read back, and sinks as rows, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from octofold.functions import keys as K
from octofold.jobs import sqltext as S
from octofold.operators import alloc, stats
from octofold.sources import adapters as A
from octofold.sources import files, formats, obj

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def folder(spark, name: str) -> str:
    return f"{A.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark, rows, name: str) -> str:
    """rows (line) as a text in the shared folder."""
    path = folder(spark, name)
    rows.write.text(path)
    return path


@query(f"WITH {S.TRAJ} SELECT stamp, tx, ty, tz FROM gt")
def file_trajectory(spark, d):
    """True poses as text, with comments and rows that don't count, read back."""
    t = A.traj(spark, d, "gt")
    pose = F.concat_ws(" ", "stamp", "tx", "ty", "tz", F.lit("0 0 0 1"))
    junk = F.when(F.col("tz") % 3 == 0, F.concat(F.lit("# "), pose)).otherwise(F.concat_ws(",", -F.col("stamp") - 1, F.lit("nan,1,1,0,0,0,1")))
    return files.trajectory(spark, written(spark, t.select(F.explode(F.array(pose, junk)).alias("line")), "poses")).select("stamp", "tx", "ty", "tz")


@query("SELECT rail, round(sum(p*dt),2) AS energy, round(sum(p*dt)/sum(dt),5) AS average, round(sum(dt),3) AS seconds FROM (SELECT r.rail, " + f"CASE r.rail WHEN 'A7' THEN value ELSE value*2e0 END AS p, {S.SECONDS} - lag({S.SECONDS}) OVER (PARTITION BY r.rail ORDER BY event_id) AS dt FROM events, (VALUES ('A7'), ('A15')) r(rail)) GROUP BY rail")
def file_power(spark, d):
    """A power report written and read back."""
    rows = A.table(spark, d, "events").select(A.seconds().alias("Sample_time"), F.col("value").alias("A7"), (F.col("value") * 2).alias("A15"))
    path = folder(spark, "power")
    rows.write.csv(path, sep="\t", header=True)
    e = files.energy(files.power_report(spark, path))
    return e.select("rail", F.round("energy", 2).alias("energy"), F.round("average", 5).alias("average"), F.round("seconds", 3).alias("seconds"))


@query("SELECT event_type AS key, max(event_id) AS seq FROM events GROUP BY 1")
def file_log_json(spark, d):
    """A log for each kind of event; its last JSON line."""
    e = A.table(spark, d, "events").select("event_type", "event_id", F.concat(F.lit('{"key": "'), "event_type", F.lit('", "seq": '), "event_id", F.lit("}")).alias("line"))
    path = folder(spark, "logs")
    e.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", F.explode(F.array("line", F.lit("frame done"))).alias("line")).write.partitionBy("event_type").text(path)
    return files.last_json(spark, f"{path}/*/*.txt", "key string, seq long").groupBy("key").agg(F.max("seq").alias("seq"))


@query(f"WITH {S.FRAMES} SELECT frame + 4*(v//50) AS frame, sum(CASE WHEN mm > 0 THEN 1 ELSE 0 END)::BIGINT AS n, sum(mm*(u+50*(v%50)))::BIGINT AS total FROM frames GROUP BY 1")
def raw_roundtrip(spark, d):
    """Frames written as a recording, and read back by the reader."""
    r = spark.read.format("raw_depth").load(recorded(spark, d))
    return r.groupBy("frame").agg(F.count(F.when(F.col("mm") > 0, 1)).alias("n"), F.sum((F.col("mm") * (F.col("u") + 50 * F.col("v"))).cast("long")).alias("total"))


RAW = ORACLE["raw_roundtrip"]


def recorded(spark, d) -> str:
    """A recording of all frames, in parts in the order of frames."""
    formats.register(spark)
    more = (F.floor(F.col("v") / 50) * 4).cast("int")
    f = A.frames(spark, d).select((F.col("frame") + more).alias("frame"), "u", (F.col("v") % 50).alias("v"), "mm")
    path = folder(spark, "raw")
    files.record(f, 50, 50).repartitionByRange("frame").sortWithinPartitions("frame").write.format("raw_depth").mode("append").save(path)
    return path


@query(RAW)
def raw_stream(spark, d):
    """The recording as a stream, each frame once, in batches."""
    path, home = recorded(spark, d), folder(spark, "recording")
    source = spark.readStream.format("raw_depth").load(path)
    query = source.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{home}/out/batch={n}")).option("checkpointLocation", f"{home}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    r = spark.read.schema("frame int, u int, v int, mm int, batch long").parquet(f"{home}/out")
    return r.groupBy("frame").agg(F.count(F.when(F.col("mm") > 0, 1)).alias("n"), F.sum((F.col("mm") * (F.col("u") + 50 * F.col("v"))).cast("long")).alias("total"))


def triangles(spark, d):
    """id, v0, v1, v2 of the vectors' first nine elements."""
    v = [F.struct(*[F.element_at("embedding", 3 * k + i + 1).cast("double").alias(n) for i, n in enumerate("xyz")]).alias(f"v{k}") for k in range(3)]
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *v)


CORNERS = [f"{n}{k}" for k in range(3) for n in "xyz"]
TRI = "t AS (SELECT vec_id AS id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(CORNERS)) + " FROM embeddings)"


def flat(t):
    return [F.col(f"v{c[1]}")[c[0]].alias(c) for c in CORNERS]


@query(f"WITH {TRI} SELECT CAST(0 AS INTEGER) AS tri, {', '.join(CORNERS)}, CAST(NULL AS VARCHAR) AS material FROM t")
def mesh_obj(spark, d):
    """A mesh written as OBJ by parts and read back."""
    formats.register(spark)
    path = folder(spark, "obj")
    triangles(spark, d).repartitionByRange("id").sortWithinPartitions("id").write.format("obj_mesh").mode("append").save(path)
    t = obj.load(spark, path, parts=True)
    return t.select("tri", *flat(t), "material")


@query(f"""WITH {TRI}, s AS (SELECT *, id // 100 AS scene FROM t) SELECT CAST(k.k AS INTEGER) AS tri, x0 AS x0, y0 AS y0, z0 AS z0, CASE k.k WHEN 0 THEN x1 ELSE x2 END AS x1, CASE k.k WHEN 0 THEN y1 ELSE y2 END AS y1, CASE k.k WHEN 0 THEN z1 ELSE z2 END AS z1, CASE k.k WHEN 0 THEN x2 ELSE x0+1 END AS x2, CASE k.k WHEN 0 THEN y2 ELSE y0+1 END AS y2, CASE k.k WHEN 0 THEN z2 ELSE z0+1 END AS z2,
 CASE WHEN scene * 100 + (id - scene * 100) // 7 * 7 < scene * 100 THEN NULL ELSE 'm' || CAST(scene * 100 + (id - scene * 100) // 7 * 7 AS VARCHAR) END AS material, CASE WHEN id - scene * 100 < 3 THEN NULL ELSE 'g ' || CAST((id - scene * 100 - 3) // 10 AS VARCHAR) END AS grp FROM s, range(0, 2) k(k)""")
def obj_scenes(spark, d):
    """Scenes of quadrilaterals in files of their own, with materials and groups that hold until
    the next, and corners that count from the start of the file or back from the last vertex."""
    v = lambda k, more=0.0: F.concat_ws(" ", F.lit("v"), *[F.col(f"v{k}")[n] + more for n in "xyz"])
    scene = F.floor(F.col("id") / 100)
    own = F.col("id") - scene * 100
    first = 4 * own + 1
    face = F.when(own % 2 == 0, F.lit("f -4/1 -3//2 -2 -1/1/1")).otherwise(F.concat_ws(" ", F.lit("f"), first, first + 1, F.concat(first + 2, F.lit("/7")), first + 3))
    use = F.when(own % 7 == 0, F.concat(F.lit("usemtl m"), F.col("id")))
    group = F.when((own >= 3) & ((own - 3) % 10 == 0), F.concat(F.lit("g g "), F.floor((own - 3) / 10)))
    rows = triangles(spark, d).select("id", scene.alias("scene"), F.explode(F.array_compact(F.array(F.lit("# a row"), use, group, v(0), v(1), v(2), v(0, 1.0), face))).alias("line"))
    path = folder(spark, "scenes")
    rows.repartition("scene").sortWithinPartitions("scene", "id").select("scene", "line").write.partitionBy("scene").text(path)
    t = obj.load(spark, f"{path}/*/*.txt")
    return t.select("tri", *flat(t), "material", "grp")


@query(f"WITH {TRI} SELECT 'points' AS kind, CAST(3*count(*) AS BIGINT) AS n, round(sum({'+'.join(CORNERS)}), 4) AS total FROM t UNION ALL SELECT 'polygons', count(*), round(sum(9e0*id+3), 4) FROM t UNION ALL SELECT 'head', CAST(6 AS BIGINT), CAST(3*count(*) + count(*) + 4*count(*) AS DOUBLE) FROM t")
def mesh_vtk(spark, d):
    """A mesh written as VTK by parts; its lines by kind, with the sums of their numbers."""
    formats.register(spark)
    path = folder(spark, "vtk")
    triangles(spark, d).repartitionByRange("id").sortWithinPartitions("id").write.format("vtk_mesh").mode("append").save(path)
    rows = spark.read.text(path).select(F.split("value", " ").alias("p"))
    number = lambda k: F.get("p", F.lit(k)).try_cast("double")
    kind = F.when(number(0).isNull(), "head").when(F.size("p") == 4, "polygons").otherwise("points")
    total = F.when(kind == "points", number(0) + number(1) + number(2)).when(kind == "polygons", number(1) + number(2) + number(3)).otherwise(F.coalesce(number(1), F.lit(0.0)) + F.coalesce(number(2), F.lit(0.0)))
    return rows.select(kind.alias("kind"), total.alias("t")).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("t"), 4).alias("total"))


@query(f"WITH {S.TRAJ}, f AS (SELECT arg_min(tx, stamp) AS fx, arg_min(ty, stamp) AS fy, arg_min(tz, stamp) AS fz FROM est) SELECT round(stamp, 3) AS stamp, round(tx-fx, 6)+0e0 AS x, round(ty-fy, 6)+0e0 AS y, round(tz-fz, 6)+0e0 AS z FROM est, f")
def cloud_rows(spark, d):
    """Positions less the first, a row of numbers a line, written and read back."""
    formats.register(spark)
    t = A.traj(spark, d, "est")
    first = t.agg(*[F.min_by(f"t{n}", "stamp").alias(f"f{n}") for n in "xyz"])
    path = folder(spark, "cloud")
    moved = t.crossJoin(F.broadcast(first)).select("stamp", *[(F.col(f"t{n}") - F.col(f"f{n}")).alias(n) for n in "xyz"])  # one row
    moved.repartitionByRange("stamp").sortWithinPartitions("stamp").write.format("number_rows").mode("append").save(path)
    rows = spark.read.text(path).select(F.split("value", " ").alias("p"))
    names = ("stamp", "x", "y", "z")
    return rows.select(*[(F.round(F.get("p", F.lit(k)).cast("double"), 6 if k else 3) + 0.0).alias(c) for k, c in enumerate(names)])


@query(f"WITH {S.POINTS} SELECT level, count(*) AS n, CAST(sum(key%1000003) AS BIGINT) AS keys FROM (SELECT DISTINCT {S.key('x', 'y', 'z', 'l.l')} AS key, CAST(l.l AS INTEGER) AS level FROM points, range(1,6) l(l)) GROUP BY level")
def map_roundtrip(spark, d):
    """A map saved by level and loaded."""
    v = alloc.voxels(A.points(spark, d), A.DEPTH)
    b = v.select("key").distinct()
    path = folder(spark, "map")
    files.save_map(alloc.levels(b, A.DEPTH), v, path)
    octants, _ = files.load_map(spark, path)
    return octants.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("key") % 1000003).alias("keys"))


LO, HI = (40, 50, 60), (72, 82, 76)


@query(f"WITH {S.POINTS}, vx AS (SELECT x, y, z, sum(val*w)/sum(w) AS value FROM points GROUP BY x, y, z) SELECT ((k-60)*32 + j-50)*32 + i-40 AS n, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, CAST(k AS INTEGER) AS z, round(coalesce(value, 1e0), 6) AS value FROM range(40,72) a(i), range(50,82) b(j), range(60,76) c(k) LEFT JOIN vx ON vx.x=i AND vx.y=j AND vx.z=k")
def slice_3d(spark, d):
    v = alloc.voxels(A.points(spark, d), A.DEPTH)
    return files.slice_3d(spark, v, LO, HI, 1.0).withColumn("value", F.round("value", 6))


@query(f"WITH {S.POINTS}, b AS (SELECT DISTINCT {S.block()} AS key, x-x%8 AS x, y-y%8 AS y, z-z%8 AS z FROM points) SELECT key, CAST(c.c AS INTEGER) AS corner, CAST(x+8*(c.c&1) AS INTEGER) AS x, CAST(y+8*((c.c>>1)&1) AS INTEGER) AS y, CAST(z+8*((c.c>>2)&1) AS INTEGER) AS z FROM b, range(0,8) c(c)")
def block_corners(spark, d):
    b = A.points(spark, d).select(*[(F.col(n) - F.col(n) % 8).alias(n) for n in "xyz"]).distinct()
    return files.block_corners(K.held(b, "x", "y", "z", key=K.block_key("x", "y", "z", A.DEPTH)))


@query("""SELECT event_id//5 AS frame, """ + ", ".join(f"round(coalesce(sum(CASE WHEN event_id%5={k} THEN value END),0e0),4) AS {n}" for k, n in enumerate(("acquisition", "preprocessing", "tracking", "integration", "raycasting"))) + ", round(sum(value),4) AS total FROM events GROUP BY 1")
def frame_log(spark, d):
    """A line for each frame with its phases and their total."""
    e = A.table(spark, d, "events").select(F.floor(F.col("event_id") / 5).alias("frame"), (F.col("event_id") % 5).alias("k"), "value")
    phases = [F.round(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("value"))), F.lit(0.0)), 4).alias(n) for k, n in enumerate(("acquisition", "preprocessing", "tracking", "integration", "raycasting"))]
    return e.groupBy("frame").agg(*phases, F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {S.TRAJ}, f AS (SELECT arg_min(tx, stamp) AS fx, arg_min(ty, stamp) AS fy, arg_min(tz, stamp) AS fz FROM est) SELECT row_number() OVER (ORDER BY stamp) - 1 AS frame, round(tx-fx, 6)+0e0 AS x, round(ty-fy, 6)+0e0 AS y, round(tz-fz, 6)+0e0 AS z FROM est, f")
def pose_log(spark, d):
    """Positions relative to the first, by frame."""
    t = A.traj(spark, d, "est").withColumn("one", F.lit(1).cast("long"))
    first = t.agg(*[F.min_by(f"t{n}", "stamp").alias(f"f{n}") for n in "xyz"])
    out = stats.running(t, "stamp", "one", "i").crossJoin(F.broadcast(first))  # one row
    return out.select((F.col("i") - 1).alias("frame"), *[(F.round(F.col(f"t{n}") - F.col(f"f{n}"), 6) + 0.0).alias(n) for n in "xyz"])


@query("""SELECT event_type AS key, '{"mean":"' || format('{:.4f}', avg(value)) || '","std":"' || format('{:.4f}', stddev_pop(value)) || '","min":"' || format('{:.4f}', min(value)) || '","max":"' || format('{:.4f}', max(value)) || '","sum":"' || format('{:.4f}', sum(value)) || '"}' AS line FROM events GROUP BY 1""")
def stats_json(spark, d):
    """The summary of each series as JSON text."""
    return files.summary_lines(stats.summary(A.samples(spark, d)))
