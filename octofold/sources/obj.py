"""Meshes as OBJ texts, of any size: lines are read in splits and numbered by running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octofold.operators import stats
from octofold.sources.files import ordered_lines


def counted(lines: DataFrame) -> DataFrame:
    """Each line with how many vertices, materials and groups came up to it in all files: running
    sums over ranges of lines."""
    kind = F.split_part("line", F.lit(" "), F.lit(1))
    marks = {"nv": kind == "v", "nm": kind == "usemtl", "ng": kind == "g"}
    rows = lines.withColumn("kind", kind).where(kind.isin("v", "f", "usemtl", "g"))
    for n, c in marks.items():
        rows = stats.running(rows.withColumn("one", c.cast("long")), "pos", "one", n).drop("one")
    return rows


def load(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Triangles of OBJ texts (``parts``: the files of a folder, in the order of their names, are one
    text): file, face (its number in the file order of all), tri (its place in the
    face's fan), v0, v1, v2 (structs x, y, z), material and grp (NULL before the first). Face
    corners are v, v/vt or v/vt/vn; negative numbers count back from the last vertex before; a
    corner that no vertex of its file has drops the triangle. Comments and other statements don't count."""
    rows = stats.checkpointed(counted(ordered_lines(spark, path)).withColumn("file", F.regexp_replace("pos.file", "/[^/]*$", "") if parts else F.col("pos.file")))
    part = F.split("line", " ")
    rest = F.expr("substr(line, locate(' ', line) + 1)")
    v = rows.where("kind = 'v'").select("nv", "file", F.struct(*[F.get(part, k + 1).try_cast("double").alias(n) for k, n in enumerate("xyz")]).alias("v"))
    named = {k: rows.where(F.col("kind") == w).select(n, "file", rest.alias(k)) for k, w, n in (("material", "usemtl", "nm"), ("grp", "g", "ng"))}
    base = rows.groupBy("file").agg(F.min(F.col("nv") - F.when(F.col("kind") == "v", 1).otherwise(0)).alias("base"))
    face = rows.where("kind = 'f'").join(base, "file")
    corner = F.transform(F.slice(part, 2, F.size(part)), lambda c: F.split_part(c, F.lit("/"), F.lit(1)).try_cast("long"))
    face = face.withColumn("c", F.transform(corner, lambda c: F.when(c < 0, F.col("nv") + c + 1).otherwise(F.col("base") + c)))
    fan = F.transform(F.sequence(F.lit(2), F.size("c") - 1), lambda k: F.struct((k - 2).cast("int").alias("tri"), F.array(F.get("c", F.lit(0)), F.get("c", k - 1), F.get("c", k)).alias("t")))
    tris = face.where("size(c) > 2").select("file", "pos", "nm", "ng", F.inline(fan))
    tris = tris.select("*", *[F.get("t", F.lit(k)).alias(f"i{k}") for k in range(3)]).drop("t")
    for k in range(3):
        tris = tris.join(v.select(F.col("nv").alias(f"i{k}"), "file", F.col("v").alias(f"v{k}")), [f"i{k}", "file"])
    for name, n in (("material", "nm"), ("grp", "ng")):
        tris = tris.join(named[name], [n, "file"], "left")
    return tris.select("file", F.col("pos").alias("face"), "tri", "v0", "v1", "v2", "material", "grp")
