"""Queries on keys, allocation and access, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from octofold.functions import keys as K
from octofold.jobs import sqltext as S
from octofold.operators import access, alloc
from octofold.sources import adapters as A

D, BL = A.DEPTH, A.BLOCK_LEVEL
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def mixed(spark, d):
    return K.held(A.mixed_keys(spark, d), key=K.encode("x", "y", "z", "level", D)).distinct()


MIXED = f"WITH {S.MIXED}, keys AS (SELECT DISTINCT {S.key('x', 'y', 'z', 'level')} AS key, x - x%(1<<(8-level)) AS x, y - y%(1<<(8-level)) AS y, z - z%(1<<(8-level)) AS z, level, 1<<(8-level) AS side FROM mixed)"


@query(f"WITH {S.POINTS} SELECT DISTINCT x, y, z, {S.morton('x', 'y', 'z')} AS code FROM points")
def morton_encode(spark, d):
    return A.points(spark, d).select("x", "y", "z").distinct().withColumn("code", K.morton("x", "y", "z"))


@query(f"WITH {S.POINTS} SELECT DISTINCT {S.morton('x', 'y', 'z')} AS code, x, y, z FROM points")
def morton_roundtrip(spark, d):
    codes = A.points(spark, d).select(K.morton("x", "y", "z").alias("code")).distinct()
    return codes.select("code", *[c.alias(n) for c, n in zip(K.unpack("code"), "xyz")])


@query(f"{MIXED} SELECT key, key - level AS code, level, x, y, z FROM keys")
def key_decode(spark, d):
    x, y, z = K.corner("key")
    return mixed(spark, d).select("key", K.code_of("key").alias("code"), K.level_of("key").alias("level"), x.alias("x"), y.alias("y"), z.alias("z"))


@query(f"{MIXED} SELECT key, {S.key('x', 'y', 'z', '(level-1)')} AS parent FROM keys")
def key_parent(spark, d):
    return mixed(spark, d).select("key", K.parent("key", D).alias("parent"))


@query(f"{MIXED} SELECT key, CAST((x//side)%2 + 2*((y//side)%2) + 4*((z//side)%2) AS INTEGER) AS child_id FROM keys")
def key_child_id(spark, d):
    return mixed(spark, d).select("key", K.child_id("key", D).alias("child_id"))


@query(f"{MIXED} SELECT key, CAST(x + side*((x//side)%2) AS INTEGER) AS fx, CAST(y + side*((y//side)%2) AS INTEGER) AS fy, CAST(z + side*((z//side)%2) AS INTEGER) AS fz FROM keys")
def key_far_corner(spark, d):
    return mixed(spark, d).select("key", *[c.alias(f"f{n}") for c, n in zip(K.far_corner("key", D), "xyz")])


@query(f"""{MIXED} SELECT key, f.face, CAST(x + side*f.dx AS INTEGER) AS x, CAST(y + side*f.dy AS INTEGER) AS y, CAST(z + side*f.dz AS INTEGER) AS z
FROM keys, (VALUES (0,-1,0,0),(1,1,0,0),(2,0,-1,0),(3,0,1,0),(4,0,0,-1),(5,0,0,1)) f(face,dx,dy,dz)""")
def key_face_neighbours(spark, d):
    return mixed(spark, d).select("key", F.inline(K.face_neighbours("key", D)))


@query(f"""{MIXED}, far AS (SELECT key, level, x + side*((x//side)%2) AS fx, y + side*((y//side)%2) AS fy, z + side*((z//side)%2) AS fz,
 2*((x//side)%2)-1 AS dx, 2*((y//side)%2)-1 AS dy, 2*((z//side)%2)-1 AS dz FROM keys),
moved AS (SELECT *, CASE WHEN fx+dx BETWEEN 0 AND 255 THEN fx+dx ELSE fx END AS mx, CASE WHEN fy+dy BETWEEN 0 AND 255 THEN fy+dy ELSE fy END AS my, CASE WHEN fz+dz BETWEEN 0 AND 255 THEN fz+dz ELSE fz END AS mz FROM far),
o AS (SELECT key, level, CAST(n.n AS INTEGER) AS n, CASE WHEN n.n & 1 = 1 THEN mx ELSE fx END AS nx, CASE WHEN n.n & 2 = 2 THEN my ELSE fy END AS ny, CASE WHEN n.n & 4 = 4 THEN mz ELSE fz END AS nz FROM moved, range(1,8) n(n))
SELECT key, n, {S.key('nx', 'ny', 'nz', 'level')} AS neighbour FROM o""")
def key_exterior_neighbours(spark, d):
    return K.exterior_neighbours(mixed(spark, d), "key", D)


@query(f"""{MIXED}, up AS (SELECT key, level, side, x - x%(2*side) AS px, y - y%(2*side) AS py, z - z%(2*side) AS pz FROM keys),
o AS (SELECT key, level, CAST(n.n AS INTEGER) AS n, px + side*(n.n & 1) AS nx, py + side*((n.n >> 1) & 1) AS ny, pz + side*((n.n >> 2) & 1) AS nz FROM up, range(0,8) n(n))
SELECT key, n, {S.key('nx', 'ny', 'nz', 'level')} AS sibling FROM o""")
def key_siblings(spark, d):
    return mixed(spark, d).select("key", F.posexplode(K.siblings("key", D)).alias("n", "sibling"))


@query(f"""{MIXED} SELECT a.key AS key, b.key AS ancestor FROM keys a JOIN keys b ON b.level <= a.level AND a.x - a.x%b.side = b.x AND a.y - a.y%b.side = b.y AND a.z - a.z%b.side = b.z""")
def key_descendant(spark, d):
    keyed = mixed(spark, d)
    named = alloc.prefixes(keyed, D, 0)
    return named.join(keyed.select(F.col("key").alias("up")), "up").where(K.descendant("key", "up", D)).select("key", F.col("up").alias("ancestor"))


@query(f"WITH {S.POINTS} SELECT level, code, count(*) AS n FROM (SELECT CAST(l.l AS INTEGER) AS level, {S.key('x', 'y', 'z', 'l.l')} - l.l AS code FROM points, range(1,6) l(l)) GROUP BY level, code")
def prefix_masks(spark, d):
    codes = A.points(spark, d).select(K.morton("x", "y", "z").alias("m"), F.explode(F.sequence(F.lit(1), F.lit(BL))).alias("level"))
    return codes.groupBy("level", K.cut("m", "level", D).alias("code")).agg(F.count("*").alias("n"))


@query(f"""{MIXED} SELECT key FROM keys a WHERE NOT EXISTS (SELECT 1 FROM keys b WHERE b.level > a.level AND b.x - b.x%a.side = a.x AND b.y - b.y%a.side = a.y AND b.z - b.z%a.side = a.z)""")
def filter_ancestors(spark, d):
    return alloc.filter_ancestors(mixed(spark, d), D)


@query(f"{MIXED} SELECT key - level AS code, max(key) AS key FROM keys WHERE level >= 3 GROUP BY 1")
def unique_multiscale(spark, d):
    return alloc.unique_multiscale(mixed(spark, d), 3)


LEVELS = f"{MIXED}, octants AS (SELECT DISTINCT {S.key('x', 'y', 'z', 'l.l')} AS key, CAST(l.l AS INTEGER) AS level FROM keys, range(1,6) l(l) WHERE l.l <= level)"


@query(f"{LEVELS} SELECT key, level FROM octants")
def allocate_levels(spark, d):
    return alloc.levels(mixed(spark, d), D)


@query(f"""{MIXED}, octants AS (SELECT DISTINCT x - x%(1<<(8-CAST(l.l AS INTEGER))) AS ox, y - y%(1<<(8-CAST(l.l AS INTEGER))) AS oy, z - z%(1<<(8-CAST(l.l AS INTEGER))) AS oz, CAST(l.l AS INTEGER) AS level, 1<<(8-CAST(l.l AS INTEGER)) AS s FROM keys, range(1,6) l(l) WHERE l.l <= level)
SELECT {S.key('ox', 'oy', 'oz', '(level-1)')} AS key, CAST(bit_or(1 << CAST((ox//s)%2 + 2*((oy//s)%2) + 4*((oz//s)%2) AS INTEGER)) AS INTEGER) AS mask FROM octants GROUP BY 1""")
def children_mask(spark, d):
    return alloc.children_mask(alloc.levels(mixed(spark, d), D), D)


@query(f"{LEVELS} SELECT CAST(sum(CASE WHEN level=5 THEN 1 ELSE 0 END) AS BIGINT) AS leaves, count(*) + 1 AS nodes FROM octants")
def leaves_nodes_count(spark, d):
    return alloc.counts(alloc.levels(mixed(spark, d), D), D)


@query(f"""WITH {S.POINTS}, a AS (SELECT DISTINCT {S.block()} AS key FROM points WHERE w <= 2), b AS (SELECT DISTINCT {S.block()} AS key FROM points WHERE w > 2)
SELECT key, 5 AS level FROM b WHERE key NOT IN (SELECT key FROM a)""")
def new_blocks_anti(spark, d):
    p = K.held(A.points(spark, d), "w", key=K.block_key("x", "y", "z", D))
    return alloc.allocate(p.where("w > 2").select("key").distinct(), p.where("w <= 2").select("key").distinct(), D).where(F.col("level") == BL)


VOXELS = f"voxels AS (SELECT {S.block()} AS key, {S.SLOT} AS slot, x, y, z, sum(val*w)/sum(w) AS value, CAST(sum(w) AS BIGINT) AS weight FROM points GROUP BY x, y, z)"


@query(f"WITH {S.POINTS}, {VOXELS} SELECT key, count(*) AS n_voxels, CAST(sum(weight) AS BIGINT) AS weight, round(sum(value), 4) AS total FROM voxels GROUP BY key")
def map_build(spark, d):
    v = alloc.voxels(A.points(spark, d), D)
    return v.groupBy("key").agg(F.count("*").alias("n_voxels"), F.sum("weight").alias("weight"), F.round(F.sum("value"), 4).alias("total"))


def a_map(spark, d):
    """The map of samples with w <= 3: voxels and blocks."""
    v = alloc.voxels(A.points(spark, d).where("w <= 3"), D)
    return v, v.select("key").distinct()


A_MAP = f"""{S.POINTS}, mp AS (SELECT * FROM points WHERE w <= 3), voxels AS (SELECT {S.block()} AS key, {S.SLOT} AS slot, x, y, z, sum(val*w)/sum(w) AS value, CAST(sum(w) AS BIGINT) AS weight FROM mp GROUP BY x, y, z),
blocks AS (SELECT DISTINCT key FROM voxels)"""
PROBES = "SELECT DISTINCT x, y, z FROM points WHERE w > 3"


@query(f"""WITH {A_MAP}, probes AS ({PROBES}), p AS (SELECT *, {S.block()} AS key, {S.SLOT} AS slot FROM probes)
SELECT p.x, p.y, p.z, round(CASE WHEN b.key IS NULL THEN NULL ELSE coalesce(v.value, 1e0) END, 6) AS value FROM p LEFT JOIN blocks b ON p.key=b.key LEFT JOIN voxels v ON p.key=v.key AND p.slot=v.slot""")
def voxel_get_fine(spark, d):
    v, b = a_map(spark, d)
    probes = A.points(spark, d).where("w > 3").select("x", "y", "z").distinct()
    return access.get_fine(probes, v, b, D, 1.0).withColumn("value", F.round("value", 6))


@query(f"""{MIXED}, octants AS (SELECT key, level, x, y, z, side, CAST(key%1000 AS DOUBLE) AS value FROM keys WHERE level < 5), probes AS (SELECT c_custkey AS id, CAST(c_custkey*29%256 AS INTEGER) AS x, CAST(c_custkey*31%256 AS INTEGER) AS y, CAST(c_custkey*37%256 AS INTEGER) AS z FROM customer),
m AS (SELECT p.id, o.key, o.level, o.value, row_number() OVER (PARTITION BY p.id ORDER BY o.level DESC) AS rn FROM probes p LEFT JOIN octants o ON p.x - p.x%o.side = o.x AND p.y - p.y%o.side = o.y AND p.z - p.z%o.side = o.z)
SELECT id, key, level, value FROM m WHERE rn = 1""")
def voxel_get_hierarchical(spark, d):
    octants = mixed(spark, d).where(K.level_of("key") < BL).select("key", F.pmod("key", F.lit(1000)).cast("double").alias("value"))
    c = F.col("c_custkey")
    probes = A.table(spark, d, "customer").select(c.alias("id"), *[F.pmod(c * k, F.lit(256)).cast("int").alias(n) for k, n in ((29, "x"), (31, "y"), (37, "z"))])
    return access.get_hierarchical(probes, octants, D)


@query(f"""WITH {A_MAP}, u AS (SELECT {S.block()} AS key, {S.SLOT} AS slot, max(val) AS value FROM points WHERE w > 3 GROUP BY 1, 2) SELECT key, slot, value FROM u WHERE key IN (SELECT key FROM blocks)""")
def voxel_set(spark, d):
    _, b = a_map(spark, d)
    return access.set_if_present(A.points(spark, d).where("w > 3").select("x", "y", "z", F.col("val").alias("value")), b, D)


LO, HI = (40, 50, 60), (59, 66, 71)


@query(f"""WITH {S.POINTS}, c AS (SELECT DISTINCT x - x%8 AS bx, y - y%8 AS b_y, z - z%8 AS bz FROM points), v AS (SELECT bx, b_y, bz, bx + CAST(i.i AS INTEGER) AS x, b_y + CAST(j.j AS INTEGER) AS y, bz + CAST(k.k AS INTEGER) AS z FROM c, range(0,8) i(i), range(0,8) j(j), range(0,8) k(k) WHERE bx BETWEEN 32 AND 58 AND b_y BETWEEN 42 AND 65 AND bz BETWEEN 52 AND 70)
SELECT {S.key('bx', 'b_y', 'bz', '5')} AS key, x, y, z, CAST(x+y+z AS DOUBLE) AS value FROM v WHERE x>=40 AND x<59 AND y>=50 AND y<66 AND z>=60 AND z<71""")
def axis_aligned_update(spark, d):
    blocks = K.held(A.points(spark, d), key=K.block_key("x", "y", "z", D)).distinct()
    return access.block_update(blocks, LO, HI, (F.col("x") + F.col("y") + F.col("z")).cast("double"))


@query(f"""{MIXED}, s AS (SELECT key, CAST(n.n AS INTEGER) AS child, CAST(x + (side//2)*(n.n&1) AS INTEGER) AS x, CAST(y + (side//2)*((n.n>>1)&1) AS INTEGER) AS y, CAST(z + (side//2)*((n.n>>2)&1) AS INTEGER) AS z FROM keys, range(0,8) n(n) WHERE level < 5)
SELECT key, child, x, y, z, 10e0 AS value FROM s WHERE x BETWEEN 100 AND 151 AND y BETWEEN 100 AND 151 AND z BETWEEN 100 AND 151""")
def axis_aligned_nodes(spark, d):
    return access.node_update(mixed(spark, d).where(K.level_of("key") < BL), D, (100,) * 3, (151,) * 3, F.lit(10.0))


@query(f"""{MIXED}, o AS (SELECT DISTINCT CAST(l.l AS INTEGER) AS level, 1<<(8-CAST(l.l AS INTEGER)) AS side, x - x%(1<<(8-CAST(l.l AS INTEGER))) AS x, y - y%(1<<(8-CAST(l.l AS INTEGER))) AS y, z - z%(1<<(8-CAST(l.l AS INTEGER))) AS z FROM keys, range(1,6) l(l) WHERE l.l <= level)
SELECT CASE WHEN level=5 THEN 1 ELSE 0 END AS kind, {S.key('x', 'y', 'z', 'level')} AS key, x, y, z, side FROM o""")
def node_iterate(spark, d):
    return access.iterate(alloc.levels(mixed(spark, d), D), D)


@query(f"""WITH {S.POINTS}, b AS (SELECT {S.block()} AS key, max(w) >= 7 AS active, x - x%8 AS x, y - y%8 AS y, z - z%8 AS z FROM points GROUP BY 1, 3, 4, 5) SELECT key, active, x, y, z FROM b WHERE active OR (x < 64 AND z < 64)""")
def active_blocks(spark, d):
    blocks = K.held(A.points(spark, d), "w", key=K.block_key("x", "y", "z", D)).groupBy("key").agg((F.max("w") >= 7).alias("active"))
    x, y, z = K.corner("key")
    placed = K.held(blocks, "key", "active", x=x, y=y, z=z)
    return access.any_of(placed, F.col("active"), (F.col("x") < 64) & (F.col("z") < 64))
