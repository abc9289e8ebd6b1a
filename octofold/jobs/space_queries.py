"""Queries on geometry, rays and images, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from octofold.functions import keys as K
from octofold.jobs import sqltext as S
from octofold.operators import alloc
from octofold.operators import geometry as G
from octofold.operators import images as I
from octofold.operators import surface as R
from octofold.sources import adapters as A

D = A.DEPTH
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def two_sets(spark, d):
    """The boxes, and the boxes moved by one voxel and shrunk by two (to one at least)."""
    b = A.boxes(spark, d)
    moved = b.select("box_id", *[(F.col(n) + 1).alias(n) for n in ("bx", "by", "bz")], *[F.greatest(F.col(n) - 2, F.lit(1)).alias(n) for n in ("ex", "ey", "ez")])
    return b, moved


PAIR = """, moved AS (SELECT box_id, bx+1 AS bx, by_+1 AS by_, bz+1 AS bz, greatest(ex-2,1) AS ex, greatest(ey-2,1) AS ey, greatest(ez-2,1) AS ez FROM boxes)
SELECT a.box_id AS a_id, b.box_id AS b_id FROM boxes a JOIN moved b ON true"""


def sql_overlap(n, m):
    return f"abs(b.{n} + b.{m}//2 - a.{n} - a.{m}//2) <= (a.{m}+b.{m})//2"


@query(f"WITH {S.BOXES}{PAIR} AND {sql_overlap('bx', 'ex')} AND {sql_overlap('by_', 'ey')} AND {sql_overlap('bz', 'ez')}")
def aabb_overlap_join(spark, d):
    return G.pairs(*two_sets(spark, d), G.overlap).select(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"))


@query(f"WITH {S.BOXES}{PAIR} " + " ".join(f"AND a.{n} < b.{n} AND a.{n}+a.{m} > b.{n}+b.{m}" for n, m in (("bx", "ex"), ("by_", "ey"), ("bz", "ez"))))
def aabb_inclusion_join(spark, d):
    return G.pairs(*two_sets(spark, d), G.inside).select(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"))


def sql_touch(n: str, e: str, place: str, side: str) -> str:
    return f"abs({place}+({side})//2-{n}-{e}//2) <= ({e}+{side})//2"


_AXES = (("bx", "ex", "x"), ("by_", "ey", "y"), ("bz", "ez", "z"))


@query(f"""WITH {S.POINTS}, {S.BOXES}, vx AS (SELECT x, y, z, x-x%8 AS cx, y-y%8 AS cy, z-z%8 AS cz, CASE WHEN max(w) >= 4 THEN 2 WHEN max(w) >= 3 THEN 1 ELSE 0 END AS status FROM points GROUP BY x, y, z),
oc AS (SELECT DISTINCT CAST(l.l AS INTEGER) AS level, cx-cx%(256>>CAST(l.l AS INTEGER)) AS x, cy-cy%(256>>CAST(l.l AS INTEGER)) AS y, cz-cz%(256>>CAST(l.l AS INTEGER)) AS z FROM vx, range(0,6) l(l)),
ch AS (SELECT level+1 AS level, x+(128>>level)*CAST(i.i AS INTEGER) AS x, y+(128>>level)*CAST(j.j AS INTEGER) AS y, z+(128>>level)*CAST(k.k AS INTEGER) AS z FROM oc, range(0,2) i(i), range(0,2) j(j), range(0,2) k(k) WHERE level < 5),
ms AS (SELECT ch.*, 256>>ch.level AS s FROM ch ANTI JOIN oc ON oc.level=ch.level AND oc.x=ch.x AND oc.y=ch.y AND oc.z=ch.z),
bl AS (SELECT x, y, z FROM oc WHERE level=5),
r1 AS (SELECT box_id, 1 AS status FROM boxes JOIN ms ON {' AND '.join(sql_touch(n, e, 'ms.' + c, 'ms.s') for n, e, c in _AXES)}),
al AS (SELECT box_id, bl.x+CAST(i.i AS INTEGER) AS x, bl.y+CAST(j.j AS INTEGER) AS y, bl.z+CAST(k.k AS INTEGER) AS z FROM boxes JOIN bl ON {' AND '.join(sql_touch(n, e, 'bl.' + c, '8') for n, e, c in _AXES)}, range(0,8) i(i), range(0,8) j(j), range(0,8) k(k)
 WHERE {' AND '.join(sql_touch(n, e, f'(bl.{c}+CAST({i}.{i} AS INTEGER))', '1') for (n, e, c), i in zip(_AXES, 'ijk'))}),
r2 AS (SELECT box_id, coalesce(status, 1) AS status FROM al LEFT JOIN vx ON vx.x=al.x AND vx.y=al.y AND vx.z=al.z)
SELECT b.box_id, CASE coalesce(max(r.status), 0) WHEN 0 THEN 'empty' WHEN 1 THEN 'unseen' ELSE 'occupied' END AS status FROM boxes b LEFT JOIN (SELECT * FROM r1 UNION ALL SELECT * FROM r2) r ON r.box_id=b.box_id GROUP BY b.box_id""")
def box_octree_collision(spark, d):
    """Boxes against the voxels, unwritten voxels and missing children of the map of all
    samples."""
    status = F.when(F.max("w") >= 4, 2).when(F.max("w") >= 3, 1).otherwise(0)
    v = A.points(spark, d).groupBy("x", "y", "z").agg(status.alias("status"))
    v = K.held(v, "x", "y", "z", "status", key=K.block_key("x", "y", "z", D))
    blocks = v.select("key").distinct()
    slots = alloc.empty_slots(alloc.levels(blocks, D), D).withColumn("status", F.lit(1))
    return G.collide(A.boxes(spark, d), slots, v, blocks, D)


def sql_slab(n):
    o, dd, lo, hi = f"o{n}", f"d{n}", f"CAST(b.c{n} AS DOUBLE)", f"(CAST(b.c{n} AS DOUBLE)+8)"
    inside = f"{o} >= {lo} AND {o} <= {hi}"
    a, b = f"({lo}-{o})/nullif({dd},0)", f"({hi}-{o})/nullif({dd},0)"
    return (f"CASE WHEN {dd}=0 THEN (CASE WHEN {inside} THEN -1e9 ELSE 1e9 END) ELSE least({a},{b}) END", f"CASE WHEN {dd}=0 THEN (CASE WHEN {inside} THEN 1e9 ELSE -1e9 END) ELSE greatest({a},{b}) END")


_SLABS = [sql_slab(n) for n in "xyz"]
HITS = f"""WITH {S.POINTS}, {S.RAYS}, b AS (SELECT DISTINCT x - x%8 AS cx, y - y%8 AS cy, z - z%8 AS cz FROM points),
t AS (SELECT ray_id, {S.key('cx', 'cy', 'cz', '5')} AS key, greatest({', '.join(s[0] for s in _SLABS)}, 0e0) AS t_in, least({', '.join(s[1] for s in _SLABS)}) AS t_out FROM rays, b),
hits AS (SELECT * FROM t WHERE t_in <= t_out AND t_in <= 40e0)"""


def hits(spark, d):
    corner = A.points(spark, d).select(*[(F.col(n) - F.col(n) % 8).alias(n) for n in "xyz"]).distinct()
    blocks = A.checkpointed(K.held(corner, "x", "y", "z", key=K.block_key("x", "y", "z", D)))  # read once a level
    return G.ray_blocks(A.rays(spark, d), blocks, 40.0, D)


@query(f"{HITS} SELECT ray_id, key, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out FROM hits")
def ray_box_slab(spark, d):
    return hits(spark, d).select("ray_id", "key", F.round("t_in", 6).alias("t_in"), F.round("t_out", 6).alias("t_out"))


@query(f"{HITS} SELECT ray_id, round(min(t_in), 6) AS t_first, count(*) AS n_blocks FROM hits GROUP BY ray_id")
def ray_first_block(spark, d):
    return hits(spark, d).groupBy("ray_id").agg(F.round(F.min("t_in"), 6).alias("t_first"), F.count("*").alias("n_blocks"))


def depth_image(spark, d):
    return A.image(spark, d).select("u", "v", (F.col("mm") / 1000.0).alias("depth"))


IMG = f"{S.IMAGE}, img AS (SELECT u, v, mm/1000e0 AS depth FROM image)"


@query(f"WITH {S.IMAGE} SELECT u//2 AS u, v//2 AS v, mm/1000e0 AS depth FROM image WHERE u%2=0 AND v%2=0")
def mm_to_metres(spark, d):
    return I.metres(A.image(spark, d), 2)


@query(f"WITH {IMG}, c AS (SELECT u//2 AS u, v//2 AS v, depth AS c FROM img WHERE u%2=0 AND v%2=0) SELECT c.u AS u, c.v AS v, round(avg(i.depth), 6) AS depth FROM c JOIN img i ON i.u//2=c.u AND i.v//2=c.v WHERE abs(i.depth-c.c) < 0.3e0 GROUP BY c.u, c.v")
def half_sample(spark, d):
    return I.half_sample(depth_image(spark, d)).withColumn("depth", F.round("depth", 6))


@query(f"""WITH {IMG}, h AS (SELECT max(v) AS top FROM img), o AS (SELECT CAST(i.i AS INTEGER) AS i, CAST(j.j AS INTEGER) AS j FROM range(-2,3) i(i), range(-2,3) j(j)),
s AS (SELECT c.u AS cu, c.v AS cv, c.depth AS c, i*i+j*j AS r2, greatest(0, least(99, c.u+i)) AS u, greatest(0, least(h.top, c.v+j)) AS v FROM img c, o, h WHERE c.depth > 0),
n AS (SELECT s.*, img.depth, exp(-(r2/32e0)) * exp(-((img.depth-c)*(img.depth-c)/0.02e0)) AS wt FROM s JOIN img ON s.u=img.u AND s.v=img.v WHERE img.depth > 0)
SELECT cu AS u, cv AS v, round(sum(wt*depth)/sum(wt), 6) AS depth FROM n GROUP BY cu, cv UNION ALL SELECT u, v, 0e0 AS depth FROM img WHERE depth = 0""")
def bilateral(spark, d):
    image = depth_image(spark, d)
    height = image.agg(F.max("v")).first()[0] + 1
    return I.bilateral(image, 100, height).withColumn("depth", F.round("depth", 6))


VERTEX = f"{IMG}, vx AS (SELECT u, v, CASE WHEN depth>0 THEN depth*(u-50e0)/120e0 END AS x, CASE WHEN depth>0 THEN depth*(v-50e0)/120e0 END AS y, CASE WHEN depth>0 THEN depth END AS z FROM img)"


@query(f"WITH {VERTEX} SELECT u, v, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) AS z FROM vx")
def depth_to_vertex(spark, d):
    v = I.vertices(depth_image(spark, d), 120.0, 120.0, 50.0, 50.0)
    return v.select("u", "v", *[(F.round(n, 6) + 0.0).alias(n) for n in "xyz"])


@query(f"""WITH {VERTEX}, h AS (SELECT max(v) AS top FROM vx), n AS (SELECT c.u, c.v, c.z AS z, r.x-l.x AS ax, r.y-l.y AS ay, r.z-l.z AS az, d.x-t.x AS bx, d.y-t.y AS b_y, d.z-t.z AS bz
FROM vx c, h, vx r, vx l, vx d, vx t WHERE r.u=least(99,c.u+1) AND r.v=c.v AND l.u=greatest(0,c.u-1) AND l.v=c.v AND d.u=c.u AND d.v=least(h.top,c.v+1) AND t.u=c.u AND t.v=greatest(0,c.v-1)),
k AS (SELECT u, v, z, ay*bz-az*b_y AS kx, az*bx-ax*bz AS ky, ax*b_y-ay*bx AS kz FROM n), q AS (SELECT *, sqrt(kx*kx+ky*ky+kz*kz) AS norm FROM k)
SELECT u, v, round(CASE WHEN z IS NOT NULL AND norm>0 THEN kx/norm END, 5)+0e0 AS nx, round(CASE WHEN z IS NOT NULL AND norm>0 THEN ky/norm END, 5)+0e0 AS ny, round(CASE WHEN z IS NOT NULL AND norm>0 THEN kz/norm END, 5)+0e0 AS nz FROM q""")
def vertex_to_normal(spark, d):
    n = I.normals(I.vertices(depth_image(spark, d), 120.0, 120.0, 50.0, 50.0))
    return n.select("u", "v", *[(F.round(c, 5) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@query(f"""WITH {IMG}, h AS (SELECT u, v, depth, (depth-0.4e0)/3.6e0*6e0 AS h FROM img), s AS (SELECT *, CAST(floor(h) AS INTEGER) AS s, 0.75e0*0.6667e0*(h-floor(h)) AS f FROM h),
r AS (SELECT *, 0.25e0+f AS up, 0.75e0-f AS dn FROM s), c AS (SELECT *, CASE s WHEN 0 THEN 0.75e0 WHEN 1 THEN dn WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.25e0 WHEN 4 THEN up WHEN 5 THEN 0.75e0 END AS r, CASE s WHEN 0 THEN up WHEN 1 THEN 0.75e0 WHEN 2 THEN 0.75e0 WHEN 3 THEN dn WHEN 4 THEN 0.25e0 WHEN 5 THEN 0.25e0 END AS g, CASE s WHEN 0 THEN 0.25e0 WHEN 1 THEN 0.25e0 WHEN 2 THEN up WHEN 3 THEN 0.75e0 WHEN 4 THEN 0.75e0 WHEN 5 THEN dn END AS b FROM r)
SELECT u, v, CASE WHEN depth < 0.4e0 THEN 16777215 WHEN depth > 4e0 THEN 0 WHEN s BETWEEN 0 AND 5 THEN CAST(floor(r*255e0)*65536+floor(g*255e0)*256+floor(b*255e0) AS INTEGER) ELSE 0 END AS colour FROM c""")
def render_depth(spark, d):
    return depth_image(spark, d).select("u", "v", I.depth_colour(F.col("depth"), 0.4, 4.0).cast("int").alias("colour"))


@query(f"""WITH {S.IMAGE}, t AS (SELECT u, v, mm%8 - 6 AS result FROM image) SELECT u, v, CASE result WHEN 1 THEN 8421504 WHEN -1 THEN 0 WHEN -2 THEN 16711680 WHEN -3 THEN 65280 WHEN -4 THEN 255 WHEN -5 THEN 16776960 ELSE 16744448 END AS colour FROM t""")
def render_track(spark, d):
    return A.image(spark, d).select("u", "v", I.track_colour(F.col("mm") % 8 - 6).alias("colour"))


_TRI = "t AS (SELECT vec_id AS id, " + ", ".join(f"CAST(embedding[{3 * k + i + 1}] AS DOUBLE) AS {n}{k}" for k in range(3) for i, n in enumerate("xyz")) + " FROM embeddings)"


def nine(spark, d):
    """Triangles of the vectors' first nine elements."""
    v = [F.struct(*[F.element_at("embedding", 3 * k + i + 1).cast("double").alias(n) for i, n in enumerate("xyz")]).alias(f"v{k}") for k in range(3)]
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *v)


@query(f"""WITH {_TRI}, c AS (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS kx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS ky, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS kz FROM t), n AS (SELECT *, sqrt(kx*kx+ky*ky+kz*kz) AS norm FROM c)
SELECT id, {', '.join(f'round(k{n}/nullif(norm,0), 6)+0e0 AS n{n}' for n in 'xyz')}, round(norm/2e0, 8)+0e0 AS area, {', '.join(f'round({f}({n}0,{n}1,{n}2), 7)+0e0 AS {s}{n}' for s, f in (('lo_', 'least'), ('hi_', 'greatest')) for n in 'xyz')} FROM n""")
def triangle_attributes(spark, d):
    """Normals, areas and boxes of the triangles of the vectors' first nine elements."""
    t = R.triangle_attributes(nine(spark, d))
    return t.select("id", *[(F.round(c, 8 if c == "area" else 6 if c[0] == "n" else 7) + 0.0).alias(c) for c in t.columns if c != "id"])


_DRAW = [f"((k.k*{a}+{b})%{m})/{m}e0" for a, b, m in ((7919, 13, 10007), (104729, 7, 9973), (1299709, 3, 9949))]


@query(f"""WITH {_TRI}, c AS (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS kx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS ky, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS kz FROM t),
a AS (SELECT *, sqrt(kx*kx+ky*ky+kz*kz)/2e0 AS area FROM c), r AS (SELECT *, sum(area) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM a), w AS (SELECT max(upto) AS whole, count(*) AS n FROM r),
p AS (SELECT k.k AS k, (k.k+{_DRAW[0]})/(4e0*n)*whole AS place, {_DRAW[1]} AS u0, {_DRAW[2]} AS v0 FROM w, range(0, (SELECT 4*n FROM w)) k(k)), q AS (SELECT k, place, CASE WHEN u0+v0>1 THEN 1e0-u0 ELSE u0 END AS u, CASE WHEN u0+v0>1 THEN 1e0-v0 ELSE v0 END AS v FROM p)
SELECT q.k, r.id, {', '.join(f'round(u*{n}0+v*{n}1+(1e0-(u+v))*{n}2, 6)+0e0 AS {n}' for n in 'xyz')} FROM q JOIN r ON q.place >= r.upto-r.area AND q.place < r.upto""")
def mesh_samples(spark, d):
    """Four points a triangle, spread by area."""
    t = nine(spark, d)
    return R.surface_samples(t, 4 * t.count()).select("k", "id", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])
