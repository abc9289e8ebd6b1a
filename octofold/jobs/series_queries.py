"""Queries on sample series and trajectories, each with its SQL oracle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from octofold.jobs import sqltext as S
from octofold.operators import poses as P
from octofold.operators import stats as T
from octofold.operators.tracking import horn
from octofold.sources import adapters as A

QUERIES, ORACLE = {}, {}
#: Seconds: association tolerance.
TOLERANCE = 1200.0
PHASES = ["view", "click", "error", "signup", "purchase"]
SAMPLES = "samples AS (SELECT event_type AS key, event_id AS seq, value FROM events)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"""WITH {SAMPLES}, s AS (SELECT key, count(*) AS n, avg(value) AS mean, min(value) AS min, max(value) AS max, sum(value) AS sum, stddev_pop(value) AS std FROM samples GROUP BY key)
SELECT key, n, round(mean,4) AS mean, min, max, round(sum,4) AS sum, round(std,4) AS std, round(sqrt(std*std*n/((SELECT max(n) FROM s)+1)),4) AS std_ref FROM s""")
def perf_stats(spark, d):
    return rounded(T.summary(A.samples(spark, d)), 4, "mean", "sum", "std", "std_ref")


@query(f"WITH {SAMPLES} SELECT key, arg_max(value, seq) AS last FROM samples GROUP BY key")
def perf_last(spark, d):
    return T.last(A.samples(spark, d))


@query(f"WITH {SAMPLES}, r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value) AS rn, count(*) OVER (PARTITION BY key) AS n FROM samples) SELECT key, value FROM r WHERE rn = CAST(floor((n-1)*0.95e0) AS BIGINT)+1")
def percentile_nearest(spark, d):
    return T.percentile(A.samples(spark, d), 0.95)


@query(f"WITH p AS (SELECT value AS p, {S.SECONDS} - lag({S.SECONDS}) OVER (ORDER BY event_id) AS dt FROM events) SELECT round(sum(p*dt),2) AS energy, round(sum(p*dt)/sum(dt),6) AS average, round(sum(dt),3) AS total FROM p")
def power_energy(spark, d):
    """The sum of power times the time since the sample before."""
    rows = A.table(spark, d, "events").select(A.seconds().alias("stamp"), F.col("value").alias("p"))
    t = T.in_order(rows, "stamp").withColumn("dt", F.col("stamp") - F.col("p_stamp"))
    return t.agg(F.round(F.sum(F.col("p") * F.col("dt")), 2).alias("energy"), F.round(F.sum(F.col("p") * F.col("dt")) / F.sum("dt"), 6).alias("average"), F.round(F.sum("dt"), 3).alias("total"))


@query(f"SELECT CAST(floor({S.SECONDS}/86400e0) AS BIGINT) AS day, event_type AS key, count(*) AS n, round(count(*)/sum(value),6) AS rate FROM events GROUP BY 1, 2")
def frame_rate_windows(spark, d):
    """Samples over their summed time in tumbling windows (of a day, for this table)."""
    events = A.table(spark, d, "events")
    w = F.window("ts", "1 day").getField("start")
    day = ((F.unix_micros(w.cast("timestamp")) - F.unix_micros(F.expr(A.EPOCH))) / 86_400_000_000).cast("long")
    return events.groupBy(day.alias("day"), F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.round(F.count("*") / F.sum("value"), 6).alias("rate"))


@query(f"""WITH {S.TRAJ}, c AS (SELECT e.stamp AS a, g.stamp AS b, abs(e.stamp-g.stamp) AS diff FROM est e JOIN gt g ON g.stamp > e.stamp-1200e0 AND g.stamp < e.stamp+1200e0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY diff, b) AS rn FROM c WHERE diff < 1200e0) SELECT a AS a_stamp, b AS b_stamp FROM r WHERE rn=1""")
def assoc_nearest(spark, d):
    return T.nearest(A.traj(spark, d, "est"), A.traj(spark, d, "gt"), TOLERANCE)


@query()
def assoc_one_to_one(spark, d):
    """Greedy one-to-one association; held against a plain greedy loop in the tests."""
    return T.one_to_one(A.traj(spark, d, "est"), A.traj(spark, d, "gt"), TOLERANCE)


MATCHED = f"""WITH {S.TRAJ}, c AS (SELECT e.stamp AS a, g.stamp AS b, abs(e.stamp-g.stamp) AS diff FROM est e JOIN gt g ON g.stamp > e.stamp-1200e0 AND g.stamp < e.stamp+1200e0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY diff, b) AS rn FROM c WHERE diff < 1200e0),
m AS (SELECT e.tx AS a_tx, e.ty AS a_ty, e.tz AS a_tz, g.tx AS b_tx, g.ty AS b_ty, g.tz AS b_tz, r.a AS stamp FROM r JOIN est e ON e.stamp=r.a JOIN gt g ON g.stamp=r.b WHERE rn=1)"""


def matched_stamps(spark, d):
    """a_stamp and b_stamp of the matched stamps, and both trajectories."""
    est, gt = A.traj(spark, d, "est"), A.traj(spark, d, "gt")
    return T.nearest(est, gt, TOLERANCE), est, gt


def matched_moments(spark, d):
    return T.pair_moments(*matched_stamps(spark, d))


def matched_pairs(spark, d):
    """All pairs of poses of matched stamps (a_*, b_*); equal poses of a stamp are one, and w says how
    many pairs a row stands for."""
    near, *sides = matched_stamps(spark, d)
    for s, rows in zip("ab", sides):
        poses = rows.groupBy("stamp", *T.AXES).agg(F.count("*").alias(f"c_{s}"))
        near = near.join(poses.select(F.col("stamp").alias(f"{s}_stamp"), *[F.col(n).alias(f"{s}_{n}") for n in T.AXES], f"c_{s}"), f"{s}_stamp")
    return near.withColumn("w", F.col("c_a") * F.col("c_b")).drop("c_a", "c_b")


def distance():
    d = [F.col(f"a_{n}") - F.col(f"b_{n}") for n in ("tx", "ty", "tz")]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


STATS = "count(e) AS n, round(sqrt(avg(e*e)),4) AS rmse, round(avg(e),4) AS mean, round(median(e),4) AS median, round(stddev_pop(e),4) AS std, round(min(e),4) AS min, round(max(e),4) AS max"


@query(f"{MATCHED}, x AS (SELECT sqrt((a_tx-b_tx)*(a_tx-b_tx)+(a_ty-b_ty)*(a_ty-b_ty)+(a_tz-b_tz)*(a_tz-b_tz)) AS e FROM m) SELECT {STATS} FROM x")
def ate_no_align(spark, d):
    e = matched_pairs(spark, d).select(distance().alias("e"), "w")
    return rounded(T.error_stats(e, weight="w"), 4, "rmse", "mean", "median", "std", "min", "max")


@query(f"{MATCHED} SELECT count(*) AS n, " + ", ".join(f"round(avg({s}_{n}),4) AS {s}{n}" for s in "ab" for n in ("tx", "ty", "tz")) + ", " + ", ".join(f"round(covar_pop(a_{m},b_{n})*count(*)/1e3,3) AS w_{m}_{n}" for m in ("tx", "ty", "tz") for n in ("tx", "ty", "tz")) + " FROM m")
def ate_moments(spark, d):
    m = matched_moments(spark, d)
    m = m.select(*[c for c in m.columns if c[0] != "v"]).withColumns({c: F.round(c, 4) for c in m.columns if c[0] in "ab"})
    return m.withColumns({c: F.round(F.col(c) / 1e3, 3) for c in m.columns if c[0] == "w"})


@query(f"{MATCHED}, f AS (SELECT arg_min(b_tx, stamp) AS fx, arg_min(b_ty, stamp) AS fy, arg_min(b_tz, stamp) AS fz FROM m) SELECT stamp, round(2*(a_tx+fx),4) AS x, round(2*(a_ty+fy),4) AS y, round(2*(a_tz+fz),4) AS z FROM m, f")
def remove_const_offset(spark, d):
    """Multiplier times (position plus the first true position), once for each true pose of the
    matched stamp."""
    near, est, gt = matched_stamps(spark, d)
    start = near.agg(F.min_by("b_stamp", "a_stamp").alias("stamp"))
    first = gt.join(F.broadcast(start), "stamp").agg(F.min(F.struct(*T.AXES)).alias("f"))  # one row each
    times = near.join(gt.groupBy(F.col("stamp").alias("b_stamp")).agg(F.count("*").alias("times")), "b_stamp")
    m = times.join(est.withColumnRenamed("stamp", "a_stamp"), "a_stamp").crossJoin(F.broadcast(first))
    m = m.select(F.col("a_stamp").alias("stamp"), *[F.round(2 * (F.col(f"t{n}") + F.col(f"f.t{n}")), 4).alias(n) for n in "xyz"], "times")
    return m.select("stamp", "x", "y", "z", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")


STEPS = f"""WITH {S.TRAJ}, o AS (SELECT stamp, tx, ty, tz, lag(tx) OVER w AS px, lag(ty) OVER w AS py, lag(tz) OVER w AS pz, lag(stamp) OVER w AS pstamp FROM gt WINDOW w AS (ORDER BY stamp)),
s AS (SELECT stamp, stamp-pstamp AS gap, coalesce(sqrt((tx-px)*(tx-px)+(ty-py)*(ty-py)+(tz-pz)*(tz-pz)),0e0) AS step FROM o)"""


def steps(spark, d):
    t = T.in_order(A.traj(spark, d, "gt"), "stamp")
    e = [F.col(n) - F.col(f"p_{n}") for n in ("tx", "ty", "tz")]
    step = F.coalesce(F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2]), F.lit(0.0))
    return t.select("stamp", (F.col("stamp") - F.col("p_stamp")).alias("gap"), step.alias("step"))


@query(f"{STEPS} SELECT stamp, round(sum(step) OVER (ORDER BY stamp ROWS UNBOUNDED PRECEDING),3) AS length FROM s")
def path_length(spark, d):
    return T.running(steps(spark, d), "stamp", "step", "length").select("stamp", F.round("length", 3).alias("length"))


@query(f"{STEPS}, m AS (SELECT median(gap) AS md FROM s), f AS (SELECT stamp, CASE WHEN gap >= 2*md THEN 1 ELSE 0 END AS cut FROM s, m) SELECT segment, count(*) AS n, min(stamp) AS first, max(stamp) AS last FROM (SELECT stamp, CAST(sum(cut) OVER (ORDER BY stamp ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f) GROUP BY segment")
def gap_segments(spark, d):
    """A new segment where the gap is twice the median or more."""
    s = steps(spark, d)
    md = T.median(s, "gap")
    cut = s.crossJoin(F.broadcast(md)).withColumn("cut", (F.coalesce(F.col("gap") >= 2 * F.col("md"), F.lit(False))).cast("long"))
    return T.running(cut, "stamp", "cut", "segment").groupBy("segment").agg(F.count("*").alias("n"), F.min("stamp").alias("first"), F.max("stamp").alias("last"))


@query("SELECT event_id, round(greatest(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0e0), 0e0), 6) AS delta FROM events")
def frame_delta(spark, d):
    """The difference to the sample before (of the same user), 0 when it decreases."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return A.table(spark, d, "events").select("event_id", F.round(F.greatest(F.coalesce(F.col("value") - before, F.lit(0.0)), F.lit(0.0)), 6).alias("delta"))


@query(f"{MATCHED}, o AS (SELECT *, lag(a_tx) OVER w AS pa_tx, lag(a_ty) OVER w AS pa_ty, lag(a_tz) OVER w AS pa_tz, lag(b_tx) OVER w AS pb_tx, lag(b_ty) OVER w AS pb_ty, lag(b_tz) OVER w AS pb_tz FROM m WINDOW w AS (ORDER BY stamp)), x AS (SELECT sqrt(power(a_tx-pa_tx-b_tx+pb_tx,2)+power(a_ty-pa_ty-b_ty+pb_ty,2)+power(a_tz-pa_tz-b_tz+pb_tz,2)) AS e FROM o) SELECT {STATS} FROM x")
def rpe_stats(spark, d):
    """Relative translation error of consecutive matched poses. Of the pairs of one stamp, those of
    one pose of a follow each other, each time with the same steps of b; so steps are counted, not pairs."""
    near, est, gt = matched_stamps(spark, d)
    row = F.struct(*T.AXES)
    ends = lambda rows, s: rows.groupBy(F.col("stamp").alias(f"{s}_stamp")).agg(F.count("*").alias(f"c_{s}"), F.min(row).alias(f"{s}_first"), F.max(row).alias(f"{s}_last"))
    before = F.lag(row).over(Window.partitionBy("stamp").orderBy(*T.AXES))
    within = lambda rows, s: rows.select(F.col("stamp").alias(f"{s}_stamp"), row.alias("now"), before.alias("before")).where("before IS NOT NULL")

    def error(a, pa, b, pb):
        sq = [F.pow(F.col(f"{a}.{n}") - F.col(f"{pa}.{n}") - F.col(f"{b}.{n}") + F.col(f"{pb}.{n}"), 2) for n in T.AXES]
        return F.sqrt(sq[0] + sq[1] + sq[2]).alias("e")

    stamps = T.checkpointed(near.join(ends(est, "a"), "a_stamp").join(ends(gt, "b"), "b_stamp"))
    one = F.lit(1).cast("long").alias("w")
    across = T.in_order(stamps.drop("b_stamp", "c_a", "c_b"), "a_stamp").select(error("a_first", "p_a_last", "b_first", "p_b_last"), one)
    a_steps = stamps.join(within(est, "a"), "a_stamp").select(error("now", "before", "b_first", "b_last"), one)
    b_steps = stamps.join(within(gt, "b"), "b_stamp").select(error("a_first", "a_first", "now", "before"), F.col("c_a").alias("w"))
    return rounded(T.error_stats(across.unionByName(a_steps).unionByName(b_steps), weight="w"), 4, "rmse", "mean", "median", "std", "min", "max")


@query("""SELECT user_id % 8 AS run, """ + ", ".join(f"round(avg(CASE WHEN event_type='{k}' THEN value END),4) AS avg_{k}" for k in PHASES) + " FROM events GROUP BY 1")
def run_pivot(spark, d):
    """One row for each run with the mean of every phase."""
    e = A.table(spark, d, "events").select((F.col("user_id") % 8).alias("run"), "event_type", "value")
    p = e.groupBy("run").pivot("event_type", PHASES).agg(F.round(F.avg("value"), 4))
    return p.select("run", *[F.col(k).alias(f"avg_{k}") for k in PHASES])


_Q = "CAST(user_id%5-2 AS DOUBLE) AS qx, CAST(event_id%7-3 AS DOUBLE) AS qy, CAST(event_id%3-1 AS DOUBLE) AS qz, CAST(1+event_id%2 AS DOUBLE) AS qw"
_M = "stamp, 1e0-s*(qy*qy+qz*qz) AS m00, s*(qx*qy-qz*qw) AS m01, s*(qx*qz+qy*qw) AS m02, tx AS m03, s*(qx*qy+qz*qw) AS m10, 1e0-s*(qx*qx+qz*qz) AS m11, s*(qy*qz-qx*qw) AS m12, ty AS m13, s*(qx*qz-qy*qw) AS m20, s*(qy*qz+qx*qw) AS m21, 1e0-s*(qx*qx+qy*qy) AS m22, tz AS m23"
POSES = ", ".join(f"{n}q AS (SELECT {S.SECONDS} AS stamp, value AS tx, CAST(user_id AS DOUBLE) AS ty, CAST(event_id%97 AS DOUBLE) AS tz, {_Q} FROM events WHERE event_type='{kind}'), {n}s AS (SELECT *, 2e0/(qx*qx+qy*qy+qz*qz+qw*qw) AS s FROM {n}q), {n} AS (SELECT {_M} FROM {n}s)" for n, kind in (("gt", "view"), ("est", "click")))


def sql_relative(a: str, b: str, out: str) -> str:
    """The inverse of a, then b, as twelve columns."""
    cols = []
    for r in range(3):
        cols += [f"{a}m0{r}*{b}m0{c}+{a}m1{r}*{b}m1{c}+{a}m2{r}*{b}m2{c} AS {out}m{r}{c}" for c in range(3)]
        cols.append("+".join(f"{a}m{k}{r}*({b}m{k}3-{a}m{k}3)" for k in range(3)) + f" AS {out}m{r}3")
    return ", ".join(cols)


_LEN, _ANG = (lambda p: f"sqrt({p}m03*{p}m03+{p}m13*{p}m13+{p}m23*{p}m23)"), (lambda p: f"acos(least(1e0, greatest(-1e0, ({p}m00+{p}m11+{p}m22-1e0)/2e0)))")
_PRE = lambda t, p: ", ".join(f"{t}.{c} AS {p}{c}" for c in P.POSE)
MOTION = f"WITH {POSES}, o AS (SELECT stamp, {', '.join(P.POSE)}, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in P.POSE)} FROM gt WINDOW w AS (ORDER BY stamp)), r AS (SELECT stamp, {sql_relative('', 'p_', 'r_')} FROM o), mo AS (SELECT stamp, coalesce({_LEN('r_')}, 0e0) AS step, coalesce({_ANG('r_')}, 0e0) AS turn FROM r)"


def posed(spark, d, src):
    return P.from_quaternion(A.poses(spark, d, src))


@query(f"{MOTION} SELECT stamp, round(sum(step) OVER w, 3) AS length, round(sum(turn) OVER w, 3) AS angle FROM mo WINDOW w AS (ORDER BY stamp ROWS UNBOUNDED PRECEDING)")
def path_motion(spark, d):
    """Path length and turned angle so far, from whole poses."""
    mo = P.motion(posed(spark, d, "gt"))
    a = T.running(mo, "stamp", "step", "length").select("stamp", F.round("length", 3).alias("length"))
    return a.join(T.running(mo, "stamp", "turn", "angle").select("stamp", F.round("angle", 3).alias("angle")), "stamp")


def sql_rpe(pairs: str) -> str:
    """Errors of pairs pq (i_stamp, j_stamp, i_*, j_*)."""
    return f"""{pairs}, md AS (SELECT 2*median(gap) AS lim FROM (SELECT stamp-lag(stamp) OVER (ORDER BY stamp) AS gap FROM gt)),
ga AS (SELECT e.stamp AS es, min(struct_pack(d := abs(g.stamp-e.stamp), s := g.stamp)).s AS gs FROM est e, gt g GROUP BY e.stamp),
pg AS (SELECT pq.*, {_PRE('gi', 'gi_')}, {_PRE('gj', 'gj_')} FROM pq JOIN ga a ON a.es=i_stamp JOIN ga b ON b.es=j_stamp JOIN gt gi ON gi.stamp=a.gs JOIN gt gj ON gj.stamp=b.gs, md WHERE abs(a.gs-i_stamp) <= lim AND abs(b.gs-j_stamp) <= lim),
re AS (SELECT i_stamp, j_stamp, {sql_relative('j_', 'i_', 'e_')}, {sql_relative('gj_', 'gi_', 'g_')} FROM pg), xe AS (SELECT i_stamp, j_stamp, {sql_relative('e_', 'g_', 'x_')} FROM re), er AS (SELECT i_stamp, j_stamp, {_LEN('x_')} AS trans, {_ANG('x_')} AS rot FROM xe)"""


def sql_delta(index: str, delta: float) -> str:
    return f"""WITH {POSES}, ix AS ({index}), nj AS (SELECT a.stamp AS si, min(struct_pack(d := abs(b.at-(a.at+{delta!r}e0)), p := b.at, s := b.stamp)).s AS sj FROM ix a, ix b GROUP BY a.stamp),
pq AS (SELECT si AS i_stamp, sj AS j_stamp, {_PRE('i', 'i_')}, {_PRE('j', 'j_')} FROM nj JOIN est i ON i.stamp=si JOIN est j ON j.stamp=sj WHERE sj <> (SELECT max(stamp) FROM est))"""


ERRORS = "i_stamp, j_stamp, round(trans, 4) AS trans, round(rot, 4) AS rot"


def rounded_errors(df):
    return df.select("i_stamp", "j_stamp", F.round("trans", 4).alias("trans"), F.round("rot", 4).alias("rot"))


@query(f"{sql_rpe(sql_delta('SELECT stamp, stamp AS at FROM est', 7200.0))} SELECT {ERRORS} FROM er")
def rpe_seconds(spark, d):
    """Relative pose errors of poses two hours apart."""
    return rounded_errors(P.delta_errors(posed(spark, d, "est"), posed(spark, d, "gt"), 7200.0, "s"))


@query(f"{sql_rpe(sql_delta('SELECT stamp, row_number() OVER (ORDER BY stamp)-1e0 AS at FROM est', 2.0))} SELECT {ERRORS} FROM er")
def rpe_frames(spark, d):
    """The same of every second pose."""
    return rounded_errors(P.delta_errors(posed(spark, d, "est"), posed(spark, d, "gt"), 2.0, "f"))


@query()
def rpe_metres(spark, d):
    """The same of poses 500 m of path apart; sums of lengths differ in their last bits, so SQL
    can choose another neighbour. Held against a plain version in the tests."""
    return rounded_errors(P.delta_errors(posed(spark, d, "est"), posed(spark, d, "gt"), 500.0, "m"))


SAMPLED = 10_000


@query(f"""{sql_rpe(f"WITH {POSES}, ix AS (SELECT *, row_number() OVER (ORDER BY stamp)-1 AS at FROM est), mx AS (SELECT count(*) AS n FROM est), pr AS (SELECT DISTINCT (m*7919+13)%n AS a, (m*104729+7)%n AS b FROM range(0,{SAMPLED}) r(m), mx), pq AS (SELECT i.stamp AS i_stamp, j.stamp AS j_stamp, {_PRE('i', 'i_')}, {_PRE('j', 'j_')} FROM pr JOIN ix i ON i.at=a JOIN ix j ON j.at=b)")} SELECT count(*) AS n, round(sqrt(avg(trans*trans)),4) AS rmse, round(avg(trans),4) AS mean, round(median(trans),4) AS median, round(stddev_pop(trans),4) AS std, round(min(trans),4) AS min, round(max(trans),4) AS max FROM er""")
def rpe_sampled(spark, d):
    """Pairs of poses drawn by a rule, SAMPLED at most; their translation errors."""
    est = T.checkpointed(P.indexed(posed(spark, d, "est"), "f"))
    n, m = est.count(), F.col("id")
    drawn = spark.range(SAMPLED).select(((m * 7919 + 13) % n).alias("a"), ((m * 104729 + 7) % n).alias("b")).distinct()
    side = lambda k, at: est.select(F.col("at").cast("long").alias(at), *[F.col(c).alias(f"{k}_{c}") for c in ("stamp", *P.POSE)])
    errors = P.pair_errors(drawn.join(side("i", "a"), "a").join(side("j", "b"), "b").drop("a", "b"), posed(spark, d, "gt"))
    return rounded(T.error_stats(T.checkpointed(errors.select("trans")), "trans"), 4, "rmse", "mean", "median", "std", "min", "max")


_AB = "+".join(f"(a_{n}-ma{n})*(b_{n}-mb{n})" for n in ("tx", "ty", "tz"))
_AA, _BB = (_AB.replace(x, y).replace(f"m{x[0]}t", f"m{y[0]}t") for x, y in (("b_", "a_"), ("a_", "b_")))


@query(f"{MATCHED}, cc AS (SELECT {', '.join(f'avg({s}_{n}) AS m{s}{n}' for s in 'ab' for n in ('tx', 'ty', 'tz'))} FROM m), s AS (SELECT avg({_AB}) AS ab, avg({_AA}) AS aa, avg({_BB}) AS bb FROM m, cc), kk AS (SELECT greatest(0e0, least(4e0, ab/aa)) AS k, ab, aa, bb FROM s) SELECT round(k, 3) AS scale, round(sqrt(k*k*aa-2*k*ab+bb), 3) AS rmse FROM kk")
def best_scale(spark, d):
    """The scale that gives the least error about the centroids. Three sums reach the
    driver, where the section search runs."""
    m = matched_moments(spark, d)
    total = lambda *names: sum((F.col(n) for n in names), F.lit(0.0))
    ab, aa, bb = [f"w_{n}_{n}" for n in T.AXES], [f"v_a_{n}" for n in T.AXES], [f"v_b_{n}" for n in T.AXES]
    r = m.select((total(*ab) / F.col("n")).alias("ab"), total(*aa).alias("aa"), total(*bb).alias("bb")).first()
    error = lambda k: max(0.0, k * k * r["aa"] - 2 * k * r["ab"] + r["bb"]) ** 0.5
    k = P.golden_section(0.0, 4.0, 1e-9, lambda x: error(x) ** 2)
    return spark.createDataFrame([(round(k, 3), round(error(k), 3))], "scale double, rmse double")


_W = [[f"covar_pop(a_t{i}, b_t{j})" for j in "xyz"] for i in "xyz"]
_M = {(i, j): "+".join(f"w{k}{i}*w{k}{j}" for k in range(3)) for i in range(3) for j in range(i, 3)}
_DET = "({0}00*({0}11*{0}22-{0}12*{0}21)-{0}01*({0}10*{0}22-{0}12*{0}20)+{0}02*({0}10*{0}21-{0}11*{0}20))"


@query(f"""{MATCHED}, w AS (SELECT {', '.join(f'{_W[i][j]} AS w{i}{j}' for i in range(3) for j in range(3))}, {'+'.join(f'var_pop(a_t{n})' for n in 'xyz')} AS aa, {'+'.join(f'var_pop(b_t{n})' for n in 'xyz')} AS bb FROM m),
g AS (SELECT *, {', '.join(f'{x} AS m{i}{j}' for (i, j), x in _M.items())}, {_DET.format('w')} AS det FROM w), q AS (SELECT *, (m00+m11+m22)/3e0 AS q FROM g), p AS (SELECT *, sqrt(((m00-q)*(m00-q)+(m11-q)*(m11-q)+(m22-q)*(m22-q)+2e0*(m01*m01+m02*m02+m12*m12))/6e0) AS p FROM q),
n AS (SELECT *, (m00-q)/p AS n00, m01/p AS n01, m02/p AS n02, m01/p AS n10, (m11-q)/p AS n11, m12/p AS n12, m02/p AS n20, m12/p AS n21, (m22-q)/p AS n22 FROM p), f AS (SELECT *, acos(greatest(-1e0, least(1e0, {_DET.format('n')}/2e0)))/3e0 AS phi FROM n),
e AS (SELECT *, q+2e0*p*cos(phi) AS e1, q+2e0*p*cos(phi+2e0*pi()/3e0) AS e3 FROM f), s AS (SELECT *, sqrt(e1)+sqrt(greatest(0e0, 3e0*q-e1-e3))+sign(det)*sqrt(greatest(0e0, e3)) AS s FROM e), k AS (SELECT *, greatest(0e0, least(4e0, s/aa)) AS k FROM s)
SELECT round(k, 3) AS scale, round(sqrt(greatest(0e0, k*k*aa-2e0*k*s+bb)), 3) AS rmse FROM k""")
def best_scale_aligned(spark, d):
    """A18 with A11: the scale whose best rigid alignment leaves the least error. The rotation is found
    anew for each scale that the section search tries, from the moments at the driver."""
    r = matched_moments(spark, d).first()
    w = np.array([[r[f"w_{i}_{j}"] / r["n"] for j in T.AXES] for i in T.AXES])
    aa, bb = (sum(r[f"v_{s}_{i}"] for i in T.AXES) for s in "ab")

    def error(k: float) -> float:
        turn, _ = horn(k * w, np.zeros(3), np.zeros(3))
        return max(0.0, k * k * aa - 2 * k * float(np.trace(turn @ w)) + bb) ** 0.5

    k = P.golden_section(0.0, 4.0, 1e-9, lambda x: error(x) ** 2)
    return spark.createDataFrame([(round(k, 3), round(error(k), 3))], "scale double, rmse double")


@query(f"WITH {S.TRAJ}, a AS (SELECT *, row_number() OVER (ORDER BY stamp) AS i FROM est), b AS (SELECT *, row_number() OVER (ORDER BY stamp) AS i FROM gt) SELECT a.stamp AS a_stamp, b.stamp AS b_stamp FROM a JOIN b USING (i)")
def assoc_positional(spark, d):
    """The i-th pose of one trajectory with the i-th of the other."""
    number = lambda src, name: T.running(A.traj(spark, d, src).select("stamp", F.lit(1).alias("one")), "stamp", "one", "i").select("i", F.col("stamp").alias(name))
    return number("est", "a_stamp").join(number("gt", "b_stamp"), "i").select("a_stamp", "b_stamp")
