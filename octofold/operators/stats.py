"""Sample series and trajectories: summaries, associations and errors."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octofold.sources.adapters import checkpointed


def summary(samples: DataFrame) -> DataFrame:
    """By key; std_ref divides by the longest series plus one, as the original report."""
    by = samples.groupBy("key").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.stddev_pop("value").alias("std"))
    longest = by.agg(F.max("n").alias("longest"))
    ref = F.sqrt(F.col("std") * F.col("std") * F.col("n") / (F.col("longest") + 1))
    return by.crossJoin(F.broadcast(longest)).select("key", "n", "mean", "min", "max", "sum", "std", ref.alias("std_ref"))


def last(samples: DataFrame) -> DataFrame:
    return samples.groupBy("key").agg(F.max_by("value", "seq").alias("last"))


#: Rows of a table that may be broadcast, after they were counted; ranges of an ordered table, and
#: rows of a range; share of a series around a rank that is sorted.
SMALL, RANGES, RANGE_ROWS, CLOSE = 100_000, 1_000, 100_000, 10_000
#: Stamps that one task associates after the ranges.
RUN_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def at_ranks(samples: DataFrame, **ranks) -> DataFrame:
    """key and, for each name, the value of that rank (a function of n, from 0) in its sorted
    series. Approximate quantiles, whose error is bounded, enclose the rank; values below are
    counted and only those between are sorted, so that no task sorts a whole series."""
    n = F.col("n")
    out = None
    for name, rank in ranks.items():
        counts = samples.groupBy("key").agg(F.count("*").alias("n"), F.percentile_approx("value", F.array(*[F.lit(q / CLOSE) for q in range(0, CLOSE + 1, CLOSE // 200)]), CLOSE).alias("q"))
        share = rank(n) / F.greatest(n - 1, F.lit(1)) * 200
        low, high = F.greatest(F.lit(0), F.floor(share - 0.1)).cast("int"), F.least(F.lit(200), F.ceil(share + 0.1)).cast("int")
        bounds = counts.select("key", rank(n).cast("long").alias("rank"), F.get("q", low).alias("lo"), F.get("q", high).alias("hi"))
        flat = bounds.where("lo = hi").select("key", F.col("lo").alias(name))  # one value makes up the place
        near = samples.select("key", "value").join(small(bounds.where("lo < hi")), "key")
        below = near.groupBy("key").agg(F.count(F.when(F.col("value") < F.col("lo"), 1)).alias("below"))
        place = F.row_number().over(Window.partitionBy("key").orderBy("value")) - 1
        between = near.where("value between lo and hi").withColumn("place", place).join(small(below), "key")
        found = between.where("place + below = rank").select("key", F.col("value").alias(name)).unionByName(flat)
        out = found if out is None else out.join(found, "key")
    return out


def percentile(samples: DataFrame, q: float) -> DataFrame:
    """The element at int((n - 1) q) of each sorted series."""
    return at_ranks(samples, value=lambda n: F.floor((n - 1) * q))


def median(values: DataFrame, column: str) -> DataFrame:
    """One row with the exact median, as md; NULLs don't count."""
    series = values.where(F.col(column).isNotNull()).select(F.lit(0).alias("key"), F.col(column).alias("value"))
    two = at_ranks(series, low=lambda n: F.floor((n - 1) / 2), high=lambda n: F.ceil((n - 1) / 2))
    return two.agg(F.avg((F.col("low") + F.col("high")) / 2).alias("md"))


def nearest(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """Of each a the nearest b within width; ties take the lower stamp. Different stamps only, in
    one order, so the work does not grow with how many lie within width."""
    left, right = a.select(F.col("stamp").alias("a_stamp")).dropna().distinct(), b.select("stamp").dropna().distinct()
    near = closest(left, "a_stamp", right, "stamp").select("a_stamp", F.col("near.stamp").alias("b_stamp"))
    return near.where(F.abs(F.col("a_stamp") - F.col("b_stamp")) < width)


def greedy(stamp: np.ndarray, side: np.ndarray, low: float, high: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy association by (diff, a, b) of a range of stamps that has others before ``low`` and
    after ``high``: its certain pairs (indices of both), and which rows stay open, as rows outside
    may decide on them. Each left stamp offers its nearest right one that is left; a stamp whose
    offer is taken comes back with the next: one offer a stamp is held. From the difference on at
    which a row outside might be as near, a stamp is open, and so is whatever an open one offers to."""
    l, r = (np.nonzero(side == k)[0][np.argsort(stamp[side == k], kind="stable")] for k in (0, 1))
    left, right = stamp[l].tolist(), stamp[r].tolist()
    edge = [np.minimum(stamp[k] - low, high - stamp[k]).tolist() for k in (l, r)]
    m, heap, pairs = len(right), [], []
    at = np.searchsorted(right, left, "left").tolist()
    below, above = [x - 1 for x in at], at  # the next to offer on either side
    down, up = list(range(m + 1)), list(range(m + 1))  # the next free one; down is moved by one
    open_l, open_r, used, done = [x < width for x in edge[0]], [x < width for x in edge[1]], [False] * m, [False] * len(left)
    sure_l, sure_r = [True] * len(left), [True] * m

    def free(links: list[int], j: int) -> int:
        root = j
        while links[root] != root:
            root = links[root]
        while links[j] != root:
            links[j], j = root, links[j]
        return root

    def offer(i: int) -> None:
        x = left[i]
        a, b = free(down, below[i] + 1) - 1, free(up, above[i])
        below[i], above[i] = a, b
        d, e = x - right[a] if a >= 0 else np.inf, right[b] - x if b < m else np.inf
        if min(d, e) < width:
            j = a if d <= e else b
            if d <= e:
                below[i] = a - 1
            else:
                above[i] = b + 1
            heapq.heappush(heap, (min(d, e), x, right[j], i, j))

    for i in range(len(left)):
        offer(i)
    while heap:
        d, _, _, i, j = heapq.heappop(heap)
        if used[j]:
            offer(i)
        elif sure_l[i] and sure_r[j] and d < edge[0][i] and d < edge[1][j]:
            used[j], done[i] = True, True
            down[j + 1], up[j] = j, j + 1
            pairs.append((l[i], r[j]))
        else:  # either may still get another
            sure_l[i] = sure_r[j] = False
            open_l[i] = open_r[j] = True
            offer(i)
    keep = np.zeros(len(stamp), bool)
    keep[l] = np.array(open_l, bool) & ~np.array(done, bool)
    keep[r] = np.array(open_r, bool) & ~np.array(used, bool)
    found = np.array(pairs, dtype=int).reshape(-1, 2)
    return found, keep


def one_to_one(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """Greedy one-to-one association by (diff, a, b). Tasks resolve ranges of the ordered stamps;
    what they leave open near their ends goes on, in ranges with other ends, until RUN_ROWS at most
    are left for one task."""
    left, taken, share = a.select("stamp", F.lit(0).alias("side")).union(b.select("stamp", F.lit(1).alias("side"))), None, 1.0

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        stamp, side = rows.stamp.to_numpy(), rows.side.to_numpy()
        pairs, keep = greedy(stamp, side, rows.low.iloc[0], rows.high.iloc[0], width)
        x, y = stamp[pairs[:, 0]], stamp[pairs[:, 1]]
        met = pd.DataFrame({"a_stamp": x, "b_stamp": y, "diff": np.abs(x - y), "side": -1})
        rest = pd.DataFrame({"a_stamp": stamp[keep], "b_stamp": np.nan, "diff": np.nan, "side": side[keep]})
        return pd.concat([met, rest])

    while True:
        rows = ranged(left, "stamp", share)
        last = rows.count() <= RUN_ROWS and taken is not None
        if last:
            placed = rows.withColumns({"k": F.lit(0), "low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
        else:
            over = Window.orderBy("k")
            ends = rows.groupBy("k").agg(F.min("stamp").alias("first"), F.max("stamp").alias("last"))
            ends = ends.select("k", F.coalesce(F.lag("last").over(over), F.lit(float("-inf"))).alias("low"), F.coalesce(F.lead("first").over(over), F.lit(float("inf"))).alias("high"))
            placed = rows.join(F.broadcast(ends), "k")
        out = checkpointed(placed.groupBy("k").applyInPandas(resolve, "a_stamp double, b_stamp double, diff double, side int"))
        new = out.where("side = -1").drop("side")
        taken = new if taken is None else taken.unionByName(new)
        left, share = out.where("side >= 0").select(F.col("a_stamp").alias("stamp"), "side"), share * 0.6
        if last or left.isEmpty():
            return taken


#: Buckets of a distribution for each factor e.
FINE = 200


def error_stats(errors: DataFrame, e: str = "e", weight: str | None = None) -> DataFrame:
    """A12, of errors of 0 or more, each as often as ``weight`` says. The errors are made twice and not
    stored: all are counted in buckets of equal ratio, then those of the median's buckets are ordered."""
    at = F.when(F.col(e) > 0, F.least(F.floor(F.least(F.ln(e) * FINE, F.lit(1e9))), F.lit(1_000_000_000))).otherwise(-1_000_000_000)
    rows = errors.where(F.col(e).isNotNull()).select(F.col(e).alias("e"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"), at.alias("bucket"))
    low, above, w = F.exp(F.col("bucket") / FINE), F.col("e") - F.exp(F.col("bucket") / FINE), F.col("w")
    by = rows.groupBy("bucket").agg(F.sum("w").alias("w"), F.sum(w * above).alias("s"), F.sum(w * above * above).alias("q"), F.sum(w * F.col("e") * F.col("e")).alias("ee"), F.min("e").alias("min"), F.max("e").alias("max"))
    by = checkpointed(by.withColumn("mean", low + F.col("s") / w).withColumn("apart", F.col("q") - F.col("s") * F.col("s") / w))
    upto = F.sum("w").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    whole = by.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.sqrt(F.sum("ee") / F.sum("w")).alias("rmse"), (F.sum(w * F.col("mean")) / F.sum("w")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"))
    off = F.col("mean") - F.col("m")
    spread = by.crossJoin(F.broadcast(whole.select(F.col("mean").alias("m")))).agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("apart") + w * off * off) / F.sum("w"))).alias("std"))  # one row
    ranks = whole.select(F.floor((F.col("n") - 1) / 2).alias("first"), F.ceil((F.col("n") - 1) / 2).alias("second"))
    held = by.withColumn("before", upto - w).crossJoin(F.broadcast(ranks)).where((F.col("before") <= F.col("second")) & (F.col("before") + w > F.col("first")))
    held = checkpointed(held.select("bucket", "before", "first", "second"))
    start = held.agg(F.min("before").alias("before"), F.first("first").alias("first"), F.first("second").alias("second"))
    near = checkpointed(rows.join(F.broadcast(held.select("bucket")), "bucket").groupBy("e").agg(F.sum("w").alias("w")))  # two buckets at most
    near = running(near, "e", "w", "upto").crossJoin(F.broadcast(start)).withColumn("from", F.col("before") + F.col("upto") - w)
    holds = lambda rank: F.max(F.when((F.col("from") <= F.col(rank)) & (F.col("from") + w > F.col(rank)), F.col("e")))
    md = near.agg(((holds("first") + holds("second")) / 2).alias("median"))
    out = whole.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(md))
    return out.select("n", "rmse", "mean", "median", "std", "min", "max")  # one row each


def ranged(rows: DataFrame, stamp: str, share: float = 1.0) -> DataFrame:
    """The rows with k, the number of their range of stamps: ranges hold about equal numbers of
    rows and are RANGES at most (``share`` of as many), so one row for each is few. Stored, as
    sampling sets the bounds."""
    parts = max(1, int(min(RANGES, rows.count() // RANGE_ROWS + 1) * share))
    return checkpointed(rows.repartitionByRange(parts, stamp).withColumn("k", F.spark_partition_id()))


def in_order(rows: DataFrame, stamp: str) -> DataFrame:
    """The row before each row in the order of stamps, without one global window: ranges are
    windows of their own, and each range's first row takes the last of the range before
    (``p_*`` columns; NULL for the first of all)."""
    names = rows.columns
    bucket = ranged(rows, stamp)
    row = F.struct(*names)
    w = Window.partitionBy("k").orderBy(stamp)
    ends = bucket.groupBy("k").agg(F.max_by(row, stamp).alias("end"))
    ends = ends.withColumn("before", F.lag("end").over(Window.orderBy("k")))
    inner = bucket.withColumn("_prev", F.lag(row).over(w))
    return inner.join(F.broadcast(ends.select("k", "before")), "k").withColumn("_prev", F.coalesce("_prev", "before")).select(*names, *[F.col(f"_prev.{c}").alias(f"p_{c}") for c in names])


def running(rows: DataFrame, stamp: str, value: str, out: str) -> DataFrame:
    """The running sum in the order of stamps, by range sums and a window in each range."""
    bucket = ranged(rows, stamp)
    sums = bucket.groupBy("k").agg(F.sum(value).alias("s"))
    before = sums.select("k", F.coalesce(F.sum("s").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    own = F.sum(value).over(Window.partitionBy("k").orderBy(stamp).rowsBetween(Window.unboundedPreceding, 0))
    return bucket.withColumn("own", own).join(F.broadcast(before), "k").withColumn(out, F.col("own") + F.col("b")).drop("k", "own", "b")


def closest(targets: DataFrame, at: str, points: DataFrame, pos: str) -> DataFrame:
    """J2 without a limit: targets with the nearest point in a struct ``near`` (ties: the lower).
    Both are ordered together in ranges; the points before and after a range come from its
    neighbours that have any."""
    t = targets.select(F.col(at).cast("double").alias("_pos"), F.lit(1).alias("_kind"), F.struct(*targets.columns).alias("_q"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_p"))
    p = points.select(F.col(pos).cast("double").alias("_pos"), F.lit(0).alias("_kind"), F.lit(None).cast(targets.select(F.struct(*targets.columns)).schema[0].dataType).alias("_q"), F.struct(*points.columns).alias("_p"))
    rows = ranged(t.unionByName(p), "_pos")
    ends = rows.groupBy("k").agg(F.min_by("_p", F.when(F.col("_kind") == 0, F.col("_pos"))).alias("first"), F.max_by("_p", F.when(F.col("_kind") == 0, F.col("_pos"))).alias("last"))
    over = Window.orderBy("k")
    ends = ends.select("k", F.last("last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("lower"), F.first("first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("upper"))
    # both frames begin at the first row: one that ends at the last is read anew for every row
    so_far = lambda *order: F.last("_p", True).over(Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    near = rows.withColumn("_a", so_far("_pos", "_kind")).withColumn("_b", so_far(F.desc("_pos"), "_kind"))
    near = near.where("_kind = 1").join(F.broadcast(ends), "k").withColumns({"_a": F.coalesce("_a", "lower"), "_b": F.coalesce("_b", "upper")})
    lower = F.col("_b").isNull() | (F.abs(F.col("_pos") - F.col("_a")[pos]) <= F.abs(F.col("_pos") - F.col("_b")[pos]))
    return near.select("_q.*", F.when(F.col("_a").isNotNull() & lower, F.col("_a")).otherwise(F.coalesce("_b", "_a")).alias("near"))


def moments(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A10: centroids and the 3 x 3 cross-covariance sums of matched positions."""
    means = {f"{s}{n}": F.avg(f"{s}_{n}") for s in (a, b) for n in ("tx", "ty", "tz")}
    both = {f"w_{m}_{n}": F.covar_pop(f"{a}_{m}", f"{b}_{n}") * F.count("*") for m in ("tx", "ty", "tz") for n in ("tx", "ty", "tz")}
    return pairs.agg(F.count("*").alias("n"), *[c.alias(k) for k, c in {**means, **both}.items()])


AXES = ("tx", "ty", "tz")


def pair_moments(near: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """As ``moments``, of all poses of a with all poses of b whose stamps ``near`` (a_stamp, b_stamp)
    matches, and v_a_*, v_b_*, their variances. One row a stamp: the means and spreads of its poses
    tell what their pairs add up to, so pairs are not made."""

    def by_stamp(rows: DataFrame, s: str) -> DataFrame:
        per = [c for n in AXES for c in (F.count(n).alias(f"c_{s}_{n}"), F.avg(n).alias(f"{s}_{n}"), (F.var_pop(n) * F.count(n)).alias(f"q_{s}_{n}"))]
        return rows.groupBy(F.col("stamp").alias(f"{s}_stamp")).agg(F.count("*").alias(f"c_{s}"), *per)

    met = near.join(by_stamp(a, "a"), "a_stamp").join(by_stamp(b, "b"), "b_stamp")
    col, mean = F.col, lambda w, x: F.try_divide(F.sum(w * x), F.sum(w))
    other = {"a": "b", "b": "a"}
    sides = [(s, n) for s in "ab" for n in AXES]
    weight = {(s, n): col(f"c_{s}_{n}") * col(f"c_{other[s]}") for s, n in sides}
    means = met.agg(F.coalesce(F.sum(col("c_a") * col("c_b")), F.lit(0)).alias("n"), *[mean(weight[k], col("_".join(k))).alias("".join(k)) for k in sides])
    # differences from the means of all: what cancels out is small
    far = met.crossJoin(F.broadcast(means)).withColumns({f"{s}_{n}": col(f"{s}_{n}") - col(f"{s}{n}") for s, n in sides})  # one row
    out = {}
    for m in AXES:
        for n in AXES:
            w, x, y = col(f"c_a_{m}") * col(f"c_b_{n}"), col(f"a_{m}"), col(f"b_{n}")
            out[f"w_{m}_{n}"] = mean(w, x * y) - mean(w, x) * mean(w, y)
    for s, n in sides:
        w, x = weight[s, n], col(f"{s}_{n}")
        out[f"v_{s}_{n}"] = F.try_divide(F.sum(w * x * x + col(f"q_{s}_{n}") * col(f"c_{other[s]}")), F.sum(w)) - mean(w, x) * mean(w, x)
    found = means.crossJoin(F.broadcast(far.agg(*[c.alias(k) for k, c in out.items()])))  # one row each
    return found.withColumns({k: col(k) * col("n") for k in out if k[0] == "w"})
