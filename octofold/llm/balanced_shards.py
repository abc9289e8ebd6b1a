"""Sharding by balanced label propagation (operator 9).

Documents with equal texts are linked: the edges of a group are those of a star around its
text. Every document starts in a shard given by a hash. In each round a group looks at how its
documents are spread over shards (a join-free aggregate on group and shard), names the shard
where most of its weight lies (every other round: among shards with room), and documents elsewhere ask to move there. Requests from shard s
to shard t are granted only within the quota of (s, t): what t can give back to other shards at
once plus its room under the law, so no shard outgrows its capacity. Which requests are granted
follows the group's hash, so whole groups move together. A group larger than a shard stays
spread: it could not be gathered and would take the room of all others.

The law is ``rows``: shard sizes (counts of documents) differ by at most one. After the rounds
an exact settlement moves the surplus rows of each shard to the shards that lack rows.

Scale: one pass over the texts makes narrow rows (a few dozen bytes), stored in the shared
folder; rounds read those. Only counts by shard pair and hash bin reach the driver
(``SHARDS ** 2 * BINS`` numbers at most; those granted are broadcast), and counts by cell (``2 * SHARDS * CHUNKS * BINS /
JOINED``), whose running sums are broadcast: both are constants, 65536 and 16384. Groups of over
1 / HOT of all rows are at most HOT, so their moves are broadcast and no task gathers them; counts
are partial sums, and ranks are taken inside (shard, bin, chunk) cells.

A row's first shard, moves and slot follow from doc_id and text alone, so the result does not
depend on how the table is split into files or partitions.

Defined cases: a null text counts as empty (size 1, crc32 0) and all such texts are one group;
repeated rows are separate rows of one group with slots of their own; rows with a null doc_id are
kept, and start in a shard by their place in the table; very long texts are only hashed; an empty
table gives none; other columns are ignored, whatever their names. Ties between shards are broken
by a hash of group and shard.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octofold.llm.common import discard, hot_keys, stored, table

#: Percent, and at least rows, that a shard may exceed the even size during the rounds; settling
#: ends that.
SLACK, SLACK_ROWS = 10, 16
SHARDS, ROUNDS = 16, 8
#: Bins of the group hash within which requests are granted or refused together, and how many of
#: them, and chunks of rows, share a cell within which slots are ranked.
BINS, JOINED, CHUNKS = 256, 8, 16


def narrow(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, grp (hash of the text), spot (a hash of the row), bin of the
    group, and a first shard."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    grp = F.xxhash64(raw, F.octet_length(raw))
    spot = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), grp)
    return docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), grp.alias("grp"), spot.alias("spot")).select(
        "*", F.pmod(F.xxhash64("grp"), F.lit(BINS)).cast("int").alias("bin"), F.pmod(F.xxhash64("spot"), F.lit(shards)).cast("int").alias("shard")
    )


def large_groups(rows: DataFrame) -> Column:
    """Whether a row's group is one of the few that hold a noticeable share of all rows."""
    found = [k for k, _ in hot_keys(rows, "grp")]
    return F.col("grp").isin(found) if found else F.lit(False)


def quotas(asked: dict[tuple[int, int], int], counts: list[int], capacity: int) -> dict[tuple[int, int], int]:
    """Rows that may move from s to t: each shard takes in at most its room plus what it is
    sure to give away, where gifts are counted only as far as they are taken elsewhere."""
    n = len(counts)
    granted = {k: 0 for k in asked}
    left = dict(asked)
    for s in range(n):  # exchanges: equal numbers both ways change no size
        for t in range(s + 1, n):
            both = min(left.get((s, t), 0), left.get((t, s), 0))
            for k in ((s, t), (t, s)):
                if both:
                    granted[k] += both
                    left[k] -= both
    room = [capacity - c for c in counts]
    for (s, t), want in sorted(left.items(), key=lambda x: (-x[1], x[0])):  # then the free room
        give = max(0, min(want, room[t]))
        granted[s, t] += give
        room[t] -= give
        room[s] += give
    return granted


def propagate(rows: DataFrame, shards: int, rounds: int, large: Column) -> DataFrame:
    """Label propagation under quotas; returns the rows with their shard, stored."""
    total = rows.count()
    even = -(-total // shards)
    capacity = even + max(SLACK_ROWS, even * SLACK // 100)
    for turn in range(rounds):
        spread = rows.groupBy("grp", "shard").agg(F.count("*").alias("n"))
        counts = [0] * shards
        for r in rows.groupBy("shard").count().collect():
            counts[r["shard"]] = r["count"]
        # in every other round, groups whose shard is full gather where there is room
        roomy = [s for s in range(shards) if counts[s] < capacity - SLACK_ROWS // 2] if turn % 2 else []
        first = F.col("shard").isin(roomy) if roomy else F.lit(True)
        best = spread.groupBy("grp").agg(F.max(F.struct(first.alias("first"), "n", F.pmod(F.xxhash64("grp", "shard"), F.lit(1 << 20)).alias("tie"), "shard")).alias("b"), F.count("*").alias("k"), F.sum("n").alias("total"))
        goal = best.where((F.col("k") > 1) & (F.col("total") <= capacity)).select("grp", F.col("b.shard").alias("goal"))
        # other bins in each round: a small group does not meet the same large ones again
        cells = spread.join(goal, "grp").where("shard <> goal").select("grp", "shard", "goal", "n", F.pmod(F.xxhash64("grp", F.lit(turn)), F.lit(BINS)).cast("int").alias("bin"))
        wish: dict[tuple[int, int], dict[int, int]] = {}
        for r in cells.groupBy("shard", "goal", "bin").agg(F.sum("n").alias("n")).collect():
            wish.setdefault((r["shard"], r["goal"]), {})[r["bin"]] = r["n"]
        if not wish:
            break
        allowed = quotas({k: sum(v.values()) for k, v in wish.items()}, counts, capacity)
        granted = []  # (shard, goal, bin) that move; a bin beyond what is left of the quota waits
        for k, bins in sorted(wish.items()):
            left = allowed[k]
            for b, n in sorted(bins.items()):
                if n <= left:
                    left -= n
                    granted.append((*k, b))
        if not granted:
            continue
        chosen = rows.sparkSession.createDataFrame(granted, "shard int, goal int, bin int")
        moves = cells.join(F.broadcast(chosen), ["shard", "goal", "bin"], "left_semi").select("grp", "shard", "goal")
        big = rows.where(large).join(F.broadcast(moves.where(large)), ["grp", "shard"], "left")  # at most HOT * shards moves
        joined = rows.where(~large).join(moves.where(~large), ["grp", "shard"], "left").unionByName(big)
        before, rows = rows, stored(joined.select("doc_id", "size", "text_crc32", "grp", "spot", "bin", F.coalesce("goal", "shard").alias("shard")), "shards")
        discard(before)
    return rows


def ranked(rows: DataFrame, shards: int, large: Column) -> tuple[DataFrame, list[int]]:
    """Adds slot, the row's place in its shard, and the counts by shard. Rows without links
    come last, so that they are the surplus as far as possible; chunks keep cells of a hot
    group small."""
    small = rows.where(~large)
    linked = small.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp", F.lit(0).alias("linked"))
    chunk = F.coalesce("linked", F.lit(1)) * CHUNKS + F.pmod(F.xxhash64("spot", F.lit(1)), F.lit(CHUNKS))
    rows = small.join(linked, "grp", "left").unionByName(rows.where(large).withColumn("linked", F.lit(0)))
    rows = rows.withColumn("chunk", chunk.cast("int")).drop("linked")
    rows = stored(rows.withColumn("bin", F.floor(F.col("bin") / JOINED).cast("int")), "cells")
    sizes = {(r["shard"], r["chunk"], r["bin"]): r["count"] for r in rows.groupBy("shard", "chunk", "bin").count().collect()}
    counts, first = [0] * shards, []
    for key in sorted(sizes):
        first.append((*key, counts[key[0]]))
        counts[key[0]] += sizes[key]
    before = rows.sparkSession.createDataFrame(first, "shard int, chunk int, bin int, first long")
    cell = Window.partitionBy("shard", "bin", "chunk").orderBy("grp", "doc_id", "spot")
    return rows.join(F.broadcast(before), ["shard", "bin", "chunk"]).withColumn("slot", F.col("first") + F.row_number().over(cell) - 1), counts


def piecewise(value: Column, starts: list[int], outputs: list[int]) -> Column:
    """outputs[i] for starts[i] <= value < starts[i + 1]."""
    out = F.lit(outputs[-1])
    for i in reversed(range(len(starts) - 1)):
        out = F.when(value < starts[i + 1], outputs[i]).otherwise(out)
    return out


def settle(rows: DataFrame, shards: int, large: Column) -> DataFrame:
    """Exact sizes: rows at or past their shard's size fill the gaps of the shards that lack
    rows. Surplus rows have places 0, 1, ... over all shards, and so have the gaps."""
    placed, counts = ranked(rows, shards, large)
    total = sum(counts)
    size = [total // shards] * shards  # the larger sizes go where most rows are
    for s in sorted(range(shards), key=lambda s: (-counts[s], s))[: total % shards]:
        size[s] += 1
    over = [max(0, c - n) for c, n in zip(counts, size)]
    gaps = [max(0, n - c) for c, n in zip(counts, size)]
    over_first = [0, *accumulate(over)][:shards]
    takers = [s for s in range(shards) if gaps[s]]
    if not takers:
        return placed
    gap_first = [0, *accumulate(gaps[s] for s in takers)][: len(takers)]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("shard") + 1)
    extra = F.col("slot") - pick(size) + pick(over_first)
    surplus = F.col("slot") >= pick(size)
    to = piecewise(extra, gap_first, takers)
    to_slot = extra + piecewise(extra, gap_first, [counts[s] - g for s, g in zip(takers, gap_first)])
    return placed.withColumns({"shard": F.when(surplus, to).otherwise(F.col("shard")).cast("int"), "slot": F.when(surplus, to_slot).otherwise(F.col("slot")).cast("long")})


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    rows = stored(narrow(docs, shards), "rows")
    large = large_groups(rows)
    return settle(propagate(rows, shards, rounds, large), shards, large).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


QUERIES = {"op9_balanced_shards": op9_balanced_shards}
