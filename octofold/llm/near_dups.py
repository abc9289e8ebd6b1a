"""Near duplicates by MinHash, banding, verification and connected components (operator 4).

1. Each text becomes its set of 5-word shingles, ``HASHES`` minima under universal hash
   functions (multiply-add modulo 2 ** 64), ``BANDS`` band keys of ``ROWS`` minima each, and a
   digest of the set. Texts are not moved.
2. Texts with equal sets form a class; its smallest doc_id represents it, so copies, however
   many, cost one aggregate and are never expanded into pairs.
3. Representatives that share a band key form a bucket. Each is compared with the bucket's
   pivot (the class with most copies): first by signature, where only a similarity far below
   the threshold (``SIGMAS`` standard errors) ends the matter, then on the full sets.
4. Links so far give components (large-star, small-star). A bucket whose other members are still
   in different components is searched fully: its members get a sketch of ``LONG`` more minima
   and are dealt into blocks of about ``BLOCK``, up to eight times as many in large buckets (ids, keys and
   sketches, under 2 KB each), and pairs of blocks compare signatures as
   matrices, then the sketches of what is left. Only pairs of different components that neither
   rules out are emitted, by the first bucket that they share, and verified on full sets.
5. Components over all links; each document gets its component's smallest doc_id.

A pair at the threshold is missed only if no band agrees: (1 - 0.85 ** 5) ** 28 < 1e-7, and
(1 - 0.8 ** 5) ** 28 < 2e-5 at 0.8.

Defined cases: null, empty or white-space texts have an empty set, link with nothing and stay;
fewer than five words form one shingle; rows with a null doc_id link with nothing, stay and have
a null component; doc_ids should be unique (rows repeated whole get the same result each); texts of
any length count whole; an empty table gives none; other columns are ignored, whatever their names. Of
buckets' members with equally many copies the smallest doc_id is the pivot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octofold.llm.common import BITMAP_BITS, bitmap, discard, forget, hot_keys, marked, spread_join, stored, table
from octofold.llm.components import components
from octofold.llm.shingles import mix, random_longs, shingle_set

SHINGLE, ROWS, BANDS = 5, 5, 28
HASHES = ROWS * BANDS
FACTOR, OFFSET = random_longs(HASHES) | np.uint64(1), random_longs(HASHES)
SIGMAS, BLOCK = 5, 256
#: Members of a block that are compared with another block at once.
TILE = 128
#: Minima of the long sketch, of which one byte each is kept.
LONG = 1024
LONG_FACTOR, LONG_OFFSET = random_longs(LONG) | np.uint64(1), random_longs(LONG)
#: Shingles whose hashes are computed at once.
PART = 1024


def minima(shingles: np.ndarray, factor: np.ndarray = FACTOR, offset: np.ndarray = OFFSET) -> np.ndarray:
    """The least value of each hash function over the set (upper 32 bits)."""
    low = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), PART):
        x = shingles[at : at + PART] >> np.uint64(32)
        values = factor[:, None] * x[None, :]
        values += offset[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return low >> np.uint64(32)


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in low.reshape(BANDS, ROWS).T:
        keys = mix(keys ^ column) * np.uint64(0xBF58476D1CE4E5B9)
    return keys.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a digest of the set, the signature (16 bits a minimum), band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            count, digest, sign, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, SHINGLE)
                count.append(len(found))
                if len(found):
                    low = minima(found)
                    digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sign.append(low.astype(np.uint16).tobytes())
                    keys.append(band_keys(low))
                else:
                    digest.append(None)
                    sign.append(None)
                    keys.append(np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(sign, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n_shingles", "digest", "sign", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sign binary, keys array<long>")


def least_agreement(percent: int, n: int = HASHES) -> int:
    """Minima of n that agree at least, unless the similarity is below the threshold for sure."""
    p = percent / 100
    return max(1, int(n * p - SIGMAS * (n * p * (1 - p)) ** 0.5))


def likely(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their signatures don't rule out."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    a, b = (signs.select(F.col("doc_id").alias(x), F.col("sign").alias(f"sign_{x}")) for x in "ab")
    both = spread_join(pairs, a, "a", ["b"], hot_keys(pairs, "a")).join(b, "b")
    return both.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ids (stored): a bitmap of fixed size, then an exact
    join, so that only these texts are moved."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("doc_id").alias("h")), "h"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            yield batch.select([0, 1]).filter(pa.array(marked(bits.value, at)))

    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)).alias("at")
    few = docs.where("doc_id is not null").select("doc_id", "text", place).mapInArrow(wanted, "doc_id long, text string")
    return few.join(ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * shared >= percent * all shingles of their full sets."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = stored(texts_of(ids, docs), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if x != last:
                    last, last_set = x, shingle_set(x, SHINGLE)
                other = shingle_set(y, SHINGLE)
                shared = len(np.intersect1d(last_set, other, assume_unique=True))
                good.append(100 * shared >= percent * (len(last_set) + len(other) - shared) and shared > 0)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    a, b = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = spread_join(spread_join(pairs, b, "b", ["a"], hot_keys(pairs, "b")), a, "a", ["b"], hot_keys(pairs, "a"))
    good = stored(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long").distinct(), "links")
    for used in (texts, ids):
        discard(used)
    return good


def sketches(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and the long sketch of the documents in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            long = [minima(shingle_set(t, SHINGLE), LONG_FACTOR, LONG_OFFSET).astype(np.uint8).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(long, pa.binary())], names=["doc_id", "long"])

    return texts_of(ids, docs).mapInArrow(run, "doc_id long, long binary").dropDuplicates(["doc_id"])


def block_pairs(members: DataFrame, sizes: DataFrame, signs: DataFrame, percent: int, hot: list[tuple]) -> DataFrame:
    """Pairs (a, b) of a bucket's members (key, doc_id, component) in different components that
    neither signatures nor sketches rule out. A bucket of n members is n / BLOCK blocks or fewer, and each pair of
    blocks is a group of its own: no task holds more than two blocks at once."""
    least, least_long = least_agreement(percent), least_agreement(percent, LONG)
    size = F.least(F.lit(8.0 * BLOCK), F.greatest(F.lit(float(BLOCK)), F.col("n") / 64))  # larger blocks are shipped less often
    blocks = F.ceil(F.col("n") / size).cast("int")
    dealt = spread_join(members, sizes.select("key", blocks.alias("k")), "key", ["doc_id"], hot).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
    spread = dealt.select("key", "doc_id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("grp")
    rows = spread.select(group, "doc_id", "component", "own", "key").join(signs, "doc_id").repartition("grp").sortWithinPartitions("grp", "own", "doc_id")

    def compare(ids: np.ndarray, comp: np.ndarray, own: np.ndarray, sign: np.ndarray, long: np.ndarray, key: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = own == own[0]
        cut = int(first.sum())
        x, y = (slice(0, cut), slice(0, cut)) if cut == len(ids) else (slice(0, cut), slice(cut, len(ids)))
        found = []
        for at in range(0, len(ids[x]), TILE):
            rows = slice(at, min(at + TILE, cut))
            same = np.zeros((len(ids[rows]), len(ids[y])), np.int16)
            for k in range(HASHES):
                same += sign[rows, k][:, None] == sign[y, k][None, :]
            i, j = np.nonzero((same >= least) & (comp[rows][:, None] != comp[y][None, :]))
            found.append((i + at, j))
        i, j = (np.concatenate(z) for z in zip(*found))
        agree = [(long[x][i[at : at + 4096]] == long[y][j[at : at + 4096]]).sum(axis=1) for at in range(0, len(i), 4096)]
        if agree:
            good = np.concatenate(agree) >= least_long
            i, j = i[good], j[good]
            shared = keys[x][i] == keys[y][j]  # a pair is left to the first bucket that it shares
            good = keys[x][i][np.arange(len(i)), shared.argmax(axis=1)] == key
            i, j = i[good], j[good]
        a, b = ids[x][i], ids[y][j]
        low = np.minimum(a, b)
        pairs = np.unique(np.stack([low, a + b - low], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and any(r[2] != held[0][2] for r in held):
                cols = list(zip(*held))
                a, b = compare(np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.frombuffer(b"".join(cols[4]), np.uint16).reshape(-1, HASHES), np.frombuffer(b"".join(cols[5]), np.uint8).reshape(-1, LONG), cols[6][0], np.array(cols[7], np.int64))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if held and row[0] != held[0][0]:
                    yield from done()
                    held = []
                held.append(row)
        yield from done()

    return rows.select("grp", "doc_id", "component", "own", "sign", "long", "key", "keys").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs), "signed")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = signed.select("doc_id", "digest", "sign", "keys").join(classes, [signed.doc_id == classes.rep, signed.digest == classes.digest]).select("doc_id", "copies", "sign", "keys").dropDuplicates(["doc_id"])
    reps = stored(reps, "reps")
    signs = reps.select("doc_id", "sign")
    member = reps.select("doc_id", "copies", F.explode("keys").alias("key"))
    pivot = F.max(F.struct("copies", (-F.col("doc_id")).alias("id"))).alias("p")
    buckets = stored(member.groupBy("key").agg(pivot, F.count("*").alias("n")).where("n > 1").select("key", (-F.col("p.id")).alias("pivot"), "n"), "buckets")
    hot = hot_keys(buckets, "key", "n")
    members = stored(spread_join(member.select("key", "doc_id"), buckets, "key", ["doc_id"], hot).where("doc_id <> pivot"), "members")
    stars = stored(members.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    near = stored(likely(stars, signs, percent), "likely")
    links = confirmed(near, docs, percent)
    discard(near)
    discard(stars)

    roots = components(links)
    here = members.where("n > 2").join(roots.select(F.col("a").alias("doc_id"), F.col("b").alias("root")), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("component"))
    mixed = here.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = stored(mixed, "mixed")
    open_ids = stored(here.join(mixed.select("key"), "key", "left_semi").select("doc_id").distinct(), "ids")
    both = stored(reps.select("doc_id", "sign", "keys").join(sketches(open_ids, docs), "doc_id"), "sketches")
    others = stored(block_pairs(here, mixed, both, percent, hot), "others")
    more = confirmed(others, docs, percent)
    stars = components(links.union(more))
    for used in (buckets, members, roots, mixed, open_ids, both, others, reps, links, more):
        discard(used)

    root = classes.join(stars.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    out = spread_join(signed.select("doc_id", "n_shingles", "digest"), root, "digest", ["doc_id"], hot_keys(classes, "digest", "copies"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_dups": op4_near_dups}
#: All pairs that share a shingle, so for small tables only; doc_ids are unique there.
ORACLE = {
    "op4_near_dups": r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS top FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.top = l.a),
roots AS (SELECT doc_id, min(top) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept FROM sets s JOIN roots r USING (doc_id)"""
}
