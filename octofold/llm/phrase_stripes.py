"""Phrases that occur more often than chance, by stripes (operator 11).

A stripe belongs to a prefix (of a language) and counts each word that follows it. Level m holds
the stripes of prefixes of m - 1 words. Tasks build partial stripes and write them by bucket of
prefixes, as plain arrays of keys and counts; the stripes of a bucket are merged element by element. A
merged stripe gives

* its extensions: the phrases of m words with their frequencies, which are the totals of the next level's
  prefixes; the sum of the stripe without prefix is the number of all words,
* the largest extension, which tells whether a phrase is subsumed to its right.

1. Texts are read once a level. A window of m words counts where its first and its last m - 1 words are
   frequent phrases; tasks know these from a bitmap of fixed size. The bitmap lets some others
   through: the merged counts are exact and decide.
2. Words have keys of 64 bits, by language, and a phrase the key of its prefix and its last word. An entry
   of a stripe is told by both (128 bits); two prefixes of one key, which would be merged, are to
   be expected once in 100,000 corpora with ten million frequent phrases.
3. Extensions are joined with the phrases that they extend and with those that they end in: each gets the
   frequencies of all its beginnings and endings, hence of all its cuts.
4. A phrase inside a longer one with as many occurrences is inside one with one more word: the largest
   extension on the right, or the largest phrase that ends in it.
5. Words are looked up by key for the phrases that are kept.

Stripes are cut into slices by the next word's key (the one without prefix into as many as there are
buckets), so many that a slice of one prefix holds about ``SLICE`` words; there are as many buckets
as shuffle partitions. Numbers are exact: scores are quotients of 38-digit decimals.

Defined cases: null and empty texts have no words; a null lang is ``und``; rows repeated whole count
as often as they occur; texts of any length count whole; an empty table gives none; other columns are
ignored, whatever their names; phrases with equal scores and frequencies are in byte order. A
language without frequent phrases has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octofold.llm.common import discard, hot_keys, spread_join, stored, table

#: Words of a phrase at most; occurrences at least; rows of a language; percent of a phrase's occurrences
#: inside a longer one from which it is dropped.
WORDS, LEAST, TOP, INSIDE = 5, 100, 2_000, 100
#: Entries of partial stripes that a task merges at once; words of a slice; buckets at least.
HELD, SLICE, BUCKETS = 2_000_000, 65_536, 64
#: Bytes of text that are looked at together, and that are hashed at once.
GROUP, PART = 4 << 20, 1 << 19
#: Bits of the bitmap of frequent phrases: 16 MB whatever the input's size.
BITS = 1 << 27
UND = "und"
#: What a byte becomes: A-Z in lower case, what ends a piece a line feed, a tab a blank.
CLEAN = np.arange(256, dtype=np.uint8)
CLEAN[65:91] += 32
CLEAN[list(b".,;:!?\x0b\x0c\r")] = 10
CLEAN[9] = 32
#: Powers of an odd number modulo 2 ** 64, and of its inverse.
ODD = 0x9E3779B97F4A7C15
POWERS = np.cumprod(np.append(np.uint64(1), np.full(PART - 1, ODD, np.uint64)))
INVERSE = np.cumprod(np.append(np.uint64(1), np.full(PART - 1, pow(ODD, -1, 1 << 64), np.uint64)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def long_hash(data: np.ndarray) -> int:
    """The hash of a word that is longer than PART."""
    h, scale = 0, 1
    for at in range(0, len(data), PART):
        part = data[at : at + PART].astype(np.uint64) + np.uint64(1)
        h += int((part * POWERS[: len(part)]).sum()) * scale
        scale = scale * pow(ODD, PART, 1 << 64) % (1 << 64)
    return h % (1 << 64)


class Words:
    """The words of some texts, one after the other: where they begin and end, the key of each (by
    word and language), and whether a piece begins with it."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.data = CLEAN[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        blank = (self.data == 32) | (self.data == 10)
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        self.start, self.end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        breaks = np.cumsum(self.data == 10)
        piece = breaks[self.start] if len(self.start) else breaks[:0]
        self.first = np.append(True, piece[1:] != piece[:-1])[: len(piece)]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.names = sorted(set(langs))
        number = {g: k for k, g in enumerate(self.names)}
        self.lang = np.array([number[g] for g in langs], np.int32)[np.searchsorted(begins, self.start, "right") - 1]
        self.salt = salt = np.array([xxhash.xxh3_64_intdigest(g) | 1 for g in self.names], np.uint64)
        size = (self.end - self.start).astype(np.uint64)
        self.key = mixed(self.hashes() ^ salt[self.lang] ^ size * np.uint64(ODD)) | np.uint64(1)

    def hashes(self) -> np.ndarray:
        """A polynomial of each word's bytes, from running sums over stretches of whole words."""
        out, k, n = np.zeros(len(self.start), np.uint64), 0, len(self.start)
        while k < n:
            low = self.start[k]
            last = int(np.searchsorted(self.end, low + PART, "right"))
            if last <= k:
                out[k] = long_hash(self.data[low : self.end[k]])
                k += 1
                continue
            part = self.data[low : self.end[last - 1]].astype(np.uint64) + np.uint64(1)
            part *= POWERS[: len(part)]
            sums = np.append(np.uint64(0), np.cumsum(part))
            a, b = self.start[k:last] - low, self.end[k:last] - low
            out[k:last] = (sums[b] - sums[a]) * INVERSE[a]
            k = last
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def windows(self, most: int) -> list[np.ndarray]:
        """Of 1, 2, ... ``most`` words the key of the window at each word, 0 where a piece ends
        before."""
        out, n = [self.key], len(self.key)
        joined = np.append(~self.first[1:], False) if n else self.first
        for m in range(2, most + 1):
            before, key = out[-1], np.zeros(n, np.uint64)
            ok = np.nonzero(joined[: n - m + 1] & (before[1 : n - m + 2] != 0) if n >= m else np.zeros(0, bool))[0]
            ok = ok[before[ok] != 0]
            key[ok] = extended(before[ok], self.key[ok + m - 1])
            out.append(key)
        return out


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of lang and text, GROUP bytes or one text at a time."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            texts.append(text)
            langs.append(lang)
            size += len(text)
            if size >= GROUP:
                yield Words(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys are in the bitmap; key 0 is not."""
    at = keys & np.uint64(BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (keys != 0)


def bitmap(keys: DataFrame) -> np.ndarray:
    """Eight places to a byte; at most BITS / 64 rows reach the driver."""
    at = keys.select(F.col("key").bitwiseAND(F.lit(BITS - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def extended(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a phrase with one more word."""
    return mixed(before * np.uint64(0xD6E8FEB86659FD93) + word) | np.uint64(1)


def added(prefix: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stripes merged element by element: entries in order of prefix and word, each once."""
    order = np.lexsort((word, prefix))
    prefix, word, n = prefix[order], word[order], n[order]
    new = np.nonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1]))[: len(prefix)])[0]
    return prefix[new], word[new], np.add.reduceat(n, new) if len(new) else n


def partial_stripes(docs: DataFrame, m: int, known: np.ndarray, slices: int, buckets: int) -> DataFrame:
    """The stripes of level m by bucket: prefixes, how many words each has, words, counts (arrays as
    bytes); one row a bucket, or some where a task has very many entries."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(prefix: np.ndarray, word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = (mixed(prefix ^ mixed(word % np.uint64(slices))) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            prefix, word, n, bucket = prefix[order], word[order], n[order], bucket[order]
            cuts = np.nonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])[0]
            rows = []
            for low, high in zip(cuts, np.append(cuts[1:], len(bucket))):
                own = prefix[low:high]
                begins = np.nonzero(np.append(True, own[1:] != own[:-1]))[0]
                sizes = np.diff(np.append(begins, len(own))).astype(np.int32)
                rows.append((int(bucket[low]), own[begins].tobytes(), sizes.tobytes(), word[low:high].tobytes(), n[low:high].tobytes()))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "prefixes", "sizes", "words", "counts"])

        for words in groups(batches):
            keys = words.windows(m)
            if m == 1:
                prefix, word = words.salt[words.lang], keys[0]
            else:
                good = marked(sent.value, keys[-2])
                at = np.nonzero((keys[-1][:-1] != 0) & good[:-1] & good[1:])[0]
                prefix, word = keys[-2][at], words.key[at + m - 1]
            held.append(added(prefix, word, np.ones(len(prefix), np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                held = [added(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from out(*held[0])
                    held, size = [], 0
        if held:
            yield from out(*added(*map(np.concatenate, zip(*held))))

    return docs.mapInArrow(run, "bucket long, prefixes binary, sizes binary, words binary, counts binary")


def merged(partial: DataFrame, m: int, least: int) -> DataFrame:
    """The stripes of each bucket merged: prefix, word, key and n of the frequent extensions, and as
    word 0 the total of a prefix (of its part in the bucket). A bucket's stripes come in order and
    are merged as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size, most = None, [], 0, HELD

        def out() -> Iterator[pa.RecordBatch]:
            prefix, word, n = added(*map(np.concatenate, zip(*held)))
            begins = np.nonzero(np.append(True, prefix[1:] != prefix[:-1])[: len(prefix)])[0]
            total = np.add.reduceat(n, begins) if len(begins) else n
            good = n >= least
            zero = np.zeros(len(begins), np.uint64)
            key = word if m == 1 else extended(prefix, word)
            cols = [np.concatenate(c) for c in ((prefix[good], prefix[begins]), (word[good], zero), (key[good], zero), (n[good], total))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in cols)], names=["prefix", "word", "key", "n"])

        for batch in batches:
            for b, *arrays in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if b != bucket:
                    if held:
                        yield from out()
                    bucket, held, size, most = b, [], 0, HELD
                sizes = np.frombuffer(arrays[1], np.int32)
                held.append((np.repeat(np.frombuffer(arrays[0], np.uint64), sizes), np.frombuffer(arrays[2], np.uint64), np.frombuffer(arrays[3], np.int64)))
                size += len(held[-1][1])
                if size > most:
                    held = [added(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    most = max(HELD, 2 * size)
        if held:
            yield from out()

    return partial.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "prefix long, word long, key long, n long")


def names(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """key, lang and word of the words in the bitmap (and of some others)."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for words in groups(batches):
            key, at = np.unique(words.key, return_index=True)
            good = marked(sent.value, key)
            new = [(k, i) for k, i in zip(key[good].view(np.int64).tolist(), at[good].tolist()) if k not in done]
            done.update(k for k, _ in new[: max(0, HELD - len(done))])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in new], pa.int64()), pa.array([words.names[words.lang[i]] for _, i in new], pa.string()), pa.array([words.word(i) for _, i in new], pa.binary()).cast(pa.string())], names=["key", "lang", "word"])

    return docs.mapInArrow(run, "key long, lang string, word string").distinct()


def with_ending(rows: DataFrame) -> DataFrame:
    """Adds the key of the phrase without its first word, from its words' keys (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index("path")
                path = batch.column(at).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
                ending = reduce(extended, path.T[1:])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ending.view(np.int64))], names=[*batch.schema.names, "ending"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("ending", T.LongType())]))


def levels(docs: DataFrame, least: int, longest: int) -> list[DataFrame]:
    """Of 1, 2, ... words the phrases: root (the language's key), prefix, key, ending, path (keys of the
    words), a, n, firsts and rests (frequencies of the beginnings of 1, 2, ... words, and of the
    endings that they leave)."""
    spark = docs.sparkSession
    buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known, slices, out = np.zeros(BITS // 8, np.uint8), buckets, []
    for m in range(1, longest + 1):
        stripes = stored(merged(partial_stripes(docs, m, known, slices, buckets), m, least), "stripes")
        ext = stripes.where("word <> 0").select("prefix", "word", "key", F.col("n").alias("a"))
        if m == 1:
            total = stripes.where("word = 0").groupBy("prefix").agg(F.sum("n").alias("n"))
            none = F.array().cast("array<long>")
            rows = spread_join(ext, total, "prefix", ["word"], hot_keys(ext, "prefix")).select(F.col("prefix").alias("root"), "prefix", "key", F.array("word").alias("path"), "a", "n", none.alias("firsts"), none.alias("rests"), F.lit(0).cast("long").alias("ending"))
        else:
            up = out[-1].select(F.col("key").alias("prefix"), "root", "path", "n", F.concat("firsts", F.array("a")).alias("firsts"))
            rows = spread_join(ext, up, "prefix", ["word"], hot_keys(ext, "prefix")).select("root", "prefix", "key", F.concat("path", F.array("word")).alias("path"), "a", "n", "firsts")
            rows = stored(with_ending(rows), "extensions")
            ended = out[-1].select(F.col("key").alias("ending"), F.concat(F.array("a"), "rests").alias("rests"))
            ends = spread_join(rows, ended, "ending", ["key"], hot_keys(rows, "ending"))
        rows = stored(rows if m == 1 else ends.select(*out[-1].columns), "phrases")
        discard(stripes)
        if m == 1:
            slices = 1 + rows.count() // SLICE
        known = known | bitmap(rows)
        out.append(rows)
    return out


def cut(n: Column) -> Column:
    """score, k, l and r of the cut with the lowest score."""

    def whole(c: Column) -> Column:
        return c.cast("decimal(38,0)")

    def one(k: Column) -> Column:
        first, rest = F.get("firsts", k - 1), F.get("rests", k - 1)
        over = whole(F.col("a")) * whole(F.lit(1000)) * whole(n)
        return F.struct(F.call_function("div", over, whole(first) * whole(rest)).alias("score"), k.alias("k"), first.alias("l"), rest.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("firsts")), one))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, longest: int = WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    docs = docs.select(F.coalesce("lang", F.lit(UND)).alias("lang"), "text").where("text is not null")
    phrases = levels(docs, least, longest)
    kept = []
    for k, here in enumerate(phrases[1:], 2):
        if k < longest:
            right = phrases[k].groupBy(F.col("prefix").alias("key")).agg(F.max("a").alias("right"))
            left = phrases[k].groupBy(F.col("ending").alias("key")).agg(F.max("a").alias("left"))
            here = here.join(right, "key", "left").join(left, "key", "left")
            # greatest passes over nulls
            here = here.where(f"100L * coalesce(greatest(right, left), 0L) < {inside}L * a")
        kept.append(here.select("root", "path", "a", "n", "firsts", "rests"))
    scored = reduce(DataFrame.union, kept).withColumn("best", cut(F.col("n")))
    scored = scored.select("root", "path", "a", "n", *(F.col(f"best.{c}").cast("long").alias(c) for c in ("l", "r", "score")))
    first = F.rank().over(Window.partitionBy("root").orderBy(F.desc("score"), F.desc("a")))
    best = stored(scored.withColumn("first", first).where(F.col("first") <= top), "best")  # with all ties
    words = stored(names(docs, bitmap(best.select(F.explode("path").alias("key")))), "names")
    spelt = best.select("path", F.posexplode("path").alias("at", "key")).join(words, "key")
    spelt = spelt.groupBy("path").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w")).select("lang", "path", F.concat_ws(" ", "w.word").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = best.join(spelt, "path").withColumn("rank", rank).where(F.col("rank") <= top)
    out = stored(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    for used in (words, best, *phrases):
        discard(used)
    return out


def op11_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """All phrases of all documents, for small tables."""
    runs = " UNION ALL ".join(f"SELECT lang, {m} AS m, unnest(list_transform(range(1, len(w) - {m - 2}), lambda i: array_to_string(w[i:i+{m - 1}], ' '))) AS phrase FROM pieces WHERE len(w) >= {m}" for m in range(1, WORDS + 1))
    return rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
split AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
pieces AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM split),
f AS (SELECT lang, m, phrase, count(*) AS a FROM ({runs}) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS HUGEINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= {least}),
gone AS (SELECT DISTINCT x.lang, x.phrase FROM (SELECT lang, a, unnest([array_to_string(w[2:], ' '), array_to_string(w[:m - 1], ' ')]) AS phrase FROM c WHERE m > 2) y JOIN c x ON x.lang = y.lang AND x.phrase = y.phrase WHERE 100 * y.a >= 100 * x.a),
cuts AS (SELECT c.*, k, array_to_string(w[:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q FROM c, range(1, {WORDS}) t(k) WHERE k < m AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = c.lang AND g.phrase = c.phrase)),
scored AS (SELECT u.lang, u.phrase, u.a, x.a AS l, y.a AS r, t.n, u.k, (CAST(1000 AS HUGEINT) * u.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS score FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = u.p JOIN f y ON y.lang = u.lang AND y.phrase = u.q JOIN totals t ON t.lang = u.lang),
least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS j FROM scored) WHERE j = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {top}"""


QUERIES = {"op11_phrase_stripes": op11_phrase_stripes}
ORACLE = {"op11_phrase_stripes": oracle()}
