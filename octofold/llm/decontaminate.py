"""Benchmark decontamination by rare seeds and Smith-Waterman alignment (operator 3).

1. Test items give their n-grams of ``GRAM`` words (ASCII case and punctuation ignored).
2. One scan over the whole texts finds occurrences of any item n-gram, by a bitmap of fixed
   size, and cuts the passage around them: as far as the longest item reaches to either side.
   The same scan counts the items' words in the corpus.
3. Seeds are the rare n-grams: those that independent words would produce at most once in
   ``RARE_DOCS`` documents, given the counted frequencies, and in any case the rarest third of
   an item. A passage copied into very many documents stays rare by this measure.
4. Seeds join passages to items; passage and item are aligned word by word (match +2, mismatch
   and gap -1). The score is the alignment's value over that of the whole item, so edited
   copies score 1 - 1.5 times the share of replaced words; ``SCORE`` or more is reported.

Nothing is broadcast but the bitmaps; items join by a shuffle unless Spark finds them small.

Defined cases: null, empty or one-word texts and items match nothing; items shorter than GRAM
words use one n-gram of all their words and those under ``SHORT`` words need ``SHORT_SCORE``;
repeated rows of documents or items give one row for each pair of ids; an empty benchmark or
table gives none; null ids of documents are reported as such; texts of any length are read whole;
other columns are ignored, whatever their names. Of alignments of equal value in a document the one
that ends first is reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octofold.llm.common import bitmap, discard, forget, hot_keys, marked, spread_join, stored, table
from octofold.llm.shingles import hash_words, windows

GRAM, RARE_DOCS = 3, 1_000
SCORE, SHORT, SHORT_SCORE = 0.5, 8, 0.9
#: For UTF-8 bytes: lower-cases A-Z and turns ASCII characters but digits and letters into spaces.
PLAIN = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


COLUMNS = ["doc_id", "passage", "start", "words", "grams", "n_words"]


def words_of(text: str | None) -> np.ndarray:
    return hash_words(text.encode("utf-8", "surrogatepass").translate(PLAIN)) if text else np.zeros(0, np.uint64)


def grams_of(words: np.ndarray) -> np.ndarray:
    n = min(GRAM, len(words))
    return windows(words, n) + np.uint64(n) if n else words


def item_words(items: DataFrame) -> DataFrame:
    """item_id and words (hashes, in order) of each distinct item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            words = [words_of(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])

    out = items.select("item_id", "text").mapInArrow(run, "item_id long, words array<long>")
    return out.where("size(words) > 0").dropDuplicates()


def item_grams(items: DataFrame) -> DataFrame:
    """item_id, gram and its words, one row for each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids, grams, parts = [], [], []
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = grams_of(np.array(words, np.int64).view(np.uint64)).view(np.int64).tolist()
                ids += [item] * len(found)
                grams += found
                parts += [words[i : i + GRAM] for i in range(len(found))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["item_id", "gram", "parts"])

    return items.mapInArrow(run, "item_id long, gram long, parts array<long>").distinct()


def scan(docs: DataFrame, gram_bits, word_bits, reach: int) -> DataFrame:
    """Passages (doc_id, passage, start, words, grams: the item n-grams inside), and for each task
    one row with the counts of items' words (start -1, words and their counts in grams) whose
    n_words is the number of all words it read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total, counts = 0, {}
        for batch in batches:
            ids, names, starts, words_out, grams_out, seen = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not len(words):
                    continue
                total += len(words)
                seen.append(words[marked(word_bits.value, words)])
                sizes = range(1, GRAM + 1) if len(words) >= GRAM else range(1, len(words) + 1)
                hits = np.zeros(len(words), bool)
                grams = {}
                for n in sizes:
                    g = windows(words, n) + np.uint64(n)
                    hit = marked(gram_bits.value, g)
                    if hit.any():
                        grams[n] = (g, hit)
                        hits[: len(g)] |= hit
                at = np.flatnonzero(hits)
                if not len(at):
                    continue
                cut = np.flatnonzero(np.diff(at) > 2 * reach) + 1
                for group in np.split(at, cut):
                    a, b = max(0, int(group[0]) - reach), min(len(words), int(group[-1]) + reach)
                    ids.append(doc)
                    names.append(int.from_bytes(hashlib.blake2b(words[a:b].tobytes() + f"{doc} {a}".encode(), digest_size=8).digest(), "big", signed=True))
                    starts.append(a)
                    words_out.append(words[a:b].view(np.int64))
                    grams_out.append(np.unique(np.concatenate([g[a:b][hit[a:b]] for g, hit in grams.values()])).view(np.int64))
            if seen:
                for w, n in zip(*(x.tolist() for x in np.unique(np.concatenate(seen), return_counts=True))):
                    counts[w] = counts.get(w, 0) + n
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(words_out, pa.list_(pa.int64())), pa.array(grams_out, pa.list_(pa.int64())), pa.array([0] * len(ids), pa.int64())],
                names=COLUMNS,
            )
        keys = np.array(list(counts), np.uint64).view(np.int64)
        last = [pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([-1], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([list(counts.values())], pa.list_(pa.int64())), pa.array([total], pa.int64())]
        yield pa.RecordBatch.from_arrays(last, names=COLUMNS)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, passage long, start long, words array<long>, grams array<long>, n_words long")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's value and the place after its last passage word."""
    j = np.arange(1, len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        step = np.maximum(row[:-1] + np.where(passage == w, 2, -1), row[1:] - 1)
        row[1:] = np.maximum(0, np.maximum.accumulate(step + j) - j)  # gaps in the item
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def align_near(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """``align`` around the item's n-grams in the passage, as far as the item can reach from
    them: a passage is as long as the longest item needs."""
    reach = len(item) + len(item) // 4 + 1
    n = min(GRAM, len(item))
    at = np.flatnonzero(np.isin(windows(passage, n), windows(item, n)))
    best, end = 0, 0
    for part in np.split(at, np.flatnonzero(np.diff(at) > 2 * reach) + 1) if len(at) else []:
        first = max(0, int(part[0]) - reach)
        value, stop = align(item, passage[first : int(part[-1]) + n + reach])
        if value > best:
            best, end = value, first + stop
    return best, end


def leaks(docs: DataFrame, items: DataFrame, score: float = SCORE) -> DataFrame:
    """doc_id, item_id, score and end_word of every document that holds (an edited copy of) a
    test item; one row for each pair."""
    spark = docs.sparkSession
    items = stored(item_words(items), "items")
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    grams = stored(item_grams(items), "grams")
    gram_bits = spark.sparkContext.broadcast(bitmap(grams, "gram"))
    vocabulary = grams.select(F.explode("parts").alias("word")).distinct()
    word_bits = spark.sparkContext.broadcast(bitmap(vocabulary, "word"))
    found = stored(scan(docs, gram_bits, word_bits, longest + longest // 4 + 1), "passages")

    counted = found.where("start = -1")
    total = counted.agg(F.sum("n_words")).first()[0] or 0
    n_docs = max(1, docs.count())
    words = counted.select(F.explode(F.arrays_zip("words", "grams")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.grams").alias("n"))
    parts = grams.select("item_id", "gram", F.posexplode("parts").alias("k", "word")).join(words, "word", "left")
    share = F.log((F.coalesce("n", F.lit(0)) + 1) / float(total + 1))
    chance = parts.groupBy("item_id", "gram").agg((F.sum(share) + float(np.log(total + 1))).alias("chance"))
    third = chance.groupBy("item_id").agg(F.percentile_approx("chance", F.lit(1 / 3), F.lit(10_000)).alias("third"))
    seeds = chance.join(third, "item_id").where((F.col("chance") <= float(np.log(n_docs / RARE_DOCS))) | (F.col("chance") <= F.col("third"))).select("item_id", "gram")

    passages = found.where("start >= 0")
    held = passages.select("passage", F.explode("grams").alias("gram"))
    met = spread_join(held, seeds, "gram", ["passage"], hot_keys(held, "gram")).select("passage", "item_id").distinct()
    pairs = stored(met, "pairs")
    discard(grams)
    ready = pairs.join(passages.select("passage", "doc_id", "start", "words"), "passage")
    ready = spread_join(ready, items.select("item_id", F.col("words").alias("item")), "item_id", ["passage"], hot_keys(pairs, "item_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            scores, ends = [], []
            for start, words, item in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                value, end = align_near(np.array(item, np.int64).view(np.uint64), np.array(words, np.int64).view(np.uint64))
                scores.append(value / (2 * len(item)))
                ends.append(start + end)
            need = [SHORT_SCORE if len(x) < SHORT else score for x in batch.column(4).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(ends, pa.int64())], names=["doc_id", "item_id", "score", "end_word"])
            yield out.filter(pa.array([s >= n for s, n in zip(scores, need)], pa.bool_()))

    hits = ready.select("doc_id", "item_id", "start", "words", "item").mapInArrow(run, "doc_id long, item_id long, score double, end_word long")
    best = F.max(F.struct("score", (-F.col("end_word")).alias("e"))).alias("b")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", (-F.col("b.e")).alias("end_word"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
