"""Token counts without ids (operator 5).

The count of a text is the sum, over its pre-tokens, of pieces times frequency. Pieces are
counted once per distinct pre-token. Words are so skewed that a fixed number of frequent
pre-tokens makes up most of any text, hence two routes that together cover every pre-token:

* the head: at most ``HEAD`` pre-tokens, found on a bounded sample of documents, whose piece
  counts are broadcast (a few MB whatever the input's size) and summed where the text is read;
* the tail: all other pre-tokens with their per-document frequencies go to the shared folder;
  their distinct values get pieces counted once and are joined back by pre-token.

The choice of the head only moves work between the routes; it cannot change a count.

Pre-tokens are found with the tokenizer's own rules. Texts whose characters are all below
U+0250 or in the General Punctuation block take a regular expression that equals those rules
there; any other text, and any text holding a special token's string, goes through the
library's normaliser and pre-tokenizer themselves (special strings by its default: one token).

Defined cases: null texts count as empty (0 bytes, 0 tokens); repeated rows are counted each,
so the route's key is a row number made while reading, never doc_id; empty tables give none; texts of
any length count whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octofold.llm.common import stored, table

HEAD = 100_000
#: Documents of the sample that the head is found on.
SAMPLE_DOCS = 4_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PreTokens:
    """Frequencies of a text's pre-tokens, and the number of pieces of one."""

    #: Equal to the tokenizer's split for lower-case text of the simple characters.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[0-9²³¹¼-¾]|(?:[^\s\w]|_)+")
    #: Letters, digits, punctuation and spaces that SPLIT and str.lower treat as the library does.
    SIMPLE = re.compile(r"[\t-\r -~ -įĲ-ɏ‐-‧‰-⁞]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.normalizer, self.splitter = self.library.normalizer, self.library.pre_tokenizer
        self.plain = all("<|" in s for s in self.special)

    def counts(self, text: str) -> tuple[Counter, int]:
        """({pre-token: frequency}, number of special tokens)."""
        n_special, parts = 0, [text]
        if not self.plain or "<|" in text:
            pieces = self.cut.split(text) if self.cut else [text]
            n_special, parts = len(pieces) // 2, pieces[::2]
        out: Counter = Counter()
        for part in parts:
            if self.SIMPLE.fullmatch(part):
                out.update(self.SPLIT.findall(part.lower()))
            else:
                normal = self.normalizer.normalize_str(part)
                out.update("\x00" + token for token, _ in self.splitter.pre_tokenize_str(normal))
        return out, n_special

    def pieces(self, pre_token: str) -> int:
        """Pieces of one pre-token; those of the library's own splitter carry a mark and are
        already mapped to its byte alphabet."""
        if pre_token.startswith("\x00"):
            return len(self.library.model.tokenize(pre_token[1:]))
        return sum(len(self.library.model.tokenize(t)) for t, _ in self.splitter.pre_tokenize_str(pre_token))


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """(pre_token, pieces) of a table of distinct pre_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = PreTokens(path)
        for batch in batches:
            col = batch.column(0)
            yield pa.RecordBatch.from_arrays([col, pa.array([rules.pieces(w) for w in col.to_pylist()], pa.int32())], names=["pre_token", "pieces"])

    return words.select("pre_token").mapInArrow(run, "pre_token string, pieces int")


def split_texts(docs: DataFrame, path: str, head) -> DataFrame:
    """One row per document: id, bytes, tokens of the head route, and the tail's pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, known = PreTokens(path), head.value if head is not None else {}
        for batch in batches:
            ids, sizes, sums, words, times = batch.column(0), [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                found, total = rules.counts(text)
                w, t = [], []
                for word, n in found.items():
                    pieces = known.get(word)
                    if pieces is None:
                        w.append(word)
                        t.append(n)
                    else:
                        total += n * pieces
                sums.append(total)
                words.append(w)
                times.append(t)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "n_bytes", "head_tokens", "words", "times"],
            )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, head_tokens long, words array<string>, times array<int>")


def find_head(docs: DataFrame, path: str, size: int = HEAD, sample_docs: int = SAMPLE_DOCS):
    """Broadcast {pre_token: pieces} of the most frequent pre-tokens of a bounded sample."""
    n = docs.select(F.count("*")).first()[0]
    if not n:
        return None
    share = min(1.0, sample_docs / n)
    sample = docs.sample(withReplacement=False, fraction=share, seed=5).limit(2 * sample_docs)
    split = split_texts(sample, path, None)
    words = split.select(F.explode(F.arrays_zip("words", "times")).alias("x")).groupBy(F.col("x.words").alias("pre_token")).agg(F.sum("x.times").alias("n"))
    top = words.where("n > 1").orderBy(F.desc("n"), "pre_token").limit(size)
    return docs.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in piece_counts(top, path).toLocalIterator()})


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    head = find_head(docs, path)
    split = stored(split_texts(docs, path, head).withColumn("row", F.monotonically_increasing_id()), "split")
    tail = split.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("pre_token"), F.col("x.times").alias("n"))
    pieces = piece_counts(tail.select("pre_token").distinct(), path)
    tokens = tail.join(pieces, "pre_token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("tail_tokens"))
    n_tokens = F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0))
    return split.select("row", "doc_id", "n_bytes", "head_tokens").join(tokens, "row", "left").select(F.col("doc_id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op5_token_count": op5_token_count}
