"""Quality rules with risk-controlled thresholds (operator 6).

Two fixed base rules fail short and repetitive texts. Beyond them, each measured ratio gets a
cutoff per stratum (length class), chosen on labelled holdouts: a cutoff is certified if the
exact (Clopper-Pearson) upper bound of its false-rejection rate on good documents is at most
``risk / number of rules``. Cutoffs are tested from loose to strict and testing stops at the
first that fails (fixed sequence), each sequence at level ``delta / number of sequences``
(Bonferroni over strata and rules). Hence, with probability 1 - delta, in every stratum the
learned rules reject at most ``risk`` of good documents. With too few labels nothing is
certified and the rule rejects nothing. Of the certified cutoffs the strictest is used, if its
rejection rate among bad documents is ``GAIN`` times that among good ones, else the next looser.

Defined cases: a null text has no words and fails the base; labels that are null or name no
document are ignored; a document labelled more than once counts as good only if all its labels
say so; an empty labels table switches the learned rules off, an empty documents table gives none;
repeated rows give repeated results; texts of any length are read whole; other columns of both tables
are ignored, whatever their names. A value equal to a cutoff is kept.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octofold.llm.common import map_rows, stored, table

SYMBOLS = "[#*$%&|<>]"[1:-1]
SPACES = " \t\n\x0b\x0c\r"
#: Length classes: words of the upper ends.
STRATA = (150, 500)
#: Rule, whether high values are bad, cutoffs from loose to strict.
RULES = (
    ("symbol_share", True, (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02, 0.01)),
    ("dup_line_share", True, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    ("repeat_share", True, (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("mean_word", True, (40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.0)),
    ("mean_word", False, (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0)),
)
RISK, DELTA, GAIN = 0.03, 0.05, 10
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more, the first included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    count, covered = 0, 0  # covered: words before this index are counted
    for i, w in enumerate(windows):
        if seen[w] > 1:
            count += i + 3 - max(covered, i)
            covered = i + 3
    return count


def features(doc_id: int | None, text: str | None) -> tuple:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word)."""
    if not text:
        return (doc_id, 0, 0, 0, 0, 0, 0)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII spaces
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x and x.strip(SPACES)]
    return (doc_id, len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The features of every document, where it was read."""
    return map_rows(docs, [id_col, text_col], f"{id_col} long, {FEATURES}", lambda: features)


def ratios() -> dict[str, Column]:
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "symbol_share": over("n_symbols", "word_chars"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "mean_word": over("word_chars", "n_words"),
    }


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for i in reversed(range(len(STRATA))):
        out = F.when(F.col("n_words") < STRATA[i], i).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the p at which k or fewer of n has probability ``level``."""
    if n == 0 or k >= n:
        return 1.0
    if k == 0:
        return 1 - level ** (1 / n)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def below(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        return math.fsum(math.exp(c + i * a + (n - i) * b) for i, c in enumerate(logs))

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid < 1 and below(mid) > level else (lo, mid)
    return hi


def learn(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[int, int], float]:
    """{(stratum, rule index): cutoff}. Only counts by stratum and cutoff reach the driver:
    strata x (1 + grid points) numbers, whatever the input's size."""
    graded = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.join(graded, "doc_id").where(~base_failed())
    for name, value in ratios().items():
        held = held.withColumn(name, value)
    rejected = [((F.col(n) > c) if high else (F.col(n) < c)).cast("long") for n, high, grid in RULES for c in grid]
    sums = [F.sum(x).alias(f"r{i}") for i, x in enumerate(rejected)]
    rows = held.groupBy(stratum().alias("stratum"), (F.col("quality") > 0).alias("good")).agg(F.count("*").alias("n"), *sums).collect()
    counts = {(row["stratum"], row["good"]): row for row in rows}
    sequences = (len(STRATA) + 1) * len(RULES)
    cutoffs = {}
    for (s, is_good), row in counts.items():
        bad = counts.get((s, False))
        if not is_good or bad is None:
            continue
        at = 0
        for r, (_, _, grid) in enumerate(RULES):
            for i, cut in enumerate(grid):
                k, n, level = row[f"r{at + i}"], row["n"], risk / len(RULES)
                if k > level * n or upper_bound(k, n, delta / sequences) > level:
                    break
                if bad[f"r{at + i}"] * n >= GAIN * max(k, 1) * bad["n"]:
                    cutoffs[s, r] = cut
            at += len(grid)
    return cutoffs


def apply(measured: DataFrame, cutoffs: dict[tuple[int, int], float]) -> DataFrame:
    """Adds base_failed and kept."""
    values, verdict = ratios(), F.lit(True)
    for (s, r), cut in sorted(cutoffs.items()):
        name, high, _ = RULES[r]
        verdict &= ~((stratum() == s) & ((values[name] > cut) if high else (values[name] < cut)))
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once: the features (seven numbers a document) are stored in the shared
    folder, and both the calibration and the verdicts read them there."""
    measured = stored(measure(table(spark, sf_dir, "documents")), "features")
    cutoffs = learn(measured, table(spark, sf_dir, "labels"))
    return apply(measured, cutoffs).drop("n_lines")


QUERIES = {"op6_quality_rules": op6_quality_rules}
