"""Language identification by cross-parsing entropy (operator 7).

For each language, labelled text becomes a suffix automaton, which recognises exactly the
substrings of that text. A document is parsed greedily into the longest phrases that the
automaton recognises; text of the same language needs few, long phrases. Pointing at a phrase
costs log2 of the labelled text's length, so the normalised phrase count is

    phrases * log2(length of labelled text) / symbols of the document

and the language with the smallest wins (ties: the first in alphabetical order). The score is
the softmax of minus the phrases' costs in nats, so it is near 1 / languages for a text that
tells nothing and near 1 for a clear one.

The automata learn from a bounded sample: ``max_chars`` characters for each language, at most
``doc_chars`` from one document, taken in the order of a hash of doc_id among documents whose
crc32(doc_id as text) mod 5 is not 0. Prediction reads whole texts. Texts are cut into windows
of ``WINDOW`` symbols that all step through the automata at once (numpy), a phrase ending at
each window's end; this holds for all languages alike and bounds memory for any text length.

Defined cases: null texts and texts without a letter give ``und`` with score 0; with no
labelled text every document is ``und``; a null doc_id is never learnt from and not held out;
repeated rows give repeated results, and repeated rows of the sample are learnt from twice; an empty
table gives none; columns named lang_pred or score are replaced in ``predict``'s result, all others
are kept there as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octofold.llm.common import forget, table

UNKNOWN = "und"
MAX_CHARS, DOC_CHARS, SAMPLE_DOCS = 16_000, 1_000, 64
#: Characters over all languages: with very many languages each gets less.
TOTAL_CHARS = 512_000
WINDOW = 512
#: Symbols (the most frequent) that have a column in the table of steps; the others' transitions
#: are looked up among sorted keys, with equal results.
#: The table has at most CELLS steps (64 MB): with very many states fewer symbols have a column.
DENSE, CELLS = 128, 1 << 24
LETTER = re.compile(r"[^\W\d_]")


def code_units(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), dtype=np.uint16)


def letters_of(units: np.ndarray) -> list[int]:
    return [int(u) for u in np.unique(units) if chr(u).isalpha()]


class SuffixAutomaton:
    """Transitions of the automaton of all substrings of a sequence of small integers."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for s in symbols:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and s not in self.next[p]:
                self.next[p][s] = new
                p = link[p]
            if p != -1:
                q = self.next[p][s]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(s) == q:
                        self.next[p][s] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


class Model:
    """The automata of all languages as one table of steps.

    ``steps[state + symbol]`` is twice the next state, plus 1 if a new phrase begins there; a
    state is the place of its row in the table. Where an automaton has no transition, the step
    goes to where the root's transition leads, or stays at the root for a symbol it never saw.

    Every letter of the samples has a symbol of its own, frequent ones first. Rows of the table
    end at symbol ``last``; the transitions by that and later symbols are few and kept as sorted
    keys, so that the size follows the automata also with thousands of letters.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        joined = {lang: " ".join(samples[lang]) for lang in self.languages}
        seen = np.zeros(65536, dtype=np.int64)
        for text in joined.values():
            seen += np.bincount(code_units(text), minlength=65536)
        known = sorted(letters_of(np.flatnonzero(seen)), key=lambda u: (-seen[u], u))
        self.symbol = np.zeros(65536, dtype=np.int64)  # 0: anything that is no letter
        other = len(known) + 1  # letters that no automaton knows
        for u in range(65536):
            if chr(u).isalpha():
                self.symbol[u] = other
        self.symbol[known] = np.arange(1, len(known) + 1)
        texts = {lang: self.symbol[code_units(joined[lang])].tolist() for lang in self.languages}
        automata = {lang: SuffixAutomaton(symbols).next for lang, symbols in texts.items()}
        self.alphabet, self.last = other + 1, min(other, DENSE, max(4, CELLS // max(1, sum(map(len, automata.values()))) - 1))
        width = self.last + 1
        tables, keys, moved, firsts, self.roots, self.costs, base = [], [], [], [], [], [], 0
        for lang in self.languages:
            symbols, moves = texts[lang], automata.pop(lang)
            first = np.full(self.alphabet, 2 * base + 1, dtype=np.int64)
            for s, q in moves[0].items():
                first[s] = 2 * (base + q * width) + 1
            at = first[:width].copy()
            at[self.last] = 2 * base + 1
            steps = np.tile(at, (len(moves), 1))
            for p, out in enumerate(moves):
                for s, q in out.items():
                    step = 2 * (base + q * width) + (p == 0)
                    if s < self.last:
                        steps[p, s] = step
                    else:
                        keys.append((base + p * width) * self.alphabet + s)
                        moved.append(step)
            tables.append(steps.ravel())
            firsts.append(first)
            self.roots.append(base)
            self.costs.append(math.log2(max(2, len(symbols))))
            base += steps.size
        self.steps = np.concatenate(tables or [np.zeros(0)]).astype(np.int32)
        self.first = np.array(firsts, dtype=np.int32).reshape(len(firsts), self.alphabet)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.rare_keys, self.rare_steps = np.array(keys, dtype=np.int64)[order], np.array(moved, dtype=np.int32)[order]

    def rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Steps of (languages, texts) states by symbols from ``last`` on."""
        keys = state.astype(np.int64) * self.alphabet + symbol
        at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
        return np.where(self.rare_keys[at] == keys, self.rare_steps[at], self.first[:, symbol])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): phrases that each text needs in each language."""
        lengths, parts = [], []
        for text in texts:
            part = self.symbol[code_units(text)].astype(np.int32)
            parts.append(part)
            lengths.append(len(part))
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not sum(lengths):
            return out
        flat = np.concatenate(parts)
        rare = bool(len(self.rare_keys))
        owner, start, size, at = [], [], [], 0
        for i, n in enumerate(lengths):
            begins = np.arange(at, at + n, WINDOW)
            start.append(begins)
            size.append(np.minimum(WINDOW, at + n - begins))
            owner.append(np.full(len(begins), i))
            at += n
        owner, start, size = map(np.concatenate, (owner, start, size))
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        state = np.repeat(np.array(self.roots, dtype=np.int32)[:, None], len(start), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        alive = np.searchsorted(-size, -np.arange(WINDOW), side="left")  # windows longer than t
        for t in range(int(size[0])):
            k = int(alive[t])
            symbol = flat[start[:k] + t]
            move = self.steps[state[:, :k] + (np.minimum(symbol, self.last) if rare else symbol)]
            if rare:
                late = np.flatnonzero(symbol >= self.last)
                if late.size:
                    move[:, late] = self.rare(state[:, late], symbol[late])
            count[:, :k] += move & 1
            state[:, :k] = move >> 1
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(owner, weights=count[j], minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        use = [i for i, x in enumerate(texts) if x and LETTER.search(x)] if self.languages else []
        if use:
            cost = self.phrases([texts[i] for i in use]) * np.array(self.costs)
            best = cost.argmin(axis=1)
            odds = np.exp((cost.min(axis=1, keepdims=True) - cost) * math.log(2))
            top = 1 / odds.sum(axis=1)
            for i, b, s in zip(use, best.tolist(), top.tolist()):
                lang[i], score[i] = self.languages[b], s
        return lang, score


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, max_chars: int = MAX_CHARS, doc_chars: int = DOC_CHARS, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of a bounded sample: about 4 * sample_docs documents a language reach the
    driver, doc_chars characters of each."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Model({})
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(scale, 4 * sample_docs * scale // n + 1))])
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    drawn = usable.where(rank < share[F.col("lang")]).select("lang", rank.alias("rank"), "doc_id", F.substring("text", 1, doc_chars).alias("text"))
    each = max(1, min(max_chars, TOTAL_CHARS // len(counts)))
    samples: dict[str, list[str]] = {}
    for row in sorted(drawn.collect(), key=lambda r: (r["rank"], r["doc_id"], r["text"])):
        taken = samples.setdefault(row["lang"], [])
        left = each - sum(map(len, taken))
        if left > 0 and LETTER.search(row["text"]):
            taken.append(row["text"][:left])
    return Model({k: v for k, v in samples.items() if v})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The input's columns with lang_pred and score after them (replacing columns so named)."""
    keep = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, text_at = keep.columns, keep.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            lang, score = sent.value.predict(batch.column(text_at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + ", lang_pred string, score double"
    return keep.mapInArrow(run, schema)


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns unchanged, whose language is predicted (not ``und``)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            lang, _ = sent.value.predict(batch.column(text_at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN for x in lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
