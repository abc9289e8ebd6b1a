"""Personal data by a semi-Markov conditional random field (operator 1).

Fixed patterns give the base spans (email, ip, card, phone). The model scores whole candidate
segments: features look at the entire span (its mask of letters, digits and marks, its number of
digits, checksum, address form) and at what stands beside it. A dynamic program over segment
ends, with segments of at most ``MAX_TOKENS`` tokens, chooses boundaries and types together;
forward-backward sums give each chosen segment's marginal. Segments that the best segmentation
chooses with a marginal of ``SURE`` or more and that touch no base span are added; base spans
always stay.

Only stretches around digits and at-signs are searched: every admissible segment holds one.
Whole texts are scanned, in time linear in their length. The model is fitted at the driver on a
bounded sample (``SAMPLE_DOCS`` documents in hash order, ``SAMPLE_WINDOWS`` stretches), whose
labels are the base spans; a third of the phone stretches are relabelled variants without the
country code.

Defined cases: null and empty texts have no spans (the hash is that of the empty string); with
nothing to learn from (also an empty table) only base spans are reported; repeated rows give repeated
results; texts of any length are scanned whole; other columns are ignored by ``digest`` and kept by
``redact``, whatever their names. Of spans that overlap, base ones stay and touching added ones go;
segments of equal score: the one found first, by end, then start.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octofold.llm.common import forget, map_rows, table

KINDS = ("email", "ip", "card", "phone")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
TRIGGER = re.compile(r"[0-9@]")
#: Tokens of a segment, characters of a segment, characters around a trigger, marginal of a report.
MAX_TOKENS, MAX_CHARS, AROUND, SURE = 16, 64, 40, 0.95
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS = 20_000, 600, 8
CUES = frozenset("mail email e-mail ip host address card visa phone tel call fax mobile".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping in each kind."""
    out: list[tuple[int, str, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in EMAIL_LEFT:
            begin -= 1
        right = EMAIL_RIGHT.match(text, at + 1) if begin < at else None
        if right:
            last = right.end()
            out.append((begin, "email", last))
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = only_digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), "card", m.end()))
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text around digits and at-signs, cut at line ends."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    parts = []
    for a, b in out:
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum() and a % MAX_CHARS:
            a -= 1
        while a < b:
            end = text.find("\n", a, b)
            end = b if end < 0 else end
            if TRIGGER.search(text, a, end):
                parts.append((a, end))
            a = end + 1
    return parts


def mask(segment: str) -> str:
    return re.sub(r"[^\W_]+", lambda m: "d" if m[0].isdecimal() else "w", segment).replace("\t", " ")


def beside(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "letter" if c.isalpha() else "digit" if c.isdecimal() else "space" if c.isspace() else c


def segment_features(text: str, a: int, b: int, before: str) -> list[str]:
    seg = text[a:b]
    digits = only_digits(seg)
    n = len(digits)
    out = ["bias", "mask=" + mask(seg), f"digits={n}", f"at={seg.count('@')}", "left=" + beside(text, a - 1), "right=" + beside(text, b), "first=" + beside(seg, 0), "last=" + beside(seg, len(seg) - 1)]
    if 12 <= n <= 19:
        out.append(f"luhn={luhn(digits)}")
    if seg.count(".") == 3 and not seg.strip("0123456789."):
        out.append(f"octets={all(0 < len(p) < 4 and int(p) < 256 for p in seg.split('.'))}")
    if before in CUES:
        out.append("cue=" + before)
    return out


def candidates(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The tokens of text[a:b], and the admissible segments (first token, last token + 1)."""
    tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
    trig = [bool(TRIGGER.search(text, s, e)) for s, e in tokens]
    digits = [e - s if text[s].isdecimal() else 0 for s, e in tokens]
    out = []
    for i, (s, _) in enumerate(tokens):
        if not (text[s].isalnum() or text[s] in "+("):
            continue
        seen, n, at = False, 0, False
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            e = tokens[j][1]
            if e - s > MAX_CHARS or j > i and tokens[j][0] - tokens[j - 1][1] > 2:
                break
            seen, n, at = seen or trig[j], n + digits[j], at or text[tokens[j][0]] == "@"
            if seen and (n >= 4 or at) and text[e - 1].isalnum():
                out.append((i, j + 1))
    return tokens, out


def log_add(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class SemiMarkov:
    """Weights of (feature, kind); a token outside entities scores 0."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))

    def rows(self, text: str, tokens: list, segments: list, grow: bool) -> list[np.ndarray]:
        out = []
        for i, j in segments:
            before = text[slice(*tokens[i - 1])].lower() if i else ""
            names = segment_features(text, tokens[i][0], tokens[j - 1][1], before)
            if grow:
                for f in names:
                    self.index.setdefault(f, len(self.index))
            out.append(np.array([self.index[f] for f in names if f in self.index], dtype=np.int64))
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum(axis=0) for r in rows]).reshape(len(rows), len(KINDS))

    @staticmethod
    def marginals(n: int, segments: list, scores: np.ndarray) -> np.ndarray:
        """P(segment, kind) by forward and backward sums over segment boundaries."""
        ending, beginning = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(segments):
            ending[j].append(k)
            beginning[i].append(k)
        total = [log_add(list(s)) for s in scores]
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = log_add([ahead[j - 1], *(ahead[segments[k][0]] + total[k] for k in ending[j])])
        for i in range(n - 1, -1, -1):
            behind[i] = log_add([behind[i + 1], *(behind[segments[k][1]] + total[k] for k in beginning[i])])
        edge = np.array([ahead[i] + behind[j] - ahead[n] for i, j in segments])
        return np.exp(np.minimum(0.0, edge[:, None] + scores))

    @staticmethod
    def best(n: int, segments: list, scores: np.ndarray) -> list[tuple[int, int]]:
        """(segment, kind) of the best segmentation, by Viterbi over segment ends."""
        ending = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(segments):
            ending[j].append(k)
        kind = scores.argmax(axis=1) if len(segments) else []
        value, choice = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in ending[j]:
                v = value[segments[k][0]] + scores[k, kind[k]]
                if v > value[j]:
                    value[j], choice[j] = v, k
        out, j = [], n
        while j > 0:
            k = choice[j]
            if k < 0:
                j -= 1
            else:
                out.append((k, int(kind[k])))
                j = segments[k][0]
        return out[::-1]

    def fit(self, texts: list[tuple[str, list[tuple[int, str, int]]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4) -> SemiMarkov:
        """Maximum likelihood by AdaGrad; texts come with their labelled spans."""
        cases = []
        for text, spans in texts:
            tokens, segments = candidates(text, 0, len(text))
            if not segments:
                continue
            gold = {(s, e): KINDS.index(k) for s, k, e in spans}
            target = np.zeros((len(segments), len(KINDS)))
            for k, (i, j) in enumerate(segments):
                kind = gold.get((tokens[i][0], tokens[j - 1][1]))
                if kind is not None:
                    target[k, kind] = 1
            cases.append((len(tokens), segments, self.rows(text, tokens, segments, True), target))
        self.weights = np.zeros((len(self.index), len(KINDS)))
        squares = np.full_like(self.weights, 1e-6)
        order = np.random.RandomState(1)
        for _ in range(epochs):
            for c in order.permutation(len(cases)):
                n, segments, rows, target = cases[c]
                step = target - self.marginals(n, segments, self.scores(rows))
                grad = np.zeros_like(self.weights)
                np.add.at(grad, np.concatenate(rows), np.repeat(step, [len(r) for r in rows], axis=0))
                grad -= decay * self.weights
                squares += grad**2
                self.weights += rate * grad / np.sqrt(squares)
        return self

    def spans(self, text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        """The spans that the model adds to the base ones."""
        if not len(self.weights):
            return []
        out = []
        taken = sorted((s, e) for s, _, e in base)
        for a, b in stretches(text):
            tokens, segments = candidates(text, a, b)
            if not segments:
                continue
            scores = self.scores(self.rows(text, tokens, segments, False))
            chosen = self.best(len(tokens), segments, scores)
            if not chosen:
                continue
            sure = None
            for k, kind in chosen:
                s, e = tokens[segments[k][0]][0], tokens[segments[k][1] - 1][1]
                if any(x < e and s < y for x, y in taken):
                    continue
                if sure is None:
                    sure = self.marginals(len(tokens), segments, scores)
                if sure[k, kind] >= SURE:
                    out.append((s, KINDS[kind], e))
        return out


def variant(window: str, spans: list[tuple[int, str, int]]) -> tuple[str, list[tuple[int, str, int]]] | None:
    """The stretch with its only phone number written without the country code."""
    phones = [x for x in spans if x[1] == "phone"]
    if len(phones) != 1 or len(spans) != 1:
        return None
    s, _, e = phones[0]
    m = re.match(r"\+[0-9]{1,3}[ .-]+(?=\(?[0-9])", window[s:e])
    if not m:
        return None
    return window[:s] + window[s + m.end() : e] + window[e:], [(s, "phone", e - m.end())]


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> SemiMarkov:
    n = docs.count()
    if not n:
        return SemiMarkov()
    scale = 1 << 30
    rank = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(scale))
    drawn = docs.select(rank.alias("rank"), "text").where((F.col("rank") < min(scale, sample_docs * scale // n + 1)) & F.col("text").rlike("[0-9@]"))

    def first(rank: int, text: str) -> tuple:
        parts = stretches(text)[:4]
        return (rank, [text[a:b] for a, b in parts])

    found = map_rows(drawn, ["rank", "text"], "rank long, parts array<string>", lambda: first)
    windows = found.select("rank", F.explode("parts").alias("part")).orderBy("rank", "part").limit(sample_windows).collect()
    texts = []
    for i, row in enumerate(windows):
        spans = base_spans(row["part"])
        other = variant(row["part"], spans) if i % 3 == 0 else None
        texts.append(other or (row["part"], spans))
    return SemiMarkov().fit(texts)


def joined(spans: list[tuple[int, str, int]]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


def find(text: str | None, model: SemiMarkov) -> tuple[list, list]:
    """(base spans, added spans)."""
    if not text or not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, model.spans(text, base)


def digest(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """One row for each document: counts of base spans, their hash, all spans, added spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def row(doc_id: int | None, text: str | None) -> tuple:
        base, added = find(text, sent.value)
        n = [sum(x[1] == k for x in base) for k in KINDS]
        return (doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added))

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_rows(docs, ["doc_id", "text"], schema, lambda: row)


def replaced(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind's mark."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """The documents with spans replaced by marks such as <EMAIL>; n_chars follows the text.
    Texts without spans, and null texts, are unchanged."""
    import pyarrow as pa

    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index("text")

    def run(batches):
        forget()
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                base, added = find(text, sent.value)
                texts.append(replaced(text, base + added) if base or added else text)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(docs, learn(docs))


QUERIES = {"op1_pii_spans": op1_pii_spans}
