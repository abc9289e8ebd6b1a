"""SentencePiece encoding and decoding by a streaming Viterbi search (operator 10).

The search runs over text positions. A state is the piece that ends at a position; its one
backpointer is the piece's start. Scores of a byte-pair vocabulary are merge priorities, not
log-probabilities, so a best-sum path would not be the library's segmentation. The potential
between neighbouring pieces is therefore hard: 0 if merging their joined text by priority gives
back these two pieces, minus infinity otherwise. A sequence is the vocabulary's segmentation of
a text exactly if all its neighbours are so compatible, hence at most one path survives at each
position and its ids equal the library's (tests hold both against each other).

Streaming: pieces are at most ``longest`` characters, so the next step sees only the last
``longest`` positions. When the surviving paths of all of these share a boundary, the ids before
it are committed and the window moves there. Some boundaries are certain from the vocabulary alone:
before a space mark that follows text, around characters that no longer piece holds, and before
punctuation that no piece has after other text. Stretches between these are looked up in a
bounded memo before they are searched.

Defined cases: a null or empty text has no ids and decodes to the empty text; characters
outside the vocabulary become their UTF-8 bytes' pieces; lone surrogates become U+FFFD; the
space mark itself decodes to a space (as in the library), and ``lossless`` says whether decoding
gave the text back; repeated rows give repeated results; texts of any length are encoded whole; an
empty table gives none; other columns are ignored, whatever their names. There are no ties: at most one
path survives at a position.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from octofold.llm.common import table, tools

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Stretches (of STRIDE characters at most) and neighbour pairs that a Python worker remembers at
#: most: some 80 and 40 MB, since workers outlive their tasks.
MEMO, PAIRS = 400_000, 200_000
#: Positions between two looks for a common boundary.
STRIDE = 64


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.vocab_size()
        self.ids: dict[str, int] = {}
        self.score: list[float] = [0.0] * n
        self.text = [b""] * n
        self.bytes = [0] * 256
        for i in range(n):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not library.is_control(i) and not library.is_unknown(i):
                self.ids[piece] = i
                self.score[i] = library.get_score(i)
                self.text[i] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that hold a space mark after text are not supported")
        self.stretches = self.certain(self.ids)
        self.every, self.names = self.ids, {i: p for p, i in self.ids.items()}
        self.ids = {p: i for p, i in self.every.items() if self.merged(p) == [i]}  # no other piece can occur
        self.wide = np.dtype(np.uint16 if n <= 65536 else np.uint32)
        self.follow: list[dict[int, bool]] = [{} for _ in range(n)]
        self.n_pairs = 0
        self.endings: dict = {}  # pieces from their last character back: (next node, id or -1)
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            node = self.endings
            for c in p[:0:-1]:
                if c not in node:
                    node[c] = ({}, -1)
                node = node[c][0]
            node[p[0]] = (node[p[0]][0] if p[0] in node else {}, i)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was in use before the memo was filled

    @staticmethod
    def certain(pieces: Iterable[str]) -> re.Pattern:
        """Cuts a text where no piece can cross: before spaces, around characters that no longer
        piece holds, and between other text and a punctuation mark that no piece has there."""
        steps = {(p[i], p[i + 1]) for p in pieces for i in range(len(p) - 1)}
        within = {c for step in steps for c in step}
        alone = "".join(c for c in "\n\t\r" if c not in within)
        marks = set(string.punctuation) - set(alone)
        odd = {a for a, b in steps if b in marks and a not in marks and a != MARK}  # these may precede a mark
        if len(odd) > 20:
            marks, odd = set(), set()
        m, o, x = (re.escape("".join(sorted(s))) for s in (marks, odd, alone))
        run = f"[^ {x}{m}]*" + (f"(?:(?<=[{o}])[{m}]+[^ {x}{m}]*)*" if odd else "")
        start = f" *[{m}]*" if marks else " *"
        return re.compile((f"[{x}]|" if alone else "") + f"(?! *\\Z){start}{run}(?<=[^{x}])| +")

    def merged(self, text: str) -> list[int]:
        """Segmentation of a short text by merging the best pair until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.every.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.every.get(p, -1) for p in parts]

    def fit(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a: no merge crosses their boundary."""
        self.n_pairs += 1
        if self.n_pairs > PAIRS:
            self.n_pairs = 0
            for known in self.follow:
                known.clear()
        good = self.follow[a][b] = self.merged(self.names[a] + self.names[b]) == [a, b]
        return good

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the joined chunks, committed as soon as they are certain."""
        window, piece, start = "", [-2], [0]  # piece[i] ends at position i; -2: none yet, -3: no path
        for chunk in chunks:
            for at in range(0, len(chunk), STRIDE):
                window += chunk[at : at + STRIDE]
                self.advance(window, piece, start)
                keep = self.common(piece, start)
                if keep:
                    yield self.path(window, piece, start, keep)
                    window, piece = window[keep:], piece[keep:]
                    start = [0, *(max(0, s - keep) for s in start[keep + 1 :])]
        if window:
            yield self.path(window, piece, start, len(window))

    def advance(self, window: str, piece: list[int], start: list[int]) -> None:
        """Adds the states of the window's positions that have none yet."""
        endings, follow = self.endings, self.follow
        for end in range(len(piece), len(window) + 1):
            node, at = endings, end
            while at:
                step = node.get(window[at - 1])
                if step is None:
                    at = 0
                    break
                at -= 1
                node, i = step
                if i < 0:
                    continue
                before = piece[at]
                if before >= 0:
                    good = follow[before].get(i)
                    if good is None:
                        good = self.fit(before, i)
                    if good:
                        break
                elif before != -3:
                    break
            else:
                i = -1
            if step is None or i < 0:
                i, at = (-1, end - 1) if window[end - 1] not in self.ids else (-3, end)  # bytes, or no path
            piece.append(i)
            start.append(at)

    def common(self, piece: list[int], start: list[int]) -> int:
        """The last boundary that the paths from all live positions share: pieces to come begin
        at one of the last ``longest`` positions."""
        live = {p for p in range(max(0, len(piece) - self.longest), len(piece)) if piece[p] != -3}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(start[top])
        return live.pop() if live else 0

    def path(self, window: str, piece: list[int], start: list[int], end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            i = piece[end]
            out += [i] if i >= 0 else [self.bytes[b] for b in reversed(window[start[end] : end].encode("utf-8", "replace"))]
            end = start[end]
        return out[::-1]

    def search(self, stretches: Iterable[str]) -> None:
        """Puts the ids of stretches into the memo. In sorted order a stretch shares its first
        states with the one before."""
        last, piece, start = "", [-2], [0]
        for s in sorted(stretches):
            text = s.replace(" ", MARK)
            if len(text) > STRIDE:
                ids = [i for part in self.stream([text]) for i in part]
            else:
                same = 0
                for x, y in zip(text, last):
                    if x != y:
                        break
                    same += 1
                del piece[same + 1 :], start[same + 1 :]
                self.advance(text, piece, start)
                ids, last = self.path(text, piece, start, len(text)), text
            self.memo[s] = np.array(ids, self.wide).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the texts' unknown stretches are searched together."""
        parts = [self.stretches.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.memo) >= MEMO // 2:  # what isn't used until it is full again goes
            self.memo, self.older = {}, self.memo
        unknown = set().union(*parts).difference(self.memo)
        again = unknown & self.older.keys()
        self.memo.update((s, self.older[s]) for s in again)
        unknown -= again
        self.search(unknown)
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, p)), self.wide) for p in parts]
        for s in unknown:
            if len(s) > STRIDE:
                del self.memo[s]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> Codec:
    """The codec of this Python worker, with what it remembers from earlier tasks."""
    if path not in tools:
        tools[path] = Codec(path)
    return tools[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids and lossless of every document, where it was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            values, ends, same = [], [0], []
            texts = batch.column(1).to_pylist()
            for text, ids in zip(texts, own.encode(texts)):
                values.append(ids)
                ends.append(ends[-1] + len(ids))
                same.append(own.decode(ids) == (text or ""))
            flat = np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), ids, pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids array<int>, lossless boolean")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of a table of ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(ids or [], np.int32)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op10_spm_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), model_path())


QUERIES = {"op10_spm_codec": op10_spm_codec}
