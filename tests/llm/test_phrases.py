"""Phrases by stripes against a plain version, in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, save

from octofold.llm import phrase_stripes as P


def plain(rows, least, top=2_000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= found[p[i:j]]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dd", "É", "ß x", "the", "THE"] + [f"w{k}" for k in range(30)]
    fixed = "one two three four five six"
    out = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rng.randrange(40))
        at = rng.randrange(len(words) + 1)
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! "]) for w in words[:at] + rng.choice([[], fixed.split()]) + words[at:])
        out.append((rng.choice(["en", "en", "en", None, "und", "x y"]), text))
    return out


@pytest.mark.parametrize("slices", [0, 1])
def test_equals_plain(spark, monkeypatch, slices):
    """Also with many slices, small partial stripes and looks at few words."""
    if slices:
        for name, value in {"SLICE": 5, "HELD": 40, "GROUP": 900, "PART": 16, "BUCKETS": 2}.items():
            monkeypatch.setattr(P, name, value)
    rows = texts(slices, 400) + [("en", None), (None, ""), ("en", "q " * 300), (None, "z")]
    got = P.collocations(documents(spark, [t for _, t in rows], langs=[g for g, _ in rows]).repartition(3), least=8, top=60)
    assert sorted(map(tuple, got.collect())) == plain(rows, 8, 60)


def test_sql_equals_plain(tmp_path):
    rows = texts(9, 300)
    folder = save(tmp_path, documents={"lang": pa.array([g for g, _ in rows], pa.string()), "text": pa.array([t for _, t in rows], pa.string())})
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    assert sorted(duck.sql(P.oracle(8, 60)).fetchall()) == plain(rows, 8, 60)


def test_scores_pass_64_bits(spark):
    """1000 * a * n and l * r of a large corpus."""
    a, n, left, right = 123_456_789_012, 98_765_432_109_876, 234_567_890_123, 345_678_901_234
    got = spark.range(1).selectExpr(f"{a}L as a", f"{n}L as n", f"array({left}L, {left}L) as firsts", f"array({right}L, {right}L) as rests").select(P.cut(P.F.col("n")).alias("c")).first()["c"]
    assert (int(got["score"]), got["k"], got["l"], got["r"]) == (1000 * a * n // (left * right), 1, left, right)


def test_merged_stripes(spark):
    """Totals of the stripes without prefix are all words; extensions are counted exactly."""
    docs = documents(spark, ["x y. x z, x y x", "x y; y x y"] * 5).select("lang", "text")
    none = np.zeros(P.BITS // 8, np.uint8)
    one = P.merged(P.partial_stripes(docs, 1, none, 3, 5), 1, 10).collect()
    words = {r.key: r.word for r in P.names(docs, none | 255).collect()}
    assert sum(r.n for r in one if r.word == 0) == 60
    assert {(words[r.key], r.n) for r in one if r.word} == {("x", 30), ("y", 25)}
    known = P.bitmap(spark.createDataFrame([(r.key,) for r in one if r.word], "key long"))
    two = P.merged(P.partial_stripes(docs, 2, known, 2, 5), 2, 10).collect()
    assert {(words[r.prefix], words[r.word], r.n) for r in two if r.word} == {("x", "y", 20), ("y", "x", 10)}
    assert sum(r.n for r in two if not r.word and words[r.prefix] == "x") == 20


def test_words_and_keys(monkeypatch):
    """Words, pieces and keys of texts that are hashed in parts, also of a word longer than a part."""
    texts = ["A b\tB,a  b\n\nÉ .", "", "b" * 100 + " a", " ,; ", "a b"]
    langs = ["x", "x", "y", "y", "y"]
    whole = P.Words([t.encode() for t in texts], langs)
    assert [whole.word(i).decode() for i in range(len(whole.key))] == ["a", "b", "b", "a", "b", "É", "b" * 100, "a", "a", "b"]
    assert whole.first.tolist() == [True, False, False, True, False, True, True, False, True, False]
    monkeypatch.setattr(P, "PART", 16)
    assert (P.Words([t.encode() for t in texts], langs).key == whole.key).all()
    named = {(whole.names[g], whole.word(i)): int(k) for i, (g, k) in enumerate(zip(whole.lang, whole.key))}
    assert len(set(named.values())) == len(named) == 6 and [named[whole.names[g], whole.word(i)] for i, g in enumerate(whole.lang)] == whole.key.tolist()
    two = whole.windows(2)[1]
    assert (two != 0).tolist() == [True, True, False, True, False, False, True, False, True, False]
    assert two[0] == two[3] != two[8]


def test_bitmap_has_every_key(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, 5_000)
    bits = P.bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert P.marked(bits, keys.view(np.uint64)).all() and P.marked(bits, rng.integers(1, 1 << 62, 9_999).astype(np.uint64)).mean() < 0.01
