"""Near duplicates, decontamination, sharding and the pipeline against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, SMALL, documents, rows, save
from pyspark.sql import functions as F

from octofold.llm import balanced_shards, components, decontaminate, near_dups, shingles


def shingle_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(ids, texts, percent):
    sets, root = shingle_sets(texts), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def copies(rng, words, n, most):
    """Copies of one text with up to ``most`` words replaced."""
    base = rng.choice(words, 150).tolist()
    out = []
    for _ in range(n):
        t = list(base)
        for at in rng.choice(150, rng.randint(0, most + 1), replace=False):
            t[at] = f"new{rng.randint(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 16)  # several blocks already at this size
    rng = np.random.RandomState(7)
    words = [f"w{i}" for i in range(400)]
    texts = copies(rng, words, 120, 6) + copies(rng, words, 20, 2) + [" ".join(rng.choice(words, rng.randint(1, 80))) for _ in range(60)]
    texts += [None, "", " \n", "one", "One", "one two three four", "ONE two three four", texts[0], texts[0].upper(), "x " * 4000]
    ids = [int(i) for i in rng.permutation(5000)[: len(texts)]]
    docs = documents(spark, texts, ids).withColumns({"digest": F.lit(1), "keys": F.lit("k"), "kept": F.lit(0)})
    got = rows(near_dups.near_duplicates(docs, percent))
    want = brute_components(ids, texts, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_duplicates_of_odd_tables(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    text = "a b c d e f g"
    out = near_dups.near_duplicates(documents(spark, [text, text, text, None], [3, 3, None, None])).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in out) == {(3, 3, True): 2, (None, None, True): 2}


def test_shingle_hashes_follow_the_words():
    a, b = "x y\tz  w v u", "X Y z w\nV u"
    assert (shingles.shingle_set(a) == shingles.shingle_set(b)).all() and len(shingles.shingle_set(a)) == 2
    assert len(shingles.shingle_set("a b")) == 1 and len(shingles.shingle_set(None)) == 0
    assert (shingles.word_hashes("long " * 3 + "y" * 200_000)[:3] == shingles.word_hashes("long")).all()


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(500, 400), (400, 450), (7, 7)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 300)}, 500: 400, 450: 400}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def smith_waterman(item, passage):
    h, best = np.zeros((len(item) + 1, len(passage) + 1), int), 0
    for i, x in enumerate(item):
        for j, y in enumerate(passage):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
            best = max(best, h[i + 1, j + 1])
    return best


def test_alignment_values():
    rng = np.random.RandomState(2)
    for _ in range(200):
        a, b = rng.randint(0, 4, rng.randint(1, 12)), rng.randint(0, 4, rng.randint(1, 20))
        assert decontaminate.align(a, b)[0] == smith_waterman(a, b)


def test_leaks(spark):
    rng = np.random.RandomState(3)
    words = [f"t{i}" for i in range(3000)]
    items = [rng.choice(words, 40).tolist() for _ in range(30)]
    texts, want = [], set()
    for d in range(120):
        t = rng.choice(words, 200).tolist()
        if d % 3 == 0:
            k, x = d % 30, list(items[d % 30])
            for at in rng.choice(40, 6 if d % 2 else 0, replace=False):
                x[at] = "edited"
            t[50:50] = [w.upper() + "," for w in x]
            want.add((d, k))
        texts.append(" ".join(t))
    texts += [None, "", "!!", " ".join(items[4]), " ".join(items[4])]
    ids = [*range(123), 123, 123]
    want.add((123, 4))
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "so"), (4, " ".join(items[4]))]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    docs = documents(spark, texts, ids).withColumns({"start": F.lit(1), "words": F.lit("x"), "score": F.lit(2)})
    got = rows(decontaminate.leaks(docs, bench).withColumn("k", F.struct("doc_id", "item_id")), "k")
    assert {(k.doc_id, k.item_id) for k in got} == want
    assert got[[k for k in got if k.doc_id == 0][0]].score == 1.0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_seeds_of_many_copies_stay_rare(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = documents(spark, [f"filler number {i} " + item for i in range(300)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.leaks(docs, bench).count() == 300


def test_shards(spark):
    rng = np.random.RandomState(5)
    texts = ["hot"] * 200 + [f"pair {i // 3}" for i in range(150)] + [f"own {i} " + "x" * int(rng.randint(0, 99)) for i in range(270)] + [None, "", None]
    ids = [*range(len(texts) - 2), 5, None]
    out = balanced_shards.assign(documents(spark, texts, ids).withColumn("shard", F.lit("mine"))).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == len(texts) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(16))
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = defaultdict(set)
    for r in out:
        if r.doc_id is not None and 200 <= r.doc_id < 350:
            by[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) <= 0.1 * len(by)
    assert sorted(r.size for r in out if r.size <= 1) == [1, 1, 1]


@pytest.mark.parametrize("n", [0, 1, 5, 16, 33])
def test_shards_of_small_tables(spark, n):
    out = balanced_shards.assign(documents(spark, [f"t{i % 3}" for i in range(n)]) if n else spark.createDataFrame([], DOCS)).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == n and (not n or max(counts.values()) - (min(counts.values()) if len(counts) == 16 else 0) <= 1)


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.RandomState(8)
    en = "the of and to in that is was for with his they this have from".split() + [f"word{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(rng.choice(en, 80)) for _ in range(60)]
    item = " ".join(rng.choice(en, 40)) + " unlike seventeen purple"
    texts += [texts[3], texts[4].replace("the", "the", 1) + " tail", "123 456", None, texts[5][:200] + " " + item, " ".join(rng.choice(en, 80)) + " mail me at jane.doe@mail.example.com or +1 (208) 555-1177"]
    n = len(texts)
    sf = save(tmp_path, documents={"doc_id": list(range(n)), "text": texts, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": [len(t or "") for t in texts]}, benchmark={"item_id": [1], "text": [item]})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_leaks", "personal_data", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, sf)
        assert docs.columns == columns
    out = rows(corpus_pipeline.run(spark, sf))
    assert set(out) == set(range(60)) | {65} and all(r.lossless for r in out.values())
    assert "<EMAIL>" in rows(docs)[65].text and "<PHONE>" in rows(docs)[65].text
    assert SMALL
