"""Small groups beside groups larger than what is left of a quota."""

from collections import defaultdict

import numpy as np
from helpers import documents

from octofold.llm import balanced_shards


def test_small_groups_pass_large_ones(spark):
    rng = np.random.RandomState(4)
    sizes = [1000] + [300] * 4 + [60] * 10 + [int(n) for n in rng.randint(2, 12, 850)]
    texts = [f"group {i}" for i, n in enumerate(sizes) for _ in range(n)]
    texts += [f"own {i}" for i in range(20_000 - len(texts))]
    ids = rng.permutation(len(texts)).tolist()
    at = dict(zip(ids, texts))
    shards = defaultdict(set)
    for r in balanced_shards.assign(documents(spark, texts, ids)).select("doc_id", "shard").collect():
        shards[at[r.doc_id]].add(r.shard)
    cut = sum(len(shards[f"group {i}"]) > 1 for i, n in enumerate(sizes) if n < 12)
    assert cut <= 40
