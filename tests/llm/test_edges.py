"""All registered queries on tables of odd rows, and on empty ones: nulls in any column, empty and
very long texts, ties, rows repeated whole, and other columns with names that the operators use."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from helpers import save
from test_scans import brute_pii

from octofold.llm import pii_spans, registry, spm_codec

LONG = "lorem ipsum dolor sit amet " * 8_000
PLAIN = " ".join(f"word{k} of the text" for k in range(40))
ITEM = "seven purple foxes quietly rearranged nineteen brass clocks under the frozen harbour bridge tonight"
TEXTS = {
    0: None,
    1: "",
    2: " \n\t ",
    3: "a",
    4: PLAIN,
    5: PLAIN,
    6: PLAIN + " end",
    7: LONG,
    8: "x" * 250_000,
    9: "mail jane.doe@mail.example.com, +1 (208) 555-1177, 10.0.0.1, 4111 1111 1111 1111 @ " + "1" * 30_000,
    10: "token = abcdefgh12 AKIA" + "A" * 20 + " " + "0" * 64 + " -----BEGIN PRIVATE KEY----- x " + "=" * 20_000,
    11: "😀 é ퟿ ﷽ " * 50,
    12: "line\nline\nline\n" * 30,
    13: "12345 !!! 67890",
    14: f"{PLAIN[:200]} {ITEM} {PLAIN[200:]}",
    15: "( + - . , ; ) " * 2_000,
}
CLASHING = "score spans n_tokens shard slot key rank lang_pred kept component_id grp bin sign digest passage n row words held_out path ids".split()
EMPTY = hashlib.sha256(b"").hexdigest()


def tables(folder, rows):
    ids = [i for i, _ in rows]
    documents = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "lang": pa.array([None if i is None or i % 4 == 0 else "en" for i in ids], pa.string()), "source": pa.array([None] * len(rows), pa.string()), "n_chars": pa.array([None if t is None else len(t) for _, t in rows], pa.int64())}
    documents |= {c: pa.array(["x"] * len(rows), pa.string()) for c in CLASHING}
    n = 1 if rows else 0
    pages = [("u", f"<article><p>{PLAIN}</p></article>"), (None, None), ("u", ""), ("u", f"<p>{LONG}</p>"), ("u", f"<article><p>{PLAIN}</p></article>")] if rows else []
    return save(
        folder,
        documents=documents,
        benchmark={"item_id": pa.array([1, 1, 2, None, 3] * n, pa.int64()), "text": pa.array([ITEM, ITEM, None, "", "one"] * n, pa.string()), "score": pa.array(["x"] * 5 * n, pa.string())},
        labels={"doc_id": pa.array([4, None, 99, 4, 6] * n, pa.int64()), "quality": pa.array([1, 0, 1, None, 0] * n, pa.int32()), "toxic": pa.array([0, 0, None, 1, 0] * n, pa.int32()), "n_words": pa.array(["x"] * 5 * n, pa.string())},
        pages={"page_id": pa.array([0, None, 2, 3, 0] * n, pa.int64()), "url": pa.array([p[0] for p in pages], pa.string()), "html": pa.array([p[1] for p in pages], pa.string()), "text": pa.array(["x"] * len(pages), pa.string())},
        embeddings={"vec_id": pa.array([0, None, 20, 20, 1] * n, pa.int64()), "embedding": pa.array([[1.0, 2.0], [1.0, 1.0], None, [0.5, None], [3.0, 1.0]] * n, pa.list_(pa.float32())), "rank": pa.array(["x"] * 5 * n, pa.string())},
        conversations={"conv_id": pa.array([1, 1, None, 2, 1] * n, pa.int64()), "turn": pa.array([0, 1, 0, None, 0] * n, pa.int64()), "role": pa.array(["user", "assistant", None, "user", "user"] * n, pa.string()), "text": pa.array(["Hi.", "Yes.", None, LONG, "Hi."] * n, pa.string()), "cost": pa.array(["x"] * 5 * n, pa.string())},
    )


#: Rows, one repeated whole, one without an id.
ROWS = [*TEXTS.items(), (4, PLAIN), (None, PLAIN + " more")]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="module")
def none(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("none"), [])


def result(spark, name, folder):
    call = next(c for n, c in registry.queries().items() if n.startswith(f"op{name}_"))
    out = call(spark, folder).collect()
    if name not in (2, 3):
        assert Counter(r.doc_id for r in out) == Counter(i for i, _ in ROWS)
    return out


def unique(out):
    """By id; the row that is repeated whole must have one result."""
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add(tuple(map(str, r)))
    assert all(len(v) == 1 for v in by.values())
    return {r.doc_id: r for r in out}


def test_personal_data(spark, odd):
    got = unique(result(spark, 1, odd))
    for i, t in ROWS:
        base = brute_pii(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii_spans.joined(base).encode()).hexdigest()
        assert set(pii_spans.joined(base).split(",")) <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x[1] == k for x in base) for k in pii_spans.KINDS]


def test_pages(spark, odd):
    got = result(spark, 2, odd)
    assert len(got) == 5 and Counter(r.text for r in got)[""] == 2
    assert [r.text for r in got if r.page_id == 0] == [PLAIN] * 2 and all(r.n_chars == len(r.text) for r in got)


def test_leaks(spark, odd):
    got = result(spark, 3, odd)
    assert [(r.doc_id, r.item_id) for r in got if r.item_id == 1] == [(14, 1)]
    assert {r.item_id for r in got} <= {1, 3}


def test_near_duplicates(spark, odd):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    got = unique(result(spark, 4, odd))
    assert all(got[i].n_shingles == len(shingles(t)) for i, t in ROWS)
    sets = {i: shingles(t) for i, t in TEXTS.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) > 0:
                    root[a] = root[b] = min(root[a], root[b])
    assert root[5] == root[6] == 4 and {i: r.component_id for i, r in got.items() if i is not None} == root
    assert all(r.kept == (r.component_id == i) for i, r in got.items() if i is not None)
    assert got[None].component_id is None and got[None].kept


def test_tokens(spark, odd):
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = unique(result(spark, 5, odd))
    for i, t in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)


def test_quality(spark, odd):
    got = unique(result(spark, 6, odd))
    for i, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        count = Counter(zip(w, w[1:], w[2:]))
        inside = {k + j for k in range(len(w) - 2) if count[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_languages(spark, odd):
    got = unique(result(spark, 7, odd))
    assert all(got[i].lang_pred == "und" for i in (0, 1, 2, 13, 15)) and got[4].lang_pred == got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out


def test_secrets(spark, odd):
    got = unique(result(spark, 8, odd))
    for i, t in ROWS:
        found = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.I | re.A) if len(m[2]) >= 8]
        found += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        found += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 32]
        text = ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(found, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1]))))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in found) for k in ("assign", "access", "hex"))
    assert got[0].spans == "" and got[0].base_sha256 == EMPTY


def test_shards(spark, odd):
    got = result(spark, 9, odd)
    sizes, slots = Counter(r.shard for r in got), defaultdict(set)
    for r in got:
        slots[r.shard].add(r.slot)
        assert 0 <= r.shard < 16 and r.law == "rows" and r.grown_shard is None
    assert max(sizes.values()) <= 2 and all(slots[s] == set(range(n)) for s, n in sizes.items())
    assert {r.doc_id: r.size for r in got}[0] == 1


def test_codec(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=spm_codec.model_path())
    got = unique(result(spark, 10, odd))
    assert all(got[i].n_ids == len(library.encode(t or "")) and got[i].lossless for i, t in ROWS)


def test_phrases(spark, odd):
    from test_phrases import plain

    langs = {i: None if i is None or i % 4 == 0 else "en" for i, _ in ROWS}
    call = registry.queries()["op11_phrase_stripes"]
    assert sorted(map(tuple, call(spark, odd).collect())) == plain([(langs[i], t) for i, t in ROWS], 100)


def test_vectors(spark, odd):
    got = registry.queries()["op12_vector_search"](spark, odd).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 5.0)]


def test_conversations(spark, odd):
    from test_conversations import plain, result

    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (None, 0, None, None), (2, None, "user", LONG), (1, 0, "user", "Hi.")]
    assert result(registry.queries()["op13_conversation_repair"](spark, odd)) == plain(rows)


def test_pipeline(spark, odd, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    out = pipeline.run(spark, odd).collect()
    assert [x.split("-")[1] for x in set(os.listdir(shared)) - before if x.startswith("octofold-")] == ["personal_data"]
    assert {r.doc_id for r in out} == {3, 4, 7, 8, 9, 10, 11, 12, None} and all(r.lossless for r in out)
    assert pipeline.run(spark, none).count() == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, none, name):
    assert registry.queries()[name](spark, none).count() == 0
