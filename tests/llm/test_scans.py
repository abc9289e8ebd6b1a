"""Secret scan, personal data, quality rules and token counts."""

import base64
import hashlib
import json
import re

import duckdb
import numpy as np
from helpers import SMALL, documents, rows

from octofold.llm import pii_spans, quality_rules, secret_scan, token_count


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\x00") + b"".join(der(2, bytes([1] + [7] * k)) for k in (40, 3, 40, 20, 20, 20, 20, 20)))


def test_secrets_confirmed_by_structure(spark):
    key64 = base64.b64encode(RSA).decode()
    broken = base64.b64encode(RSA[:-9]).decode()
    jwt = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b'{"sub":1}', b"x" * 20))
    no_alg = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"typ":"JWT"}', b'{"sub":1}', b"x" * 20))
    texts = [f"a {key64} b", f"a {broken} b", f"x {jwt} y", f"x {no_alg} y", f"k {RSA.hex()} z", "-----BEGIN RSA PRIVATE KEY-----\n" + key64 + "\n-----END RSA PRIVATE KEY-----", None, "", 'É Token = "abcd12345" PASSWORD=short secret: longenough', "AKIA" + "A" * 12 + " AKIA1", "0" * 31 + " " + "0" * 32]
    got = rows(secret_scan.scan(documents(spark, texts)))
    kinds = [set(re.findall(r"(\w+):\d", got[i].spans)) for i in range(len(texts))]
    assert kinds[0] == {"key64"} and kinds[1] == set() and kinds[2] == {"jwt"} and kinds[3] == set()
    assert kinds[4] == {"hex", "keyhex"} and "pem" in kinds[5]
    empty = hashlib.sha256(b"").hexdigest()
    assert got[6].spans == got[7].spans == "" and got[6].base_sha256 == got[7].base_sha256 == empty
    assert got[8].n_assign == 2 and got[8].spans == "assign:2:20,assign:37:55"
    assert got[9].n_access == 1 and got[10].n_hex == 1


def test_key_blocks():
    """A block is a BEGIN line and the END line of its name that follows next."""
    key64 = base64.b64encode(RSA).decode()
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    whole = f"{begin}\n{key64}\n{end}"
    pem = lambda t: [(a, b) for a, k, b in secret_scan.spans_of(t) if k == "pem"]
    assert pem(f"x {whole} y {whole}") == [(2, 2 + len(whole)), (5 + len(whole), 5 + 2 * len(whole))]
    assert pem(f"{begin} x {whole}") == [(len(begin) + 3, len(begin) + 3 + len(whole))]
    assert pem(f"{begin}\n{key64}\n-----END PRIVATE KEY-----") == pem(f"{begin}\n{key64}") == pem(f"{begin}{end}") == []
    locked = base64.b64encode(bytes(range(80))).decode()
    head = "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00-11\n\n"
    assert len(pem(f"{begin}{head}{locked}\n{end}")) == 1 and pem(f"{begin}\n{locked}\n{end}") == []


def test_secret_base_equals_patterns(spark):
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet'").fetchall()] + ["x" * 300_000 + " token=abcdefgh"]
    got = rows(secret_scan.scan(documents(spark, texts)))
    for i, t in enumerate(texts):
        want = [(m.start(), "assign", m.end()) for m in secret_scan.ASSIGN.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        assert got[i].base_sha256 == hashlib.sha256(secret_scan.joined(want, secret_scan.KINDS).encode()).hexdigest()


def brute_pii(t):
    digits = pii_spans.only_digits
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii_spans.luhn(digits(m[0]))]
    return out + [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_personal_base_spans():
    rng = np.random.RandomState(0)
    for _ in range(20_000):
        t = "".join(rng.choice(list("a.@1+ -()2b0%"), rng.randint(0, 40)))
        assert brute_pii(t) == pii_spans.base_spans(t)
    assert pii_spans.base_spans("1" * 200_000 + "a." * 100_000 + "@") == []


def model():
    texts = []
    for i in range(60):
        for t in (f"word +1 ({200 + i}) 555-{1000 + i} next", f"some u{i}.{i % 9}@mail{i % 7}.example.com end", f"from {i}.2.{i}.4 at", f"on day {i} of 2024-0{1 + i % 9}-11 token{i}", "pay 4796348678214084 now" if i % 2 else "pay 4539578763621486 now"):
            texts.append((t, pii_spans.base_spans(t)))
    return pii_spans.SemiMarkov().fit(texts, epochs=6)


def test_model_splits_what_the_patterns_run_together(spark):
    m = model()
    text = "word +1 (208) 555-1177 4539578763621486 next"
    assert pii_spans.base_spans(text) == []
    got = rows(pii_spans.digest(documents(spark, [text, None, "", "plain words only", "a@b.co x"]), m))
    assert got[0].spans == "phone:5:22,card:23:39"
    assert got[1].spans == got[2].spans == got[3].spans == "" and got[4].spans == "email:0:6"
    masked = rows(pii_spans.redact(documents(spark, [text, None, "plain"]), m))
    assert masked[0].text == "word <PHONE> <CARD> next" and masked[0].n_chars == len(masked[0].text)
    assert masked[1].text is None and masked[2].text == "plain"


def test_marginals_are_probabilities_and_viterbi_is_best():
    rng = np.random.RandomState(4)
    segments = [(i, j) for i in range(6) for j in range(i + 1, min(7, i + 4))]
    scores = rng.randn(len(segments), 4)
    value = {6: [(0.0, [])]}
    for i in range(5, -1, -1):  # all segmentations, by brute force
        value[i] = list(value[i + 1])
        for k, (a, b) in enumerate(segments):
            if a == i:
                value[i] += [(v + scores[k, y], [(k, y), *p]) for v, p in value[b] for y in range(4)]
    z = sum(np.exp(v) for v, _ in value[0])
    best = max(value[0], key=lambda x: x[0])
    marg = pii_spans.SemiMarkov.marginals(6, segments, scores)
    for k in range(len(segments)):
        for y in range(4):
            assert abs(marg[k, y] - sum(np.exp(v) for v, p in value[0] if (k, y) in p) / z) < 1e-9
    assert pii_spans.SemiMarkov.best(6, segments, scores) == sorted(best[1], key=lambda x: segments[x[0]])


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, x in enumerate(win) if win.count(x) > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_features(spark):
    texts = [None, "", " \n\t", "a b c a b c", "x y\nx y\n\nx y", "a b c #*$ é|<>", "a a a a a", "p q r s p q r s p"]
    texts += [r[0][:3000] for r in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet' LIMIT 40").fetchall()]
    got = rows(quality_rules.measure(documents(spark, texts)))
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute_quality(t)


def test_certified_cutoffs():
    bound = quality_rules.upper_bound
    assert abs(bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-12 and bound(5, 5, 0.05) == 1.0
    assert abs(bound(3, 50, 0.05) - 0.1484) < 1e-3  # a published table's value, to three places


def test_quality_learns_and_survives_odd_labels(spark):
    good = [(i, 100, 500, 0, 0, 0, 5) for i in range(2000)]
    bad = [(i, 100, 500, 150, 0, 0, 5) for i in range(2000, 2200)]
    measured = spark.createDataFrame(good + bad, "doc_id long, " + quality_rules.FEATURES)
    labels = spark.createDataFrame([(i, 1 if i < 2000 else 0, 0) for i in range(2200)] + [(None, 1, 0), (5, None, 0), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    kept = rows(quality_rules.apply(measured, quality_rules.learn(measured, labels)))
    assert all(kept[i].kept for i in range(2000)) and not any(kept[i].kept for i in range(2000, 2200))
    assert quality_rules.learn(measured, labels.limit(0)) == {}


def test_tokens_equal_the_library(spark):
    path = token_count.tokenizer_path()
    library = token_count.PreTokens(path).library
    odd = [None, "", "  \n", "It's Ünïcode's ²½ test_x", "日本 é ﬁ İ", "a<|endoftext|>b<|startoftext|>", "<|end", " x​", "don'LL", "x" * 50_000]
    texts = odd + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet' LIMIT 60").fetchall()]
    ids = list(range(len(texts) - 1)) + [0]  # a repeated id keeps a row of its own
    got = token_count.count_tokens(documents(spark, texts, ids), path).collect()
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(ids, texts))
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_count.count_tokens(documents(spark, texts).limit(0), path).count() == 0


def test_simple_characters_split_as_the_library():
    rules = token_count.PreTokens(token_count.tokenizer_path())
    for cp in [*range(0x250), *range(0x2000, 0x2070)]:
        for t in (chr(cp), f"a{chr(cp)}b", f"1{chr(cp)}2"):
            found, n = rules.counts(t)
            assert n + sum(k * rules.pieces(w) for w, k in found.items()) == len(rules.library.encode(t, add_special_tokens=False).ids)
