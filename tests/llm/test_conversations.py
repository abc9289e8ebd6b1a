"""Conversation repair against a plain version: damage, faults, cheapest and least edits, texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
from helpers import SMALL, save

from octofold.llm import conversation_repair as C

WHITE = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """(cost, audit) for (role, forced, truncated) rows: all ways, by position and state of the role pattern, with whole strings."""
    best = {0: (0, "")}

    def offer(to, state, value):
        if state not in to or value < to[state]:
            to[state] = value

    def insert(now):
        for _ in range(2):
            for state, (c, a) in list(now.items()):
                for role in "ua":
                    if (state, role) in C.NEXT:
                        offer(now, C.NEXT[state, role], (c + 2, a + "I"))

    for role, forced, truncated in rows:
        insert(best)
        after = {}
        for state, (c, a) in best.items():
            offer(after, state, (c + 3, a + "D"))
            if not forced:
                if (state, role) in C.NEXT:
                    offer(after, C.NEXT[state, role], (c + truncated, a + "K"))
                for new in "ua":
                    if (state, new) in C.NEXT:
                        offer(after, C.NEXT[state, new], (c + 2 + truncated, a + "R"))
        best = after
    insert(best)
    return min(best[s] for s in (0, 3) if s in best)


def plain(table):
    """Rows of (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        kept = convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {r[0] for r in rows if r[0] is not None}
        count, seen, marks = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in rows:
            solid = text.rstrip(WHITE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = plain_edits(marks)
        pieces, at, state = [], 0, 0
        for edit in audit:
            role, text = None, ""
            if edit != "I":
                _, role, text = rows[at]
                at += 1
            if edit == "D":
                continue
            role = role if edit == "K" else "assistant" if state == 2 else "user"
            state = C.NEXT[state, role[0]]
            pieces.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(pieces).encode()).hexdigest())
    return out


def result(df):
    got = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(out) == len(got)
    return out


def every_way(rows):
    """All edit sequences with at most two inserted turns at a place."""
    pattern = re.compile(r"(s?(ua)+)?")
    found = []
    for edits in itertools.product(*[["D"] if forced else ["D", "K", "u", "a"] for _, forced, _ in rows]):
        for places in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            roles, audit, cost = places[0], "I" * len(places[0]), 0
            for (role, _, truncated), e, more in zip(rows, edits, places[1:]):
                roles += ("" if e == "D" else role if e == "K" else e) + more
                audit += (e if e in "DK" else "R") + "I" * len(more)
                cost += 3 if e == "D" else truncated + (2 if e != "K" else 0)
            if pattern.fullmatch(roles):
                found.append((cost + 2 * audit.count("I"), audit))
    return min(found)


def test_plain_version_is_every_way():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3):
        rows = [(rng.choice("suaxt"), rng.random() < 0.2, int(rng.random() < 0.3)) for _ in range(n)]
        assert plain_edits(rows) == every_way(rows)


def test_grammar_and_ropes():
    """Rules, whatever they are, do not change results; also where all symbols are the same."""
    rng = random.Random(2)
    rows = [[(rng.choice("suax"), rng.random() < 0.15, int(rng.random() < 0.2)) for _ in range(n)] for n in (1, 5, 40, 300)] + [[("u", False, 0)] * 200, [("x", True, 0)] * 150, [("a", False, 1), ("u", False, 0)] * 90]
    texts = ["".join("d" if forced else r.upper() if t else r for r, forced, t in row) for row in rows]
    for pairs in ([], ["ua", "au", chr(C.Grammar.FIRST) * 2, chr(C.Grammar.FIRST + 2) * 2, "uu", chr(C.Grammar.FIRST + 4) * 2, "dd", chr(C.Grammar.FIRST + 6) * 2]):
        grammar = C.Grammar(pairs)
        matrices = grammar.matrices()
        for row, text in zip(rows, texts):
            repair = C.Repair(matrices)
            repair.feed(grammar.shortened(text))
            assert repair.result() == plain_edits(row)
    one, two = C.leaf("KD"), C.leaf("KR")
    assert C.before(C.rope(one, two), C.rope(two, one)) and not C.before(one, one) and C.before(one, C.rope(one, two)) and not C.before(C.rope(one, two), one)


def test_small_table(spark):
    cols = pq.read_table(f"{SMALL}/conversations.parquet").to_pydict()
    assert result(C.op13_conversation_repair(spark, SMALL)) == plain(zip(cols["conv_id"], cols["turn"], cols["role"], cols["text"]))


def test_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \n", "yes.", "no", "Why? ", "same.", "same.", "é…", "a\nb!", "x" * 40_000]
    roles = ["user", "assistant", "system", "tool", None, "", "u"]
    rows = [(rng.choice([*range(60), None]), rng.choice([*range(-2, 8), None]), rng.choice(roles), rng.choice(texts)) for _ in range(700)]
    rows += [(900, t, "user" if t % 2 else "assistant", f"turn {t}" + "." * (t % 3)) for t in range(5_000)]  # several stretches
    rows += [(901, 7, "user", "again.")] * 3_000 + [(902, t, "assistant", "again.") for t in range(2_500)] + [(903, 0, "user", None), (904, None, None, None)]
    kinds = {k: next(c for c in range(1_000, 2_000) if zlib.crc32(f"{c}:0".encode()) % 20 == k) for k in range(5)}
    rows += [(c, 0, "assistant", "One. Two!") for c in kinds.values()]
    cols = list(zip(*rows))
    table = {"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()), "role": pa.array(cols[2], pa.string()), "text": pa.array(cols[3], pa.string())}
    table |= {c: pa.array(["x"] * len(rows)) for c in ("n", "fault", "audit", "symbol", "cost", "id", "part")}
    got = result(C.op13_conversation_repair(spark, save(tmp_path, conversations=table)))
    assert got == plain(rows)
    assert got[kinds[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_rounds_of_pairs(spark):
    """The grammar comes from all stretches: a long repeated sequence becomes few symbols."""
    texts = spark.createDataFrame([("ua" * 256, 3), ("sua", 2), ("dud", 1)], "symbols string, times long")
    grammar = C.learn(texts)
    assert len(grammar.shortened("ua" * 256)) <= 4 and grammar.pairs[0] in ("au", "ua")
