"""Repair of role sequences by dynamic programming over a grammar (operator 13).

A conversation's rows become a sequence of symbols: what the role starts with (s, u, a or else) and
the row's fault. Edits keep, rerole or delete rows and insert turns so that the roles read
``(s?(ua)+)?``; the cheapest edits win, and of these the least audit (their initials in order).

1. Faults: identical rows of a conversation are counted first, so copies, however many, are one row;
   what was seen at an earlier turn is found by a minimum and a join.
2. Rows are put in order in ranges, and each range writes its stretches of a conversation as
   strings of at most ``STRETCH`` symbols.
3. Re-Pair over the different stretches, weighted by how often they occur: each round the most
   frequent pairs get a symbol of their own (``PAIRS`` a round, ``ROUNDS`` rounds at most, so the grammar has a fixed
   bound), until no pair occurs twice.
4. A symbol's transfer matrix holds, for each pair of states of the role automaton, the cost of the
   cheapest edits between them and their audit as a rope. A rule's matrix is the min-plus product
   of its two symbols' matrices; ropes share their parts. Rules are evaluated once, bottom-up, and
   serve all conversations: each is a row vector times the matrices of its few symbols.
5. The audit and the rows, in order, give the repaired text, hashed as it streams by.

Equally cheap audits of the same rows are never one the beginning of the other (their letters fix
their costs), so the least of a concatenation is made of the least parts, and ropes are compared
by length and hash of their parts first.

No step holds a conversation: rows pass in order, and of a conversation only its audit is in memory.
The hash needs its rows one after the other, in one task.

Defined cases: a null conv_id is a conversation of its own; null roles and texts are one space, as
are nulls in the key of the damage; rows with the same turn are in order of role, then text; rows
repeated whole are duplicates; roles count by their first character; a conversation without rows
after damage has zeros, an empty audit and the hash of the empty string; an empty table gives no
rows; other columns are ignored, whatever their names. Texts of any length count whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octofold.llm.common import discard, hot_keys, spread_join, stored, table

#: Symbols of a stretch; pairs that get a symbol in a round; rounds.
STRETCH, PAIRS, ROUNDS = 1_024, 64, 10
#: Stretches whose shortened form a worker remembers.
MEMO = 100_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Symbols: what the role starts with, in capitals if the row is truncated; blank and duplicate rows.
ROLES, GONE = "suax", "d"
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a; next state by initial.
STATES, FINAL = range(4), (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PRIME, BASE = (1 << 89) - 1, 0x1F3D5B79A2C4E6F08

#: (length, hash, left, right), or (length, hash, letters, None).
Rope = tuple


def leaf(letters: str) -> Rope:
    h = 0
    for c in letters:
        h = (h * BASE + ord(c)) % PRIME
    return len(letters), h, letters, None


def rope(x: Rope, y: Rope) -> Rope:
    """x, then y."""
    if not x[0]:
        return y
    if not y[0]:
        return x
    if x[3] is None and y[3] is None and x[0] + y[0] <= 32:
        return leaf(x[2] + y[2])
    return x[0] + y[0], (x[1] * pow(BASE, y[0], PRIME) + y[1]) % PRIME, x, y


def before(x: Rope, y: Rope) -> bool:
    """Whether x comes before y in ASCII order: equal parts at equal places are passed over whole."""
    one, two = [x], [y]
    while one and two:
        a, b = one.pop(), two.pop()
        if a is b or a[:2] == b[:2]:
            continue
        if a[3] is None and b[3] is None:
            n = min(a[0], b[0])
            if a[2][:n] != b[2][:n]:
                return a[2] < b[2]
            for rest, side in ((a[2][n:], one), (b[2][n:], two)):
                if rest:
                    side.append(leaf(rest))
        elif b[3] is None or (a[3] is not None and a[0] >= b[0]):
            one += [a[3], a[2]]
            two.append(b)
        else:
            two += [b[3], b[2]]
            one.append(a)
    return bool(two) and not one


def letters(x: Rope) -> str:
    out, todo = [], [x]
    while todo:
        a = todo.pop()
        if a[3] is None:
            out.append(a[2])
        else:
            todo += [a[3], a[2]]
    return "".join(out)


#: A matrix: the cheapest (cost, audit) from state to state; no entry where there is no way.
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def least(found: dict, key, cost: int, audit: Rope) -> None:
    old = found.get(key)
    if old is None or cost < old[0] or (cost == old[0] and before(audit, old[1])):
        found[key] = (cost, audit)


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (c, a) in x.items():
        for (m, j), (d, b) in y.items():
            if k == m:
                least(out, (i, j), c + d, rope(a, b))
    return out


def inserts() -> Matrix:
    """No, one or two inserted turns: more would come back to a state at a cost."""
    out: Matrix = {(i, i): (0, leaf("")) for i in STATES}
    step: Matrix = {(i, j): (INSERT, leaf("I")) for (i, role), j in NEXT.items() if role != "s"}
    for way in (step, product(step, step)):
        for key, (cost, audit) in way.items():
            least(out, key, cost, audit)
    return out


INSERTS = inserts()


def of_symbol(symbol: str) -> Matrix:
    """Inserted turns, then what is done with the row."""
    out: Matrix = {}
    for i in STATES:
        least(out, (i, i), DELETE, leaf("D"))
    if symbol != GONE:
        fine = TRUNCATED if symbol.isupper() else 0
        for (i, role), j in NEXT.items():
            if role == symbol.lower():
                least(out, (i, j), KEEP + fine, leaf("K"))
            if role != "s":
                least(out, (i, j), REROLE + fine, leaf("R"))
    return product(INSERTS, out)


class Grammar:
    """Re-Pair rules, in order: each is a symbol for a pair of earlier symbols."""

    FIRST = 0x4E00

    def __init__(self, pairs: list[str] | None = None):
        self.pairs = list(pairs or [])

    def shortened(self, text: str) -> str:
        for k, pair in enumerate(self.pairs):
            if len(text) > 1 and pair in text:
                text = text.replace(pair, chr(self.FIRST + k))
        return text

    def matrices(self) -> dict[str, Matrix]:
        """Of each symbol, bottom-up."""
        out = {c: of_symbol(c) for c in (*ROLES, *ROLES.upper(), GONE)}
        for k, (a, b) in enumerate(self.pairs):
            out[chr(self.FIRST + k)] = product(out[a], out[b])
        return out


class Repair:
    """The cheapest edits of one conversation, fed in stretches."""

    def __init__(self, matrices: dict[str, Matrix]):
        self.matrices = matrices
        self.at: dict[int, tuple[int, Rope]] = {0: (0, leaf(""))}

    def feed(self, symbols: str) -> None:
        for c in symbols:
            out: dict[int, tuple[int, Rope]] = {}
            for (i, j), (d, b) in self.matrices[c].items():
                if i in self.at:
                    least(out, j, self.at[i][0] + d, rope(self.at[i][1], b))
            self.at = out

    def result(self) -> tuple[int, str]:
        out: dict[str, tuple[int, Rope]] = {}
        for (i, j), (d, b) in INSERTS.items():
            if i in self.at and j in FINAL:
                least(out, "", self.at[i][0] + d, rope(self.at[i][1], b))
        cost, audit = out[""]
        return cost, letters(audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows that are left after damage."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.encode(key, "utf-8")) % 20).alias("kind"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long")
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


WHITE = " \t\n\x0b\x0c\r"


def different(rows: DataFrame) -> DataFrame:
    """Each different row once, with n copies, a digest of what is said in which conversation, and
    the text's last character that is not white space."""
    said = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    return same.withColumn("said", said).withColumn("last", F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1)))


def with_faults(same: DataFrame) -> DataFrame:
    """The rows of ``different`` with the fault of each (of its first copy) and its symbol. A null
    turn comes before all others."""
    first = same.groupBy("said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    joined = spread_join(same, first, "said", ["turn"], hot_keys(same, "said"))
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("last") == "", "blank").when(again, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("none")
    start = F.left("role", F.lit(1))
    kind = F.when(start.isin(*"sua"), start).otherwise(F.lit("x"))
    out = joined.withColumn("fault", fault)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE)).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    return out.select("conv_id", "turn", "role", "text", "n", "fault", symbol.alias("symbol"), start.alias("start"))


def counted(rows: DataFrame) -> DataFrame:
    """Gaps and faults of each conversation with rows."""
    later = F.when(F.col("fault") == "blank", F.lit(0)).otherwise(F.col("n") - 1)
    turns = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(later + F.when(F.col("fault") == "duplicate", 1).otherwise(0)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))


def stretches(rows: DataFrame) -> DataFrame:
    """conv_id, part and seq (their order), symbols of at most STRETCH rows, how many adjacent pairs
    of roles in it are illegal, and the first and last initial."""
    legal = frozenset(("su", "ua", "au"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, seq = TaskContext.get().partitionId(), [], 0
        conv, held, illegal, first, last = None, [], 0, None, None

        def end() -> None:
            nonlocal held, illegal, first, last, seq
            if held:
                out.append((conv, part, seq, "".join(held), illegal, first, last))
                seq += 1
            held, illegal, first, last = [], 0, None, None

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", "part", "seq", "symbols", "illegal", "first", "last"])
            out.clear()
            return got

        for batch in batches:
            for c, symbol, start, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if c != conv:
                    end()
                    conv = c
                while n:
                    if len(held) == STRETCH:
                        end()
                    if held:
                        illegal += last + start not in legal
                    if first is None:
                        first = start
                    last = start
                    held.append(symbol)
                    symbol, n = GONE, n - 1
                if len(out) >= STRETCH:
                    yield batch_of()
        end()
        yield batch_of()

    spark = rows.sparkSession
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    # ranges end between beginnings of texts: Spark samples the keys at the driver
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    return dealt.select("conv_id", "symbol", "start", "n").mapInArrow(run, "conv_id long, part int, seq long, symbols string, illegal long, first string, last string")


def pair_counts(texts: DataFrame, grammar: Grammar) -> DataFrame:
    """How often each pair of symbols occurs in the shortened texts (texts, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                short = grammar.shortened(text)
                for pair, n in Counter(map("".join, zip(short, short[1:]))).items():
                    found[pair] += times * (n if pair[0] != pair[1] else max(1, n // 2))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["pair", "n"])

    return texts.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame) -> Grammar:
    """Re-Pair over all different texts: PAIRS rules a round at most reach the driver."""
    grammar = Grammar()
    for _ in range(ROUNDS):
        best = pair_counts(texts, grammar).where("n > 1").orderBy(F.desc("n"), "pair").limit(PAIRS).collect()
        if not best:
            break
        grammar = Grammar(grammar.pairs + [r["pair"] for r in best])
    return grammar


def solved(parts: DataFrame, grammar: Grammar) -> DataFrame:
    """conv_id, illegal, cost and audit of every conversation with rows."""
    sent = parts.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = sent.value
        matrices, shortened = rules.matrices(), lru_cache(MEMO)(rules.shortened)
        alone = lru_cache(MEMO)(lambda symbols: whole([symbols]))

        def whole(texts: Iterator[str]) -> tuple[int, str]:
            repair = Repair(matrices)
            for text in texts:
                repair.feed(shortened(text))
            return repair.result()

        out: list[tuple] = []
        conv, repair, only, illegal, last = None, None, None, 0, None

        def end() -> None:
            if only is not None or repair is not None:
                out.append((conv, illegal, *(alone(only) if repair is None else repair.result())))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 4
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "illegal", "cost", "audit"])
            out.clear()
            return got

        for batch in batches:
            for c, symbols, bad, first, final in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if c != conv or only is None and repair is None:
                    end()
                    conv, repair, only, illegal = c, None, symbols, bad
                else:  # a further stretch
                    if repair is None:
                        repair = Repair(matrices)
                        repair.feed(shortened(only))
                        only = None
                    repair.feed(shortened(symbols))
                    illegal += bad + (last + first not in ("su", "ua", "au"))
                last = final
            if out:
                yield batch_of()
        end()
        yield batch_of()

    order = [F.col("conv_id").asc_nulls_first(), "part", "seq"]
    return parts.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "symbols", "illegal", "first", "last").mapInArrow(run, "conv_id long, illegal long, cost long, audit string")


class Writer:
    """The repaired text of one conversation, piece by piece."""

    def __init__(self, audit: str, say: Callable[[str], None]):
        self.audit, self.at, self.state, self.say, self.some = audit, 0, 0, say, False

    def turn(self, role: str, text: str) -> None:
        self.state = NEXT[self.state, role[:1]]
        self.say(f"\n{role}:{text}" if self.some else f"{role}:{text}")
        self.some = True

    def wanted(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.turn(self.wanted(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        what = self.audit[self.at]
        self.at += 1
        if what == "K":
            self.turn(role, text)
        elif what == "R":
            self.turn(self.wanted(), text)


def hashed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, audit's own columns and the hash of the repaired text: of each conversation the
    audit comes first, then its rows in order."""
    head = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"), "illegal", "cost")
    body = rows.select("conv_id", "turn", "role", "text", "n", F.lit(None).cast("long").alias("illegal"), F.lit(None).cast("long").alias("cost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: tuple | None = None

        def end() -> None:
            if now is not None:
                now[1].insert()
                out.append((*now[0], now[2].hexdigest()))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", "illegal", "cost", "audit", "repaired_sha256"])
            out.clear()
            return got

        for batch in batches:
            for conv, role, text, n, illegal, cost in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if not n:
                    end()
                    sha = hashlib.sha256()
                    now = ((conv, illegal, cost, text), Writer(text, lambda piece, sha=sha: sha.update(piece.encode("utf-8", "surrogatepass"))), sha)
                for _ in range(n):
                    now[1].row(role, text)
            if out:
                yield batch_of()
        end()
        yield batch_of()

    order = [F.col("conv_id").asc_nulls_first(), F.col("cost").isNull(), F.col("turn").asc_nulls_first(), "role", "text"]
    both = head.unionByName(body).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "role", "text", "n", "illegal", "cost").mapInArrow(run, "conv_id long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``, repaired from ``rows`` (conv_id, turn, role,
    text, copies)."""
    same = stored(different(rows), "rows")
    faulty = stored(with_faults(same), "faults")
    discard(same)
    parts = stored(stretches(faulty), "stretches")
    texts = stored(parts.groupBy("symbols").agg(F.count("*").alias("times")), "texts")
    grammar = learn(texts)
    edits = stored(solved(parts, grammar), "edits")
    done = stored(hashed(faulty, edits), "repaired")
    counts = counted(faulty)
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(counts, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    out = stored(out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")), "conversations")
    for used in (faulty, parts, texts, edits, done):
        discard(used)
    return out


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(conversations, damaged(conversations))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
