"""Nearest neighbours by randomly rotated one-bit codes (operator 12).

1. A few hundred centroids at most are fitted on a bounded sample. Each vector v goes to the cell of
   its nearest centroid c; its residual v - c is rotated at random into ``BITS`` dimensions, and the
   signs of the rotated coordinates, packed, are its code. Every row is indexed.
2. Correction scalars: with o the residual's direction and s the code as a unit vector, <s, o> is
   known exactly, and <s, q> / <s, o> estimates <o, q> without bias. Its error is a random
   direction's share of a vector of length sqrt(1 - <s, o> ** 2) / <s, o>, so ``SIGMAS``
   standard errors of it bound the inner product from above.
3. Queries and candidates meet as blocks of bounded size. A task walks through its candidates
   cell by cell, estimates inner products from codes, and computes the exact one only where the
   bound reaches the query's k-th best so far; cells whose radius rules them out are passed over.
4. Each query's best of all blocks are merged and the first k kept. A block reports its k best, so
   nothing is lost between blocks.

Scores are sums of products in double precision, component by component from the first, so equal
vectors have equal scores wherever they are computed. A neighbour is missed only if its estimate
errs by more than ``SIGMAS`` standard errors downwards.

Defined cases: vectors that are null, empty or zero, that hold a null or a non-finite component, or
whose length is not the most frequent one (the larger of two) take no part, nor do rows with a null
vec_id. Rows with one vec_id count once, with the least vector. With fewer candidates than k all are returned; an empty
table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octofold.llm.common import discard, stored, table

#: Bits of a code, and standard errors that an estimate may be too low.
BITS, SIGMAS = 256, 4.0
#: Vectors that the centroids are fitted on, at most about so many; cells; rounds of the fit.
SAMPLE, CELLS, FITS = 8_192, 32, 6
#: Largest blocks of queries and of candidates; candidates make so many blocks at least.
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCKS = 16_384, 65_536, 32
#: Tasks that the pairs of blocks are dealt to, at most.
TASKS = 4_096
#: Candidates whose estimates are computed at once.
TILE = 256
SEED = 12


class Codec:
    """The rotation and the centroids."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, cells: int = CELLS):
        dim = sample.shape[1]
        rng = np.random.default_rng(SEED)
        self.bits = max(bits, -(-dim // 8) * 8)
        #: Orthonormal columns: lengths and inner products are kept.
        self.rotation = np.linalg.qr(rng.standard_normal((self.bits, dim)))[0]
        unit = sample / lengths(sample)[:, None]
        cells = max(1, min(cells, len(sample) // 32))
        self.centroids = sample[np.sort(rng.permutation(len(sample))[:cells])].astype(np.float64)
        for _ in range(FITS if cells > 1 else 0):
            at = self.cell(sample)
            for c in range(cells):
                if (at == c).any():
                    self.centroids[c] = sample[at == c].mean(axis=0)
        if cells == 1:
            self.centroids = unit.mean(axis=0, keepdims=True) * float(np.median(lengths(sample)))

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest centroid of each vector."""
        apart = (self.centroids**2).sum(axis=1)[None, :] - 2 * (vectors @ self.centroids.T)
        return apart.argmin(axis=1)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, packed code, radius, correction of the estimate, and its standard error."""
        cell = self.cell(vectors)
        rest = vectors - self.centroids[cell]
        radius = lengths(rest)
        turned = (rest / np.where(radius > 0, radius, 1.0)[:, None]) @ self.rotation.T
        code = np.packbits(turned > 0, axis=1)
        along = np.where(radius > 0, np.abs(turned).sum(axis=1) / self.bits**0.5, 1.0)
        error = radius * np.sqrt(np.maximum(0.0, 1 - along**2)) / along / (self.bits - 1) ** 0.5
        return cell, code, radius, radius / along, error


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares pass the range of doubles."""
    top = np.abs(x).max(axis=1, initial=0.0)
    return top * np.sqrt(((x / np.where(top > 0, top, 1.0)[:, None]) ** 2).sum(axis=1))


def usable(embeddings: DataFrame) -> tuple[DataFrame, int, str]:
    """vec_id and vector (the components' bytes) of the rows that take part, how many components
    a vector has, and their type."""
    kind = "float" if isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    rows = embeddings.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    lasting = rows.where("forall(embedding, x -> x is not null and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    most = lasting.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim, dtype = (most["dim"] if most else 0), np.float32 if kind == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().astype(dtype, copy=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], names=["vec_id", "vector"])

    packed = lasting.where(F.size("embedding") == dim).mapInArrow(run, "vec_id long, vector binary")
    return packed.groupBy("vec_id").agg(F.min("vector").alias("vector")), dim, dtype.__name__


def matrix(column: pa.ChunkedArray | pa.Array, width: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def fit(vectors: DataFrame, n: int, dim: int, dtype: str, sample: int = SAMPLE) -> Codec:
    """The codec of a bounded sample: about ``sample`` rows of n, by a hash of vec_id."""
    scale = 1 << 30
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(scale)) < min(scale, sample * scale // n + 1)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample).toArrow()
    if not drawn.num_rows:
        drawn = vectors.orderBy("vec_id").limit(1).toArrow()
    return Codec(matrix(drawn.column("vector"), dim, dtype).astype(np.float64))


def index(vectors: DataFrame, codec: Codec, dim: int, dtype: str) -> DataFrame:
    """Every row with its cell, code and correction scalars; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, code, *scalars = codec.encode(matrix(batch.column(1), dim, dtype).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array([x.tobytes() for x in code], pa.binary()), *map(pa.array, scalars)],
                names=["vec_id", "vector", "cell", "code", "radius", "scale", "error"],
            )

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector binary, cell int, code binary, radius double, scale double, error double")


class Best:
    """Of each query, the k best candidates so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates ``ids`` with ``score`` for the queries ``at``."""
        if not len(at):
            return
        met = np.unique(at)
        q = np.concatenate([np.repeat(met, self.k), at])
        s, i = np.concatenate([self.score[met].ravel(), score]), np.concatenate([self.id[met].ravel(), ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        kept = rank < self.k
        self.score[q[kept], rank[kept]], self.id[q[kept], rank[kept]] = s[kept], i[kept]


def search(codec: Codec, query: np.ndarray, query_id: np.ndarray, vectors: np.ndarray, ids: np.ndarray, cell: np.ndarray, code: np.ndarray, radius: np.ndarray, scale: np.ndarray, error: np.ndarray, k: int) -> tuple[Best, int]:
    """The k best of the candidates for each query, and how many exact products it took."""
    order = np.lexsort((ids, cell))
    vectors, ids, cell, code, radius, scale, error = (x[order] for x in (vectors, ids, cell, code, radius, scale, error))
    by_query = np.argsort(query_id)
    query, query_id = query[by_query], query_id[by_query]
    size = lengths(query)
    unit = query / size[:, None]
    turned = (unit @ codec.rotation.T).astype(np.float32).T / np.float32(codec.bits**0.5)
    middle = codec.centroids @ unit.T
    columns, rows = np.ascontiguousarray(query.T), np.ascontiguousarray(vectors.T)
    best, exact = Best(len(query), k), 0

    def offer(at: np.ndarray, to: np.ndarray) -> None:
        nonlocal exact
        total = np.zeros(len(at))
        for x, y in zip(columns, rows):
            total += x[at] * y[to]
        exact += len(at)
        best.offer(at, total, ids[to])

    for c in np.unique(cell):
        begin, end = np.searchsorted(cell, [c, c + 1])
        for low in range(begin, end, TILE):
            tile = slice(low, min(low + TILE, end))
            reach = middle[c] + radius[tile].max() * (1 + 1e-9) + 1e-9 * np.abs(middle[c])
            met = np.nonzero(~(reach * size < best.score[:, -1]))[0]
            if not len(met):
                continue
            signs = np.unpackbits(code[tile], axis=1, count=codec.bits).astype(np.float32) * 2 - 1
            guess = (signs @ turned[:, met]) * scale[tile, None] + middle[c][None, met]
            own = np.minimum(np.searchsorted(query_id[met], ids[tile]), len(met) - 1)
            own = (np.nonzero(query_id[met][own] == ids[tile])[0], own[query_id[met][own] == ids[tile]])
            guess[own] = -np.inf
            if not np.isfinite(best.score[met, -1]).any() and len(guess) > k:  # start with the likeliest
                first = np.argpartition(-guess, k, axis=0)[:k]
                offer(np.tile(met, k), first.ravel() + low)
                done = np.zeros(guess.shape, bool)
                done[first, np.arange(len(met))[None, :]] = True
            else:
                done = np.zeros(guess.shape, bool)
            done[own] = True
            bound = (guess + (SIGMAS * error[tile, None] + 1e-5 * (scale[tile, None] + np.abs(middle[c][None, met])))) * size[met]
            to, at = np.nonzero(~(bound < best.score[met, -1]) & ~done)
            offer(met[at], to + low)
    back = np.argsort(by_query)
    best.score, best.id = best.score[back], best.id[back]
    return best, exact


def neighbours(embeddings: DataFrame, queries: str = "pmod(vec_id, 20) = 0", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of every row that meets ``queries``."""
    spark = embeddings.sparkSession
    vectors, dim, dtype = usable(embeddings)
    schema = "query_id long, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    vectors = stored(vectors, "vectors")
    n, asked = vectors.count(), vectors.where(queries).count()
    codec = fit(vectors, n, dim, dtype)
    sent = spark.sparkContext.broadcast(codec)
    across, down = max(LEAST_BLOCKS, -(-n // CANDIDATE_BLOCK)), max(1, -(-asked // QUERY_BLOCK))

    def block(count: int, seed: int) -> F.Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count))

    def blocks(count: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = vectors.where(queries).withColumn("row", block(down, 1)).withColumn("col", blocks(across))
    right = index(vectors, codec, dim, dtype).withColumn("col", block(across, 2)).withColumn("row", blocks(down))
    left, right = (x.withColumn("grp", F.col("row") * across + F.col("col")).drop("row", "col").repartition(min(TASKS, across * down), "grp") for x in (left, right))

    def run(asking: pa.Table, found: pa.Table) -> pa.Table:
        ids, scores, to = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if asking.num_rows and found.num_rows:
            tools = sent.value
            numbers = [found.column(c).to_numpy() for c in ("radius", "scale", "error")]
            query_id = asking.column("vec_id").to_numpy()
            best, _ = search(
                tools, matrix(asking.column("vector"), dim, dtype).astype(np.float64), query_id, matrix(found.column("vector"), dim, dtype).astype(np.float64),
                found.column("vec_id").to_numpy(), found.column("cell").to_numpy(), matrix(found.column("code"), tools.bits // 8, "uint8"), *numbers, k,
            )
            good = best.id != np.iinfo(np.int64).max
            ids, scores, to = np.repeat(query_id, good.sum(axis=1)), best.score[good], best.id[good]
        return pa.table({"query_id": ids, "vec_id": to, "score": scores})

    near = left.groupBy("grp").cogroup(right.groupBy("grp")).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = stored(near.withColumn("rank", rank).where(F.col("rank") <= k), "neighbours")
    discard(vectors)
    return out.select("query_id", "rank", "vec_id", "score")


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_vector_search": op12_vector_search}
#: All candidates of all queries, for small tables of vectors of one length with unique vec_ids.
ORACLE = {
    "op12_vector_search": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
}
