"""What the training-data operators share: table access, shared-folder tables, Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts can hold over 100,000 characters each.
ARROW_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, with Arrow batches kept small for long texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and the master is local
    (tests), a new one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there,
    and a lost executor costs a read, not the work before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/octofold-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._octofold_path = path
    _here.__dict__.setdefault("paths", set()).add(path)
    return out


#: Folders of the ``stored`` tables of this thread that were not deleted yet.
_here = threading.local()


def made() -> set[str]:
    return set(_here.__dict__.get("paths", ()))


def discard_since(known: set[str], kept: DataFrame) -> None:
    """Deletes the tables stored since ``known`` was taken, but for ``kept``: for a caller that has
    stored a result and reads nothing else any more."""
    for path in made() - known - {kept._octofold_path}:
        remove(kept.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    _here.__dict__.setdefault("paths", set()).discard(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that nothing reads any more, and has the JVM
    collect its garbage, upon which Spark removes the shuffle files of the plans before it: with
    many partitions these take more disk than the rows of iterative steps."""
    path = getattr(df, "_octofold_path", None)
    if path:
        gc.collect()
        df.sparkSession._jvm.System.gc()
        remove(df.sparkSession, path)


#: A key is hot if it has over 1 / HOT of all rows (and HOT_ROWS at least): HOT keys at most.
HOT, HOT_ROWS = 256, 500


def hot_keys(df: DataFrame, key: str, n: str | None = None) -> list[tuple]:
    """The hot keys of df, each with the number of tasks that its rows are dealt to; at most HOT
    pairs reach the driver. ``n``: a column that holds the rows that a row of df stands for."""
    rows = df.where(F.col(key).isNotNull())
    size = F.sum(n) if n else F.count("*")
    top = rows.groupBy(key).agg(size.alias("n")).where(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(HOT).collect()
    if not top:
        return []
    least = max(HOT_ROWS, rows.agg(size).first()[0] // HOT)
    return [(r[0], -(-r["n"] // least)) for r in top if r["n"] > least]


def spread_join(left: DataFrame, right: DataFrame, key: str, by: list[str], hot: list[tuple], how: str = "inner") -> DataFrame:
    """left.join(right, key, how), where the rows of hot keys of left are dealt to several tasks
    by a hash of the columns ``by``; right's rows of those keys (few) are repeated for each."""
    if not hot:
        return left.join(right, key, how)
    kind = left.schema[key].dataType.simpleString()
    parts = F.broadcast(left.sparkSession.createDataFrame(hot, f"`{key}` {kind}, _parts long"))
    n = F.coalesce("_parts", F.lit(1))
    a = left.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(*by), n)).drop("_parts")
    b = right.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("_parts")
    return a.join(b, [key, "_part"], how).drop("_part")


#: What this Python worker keeps from task to task: workers outlive the stage that filled it.
tools: dict[str, object] = {}


def forget() -> None:
    """Frees what earlier stages left in this worker, for stages that do not use it."""
    if tools:
        tools.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row for each row of df[columns].

    ``make`` runs once in a task and returns the function that turns a row's values into a
    tuple in the order of ``schema`` (names and types as in DDL, simple types only).
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        work, types = make(), None
        for batch in batches:
            rows = [work(*row) for row in zip(*(batch.column(c).to_pylist() for c in columns))]
            types = types or arrow_types(schema)
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    return df.select(*columns).mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_types(schema: str) -> list[pa.DataType]:
    out = []
    for part in schema.split(","):
        kind = part.split()[1]
        out.append(pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind])
    return out


#: Bits of a membership bitmap: 2 MB whatever the input's size. When very many keys fill it,
#: more rows pass the first filter; the exact join that follows decides.
BITMAP_BITS = 1 << 24


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap, eight bits to a byte, with the bits of the (well mixed) long keys set; at most
    BITMAP_BITS / 64 numbers reach the driver. ``marked`` reads it."""
    at = F.pmod(F.col(column), F.lit(BITMAP_BITS))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = words.toArrow()  # one job, where an iterator runs one for each partition
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (unsigned, or already in the range of the bitmap) is in the bitmap."""
    at = keys & np.array(BITMAP_BITS - 1, keys.dtype)
    return (bits[at >> np.array(3, keys.dtype)] >> (at & np.array(7, keys.dtype)).astype(np.uint8) & 1).astype(bool)
