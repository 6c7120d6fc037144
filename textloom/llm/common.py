"""Helpers shared by the training-data operators: storage between jobs, word
hashing in bulk, and the merging of per-partition blocks."""

from __future__ import annotations

import contextlib
import threading

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import remove as _remove
from ..storage import scratch_folder as shared_dir

#: Rows of an Arrow batch handed to Python; texts may be long, so far below
#: Spark's 10,000.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless they were set on purpose.  The
    bound stays set: plans read it when they run, after the operator has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_cleaners: dict = {"lock": threading.Lock(), "running": 0, "before": None}


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """The setting while writes run; the last of several threads puts it back."""
    c = _cleaners
    with c["lock"]:
        if not c["running"]:
            c["before"] = spark.conf.get(_CLEAN, None)
            spark.conf.set(_CLEAN, "true")
        c["running"] += 1
    try:
        yield
    finally:
        with c["lock"]:
            c["running"] -= 1
            if not c["running"]:
                if c["before"] is None:
                    spark.conf.unset(_CLEAN)
                else:
                    spark.conf.set(_CLEAN, c["before"])


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage
    ends there, and a lost executor costs only the running stage.  Shuffle files of
    the write go with its end, not only when the driver next collects its garbage."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    with _cleaning(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for df in stored:
        _remove(df.sparkSession, df.stored_at)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it unlike every
    column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_bytes(docs: DataFrame, column: str = "text"):
    """The text as bytes, null as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit("")).cast("binary")


def free_memory() -> None:
    """Give what a task has freed back to the system, where its C library can: a worker
    lives on for the next tasks, which may be the JVM's alone."""
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage and give free heap back to the
    system.  A heap that a stage of shuffles has grown stays as large, garbage or not,
    and then lacks to the Python workers of the next stage.  The tasks are as many as the
    cores, so each executor gets some; one that gets none only keeps its memory."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')").collect()  # a row a core


class WordHash(dict):
    """64-bit hashes of words; a bounded memory of those seen before."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_words(texts: list[bytes], memory: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (separated by ASCII white space) of all texts in one
    array, and where each text's words start and end in it."""
    ends, flat = [0], []
    for t in texts:
        flat += t.split()
        ends.append(len(flat))
    return np.fromiter(map(memory.__getitem__, flat), np.uint64, len(flat)), np.array(ends, np.int64)


def slices(texts: list[bytes], most: int = 6_000_000, rows: int = 50_000):
    """Index ranges of consecutive texts with about so many bytes together, and no
    more than so many rows."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most or i - start >= rows:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    x = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return x | np.uint64(1)


def rolling(h: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Hashes of all runs of n neighbouring values (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j, c in enumerate(odd_multipliers(n, seed)):
        total += h[j : j + m] * c
    return mix(total)


def starts_within(ends: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of the total - n + 1 runs of n values, those inside one text (boolean)."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.ones(m, bool)
    for e in ends[1:-1]:
        ok[max(0, e - n + 1) : e] = False
    return ok


def merge_blocks(df: DataFrame, merge, fan_in: int = 64) -> DataFrame:
    """Merge rows (part int, block int, data binary) to one per block, in a tree:
    no task ever holds more than fan_in blocks of a group.  merge(list of bytes)
    gives bytes."""
    import pandas as pd

    def one(key, pdf):
        return pd.DataFrame({"part": [int(key[0])], "block": [int(key[1])], "data": [merge(list(pdf["data"]))]})

    most = df.agg(F.max("part")).first()[0] or 0
    while most > 0:
        most //= fan_in
        df = df.groupBy(F.expr(f"part div {fan_in}").cast("int").alias("part"), "block").applyInPandas(one, "part int, block int, data binary")
    return df
