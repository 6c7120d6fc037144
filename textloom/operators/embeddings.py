"""Embeddings: pair matrices, a linear map between two spaces, nearest neighbours.

Fitting needs only the Gram statistics A = X'X, B = Y'X, c = tr(Y'Y) and N: one pass
over the pairs gives partial sums of fixed size, and every iteration then works on
d x d matrices on the driver.  Vectors are array<float>.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counting import Best, frugal


def norm(v: Column) -> Column:
    """Euclidean length in double precision, at least 1e-9."""
    return F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.lit(1e-9))


def pairs(source: DataFrame, target: DataFrame, dictionary: DataFrame) -> DataFrame:
    """x, y: a row for each dictionary(source_word, target_word) row whose words both
    have vectors; repeated rows stay.  source and target have word, vec."""
    s = source.select(F.col("word").alias("source_word"), F.col("vec").alias("x"))
    t = target.select(F.col("word").alias("target_word"), F.col("vec").alias("y"))
    return dictionary.join(s, "source_word").join(t, "target_word").select("source_word", "target_word", "x", "y")


@dataclass(frozen=True)
class Gram:
    a: np.ndarray
    b: np.ndarray
    c: float
    n: int

    def loss(self, w: np.ndarray, scale: bool = True) -> float:
        """||X W' - Y||^2, divided by N if scaled; infinity if not finite."""
        total = np.trace(w @ self.a @ w.T) - 2 * np.trace(w @ self.b.T) + self.c
        total = total / self.n if scale else total
        return float(total) if np.isfinite(total) else float("inf")

    def gradient(self, w: np.ndarray, scale: bool = True) -> np.ndarray:
        return 2 * (w @ self.a - self.b) / (self.n if scale else 1)


def gram(pairs: DataFrame) -> Gram:
    """The statistics of pairs(x, y): one row of d x d sums per task, added up in the
    JVM, and one row at the driver."""
    import pyarrow as pa

    def run(batches):
        total = None
        for rb in batches:
            if not rb.num_rows:
                continue
            x, y = (np.array(rb.column(i).to_pylist(), np.float64) for i in (0, 1))
            part = np.concatenate([(x.T @ x).ravel(), (y.T @ x).ravel(), [(y * y).sum(), len(x), x.shape[1], y.shape[1]]])
            total = part if total is None else np.concatenate([total[:-2] + part[:-2], part[-2:]])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    cells = pairs.select("x", "y").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"), F.max("v").alias("m")).collect()
    if not cells:
        raise ValueError("no pairs")
    cells.sort(key=lambda r: r.i)
    v = np.array([r.v for r in cells])
    dx, dy = int(cells[-2].m), int(cells[-1].m)
    return Gram(v[: dx * dx].reshape(dx, dx), v[dx * dx : dx * dx + dy * dx].reshape(dy, dx), float(v[-4]), int(v[-3]))


def nearest_orthogonal(w: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(w, full_matrices=False)
    return u @ vt


def procrustes(g: Gram) -> np.ndarray:
    """The orthogonal map of least loss, in closed form."""
    return nearest_orthogonal(g.b)


@dataclass
class Fit:
    w: np.ndarray
    epochs: int
    history: list[tuple[int, float, float]]


def fit_map(train: Gram, test: Gram, epochs: int = 1000, rate: float = 1.0, decay: float = 0.0, clip: float | None = None, orthogonal_every: int | None = 1, look_every: int = 20, window: int = 10, tolerance: float = 1e-7, seed: int = 0, stop: str = "compat", scale: bool = True) -> Fit:
    """Gradient descent on the map, kept orthogonal if asked for; the map of least
    test loss wins.  history: (epoch, train loss, test loss).

    stop="compat" ends as soon as the window is full, because the current loss is
    part of the window that it has to improve on; stop="improvement" compares it
    with the losses before."""
    rng = np.random.default_rng(seed)
    dy, dx = train.b.shape
    bound = np.sqrt(6 / (dx + dy))
    w = rng.uniform(-bound, bound, (dy, dx))
    if orthogonal_every:
        w = nearest_orthogonal(w)
    best, best_loss, seen, history = w, float("inf"), [], []
    epoch = 0
    for epoch in range(1, epochs + 1):
        g = train.gradient(w, scale)
        size = np.linalg.norm(g)
        if clip is not None and size > clip:
            g = g * (clip / (size + 1e-9))
        w = w - rate / (1 + decay * (epoch - 1)) * g
        if not np.isfinite(w).all():
            break
        if orthogonal_every and epoch % orthogonal_every == 0:
            w = nearest_orthogonal(w)
        if epoch % look_every:
            continue
        now = test.loss(w, scale)
        history.append((epoch, train.loss(w, scale), now))
        if not np.isfinite(now):
            break
        if now < best_loss:
            best, best_loss = w, now
        past = seen[-(window - 1) :] if stop == "compat" else seen[-window:]
        seen.append(now)
        full = len(seen) >= window if stop == "compat" else len(seen) > window
        least = min([*past, now]) if stop == "compat" else min(past, default=now)
        if full and least - now < tolerance:
            break
    return Fit(best, epoch, history)


def map_rows(w: np.ndarray, spark) -> DataFrame:
    """row, values of a map, to be written as a table."""
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(w)], "row int, values array<double>")


def save_map(w: np.ndarray, spark, path: str) -> None:
    map_rows(w, spark).write.mode("overwrite").parquet(path)


def load_map(spark, path: str) -> np.ndarray:
    return np.array([r["values"] for r in spark.read.parquet(path).orderBy("row").collect()])  # a model's size


def apply_map(rows: DataFrame, w: np.ndarray, column: str = "vec") -> DataFrame:
    """rows with the vector mapped, in vectorized batches."""
    w = np.asarray(w, np.float64)

    @F.pandas_udf("array<float>")
    def mapped(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_list()).astype(np.float64) @ w.T).astype(np.float32))) if len(v) else pd.Series([], dtype=object)

    return rows.withColumn(column, mapped(column))


def nearest(targets: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vec: str = "embedding", skip_self: bool = True, block_numbers: int = 1 << 21) -> DataFrame:
    """query_id, id, similarity, rank: the k most similar rows of targets for each
    row of queries (same columns), by cosine, ties by id.

    The queries are a stated set, taken in blocks of at most so many numbers (16 MB);
    each block is a matrix that travels to the tasks and one pass over the targets, and
    a task gives its best k per query, however many batches it reads."""
    out, held, numbers = None, [], 0
    for r in queries.where(F.col(vec).isNotNull()).select(id_column, vec).toLocalIterator():
        if held and numbers + len(r[1]) > block_numbers:
            part = _best(targets, held, k, id_column, vec, skip_self)
            out, held, numbers = part if out is None else out.unionAll(part), [], 0
        held.append((r[0], r[1]))
        numbers += len(r[1])
    if held:
        part = _best(targets, held, k, id_column, vec, skip_self)
        out = part if out is None else out.unionAll(part)
    kind = targets.schema[id_column].dataType.simpleString()
    if out is None:
        return targets.sparkSession.createDataFrame([], f"query_id {kind}, id {kind}, similarity double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(targets: DataFrame, held: list, k: int, id_column: str, vec: str, skip_self: bool, chunk_cells: int = 1 << 18) -> DataFrame:
    """A task holds a chunk of similarities and the best so far; ids are only compared
    where similarities may be among the best."""
    import pyarrow as pa

    kind = targets.schema[id_column].dataType.simpleString()
    q_ids = np.array([i for i, _ in held])
    q = np.array([v for _, v in held], np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    shared = targets.sparkSession.sparkContext.broadcast((q_ids, q))  # one block of queries

    def run(batches):
        q_ids, q = shared.value
        best, id_type = Best(len(q_ids), k, least=-np.inf, most=chunk_cells), None
        for rb in batches:
            n = rb.num_rows
            if not n:
                continue
            id_type = rb.column(0).type
            ids = rb.column(0).to_numpy(zero_copy_only=False)
            flat = rb.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            for a in range(0, n, step := max(1, chunk_cells // max(len(q), flat.shape[1]))):
                own, x = ids[a : a + step], flat[a : a + step].astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                sim = np.round(x @ q.T, 12)  # equal vectors tie, whatever their batch
                if skip_self:
                    sim[own[:, None] == q_ids[None, :]] = -np.inf
                best.offer(own, sim)
        best.judge()
        if id_type is not None:
            at, of, sim = best.kept
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]).cast(id_type), pa.array(of).cast(id_type), pa.array(sim)], names=["query_id", "id", "similarity"])

    rows = targets.where(F.col(vec).isNotNull()).select(id_column, vec)
    return rows.mapInArrow(frugal(run), f"query_id {kind}, id {kind}, similarity double")


def accuracy(predictions: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """evaluated, top1, topk (percent) over truth(query_id, id): a query that has no
    prediction is not evaluated."""
    asked = predictions.select("query_id").distinct()
    hit = truth.join(asked, "query_id").join(predictions.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    one = F.coalesce(F.col("rank") == 1, F.lit(False))
    any_ = F.coalesce(F.col("rank") <= k, F.lit(False))
    return hit.agg(F.count("*").alias("evaluated"), (100 * F.avg(one.cast("int"))).alias("top1"), (100 * F.avg(any_.cast("int"))).alias("topk"))
