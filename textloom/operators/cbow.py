"""Continuous bag of words: vocabulary, context pairs, training, neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cbow_tokens, first_position, lookup
from . import grams
from .counting import frugal


def vocabulary(docs: DataFrame, size: int = 1000, tokens=cbow_tokens) -> DataFrame:
    """word, ix (1 for the most frequent; 0 is for all others), cnt."""
    rows = grams.counts(docs, 1, tokens(docs["text"])).withColumnRenamed("next", "word")
    counted = rows.groupBy("word").agg(F.sum("cnt").alias("cnt"), F.min(first_position(F.col("doc_id"), F.col("pos"))).alias("first_pos"))
    best = counted.orderBy(F.desc("cnt"), "first_pos").limit(size)  # `size` rows
    return best.select("word", F.row_number().over(Window.orderBy(F.desc("cnt"), "first_pos")).alias("ix"), "cnt")


def context_pairs(docs: DataFrame, vocabulary: DataFrame, reach: int = 2, tokens=cbow_tokens) -> DataFrame:
    """doc_id, pos, context array<int>, target: for each token the ids of up to
    `reach` neighbours on either side in its document.

    The vocabulary is a map literal of bounded size, so nothing is shuffled."""
    words = vocabulary.select("word", "ix").orderBy("ix").collect()  # at most the vocabulary's size
    find = lookup([(r.word, r.ix) for r in words])
    ids = F.transform(tokens(docs["text"]), lambda x: F.coalesce(find(x), F.lit(0)))
    coded = docs.select("doc_id", ids.alias("ids"))
    around = lambda x, i: F.struct(i.cast("long").alias("pos"), F.concat(F.slice("ids", F.greatest(i - (reach - 1), F.lit(1)), F.least(i, F.lit(reach))), F.slice("ids", i + 2, F.lit(reach))).alias("context"), x.alias("target"))
    rows = coded.select("doc_id", F.explode(F.transform("ids", around)).alias("p")).select("doc_id", "p.pos", "p.context", "p.target")
    return rows.where(F.size("context") > 0)


class Model:
    """Input vectors, output weights and bias of a vocabulary with one extra row."""

    def __init__(self, size: int, width: int = 50, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.01, (size, width))
        self.w = rng.normal(0, 0.01, (width, size))
        self.b = np.zeros(size)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.e.ravel(), self.w.ravel(), self.b])

    def load(self, flat: np.ndarray) -> None:
        n, d = self.e.shape
        self.e, self.w, self.b = flat[: n * d].reshape(n, d).copy(), flat[n * d : 2 * n * d].reshape(d, n).copy(), flat[2 * n * d :].copy()

    def step(self, contexts: list, targets: np.ndarray, rate: float) -> tuple[float, float]:
        """One descent step on the mean loss of a batch; summed loss and target
        probability.  A word that a context has twice is moved twice."""
        sizes = np.array([len(c) for c in contexts])
        return self.descend(np.concatenate(contexts).astype(np.int64), sizes, np.asarray(targets), rate)

    def descend(self, flat: np.ndarray, sizes: np.ndarray, targets: np.ndarray, rate: float) -> tuple[float, float]:
        """step(), of the contexts one after another and their sizes (none is 0)."""
        n, starts = len(targets), np.cumsum(sizes) - sizes
        hidden = np.add.reduceat(self.e[flat], starts, 0) / sizes[:, None]
        p = hidden @ self.w
        p += self.b
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        total = p.sum(1)
        here = np.arange(n), targets
        right = p[here] / total
        p *= (1 / (total * n))[:, None]
        p[here] -= 1 / n
        back = p @ self.w.T
        back *= (rate / sizes)[:, None]
        hidden *= rate
        self.w -= hidden.T @ p
        self.b -= rate * p.sum(0)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        self.e[flat[order][first]] -= np.add.reduceat(back[np.repeat(np.arange(n), sizes)[order]], first, 0)
        return float(-np.log(right + 1e-9).sum()), float(right.sum())


def train(pairs: DataFrame, size: int, width: int = 50, epochs: int = 5, rate: float = 0.01, batch: int = 1, seed: int = 42) -> tuple[Model, list[tuple[int, float, float]]]:
    """(model, [(epoch, mean loss, mean target probability)]).

    Each epoch every task goes through its pairs in a seeded random order of its
    batches, starting from the model so far; the tasks' models are averaged by their
    numbers of pairs, one row per parameter in the JVM.  With one partition and
    batch=1 this is plain sequential descent; with more it has the same aim but not
    the same path.  What travels is the model, whose size does not grow with the input."""
    import pyarrow as pa

    model, history = Model(size, width, seed), []
    spark = pairs.sparkSession

    def one_epoch(shared, epoch):
        def run(batches):
            from pyspark import TaskContext

            own = Model(size, width, seed)
            own.load(shared.value)
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            n, loss, right = 0, 0.0, 0.0
            for rb in batches:
                contexts, targets = rb.column(0), rb.column(1).to_numpy(zero_copy_only=False)
                order = rng.permutation(len(targets))
                contexts, targets = contexts.take(pa.array(order)), targets[order]
                flat, sizes = contexts.flatten().to_numpy().astype(np.int64), contexts.value_lengths().to_numpy().astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for i in range(0, len(order), batch):
                    to = min(i + batch, len(order))
                    a, b = own.descend(flat[ends[i] : ends[to]], sizes[i:to], targets[i:to], rate)
                    loss, right = loss + a, right + b
                n += len(order)
            if n:
                flat = np.concatenate([own.flat() * n, [loss, right, n]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

        return run

    for epoch in range(1, epochs + 1):
        shared = spark.sparkContext.broadcast(model.flat())
        cells = pairs.select("context", "target").mapInArrow(frugal(one_epoch(shared, epoch)), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        got = cells.toPandas()
        shared.destroy()
        if not len(got):
            break
        v = np.zeros(len(got))
        v[got["i"]] = got["v"]
        model.load(v[:-3] / v[-1])
        history.append((epoch, v[-3] / v[-1], v[-2] / v[-1]))
    return model, history


def save(model: Model, spark: SparkSession, path: str) -> None:
    """The model as a table: kind (e, w, b), row, values."""
    parts = [("e", model.e), ("w", model.w), ("b", model.b[None, :])]
    rows = [(kind, i, [float(x) for x in r]) for kind, m in parts for i, r in enumerate(m)]
    spark.createDataFrame(rows, "kind string, row int, values array<double>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path).orderBy("kind", "row").collect()  # a model's size
    of = {k: np.array([r["values"] for r in rows if r.kind == k]) for k in "ewb"}
    model = Model(*of["e"].shape)
    model.e, model.w, model.b = of["e"], of["w"], of["b"][0]
    return model


def projection(vectors: DataFrame, k: int = 2, vec: str = "vec") -> DataFrame:
    """The rows with `point`, the first k principal components (centred, each with the
    sign that makes its largest weight positive): one pass for the covariances, d x d
    numbers at the driver, one projection in place."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = vectors.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    fitted = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    axes = fitted.pc.toArray()
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    mean = rows.select(Summarizer.mean(F.col("_v"))).first()[0].toArray()
    sign = np.sign((axes * fitted.pc.toArray()).sum(0))
    shift = mean @ axes
    # The transformer does not centre and keeps its own signs.
    point = F.transform(vector_to_array("_p"), lambda x, i: x * F.get(F.array(*[F.lit(float(s)) for s in sign]), i) - F.get(F.array(*[F.lit(float(s)) for s in shift]), i))
    return fitted.transform(rows).withColumn("point", point).drop("_v", "_p")


def vectors(model: Model, vocabulary: DataFrame) -> DataFrame:
    """ix, word, vec of the vocabulary and <UNK> (0)."""
    spark = vocabulary.sparkSession
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(model.e)], "ix int, vec array<float>")
    return rows.join(vocabulary.select("ix", "word"), "ix", "left").select("ix", F.coalesce("word", F.lit("<UNK>")).alias("word"), "vec")
