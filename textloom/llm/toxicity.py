"""Toxicity as severity: cumulative-link ordinal regression on sparse text features.

Grades: 0 for texts labelled clean; texts labelled toxic get 1 to 3.  The labels
say only that a text is toxic, so its grade comes from the labels' own words: words
found far more often under toxic labels than under clean ones form a lexicon, and
the toxic texts' rates of such words are cut at their terciles (a toxic text
without any has grade 1).  One weight vector is shared by all thresholds:
P(grade > j) = logistic(w . x - theta_j), theta ascending.  A text's expected
severity is the sum of these; it is toxic where P(grade > 0) is a half or more.

Features of a text: for each word of the vocabulary whether the text has it, and
the logarithm of its rate.  Vocabulary words are those that at least `least`
sample texts have and whose rate differs most between labels.

The model is fitted on at most `sample` labelled rows, the ones with the smallest
hash of their id; every whole text is scored in one pass without a shuffle.

Defined results: null or empty texts have no features and get the severity of
such; labels with a null are not used, several labels of a document count by
their largest; repeated rows are scored again; other columns are ignored; without
labels every severity is 0.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, slices, text_bytes

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: bytes) -> str:
    return _EDGE.sub("", word.decode("utf-8", "replace").lower())


class Words(dict):
    """Numbers of vocabulary words by the words as they stand; -1 for others."""

    limit = 300_000

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[word] = self.vocabulary.get(bare(word), -1)
        return n


def sparse(texts: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and count of every vocabulary word in the texts; words per text."""
    sizes, rows, cols = np.zeros(len(texts), np.int64), [], []
    for i, t in enumerate(texts):
        got = t.split()
        sizes[i] = len(got)
        ids = np.fromiter(map(words.__getitem__, got), np.int64, len(got))
        ids = ids[ids >= 0]
        if len(ids):
            rows.append(np.full(len(ids), i))
            cols.append(ids)
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none, sizes
    v = max(1, len(words.vocabulary))
    key, count = np.unique(np.concatenate(rows) * v + np.concatenate(cols), return_counts=True)
    return key // v, key % v, count, sizes


class Ordinal:
    """Cumulative-link model over sparse rows (row, feature, value)."""

    def __init__(self, n_features: int, grades: int):
        self.w, self.theta = np.zeros(n_features), np.linspace(1, 2, grades - 1)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) per row and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.theta[None, :], -40, 40)))

    def fit(self, row, col, val, grade: np.ndarray, steps: int = 600, rate: float = 0.05, l2: float = 2e-4) -> None:
        n, k = len(grade), len(self.theta)
        raw = np.concatenate([[self.theta[0]], np.log(np.diff(self.theta))])
        p = np.concatenate([self.w, raw])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, steps + 1):
            w, raw = p[: len(self.w)], p[len(self.w) :]
            self.theta = np.cumsum(np.concatenate([[raw[0]], np.exp(np.clip(raw[1:], -6, 4))]))
            score = np.bincount(row, weights=val * w[col], minlength=n)
            q = np.concatenate([np.ones((n, 1)), self.above(score), np.zeros((n, 1))], 1)
            i = np.arange(n)
            like = np.maximum(q[i, grade] - q[i, grade + 1], 1e-9)
            slope = q * (1 - q)
            d_score = -(slope[i, grade] - slope[i, grade + 1]) / like / n
            d_theta = np.zeros(k)
            for j in range(k):
                d_theta[j] = ((grade == j + 1) * slope[:, j + 1] / like).sum() / n - ((grade == j) * slope[:, j + 1] / like).sum() / n
            tail = np.cumsum(d_theta[::-1])[::-1]
            d_raw = np.concatenate([[tail[0]], tail[1:] * np.exp(np.clip(raw[1:], -6, 4))])
            g = np.concatenate([np.bincount(col, weights=val * d_score[row], minlength=len(w)) + l2 * w, d_raw])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, raw = p[: len(self.w)], p[len(self.w) :]
        self.theta = np.cumsum(np.concatenate([[raw[0]], np.exp(np.clip(raw[1:], -6, 4))]))


class Model:
    def __init__(self, vocabulary: list[str], ordinal: Ordinal):
        self.vocabulary, self.ordinal = {w: i for i, w in enumerate(vocabulary)}, ordinal

    def values(self, row, col, count, sizes):
        """The two features of each word in a text."""
        v = len(self.vocabulary)
        rate = np.log1p(100 * count / np.maximum(sizes[row], 1))
        return np.concatenate([row, row]), np.concatenate([col, col + v]), np.concatenate([np.ones(len(row)), rate])

    def score(self, texts: list[bytes], words: Words) -> np.ndarray:
        row, col, count, sizes = sparse(texts, words)
        r, c, x = self.values(row, col, count, sizes)
        return self.ordinal.above(np.bincount(r, weights=x * self.ordinal.w[c], minlength=len(texts)))


def labelled(docs: DataFrame, labels: DataFrame, column: str, allowed=None, sample: int = 20_000) -> DataFrame:
    """doc_id and label of at most `sample` labelled documents."""
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    one = rows.groupBy("doc_id").agg(F.max(column).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, least: int = 5, most_words: int = 20_000, sample: int = 20_000) -> Model | None:
    import pyarrow as pa

    prepare(docs.sparkSession)
    chosen = F.broadcast(labelled(docs, labels, "toxic", sample=sample))  # at most `sample` rows
    rows = docs.select("doc_id", text_bytes(docs).alias("_text")).join(chosen, "doc_id").select("_text", F.col("label").cast("int").alias("label"))
    rows = materialize(rows)

    def counts(batches):
        for rb in batches:
            seen: dict[str, list[int]] = {}
            for t, y in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                for w in {bare(x) for x in set(t.split())}:
                    if w:
                        seen.setdefault(w, [0, 0])[y > 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["word", "clean", "toxic"])

    per_word = rows.mapInArrow(counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    size = {r.label > 0: r.n for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = size.get(False, 0), size.get(True, 0)
    if not n_clean or not n_toxic:
        return None
    a, b = (F.col("toxic") + 0.5) / (n_toxic + 1), (F.col("clean") + 0.5) / (n_clean + 1)
    z = F.abs(F.log(a / b)) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    words = per_word.where(F.col("toxic") + F.col("clean") >= least).select("word", F.log(a / b).alias("odds"), z.alias("z")).orderBy(F.desc("z"), "word").limit(most_words).where("z > 3").collect()
    model = Model([r.word for r in words], Ordinal(2 * len(words), 4))
    lexicon = np.array([r.odds > np.log(8) for r in words], bool)
    vocabulary = model.vocabulary

    def extract(batches):
        own = Words(vocabulary)
        for rb in batches:
            raw = rb.column(0).to_pylist()
            row, col, count, sizes = sparse(raw, own)
            of = np.searchsorted(row, np.arange(len(raw) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rb.column(1), pa.array(sizes), pa.ListArray.from_arrays(pa.array(of), pa.array(col)), pa.ListArray.from_arrays(pa.array(of), pa.array(count.astype(np.int64)))], names=["label", "n", "col", "cnt"])

    got = rows.mapInArrow(extract, "label int, n long, col array<long>, cnt array<long>").collect()
    row = np.repeat(np.arange(len(got)), [len(r.col) for r in got])
    col = np.array([c for r in got for c in r.col], np.int64)
    count = np.array([c for r in got for c in r.cnt], np.int64)
    sizes = np.array([r.n for r in got])
    toxic = np.array([r.label > 0 for r in got])
    hits = np.bincount(row, weights=count * lexicon[col], minlength=len(got)) if len(row) else np.zeros(len(got))
    rate = hits / np.maximum(sizes, 1)
    real = rate[toxic & (hits > 0)]
    cuts = np.quantile(real, [1 / 3, 2 / 3]) if len(real) else np.array([np.inf, np.inf])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, rate, "left"), 0)
    r, c, x = model.values(row, col, count, sizes)
    model.ordinal.fit(r, c, x, grade)
    return model


def score(docs: DataFrame, model: Model | None, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, expected_severity (0 to 3), p_toxic, toxic (boolean), grade (the likeliest)."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        own = Words(model.vocabulary) if model else None
        for rb in batches:
            raw = rb.column(1).to_pylist()
            for a, b in slices(raw):
                q = model.score(raw[a:b], own) if model else np.zeros((b - a, 3))
                each = np.concatenate([1 - q[:, :1], q[:, :-1] - q[:, 1:], q[:, -1:]], 1)
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, b - a), pa.array(q.sum(1)), pa.array(q[:, 0]), pa.array(q[:, 0] >= 0.5), pa.array(each.argmax(1).astype(np.int32))], names=[id_column, "expected_severity", "p_toxic", "toxic", "grade"])

    return docs.select(docs[id_column], text_bytes(docs).alias("_text")).mapInArrow(run, f"`{id_column}` {kind}, expected_severity double, p_toxic double, toxic boolean, grade int")
