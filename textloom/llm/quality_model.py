"""Quality classifier: random-indexing word vectors, pooled per document, into a
two-layer network with temperature-calibrated probabilities.

Units of a text are its words (lower case, without what surrounds them), the
shapes of its tokens (case and the symbols around) and a mark where a token
repeats the one before.  Each unit has a bucket; each bucket a fixed sparse ternary
index vector.  A unit's vector is the sum of the index vectors of its neighbours
in *all* texts: one pass gives exact integer sums per task, which are merged in a
tree.  The table has a fixed size (2^15 buckets of 32), so it may be broadcast
whatever the input's size.  A document is pooled to the mean and the spread of its
units' vectors, centred and of length one.

The network (tanh layer, logistic output) is fitted on at most `sample` labelled
documents, the ones with the smallest hash of their id (of rows that share an id, the
one with the largest pooled vector); a fifth of those is kept from it to fit the
temperature.

Defined results: null or empty texts pool to zeros and get the score of such;
labels with a null are not used, several of a document count by their largest;
repeated rows are scored again; other columns are ignored; without labels of both
kinds every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, merge_blocks, mix, prepare, slices, text_bytes
from .toxicity import labelled

BUCKETS, WIDTH, NONZERO, BLOCKS = 1 << 15, 32, 4, 16
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_REPEAT = xxhash.xxh32_intdigest("\0repeat") % BUCKETS
_LOWER = xxhash.xxh32_intdigest("\0|l|") % BUCKETS


def token_units(token: bytes) -> tuple[int, int]:
    """The buckets of a token's shape and of its word."""
    if token.isalpha() and token.islower():  # ASCII letters alone
        return _LOWER, xxhash.xxh32_intdigest(token) % BUCKETS
    t = token.decode("utf-8", "replace")
    core = t if t.isalnum() else _EDGE.sub("", t)
    at = t.find(core) if core else 0
    case = "0" if not core else "U" if core.isupper() and len(core) > 1 else "c" if core[:1].isupper() else "l" if core.isalpha() else "m"
    shape = f"\0{t[:at][:4]}|{case}|{t[at + len(core):][:4] if core else t[:4]}"
    return xxhash.xxh32_intdigest(shape) % BUCKETS, xxhash.xxh32_intdigest(core.lower()) % BUCKETS


class TokenUnits(dict):
    """Buckets of tokens seen before; a token takes some 200 bytes."""

    limit = 600_000

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        s, w = token_units(token)
        n = self[token] = s << 15 | w
        return n


_MEMORY = TokenUnits()


def unit_memory() -> TokenUnits:
    """The memory of this worker, kept from task to task."""
    return _MEMORY


def unit_stream(texts: list[bytes], memory: TokenUnits) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all units in order, and the texts' ends in them."""
    cut = [t.split() for t in texts]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    both = np.fromiter(map(memory.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    same = np.zeros(len(both), bool)
    same[1:] = both[1:] == both[:-1]
    same[ends[1:-1][ends[1:-1] < len(both)]] = False
    units = np.stack([np.where(same, _REPEAT, both >> 15), both & (BUCKETS - 1)], 1).ravel()
    return units, ends * 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    h = mix((np.arange(BUCKETS, dtype=np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64)) + np.uint64(0x51ED27))
    return (h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The centred unit-length vectors of all buckets, from all texts."""
    import pyarrow as pa

    rows = BUCKETS // BLOCKS

    def run(batches):
        from pyspark import TaskContext

        place, sign = index_vectors()
        total = np.zeros(BUCKETS * WIDTH)
        memory = unit_memory()
        for rb in batches:
            raw = rb.column(0).to_pylist()
            for a, b in slices(raw, 4_000_000):
                u, ends = unit_stream(raw[a:b], memory)
                if len(u) < 2:
                    continue
                apart = np.ones(len(u) - 1, bool)
                inner = ends[1:-1]
                apart[inner[(inner > 0) & (inner < len(u))] - 1] = False
                # Neighbours return often: each pair is worked out once, with its count.
                pair, n = np.unique(u[:-1][apart] << 15 | u[1:][apart], return_counts=True)
                left, right = pair >> 15, pair & (BUCKETS - 1)
                for k in range(NONZERO):
                    for x, y in ((left, right), (right, left)):
                        total += np.bincount(x * WIDTH + place[y, k], weights=n * sign[y, k], minlength=BUCKETS * WIDTH)
        part = TaskContext.get().partitionId()
        blobs = [zlib.compress(total[i * rows * WIDTH : (i + 1) * rows * WIDTH].astype("<i8").tobytes(), 1) for i in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array([part] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "block", "data"])

    def merge(blobs):
        total = np.zeros(rows * WIDTH, np.int64)
        for x in blobs:
            total += np.frombuffer(zlib.decompress(x), "<i8")
        return zlib.compress(total.astype("<i8").tobytes(), 1)

    prepare(docs.sparkSession)
    parts = materialize(docs.select(text_bytes(docs).alias("_text")).mapInArrow(run, "part int, block int, data binary"))
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for r in merge_blocks(parts, merge).collect():  # BLOCKS rows
        v = np.frombuffer(zlib.decompress(r.data), "<i8").reshape(rows, WIDTH)
        out[r.block * rows : (r.block + 1) * rows] = v
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out /= np.maximum(size, 1e-9)
    used = size[:, 0] > 0
    if used.any():
        out[used] -= np.average(out[used], axis=0, weights=np.log1p(size[used, 0]))
        out[used] /= np.maximum(np.linalg.norm(out[used], axis=1, keepdims=True), 1e-9)
    return out


def _sums(both: np.ndarray, units: np.ndarray, starts: np.ndarray, ends: np.ndarray, run: int = 512, often: int = 512) -> np.ndarray:
    """Sums of the units' rows for texts that lie one after another, units[start:end],
    none empty: for the `often` most frequent units by their counts in each text, in
    double precision; for the others in single precision over short runs, whose sums are
    added in double."""
    n = len(starts)
    owner = np.repeat(np.arange(n), ends - starts)
    units = units[starts[0] : ends[-1]]
    found = np.bincount(units, minlength=len(both))
    top = np.argpartition(found, -often)[-often:] if often < len(found) else np.arange(len(found))
    top = top[found[top] > 0]
    place = np.full(len(both), -1)
    place[top] = np.arange(len(top))
    at = place[units]
    hit = at >= 0
    counts = np.bincount(owner[hit] * len(top) + at[hit], minlength=n * len(top)).reshape(n, len(top))
    total = counts.astype(np.float64) @ both[top].astype(np.float64)
    rest = units[~hit]
    stop = np.cumsum(np.bincount(owner[~hit], minlength=n)).tolist()
    one, a = np.ones(run, both.dtype), 0
    for i, b in enumerate(stop):
        for j in range(a, b, run):
            k = min(b, j + run)
            total[i] += one[: k - j] @ both[rest[j:k]]
        a = b
    return total


def pool(docs: DataFrame, vectors: np.ndarray, id_column: str = "doc_id") -> DataFrame:
    """Per row its id and `pooled` array<float>: mean and spread of the vectors of
    its units, separately for shapes and words."""
    import pyarrow as pa

    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # 4 MB, whatever the input

    def run(batches):
        table, memory = shared.value, unit_memory()
        both = np.concatenate([table, table * table], 1)
        for rb in batches:
            raw = rb.column(1).to_pylist()
            for a, b in slices(raw, 3_000_000, 4_000):
                u, ends = unit_stream(raw[a:b], memory)
                n, parts = b - a, []
                full = np.flatnonzero(np.diff(ends))
                for units in (u[::2], u[1::2]):
                    at = np.zeros((n, 2 * WIDTH))
                    if len(full):
                        starts, stops = ends[full] // 2, ends[full + 1] // 2
                        at[full] = _sums(both, units, starts, stops) / (stops - starts)[:, None]
                    mean, square = at[:, :WIDTH], at[:, WIDTH:]
                    parts += [mean, np.sqrt(np.maximum(square - mean * mean, 0))]
                flat = np.concatenate(parts, 1).astype(np.float32)
                of = pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1])
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, n), pa.ListArray.from_arrays(of, pa.array(flat.ravel()))], names=[id_column, "pooled"])

    prepare(docs.sparkSession)
    return docs.select(docs[id_column], text_bytes(docs).alias("_text")).mapInArrow(run, f"`{id_column}` {kind}, pooled array<float>")


class Network:
    """inputs -> tanh layer -> logistic, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 5):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, own = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-3
        z = (x - self.mean) / self.scale
        d = x.shape[1]
        p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            rng.shuffle(own)
            for i in range(0, len(own), 128):
                j = own[i : i + 128]
                h = np.tanh(z[j] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[j]) / len(j)
                back = e[:, None] * p[2] * (1 - h * h)
                t += 1
                for k, g in enumerate((z[j].T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], e.sum(keepdims=True))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(held):
            logit = self.logit(x[held])
            grid = np.exp(np.linspace(-1, 2.5, 71))
            loss = [np.mean(np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logit / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def score_quality(docs: DataFrame, labels: DataFrame, allowed=None, sample: int = 20_000) -> DataFrame:
    """Per row of docs: doc_id, score.  `allowed`: which labels may be learned from."""
    import pyarrow as pa

    pooled = materialize(pool(docs, word_vectors(docs)))
    chosen = F.broadcast(labelled(docs, labels, "quality", allowed, sample))  # at most `sample` rows
    # One row for each chosen id: of rows that share it, the largest vector.
    got = pooled.join(chosen, "doc_id").groupBy("doc_id").agg(F.max("pooled").alias("pooled"), F.max("label").alias("label")).collect()
    got.sort(key=lambda r: (r.doc_id, r.pooled))
    y = np.array([float(r.label > 0) for r in got])
    net = Network(np.array([r.pooled for r in got], np.float64), y) if len(set(y)) == 2 else None
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for rb in batches:
            n = rb.num_rows
            x = rb.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(net(x.astype(np.float64)) if net is not None and n else np.full(n, 0.5))], names=["doc_id", "score"])

    return pooled.select("doc_id", "pooled").mapInArrow(run, f"doc_id {kind}, score double")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    from .language import held_out

    out = score_quality(docs, labels, ~held_out(labels, 3, 1))
    return out.select("doc_id", held_out(out, 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
