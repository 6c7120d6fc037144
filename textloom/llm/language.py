"""Language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; a table of weights
turns them into a score per language, and learned transition weights tie
neighbouring words, so that switches inside a text are found but cost something.
Forward-backward gives each word's posterior; a document's language is the one
with the largest expected share of its words, and that share is the score.

Forward-backward runs in bulk: every text is cut into chunks, the product of each
chunk's matrices is taken for all chunks side by side, the chunk ends are chained
per text, and the chunks are filled in again side by side.  The result is that of
the plain recursion for texts of any length.

The classifier is fitted on a bounded sample: at most `per_lang` whole documents
of each language, the ones with the smallest hash of their id.  Half of them give
the lexicon, the other half the training sequences, which join pieces of
different languages so that transitions are learned from switches.

Defined results: a null text or one without a letter is `und` with score 0; words
without a letter carry no score; a repeated row is predicted again; ties go to the
language first in alphabetical order; other columns are ignored; without any
labelled text everything is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_memory, mix, prepare, slices, text_bytes

_BITS = 16
#: Longer words are scored like others, but training does not draw them.
_TRAINED = 64
#: Bytes of text that are worked on at once; the tables of a slice take some 100 times that.
_SLICE = 1_000_000


def bare(word: str) -> str:
    """The word in lower case without what is not a letter; '' if none is left."""
    w = word.lower()
    return w if w.isalpha() else "".join(c for c in w if c.isalpha())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of bare words, and which word each belongs to: n-grams (1 to
    4 characters, ends marked) and, hashed apart, affixes of 1 to 4 characters."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    starts, owner = ends - sizes, np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(chars))
    code, found, of = np.zeros(len(chars), np.uint64), [], []
    fold = lambda h, salt: (mix(h + np.uint64(salt)) >> np.uint64(64 - _BITS)).astype(np.int64)
    for n in range(1, 6):
        code = code * np.uint64(0x9E3779B97F4A7C15)
        code[: max(0, len(chars) - n + 1)] += chars[n - 1 :] + np.uint64(n)
        fits = left >= n
        if n < 5:
            at = np.flatnonzero(fits)
            found.append(fold(code[at], n))
            of.append(owner[at])
        if n > 1:
            long = np.flatnonzero(sizes >= n)
            for where, salt in ((starts[long], 77), (ends[long] - n, 99)):
                found.append(fold(code[where], salt))
                of.append(long)
    return np.concatenate(found), np.concatenate(of)


class Model:
    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs = langs
        self.weights = np.zeros((1 << _BITS, n), np.float32)
        self.lexicon: dict[int, np.ndarray] = {}
        self.lex_scale = np.float32(0.3)
        self.transitions = np.zeros((n, n), np.float32) + 1.5 * np.eye(n, dtype=np.float32)

    def lex(self, word: str) -> np.ndarray:
        return self.lexicon.get(xxhash.xxh64_intdigest(word), _NONE[: len(self.langs)])

    def emissions(self, feats: np.ndarray, owner: np.ndarray, lex: np.ndarray) -> np.ndarray:
        """The score of every language for each of len(lex) words."""
        sums = [np.bincount(owner, weights=self.weights[feats, k], minlength=len(lex)) for k in range(len(self.langs))]
        return np.stack(sums, 1) + self.lex_scale * lex


_NONE = np.zeros(4096, np.float32)


def _learn_lexicon(model: Model, texts: list[tuple[str, int]]) -> None:
    n = len(model.langs)
    counts: dict[int, np.ndarray] = {}
    for text, lang in texts:
        for w in {bare(x) for x in text.split()} - {""}:
            counts.setdefault(xxhash.xxh64_intdigest(w), np.zeros(n, np.float32))[lang] += 1
    model.lexicon = {h: np.log((c + 0.2) / (c.sum() + 0.2 * n) * n).astype(np.float32) for h, c in counts.items() if c.sum() >= 2}


def _sequences(texts: list[list[list[str]]], n_seq: int, length: int, rng) -> tuple[list[list[str]], np.ndarray]:
    """n_seq sequences of words, each of pieces from texts of random languages."""
    words, labels = [], np.zeros((n_seq, length), np.int64)
    for s in range(n_seq):
        got: list[str] = []
        while len(got) < length:
            lang = int(rng.integers(len(texts)))
            doc = texts[lang][int(rng.integers(len(texts[lang])))]
            want = min(1 + int(rng.geometric(1 / 14)), length - len(got), len(doc))
            at = int(rng.integers(len(doc) - want + 1))
            labels[s, len(got) : len(got) + want] = lang
            got += doc[at : at + want]
        words.append(got)
    return words, labels


def train(samples: list[tuple[str, str]], steps: int = 250, batch: int = 48, length: int = 28, seed: int = 11) -> Model | None:
    """Fit on (text, lang) rows by adaptive gradient steps on the likelihood."""
    langs = sorted({x for _, x in samples})
    if not langs:
        return None
    model, n = Model(langs), len(langs)
    rng = np.random.default_rng(seed)
    own = [[t for t, x in samples if x == lang] for lang in langs]
    _learn_lexicon(model, [(t, i) for i, ts in enumerate(own) for t in ts[::2]])
    docs = [[d for d in ([w for w in map(bare, t.split()) if 0 < len(w) <= _TRAINED] for t in ts[1::2] or ts) if d] for ts in own]
    docs = [d or [["-"]] for d in docs]
    sums = np.full_like(model.weights, 1e-6)
    t_sum, s_sum = np.full((n, n), 1e-6), 1e-6
    memory: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for _ in range(steps):
        seqs, y = _sequences(docs, batch, length, rng)
        flat = [w for s in seqs for w in s]
        new = [w for w in dict.fromkeys(flat) if w not in memory]
        if new:
            f, of = features(new)
            order = np.argsort(of, kind="stable")
            for w, own_f in zip(new, np.split(f[order], np.cumsum(np.bincount(of, minlength=len(new)))[:-1]), strict=True):
                memory[w] = (own_f, model.lex(w))
        feats = np.concatenate([memory[w][0] for w in flat])
        sizes = np.array([len(memory[w][0]) for w in flat])
        lex = np.stack([memory[w][1] for w in flat])
        e = model.emissions(feats, np.repeat(np.arange(len(flat)), sizes), lex)
        gamma, xi = _posteriors(e.reshape(batch, length, n), model.transitions)
        truth = np.zeros_like(gamma)
        truth[np.arange(batch)[:, None], np.arange(length), y] = 1
        g = ((gamma - truth) / batch).reshape(-1, n)
        each = np.repeat(g, sizes, 0)
        dw = np.stack([np.bincount(feats, weights=each[:, k], minlength=1 << _BITS) for k in range(n)], 1)
        dw += 1e-5 * model.weights
        sums += dw * dw
        model.weights -= (0.15 * dw / np.sqrt(sums)).astype(np.float32)
        seen = np.zeros((n, n))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1 / batch)
        dt = xi / batch - seen
        t_sum += dt * dt
        model.transitions -= (0.1 * dt / np.sqrt(t_sum)).astype(np.float32)
        ds = float((g * lex).sum())
        s_sum += ds * ds
        model.lex_scale = np.float32(max(0.0, float(model.lex_scale) - 0.05 * ds / np.sqrt(s_sum)))
    return model


def _posteriors(e: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plain forward-backward for equal-length sequences: word posteriors and the
    expected transition counts."""
    b, t, n = e.shape
    m = np.exp(transitions.astype(np.float64))
    x = np.exp(e - e.max(2, keepdims=True)).astype(np.float64)
    alpha, beta = np.empty((b, t, n)), np.ones((b, t, n))
    a = np.full((b, n), 1 / n)
    for i in range(t):
        a = (a @ m) * x[:, i]
        a /= a.sum(1, keepdims=True)
        alpha[:, i] = a
    for i in range(t - 2, -1, -1):
        v = (x[:, i + 1] * beta[:, i + 1]) @ m.T
        beta[:, i] = v / v.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    xi = np.zeros((n, n))
    for i in range(t - 1):
        p = alpha[:, i, :, None] * m * (x[:, i + 1] * beta[:, i + 1])[:, None, :]
        xi += (p / p.sum((1, 2), keepdims=True)).sum(0)
    return gamma, xi


def bulk_posteriors(e: np.ndarray, ends: np.ndarray, transitions: np.ndarray, chunk: int = 32) -> np.ndarray:
    """Posteriors of the words of many texts; text i has rows ends[i]:ends[i+1]."""
    total, n = e.shape
    sizes = np.diff(ends)
    texts = np.flatnonzero(sizes)
    if not len(texts):
        return np.zeros((0, n), np.float32)
    per = -(-sizes[texts] // chunk)
    first = np.concatenate([[0], np.cumsum(per)])
    owner = np.repeat(np.arange(len(texts)), per)
    rank = np.arange(first[-1]) - first[owner]
    start = ends[texts][owner] + rank * chunk
    left = np.minimum(chunk, ends[texts + 1][owner] - start)
    m = np.exp(transitions).astype(np.float32)
    x = np.exp(e - e.max(1, keepdims=True)).astype(np.float32)
    nc = len(start)
    prod = np.broadcast_to(np.eye(n, dtype=np.float32), (nc, n, n)).copy()
    for t in range(chunk):
        on = np.flatnonzero(left > t)
        p = (prod[on].reshape(-1, n) @ m).reshape(-1, n, n) * x[start[on] + t][:, None, :]
        prod[on] = p / p.max((1, 2), keepdims=True)
    into, after = np.empty((nc, n), np.float32), np.empty((nc, n), np.float32)
    a, deepest = np.full((len(texts), n), 1 / n, np.float32), int(per.max())
    by_size = np.argsort(-per, kind="stable")
    depth = per[by_size]
    for r in range(deepest):
        d = by_size[: np.searchsorted(-depth, -r, "left")]
        c = first[d] + r
        into[c] = a[d]
        v = np.einsum("ij,ijk->ik", a[d], prod[c])
        a[d] = v / v.sum(1, keepdims=True)
    b = np.full((len(texts), n), 1 / n, np.float32)
    for r in range(deepest - 1, -1, -1):
        d = by_size[: np.searchsorted(-depth, -r, "left")]
        c = first[d] + r
        after[c] = b[d]
        v = np.einsum("ijk,ik->ij", prod[c], b[d])
        b[d] = v / v.sum(1, keepdims=True)
    alpha, gamma = np.empty((total, n), np.float32), np.empty((total, n), np.float32)
    a = into
    for t in range(chunk):
        on = np.flatnonzero(left > t)
        v = (a[on] @ m) * x[start[on] + t]
        v /= v.sum(1, keepdims=True)
        alpha[start[on] + t] = v
        a[on] = v
    b = after
    for t in range(chunk - 1, -1, -1):
        on = np.flatnonzero(left > t)
        g = alpha[start[on] + t] * b[on]
        gamma[start[on] + t] = g / g.sum(1, keepdims=True)
        v = (x[start[on] + t] * b[on]) @ m.T
        b[on] = v / v.sum(1, keepdims=True)
    return gamma


class Predictor:
    """Applies a model to lists of texts; a bounded memory of words' scores."""

    limit, chunk = 200_000, 10_000

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        n = len(self.model.langs)
        self.ids: dict[bytes, int] = {}
        self.scores = np.zeros((1024, n), np.float32)
        self.lettered = np.zeros(1024, bool)

    def _learn(self, new: list[bytes]) -> None:
        at = len(self.ids)
        need = at + len(new)
        while need > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.lettered = np.concatenate([self.lettered, np.zeros_like(self.lettered)])
        words = [bare(w.decode("utf-8", "replace")) for w in new]
        full = [i for i, w in enumerate(words) if w]
        for i, w in enumerate(new):
            self.ids[w] = at + i
        self.scores[at:need] = 0
        self.lettered[at:need] = False
        for a in range(0, len(full), self.chunk):  # features take some 1 KB a word
            part = full[a : a + self.chunk]
            f, of = features([words[i] for i in part])
            lex = np.stack([self.model.lex(words[i]) for i in part])
            rows = at + np.array(part)
            self.scores[rows] = self.model.emissions(f, of, lex)
            self.lettered[rows] = True

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of all words, whether each has a letter, and the texts' ends."""
        cut = [t.split() for t in texts]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        known = set().union(*cut)
        new = known - self.ids.keys()
        if new and len(self.ids) + len(new) > self.limit:
            self._clear()
            new = known
        self._learn(list(new))
        ids = np.fromiter((i for c in cut for i in map(self.ids.__getitem__, c)), np.int64, int(ends[-1]))
        return bulk_posteriors(self.scores[ids], ends, self.model.transitions), self.lettered[ids], ends

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        gamma, lettered, ends = self.words(texts)
        n = len(self.model.langs)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))[lettered]
        share = np.stack([np.bincount(owner, weights=gamma[lettered, k], minlength=len(texts)) for k in range(n)], 1)
        count = np.bincount(owner, minlength=len(texts))
        best = share.argmax(1)
        score = share[np.arange(len(texts)), best] / np.maximum(count, 1)
        return [self.model.langs[b] if c else "und" for b, c in zip(best, count, strict=True)], [min(1.0, float(s)) for s in score]

    def runs(self, texts: list[bytes]) -> list[list[dict]]:
        """Per text its runs of words with one most likely language."""
        gamma, lettered, ends = self.words(texts)
        label = np.where(lettered, gamma.argmax(1) if len(gamma) else 0, -1)
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            found, last = [], -1
            for i in range(a, b):
                k = int(label[i])
                if k >= 0 and k != last:
                    if found:
                        found[-1]["end_word"] = int(i - a)
                    found.append({"lang": self.model.langs[k], "start_word": int(i - a), "end_word": int(b - a)})
                    last = k
            out.append(found)
        return out


def fit(docs: DataFrame, trainable, per_lang: int = 160, most: int = 32_000, most_chars: int = 2_000_000) -> Model | None:
    """Fit on the bounded sample of the rows of docs(doc_id, text, lang) where
    `trainable` holds and lang is not null: per language the documents with the least
    hash of their id, `per_lang` of them and no further ones once they have `most_chars`
    characters; `most` in all, a document of each language before any second one.  Of
    rows with one id and language, the text first in order counts."""
    prepare(docs.sparkSession)
    rows = docs.where(trainable & docs["lang"].isNotNull() & docs["text"].isNotNull())
    order = Window.partitionBy("lang").orderBy("key", "doc_id")
    keys = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("key"), F.length("text").cast("long").alias("n"))
    first = keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
    chosen = first.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < most_chars)
    wanted = F.broadcast(chosen.orderBy("rank", "lang").limit(most).select("lang", "doc_id").distinct())  # `most` rows
    own = rows.select("doc_id", "text", "lang").join(wanted, ["doc_id", "lang"], "left_semi")
    got = own.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()  # at most `most` rows
    got.sort(key=lambda r: (r.lang, xxhash.xxh64_intdigest(str(r.doc_id)), r.text))
    return train([(r.text, r.lang) for r in got])


def predict(docs: DataFrame, model: Model | None, id_column: str = "doc_id", runs: bool = False) -> DataFrame:
    """Per row its id, lang_pred, score and, if asked for, `runs`, the stretches
    of words in one language.  One pass, no shuffle."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    of_run = pa.list_(pa.struct([("lang", pa.string()), ("start_word", pa.int32()), ("end_word", pa.int32())]))

    def run(batches):
        p = Predictor(model) if model else None
        for rb in batches:
            raw = rb.column(1).to_pylist()
            for a, b in slices(raw, _SLICE):
                texts = raw[a:b]
                lang, score = p.predict(texts) if p else (["und"] * len(texts), [0.0] * len(texts))
                cols = [rb.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                if runs:
                    cols.append(pa.array(p.runs(texts) if p else [[]] * len(texts), of_run))
                yield pa.RecordBatch.from_arrays(cols, names=[id_column, "lang_pred", "score", "runs"][: len(cols)])
        p = None
        free_memory()

    schema = f"`{id_column}` {kind}, lang_pred string, score double" + ", runs array<struct<lang:string,start_word:int,end_word:int>>" * runs
    return docs.select(docs[id_column], text_bytes(docs).alias("_text")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.4) -> DataFrame:
    """The documents with a language of at least that share, all columns as they are."""
    prepare(docs.sparkSession)

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = Predictor(model) if model else None
        for s in texts:
            raw = [(t or "").encode() for t in s]
            out = []
            for a, b in slices(raw, _SLICE):
                if p:
                    lang, score = p.predict(raw[a:b])
                    out += [x != "und" and y >= least for x, y in zip(lang, score, strict=True)]
                else:
                    out += [False] * (b - a)
            yield pd.Series(out, dtype=bool)
        p = None
        free_memory()

    return docs.where(known(docs["text"]))


def held_out(docs: DataFrame, of: int, rest: int):
    """Whether crc32 of the id as text leaves that rest; false for a null id."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % of == rest, F.lit(False))


def op3(docs: DataFrame) -> DataFrame:
    model = fit(docs, ~held_out(docs, 4, 2))
    out = predict(docs, model)
    return out.select("doc_id", held_out(out, 4, 2).alias("held_out"), "lang_pred", "score")
