"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text's shingles are its runs of five words (separated by ASCII white space, as
they stand), weighted by how often it has them.  ProbMinHash draws, for each
shingle, arrivals of a Poisson process whose rate is the weight; an arrival falls
on a random place of the signature and stays if it is the earliest there; a
shingle stops as soon as its next arrival is later than every place's earliest.
Two signatures agree in a place with the probability Jaccard similarity J_P of the
weighted sets.  25 bands of 5 places make a pair of similarity 0.8 meet with
probability 0.99995.

Texts with equal word sequences are one node, so copies are never paired.  In each
bucket every node is compared with the bucket's pivot, the node whose buckets are
the largest (in a group of near copies, the one they were made from); pairs are
judged by J_P of their whole shingle sets.  Linked nodes get their component, and
buckets that then lie in one component are done: a pair inside a component needs no
comparison.  In the others, pairs of different components are found in two ways,
which together lose none that reaches 0.8:

* pairs whose common shingles all lie in the bucket's core, which is the pivot's
  shingles and those that more than `_HOT` of the pivot's nodes have: their common
  mass is bounded by each one's mass on the core, so a node for which no size in its
  bucket fits the bound is left out before anything is paired.  1 - J_P is a metric
  (J_P is a collision probability), so two nodes whose similarities to the pivot
  differ by more than 0.2 are no pair either, nor are two whose counts, taken together
  in classes of the pivot's shingles, have a J_P below 0.8 (`_coarse`);
* pairs with a common shingle off the core: joined on those shingles, each of which
  at most `_HOT` nodes have, by prefixes.  The bound says how many such shingles two
  nodes of given sizes need; with shingles in one order (rarest first), each node
  enters with all but the last so many of them.

So each two nodes that meet in a bucket end in one component, or were compared, or
are proven unlike: no link between classes is lost, and a group of n near copies
costs n comparisons, not n^2.

Defined results: texts of 1 to 4 words have one shingle, all their words; a text
without words is a class of its own; rows with equal id and words are one
document; a class's id is its least doc_id (a null id only if it has no other);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, discard, free_memory, free_names, materialize, mix, prepare, rolling, slices, starts_within, hashed_words, text_bytes
from .components import components

WORDS, PLACES, BANDS, ROWS, LEAST = 5, 125, 25, 5, 0.8
_EPS, _HOT, _DEAL = 1e-9, 64, 100


def node_of(text: bytes) -> bytes:
    """16 bytes that stand for the text's word sequence."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def shingles(texts: list[bytes], memory: WordHash) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its sorted distinct shingle hashes and their counts."""
    h, ends = hashed_words(texts, memory)
    g = rolling(h, WORDS)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = g[a : b - WORDS + 1] if b - a >= WORDS else _short(h[a:b])
        out.append(np.unique(own, return_counts=True))
    return out


def _short(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.uint64)
    total = np.uint64(len(h))
    for x in h:
        total = mix(np.array([total ^ x], np.uint64))[0]
    return np.array([total], np.uint64)


def signatures(texts: list[bytes], memory: WordHash, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash signatures (texts x places) and the number of words of each."""
    h, ends = hashed_words(texts, memory)
    n = len(texts)
    ok = np.flatnonzero(starts_within(ends, WORDS, len(h)))
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(n, dtype=np.uint64), sizes)
    key = owner[ok] << np.uint64(48) | rolling(h, WORDS)[ok] >> np.uint64(16) if len(ok) else np.zeros(0, np.uint64)
    short = [(i, _short(h[ends[i] : ends[i + 1]])[0]) for i in np.flatnonzero((sizes > 0) & (sizes < WORDS))]
    if short:
        key = np.concatenate([key, np.array([int(i) << 48 | int(g) >> 16 for i, g in short], np.uint64)])
    key = np.sort(key)
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(key))).astype(np.float64)
    key = key[at]
    doc = (key >> np.uint64(48)).astype(np.int64)
    elem = mix(key & np.uint64((1 << 48) - 1))
    time = np.zeros(len(elem))
    best, sig = np.full(n * places, np.inf), np.zeros(n * places, np.uint64)
    step = 0
    while len(elem):
        step += 1
        r = mix(elem + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = doc * places + (mix(r ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(places)).astype(np.int64)
        better = np.flatnonzero(time < best[slot])
        s, t = slot[better], time[better]
        np.minimum.at(best, s, t)
        won = t == best[s]
        sig[s[won]] = elem[better][won]
        docs_now = np.unique(doc) if step > 1 else np.arange(n)
        latest = np.zeros(n)
        latest[docs_now] = best.reshape(n, places)[docs_now].max(1)
        go = time <= latest[doc]
        elem, doc, weight, time = elem[go], doc[go], weight[go], time[go]
    return sig.reshape(n, places), sizes


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One hash per band and text."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sig), b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
        out[:, b] = x
    return out


def probability_jaccard(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray) -> float:
    """J_P of two weighted sets: sorted distinct elements and their weights."""
    if not len(a) or not len(b):
        return 0.0
    i = np.searchsorted(a, b)
    hit = np.flatnonzero((i < len(a)) & (a[np.minimum(i, len(a) - 1)] == b))
    if not len(hit):
        return 0.0
    wa, wb = ca[i[hit]].astype(float), cb[hit].astype(float)
    if (ca == 1).all() and (cb == 1).all():
        return len(hit) / (len(a) + len(b) - len(hit))
    only_a, only_b = ca.sum() - wa.sum(), cb.sum() - wb.sum()
    pairs, n = np.unique(np.stack([wa, wb], 1), axis=0, return_counts=True)
    total = 0.0
    for (x, y), k in zip(pairs, n, strict=True):
        total += k / (np.maximum(pairs[:, 0] / x, pairs[:, 1] / y) @ n + only_a / x + only_b / y)
    return total


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_words, bands of every row."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        memory = WordHash()
        for rb in batches:
            raw = rb.column(1).to_pylist()
            for a, b in slices(raw, 3_000_000):
                sig, sizes = signatures(raw[a:b], memory)
                keys = band_keys(sig)
                keys = keys[sizes > 0].view(np.int64).ravel()
                of = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                nodes = pa.array([node_of(t) for t in raw[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, b - a), nodes, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(of), pa.array(keys))], names=["doc_id", "node", "n_words", "bands"])
        memory.clear()
        free_memory()

    return docs.select("doc_id", text_bytes(docs).alias("_text")).mapInArrow(run, f"doc_id {kind}, node binary, n_words long, bands array<long>")


def _shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, g, c: shingle hashes and counts of the wanted(node, doc_id) nodes."""
    import pyarrow as pa

    def run(batches):
        memory = WordHash()
        for rb in batches:
            raw, node = rb.column(0).to_pylist(), rb.column(1).to_pylist()
            for a, b in slices(raw, 3_000_000):
                mine = [i for i in range(a, b) if node_of(raw[i]) == node[i]]
                got = shingles([raw[i] for i in mine], memory)
                of = pa.array(np.concatenate([[0], np.cumsum([len(g) for g, _ in got])]).astype(np.int32))
                flat = [np.concatenate([x[k] for x in got]) if got else np.zeros(0, np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in mine], pa.binary()), pa.ListArray.from_arrays(of, pa.array(flat[0].view(np.int64))), pa.ListArray.from_arrays(of, pa.array(flat[1].astype(np.int32)))], names=["node", "g", "c"])

    one = wanted.select("node", F.col("doc_id").alias("_id"))
    rows = docs.select("doc_id", text_bytes(docs).alias("_text"))
    rows = rows.join(one, rows["doc_id"].eqNullSafe(one["_id"])).select("_text", "node")
    return rows.mapInArrow(run, "node binary, g array<long>, c array<int>").dropDuplicates(["node"])


def _similarities(pairs: DataFrame, table: DataFrame, rest: bool = False) -> DataFrame:
    """u, v, sim of the pairs(u, v); with `rest` also on_u, all_v, extra_v (v's
    counts: those of shingles that u has, all, and those above one), rest_v, the
    shingles of v that u lacks, n_u, the number of u's shingles, and miss_v, how many of
    them v lacks in each of 32 hash classes, part_v, v's counts of them in each of those
    classes, and off_extra_v, v's counts above one of shingles that u lacks."""
    import pyarrow as pa

    names = ["u", "v", "sim", "on_u", "all_v", "extra_v", "rest_v", "n_u", "miss_v", "part_v", "off_extra_v"]

    def run(batches):
        for rb in batches:
            lists = []
            for k in (2, 3, 4, 5):
                col = rb.column(k)
                flat, of = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
                flat = flat.view(np.uint64) if k % 2 == 0 else flat  # sorted as unsigned
                lists.append([flat[i:j] for i, j in zip(of[:-1], of[1:], strict=True)])
            sims = [probability_jaccard(*x) for x in zip(*lists, strict=True)]
            cols = [rb.column(0), rb.column(1), pa.array(sims, pa.float64())]
            if rest:
                lacks = [~np.isin(gv, gu, assume_unique=True) for gu, _, gv, _ in zip(*lists, strict=True)]
                total = [int(c.sum()) for c in lists[3]]
                of = pa.array(np.concatenate([[0], np.cumsum([x.sum() for x in lacks])]).astype(np.int32))
                left = [g[x] for g, x in zip(lists[2], lacks, strict=True)]
                cols += [pa.array([n - int(c[x].sum()) for n, c, x in zip(total, lists[3], lacks, strict=True)], pa.int64()), pa.array(total, pa.int64())]
                cols += [pa.array([n - len(c) for n, c in zip(total, lists[3], strict=True)], pa.int64())]
                cols += [pa.ListArray.from_arrays(of, pa.array((np.concatenate(left) if left else np.zeros(0, np.uint64)).view(np.int64)))]
                missed = [np.bincount((gu[~np.isin(gu, gv, assume_unique=True)] & np.uint64(31)).astype(np.int64), minlength=32) for gu, _, gv, _ in zip(*lists, strict=True)]
                of = pa.array(np.arange(len(missed) + 1, dtype=np.int32) * 32)
                cols += [pa.array([len(g) for g in lists[0]], pa.int64()), pa.ListArray.from_arrays(of, pa.array((np.concatenate(missed) if missed else np.zeros(0)).astype(np.int32)))]
                parts = [np.bincount((gv[~x] & np.uint64(31)).astype(np.int64), weights=cv[~x], minlength=32) for (_, _, gv, cv), x in zip(zip(*lists, strict=True), lacks, strict=True)]
                cols += [pa.ListArray.from_arrays(of, pa.array((np.concatenate(parts) if parts else np.zeros(0)).astype(np.int32)))]
                cols += [pa.array([int(c[x].sum()) - int(x.sum()) for c, x in zip(lists[3], lacks, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names[: len(cols)])

    left = table.select(F.col("node").alias("u"), F.col("g").alias("gu"), F.col("c").alias("cu"))
    right = table.select(F.col("node").alias("v"), F.col("g").alias("gv"), F.col("c").alias("cv"))
    schema = "u binary, v binary, sim double" + ", on_u long, all_v long, extra_v long, rest_v array<long>, n_u long, miss_v array<int>, part_v array<int>, off_extra_v long" * rest
    return pairs.join(left, "u").join(right, "v").select("u", "v", "gu", "cu", "gv", "cv").mapInArrow(run, schema)


def _similar(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("sim") >= LEAST - _EPS).select("u", "v")


def _mixed(placed: DataFrame, by: str) -> DataFrame:
    """The groups with nodes of several components."""
    return placed.groupBy(by).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select(by)


#: J_P <= 1 / (1/p + 1/q - 1) for the parts p, q of two masses that are common.
_SLACK = 1 + 1 / LEAST + _EPS


def _size_bin():
    return F.floor(F.log("total") / float(np.log(1.05))).cast("int")


def _live(off: DataFrame) -> DataFrame:
    """The rows of off(pivot, node, component, on, total, extra) that may have a
    partner of another component, under one pivot, whose common shingles the core has.

    Let x be the common counts of a node and y those of its partner: x <= on, and
    y <= x + extra(partner), since two counts of a shingle differ by at most what they
    have above one.  So the part of the partner's mass, y / total(partner), that the
    bound asks for must be within (on + extra(partner)) / total(partner).  Sizes of
    partners are taken together in bins, of which there are few."""
    part = F.col("on") / F.col("total")
    bins = off.groupBy("pivot", _size_bin().alias("bin")).agg(F.min("total").alias("b_total"), F.max("extra").alias("b_extra"), F.min("component").alias("lo"), F.max("component").alias("hi")).drop("bin")
    asked = off.where(part >= LEAST - _EPS).withColumn("asked", 1 / (_SLACK - 1 / part))
    met = asked.join(bins, "pivot").where("lo != component or hi != component").where(F.col("asked") * F.col("b_total") - F.col("b_extra") <= F.col("on") + _EPS * F.col("total"))
    return off.join(met.select("pivot", "node").distinct(), ["pivot", "node"], "left_semi")


def _off_core(open_: DataFrame, compared: DataFrame) -> DataFrame:
    """pivot, node, component, sim, on, total, extra, hot, n_pivot, miss, rest of the
    nodes in open buckets: `hot` counts its shingles in the core but not in the pivot, `on` is at least the counts of shingles in the core, `rest` array<struct<n,
    h>> has the others that nodes of another component share, rarest first."""
    own = open_.select("pivot", "node", "component").distinct()
    facts = compared.select(F.col("u").alias("pivot"), F.col("v").alias("node"), "sim", F.col("on_u").alias("on"), F.col("all_v").alias("total"), F.col("extra_v").alias("extra"), F.col("n_u").alias("n_pivot"), F.col("miss_v").alias("miss"), F.col("part_v").alias("part"), (F.col("all_v") - F.col("on_u")).alias("off"), F.col("off_extra_v").alias("off_extra"))
    own = materialize(own.join(facts, ["pivot", "node"]))
    lacking = compared.select(F.col("u").alias("pivot"), F.col("v").alias("node"), "rest_v").join(own.select("pivot", "node", "component"), ["pivot", "node"])
    cells = materialize(lacking.select("pivot", "node", "component", F.explode("rest_v").alias("g")).select("pivot", "node", "component", F.xxhash64("pivot", "g").alias("h")))
    several = cells.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("h", "n")
    met = cells.join(several, "h").groupBy("pivot", "node").agg(F.count_if(F.col("n") > _HOT).alias("hot"), F.array_sort(F.collect_list(F.when(F.col("n") <= _HOT, F.struct("n", "h")))).alias("rest"))
    on = F.when(F.col("hot") > 0, F.least(F.col("on") + F.col("hot") + F.col("extra"), F.col("total"))).otherwise(F.col("on"))
    return own.join(met, ["pivot", "node"], "left").withColumn("hot", F.coalesce("hot", F.lit(0))).withColumn("on", on)


def _coarse(n):
    """Whether J_P of a pair's coarse counts reaches the least; `n` is the most shingles
    off the pivot that the two share.

    Taking shingles together never lowers J_P: with a, b the counts of one in both, its
    term 1 / sum(max(x/a, y/b)) is concave and of degree one in (a, b), so the term of
    a sum is at least the sum of terms, and the sums below the line only fall.  So J_P of
    the counts in the classes of the pivot's shingles and in one class of what is common
    off the pivot (at most n + off_extra) is a bound, and so is the sum of the lesser
    shares, which J_P never exceeds and which costs less."""
    off = {s: F.when(n > 0, F.least(f"off_{s}", n + F.col(f"off_extra_{s}"))).otherwise(0).cast("double") for s in "ab"}
    x, y = (F.concat(F.col(f"part_{s}").cast("array<double>"), F.array(off[s])) for s in "ab")
    add = lambda t, z: t + z
    share = F.aggregate(F.zip_with(x, y, lambda a, b: F.least(a / F.col("total_a"), b / F.col("total_b"))), F.lit(0.0), add)
    alone_a, alone_b = F.col("off_a") - off["a"], F.col("off_b") - off["b"]
    term = lambda a, b: 1 / F.aggregate(F.zip_with(x, y, lambda c, d: F.greatest(c / a, d / b)), alone_a / a + alone_b / b, add)
    return (share >= LEAST - 1e-6) & (F.aggregate(F.zip_with(x, y, lambda a, b: F.when((a > 0) & (b > 0), term(a, b)).otherwise(F.lit(0.0))), F.lit(0.0), add) >= LEAST - 1e-6)


def _pairs_on_core(off: DataFrame) -> DataFrame:
    """u, v of different components whose common shingles may all be in the core.

    Of a pivot with many nodes, one side is dealt to as many tasks as it has hundreds,
    and the other goes to each of them: no task has more than `_DEAL` rows of a pivot on
    one side."""
    live = materialize(_live(off.drop("rest")))
    pivots = live.groupBy("pivot").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    live = live.join(pivots.where("lo != hi").select("pivot", F.ceil(F.col("n") / _DEAL).alias("parts")), "pivot")
    side = lambda n, s: live.select("pivot", "parts", F.col("node").alias(n), *[F.col(c).alias(f"{c}_{s}") for c in ("component", "sim", "on", "total", "extra", "hot", "n_pivot", "miss", "part", "off", "off_extra")])
    left = side("u", "a").withColumn("part", F.pmod(F.xxhash64("u"), "parts")).drop("parts")
    right = side("v", "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    p = F.least("on_a", F.col("on_b") + F.col("extra_a")) / F.col("total_a")
    q = F.least("on_b", F.col("on_a") + F.col("extra_b")) / F.col("total_b")
    near = F.abs(F.col("sim_a") - F.col("sim_b")) <= 1 - LEAST + _EPS
    # What either lacks of the pivot is in no common part.
    lost = F.aggregate(F.zip_with("miss_a", "miss_b", lambda x, y: F.greatest(x, y)), F.lit(0), lambda a, x: a + x)
    common = F.col("n_pivot_a") - lost + F.least("hot_a", "hot_b") + F.col("extra_a") + F.col("extra_b")
    enough = common + 1e-6 >= (F.col("total_a") + F.col("total_b")) / (1 + 1 / LEAST)
    return left.join(right, ["pivot", "part"]).where(F.expr("u < v and component_a != component_b") & near & (1 / p + 1 / q <= _SLACK) & enough & _coarse(F.least("hot_a", "hot_b"))).select("u", "v")


def _rows_off_core(off: DataFrame) -> DataFrame:
    """h, node and its facts, left: the shingles off the core by which a node meets others,
    each once.

    Of the needs that the bins of its pivot's sizes ask for, the least holds for all of
    its partners: their first common shingle lies in the prefix that it leaves."""
    off = off.withColumn("bin", _size_bin())
    bins = off.groupBy("pivot", "bin").agg(F.min("total").alias("low"), F.max("total").alias("high"), F.max("extra").alias("more"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    bins = bins.groupBy("pivot").agg(F.collect_list(F.struct("low", "high", "more", "lo", "hi")).alias("bins"))

    def fits(x):
        other = (x["lo"] != F.col("component")) | (x["hi"] != F.col("component"))
        return other & (x["high"] + F.col("extra") + 1e-6 >= LEAST * F.col("total")) & (F.col("total") + x["more"] + 1e-6 >= LEAST * x["low"])

    def need(x):
        return F.greatest(F.lit(1), F.ceil((F.col("total") + x["low"]) / (1 + 1 / LEAST) - F.col("extra") - x["more"] - F.col("on") - 1e-6).cast("int"))

    asked = off.where("size(rest) > 0").join(bins, "pivot").withColumn("need", F.array_min(F.transform(F.filter("bins", fits), need)))
    asked = asked.where(F.col("need") <= F.size("rest"))
    rows = asked.select("node", *_FACTS, F.size("rest").alias("m"), F.posexplode(F.slice("rest", F.lit(1), F.size("rest") - F.col("need") + 1)).alias("i", "x"))
    # Of a pair's common shingles, the first leaves `left` for all of them.
    return rows.select(F.col("x.h").alias("h"), "node", *_FACTS, (F.col("m") - F.col("i")).alias("left"))


_FACTS = ["component", "sim", "on", "total", "extra", "hot", "part", "off", "off_extra"]


def _pairs_off_core(off: DataFrame) -> DataFrame:
    """u, v of different components with a common shingle off the core of a pivot
    of both, unless they have too few of them.

    A pair at L has common counts x >= (total(u) + total(v)) / (1 + 1/L) - extra(v) in
    u (from 1/p + 1/q <= 1 + 1/L and y <= x + extra(v)), so at least x - extra(u)
    common shingles, of which the core has at most on(u)."""
    rows = materialize(_rows_off_core(off))
    side = lambda n, s: rows.select("h", F.col("node").alias(n), *[F.col(c).alias(f"{c}_{s}") for c in (*_FACTS, "left")])
    enough = F.least("on_a", "on_b") + F.least("left_a", "left_b") + F.col("extra_a") + F.col("extra_b") + 1e-6 >= (F.col("total_a") + F.col("total_b")) / (1 + 1 / LEAST)
    near = F.abs(F.col("sim_a") - F.col("sim_b")) <= 1 - LEAST + _EPS
    return side("u", "a").join(side("v", "b"), "h").where(F.expr("u < v and component_a != component_b") & enough & near & _coarse(F.least("hot_a", "hot_b") + F.least("left_a", "left_b"))).select("u", "v")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, node, class_id (the least doc_id of
    its class) and n_links (verified links of its text to other texts, of those
    that had to be compared)."""
    return _classes(docs)


def _classes(docs: DataFrame, *also: str) -> DataFrame:
    """near_duplicate_classes() and, if asked for, `component`: the class itself,
    whatever its ids (null for texts without words)."""
    prepare(docs.sparkSession)
    signed = materialize(_signed(docs))
    nodes = signed.where("n_words > 0")
    # One row per node and band.  Copies carry the same bands: the aggregation joins them before the shuffle.
    members = materialize(nodes.select("node", F.explode("bands").alias("key")).groupBy("key", "node").agg(F.lit(1).alias("one")).select("key", "node"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(members.join(sizes, "key"))
    discard(members)
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    pivots = met.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))
    shared = materialize(met.join(pivots, "key").select("key", "node", "pivot"))
    discard(met)
    star = materialize(shared.where("node != pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct())
    wanted = star.select(F.col("u").alias("node")).unionAll(star.select(F.col("v").alias("node"))).distinct()
    ids = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    table = materialize(_shingle_table(docs, ids.join(wanted, "node")))
    compared = materialize(_similarities(star, table, rest=True))
    discard(star)
    comp = materialize(components(_similar(compared)))

    placed = materialize(shared.join(comp, "node", "left").select("key", "node", "pivot", F.coalesce("component", "node").alias("component")))
    discard(shared, comp)
    open_ = placed.join(_mixed(placed, "key"), "key", "left_semi")
    # A pivot was compared with all of its bucket: it takes no further part there.
    open_ = open_.where("node != pivot").select("pivot", "node", "component").distinct()
    off = materialize(_off_core(open_, compared))
    discard(placed)
    rest = _pairs_on_core(off).unionAll(_pairs_off_core(off)).distinct()
    more = materialize(_similarities(rest, table))
    discard(off, table)
    links = _similar(compared).unionAll(_similar(more)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    comp = components(links)

    degree = links.select(F.col("u").alias("node")).unionAll(links.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    named = ids.join(comp, "node", "left").join(degree, "node", "left")
    named = named.select("node", "doc_id", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    named = materialize(named.join(least, "component").select("node", "class_id", "n_links", *also))
    discard(compared, more)
    out = signed.select("doc_id", "node", "n_words").join(named, "node", "left")
    return out.select("doc_id", "node", F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *also)


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least id; all columns as they
    are.  Of rows with that id, null too, one stays; texts without words all stay."""
    least = _classes(docs, "component").where("doc_id <=> class_id")
    best = least.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("b")).select("b.doc_id", "b.node")
    classes = best.unionAll(least.where("component is null").select("doc_id", "node")).distinct().select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))

    @F.pandas_udf("binary")
    def node(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: node_of((t or "").encode()))

    empty = node_of(b"")
    own, salt = free_names(docs, "own", "salt")
    rows = docs.withColumn(own, node(docs["text"]))
    kept = rows.join(classes, rows["doc_id"].eqNullSafe(classes["_id"]) & (rows[own] == classes["_node"]), "left_semi")
    kept = kept.withColumn(salt, F.when(F.col(own) == F.lit(empty), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return kept.dropDuplicates(["doc_id", own, salt]).drop(own, salt)
