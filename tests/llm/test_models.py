"""Held-out accuracy and defined results of the trained operators, and the edit
matching of benchmark items."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.odd import empty_docs, odd_docs
from textloom.llm import decontaminate, language, quality_model, toxicity


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def bigger():
    return "/root/testdata/sf0.01"


# --- language ---
def test_language_held_out(spark, bigger):
    docs = spark.read.parquet(f"{bigger}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.op3(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in judged]) > 0.95


def test_bulk_posteriors_are_those_of_the_recursion():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 5, 31, 32, 33, 200]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    e, t = rng.normal(size=(ends[-1], 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    got = language.bulk_posteriors(e, ends, t)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if a < b:
            want, _ = language._posteriors(e[None, a:b], t)
            assert np.allclose(got[a:b], want[0], atol=1e-4)


def test_language_code_switch(spark):
    en, de = "the house and the garden with all of them", "das haus und der garten mit allen von ihnen"
    samples = [(" ".join(random.Random(i).sample((en if i % 2 else de).split(), 8)), "en" if i % 2 else "de") for i in range(80)]
    model = language.train(samples, steps=80)
    runs = language.Predictor(model).runs([f"{en} {de}".encode()])[0]
    assert [r["lang"] for r in runs] == ["en", "de"] and runs[0]["end_word"] in (8, 9, 10)


def test_language_odd(spark):
    df = odd_docs(spark)
    rows = language.op3(df).collect()
    assert len(rows) == df.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 3))
    assert language.op3(empty_docs(spark)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.op3(unlabelled).collect()} == {"und"}
    kept = language.keep_identified(df, language.fit(df, F.lit(True)))
    assert kept.columns == df.columns and not {0, 1, 2, 3} & {r.doc_id for r in kept.collect()}


# --- quality and toxicity ---
def test_quality_held_out(spark, bigger):
    docs, labels = (spark.read.parquet(f"{bigger}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    rows = quality_model.op2(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.predicted == int(r.score >= 0.5) and r.held_out == (crc(r.doc_id, 3) == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.8


def test_toxicity_finds_labelled(spark, bigger):
    docs, labels = (spark.read.parquet(f"{bigger}/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = toxicity.fit(docs, labels.where(half))
    truth = {r.doc_id: r.toxic for r in labels.where(~half).collect() if r.toxic is not None}
    rows = [r for r in toxicity.score(docs, model).collect() if r.doc_id in truth]
    assert np.mean([r.toxic == (truth[r.doc_id] > 0) for r in rows]) > 0.9
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.grade <= 3 for r in rows)
    assert list(model.ordinal.theta) == sorted(model.ordinal.theta)


def test_models_odd(spark):
    df = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (6, 0, 0), (7, None, None), (None, 1, 1), (8, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.op2(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.where("false")
    assert {r.score for r in quality_model.op2(df, none).collect()} == {0.5}
    scored = toxicity.score(df, toxicity.fit(df, labels))
    assert scored.count() == df.count()
    assert {r.expected_severity for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.0}
    for d in (empty_docs(spark),):
        assert quality_model.op2(d, labels).count() == 0 and toxicity.score(d, toxicity.fit(d, labels)).count() == 0


def test_word_vectors_are_sums_over_neighbours(spark):
    texts = ["alpha beta gamma", "beta beta", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place, sign = quality_model.index_vectors()
    total = np.zeros((quality_model.BUCKETS, quality_model.WIDTH))
    for t in texts:
        u, _ = quality_model.unit_stream([(t or "").encode()], quality_model.TokenUnits())
        for x, y in zip(u, u[1:]):
            for a, b in ((x, y), (y, x)):
                np.add.at(total[a], place[b], sign[b])
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    got = quality_model.word_vectors(df)
    assert ((np.abs(got).sum(1) > 0) == (np.abs(total).sum(1) > 0)).all()


def test_word_vectors_brute(spark):
    """The whole table by definition: sums over neighbours, length one, centred by the
    logarithm of the sums' sizes, length one again."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta,", "Beta", "beta", "GAMMA!", "12", "--"]) for _ in range(rng.randint(0, 30))) for _ in range(25)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    place, sign = quality_model.index_vectors()
    total = np.zeros((quality_model.BUCKETS, quality_model.WIDTH))
    for t in texts:
        units, last = [], None
        for w in (t or "").encode().split():
            shape, word = quality_model.token_units(w)
            units += [quality_model._REPEAT if w == last else shape, word]
            last = w
        for x, y in zip(units, units[1:]):
            for a, b in ((x, y), (y, x)):
                for k in range(quality_model.NONZERO):
                    total[a, place[b, k]] += sign[b, k]
    size = np.linalg.norm(total, axis=1)
    used = size > 0
    want = total / np.maximum(size, 1e-9)[:, None]
    weight = np.log1p(size[used])
    want[used] -= (want[used] * weight[:, None]).sum(0) / weight.sum()
    want[used] /= np.maximum(np.linalg.norm(want[used], axis=1), 1e-9)[:, None]
    vectors = quality_model.word_vectors(df)
    assert used.sum() > 10 and np.allclose(vectors, want, atol=1e-5)
    pooled = {r.doc_id: r.pooled for r in quality_model.pool(df, vectors).collect()}
    for i, t in enumerate(texts):
        own, last = [], None
        for w in (t or "").encode().split():
            shape, word = quality_model.token_units(w)
            own.append((quality_model._REPEAT if w == last else shape, word))
            last = w
        parts = []
        for k in (0, 1):
            v = np.array([vectors[u[k]] for u in own]).reshape(-1, quality_model.WIDTH)
            parts += [v.mean(0), v.std(0)] if len(v) else [np.zeros(quality_model.WIDTH)] * 2
        assert np.allclose(pooled[i], np.concatenate(parts), atol=1e-4)


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 6))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality_model.Network(x[:3000], y[:3000])
    p = net(x[3000:])
    for lo in (0.0, 0.25, 0.5, 0.75):
        on = (p >= lo) & (p < lo + 0.25)
        assert abs(p[on].mean() - y[3000:][on].mean()) < 0.1


def test_paths_by_enumeration():
    """Posteriors of short sequences from the weights of every path."""
    import itertools

    rng = np.random.default_rng(1)
    for size in (1, 2, 4, 6):
        e, t = rng.normal(size=(size, 3)), rng.normal(size=(3, 3))
        gamma, pairs, total = np.zeros((size, 3)), np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=size):
            # The chain starts from a state drawn evenly, whose move to the first word counts.
            start = np.exp(t[:, path[0]]).sum()
            w = start * np.exp(sum(e[i, k] for i, k in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, k in enumerate(path):
                gamma[i, k] += w
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w
        got, xi = language._posteriors(e[None], t)
        assert np.allclose(got[0], gamma / total) and np.allclose(xi, pairs / total)
        bulk = language.bulk_posteriors(e.astype(np.float32), np.array([0, size]), t.astype(np.float32), chunk=2)
        assert np.allclose(bulk, gamma / total, atol=1e-4)


def test_sample_has_every_language(spark):
    rows = [(i, f"text number {i} " * 50, f"l{i % 9}") for i in range(90)] + [(5, "another text of the same id", "l5"), (None, "no id", "l0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(df, F.lit(True), most=12, most_chars=10).langs == [f"l{i}" for i in range(9)]
    assert language.fit(df, F.col("lang") == "l3").langs == ["l3"]


def test_ordinal_goes_down_the_likelihood():
    """The fitted model beats its neighbours in the penalised likelihood written out."""
    rng = np.random.default_rng(4)
    x = (rng.random((300, 5)) < 0.4) * rng.normal(1, 0.2, (300, 5))
    grade = np.clip(np.digitize(x @ [2, 1, -1, 0.5, 0] + rng.logistic(size=300), [0.5, 1.5, 2.5]), 0, 3)
    row, col = np.nonzero(x)
    model = toxicity.Ordinal(5, 4)
    model.fit(row, col, x[row, col], grade, steps=3000, rate=0.02)

    def loss(w, theta):
        above = np.concatenate([np.ones((300, 1)), 1 / (1 + np.exp(-(x @ w)[:, None] + theta)), np.zeros((300, 1))], 1)
        return -np.log(above[np.arange(300), grade] - above[np.arange(300), grade + 1]).mean() + 1e-4 * (w * w).sum()

    best = loss(model.w, model.theta)
    assert (np.diff(model.theta) > 0).all() and np.allclose(model.above(x @ model.w), 1 / (1 + np.exp(-(x @ model.w)[:, None] + model.theta)))
    for i in range(5):
        for d in (-0.05, 0.05):
            w = model.w.copy()
            w[i] += d
            assert loss(w, model.theta) > best - 1e-6
    for j in range(3):
        for d in (-0.05, 0.05):
            theta = model.theta.copy()
            theta[j] += d
            assert loss(model.w, theta) > best - 1e-6


# --- decontamination ---
def best_distance(item, text):
    """The least edit distance of the item to any run of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(4)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(a, b))) for a, b in ((1, 12), (0, 40)))
        assert decontaminate.myers(p, t)[0] == min(best_distance(p, t), len(p))


def test_decontaminate_brute(spark):
    rng = random.Random(6)
    items = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(n)) for n in (5, 9, 15, 40, 80)] + [None, "short", ""]
    texts = []
    for _ in range(60):
        own = list(rng.choice([x for x in items if x and len(x) > 20]))
        for _ in range(rng.randint(0, 14)):
            i = rng.randrange(len(own))
            own[i : i + 1] = rng.choice([[], ["z"], [own[i], "y"]])
        texts.append(" ".join(f"v{rng.random()}" for _ in range(rng.randint(0, 9))) + "\n " + "".join(own).upper() + " end")
    df = odd_docs(spark, texts)
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_contamination(df, bench).collect()}
    want = {}
    for r in df.collect():
        t = decontaminate.normalise(r.text or "")
        for i, x in enumerate(items):
            x = decontaminate.normalise(x or "")
            if len(x) >= 32 and len(t) < 5000 and (d := best_distance(x, t)) <= decontaminate.budget(len(x)):
                want[r.doc_id, i] = d
    assert got == want and len(want) > 15
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in df.collect()} - {i for i, _ in want}
    none = bench.where("false")
    assert decontaminate.find_contamination(df, none).count() == 0 and decontaminate.drop_contaminated(df, none).count() == df.count()
    assert decontaminate.find_contamination(empty_docs(spark), bench).count() == 0


def test_short_items(spark, tmp_path):
    import corpus_pipeline
    from textloom.llm.queries import QUERIES

    texts = ["We ask: WHO wrote\n it? Then more", "nobody who wrote items", "café and art", "cafe\u0301 too", "an artist", "東京大学へ", "1,2 art", None, "é é art_x art"]
    items = ["who wrote it", "art", "cafe", "大学", "?", "", None, "é", "art"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.item_id, r.distance, r.span_start, r.span_end) for r in QUERIES["op4_decontaminate"](spark, str(tmp_path)).collect())
    assert got == [(0, 0, 0, 8, 20), (0, 4, 0, 20, 21), (2, 1, 0, 9, 12), (2, 8, 0, 9, 12), (5, 3, 0, 2, 4), (6, 1, 0, 4, 7), (6, 8, 0, 4, 7), (8, 1, 0, 10, 13), (8, 7, 0, 0, 1), (8, 8, 0, 10, 13)]
    kept = corpus_pipeline.drop_benchmark(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 7}


def test_sums_of_units_count_the_frequent_ones():
    """Like plain sums in double precision, exactly so for frequent units, and without a
    row for every unit in memory."""
    import tracemalloc

    rng = np.random.default_rng(4)
    both = rng.normal(size=(quality_model.BUCKETS, 2 * quality_model.WIDTH)).astype(np.float32)
    ends = np.cumsum([1, 700, 3, *[4000] * 100])
    starts = np.concatenate([[0], ends[:-1]])
    few = rng.integers(0, 300, ends[-1])
    many = np.where(rng.random(ends[-1]) < 0.5, few, rng.integers(0, quality_model.BUCKETS, ends[-1]))
    for units, off in ((few, 1e-9), (many, 1e-3)):
        want = np.stack([both[units[a:b]].sum(0, dtype=np.float64) for a, b in zip(starts, ends, strict=True)])
        tracemalloc.start()
        got = quality_model._sums(both, units, starts, ends)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.abs(got - want).max() < off and peak < 60e6
