"""Work that must not grow faster than its input, held by plans and by large rows."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_goldens import docs_of
from textloom.functions import streams
from textloom.operators import cbow, counting, embeddings, index, language_model, overlap, pattern_search, tfidf


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- TF-IDF (F1, F3, F22, F23, F24) ---
def test_rows_of_documents_are_shuffled_once(spark):
    d = docs_of(spark, ["x y y", "x q"])
    for df in (tfidf.weights(d), tfidf.weights(d, domain=("x",))):
        plan = plan_of(df)
        assert "hashpartitioning(doc_id" not in plan and "SortMergeJoin" not in plan
    assert plan_of(tfidf.norms(tfidf.weights(d))).count("hashpartitioning(doc_id") == 1


def test_unit_vector_of_a_long_document(spark):
    """Its norm is worked out once, not once for each term (before: a square of them)."""
    d = docs_of(spark, [" ".join(f"w{i}" for i in range(12_000)), "w1 z"])
    start = time.perf_counter()
    rows = {r.doc_id: r for r in tfidf.unit_vectors(tfidf.weights(d)).collect()}
    assert time.perf_counter() - start < 10
    assert len(rows[0].terms) == 11_999 and sum(x * x for x in rows[0]["values"]) == pytest.approx(1)
    assert rows[0].terms == sorted(rows[0].terms)


def test_neighbours_in_chunks(spark):
    """Common and rare terms, any chunks and any blocks give what all pairs give."""
    rng = np.random.default_rng(1)
    words = [f"t{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12), p=np.r_[[0.2] * 3, [0.4 / 37] * 37])) for _ in range(90)] + ["t5 t6", "t5 t6", "q"]
    vectors = tfidf.unit_vectors(tfidf.weights(docs_of(spark, texts)))
    v = {r.doc_id: dict(zip(r.terms, r["values"], strict=True)) for r in vectors.collect()}
    asked = docs_of(spark, texts).where("doc_id % 3 = 0").select("doc_id")
    want = {}
    for q in (i for i in v if i % 3 == 0):
        sims = {i: round(sum(x * v[i].get(t, 0) for t, x in v[q].items()), 12) for i in v if i != q}
        want[q] = [(i, s) for i, s in sorted(sims.items(), key=lambda x: (-x[1], x[0]))[:4] if s > 0]
    for numbers in (1 << 21, 30):
        got = {}
        for r in sorted(tfidf.cosine_neighbours(vectors, asked, 4, numbers).collect(), key=lambda r: r.rank):
            got.setdefault(r.query_id, []).append((r.doc_id, pytest.approx(r.similarity, abs=1e-9)))
        assert got == {q: x for q, x in want.items() if x}


def test_proportional_documents_without_exploding(spark):
    d = docs_of(spark, ["e p q", "e r", "e s", "e q p q p e", "e p q p q", "e"])
    assert tfidf._everywhere(tfidf._kept(d), counting_tokens) == ["e"]
    assert tfidf._proportional(d, counting_tokens) == (0, 3)
    assert tfidf._proportional(docs_of(spark, ["e p q", "e p p q"]), counting_tokens) is None
    assert tfidf._proportional(docs_of(spark, ["e p q", "x p", "", "x x p p"]), counting_tokens) == (1, 3)


def counting_tokens(column):
    from textloom.functions.text import tfidf_tokens

    return tfidf_tokens(column)


def test_counts_in_slices(spark):
    import pyarrow as pa

    rb = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a", "b"], [], ["a"], None, ["c"] * 9, ["d"]])], names=["i", "t"])
    for batch, want in ((rb, [[0, 1, 2, 3], [4], [5]]), (rb.slice(1), [[1, 2, 3], [4], [5]])):
        assert [p.column(0).to_pylist() for p in counting.slices(batch, most=3)] == want
    d = docs_of(spark, ["x y y", "", "x q", "x x x x x w"])
    got = {tuple(r) for r in counting.document_counts(d, counting_tokens(F.col("text"))).collect()}
    assert got == {(0, "x", 1, 3), (0, "y", 2, 3), (2, "x", 1, 2), (2, "q", 1, 2), (3, "x", 5, 6), (3, "w", 1, 6)}
    assert {tuple(r) for r in counting.document_frequencies(d, counting_tokens(F.col("text"))).collect()} == {("x", 3), ("y", 1), ("q", 1), ("w", 1)}


# --- codes and posting lists (F2, F5, F12, F15, F18, F19, F20) ---
@pytest.mark.parametrize("code", ["unary", "gamma", "fibonacci"])
def test_streams_like_single_codes(code):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    most = 40 if code == "unary" else 1 << 62
    lists = [[int(n) for n in np.exp(rng.uniform(0, np.log(most), rng.integers(0, 9))).astype(np.int64)] for _ in range(60)] + [[], [1], [1, 1, 1], [most]]
    flat = np.array([n for x in lists for n in x], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    bits = streams.encode(flat, offsets, code)
    for x, got in zip(lists, bits.to_pylist(), strict=True):
        at, back = 0, []
        while at < len(got):
            n, at = index.DECODERS[code](got, at)
            back.append(n)
        assert back == x
    for column, want in ((bits, lists), (bits.slice(3), lists[3:])):
        values, counts, whole = streams.decode(column, code)
        assert whole.all() and counts.tolist() == [len(x) for x in want] and values.tolist() == [n for x in want for n in x]
    assert streams.lengths(flat, code).tolist() == [len(streams.code_of(int(n), code)) for n in flat]
    assert streams.encode(flat[:0], np.zeros(3, np.int64), code).to_pylist() == ["", ""]
    good = streams.code_of(5, code)
    values, counts, whole = streams.decode(pa.array([good + good[:-1], None, good, "1", "0" if code == "fibonacci" else good]), code)
    assert counts[2] == 1 and values[0] == 5 and whole.tolist()[:4] == [False, True, True, False]


def test_codes_of_segments_are_short(spark):
    """A segment's first code counts from the segment's start (before: from 0, a unary
    code as long as the id)."""
    p = spark.createDataFrame([("x", 5_000_000, 1), ("x", 5_000_003, 1), ("y", 0, 1), ("y", 127, 1)], "term string, doc_id long, tf long")
    lists = index.list_segments(p, segment=128)
    for code in ("unary", "gamma", "fibonacci"):
        coded = index.encoded_lists(lists, code, 128)
        assert max(len(r.bits) for r in coded.collect()) <= 129
        got = {(r.term, r.seg): r.gaps for r in index.decoded_lists(coded, code, 128).collect()}
        assert got == {("x", 39062): [5_000_001, 3], ("y", 0): [1], ("y", 1): [128]}


def test_lists_of_documents_like_lists_of_postings(spark):
    """Texts go out as lists of slices: the rows of single postings are not shuffled."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(300).tolist()
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "rare" + "abcdefghij"[i % 10]], 6))) for i in ids]
    docs = spark.createDataFrame([*rows, (400, None), (401, "")], "doc_id long, text string").repartition(7)
    p = index.postings(docs)
    for segment in (16, 1 << 20):
        want = sorted(map(tuple, index.gap_rows(p, segment=segment).collect()))
        df = index.document_gaps(docs, segment=segment)
        assert sorted(map(tuple, df.collect())) == want
        assert "hashpartitioning(term#" in (plan := plan_of(df)) and ", doc_id#" not in plan[plan.index("hashpartitioning") :].split("\n")[0]
        counts = {}
        for _, _, gap in want:
            counts[gap] = counts.get(gap, 0) + 1
        assert {r.gap: r.cnt for r in index.gap_counts(docs, segment=segment).collect()} == counts
        assert index.document_code_sizes(docs, segment=segment).first() == index.code_sizes(index.gap_rows(p, segment=segment)).first()
        lists = {(r.term, r.seg): r.ids for r in index.document_segments(docs, segment).collect()}
        assert lists == {(r.term, r.seg): r.ids for r in index.list_segments(p, segment=segment).collect()}


# --- language model (F6 to F10, F14, F16, F17) ---
def _corpus(spark, n=120, words=9, seed=4):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{i}" for i in np.minimum(rng.geometric(0.3, rng.integers(0, 14)), words)) for _ in range(n)]
    return docs_of(spark, [*texts, "", "w1", "w1 w2", "w3 w3 w3 w3", "Ž1 ž1"]).unionAll(spark.createDataFrame([(999, None)], "doc_id long, text string")).repartition(5)


@pytest.mark.parametrize(("n", "alpha"), [(1, 0.0), (1, 1.0), (2, 0.0), (2, 1.0), (3, 0.5), (4, 1.0)])
def test_own_perplexity_like_the_model(spark, n, alpha):
    """Sums by n-grams and by prefixes give what the joined model gives, without its
    strings in a shuffle."""
    d = _corpus(spark)
    want = {r.doc_id: (r.n_grams, pytest.approx(r.perplexity, rel=1e-9)) for r in language_model.perplexity(d, language_model.probabilities(d, n, alpha), n).collect()}
    df = language_model.own_perplexity(d, n, alpha)
    assert {r.doc_id: (r.n_grams, r.perplexity) for r in df.collect()} == want
    assert "hashpartitioning(prefix" not in plan_of(df) and "hashpartitioning(doc_id#" in plan_of(df)


def test_frequencies_like_plain_counts(spark):
    d = _corpus(spark)
    for n in (1, 2, 3):
        plain = {}
        for r in language_model.occurrences(d, n).collect():
            cnt, first = plain.get((r.prefix, r.next), (0, 1 << 62))
            plain[r.prefix, r.next] = (cnt + 1, min(first, (r.doc_id << 24) | r.pos))
        got = {(r.prefix, r.next): (r.cnt, r.first_pos) for r in language_model.frequencies(d, n).collect()}
        assert got == plain
        order = [" ".join(filter(None, g)) for g in sorted(plain, key=lambda g: (-plain[g][0], plain[g][1]))]
        assert [r.gram for r in language_model.top_grams(d, n, 7).collect()] == order[:7]
        assert [r.gram for r in language_model.top_grams(d, n, 7, most=6).collect()] == order[:7]
        before = {}
        for r in language_model.occurrences(d, max(1, n - 1)).collect():
            g = f"{r.prefix} {r.next}".strip()
            before[g] = before.get(g, 0) + 1
        if n > 1:
            assert {(r.prefix, r.next): r.prob for r in language_model.probabilities(d, n).collect()} == {g: c / before[g[0]] for g, (c, _) in plain.items()}
    plan = plan_of(language_model.probabilities(d, 3, 1.0))
    assert plan[: plan.index("== Initial") if "== Initial" in plan else None].count("hashpartitioning(prefix") == 1


def test_likeliest_words(spark):
    d = _corpus(spark)
    want = {tuple(r) for r in language_model.next_words(language_model.probabilities(d, 2)).collect()}
    assert {tuple(r) for r in language_model.likeliest_words(d).collect()} == want


def test_start_perplexities(spark):
    d, models = _corpus(spark), ((1, 0.0), (2, 1.0), (3, 1.0))
    for first in (1, 2, 50, 10_000):
        want = [(n, *language_model.corpus_perplexity(d, language_model.probabilities(d, n, a), n, first).first()) for n, a in models]
        got = language_model.start_perplexities(d, models, first)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert language_model.start_perplexities(docs_of(spark, ["", "!"]), models) == [(1, 0, np.inf), (2, 0, np.inf), (3, 0, np.inf)]


def test_generated_without_model_rows(spark):
    d = _corpus(spark)
    two, three = (language_model.probabilities(d, n, 1.0).cache() for n in (2, 3))
    start = language_model.top(language_model.frequencies(d, 1), 1).first().gram
    assert language_model.generated(d, [0, 5], 8) == [language_model.generate(two, three, start, 8, s) for s in (0, 5)]
    assert language_model.generated(docs_of(spark, ["", "a"]), [1]) == [["a"]]


# --- CBOW and nearest vectors (F4, F11, F13, F21) ---
def test_descent_like_the_step_by_hand():
    """Contexts one after another; no Python work for each pair."""
    rng = np.random.default_rng(5)
    contexts, targets = [rng.integers(0, 7, rng.integers(1, 5)) for _ in range(20)], rng.integers(0, 7, 20)
    a, b = cbow.Model(7, 3), cbow.Model(7, 3)
    a.e, b.e = (rng.normal(size=(7, 3)) for _ in range(2))
    b.e[:] = a.e
    n = len(targets)
    hidden = np.stack([b.e[c].mean(0) for c in contexts])
    p = np.exp(hidden @ b.w + b.b)
    p /= p.sum(1, keepdims=True)
    right = p[np.arange(n), targets].copy()
    p[np.arange(n), targets] -= 1
    back = p / n @ b.w.T
    for c, g in zip(contexts, back, strict=True):
        for x in c:
            b.e[x] -= 0.1 * g / len(c)
    b.w -= 0.1 * hidden.T @ p / n
    b.b -= 0.1 * p.sum(0) / n
    loss, total = a.descend(np.concatenate(contexts), np.array([len(c) for c in contexts]), targets, 0.1)
    assert np.allclose(a.flat(), b.flat()) and loss == pytest.approx(-np.log(right + 1e-9).sum()) and total == pytest.approx(right.sum())


def test_nearest_holds_little():
    """A task's memory does not grow with the queries' cells (before: copies of 4 million)."""
    import tracemalloc

    rng = np.random.default_rng(6)
    best = counting.Best(2000, 5, -np.inf, 1 << 18)
    everything = []
    tracemalloc.start()
    for a in range(0, 1300, 130):
        sims = np.round(rng.normal(size=(130, 2000)), 1)
        everything.append(sims)
        best.offer(np.arange(a, a + 130)[::-1], sims)
    best.judge()
    assert tracemalloc.get_traced_memory()[1] < 10 * 130 * 2000 * 8 + 60e6
    tracemalloc.stop()
    whole = np.concatenate([x[::-1] for x in everything])
    for q in (0, 17, 1999):
        want = np.argsort(-whole[:, q], kind="stable")[:5]
        own = best.kept[0] == q
        assert best.kept[1][own].tolist() == want.tolist() and best.kept[2][own].tolist() == whole[want, q].tolist()


def test_nearest_of_names_and_ties(spark):
    rows = [(f"n{i:02}", [float(i % 3), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "name string, vec array<float>").repartition(4)
    got = sorted(map(tuple, embeddings.nearest(df, df.where("name < 'n02'"), 4, "name", "vec").collect()), key=lambda r: (r[0], r[3]))
    assert [r[1] for r in got] == ["n03", "n06", "n09", "n12", "n04", "n07", "n10", "n13"] and all(r[2] == 1.0 for r in got)


# --- patterns and overlap (F25, F26) ---
def test_patterns_hold_few_texts():
    """Texts become Python strings a part at a time (before: a whole batch of them)."""
    import pyarrow as pa

    rb = pa.RecordBatch.from_arrays([pa.array(range(1001)), pa.array(["a"] * 1001)], names=["i", "t"])
    sizes = [p.num_rows for p in pattern_search._parts([rb, rb.slice(0, 0), rb.slice(1000)])]
    assert sizes == [250] * 4 + [1, 1]


def test_overlap_in_place(spark):
    """Pairs are counted where they are, each row by itself: no shuffle of n-grams."""
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("aab bc.c") for _ in range(rng.randint(1, 12)))
    rows = [(i // 2, text(), text()) for i in range(80)] + [(90, "x", "?"), (91, " ", "x"), (92, None, "x"), (93, "x y", "x y"), (94, "é", "é")]
    pairs = spark.createDataFrame(rows, "k int, reference string, prediction string").repartition(3)
    df = overlap.scores_of(pairs, ["k"])
    assert "hashpartitioning" not in plan_of(df)
    want = []
    for k, r, p in rows:
        if (r or "").strip() and p.strip():
            got = [k]
            for n in (1, 2):
                a, b = ([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for w in (re.findall("[a-z0-9]+", x) for x in (r, p)))
                both = sum((Counter(a) & Counter(b)).values())
                x, y = both / len(b) if b else 0.0, both / len(a) if a else 0.0
                got += [x, y, 2 * x * y / (x + y) if both else 0.0]
            want.append(tuple(got))
    assert sorted(map(tuple, df.collect())) == sorted(want)
