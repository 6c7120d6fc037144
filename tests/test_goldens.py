"""Small cases with results known by reasoning, and plain restatements of the rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import codes, sequences, stemming, text
from textloom.operators import cbow, embeddings, index, language_model, overlap, pattern_search, spelling, tfidf
from textloom.plans import boolean
from textloom.sources import text as sources
from textloom.streaming import counts

SEVEN = [
    "informace vyhledávání",
    "systém web",
    "vyhledávání dat vyhledávání",
    "data analýza",
    "data data index informace",
    "dokument text",
    "systém informace",
]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def column(spark, value, expr):
    return spark.createDataFrame([(value,)], "v " + ("long" if isinstance(value, int) else "string")).select(expr(F.col("v"))).first()[0]


# --- codes ---
def test_code_goldens(spark):
    want = {"unary": {5: "11110"}, "gamma": {1: "0", 5: "11001", 8: "1110000", 11: "1110011"}, "fibonacci": {1: "11", 2: "011", 4: "1011", 11: "001011", 65: "0100100011"}}
    for code, pairs in want.items():
        for n, bits in pairs.items():
            assert column(spark, n, codes.ENCODERS[code]) == bits
    assert column(spark, 0, codes.gamma) is None


def test_codes_round_trip(spark):
    rows = spark.range(1, 3000).select("id", codes.unary(F.col("id")).alias("u"), codes.gamma(F.col("id")).alias("g"), codes.fibonacci(F.col("id")).alias("f")).collect()
    for r in rows:
        for code, bits in (("unary", r.u), ("gamma", r.g), ("fibonacci", r.f)):
            assert index.DECODERS[code](bits, 0) == (r.id, len(bits))
        assert "11" not in r.f[:-2]
    ids = spark.createDataFrame([([3, 5, 20],)], "ids array<long>").select(codes.gaps(F.col("ids")).alias("g"))
    assert ids.first().g == [3, 2, 15]
    assert ids.select(codes.decode_unary(codes.encode_list(F.col("g"), "unary"))).first()[0] == [3, 2, 15]
    assert ids.select(codes.decode_fibonacci(codes.encode_list(F.col("g"), "fibonacci"))).first()[0] == [3, 2, 15]
    assert ids.select(codes.decode_gamma(codes.encode_list(F.col("g"), "gamma"))).first()[0] == [3, 2, 15]


def test_codes_of_large_numbers(spark):
    big = [1, 2, 3, (1 << 31) - 1, 1 << 31, (1 << 40) + 12345, (1 << 62) + 7, (1 << 63) - 1]
    rows = spark.createDataFrame([(n,) for n in big], "n long").select("n", codes.gamma(F.col("n")).alias("g"), codes.fibonacci(F.col("n")).alias("f"), codes.gamma_length(F.col("n")).alias("gl"), codes.fibonacci_length(F.col("n")).alias("fl")).collect()
    for r in rows:
        assert index.DECODERS["gamma"](r.g, 0) == (r.n, len(r.g)) and index.DECODERS["fibonacci"](r.f, 0) == (r.n, len(r.f))
        assert (r.gl, r.fl) == (len(r.g), len(r.f)) and "11" not in r.f[:-2]
    assert column(spark, 1 << 31, codes.unary) is None and column(spark, 0, codes.fibonacci_length) is None
    many = spark.createDataFrame([(big,)], "ids array<long>").select(codes.encode_list(F.col("ids"), "gamma").alias("g"), codes.encode_list(F.col("ids"), "fibonacci").alias("f"))
    assert many.select(codes.decode_gamma("g"), codes.decode_fibonacci(F.col("f"))).first()[:] == (big, big)


def test_membership(spark):
    p = spark.createDataFrame([("a", d) for d in (2, 4, 19)] + [("b", 0)], "term string, doc_id long")
    lists = index.posting_lists(p)
    wanted = spark.createDataFrame([("a", t) for t in range(1, 25)] + [("c", 1), ("b", 1)], "term string, target long")
    for code in codes.ENCODERS:
        got = {(r.term, r.target) for r in index.member_compressed(index.encoded_lists(lists, code), wanted, code).collect() if r.found}
        assert got == {("a", 3), ("a", 5), ("a", 20), ("b", 1)}
        cut = index.encoded_lists(index.list_segments(p, segment=4), code)
        got = index.member_compressed(cut, wanted, code, 4).collect()
        assert {(r.term, r.target) for r in got if r.found} == {("a", 3), ("a", 5), ("a", 20), ("b", 1)} and len(got) == 26
    assert not index.holds("11", 3, "gamma") and not index.holds("0000", 9, "fibonacci") and not index.holds(None, 1, "unary")
    gaps = {(r.term, r.doc_id): r.gap for r in index.gap_rows(p, segment=4).collect()}
    assert gaps == {("a", 3): 3, ("a", 5): 2, ("a", 20): 15, ("b", 1): 1}


# --- search ---
def naive_comparisons(t, p, kind):
    """The counts by their definitions, on small inputs."""
    n, m, c, at = len(t), len(p), 0, 0
    if kind == "brute_force":
        return sum(next((j + 1 for j in range(m) if t[i + j] != p[j]), m) for i in range(n - m + 1))
    if kind == "horspool":
        while at + m <= n:
            k = next((k for k in range(m) if t[at + m - 1 - k] != p[m - 1 - k]), m)
            c += min(k + 1, m)
            at += m if k == m else min([m - 1 - i for i in range(m - 1) if p[i] == t[at + m - 1]], default=m)
        return c
    # KMP, told by events: a look at a character in a state, ahead of time after a match
    border = lambda s: max((k for k in range(len(s)) if s[:k] == s[len(s) - k :]), default=0)
    state, ahead = 0, False
    for ch in t:
        if ahead and ch != p[state]:
            c += 1
            state, ahead = border(p[:state]), False
        while ch != p[state]:
            c += 2
            if state == 0:
                state = -1
                break
            state = border(p[:state])
        if state >= 0:
            c += 1
        state, ahead = state + 1, state >= 0
        if state == m:
            state, ahead = border(p), False
    return c


def test_kmp_by_the_book():
    """The count of the textbook loop, which looks ahead after each match."""

    def plain(t, p):
        border = [0] * (len(p) + 1)
        for q in range(2, len(p) + 1):
            border[q] = max(k for k in range(q) if p[:k] == p[q - k : q])
        i = j = cost = 0
        while i < len(t):
            cost, same = cost + 1, t[i] == p[j]
            i, j = i + same, j + same
            if j == len(p):
                j = border[j]
            elif i < len(t) and t[i] != p[j]:
                cost += 1
                i, j = (i, border[j]) if j else (i + 1, 0)
        return cost

    rng = random.Random(2)
    for _ in range(500):
        t, p = ("".join(rng.choice("abc") for _ in range(rng.randint(a, b))) for a, b in ((0, 40), (1, 6)))
        assert pattern_search.KmpCost(p).comparisons(t) == plain(t, p), (t, p)


def test_stored_index(spark, tmp_path):
    d = docs_of(spark, SEVEN)
    path = str(tmp_path / "index")
    index.store(index.postings(d), path, 4)
    for q in ("informace AND NOT data", "NOT informace", "data OR NOT web", "dokument", ""):
        assert {r.doc_id for r in boolean.find_stored(spark, path, d, q).collect()} == {r.doc_id for r in boolean.find(d, q).collect()}, q


def test_lookup_speed(spark):
    rows = index.lookup_speed(sources.random_postings(spark, 300, 500, 20_000), 2).collect()
    assert {r.list for r in rows} == {"short", "medium", "long"} and len(rows) == 48
    assert all(r.exists == r.found and r.seconds >= 0 for r in rows) and sum(r.exists for r in rows) == 36


def test_sequence_pieces(spark):
    df = spark.createDataFrame([(["a", "b", "q", ""],)], "t array<string>")
    find = text.lookup([("a", 5), ("b", 6)])
    got = df.select(text.encode_batch(F.col("t"), find, 6, ["b"]).alias("x")).first().x
    assert got.ids == [6, 5, 6, 1, 1, 0] and got.mask == [1, 1, 1, 1, 1, 0]
    assert df.select(sequences.padding_mask(F.array(F.lit(3), F.lit(0)))).first()[0] == [False, True]


def test_search_goldens(spark):
    d = docs_of(spark, ["aaaa", "AGCT" * 15, "b", None, ""])
    got = {r.doc_id: (r.positions, r.apart_positions) for r in pattern_search.search(d, "aa").collect()}
    assert got == {0: ([0, 1, 2], [0, 2])}
    dna = [r for r in pattern_search.comparisons(d, "AGCT").collect() if r.doc_id == 1][0]
    assert (dna.brute_force, dna.kmp, dna.horspool, dna.method, dna.hybrid) == (102, 60, 60, "horspool", 60)
    with pytest.raises(ValueError):
        pattern_search.search(d, "")
    rng = random.Random(1)
    for _ in range(300):
        t, p = ("".join(rng.choice("ab") for _ in range(rng.randint(a, b))) for a, b in ((0, 30), (1, 6)))
        assert pattern_search.brute_force_comparisons(t, p) == naive_comparisons(t, p, "brute_force")
        assert pattern_search.horspool_comparisons(t, p) == naive_comparisons(t, p, "horspool")
        assert pattern_search.KmpCost(p).comparisons(t) == naive_comparisons(t, p, "kmp"), (t, p)


# --- tokenizers and edits ---
def test_tokenizers(spark):
    t = "Dům, test1 vièle the Rock-and-Roll × x y 12"
    assert column(spark, t, text.word_tokens) == ["dům", "test1", "vièle", "the", "rock", "and", "roll", "x", "y", "12"]
    assert column(spark, t, text.index_tokens) == ["dům", "rock", "roll"]
    assert column(spark, t, text.tfidf_tokens) == ["dům", "test1", "vièle", "the", "rockandroll", "×", "x", "y", "12"]
    assert column(spark, t, text.cbow_tokens) == ["dům", "test1", "vile", "the", "rockandroll", "x", "y", "12"]
    assert column(spark, t, text.ngram_tokens) == ["dům", "test1", "vièle", "the", "rockandroll", "×", "x", "y", "12"]
    assert column(spark, "a\n" + "b" * 90, text.snippet) == "a " + "b" * 78 + "..."
    assert column(spark, "a", lambda c: text.ngrams(text.ngram_tokens(c), 2)) == []


@pytest.mark.parametrize("word", ["teh", "thhe", "adn", "a", ""])
def test_edit_variants(spark, word):
    alphabet = set("abcdefghijklmnopqrstuvwxyzáéíóúýčďěňóřšťžů")
    want = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    want |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    want |= {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    got = column(spark, word, text.edit_variants)
    assert len(got) == len(set(got)) and set(got) == want
    if len(word) > 2:
        assert len(got) == {3: 287, 4: 367}[len(word)]


def test_pad_and_shift(spark):
    df = spark.createDataFrame([([5, 6, 7],)], "x array<int>")
    assert df.select(text.pad_or_cut(F.col("x"), 5)).first()[0] == [5, 6, 7, 0, 0]
    assert df.select(text.pad_or_cut(F.col("x"), 2)).first()[0] == [5, 6]
    assert df.select(text.shift_right(F.col("x"))).first()[0] == [0, 5, 6]


# --- language model ---
def test_language_model(spark):
    d = docs_of(spark, ["a b a b c", "a c", "", "z"])
    model = {(r.prefix, r.next): r.prob for r in language_model.probabilities(d, 2).collect()}
    assert model == {("a", "b"): 2 / 3, ("b", "a"): 1 / 2, ("b", "c"): 1 / 2, ("a", "c"): 1 / 3}
    best = {r.prefix: r.next for r in language_model.next_words(language_model.probabilities(d, 2)).collect()}
    assert best == {"a": "b", "b": "a"}  # a stands before c after b
    smooth = language_model.probabilities(d, 2, 1.0)
    per = {r.doc_id: r.perplexity for r in language_model.perplexity(d, smooth, 2).collect()}
    p = {k: (2 * (k == ("a", "b")) + (k != ("a", "b")) + 1) / ({"a": 3, "b": 2}[k[0]] + 4) for k in model}
    want = math.exp(-(2 * math.log(p["a", "b"]) + math.log(p["b", "a"]) + math.log(p["b", "c"])) / 4)
    assert per[0] == pytest.approx(want) and per[2] == per[3] == math.inf
    # compat: a single word's "probability" is its count
    assert {r.next: r.prob for r in language_model.probabilities(d, 1).collect()}["a"] == 3
    assert sum(r.prob for r in language_model.probabilities(d, 1, corrected=True).collect()) == pytest.approx(1)
    two, three = language_model.probabilities(d, 2), language_model.probabilities(d, 3)
    out = language_model.generate(two, three, "a", seed=3)
    assert out == language_model.generate(two, three, "a", seed=3) and out[0] == "a" and out[1] in "bc"


# --- spelling ---
def test_spelling(spark):
    d = spelling.dictionary(docs_of(spark, ["the the then tea ten", "ten cat"]))
    words = spark.createDataFrame([("teh",), ("xxxxxx",), ("caat",)], "word string")
    best = {r.word: (r.correction, r.freq) for r in spelling.most_frequent(words, d).collect()}
    assert best == {"teh": ("ten", 2), "xxxxxx": (None, None), "caat": ("cat", 1)}  # ten before the
    near = {r.word: (r.correction, r.distance) for r in spelling.closest(words, d, block=2).collect()}
    assert near["teh"] == ("tea", 1) and near["caat"] == ("cat", 1) and near["xxxxxx"][1] == 6
    score = {r.variant: r.score for r in spelling.bigram_scores(spark.createDataFrame([("cat",), ("thx",), ("q",), ("qq",)], "variant string"), spelling.bigram_index(d)).collect()}
    assert score == {"cat": 0.0, "thx": -math.inf, "q": 0.0, "qq": 0.0}
    fixed = spelling.correct_sentences(spark.createDataFrame([(1, "Caat  teh, caat")], "sent_id int, text string"), spelling.most_frequent(words, d))
    assert fixed.first().text == "cat teh, cat"
    many = spelling.correct_sentences(spark.createDataFrame([(1, "Caat  teh, caat"), (2, " ")], "sent_id int, text string"), spelling.most_frequent(words, d), most=1)
    assert [tuple(r) for r in many.collect()] == [(1, "cat teh, cat")]
    likely = {r.word: (r.correction, r.score) for r in spelling.best_by_bigrams(words, spelling.bigram_index(d)).collect()}
    assert likely["caat"] == ("cat", 0.0) and likely["xxxxxx"][1] == 0.0


# --- boolean ---
def test_boolean_goldens(spark):
    d = docs_of(spark, SEVEN)
    find = lambda q, **k: {r.doc_id for r in boolean.find(d, q, **k).collect()}
    assert find("informace AND vyhledávání") == find("informace vyhledávání") == {0}
    assert find("informace OR systém") == {0, 1, 4, 6}
    assert find("NOT systém") == {0, 2, 3, 4, 5}
    assert find("(informace OR data) AND index") == {4}
    assert find("dokument AND NOT (systém OR web)") == {5}
    assert find("a NOT") == set(range(7)) and find("") == set()
    assert find("data AND NOT NOT index") == find("NOT data AND NOT index")
    for bad in ("informace NOT systém", "NOT NOT data", "(data OR index", "data)", "data AND", "AND"):
        with pytest.raises(boolean.QuerySyntaxError):
            boolean.parse(bad)
    for bad in ("a NOT", "a AND NOT NOT b"):
        with pytest.raises(boolean.QuerySyntaxError):
            boolean.parse(bad, strict=True)
    assert boolean.parse("rock-and-roll") == boolean.parse("rock AND roll")
    ranked = [(r.doc_id, r.score) for r in boolean.rank(d, "data", 10).collect()]
    idf = math.log10(7 / 2)
    assert ranked == [(4, pytest.approx((1 + math.log10(2)) * idf)), (3, pytest.approx(idf))]
    assert boolean.rank(d, "NOT systém").count() == 0 and boolean.rank(d, "NOT data AND NOT index").count() == 0
    # a term of every document has no members when ranked, so NOT of it is everything
    every = docs_of(spark, ["data index", "data", "data web"])
    assert {r.doc_id for r in boolean.rank(every, "web AND NOT data").collect()} == {2}
    assert boolean.find(every, "web AND NOT data").count() == 0


# --- TF-IDF ---
def test_tfidf_small(spark):
    d = docs_of(spark, ["x y y", "x q", "a i k", "", "x"])
    w = {(r.doc_id, r.term): r.w for r in tfidf.weights(d).collect()}
    assert w[0, "y"] == pytest.approx(2 / 3 * math.log(4)) and w[0, "x"] == pytest.approx(1 / 3 * math.log(4 / 3))
    assert {r.doc_id for r in tfidf.query_scores(d, "y y x").collect()} == {0, 1, 4}
    assert {r.doc_id: r.score for r in tfidf.query_scores(d, "q q", multiset=True).collect()}[1] == pytest.approx(math.log(4))
    assert tfidf.query_scores(d, "a i").count() == 0
    pair = tfidf.most_similar_pair(d).first()
    n = {i: math.sqrt(sum(v * v for (j, _), v in w.items() if j == i)) for i in (0, 1, 4)}
    sims = {(0, 4): w[0, "x"] / n[0], (1, 4): w[1, "x"] / n[1], (0, 1): w[0, "x"] * w[1, "x"] / n[0] / n[1]}
    assert (pair.d1, pair.d2) == max(sims, key=sims.get) and pair.similarity == pytest.approx(max(sims.values()))
    assert tfidf.most_similar_pair(docs_of(spark, ["p", "q", "", "r s"])).first()[:] == (0, 1, 0.0)
    assert tfidf.most_similar_pair(docs_of(spark, ["p", ""])).count() == 0
    best = {(r.rank, r.doc_id) for r in tfidf.top_scores(d, "y x", 2).collect()}
    assert best == {(1, 0), (2, 4)}
    twins = tfidf.most_similar_pair(docs_of(spark, ["p q", "r", "s", "q p q p", "p q"])).first()
    assert (twins.d1, twins.d2, twins.similarity) == (0, 3, 1.0)


def test_similar_pairs_brute(spark):
    rng = random.Random(4)
    d = docs_of(spark, [" ".join(rng.choice("bcdefg") for _ in range(rng.randint(1, 6))) for _ in range(40)])
    v = {r.doc_id: dict(zip(r.terms, r["values"], strict=True)) for r in tfidf.unit_vectors(tfidf.weights(d)).collect()}
    for least in (0.3, 0.8):
        want = {(a, b) for a in v for b in v if a < b and sum(x * v[b].get(t, 0) for t, x in v[a].items()) >= least + 1e-9}
        got = {(r.d1, r.d2) for r in tfidf.similar_pairs(tfidf.weights(d), least - 1e-9).collect()}
        assert want <= got and all(sum(x * v[b].get(t, 0) for t, x in v[a].items()) >= least - 1e-6 for a, b in got)


# --- embeddings and CBOW ---
def test_map_and_gram(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    q = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    y = x @ q.T
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>")
    g = embeddings.gram(df)
    w = rng.normal(size=(4, 4))
    assert g.loss(w) == pytest.approx(((x @ w.T - y) ** 2).sum() / 200)
    assert np.allclose(g.gradient(w), 2 / 200 * (x @ w.T - y).T @ x)
    assert np.allclose(embeddings.procrustes(g), q)
    fit = embeddings.fit_map(g, g)
    assert fit.epochs == 200 and g.loss(fit.w) == pytest.approx(min(x for _, _, x in fit.history)) and np.allclose(fit.w @ fit.w.T, np.eye(4))
    words = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0])], "word string, vec array<float>")
    mapped = embeddings.apply_map(words, q)
    target = spark.createDataFrame([("A", q[:, 0].tolist()), ("B", q[:, 1].tolist())], "word string, vec array<float>")
    near = embeddings.nearest(target, mapped, 1, "word", "vec", skip_self=False)
    assert {(r.query_id, r.id) for r in near.collect()} == {("a", "A"), ("b", "B")}
    truth = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "C")], "query_id string, id string")
    assert embeddings.accuracy(near, truth).first()[:] == (2, 50.0, 50.0)


def test_cbow(spark, tmp_path):
    d = docs_of(spark, ["x y w x y", "x", "q x y"])
    vocab = cbow.vocabulary(d, 2)
    assert {r.word: r.ix for r in vocab.collect()} == {"x": 1, "y": 2}
    got = sorted((r.doc_id, r.pos, list(r.context), r.target) for r in cbow.context_pairs(d, vocab).collect())
    ids = {0: [1, 2, 0, 1, 2], 2: [0, 1, 2]}
    want = sorted((k, i, v[max(0, i - 2) : i] + v[i + 1 : i + 3], v[i]) for k, v in ids.items() for i in range(len(v)))
    assert got == want
    model, history = cbow.train(cbow.context_pairs(d, vocab).coalesce(1), 3, width=8, epochs=30, rate=0.3)
    assert len(history) == 30 and history[-1][1] < history[0][1] and history[-1][2] > history[0][2]
    assert cbow.vectors(model, vocab).count() == 3
    path = str(tmp_path / "model")
    cbow.save(model, spark, path)
    assert (cbow.load(spark, path).flat() == model.flat()).all()


def test_cbow_step_is_the_gradient():
    """A step of any batch goes down the mean loss, and stays bounded."""
    rng = np.random.default_rng(3)
    contexts, targets = [list(rng.integers(0, 6, rng.integers(1, 5))) for _ in range(9)], rng.integers(0, 6, 9)
    model = cbow.Model(6, 4)
    model.e, model.w, model.b = (rng.normal(size=x.shape) for x in (model.e, model.w, model.b))

    def loss(flat):
        m = cbow.Model(6, 4)
        m.load(flat)
        h = np.stack([m.e[c].mean(0) for c in contexts])
        s = h @ m.w + m.b
        return np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(9), targets])

    before = model.flat()
    want = np.array([(loss(before + d) - loss(before - d)) / 2e-6 for d in np.eye(len(before)) * 1e-6])
    total, _ = model.step(contexts, targets, 0.1)
    assert np.allclose((before - model.flat()) / 0.1, want, atol=1e-5) and total == pytest.approx(9 * loss(before), abs=1e-6)


def test_projection(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + 2
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, vec array<double>")
    got = np.array([r.point for r in cbow.projection(df, 2).orderBy("i").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = vt[:2] * np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(1)])[:, None]
    assert np.allclose(got, (x - x.mean(0)) @ axes.T, atol=1e-6)


def test_checkpoints_and_blocks_of_neighbours(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    whole = sorted(map(tuple, embeddings.nearest(df, df.where("vec_id < 7"), 4).collect()))
    cut = sorted(map(tuple, embeddings.nearest(df, df.where("vec_id < 7"), 4, block_numbers=7).collect()))
    assert whole == cut and len(whole) == 28
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    for q in range(7):
        own = [r[1] for r in sorted(whole, key=lambda r: r[3]) if r[0] == q]
        assert own == [i for i in np.argsort(-sims[q], kind="stable") if i != q][:4]
    embeddings.save_map(x, spark, str(tmp_path / "w"))
    assert (embeddings.load_map(spark, str(tmp_path / "w")) == x).all()


def test_overlap(spark):
    rows = [(1, "the cat sat", "the cat"), (2, "a", " "), (3, "b b", "b"), (4, "??", "x")]
    df = spark.createDataFrame(rows, "id int, reference string, prediction string")
    got = {r.id: (r.precision, r.recall, r.f1) for r in overlap.scores(df, ["id"]).collect()}
    assert got == {1: (1.0, pytest.approx(2 / 3), pytest.approx(0.8)), 3: (1.0, 0.5, pytest.approx(2 / 3)), 4: (0.0, 0.0, 0.0)}
    assert overlap.mean_f1(df.where("id = 2"), ["id"]).first()[:] == (0.0, 0.0)


def test_stems(spark):
    pairs = "caresses caress ponies poni ties tie agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi relational relat conditional condit rational ration radically radic vietnamization vietnam decisiveness decis hopefulness hope triplicate triplic electrical electr goodness good allowance allow replacement replac adoption adopt effective effect probate probat rate rate cease ceas roll roll generalizations gener enjoy enjoy dies die geology geolog skies sky lying lie".split()
    words = dict(zip(pairs[::2], pairs[1::2], strict=True))
    assert {w: stemming.stem(w) for w in words} == words
    df = spark.createDataFrame([(1, "The hopping cats were motoring", "a cat hops and motors"), (2, None, "x")], "id int, reference string, prediction string")
    got = {r.id: (r.precision, r.recall) for r in overlap.scores(df, ["id"], 1, overlap.stemmed_tokens).collect()}
    assert got == {1: (pytest.approx(3 / 5), pytest.approx(3 / 5))}


def test_stemmed_overlap_brute(spark, sf):
    import re
    from collections import Counter

    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    turns = {(r.conv_id, r.turn): r for r in rows}
    want = {}
    for (c, t), r in turns.items():
        n = turns.get((c, t + 1))
        if n and r.role == "user" and n.role == "assistant" and (r.text or "").strip(" ") and (n.text or "").strip(" "):
            a, b = (Counter(stemming.stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", x.lower())) for x in (r.text, n.text))
            both, na, nb = sum((a & b).values()), sum(a.values()), sum(b.values())
            want[c, t] = (both / nb if nb else 0.0, both / na if na else 0.0)
    got = {(r.conv_id, r.turn): (r.precision, r.recall) for r in overlap.scores(overlap.dialogue_pairs(spark.read.parquet(f"{sf}/conversations.parquet")), ["conv_id", "turn"], 1, overlap.stemmed_tokens).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


# --- files ---
def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(26)))
    (tmp_path / "b.TXT").write_bytes("caf\xe9 \x80".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b"\x81\xff")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "a_part_01.txt").write_text("no")
    (tmp_path / "d.md").write_text("no")
    files = {r.file: r.text for r in sources.decoded_files(spark, str(tmp_path)).collect()}
    assert files["b.TXT"] == "café €" and files["c.txt"] is None and set(files) == {"a.txt", "b.TXT", "c.txt"}
    parts = sources.split_parts(sources.decoded_files(spark, str(tmp_path)), 25).collect()
    own = sorted((r.part_file, r.n_lines) for r in parts if r.file == "a.txt")
    assert len(own) == 13 and own[0] == ("a_part_01.txt", 2) and own[-1] == ("a_part_13.txt", 2)
    assert not [r for r in parts if r.file == "empty.txt"]
    whole = {r.file: r.text for r in sources.whole_files(spark, str(tmp_path)).where("file != 'c.txt'").collect()}
    assert set(whole) == {"a.txt", "a_part_01.txt"} and whole["a.txt"].count("\n") == 26
    assert {r.file for r in sources.whole_files(spark, str(tmp_path), skip=("a.txt", "c.txt"), keep_empty=True).collect()} == {"a_part_01.txt", "empty.txt"}
    assert sources.whole_file(spark, str(tmp_path / "a.txt")).first().text.startswith("line 0\nline 1")
    sources.write_parts(spark.createDataFrame(parts), f"file://{tmp_path}/out")
    assert spark.read.text(str(tmp_path / "out")).count() == 27
    assert (tmp_path / "out" / "a_part_13.txt").read_text() == "line 24\nline 25\n"


def test_vectors_and_pairs(spark, tmp_path):
    (tmp_path / "v.vec").write_text("3 2\na 1 2\nb 1 2 3\nc x 1\na 3 4\nd 5 6\n")
    got = {r.word: r.vec for r in sources.word_vectors(spark, str(tmp_path / "v.vec")).collect()}
    assert got == {"a": [3.0, 4.0], "d": [5.0, 6.0]}
    (tmp_path / "n.vec").write_text("a 1 2 3\nb 4 5 6\n")
    assert {r.word for r in sources.word_vectors(spark, str(tmp_path / "n.vec"), limit=1).collect()} == {"a"}
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "1.txt").write_text("9 2\na 1 2\n")  # the smaller file comes first by its name
    (tmp_path / "parts" / "2.txt").write_text("a 3 4\n" + "".join(f"x{i} 1 1\n" for i in range(50)))
    assert {r.word: r.vec for r in sources.word_vectors(spark, str(tmp_path / "parts")).collect()}["a"] == [3.0, 4.0]
    (tmp_path / "p.txt").write_text("dog\tpes\ncat kočka\nalone\n\n")
    assert {tuple(r) for r in sources.translation_pairs(spark, str(tmp_path / "p.txt")).collect()} == {("dog", "pes"), ("cat", "kočka")}


def test_generators(spark):
    d = sources.random_documents(spark, 20, seed=5)
    rows = d.collect()
    assert rows == sources.random_documents(spark, 20, seed=5).repartition(3).orderBy("doc_id").collect()
    assert all(50 <= len(r.text.split()) <= 200 and all(3 <= len(w) <= 10 for w in r.text.split()) for r in rows)
    p = sources.random_postings(spark, 7, 11, 50, seed=2)
    assert p.distinct().count() == 50 and sources.random_postings(spark, 7, 11, 200).distinct().count() == 77
    df = [r["n"] for r in sources.random_postings(spark, 20, 1000, 5000).groupBy("term").agg(F.count("*").alias("n")).collect()]
    assert len(df) == 20 and 8 < np.std(df) < 25  # about as uneven as draws without replacement
    gaps = index.gap_rows(sources.random_postings(spark, 20, 1000, 5000)).select("gap").distinct().count()
    assert gaps > 12


# --- streaming ---
def test_stream(spark, tmp_path):
    d = docs_of(spark, SEVEN)
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = counts.term_counts(stream).writeStream.format("memory").queryName("terms").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.term: (r.tf, r.df) for r in spark.table("terms").collect()}
    assert got["data"] == (3, 2) and got["vyhledávání"] == (3, 2)
    q = counts.matching(stream, "data AND NOT index").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.doc_id for r in spark.table("found").collect()} == {3}
    timed = stream.withColumn("at", F.timestamp_seconds(F.col("doc_id") * 400))
    q = counts.windowed_term_counts(timed, "at").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").columns == ["window", "term", "tf"]


def test_empty_tables(spark):
    d = docs_of(spark, [])
    for df in (language_model.probabilities(d, 2), index.postings(d), index.gap_rows(index.postings(d)), tfidf.weights(d), boolean.find(d, "x AND NOT y"), boolean.rank(d, "x"), pattern_search.search(d, "x"), tfidf.query_scores(d, "x")):
        assert df.count() == 0
