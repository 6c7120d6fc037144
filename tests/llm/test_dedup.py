import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.odd import empty_docs, odd_docs
from tests.oracle import compare
from textloom.llm import components, line_dedup, near_dups, substring_dedup
from textloom.llm.common import WordHash
from textloom.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, sf, name):
    compare(spark, name, QUERIES[name], ORACLE_SQL[name], sf)


# --- substring dedup ---
def removed_words(texts):
    """{id: kept words} by definition, for non-null ids; equal ids share windows."""
    least, words = {}, [(i, WORD.findall(t or "")) for i, t in texts]
    for i, w in words:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and least[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def test_substring_brute(spark):
    rng = random.Random(3)
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else [str(rng.random()) for _ in range(rng.randint(0, 60))] for _ in range(rng.randint(1, 4))]
        texts.append(" ".join(w for p in parts for w in p))
    df = odd_docs(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(map(tuple, substring_dedup.op6(df).collect()), key=str)
    assert got == sorted(removed_words(rows), key=str)
    assert substring_dedup.op6(empty_docs(spark)).count() == 0


def test_sketch_loses_no_repeated_anchor(spark):
    """Whatever the grid, an anchor of two documents is estimated to repeat; few
    others are."""
    rng = random.Random(8)
    common = [" ".join(f"c{p}x{rng.random()}" for _ in range(60)) for p in range(40)]
    texts = [" ".join(f"w{rng.random()}" for _ in range(120)) + " " + common[i % 40] for i in range(120)]
    h, ends = substring_dedup.hashed_words([t.encode() for t in texts], WordHash())
    g, text, _, _ = substring_dedup.anchors(h, ends)
    in_docs = defaultdict(set)
    for x, t in zip(g, text, strict=True):
        in_docs[int(x)].add(int(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    least = substring_dedup.LEAST_GRID
    try:
        for substring_dedup.LEAST_GRID in (least, 6):
            s = substring_dedup.sketch(df)
            said = dict(zip(map(int, g), s.repeated(g), strict=True))
            assert all(said[x] for x, d in in_docs.items() if len(d) > 1)
            assert sum(said[x] for x, d in in_docs.items() if len(d) == 1) < len(in_docs) / 8
    finally:
        substring_dedup.LEAST_GRID = least


# --- line dedup ---
def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def kept_lines(docs, least=20):
    """Kept texts by definition, for different ids."""
    lines = [(i, p, x) for i, t in docs for p, x in enumerate(t.split("\n")) if WORD.search(x)]
    first, gone = {}, set()
    for k in sorted(lines):
        if k[2] in first:
            gone.add(k[:2])
        first.setdefault(k[2], k[:2])
    names = list(first)
    for x in names:
        for y in names:
            if first[y] < first[x] and min(len(x), len(y)) >= least and within_one(x, y):
                gone |= {(i, p) for i, p, z in lines if z == x}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


def test_lines_brute(spark):
    rng = random.Random(5)
    bases = ["the quick brown fox jumps over it", "é日本 zwei drei vier fünf sechs", "x" * 19, "a" * 20, "  leading and   inner blanks  ", "one two three four five six seven eight"]

    def changed(x):
        i = rng.randrange(len(x) + 1)
        return rng.choice([x, x[:i] + "q" + x[i:], x[:i] + x[i + 1 :], x[:i] + "z" + x[i + 1 :], x[:i] + " " + x[i:]])

    docs = [(i, "\n".join(rng.choice(["", " ", changed(rng.choice(bases)), str(rng.random()) * 2]) for _ in range(rng.randint(0, 7)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r._kept for r in line_dedup.dedup_lines(df).collect()}
    assert got == kept_lines(docs)


def test_lines_of_words_in_another_order(spark):
    """Lines with the same neighbouring words must not hide each other."""
    docs = list(enumerate(["pppp xx aa bb xx cc dd xx", "pppp xx cc dd xx aa bb xx", "qppp xx cc dd xx aa bb xx", "pppp xx aa bb xx cc dd xz"]))
    got = {r.doc_id: r._kept for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == kept_lines(docs) and got[2] == "" and got[3] == ""


def test_lines_permuted(spark):
    rng = random.Random(11)
    docs = []
    for i in range(150):
        w = ["aa", "bb", "xx", "cc", "aa", "xx", "bb", ""]
        rng.shuffle(w)
        x = "pp " + " ".join(w) + " end"
        for _ in range(rng.randint(0, 2)):
            p = rng.randrange(len(x))
            x = x[:p] + rng.choice(["", " ", "q"]) + x[p + rng.randint(0, 1) :]
        docs.append((i, x))
    got = {r.doc_id: r._kept for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == kept_lines(docs)


def test_lines_names_clash(spark):
    names = ["places", "every", "_all", "_flags", "flag", "_p_id", "p_id", "p_rk", "rk", "_kept", "_n_lines", "_n_removed", "line", "stays"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a line that is long enough\nx", "a line that is long enough\ny", "z"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = line_dedup.drop_repeated_lines(df)
    want = [(i, "y" if i == 1 else t, *rest) for i, t, *rest in rows]
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == want
    assert line_dedup.dedup_lines(df).columns == [*df.columns, "__n_lines", "__n_removed", "__kept"]


def test_lines_odd(spark):
    df = odd_docs(spark)
    rows = line_dedup.op10(df).collect()
    assert len(rows) == df.count()
    twins = [tuple(r) for r in rows if r.doc_id == 8]
    assert len(twins) == 3 and len(set(twins)) == 2  # a repeated row is one document
    kept = line_dedup.drop_repeated_lines(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, 4, 5, 6, 7}
    assert line_dedup.op10(empty_docs(spark)).count() == 0 and line_dedup.drop_repeated_lines(empty_docs(spark)).count() == 0


# --- near duplicates ---
def weighted(text):
    w = text.split()
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    out = defaultdict(int)
    for x in runs:
        out[x] += 1
    return out


def jaccard_p(a, b):
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def classes_of(docs, least=0.8):
    sets = {i: weighted(t or "") for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and jaccard_p(sets[i], sets[j]) >= least - 1e-12:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_probability_jaccard():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ({k: rng.randint(1, 4) for k in rng.sample(range(12), rng.randint(1, 9))} for _ in range(2))
        arr = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert near_dups.probability_jaccard(*arr[0], *arr[1]) == pytest.approx(jaccard_p(a, b))


def test_signatures_estimate():
    rng = random.Random(2)
    w = [f"w{rng.randint(0, 10_000)}" for _ in range(400)]
    v = list(w)
    for i in range(0, 400, 60):
        v[i] = "changed"
    sig, _ = near_dups.signatures([" ".join(w).encode(), " ".join(v).encode()], WordHash())
    want = jaccard_p(weighted(" ".join(w)), weighted(" ".join(v)))
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.12)


def test_near_brute(spark):
    """Families of copies of copies, with and without repeated passages."""
    rng = random.Random(7)
    docs = []
    for family in range(6):
        base = [f"f{family}w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 60, 120]))]
        if family % 2:
            base += base[:20] * 2
        pool = [base]
        for _ in range(30):
            own = list(rng.choice(pool))
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 9)}"
            pool.append(own)
            docs.append(" ".join(own))
    docs += ["", "one", "one", "one two three four", "one two three four"]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicate_classes(df).collect()}
    assert got == classes_of(docs)
    near_dups_hot = near_dups._HOT
    try:  # the bounds must lose nothing wherever the limit stands
        near_dups._HOT = 2
        assert {r.doc_id: r.class_id for r in near_dups.near_duplicate_classes(df).collect()} == got
    finally:
        near_dups._HOT = near_dups_hot


def test_near_odd(spark):
    df = odd_docs(spark)
    rows = near_dups.near_duplicate_classes(df).collect()
    assert len(rows) == df.count()
    kept = near_dups.keep_representatives(df)
    assert kept.columns == df.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert texts.count((8, "same row")) == 1 and (9, "same row") not in texts and {(0, None), (1, ""), (2, "   \n\t ")} <= set(texts)
    assert near_dups.near_duplicate_classes(empty_docs(spark)).count() == 0 and near_dups.keep_representatives(empty_docs(spark)).count() == 0


def test_near_names_clash(spark):
    names = ["own", "_own", "__own", "salt", "_salt", "component", "class_id", "_id", "_node", "bands"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b c d e f g", "a b c d e f g", "other words", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = near_dups.keep_representatives(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], *rows[2:]]


def test_one_representative_without_ids(spark):
    """Unlike-worded near copies that all have a null id, or the same one."""
    base = {i: [f"{i}w{j}" for j in range(200)] for i in "abc"}
    near = lambda i, n: " ".join(base[i][:-1] + [f"end{n}"])
    rows = [(None, near("a", n)) for n in range(3)] + [(7, near("b", n)) for n in range(3)] + [(7, near("c", 0)), (None, near("c", 1)), (None, ""), (None, " ")]
    kept = [tuple(r) for r in near_dups.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == len(set(kept)) == 5 and set(kept) <= set(rows)
    assert [sum(i == k and t.startswith(w) for i, t in kept) for k, w in ((None, "a"), (7, "b"), (7, "c"), (None, "c"))] == [1, 1, 1, 0]


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    # the least node of a component may be left out: it is its own
    assert all(want[x] == c for x, c in got.items()) and all(x in got or want[x] == x for x in want)


def test_few_pairs_under_a_much_repeated_line(spark, monkeypatch):
    """Texts of one line many times and words of their own, just below the threshold: the
    classes are those of brute force, and few pairs are compared one by one."""
    rng = random.Random(8)
    own = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    line, pools = "one more line \n" * 150, [own(9) for _ in range(3)]
    docs = [(i, line + own(60 + i % 50) + "\n" + pools[i % 3] + "\n" + ("and a last line with the same words in most" if i % 4 else own(9))) for i in range(90)]
    docs += [(90 + i, line + own(2)) for i in range(3)] + [(100 + i, docs[5 * i][1] + " " + own(3)) for i in range(5)]
    compared, plain = [], near_dups._similarities

    def counted(pairs, table, rest=False):
        out = plain(pairs, table, rest)
        if not rest:
            compared.append(out.count())
        return out

    monkeypatch.setattr(near_dups, "_similarities", counted)
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == classes_of(docs)
    assert len(set(got.values())) > 20 and compared[0] < 300, compared


def test_substring_stages_start_with_small_heaps(spark, monkeypatch):
    """The heaps are collected before each stage of weight: the sketch, the rows of
    anchors, the contexts, the single windows and the rows of what is known."""
    done = []
    monkeypatch.setattr(substring_dedup, "shrink_heaps", lambda s: done.append("shrink"))
    monkeypatch.setattr(substring_dedup, "materialize", lambda df, f=substring_dedup.materialize: done.append(",".join(df.columns)) or f(df))
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (2, "x " + text), (3, text + " " + text), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.op6(df).collect())) == removed_words(rows)
    for stage in ("part,block,n,data", "ctx,anchor,wins,least,most,tail", "anchor,tail,least,wins", "ctx,least,each"):
        assert done[done.index(stage) - 1] == "shrink"
    assert done[-1] == "shrink"


def test_rows_off_core_once(spark, monkeypatch):
    """Nodes of many sizes with common shingles off their pivot: a node enters the join with
    each of them once at most, whatever the sizes it may meet, and no pair is lost."""
    rng = random.Random(11)
    has = {i: set(rng.sample(range(30), rng.randint(1, 25))) for i in range(60)}
    total = {i: 80 + len(x) + rng.randint(0, 8) for i, x in has.items()}
    often = {h: sum(h in x for x in has.values()) for h in range(30)}
    part = [80] + [0] * 31
    off = [(b"p", bytes([i]), bytes([i % 50]), 0.8, 80, total[i], 0, 0, part, total[i] - 80, 0, sorted((often[h], h) for h in x)) for i, x in has.items()]
    off = spark.createDataFrame(off, "pivot binary, node binary, component binary, sim double, on long, total long, extra long, hot long, part array<int>, off long, off_extra long, rest array<struct<n: long, h: long>>")
    rows, stored = [], near_dups.materialize

    def kept(df, path=None):
        out = stored(df, path)
        rows.append(out.count())
        return out

    monkeypatch.setattr(near_dups, "materialize", kept)
    got = {(r.u[0], r.v[0]) for r in near_dups._pairs_off_core(off).collect()}
    common = {(i, j): 80 + len(has[i] & has[j]) for i in has for j in has if i < j and i % 50 != j % 50 and has[i] & has[j]}
    links = {(i, j) for (i, j), c in common.items() if c >= 0.8 * (total[i] + total[j] - c)}
    assert len(links) > 20 and links <= got <= set(common)
    assert 0 < rows[0] <= sum(map(len, has.values())), rows
