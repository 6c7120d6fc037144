import re

import numpy as np

from textloom.llm import quality_rules
from textloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_base_measures(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_quality_rules"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept) and isinstance(r.kept, bool)


def test_odd_rows(spark):
    texts = [None, "", "\n\n", "é# x\x1cy\x85z", "a b c d e f g h " * 5, "one\ntwo\none\n \n", "z" * 50000] + ["word%d other thing" % i for i in range(5)] * 2
    rows = [(i if i else None, t, None if i % 3 == 0 else "en", "s", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    got = quality_rules.apply_rules(df).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        assert (by[i].n_words, by[i].word_chars, by[i].n_symbols, by[i].n_dup_lines, by[i].n_repeat_words, by[i].base_failed) == base(t)
    assert quality_rules.apply_rules(df.limit(0)).count() == 0


def test_fences_follow_the_group(spark):
    rng = np.random.default_rng(3)
    text = lambda extra: " ".join("w%d" % x for x in rng.integers(0, 10**6, 60)) + extra
    rows = [(i, text(" ## %% ## &&&"), "en", "symbols") for i in range(60)] + [(100 + i, text(""), "en", "plain") for i in range(60)]
    rows += [(1000, text(" ##" * 60), "en", "plain"), (1001, text(" averyveryverylongword" * 60), "en", "plain")]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(60)) and all(got[100 + i].kept for i in range(60))
    assert not got[1000].kept and not got[1001].kept


def test_kept_brute(spark, sf):
    """The whole verdict from exact quartiles; only rows whose rate lies between the
    fences of quartiles a rank error away may differ."""
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rates = {}
    for i, t, lang, source in docs:
        n, chars, symbols, dup, repeat, failed = base(t)
        lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
        rates[i] = (failed, lang, source, {"word_len": chars / max(n, 1), "symbol_rate": symbols / max(chars, 1), "dup_line_rate": dup / max(lines, 1), "repeat_rate": repeat / max(n, 1)})
    fine, by_lang, every = {}, {}, []
    for failed, lang, source, r in rates.values():
        if not failed:
            fine.setdefault((lang, source), []).append(r)
            by_lang.setdefault(lang, []).append(r)
            every.append(r)
    doubtful = 0
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, sf).collect()}
    for i, (failed, lang, source, r) in rates.items():
        group = next(g for g in (fine.get((lang, source), []), by_lang.get(lang, []), every) if len(g) >= 30 or g is every)
        verdicts = set()
        for shift in (-0.02, 0.0, 0.02):  # rank error of a sketch with k = 200
            out = []
            for name, (floor, both) in quality_rules.RATES.items():
                own = sorted(x[name] for x in group)
                q1, q3 = (own[min(len(own) - 1, max(0, int(np.ceil((q + shift) * len(own))) - 1))] for q in (0.25, 0.75))
                width = 4.0 * max(q3 - q1, floor)
                if r[name] > q3 + width or both and r[name] < q1 - width:
                    out.append(name)
            verdicts.add(tuple(out))
        if len(verdicts) > 1:
            doubtful += 1
            continue
        assert tuple(got[i].failed) == verdicts.pop() or failed
        assert got[i].kept == (not failed and not got[i].failed)
    assert doubtful <= len(docs) // 20


def test_each_fence_alone_rejects(spark):
    """Rows that pass the base, each beyond one fence of its group only."""
    rng = np.random.default_rng(5)
    words = lambda n: ["w%d" % x for x in rng.integers(10**5, 10**6, n)]

    def passage(n):  # n of 100 words stand in a passage of n / 2 words that is given twice
        w = words(100 - n // 2)
        return " ".join(w + w[: n // 2])

    lines = lambda n, same: "\n".join(x for i in range(n - same) for x in [" ".join(words(6)), "one two three"][: 1 + (i < same)])
    rows = [(i, " ".join(words(100)), "en", "plain") for i in range(60)]
    rows += [(100 + i, passage(2 * (i % 14)), "en", "songs") for i in range(60)]
    rows += [(200 + i, lines(10, 1 + i % 5), "en", "lists") for i in range(60)]
    rows += [(1000, " ".join("averyveryverylong" + w for w in words(100)), "en", "plain"), (1001, " ".join(words(100)) + "#" * 60, "en", "plain")]
    rows += [(1002, lines(10, 4), "en", "plain"), (1003, passage(24), "en", "plain"), (1004, passage(24), "en", "songs"), (1005, lines(10, 4), "en", "lists")]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].failed for i in range(1000, 1006)] == [["word_len"], ["symbol_rate"], ["dup_line_rate"], ["repeat_rate"], [], []]
    assert [got[i].kept for i in range(1000, 1006)] == [False] * 4 + [True] * 2
    assert all(got[i].kept for s in (0, 100, 200) for i in range(s, s + 60))
