"""The pipeline keeps what its stages keep, and its last stage codes that."""

import hashlib

import corpus_pipeline
from tests.llm.odd import empty_docs, odd_docs


def test_stages_on_odd_rows(spark, sf):
    docs = odd_docs(spark, ["the first plain sentence of it all\n" * 3, "the first plain sentence of it all"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, empty_docs(spark), sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_stages_start_with_small_heaps(spark, sf):
    """Each stage has the heaps collected in full, and so shrunk, before its own work."""
    beans = spark._jvm.java.lang.management.ManagementFactory

    def full():
        return sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, empty_docs(spark), sf)
        assert full() > before, name


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == kept.keys() and 50 < len(kept) < 200
    for i, t in kept.items():
        assert rows[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_run_brute(spark, sf, tmp_path):
    """The whole pipeline over a small table, every stage restated plainly."""
    import numpy as np

    from tests.llm.test_dedup import WORD, classes_of, kept_lines
    from tests.llm.test_models import best_distance
    from tests.llm.test_tokens import plain_tiktoken
    from textloom.llm import decontaminate, language

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1200 or text is null").orderBy("doc_id").limit(70).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs]
    long = [t for _, t, *_ in rows if t and len(t) > 300]
    items = [long[3][20:90], long[9][40:140], "odd", None]
    more = [long[0] + " more", "x " + long[3], long[9][:60] + "#" + long[9][60:], long[1].replace(" ", "  ", 3), "12 34 -- 56", "", None, "one line\n" * 3 + long[2].replace("\n", " ") + "\none line", "und so weiter und so fort"]
    rows += [(100_000 + i, t, "en", "s", None) for i, t in enumerate(more)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language.fit(table, ~language.held_out(table, 4, 2))
    left = {}
    for i, t, *_ in rows:
        words = [language.bare(w) for w in WORD.findall(t or "")]
        feats = [language.features([w]) if w else None for w in words]
        e = np.array([model.emissions(f[0], f[1], model.lex(w)[None])[0] if f else np.zeros(len(model.langs)) for f, w in zip(feats, words, strict=True)])
        lettered = [bool(w) for w in words]
        if any(lettered):
            gamma, _ = language._posteriors(e[None], model.transitions)
            if gamma[0][lettered].mean(0).max() >= 0.4:
                left[i] = t
    assert 20 < len(left) < len(rows)
    cut = kept_lines(sorted(left.items()))
    left = {i: t for i, t in cut.items() if WORD.search(t) or not WORD.search(left[i])}
    classes = classes_of(sorted(left.items()))
    left = {i: t for i, t in left.items() if classes[i] == i or not WORD.search(t)}

    def clean(text):
        t = decontaminate.normalise(text)
        for x in items:
            x = decontaminate.normalise(x or "")
            if len(x) >= 32 and best_distance(x, t) <= decontaminate.budget(len(x)):
                return False
            if 0 < len(x) < 32 and f" {x} " in f" {''.join(c if c.isalnum() else ' ' for c in t)} ":
                return False
        return True

    want = {i: t for i, t in left.items() if clean(t)}
    assert got.keys() == want.keys() and len(want) < len(left) < len(cut)
    enc = plain_tiktoken()
    for i, t in want.items():
        ids = enc.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
