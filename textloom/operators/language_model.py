"""Word n-gram language model: counts, conditional probabilities, smoothing,
next words, generation and perplexity.

N-grams never cross documents.  They are counted by slices of documents before a
group-by; probabilities come from one equi-join of n-gram counts with prefix counts, or,
for longer n-grams, from one shuffle by the prefix.  Ties go to what stands first in the
corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_position, ngram_tokens, ngrams
from ..storage import stored
from . import counting, grams


def occurrences(docs: DataFrame, n: int, tokens=ngram_tokens) -> DataFrame:
    """doc_id, prefix, next, pos of every n-gram."""
    # The tokens are a column of their own: a lambda would take them from the text again for each n-gram.
    return docs.select("doc_id", tokens(docs["text"]).alias("t")).select("doc_id", F.explode(ngrams(F.col("t"), n)).alias("g")).select("doc_id", "g.prefix", "g.next", "g.pos")


def frequencies(docs: DataFrame, n: int, tokens=ngram_tokens) -> DataFrame:
    """prefix, next, cnt, first_pos."""
    return _summed(grams.counts(docs, n, tokens(docs["text"])))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("prefix", "next").agg(F.sum("cnt").alias("cnt"), F.min(first_position(F.col("doc_id"), F.col("pos"))).alias("first_pos"))


def gram(prefix="prefix", next_="next"):
    return F.concat_ws(" ", F.nullif(F.col(prefix), F.lit("")), F.col(next_))


def top(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("cnt"), "first_pos").limit(k).select(gram().alias("gram"), "cnt")


def top_grams(docs: DataFrame, n: int, k: int = 10, tokens=ngram_tokens, most: int = 10_000) -> DataFrame:
    """top(frequencies(docs, n), k), for n-grams of which most are rare.

    Counts by hashes, a few bytes each, are at least those of the n-grams behind them:
    what has a k-th place has a hash of that count or more.  Only those are counted by
    themselves; where they are too many, as in small or even corpora, all are."""
    text = tokens(docs["text"])
    hashed = stored(grams.hashed_counts(docs, n, text))
    first = hashed.orderBy(F.desc("cnt")).limit(k).agg(F.min("cnt"), F.count("*")).first()
    least = first[0] or 0
    while first[1] == k:
        own = hashed.where(F.col("cnt") >= least).select("h").limit(most + 1).collect()
        if len(own) > most:
            break
        found = stored(_summed(grams.counts_by_hash(docs, n, [r.h for r in own], text)))
        exact = found.orderBy(F.desc("cnt")).limit(k).agg(F.min("cnt"), F.count("*")).first()
        if exact[1] == k and exact[0] >= least:
            return top(found, k)
        least = exact[0] if exact[1] == k else least - 1  # two n-grams of one hash
    return top(frequencies(docs, n, tokens), k)


def vocabulary_size(docs: DataFrame, tokens=ngram_tokens) -> DataFrame:
    words = counting.document_frequencies(docs, tokens(docs["text"]))
    return words.agg(F.count("*").alias("vocab_size"))


def probabilities(docs: DataFrame, n: int, alpha: float = 0.0, corrected: bool = False, tokens=ngram_tokens) -> DataFrame:
    """prefix, next, cnt, first_pos, prob.  alpha 0: the share of the prefix's
    count; else with alpha added to each count of the vocabulary.  A single word has
    no prefix, so its divisor is 1 (its probability is its count) unless `corrected`."""
    if n == 1:
        counts = frequencies(docs, n, tokens)
        total = F.lit(1)
        if corrected:
            counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("cnt").alias("prefix_cnt"))))  # one row
            total = F.col("prefix_cnt")
    elif n == 2:
        before = frequencies(docs, n - 1, tokens).select(gram().alias("prefix"), F.col("cnt").alias("prefix_cnt"))
        counts = frequencies(docs, n, tokens).join(before.hint("shuffle_hash"), "prefix")
        total = F.col("prefix_cnt")
    else:
        # One shuffle by the prefix has all of its n-grams, and its ends of documents.
        rows = grams.counts(docs, n, tokens(docs["text"]), tails=True).repartition("prefix")
        counts = _summed(rows).withColumn("prefix_cnt", F.sum("cnt").over(Window.partitionBy("prefix"))).where("next is not null")
        total = F.col("prefix_cnt")
    if alpha:
        counts = counts.crossJoin(F.broadcast(vocabulary_size(docs, tokens)))  # one row
        # Only a corrected or longer n-gram has a prefix that was seen.
        seen = total if n > 1 or corrected else F.lit(0)
        prob = (F.col("cnt") + alpha) / (seen + alpha * F.col("vocab_size"))
    else:
        prob = F.col("cnt") / total
    return counts.select("prefix", "next", "cnt", "first_pos", prob.alias("prob"))


def next_words(model: DataFrame) -> DataFrame:
    """prefix, next, prob: the likeliest word after each prefix."""
    best = F.max_by(F.struct("next", "prob"), F.struct(F.col("prob"), -F.col("first_pos")))
    return model.groupBy("prefix").agg(best.alias("b")).select("prefix", "b.next", "b.prob")


def likeliest_words(docs: DataFrame, tokens=ngram_tokens) -> DataFrame:
    """next_words(probabilities(docs, 2)): the best of a prefix is the one of the largest
    count, so only that one meets the prefix's own count."""
    best = F.max_by(F.struct("next", "cnt"), F.struct(F.col("cnt"), -F.col("first_pos")))
    chosen = frequencies(docs, 2, tokens).groupBy("prefix").agg(best.alias("b")).select("prefix", "b.next", "b.cnt")
    before = frequencies(docs, 1, tokens).select(F.col("next").alias("prefix"), F.col("cnt").alias("prefix_cnt"))
    return chosen.join(before.hint("shuffle_hash"), "prefix").select("prefix", "next", (F.col("cnt") / F.col("prefix_cnt")).alias("prob"))


def own_perplexity(docs: DataFrame, n: int, alpha: float = 0.0, tokens=ngram_tokens) -> DataFrame:
    """perplexity(docs, probabilities(docs, n, alpha), n), without the model's rows."""
    size = vocabulary_size(docs, tokens).first()[0] if alpha else 0
    each = grams.log_sums(docs, n, alpha, size, tokens(docs["text"])).select("doc_id", "n_grams", F.exp(-F.col("l") / F.col("n_grams")).alias("perplexity"))
    every = docs.select("doc_id").distinct()
    return every.join(each, "doc_id", "left").select("doc_id", F.coalesce("n_grams", F.lit(0)).alias("n_grams"), F.coalesce("perplexity", F.lit(float("inf"))).alias("perplexity"))


def start_perplexities(docs: DataFrame, models: tuple[tuple[int, float], ...], first: int = 1000, tokens=ngram_tokens) -> list[tuple[int, int, float]]:
    """(n, n_grams, perplexity) of corpus_perplexity() for models (n, alpha) of the
    corpus: only the n-grams of the start, and their prefixes, are counted."""
    import math
    from collections import Counter

    lists = docs.select("doc_id", tokens(docs["text"]).alias("t"))
    rows, reach = [], docs.select("doc_id").where("doc_id is not null").orderBy("doc_id").limit(first).agg(F.max("doc_id")).first()[0]
    if reach is not None:
        rows = lists.where((F.col("doc_id") <= reach) & (F.size("t") > 0)).orderBy("doc_id").limit(first).collect()
    if sum(len(r.t) for r in rows) < first:  # many have no token
        rows = lists.where(F.size("t") > 0).orderBy("doc_id").limit(first).collect()
    cut, left = [], first
    for r in rows:
        cut.append(r.t[:left])
        left -= len(cut[-1])
    own = {n: Counter(tuple(t[i : i + n]) for t in cut for i in range(len(t) - n + 1)) for n, _ in models}
    wanted = [" ".join(x) for n in own for g in own[n] for x in (g, g[:-1]) if x]
    cnt = {r.gram: r.cnt for r in grams.chosen_counts(docs, wanted, tokens(docs["text"])).collect()} if wanted else {}
    size = vocabulary_size(docs, tokens).first()[0] if any(a for _, a in models) else 0
    out = []
    for n, alpha in models:
        prefix = lambda g: 0 if alpha else 1
        if n > 1:
            prefix = lambda g: cnt[" ".join(g[:-1])]
        logs = math.fsum(k * math.log((cnt[" ".join(g)] + alpha) / (prefix(g) + alpha * size)) for g, k in own[n].items())
        total = own[n].total()
        out.append((n, total, math.exp(-logs / total) if total else math.inf))
    return out


def perplexity(docs: DataFrame, model: DataFrame, n: int, first: int | None = None, tokens=ngram_tokens, unseen: float = 1e-10) -> DataFrame:
    """doc_id, n_grams, perplexity of every document under a model (prefix, next,
    prob): exp of the mean negative log probability; infinity without an n-gram.
    `first`: judge only so many tokens from the start."""
    rows = occurrences(docs, n, tokens)
    if first is not None:
        rows = rows.where(F.col("pos") + n <= first)
    counted = rows.groupBy("doc_id", "prefix", "next").agg(F.count("*").alias("k"))
    logs = counted.join(model.select("prefix", "next", "prob"), ["prefix", "next"], "left").select("doc_id", "k", (F.col("k") * F.log(F.coalesce("prob", F.lit(unseen)))).alias("l"))
    each = logs.groupBy("doc_id").agg(F.sum("k").alias("n_grams"), F.exp(-F.sum("l") / F.sum("k")).alias("perplexity"))
    every = docs.select("doc_id").distinct()
    return every.join(each, "doc_id", "left").select("doc_id", F.coalesce("n_grams", F.lit(0)).alias("n_grams"), F.coalesce("perplexity", F.lit(float("inf"))).alias("perplexity"))


def corpus_perplexity(docs: DataFrame, model: DataFrame, n: int, first: int = 1000, tokens=ngram_tokens, unseen: float = 1e-10) -> DataFrame:
    """n_grams, perplexity (one row) of the corpus's first tokens, documents taken by
    their ids.  No more than `first` documents are looked at: each has a token."""
    start = docs.select("doc_id", tokens(docs["text"]).alias("t")).where(F.size("t") > 0).orderBy("doc_id").limit(first)
    before = F.coalesce(F.sum(F.size("t")).over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `first` rows
    cut = start.withColumn("left", F.lit(first) - before).where("left > 0").select("doc_id", F.slice("t", F.lit(1), F.col("left").cast("int")).alias("t"))
    grams = cut.select(F.explode(ngrams(F.col("t"), n)).alias("g")).groupBy("g.prefix", "g.next").agg(F.count("*").alias("k"))
    logs = grams.join(model.select("prefix", "next", "prob"), ["prefix", "next"], "left").select("k", (F.col("k") * F.log(F.coalesce("prob", F.lit(unseen)))).alias("l"))
    return logs.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_grams"), F.coalesce(F.exp(-F.sum("l") / F.sum("k")), F.lit(float("inf"))).alias("perplexity"))


def generated(docs: DataFrame, seeds: list[int], words: int = 20, alpha: float = 1.0, tokens=ngram_tokens) -> list[list[str]]:
    """generate() of the corpus's smoothed models from its most frequent word, for each
    seed.  The models' rows are not made: the tokens are written once, each step looks
    through them for what follows the last words of all seeds, and draws alike."""
    start = top(frequencies(docs, 1, tokens), 1).first()
    if start is None:
        return [[] for _ in seeds]
    size = vocabulary_size(docs, tokens).first()[0]
    lines = stored(docs.select(F.concat(F.lit(" "), F.array_join(tokens(docs["text"]), " "), F.lit(" ")).alias("line")))
    out, open_ = {s: [start.gram] for s in seeds}, list(seeds)
    for place in range(1, words):
        if not open_:
            break
        ends = {s: " ".join(out[s][-2:]) for s in open_}
        here = F.lit(False)
        for e in set(ends.values()):
            here = here | F.col("line").contains(f" {e} ")
        follow = []
        for s, e in ends.items():
            # Tokens have letters and digits alone; a document's end follows as null.
            nexts = F.regexp_extract_all("line", F.lit(f"(?<= {e} )[^ ]+"), F.lit(0))
            tail = F.when(F.col("line").endswith(f" {e} "), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
            follow.append(F.struct(F.lit(s).alias("seed"), F.when(F.col("line").contains(f" {e} "), F.concat(nexts, tail)).otherwise(F.array().cast("array<string>")).alias("nexts")))
        rows = lines.where(here).select(F.explode(F.array(*follow)).alias("f")).select("f.seed", F.explode("f.nexts").alias("next"))
        cnt = stored(rows.groupBy("seed", "next").agg(F.count("*").alias("cnt")))
        before = cnt.groupBy("seed").agg(F.sum("cnt").alias("prefix_cnt"))
        prob = (F.col("cnt") + alpha) / (F.col("prefix_cnt") + alpha * F.lit(size))
        u = (F.pmod(F.xxhash64("next", "seed", F.lit(place)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        drawn = cnt.where("next is not null").join(F.broadcast(before), "seed").select("seed", F.struct((-F.log(u) / prob).alias("t"), "next").alias("x"))  # a row a seed
        got = {r.seed: r.x.next for r in drawn.groupBy("seed").agg(F.min("x").alias("x")).collect()}
        for s in open_:
            if s in got:
                out[s].append(got[s])
        open_ = [s for s in open_ if s in got]
    return [out[s] for s in seeds]


def generate(bigrams: DataFrame, trigrams: DataFrame, start: str, words: int = 20, seed: int = 0) -> list[str]:
    """Weighted random words after `start`: the second by bigrams, the others by
    trigrams.  Each step is one distributed draw (exponential clocks with the
    probability as rate; the earliest wins) that brings one row to the driver."""
    out = [start]
    while len(out) < words:
        model, prefix = (bigrams, out[-1]) if len(out) == 1 else (trigrams, " ".join(out[-2:]))
        u = (F.pmod(F.xxhash64("next", F.lit(seed), F.lit(len(out))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        drawn = model.where((F.col("prefix") == prefix) & (F.col("prob") > 0)).select("next", (-F.log(u) / F.col("prob")).alias("t")).orderBy("t", "next").limit(1).collect()
        if not drawn:
            break
        out.append(drawn[0]["next"])
    return out
