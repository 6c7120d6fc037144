"""Spelling correction: the most frequent near word, the closest word, and the
near word with the likeliest character pairs.

Candidates are generated and looked up by equi-joins.  The dictionary grows with
the corpus and is never broadcast by hand; the words to correct are the small side.
Ties go to the word first in alphabetical order, those of closest() to the word
that stands first in the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_bigrams, edit_variants, first_position, lookup, word_tokens


def dictionary(docs: DataFrame) -> DataFrame:
    """word, freq, first_pos."""
    rows = docs.select("doc_id", F.posexplode(word_tokens(docs["text"])).alias("pos", "word"))
    return rows.groupBy("word").agg(F.count("*").alias("freq"), F.min(first_position(F.col("doc_id"), F.col("pos"))).alias("first_pos"))


def candidates(words: DataFrame) -> DataFrame:
    """word, variant for every row of words(word)."""
    return words.select("word").distinct().select("word", F.explode(edit_variants(F.col("word"))).alias("variant"))


def most_frequent(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, correction (null if no variant is known), freq."""
    found = candidates(words).join(dictionary.select(F.col("word").alias("variant"), "freq"), "variant")
    best = found.groupBy("word").agg(F.min_by(F.struct("variant", "freq"), F.struct(-F.col("freq"), "variant")).alias("b"))
    return words.select("word").distinct().join(best, "word", "left").select("word", F.col("b.variant").alias("correction"), F.col("b.freq").alias("freq"))


def closest(words: DataFrame, dictionary: DataFrame, block: int = 500) -> DataFrame:
    """word, correction, distance: the dictionary word with the least edit distance.

    The words are a stated query set: they are read in blocks of at most `block`,
    each carried to every task as a literal, so the dictionary is scanned in place
    and only a row per word and task is shuffled."""
    spark = words.sparkSession
    kept = dictionary.select("word", "first_pos")
    out, held = None, []

    def one(block_words):
        each = kept.withColumn("q", F.explode(F.array(*[F.lit(w) for w in block_words])))
        scored = each.select("q", "word", "first_pos", F.levenshtein("q", "word").alias("distance"))
        best = scored.groupBy("q").agg(F.min_by(F.struct("word", "distance"), F.struct("distance", "first_pos")).alias("b"))
        return best.select(F.col("q").alias("word"), F.col("b.word").alias("correction"), F.col("b.distance").alias("distance"))

    for r in words.select("word").where("word is not null").distinct().toLocalIterator():
        held.append(r.word)
        if len(held) == block:
            out = one(held) if out is None else out.unionAll(one(held))
            held = []
    if held:
        out = one(held) if out is None else out.unionAll(one(held))
    return out if out is not None else spark.createDataFrame([], "word string, correction string, distance int")


def bigram_index(dictionary: DataFrame) -> DataFrame:
    """bigram, word, cnt: how often each dictionary word has a pair of characters."""
    rows = dictionary.select("word", F.explode(char_bigrams(F.col("word"))).alias("bigram"))
    return rows.groupBy("bigram", "word").agg(F.count("*").alias("cnt"))


def bigram_scores(variants: DataFrame, index: DataFrame) -> DataFrame:
    """variant, score: the sum over the variant's pairs of ln(its count in this
    word / its count in all words).  Pairs that no word has are left out, so a
    variant without a known pair scores 0; a known pair that the variant lacks as a
    dictionary word makes it minus infinity."""
    totals = index.groupBy("bigram").agg(F.sum("cnt").alias("total"))
    rows = variants.select("variant").distinct().select("variant", F.explode_outer(char_bigrams(F.col("variant"))).alias("bigram"))
    rows = rows.groupBy("variant", "bigram").agg(F.count("*").alias("k"))
    rows = rows.join(totals, "bigram", "left").join(index.withColumnRenamed("word", "variant"), ["bigram", "variant"], "left")
    term = F.when(F.col("total").isNull(), F.lit(0.0)).when(F.col("cnt").isNull(), F.lit(float("-inf"))).otherwise(F.col("k") * F.log(F.col("cnt") / F.col("total")))
    return rows.groupBy("variant").agg(F.sum(term).alias("score"))


def best_by_bigrams(words: DataFrame, index: DataFrame) -> DataFrame:
    """word, correction, score of the variant with the highest score; null where every
    variant's score is minus infinity."""
    found = candidates(words)
    scored = found.join(bigram_scores(found, index), "variant").where(F.col("score") > float("-inf"))
    best = scored.groupBy("word").agg(F.min_by(F.struct("variant", "score"), F.struct(-F.col("score"), "variant")).alias("b"))
    return words.select("word").distinct().join(best, "word", "left").select("word", F.col("b.variant").alias("correction"), F.col("b.score").alias("score"))


def correct_sentences(sentences: DataFrame, corrections: DataFrame, most: int = 20_000) -> DataFrame:
    """sent_id, text with each word replaced by its correction, if there is one.
    sentences(sent_id, text); corrections(word, correction).

    Up to `most` corrections are carried to the sentences, which are rewritten in place;
    with more, the words are shuffled to them."""
    split = F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda x: x != "")
    known = corrections.where("word is not null and correction is not null").select("word", "correction")
    few = known.limit(most + 1).collect()
    if len(few) <= most:
        find = lookup([(r.word, r.correction) for r in few])
        rows = sentences.select("sent_id", split.alias("w")).where(F.size("w") > 0)
        return rows.select("sent_id", F.array_join(F.transform("w", lambda x: F.coalesce(find(x), x)), " ").alias("text"))
    words = sentences.select("sent_id", F.posexplode(split).alias("pos", "word"))
    fixed = words.join(known, "word", "left").select("sent_id", "pos", F.coalesce("correction", "word").alias("w"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    return fixed.groupBy("sent_id").agg(joined.alias("text"))


def sentence_words(sentences: DataFrame) -> DataFrame:
    return sentences.select(F.explode(F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda x: x != "")).alias("word")).distinct()
