"""Tokens, language model, search, spelling, index, TF-IDF, codes, embeddings, word
vectors and overlap: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, text
from ..functions.words import CZECH_LETTERS, EDIT_ALPHABET, INDEX_STOP, PUNCTUATION, STOP_CS
from ..operators import cbow, embeddings, index, language_model, overlap, pattern_search, spelling, tfidf
from ..plans import boolean
from ..sources import text as text_source
from ..storage import scratch_folder, stored

#: Words to correct and queries to answer: parameters of the registered queries.
MISSPELLED = ("teh", "thhe", "adn", "wich", "becuase", "peopel", "wrok", "tme")
QUERY_TEXT = "time en re th en"
FLAGSHIP = "en AND (re OR th) AND NOT ha"
BOOLEAN = {"bool_and": "en AND re", "bool_or": "en OR th", "bool_not": "NOT en", "bool_nested": FLAGSHIP}
RANKED = {"ranked_and": "en AND re", "ranked_or": "en OR th", "ranked_and_not": FLAGSHIP}
DOMAIN = ("the", "en", "time", "die")
PATTERN = "the "
#: A pattern that overlaps itself where a text has three of its characters in a row.
OVERLAPPING = "&&"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# Tokens of each kind as DuckDB expressions over `text`.
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_SPLIT = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
SQL_TOKENS = {
    "ngram": _SPLIT.format(r"regexp_replace(lower(text), '[^a-zá-žÁ-Ž0-9\s]', '', 'g')"),
    "word": _WORDS,
    "index": f"list_filter({_WORDS}, lambda x: regexp_full_match(x, '[a-z{CZECH_LETTERS}]{{2,}}') AND x NOT IN ({_sql(INDEX_STOP)}))",
    "tfidf": f"list_filter({_SPLIT.format('translate(lower(text), ' + _sql([PUNCTUATION]) + ', ' + chr(39) * 2 + ')')}, lambda x: x NOT IN ({_sql(STOP_CS)}))",
    "cbow": f"list_filter({_SPLIT.format('regexp_replace(lower(text), ' + chr(39) + '[^a-z' + CZECH_LETTERS + '0-9' + chr(92) + 's]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, lambda x: x NOT IN ({_sql(STOP_CS)}))",
}
TOKENS = {"ngram": text.ngram_tokens, "word": text.word_tokens, "index": text.index_tokens, "tfidf": text.tfidf_tokens, "cbow": text.cbow_tokens}


def _token_counts(kind):
    def query(spark, sf_dir):
        docs = _docs(spark, sf_dir)
        return docs.select(F.explode(TOKENS[kind](docs["text"])).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))

    return query


for _kind in TOKENS:
    QUERIES[f"tok_{_kind}_counts"] = _token_counts(_kind)
    ORACLE_SQL[f"tok_{_kind}_counts"] = f"SELECT token, count(*) AS cnt FROM (SELECT unnest({SQL_TOKENS[_kind]}) AS token FROM documents) GROUP BY token"


# --- n-gram language model ---
def _grams_sql(n: int) -> str:
    prefix = f"array_to_string(t[i : i + {n - 2}], ' ')" if n > 1 else "''"
    return f"SELECT doc_id, {prefix} AS prefix, t[i + {n - 1}] AS next, i - 1 AS pos FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM (SELECT doc_id, {SQL_TOKENS['ngram']} AS t FROM documents) WHERE len(t) >= {n})"


def _freq_sql(n: int) -> str:
    return f"SELECT prefix, next, count(*) AS cnt, min(doc_id * 16777216 + pos) AS first_pos FROM ({_grams_sql(n)}) GROUP BY prefix, next"


def _gram_sql() -> str:
    return "CASE WHEN prefix = '' THEN next ELSE prefix || ' ' || next END"


def _model_sql(n: int, alpha: float) -> str:
    if n == 1:
        prob = f"(cnt + {alpha}) / ({alpha} * (SELECT count(*) FROM ({_freq_sql(1)})))" if alpha else "cnt / 1"
        return f"SELECT *, {prob} AS prob FROM ({_freq_sql(1)})"
    before = f"SELECT {_gram_sql()} AS prefix, cnt AS prefix_cnt FROM ({_freq_sql(n - 1)})"
    prob = f"(cnt + {alpha}) / (prefix_cnt + {alpha} * (SELECT count(*) FROM ({_freq_sql(1)})))" if alpha else "cnt / prefix_cnt"
    return f"SELECT g.*, {prob} AS prob FROM ({_freq_sql(n)}) g JOIN ({before}) b USING (prefix)"


for _n, _name in ((1, "unigram"), (2, "bigram"), (3, "trigram")):
    QUERIES[f"{_name}_top"] = lambda spark, sf_dir, n=_n: language_model.top_grams(_docs(spark, sf_dir), n)
    ORACLE_SQL[f"{_name}_top"] = f"SELECT {_gram_sql()} AS gram, cnt FROM ({_freq_sql(_n)}) ORDER BY cnt DESC, first_pos LIMIT 10"

QUERIES["vocab_size"] = lambda spark, sf_dir: language_model.vocabulary_size(_docs(spark, sf_dir))
ORACLE_SQL["vocab_size"] = f"SELECT count(DISTINCT w) AS vocab_size FROM (SELECT unnest({SQL_TOKENS['ngram']}) AS w FROM documents)"


def _model_query(n, alpha):
    return lambda spark, sf_dir: language_model.probabilities(_docs(spark, sf_dir), n, alpha).select("prefix", "next", "cnt", F.round("prob", 9).alias("prob"))


for _name, _n, _alpha in (("bigram_mle", 2, 0.0), ("bigram_laplace", 2, 1.0), ("trigram_laplace", 3, 1.0)):
    QUERIES[_name] = _model_query(_n, _alpha)
    ORACLE_SQL[_name] = f"SELECT prefix, next, cnt, round(prob, 9) AS prob FROM ({_model_sql(_n, _alpha)})"

QUERIES["next_word"] = lambda spark, sf_dir: language_model.likeliest_words(_docs(spark, sf_dir)).withColumn("prob", F.round("prob", 9))
ORACLE_SQL["next_word"] = f"SELECT prefix, next, round(prob, 9) AS prob FROM ({_model_sql(2, 0.0)}) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY prob DESC, first_pos) = 1"


def _perplexity(n, alpha):
    def query(spark, sf_dir):
        out = language_model.own_perplexity(_docs(spark, sf_dir), n, alpha)
        return out.select("doc_id", "n_grams", F.format_string("%.5e", "perplexity").alias("perplexity"))

    return query


for _name, _n, _alpha in (("perplexity_uni", 1, 0.0), ("perplexity_bi", 2, 1.0), ("perplexity_tri", 3, 1.0)):
    QUERIES[_name] = _perplexity(_n, _alpha)
    ORACLE_SQL[_name] = (
        f"SELECT doc_id, count(next) AS n_grams, CASE WHEN count(next) = 0 THEN 'Infinity' ELSE printf('%.5e', exp(-avg(ln(coalesce(prob, 1e-10))))) END AS perplexity "
        f"FROM documents LEFT JOIN ({_grams_sql(_n)}) g USING (doc_id) LEFT JOIN ({_model_sql(_n, _alpha)}) m USING (prefix, next) GROUP BY doc_id"
    )


def perplexity_start(spark, sf_dir):
    """Of the first 1000 tokens of the corpus, by single words, pairs and triples."""
    out = spark.createDataFrame(language_model.start_perplexities(_docs(spark, sf_dir), ((1, 0.0), (2, 1.0), (3, 1.0))), "n int, n_grams long, perplexity double")
    return out.select("n", "n_grams", F.format_string("%.5e", "perplexity").alias("perplexity"))


def generated_text(spark, sf_dir):
    """Twenty words drawn from the models, for each of three seeds."""
    texts = language_model.generated(_docs(spark, sf_dir), [0, 1, 2])
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "seed int, text string")


QUERIES |= {f.__name__: f for f in (perplexity_start, generated_text)}
# The start's tokens in order, each with its document: n-grams do not cross documents.
_START = f"SELECT doc_id, i, tok FROM (SELECT doc_id, unnest({SQL_TOKENS['ngram']}) AS tok, generate_subscripts({SQL_TOKENS['ngram']}, 1) AS i FROM documents) ORDER BY doc_id, i LIMIT 1000"
_START_GRAMS = {
    1: "SELECT '' AS prefix, tok AS next FROM st",
    2: "SELECT a.tok AS prefix, b.tok AS next FROM st a JOIN st b ON a.doc_id = b.doc_id AND b.i = a.i + 1",
    3: "SELECT a.tok || ' ' || b.tok AS prefix, c.tok AS next FROM st a JOIN st b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN st c ON a.doc_id = c.doc_id AND c.i = a.i + 2",
}
ORACLE_SQL["perplexity_start"] = f"WITH st AS MATERIALIZED ({_START}) " + " UNION ALL ".join(
    f"SELECT {n} AS n, count(*) AS n_grams, printf('%.5e', exp(-avg(ln(coalesce(prob, 1e-10))))) AS perplexity FROM ({_START_GRAMS[n]}) g LEFT JOIN ({_model_sql(n, a)}) m USING (prefix, next)" for n, a in ((1, 0.0), (2, 1.0), (3, 1.0))
)


# --- pattern search ---
def pattern_positions(spark, sf_dir):
    return pattern_search.search(_docs(spark, sf_dir), PATTERN).select("doc_id", F.explode("positions").alias("pos"))


def pattern_overlapping(spark, sf_dir):
    """Hits of a pattern that overlaps itself."""
    return pattern_search.search(_docs(spark, sf_dir), OVERLAPPING).select("doc_id", F.explode("positions").alias("pos"))


def pattern_nonoverlap(spark, sf_dir):
    out = pattern_search.search(_docs(spark, sf_dir), OVERLAPPING)
    return out.select("doc_id", F.size("apart_positions").alias("n_hits"), F.size("positions").alias("n_all"), F.get("apart_positions", F.lit(0)).alias("first_hit"))


def pattern_choice(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", *[pattern_search.chosen_method(docs["text"], F.lit(p)).alias(n) for n, p in (("short", "word"), ("long", PATTERN * 30))])


def pattern_comparisons(spark, sf_dir):
    return pattern_search.comparisons(_docs(spark, sf_dir), PATTERN)


def pattern_brute_comparisons(spark, sf_dir):
    """Brute force's comparisons on every document."""
    return pattern_comparisons(spark, sf_dir).select("doc_id", "brute_force", "method")


def pattern_harness(spark, sf_dir):
    """Texts x methods: a short and a long text, a sequence of four letters, and three
    with patterns that have borders."""
    return pattern_search.harness(spark, HARNESS)


HARNESS = {
    "dna": ("AGCT" * 15, "AGCT"),
    "short": ("a small text about time, people and the time they have", "time"),
    "long": (" ".join(f"line {i} of a longer text, at times about people" for i in range(60)), "people"),
    "borders": ("abababcababababdabab" * 4, "ababab"),
    "runs": ("aaabaaaabaaaaab" * 5, "aaaa"),
    "wide": ("abcdefg", "abcde"),
}
QUERIES |= {f.__name__: f for f in (pattern_positions, pattern_overlapping, pattern_nonoverlap, pattern_choice, pattern_comparisons, pattern_brute_comparisons, pattern_harness)}
# The pattern cannot overlap itself, so the pieces between its hits give all of them.
ORACLE_SQL["pattern_positions"] = f"""
WITH p AS (SELECT doc_id, string_split(text, '{PATTERN}') AS ps FROM documents WHERE contains(text, '{PATTERN}')),
u AS (SELECT doc_id, unnest(ps) AS s, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM p)
SELECT doc_id, (sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) + {len(PATTERN)} * (i - 1))::INT AS pos FROM u QUALIFY i < n"""
_HITS = f"list_filter(range(0, length(text)), lambda i: substr(text, i + 1, {len(OVERLAPPING)}) = '{OVERLAPPING}')"
ORACLE_SQL["pattern_overlapping"] = f"SELECT doc_id, unnest({_HITS})::INT AS pos FROM documents WHERE contains(text, '{OVERLAPPING}')"
ORACLE_SQL["pattern_nonoverlap"] = f"SELECT doc_id, (len(string_split(text, '{OVERLAPPING}')) - 1)::INT AS n_hits, len({_HITS})::INT AS n_all, (instr(text, '{OVERLAPPING}') - 1)::INT AS first_hit FROM documents WHERE contains(text, '{OVERLAPPING}')"
_CHOICE = "CASE WHEN {m} > length(text) // 2 THEN 'kmp' WHEN {m} <= 5 AND {d} > 3 THEN 'horspool' ELSE 'brute_force' END"
ORACLE_SQL["pattern_choice"] = f"SELECT doc_id, {_CHOICE.format(m=4, d=4)} AS short, {_CHOICE.format(m=30 * len(PATTERN), d=4)} AS long FROM documents"

# Each alignment costs one, and one more for every character that agrees before its last.
_AGREE = " + ".join("len(list_filter(range(1, len(c) - {m} + 2), lambda i: {eq}))".format(m=len(PATTERN), eq=" AND ".join(f"c[i + {k}] = '{x}'" for k, x in enumerate(PATTERN[:j]))) for j in range(1, len(PATTERN)))
ORACLE_SQL["pattern_brute_comparisons"] = f"SELECT doc_id, (greatest(length(t) - {len(PATTERN) - 1}, 0) + {_AGREE})::BIGINT AS brute_force, {_CHOICE.format(m=4, d=4).replace('length(text)', 'length(t)')} AS method FROM (SELECT doc_id, t, string_split(t, '') AS c FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"
# The three searches character by character, as steps of a recursive query.
_CASES = ", ".join(f"({_sql([n])}, {_sql([t])}, {_sql([p])})" for n, (t, p) in HARNESS.items())
ORACLE_SQL["pattern_harness"] = f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT name, t, p, length(t) AS n, length(p) AS m FROM (VALUES {_CASES}) v(name, t, p)),
border AS MATERIALIZED (SELECT name, q, (SELECT coalesce(max(k), 0) FROM range(0, q) r(k) WHERE left(left(p, q), k::INT) = right(left(p, q), k::INT)) AS b FROM (SELECT name, p, unnest(range(1, m + 1)) AS q FROM c)),
kmp AS (
  SELECT name, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS cost FROM c
  UNION ALL
  SELECT name,
    CASE WHEN same THEN i + 1 WHEN j = 0 THEN i + 1 ELSE i END,
    CASE WHEN same AND j + 1 < m AND (i + 1 >= n OR ahead) THEN j + 1 WHEN same THEN (SELECT b FROM border x WHERE x.name = s.name AND x.q = s.j + 1) WHEN j = 0 THEN 0 ELSE (SELECT b FROM border x WHERE x.name = s.name AND x.q = s.j) END,
    cost + 1 + CASE WHEN NOT same THEN 1 WHEN j + 1 < m AND i + 1 < n AND NOT ahead THEN 1 ELSE 0 END
  FROM (SELECT k.*, n, m, substr(t, k.i + 1, 1) = substr(p, k.j + 1, 1) AS same, substr(t, k.i + 2, 1) = substr(p, k.j + 2, 1) AS ahead FROM kmp k JOIN c USING (name) WHERE k.i < n) s
),
bmh AS (
  SELECT name, 0::BIGINT AS i, 0::BIGINT AS cost FROM c
  UNION ALL
  SELECT name, i + CASE WHEN agree = m THEN m ELSE coalesce(list_min(list_filter(list_transform(range(1, m), lambda k: CASE WHEN substr(p, (m - k)::INT, 1) = last THEN k END), lambda k: k IS NOT NULL)), m) END, cost + least(agree + 1, m)
  FROM (SELECT b.*, n, m, p, substr(t, (b.i + m)::INT, 1) AS last, (SELECT coalesce(max(k), 0) FROM range(0, m + 1) r(k) WHERE right(p, k::INT) = substr(t, (b.i + m - k + 1)::INT, k::INT)) AS agree FROM bmh b JOIN c USING (name) WHERE b.i <= n - m)
),
brute AS (SELECT name, greatest(n - m + 1, 0) + list_sum(list_transform(range(1, m), lambda k: len(list_filter(range(0, n - m + 1), lambda i: substr(t, (i + 1)::INT, k::INT) = left(p, k::INT))))) AS cost, m, n, len(list_distinct(string_split(p, ''))) AS d FROM c),
every AS (SELECT b.name, b.cost AS brute_force, k.cost AS kmp, h.cost AS horspool, m, n, d FROM brute b JOIN (SELECT name, max(cost) AS cost FROM kmp GROUP BY name) k USING (name) JOIN (SELECT name, max(cost) AS cost FROM bmh GROUP BY name) h USING (name))
SELECT name, brute_force::BIGINT AS brute_force, kmp::BIGINT AS kmp, horspool::BIGINT AS horspool, CASE WHEN m > n // 2 THEN 'kmp' WHEN m <= 5 AND d > 3 THEN 'horspool' ELSE 'brute_force' END AS method,
  (CASE WHEN m > n // 2 THEN kmp WHEN m <= 5 AND d > 3 THEN horspool ELSE brute_force END)::BIGINT AS hybrid FROM every"""


# --- spelling ---
def _misspelled(spark):
    return spark.createDataFrame([(w,) for w in MISSPELLED], "word string")


def spell_variants(spark, sf_dir):
    """Variants of the words to correct that the dictionary has."""
    d = spelling.dictionary(_docs(spark, sf_dir))
    return spelling.candidates(_misspelled(spark)).join(d.select(F.col("word").alias("variant"), "freq"), "variant").select("word", "variant", "freq")


def spell_most_frequent(spark, sf_dir):
    return spelling.most_frequent(_misspelled(spark), spelling.dictionary(_docs(spark, sf_dir)))


def spell_closest(spark, sf_dir):
    """Over the whole dictionary.  The SQL looks at ASCII words alone, as DuckDB
    counts bytes: it gives the same rows where no other word is closest."""
    return spelling.closest(_misspelled(spark), spelling.dictionary(_docs(spark, sf_dir)))


def char_bigram_index(spark, sf_dir):
    return spelling.bigram_index(spelling.dictionary(_docs(spark, sf_dir)))


def spell_bigram_logprob(spark, sf_dir):
    """The score of every dictionary word."""
    d = spelling.dictionary(_docs(spark, sf_dir))
    scored = spelling.bigram_scores(d.select(F.col("word").alias("variant")), spelling.bigram_index(d))
    return scored.select("variant", F.round("score", 6).alias("score"))


def spell_best_bigrams(spark, sf_dir):
    """The variant with the likeliest pairs of characters."""
    d = spelling.dictionary(_docs(spark, sf_dir))
    return spelling.best_by_bigrams(_misspelled(spark), spelling.bigram_index(d)).withColumn("score", F.round("score", 6))


def _sentences(spark, sf_dir, strategy):
    """Every document's text with the words to correct replaced by a strategy."""
    docs = _docs(spark, sf_dir)
    fixes = stored(strategy(_misspelled(spark), spelling.dictionary(docs)))
    fixed = spelling.correct_sentences(docs.select(F.col("doc_id").alias("sent_id"), "text"), fixes)
    return fixed.select(F.col("sent_id").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def spell_sentence(spark, sf_dir):
    return _sentences(spark, sf_dir, spelling.most_frequent)


def spell_sentence_closest(spark, sf_dir):
    return _sentences(spark, sf_dir, spelling.closest)


def spell_sentence_bigrams(spark, sf_dir):
    return _sentences(spark, sf_dir, lambda words, d: spelling.best_by_bigrams(words, spelling.bigram_index(d)))


QUERIES |= {f.__name__: f for f in (spell_variants, spell_most_frequent, spell_closest, char_bigram_index, spell_bigram_logprob, spell_best_bigrams, spell_sentence, spell_sentence_closest, spell_sentence_bigrams)}
_DICT = f"SELECT word, count(*) AS freq, min(doc_id * 16777216 + pos) AS first_pos FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {_WORDS} AS w FROM documents)) GROUP BY word"
_LETTERS = "[" + _sql(dict.fromkeys(EDIT_ALPHABET)) + "]"
_VARIANTS = f"""
SELECT DISTINCT word, unnest(list_concat([word],
  list_concat(flatten(list_transform(range(0, length(word) + 1), lambda i: list_transform({_LETTERS}, lambda c: left(word, i) || c || substr(word, i + 1)))),
  list_concat(list_transform(range(0, length(word)), lambda i: left(word, i) || substr(word, i + 2)),
  list_concat(flatten(list_transform(range(0, length(word)), lambda i: list_transform({_LETTERS}, lambda c: left(word, i) || c || substr(word, i + 2)))),
  list_transform(range(0, length(word) - 1), lambda i: left(word, i) || substr(word, i + 2, 1) || substr(word, i + 1, 1) || substr(word, i + 3))))))) AS variant
FROM (SELECT unnest([{_sql(MISSPELLED)}]) AS word)"""
ORACLE_SQL["spell_variants"] = f"SELECT v.word, variant, freq FROM ({_VARIANTS}) v JOIN ({_DICT}) d ON d.word = variant"
_BEST = f"SELECT q.word, variant AS correction, freq FROM (SELECT unnest([{_sql(MISSPELLED)}]) AS word) q LEFT JOIN ({ORACLE_SQL['spell_variants']}) v USING (word) QUALIFY row_number() OVER (PARTITION BY q.word ORDER BY freq DESC, variant) = 1"
ORACLE_SQL["spell_most_frequent"] = _BEST
ORACLE_SQL["spell_closest"] = f"SELECT q AS word, word AS correction, levenshtein(q, word)::INT AS distance FROM (SELECT unnest([{_sql(MISSPELLED)}]) AS q), ({_DICT}) WHERE NOT regexp_matches(word, '[^a-z0-9_]') QUALIFY row_number() OVER (PARTITION BY q ORDER BY levenshtein(q, word), first_pos) = 1"
_BIGRAMS = f"SELECT bigram, word, count(*) AS cnt FROM (SELECT word, unnest(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) AS bigram FROM ({_DICT})) GROUP BY bigram, word"
ORACLE_SQL["char_bigram_index"] = _BIGRAMS
ORACLE_SQL["spell_bigram_logprob"] = f"""
WITH b AS ({_BIGRAMS}), t AS (SELECT bigram, sum(cnt) AS total FROM b GROUP BY bigram)
SELECT word AS variant, round(coalesce(sum(cnt * ln(cnt / total)), 0.0), 6) AS score FROM ({_DICT}) LEFT JOIN b USING (word) LEFT JOIN t USING (bigram) GROUP BY word"""
ORACLE_SQL["spell_best_bigrams"] = f"""
WITH b AS MATERIALIZED ({_BIGRAMS}), t AS MATERIALIZED (SELECT bigram, sum(cnt) AS total FROM b GROUP BY bigram), v AS MATERIALIZED ({_VARIANTS}),
g AS (SELECT DISTINCT variant, unnest(CASE WHEN length(variant) > 1 THEN list_transform(range(1, length(variant)), lambda i: substr(variant, i, 2)) ELSE [''] END) AS bigram, generate_subscripts(CASE WHEN length(variant) > 1 THEN list_transform(range(1, length(variant)), lambda i: substr(variant, i, 2)) ELSE [''] END, 1) AS at FROM v),
s AS (SELECT variant, sum(CASE WHEN total IS NULL THEN 0.0 WHEN cnt IS NULL THEN -1e300 ELSE ln(cnt / total) END) AS score FROM g LEFT JOIN t USING (bigram) LEFT JOIN b ON b.bigram = g.bigram AND b.word = g.variant GROUP BY variant)
SELECT q.word, variant AS correction, round(score, 6) AS score FROM (SELECT unnest([{_sql(MISSPELLED)}]) AS word) q LEFT JOIN (SELECT word, variant, score FROM v JOIN s USING (variant) WHERE score > -1e200) x USING (word) QUALIFY row_number() OVER (PARTITION BY q.word ORDER BY score DESC, variant) = 1"""
for _name, _fix in (("spell_sentence", _BEST), ("spell_sentence_closest", ORACLE_SQL["spell_closest"]), ("spell_sentence_bigrams", ORACLE_SQL["spell_best_bigrams"])):
    ORACLE_SQL[_name] = f"""
WITH w AS (SELECT doc_id, {_SPLIT.format('lower(text)')} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)
SELECT doc_id, md5(string_agg(coalesce(correction, word), ' ' ORDER BY i)) AS text_md5 FROM u LEFT JOIN ({_fix}) f USING (word) GROUP BY doc_id"""


# --- index and boolean queries ---
def postings(spark, sf_dir):
    return index.postings(_docs(spark, sf_dir))


def index_stats(spark, sf_dir):
    return index.statistics(postings(spark, sf_dir)).withColumn("mean_list", F.round("mean_list", 6))


def idf_log10(spark, sf_dir):
    return index.idf_log10(_docs(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


QUERIES |= {f.__name__: f for f in (postings, index_stats, idf_log10)}
_POSTINGS = f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({SQL_TOKENS['index']}) AS term FROM documents) GROUP BY term, doc_id"
_N = "(SELECT count(*) FROM documents)"
ORACLE_SQL["postings"] = _POSTINGS
ORACLE_SQL["index_stats"] = f"SELECT count(DISTINCT term) AS n_terms, count(*) AS n_postings, round(count(*) / count(DISTINCT term), 6) AS mean_list FROM ({_POSTINGS})"
ORACLE_SQL["idf_log10"] = f"SELECT term, count(*) AS df, round(log10({_N} / count(*)), 6) AS idf FROM ({_POSTINGS}) GROUP BY term"
for _name, _q in BOOLEAN.items():
    QUERIES[_name] = lambda spark, sf_dir, q=_q: boolean.find(_docs(spark, sf_dir), q)
_SET = lambda w: f"SELECT doc_id FROM ({_POSTINGS}) WHERE term = '{w}'"
ORACLE_SQL |= {
    "bool_and": f"{_SET('en')} INTERSECT {_SET('re')}",
    "bool_or": f"{_SET('en')} UNION {_SET('th')}",
    "bool_not": f"SELECT doc_id FROM documents EXCEPT {_SET('en')}",
    "bool_nested": f"({_SET('en')} INTERSECT ({_SET('re')} UNION {_SET('th')})) EXCEPT {_SET('ha')}",
}
for _name, _q in RANKED.items():
    QUERIES[_name] = lambda spark, sf_dir, q=_q: boolean.rank(_docs(spark, sf_dir), q).select("doc_id", F.round("score", 6).alias("score"))


def bool_stored(spark, sf_dir):
    """The flagship's documents, from the index written once."""
    path = scratch_folder(spark)
    index.store(postings(spark, sf_dir), path)
    return boolean.find_stored(spark, path, _docs(spark, sf_dir), FLAGSHIP)


def bool_stored_not(spark, sf_dir):
    path = scratch_folder(spark)
    index.store(postings(spark, sf_dir), path)
    return boolean.find_stored(spark, path, _docs(spark, sf_dir), BOOLEAN["bool_not"])


def posting_list_digests(spark, sf_dir):
    """The sorted list of every term."""
    lists = index.posting_lists(postings(spark, sf_dir))
    return lists.select("term", F.size("ids").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary")).alias("ids_md5"))


QUERIES |= {f.__name__: f for f in (bool_stored, bool_stored_not, posting_list_digests)}
ORACLE_SQL["bool_stored"], ORACLE_SQL["bool_stored_not"] = ORACLE_SQL["bool_nested"], ORACLE_SQL["bool_not"]
ORACLE_SQL["posting_list_digests"] = f"SELECT term, count(*)::INT AS n, md5(string_agg((doc_id + 1)::VARCHAR, ',' ORDER BY doc_id)) AS ids_md5 FROM ({_POSTINGS}) GROUP BY term"
_LEAF = f"SELECT doc_id, term, (1 + log10(tf)) * log10({_N} / count(*) OVER (PARTITION BY term)) AS w FROM ({_POSTINGS})"
_W = lambda w: f"(SELECT doc_id, w FROM ({_LEAF}) WHERE term = '{w}' AND w <> 0)"
ORACLE_SQL |= {
    "ranked_and": f"SELECT doc_id, round(a.w + b.w, 6) AS score FROM {_W('en')} a JOIN {_W('re')} b USING (doc_id)",
    "ranked_or": f"SELECT doc_id, round(coalesce(a.w, 0) + coalesce(b.w, 0), 6) AS score FROM {_W('en')} a FULL JOIN {_W('th')} b USING (doc_id)",
    "ranked_and_not": f"SELECT doc_id, round(a.w + coalesce(b.w, 0) + coalesce(c.w, 0), 6) AS score FROM {_W('en')} a LEFT JOIN {_W('re')} b USING (doc_id) LEFT JOIN {_W('th')} c USING (doc_id) ANTI JOIN {_W('ha')} d USING (doc_id) WHERE b.w IS NOT NULL OR c.w IS NOT NULL",
}


def ranked_top10(spark, sf_dir):
    """The flagship query's first ten, with snippets."""
    return boolean.rank(_docs(spark, sf_dir), FLAGSHIP, 10).withColumn("score", F.round("score", 4))


QUERIES["ranked_top10"] = ranked_top10
ORACLE_SQL["ranked_top10"] = f"SELECT doc_id, round(score, 4) AS score, replace(left(text, 80), chr(10), ' ') || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS snippet FROM ({ORACLE_SQL['ranked_and_not']}) JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10"


# --- TF-IDF and cosine ---
def tfidf_weights(spark, sf_dir):
    return tfidf.weights(_docs(spark, sf_dir)).select("doc_id", "term", *[F.round(c, 6).alias(c) for c in ("tf", "idf", "w")])


def doc_norms(spark, sf_dir):
    return tfidf.norms(tfidf.weights(_docs(spark, sf_dir))).withColumn("norm", F.round("norm", 6))


def query_score_set(spark, sf_dir):
    return tfidf.query_scores(_docs(spark, sf_dir), QUERY_TEXT).withColumn("score", F.round("score", 6))


def query_score_multiset(spark, sf_dir):
    return tfidf.query_scores(_docs(spark, sf_dir), QUERY_TEXT, multiset=True).withColumn("score", F.round("score", 6))


def query_top10(spark, sf_dir):
    """The first ten documents of a query, its words as a set and as they stand."""
    docs = _docs(spark, sf_dir)
    parts = [tfidf.top_scores(docs, QUERY_TEXT, 10, m).select(F.lit(m).alias("multiset"), "rank", F.round("score", 6).alias("score")) for m in (False, True)]
    return parts[0].unionAll(parts[1])


def tfidf_binary(spark, sf_dir):
    """Weights by presence alone."""
    return tfidf.weights(_docs(spark, sf_dir), binary=True).select("doc_id", "term", *[F.round(c, 6).alias(c) for c in ("tf", "idf", "w")])


def tfidf_domain(spark, sf_dir):
    """Weights where some terms' inverse document frequency is 1."""
    return tfidf.weights(_docs(spark, sf_dir), domain=DOMAIN).select("doc_id", "term", *[F.round(c, 6).alias(c) for c in ("tf", "idf", "w")])


def cosine_neighbours(spark, sf_dir):
    """The ten most similar documents of every document whose id is divisible by 100."""
    docs = _docs(spark, sf_dir)
    out = tfidf.cosine_neighbours(tfidf.unit_vectors(tfidf.weights(docs)), docs.where("doc_id % 100 = 0").select("doc_id"))
    return out.select("query_id", "rank", F.round("similarity", 6).alias("similarity"))


def most_similar_pair(spark, sf_dir):
    return tfidf.most_similar_pair(_docs(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


QUERIES |= {"tfidf": tfidf_weights} | {f.__name__: f for f in (doc_norms, query_score_set, query_score_multiset, query_top10, tfidf_binary, tfidf_domain, cosine_neighbours, most_similar_pair)}
_TFIDF = f"""
SELECT *, tf * idf AS w FROM (SELECT doc_id, term, cnt / n AS tf, ln((SELECT count(*) FROM documents WHERE length(text) > 0) / count(*) OVER (PARTITION BY term)) AS idf
FROM (SELECT doc_id, term, count(*) AS cnt, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id, {SQL_TOKENS['tfidf']} AS t FROM documents WHERE length(text) > 0)) GROUP BY doc_id, term))"""
ORACLE_SQL["tfidf"] = f"SELECT doc_id, term, round(tf, 6) AS tf, round(idf, 6) AS idf, round(w, 6) AS w FROM ({_TFIDF})"
ORACLE_SQL["doc_norms"] = f"SELECT doc_id, round(sqrt(sum(w * w)), 6) AS norm FROM ({_TFIDF}) GROUP BY doc_id"
ORACLE_SQL["query_score_set"] = f"SELECT doc_id, round(sum(w), 6) AS score FROM ({_TFIDF}) WHERE term IN ({_sql(dict.fromkeys(QUERY_TEXT.split()))}) GROUP BY doc_id HAVING sum(w) > 1e-9"
ORACLE_SQL["query_score_multiset"] = f"SELECT d.doc_id, round(coalesce(sum(w), 0), 6) AS score FROM documents d LEFT JOIN (SELECT doc_id, w FROM ({_TFIDF}) JOIN (SELECT unnest([{_sql(QUERY_TEXT.split())}]) AS term) USING (term)) x USING (doc_id) WHERE length(d.text) > 0 GROUP BY d.doc_id"
_TOP10 = "SELECT {m} AS multiset, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, score FROM ({q}) ORDER BY rank LIMIT 10"
ORACLE_SQL["query_top10"] = f"SELECT * FROM ({_TOP10.format(m='false', q=ORACLE_SQL['query_score_set'])}) UNION ALL SELECT * FROM ({_TOP10.format(m='true', q=ORACLE_SQL['query_score_multiset'])})"
ORACLE_SQL["tfidf_binary"] = f"SELECT doc_id, term, 1.0::DOUBLE AS tf, round(idf, 6) AS idf, round(idf, 6) AS w FROM ({_TFIDF})"
ORACLE_SQL["tfidf_domain"] = f"SELECT doc_id, term, round(tf, 6) AS tf, round(i, 6) AS idf, round(tf * i, 6) AS w FROM (SELECT doc_id, term, tf, CASE WHEN term IN ({_sql(DOMAIN)}) THEN 1.0 ELSE idf END AS i FROM ({_TFIDF}))"
_UNIT = f"SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM ({_TFIDF}) WHERE w <> 0"
ORACLE_SQL["cosine_neighbours"] = f"""
WITH u AS MATERIALIZED ({_UNIT})
SELECT a.doc_id AS query_id, (row_number() OVER (PARTITION BY a.doc_id ORDER BY round(sum(a.v * b.v), 9) DESC, b.doc_id))::INT AS rank, round(least(1.0, sum(a.v * b.v)), 6) AS similarity
FROM u a JOIN u b ON a.term = b.term AND a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id QUALIFY rank <= 10"""
ORACLE_SQL["most_similar_pair"] = f"""
WITH u AS MATERIALIZED ({_UNIT})
SELECT a.doc_id AS d1, b.doc_id AS d2, round(least(1.0, sum(a.v * b.v)), 6) AS similarity FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id
GROUP BY d1, d2 ORDER BY round(sum(a.v * b.v), 9) DESC, d1, d2 LIMIT 1"""


# --- codes ---
def dgaps(spark, sf_dir):
    return index.document_gaps(_docs(spark, sf_dir))


def code_gamma(spark, sf_dir):
    return index.gap_counts(_docs(spark, sf_dir)).select("gap", "cnt", codes.gamma(F.col("gap")).alias("code"))


def code_fibonacci(spark, sf_dir):
    return index.gap_counts(_docs(spark, sf_dir)).select("gap", "cnt", codes.fibonacci(F.col("gap")).alias("code"))


def code_unary(spark, sf_dir):
    return index.gap_counts(_docs(spark, sf_dir)).select("gap", "cnt", codes.unary(F.col("gap")).alias("code"))


def posting_sizes(spark, sf_dir):
    out = index.document_code_sizes(_docs(spark, sf_dir))
    return out.select(*[F.col(c).cast("long").alias(c) if c.endswith("_bits") else F.round(c, 9).alias(c) for c in out.columns])


def _wanted(spark, sf_dir):
    """Every (term, document divisible by 100) of the index, and the document after it."""
    p = postings(spark, sf_dir).where("doc_id % 100 = 0")
    return p.select("term", "doc_id").unionAll(p.select("term", (F.col("doc_id") + 1).alias("doc_id")))


def posting_member(spark, sf_dir):
    return index.member(postings(spark, sf_dir), _wanted(spark, sf_dir))


def posting_member_compressed(spark, sf_dir):
    segment = 1 << 12
    lists = stored(index.document_segments(_docs(spark, sf_dir), segment))
    asked = F.filter("ids", lambda x: (x - 1) % 100 == 0)
    wanted = lists.select("term", F.explode(F.flatten(F.transform(asked, lambda x: F.array(x, x + 1)))).alias("target"))
    return index.member_compressed(index.encoded_lists(lists, "gamma"), wanted, "gamma", segment).select("term", (F.col("target") - 1).alias("doc_id"), "found")


def _decoded(code):
    """Every list segment coded and decoded again, number by number."""

    def query(spark, sf_dir):
        coded = index.encoded_lists(index.document_segments(_docs(spark, sf_dir), 128), code, 128)
        return index.decoded_lists(coded, code, 128).select("term", "seg", F.array_join(F.col("gaps").cast("array<string>"), " ").alias("gaps"))

    return query


QUERIES |= {f.__name__: f for f in (dgaps, code_gamma, code_fibonacci, code_unary, posting_sizes, posting_member, posting_member_compressed)}
QUERIES |= {f"decoded_{c}": _decoded(c) for c in codes.ENCODERS}
_GAPS = f"SELECT term, doc_id + 1 AS doc_id, doc_id + 1 - coalesce(lag(doc_id + 1) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM ({_POSTINGS})"
ORACLE_SQL["dgaps"] = _GAPS
_GAP_COUNTS = f"SELECT gap, count(*) AS cnt FROM ({_GAPS}) GROUP BY gap"
_GAMMA = "repeat('1', length(bin(gap)) - 1) || '0' || substr(bin(gap), 2)"
ORACLE_SQL["code_gamma"] = f"SELECT gap, cnt, {_GAMMA} AS code FROM ({_GAP_COUNTS})"
ORACLE_SQL["code_unary"] = f"SELECT gap, cnt, repeat('1', gap - 1) || '0' AS code FROM ({_GAP_COUNTS})"
_FIBS = ", ".join(map(str, codes.fibonacci_numbers(1 << 62)))
_FIB = f"""
WITH RECURSIVE f AS (SELECT unnest([{_FIBS}]) AS fib, unnest(range(1, {len(codes.fibonacci_numbers(1 << 62)) + 1})) AS i),
g AS ({_GAP_COUNTS}),
z AS (
  SELECT gap, gap AS rest, (SELECT max(i) FROM f) AS i, '' AS bits FROM g
  UNION ALL
  SELECT gap, CASE WHEN rest >= fib THEN rest - fib ELSE rest END, z.i - 1, CASE WHEN rest >= fib THEN '1' || bits WHEN bits <> '' THEN '0' || bits ELSE '' END FROM z JOIN f USING (i)
)"""
ORACLE_SQL["code_fibonacci"] = f"{_FIB} SELECT gap, cnt, bits || '1' AS code FROM z JOIN g USING (gap) WHERE z.i = 0"
ORACLE_SQL["posting_sizes"] = f"""{_FIB}, fc AS (SELECT gap, length(bits) + 1 AS fl FROM z WHERE i = 0), r AS ({_GAPS}),
s AS (SELECT 8 * (sum(length(doc_id::VARCHAR)) + count(*) - count(DISTINCT term)) AS text_bits, sum(gap) AS unary_bits, sum(length({_GAMMA})) AS gamma_bits, sum(fl) AS fibonacci_bits FROM r JOIN fc USING (gap))
SELECT text_bits::BIGINT AS text_bits, unary_bits::BIGINT AS unary_bits, gamma_bits::BIGINT AS gamma_bits, fibonacci_bits::BIGINT AS fibonacci_bits,
  round(unary_bits / text_bits, 9) AS unary_ratio, round(gamma_bits / text_bits, 9) AS gamma_ratio, round(fibonacci_bits / text_bits, 9) AS fibonacci_ratio FROM s"""
_SEG_GAPS = f"SELECT term, (doc_id + 1) // 128 AS seg, string_agg((doc_id + 1 - coalesce(before, 0))::VARCHAR, ' ' ORDER BY doc_id) AS gaps FROM (SELECT term, doc_id, lag(doc_id + 1) OVER (PARTITION BY term, (doc_id + 1) // 128 ORDER BY doc_id) AS before FROM ({_POSTINGS})) GROUP BY term, seg"
ORACLE_SQL |= {f"decoded_{c}": _SEG_GAPS for c in codes.ENCODERS}
_ASKED = f"SELECT term, doc_id FROM ({_POSTINGS}) WHERE doc_id % 100 = 0"
_MEMBER = f"SELECT w.term, w.doc_id, p.tf IS NOT NULL AS found FROM ({_ASKED} UNION ALL SELECT term, doc_id + 1 FROM ({_ASKED})) w LEFT JOIN ({_POSTINGS}) p ON w.term = p.term AND w.doc_id = p.doc_id"
ORACLE_SQL["posting_member"] = ORACLE_SQL["posting_member_compressed"] = _MEMBER


# --- embeddings ---
def embedding_norms(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(embeddings.norm(F.col("embedding")), 5).alias("norm"))


def embedding_knn(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 100."""
    e = _table(spark, sf_dir, "embeddings")
    out = embeddings.nearest(e, e.where("vec_id % 100 = 0"))
    return out.select("query_id", "rank", F.round("similarity", 5).alias("similarity"))


def knn_label_accuracy(spark, sf_dir):
    """How often the nearest, or one of the five nearest, has the query's label."""
    e = _table(spark, sf_dir, "embeddings")
    near = embeddings.nearest(e, e.where("vec_id % 100 = 0")).join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("found")), "id")
    named = near.groupBy("query_id", F.col("found").alias("id")).agg(F.min("rank").alias("rank"))
    truth = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("id"))
    return embeddings.accuracy(named, truth).select("evaluated", F.round("top1", 6).alias("top1"), F.round("topk", 6).alias("topk"))


def _reversal(spark, sf_dir):
    """Pairs of each vector and its reverse."""
    e = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select(F.col("embedding").alias("x"), F.reverse("embedding").alias("y"), "vec_id")


def map_pairs(spark, sf_dir):
    """Pair matrices: a dictionary from each vector's name to the next one's, and one
    more row of every tenth; names without a vector fall out."""
    e = _table(spark, sf_dir, "embeddings")
    words = e.select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))
    rows = e.select(F.col("vec_id").cast("string").alias("source_word"), (F.col("vec_id") + 1).cast("string").alias("target_word"), "vec_id")
    both = rows.unionAll(rows.where("vec_id % 10 = 0")).drop("vec_id")
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return embeddings.pairs(words, words, both).select("source_word", "target_word", F.round(dot, 5).alias("dot"))


def map_loss(spark, sf_dir):
    """Loss and gradient of the map that changes nothing, over all pairs."""
    import numpy as np

    g = embeddings.gram(_reversal(spark, sf_dir).where("vec_id % 4 != 0"))
    w = np.eye(len(g.a))
    grad = g.gradient(w)
    rows = [("loss", 0, 0, round(g.loss(w), 4)), ("pairs", 0, 0, float(g.n))]
    rows += [("gradient", i, j, round(float(grad[i, j]), 4) + 0.0) for i in range(len(w)) for j in range(len(w))]
    return spark.createDataFrame(rows, "kind string, i int, j int, value double")


def translated_knn(spark, sf_dir):
    """Vectors mapped by the reversal, and the five nearest to what comes out."""
    import numpy as np

    e = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    asked = e.where("vec_id % 100 = 0").select("vec_id", "embedding")
    width = e.select(F.size("embedding")).first()[0]
    path = scratch_folder(spark)
    embeddings.save_map(np.eye(width)[::-1], spark, path)
    mapped = embeddings.apply_map(asked, embeddings.load_map(spark, path), "embedding")
    return embeddings.nearest(e, mapped, skip_self=False).select("query_id", "rank", F.round("similarity", 5).alias("similarity"))


def embedding_projection(spark, sf_dir):
    """The first two principal components of every vector."""
    e = _table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    return cbow.projection(e, 2, "embedding").select("vec_id", *[F.round(F.get("point", F.lit(i)), 4).alias(n) for i, n in enumerate("xy")])


def procrustes_fit(spark, sf_dir):
    """The loss of maps from each vector to its reverse: fitted by descent, in closed
    form, and none."""
    import numpy as np

    pairs = _reversal(spark, sf_dir)
    train, test = embeddings.gram(pairs.where("vec_id % 4 != 0")), embeddings.gram(pairs.where("vec_id % 4 = 0"))
    fit = embeddings.fit_map(train, test)
    exact = embeddings.procrustes(train)
    rows = [("descent", train.loss(fit.w), test.loss(fit.w), fit.epochs), ("closed_form", train.loss(exact), test.loss(exact), 0), ("identity", train.loss(np.eye(len(exact))), test.loss(np.eye(len(exact))), 0)]
    return spark.createDataFrame(rows, "method string, train_loss double, test_loss double, epochs int")


QUERIES |= {f.__name__: f for f in (embedding_norms, embedding_knn, knn_label_accuracy, map_pairs, map_loss, translated_knn, embedding_projection, procrustes_fit)}
_NEAR = "SELECT q.vec_id AS query_id, q.label AS label, t.vec_id AS id, t.label AS found, list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS similarity, (row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, t.vec_id))::INT AS rank FROM embeddings q JOIN embeddings t ON q.vec_id % 100 = 0 AND q.vec_id <> t.vec_id QUALIFY rank <= 5"
ORACLE_SQL["embedding_norms"] = "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings"
ORACLE_SQL["embedding_knn"] = f"SELECT query_id, rank, round(similarity, 5) AS similarity FROM ({_NEAR})"
ORACLE_SQL["knn_label_accuracy"] = f"SELECT count(*) AS evaluated, round(100 * avg(one::INT), 6) AS top1, round(100 * avg(five::INT), 6) AS topk FROM (SELECT query_id, bool_or(rank = 1 AND found = label) AS one, bool_or(found = label) AS five FROM ({_NEAR}) GROUP BY query_id)"

_DICTIONARY = "SELECT vec_id, vec_id + 1 AS next FROM embeddings UNION ALL SELECT vec_id, vec_id + 1 FROM embeddings WHERE vec_id % 10 = 0"
ORACLE_SQL["map_pairs"] = f"SELECT d.vec_id::VARCHAR AS source_word, d.next::VARCHAR AS target_word, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot FROM ({_DICTIONARY}) d JOIN embeddings a ON a.vec_id = d.vec_id JOIN embeddings b ON b.vec_id = d.next"
ORACLE_SQL["map_loss"] = """
WITH p AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x, list_reverse(embedding)::DOUBLE[] AS y, len(embedding) AS d FROM embeddings WHERE vec_id % 4 <> 0 AND embedding IS NOT NULL),
u AS MATERIALIZED (SELECT vec_id, unnest(range(0, d)) AS i, unnest(x) AS x, unnest(y) AS y FROM p), n AS (SELECT count(*) AS n FROM p)
SELECT 'loss' AS kind, 0 AS i, 0 AS j, round(sum((x - y) * (x - y)) / any_value(n), 4) AS value FROM u, n
UNION ALL SELECT 'pairs', 0, 0, n::DOUBLE FROM n
UNION ALL SELECT 'gradient', a.i::INT, b.i::INT, round(2 * sum((a.x - a.y) * b.x) / any_value(n), 4) + 0.0 FROM u a JOIN u b USING (vec_id), n GROUP BY a.i, b.i"""
ORACLE_SQL["translated_knn"] = "SELECT query_id, rank, round(similarity, 5) AS similarity FROM (SELECT q.vec_id AS query_id, list_cosine_similarity(list_reverse(q.embedding)::DOUBLE[], t.embedding::DOUBLE[]) AS similarity, (row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, t.vec_id))::INT AS rank FROM embeddings q JOIN embeddings t ON q.vec_id % 100 = 0 QUALIFY rank <= 5)"


# --- CBOW ---
def cbow_vocab(spark, sf_dir):
    return cbow.vocabulary(_docs(spark, sf_dir))


def cbow_pairs(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    out = cbow.context_pairs(docs, cbow.vocabulary(docs))
    return out.select("doc_id", "pos", F.array_join(F.transform("context", lambda x: x.cast("string")), " ").alias("context"), "target")


def cbow_neighbours(spark, sf_dir):
    """The five nearest words of each of the 100 most frequent, after an epoch."""
    docs = _docs(spark, sf_dir)
    vocab = stored(cbow.vocabulary(docs))
    model, _ = cbow.train(cbow.context_pairs(docs, vocab), 1001, epochs=1, rate=0.05, batch=128)
    vecs = cbow.vectors(model, vocab).where("ix > 0")
    out = embeddings.nearest(vecs, vecs.where("ix <= 100"), 5, "ix", "vec")
    return out.select("query_id", "id", F.round("similarity", 3).alias("similarity"), "rank")


QUERIES |= {f.__name__: f for f in (cbow_vocab, cbow_pairs, cbow_neighbours)}
_CBOW = f"SELECT doc_id, {SQL_TOKENS['cbow']} AS t FROM documents"
_VOCAB = f"SELECT word, row_number() OVER (ORDER BY cnt DESC, first_pos)::INT AS ix, cnt FROM (SELECT word, count(*) AS cnt, min(doc_id * 16777216 + pos) AS first_pos FROM (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos FROM ({_CBOW})) GROUP BY word) QUALIFY ix <= 1000"
ORACLE_SQL["cbow_vocab"] = _VOCAB
ORACLE_SQL["cbow_pairs"] = f"""
WITH c AS MATERIALIZED (SELECT doc_id, pos, coalesce(ix, 0) AS ix FROM (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos FROM ({_CBOW})) LEFT JOIN ({_VOCAB}) USING (word))
SELECT a.doc_id, a.pos, string_agg(b.ix::VARCHAR, ' ' ORDER BY b.pos) AS context, a.ix AS target
FROM c a JOIN (SELECT doc_id, pos, ix, unnest([pos - 2, pos - 1, pos + 1, pos + 2]) AS at FROM c) b ON a.doc_id = b.doc_id AND a.pos = b.at GROUP BY a.doc_id, a.pos, a.ix"""


# --- overlap of dialogue turns ---
def rouge_pairs(spark, sf_dir):
    keys = ["conv_id", "turn"]
    out = overlap.scores_of(overlap.dialogue_pairs(_table(spark, sf_dir, "conversations")), keys)
    return out.select(*keys, *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def rouge_mean(spark, sf_dir):
    out = overlap.mean_f1(overlap.dialogue_pairs(_table(spark, sf_dir, "conversations")), ["conv_id", "turn"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def rouge_first(spark, sf_dir):
    """The mean over the evaluation subset, the first thousand pairs."""
    keys = ["conv_id", "turn"]
    first = overlap.first_pairs(overlap.dialogue_pairs(_table(spark, sf_dir, "conversations")), keys)
    out = overlap.mean_f1(stored(first), keys)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def rouge_stemmed(spark, sf_dir):
    """Overlap of stems, per pair."""
    pairs, keys = overlap.dialogue_pairs(_table(spark, sf_dir, "conversations")), ["conv_id", "turn"]
    return overlap.scores(pairs, keys, 1, overlap.stemmed_tokens).select(*keys, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


QUERIES |= {f.__name__: f for f in (rouge_pairs, rouge_mean, rouge_first, rouge_stemmed)}
_DIALOGUE = "SELECT a.conv_id, a.turn, a.text AS r, b.text AS p FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant' WHERE trim(a.text) <> '' AND trim(b.text) <> ''"


def _overlap_sql(n: int) -> str:
    grams = lambda c: f"list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i : i + {n - 1}], ' '))"
    return f"""
SELECT conv_id, turn, CASE WHEN np > 0 THEN both_n / np ELSE 0.0 END AS precision, CASE WHEN nr > 0 THEN both_n / nr ELSE 0.0 END AS recall,
  CASE WHEN both_n > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
FROM (
  SELECT conv_id, turn, len(gp) AS np, len(gr) AS nr,
    coalesce(list_sum(list_transform(list_distinct(gp), lambda g: least(len(list_filter(gp, lambda x: x = g)), len(list_filter(gr, lambda x: x = g))))), 0) AS both_n
  FROM (SELECT conv_id, turn, {grams('tp')} AS gp, {grams('tr')} AS gr FROM (SELECT conv_id, turn, regexp_extract_all(lower(p), '[a-z0-9]+') AS tp, regexp_extract_all(lower(r), '[a-z0-9]+') AS tr FROM ({_DIALOGUE}))))"""


_SIX = lambda n: ", ".join(f"round({c}, 6) AS {c}_{n}" for c in ("precision", "recall", "f1"))
ORACLE_SQL["rouge_pairs"] = f"SELECT * FROM (SELECT conv_id, turn, {_SIX(1)} FROM ({_overlap_sql(1)})) JOIN (SELECT conv_id, turn, {_SIX(2)} FROM ({_overlap_sql(2)})) USING (conv_id, turn)"
ORACLE_SQL["rouge_mean"] = f"SELECT round(a.f, 6) AS f1_1, round(b.f, 6) AS f1_2 FROM (SELECT coalesce(avg(f1), 0) AS f FROM ({_overlap_sql(1)})) a, (SELECT coalesce(avg(f1), 0) AS f FROM ({_overlap_sql(2)})) b"

_ALL_PAIRS = "SELECT a.conv_id, a.turn, a.text AS r, b.text AS p FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'"
_FIRST = f"SELECT * FROM ({_ALL_PAIRS} ORDER BY a.conv_id, a.turn LIMIT 1000) WHERE trim(r) <> '' AND trim(p) <> ''"
ORACLE_SQL["rouge_first"] = ORACLE_SQL["rouge_mean"].replace(_DIALOGUE, _FIRST)
