"""Sources, sinks and generators: what is written and read again, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embeddings, index
from ..sources import text as source
from ..storage import scratch_folder
from .text import _docs, _sql, _table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def split_parts(spark, sf_dir):
    """Every document as a file in at most five parts."""
    files = _docs(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), "text")
    out = source.split_parts(files.where("length(text) > 0"), 5)
    return out.select("part_file", "n_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _nation_files(spark, sf_dir):
    """A file per nation, with its customers' names, one on each line."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_name")
    lines = c.join(n, "k").groupBy("k", "n_name").agg(F.array_join(F.array_sort(F.collect_list("c_name")), "\n").alias("text"))
    return lines.select("k", F.concat("n_name", F.lit(".txt")).alias("file"), F.concat("text", F.lit("\n")).alias("text"))


def files_whole(spark, sf_dir):
    """Named files written and read again, one row each; another ending, an empty file
    and a skipped one are no documents."""
    folder = scratch_folder(spark)
    files = _nation_files(spark, sf_dir).select("file", "text")
    more = spark.createDataFrame([("notes.md", "no"), ("empty.txt", ""), ("script.txt", "no")], "file string, text string")
    source.write_files(files.unionAll(more), folder)
    out = source.whole_files(spark, folder, skip=("script.txt",))
    return out.select("file", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def files_decoded(spark, sf_dir):
    """Files of two encodings, told apart by their bytes; parts are left out."""
    folder = scratch_folder(spark)
    files = _nation_files(spark, sf_dir).select("k", "file", F.concat(F.lit("caf\u00e9 \u20ac "), "text").alias("text"))
    source.write_files(files.where("k % 2 = 0"), folder)
    source.write_files(files.where("k % 2 = 1").withColumn("file", F.replace("file", F.lit(".txt"), F.lit(".TXT"))), folder, encoding="cp1252")
    source.write_files(files.select(F.concat(F.lit("x_part_01"), "file").alias("file"), "text"), folder)
    return source.decoded_files(spark, folder).select("file", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def file_lower(spark, sf_dir):
    """One file in lower case."""
    folder = scratch_folder(spark)
    text = _table(spark, sf_dir, "nation").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " ").alias("text")).select(F.lit("all.txt").alias("file"), "text")
    source.write_files(text, folder)
    return source.whole_file(spark, f"{folder}/all.txt")


def files_parts(spark, sf_dir):
    """Files split into at most seven parts, written under the parts' names and read."""
    folder = scratch_folder(spark)
    source.write_parts(source.split_parts(_nation_files(spark, sf_dir), 7), folder)
    out = source.whole_files(spark, folder)
    return out.select("file", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def vec_file(spark, sf_dir):
    """Word vectors written as text and read again; a bad line falls out, and of two
    lines of a word the last counts."""
    folder = scratch_folder(spark)
    e = _table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    width = e.select(F.size("embedding")).first()[0]
    row = F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "))
    lines = e.orderBy("vec_id").select(row.alias("value"))
    first = spark.createDataFrame([(f"{e.count()} {width}",), ("w0 " + " ".join(["9"] * width),), ("bad 1 2 x",)], "value string").coalesce(1)
    first.unionAll(lines).write.text(folder)
    got = source.word_vectors(spark, folder)
    return got.select("word", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def translation_file(spark, sf_dir):
    """Pairs cut at a tab or at the first blank; other lines fall out."""
    folder = scratch_folder(spark)
    n = _table(spark, sf_dir, "nation").select("n_nationkey", F.split("n_name", " ")[0].alias("w"))
    sep = F.when(F.col("n_nationkey") % 2 == 0, "\t").otherwise(" ")
    n.select(F.concat("w", sep, F.lower("w"), F.lit(" x")).alias("value")).unionAll(n.select(F.col("w").alias("value"))).write.text(folder)
    return source.translation_pairs(spark, folder)


def gram_matrix(spark, sf_dir):
    """Sums of products of all vectors' entries, written as a map and read again."""
    e = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    path = scratch_folder(spark)
    embeddings.save_map(embeddings.gram(e.select(F.col("embedding").alias("x"), F.col("embedding").alias("y"))).a, spark, path)
    w = embeddings.load_map(spark, path)
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(w)], "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).select("i", "j", F.round("v", 3).alias("v"))


def sample_index(spark, sf_dir):
    """The index of the seven sample documents."""
    return index.postings(source.sample_corpus(spark, 0))


def sample_sizes(spark, sf_dir):
    """Lengths of 200 drawn sample documents lie where they should."""
    d = source.sample_corpus(spark, 200).where("doc_id < 200").select(F.size(F.split("text", " ")).alias("n"))
    return d.agg(F.count("*").alias("n_docs"), F.min(F.col("n") >= 22).alias("long_enough"), F.max(F.col("n") > 48).alias("too_long"), (F.countDistinct("n") > 5).alias("lengths_differ"))


def random_text(spark, sf_dir):
    """Sizes of the documents of a random vocabulary."""
    d = source.random_documents(spark, 300, seed=4).select(F.split("text", " ").alias("w"))
    return d.agg(F.count("*").alias("n_docs"), F.min(F.size("w") >= 50).alias("long_enough"), F.max(F.size("w") > 200).alias("too_long"), F.max(F.exists("w", lambda x: (F.length(x) < 3) | (F.length(x) > 10))).alias("odd_words"), (F.countDistinct(F.size("w")) > 60).alias("lengths_differ"))


def generated_postings(spark, sf_dir):
    """Lists of the seeded posting generator: their lengths and sums."""
    return source.random_postings(spark).groupBy("term").agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"), F.countDistinct("doc_id").alias("n_different"))


def generated_sizes(spark, sf_dir):
    """The generator's table through gaps and codes: bits of each code and ratios."""
    out = index.code_sizes(index.gap_rows(source.random_postings(spark)))
    return out.select(*[F.col(c).cast("long").alias(c) if c.endswith("_bits") else F.round(c, 9).alias(c) for c in out.columns])


def generated_lookups(spark, sf_dir):
    """Whether each lookup of the speed comparison finds its target in every code."""
    return index.lookup_speed(source.random_postings(spark), 3).select("list", "target", "method", "exists", "found")


QUERIES |= {f.__name__: f for f in (split_parts, files_whole, files_decoded, file_lower, files_parts, vec_file, translation_file, gram_matrix, sample_index, sample_sizes, random_text, generated_postings, generated_sizes, generated_lookups)}

ORACLE_SQL["split_parts"] = r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS a FROM documents WHERE length(text) > 0),
l AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1 : len(a) - 1] ELSE a END AS ls FROM d),
s AS (SELECT doc_id, ls, (len(ls) + 4) // 5 AS k FROM l WHERE len(ls) > 0),
p AS (SELECT doc_id, k, ls, unnest(range(0, (len(ls) + k - 1) // k)) AS i FROM s)
SELECT 'doc' || doc_id || '_part_' || lpad((i + 1)::VARCHAR, 2, '0') || '.txt' AS part_file, len(ls[i * k + 1 : (i + 1) * k])::INT AS n_lines,
  md5(array_to_string(ls[i * k + 1 : (i + 1) * k], chr(10)) || chr(10)) AS text_md5 FROM p"""
_FILES = "SELECT c_nationkey AS k, n_name, string_agg(c_name, chr(10) ORDER BY c_name) || chr(10) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"
ORACLE_SQL["files_whole"] = f"SELECT n_name || '.txt' AS file, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM ({_FILES})"
ORACLE_SQL["files_decoded"] = f"SELECT n_name || CASE WHEN k % 2 = 0 THEN '.txt' ELSE '.TXT' END AS file, md5('café € ' || text) AS text_md5 FROM ({_FILES})"
ORACLE_SQL["file_lower"] = "SELECT lower(string_agg(n_name, ' ' ORDER BY n_name)) AS text FROM nation"
ORACLE_SQL["files_parts"] = f"""
WITH l AS (SELECT n_name, string_split(rtrim(text, chr(10)), chr(10)) AS ls FROM ({_FILES})), s AS (SELECT *, (len(ls) + 6) // 7 AS k FROM l),
p AS (SELECT n_name, ls, k, unnest(range(0, (len(ls) + k - 1) // k)) AS i FROM s)
SELECT n_name || '_part_' || lpad((i + 1)::VARCHAR, 2, '0') || '.txt' AS file, md5(array_to_string(ls[i * k + 1 : (i + 1) * k], chr(10)) || chr(10)) AS text_md5 FROM p"""
ORACLE_SQL["vec_file"] = "SELECT 'w' || vec_id AS word, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings WHERE embedding IS NOT NULL"
ORACLE_SQL["translation_file"] = "SELECT string_split(n_name, ' ')[1] AS source_word, lower(string_split(n_name, ' ')[1]) || ' x' AS target_word FROM nation"
ORACLE_SQL["gram_matrix"] = """
WITH u AS MATERIALIZED (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL)
SELECT a.i::INT AS i, b.i::INT AS j, round(sum(a.x * b.x), 3) AS v FROM u a JOIN u b USING (vec_id) GROUP BY a.i, b.i"""
_SAMPLE = ", ".join(f"({i}, {_sql([t])})" for i, t in enumerate(source.SAMPLE_DOCUMENTS))
# Stop words of the sample documents, as the index leaves them out.
ORACLE_SQL["sample_index"] = f"SELECT term, doc_id::BIGINT AS doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS term FROM (VALUES {_SAMPLE}) v(doc_id, text)) WHERE length(term) > 1 AND term NOT IN ('jsou', 'pro', 'na') GROUP BY term, doc_id"
ORACLE_SQL["sample_sizes"] = "SELECT 200::BIGINT AS n_docs, true AS long_enough, false AS too_long, true AS lengths_differ"
ORACLE_SQL["random_text"] = "SELECT 300::BIGINT AS n_docs, true AS long_enough, false AS too_long, false AS odd_words, true AS lengths_differ"


def _generated() -> str:
    """The generator's rounds as nested queries."""
    rows = "SELECT i // 10000 AS t, i % 10000 AS d FROM range(1000000) r(i)"
    for i, (a, b, c, e) in enumerate(source.round_constants(0)):
        key, to, size = ("t", "d", 10000) if i % 2 == 0 else ("d", "t", 1000)
        rows = f"SELECT {key}, ({to} + ((({key} * {a} + {b}) % 2147483647) * {c} + {e}) % 2147483629) % {size} AS {to} FROM ({rows})"
    return f"SELECT 'term' || t AS term, (d + 1)::BIGINT AS doc_id FROM ({rows})"


ORACLE_SQL["generated_postings"] = f"SELECT term, count(*) AS n, sum(doc_id)::BIGINT AS total, count(DISTINCT doc_id) AS n_different FROM ({_generated()}) GROUP BY term"


def _generated_sizes() -> str:
    from .text import ORACLE_SQL as text_sql

    gaps = f"SELECT term, doc_id + 1 AS doc_id, doc_id + 1 - coalesce(lag(doc_id + 1) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM ({_generated()})"
    return text_sql["posting_sizes"].replace(text_sql["dgaps"], gaps)


ORACLE_SQL["generated_sizes"] = _generated_sizes()
