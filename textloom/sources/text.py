"""Text sources and sinks: whole files, folders, lines in either encoding, parts of
files, word vectors, translation pairs, and seeded generators.

Everything is read by Spark's readers, so paths may be in any store it reaches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str, glob: str = "*.txt", skip: tuple[str, ...] = (), keep_empty: bool = False) -> DataFrame:
    """file, text of the files in a folder whose names fit the glob, UTF-8.  Empty
    files are no documents; a missing folder has none if Spark is told to ignore it."""
    rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    if skip:
        rows = rows.where(~F.col("file").isin(*skip))
    full = rows.where(F.length("text") > 0)
    if not keep_empty:
        return full
    # Spark's scan may leave out files without bytes: they come from the listing.
    empty = [(n, "") for n in _empty_files(spark, path, glob) if n not in skip]
    return full.unionAll(spark.createDataFrame(empty, "file string, text string")) if empty else full


def _empty_files(spark: SparkSession, path: str, glob: str) -> list[str]:
    """Names of the files without bytes in a folder, as Spark's readers would see them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fits = hadoop.GlobFilter(glob)
    found = []
    for top in fs.globStatus(at) or []:
        for f in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            name = f.getPath().getName()
            if f.isFile() and f.getLen() == 0 and name[0] not in "._" and fits.accept(f.getPath()):
                found.append(name)
    return found


def whole_file(spark: SparkSession, path: str) -> DataFrame:
    """text of one file in lower case."""
    return spark.read.text(path, wholetext=True).select(F.lower("value").alias("text"))


def _lines(text):
    """The lines of a text; a final line feed starts no further line."""
    parts = F.split(text, r"\r\n|\r|\n", -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """file, text of every .txt file (in any case) that is not a part itself: UTF-8
    if the bytes are, else cp1252, else null."""
    @F.pandas_udf("string")
    def western(content: pd.Series) -> pd.Series:
        def read(b):
            try:
                return bytes(b).decode("cp1252")
            except UnicodeDecodeError:
                return None

        return content.map(read, na_action="ignore")

    rows = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")
    rows = rows.where(F.lower("file").endswith(".txt") & ~F.col("file").contains("_part_"))
    plain = F.is_valid_utf8(F.col("content").cast("string"))
    utf8 = rows.where(plain).select("file", F.col("content").cast("string").alias("text"))
    other = rows.where(~plain).select("file", western("content").alias("text"))
    return utf8.unionAll(other)


def split_parts(files: DataFrame, parts: int) -> DataFrame:
    """file, part (1 and on), part_file, n_lines, text: every file in parts of
    ceil(lines / parts) lines, one at least.  Files without lines give none.
    The file is one row, so is each part; nothing is shuffled."""
    lines = files.select("file", _lines(F.col("text")).alias("ls")).where(F.size("ls") > 0)
    size = F.ceil(F.size("ls") / parts).cast("int")
    rows = lines.withColumn("size", size).select("file", "ls", "size", F.explode(F.sequence(F.lit(1), F.ceil(F.size("ls") / F.col("size")).cast("int"))).alias("part"))
    own = F.slice("ls", (F.col("part") - 1) * F.col("size") + 1, F.col("size"))
    stem, suffix = F.regexp_replace("file", r"\.[^.]*$", ""), F.regexp_extract("file", r"(\.[^.]*)$", 1)
    number = F.when(F.col("part") < 10, F.concat(F.lit("0"), F.col("part").cast("string"))).otherwise(F.col("part").cast("string"))
    return rows.select("file", "part", F.concat(stem, F.lit("_part_"), number, suffix).alias("part_file"), F.size(own).alias("n_lines"), F.concat(F.array_join(own, "\n"), F.lit("\n")).alias("text"))


def write_files(files: DataFrame, folder: str, name: str = "file", encoding: str = "utf-8") -> DataFrame:
    """Write each row's text under its name into one folder (a URI that Arrow's file
    systems reach), by the tasks themselves.  Returns name and the number of bytes.  A
    task that runs again writes the same bytes under the same name."""
    import pyarrow as pa

    def run(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        for rb in batches:
            sizes = []
            for file, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                data = (text or "").encode(encoding)
                with where.open_output_stream(f"{base}/{file}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(sizes, pa.int64())], names=["file", "n_bytes"])

    done = files.select(F.col(name).alias("file"), "text").mapInArrow(run, "file string, n_bytes long")
    rows = done.persist()
    rows.count()
    return rows


def write_parts(parts: DataFrame, folder: str) -> DataFrame:
    """The rows of split_parts() as files of their names."""
    return write_files(parts, folder, "part_file")


def word_vectors(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """word, vec of a text file (or a folder's, by their names) with a word and its
    numbers on each line, after an optional line with count and width.  Lines of another
    width, or with something that is no number, are skipped; of a word's lines the last
    counts.  `limit`: only so many vectors from the start.

    The width is the header's or else that of the first line.  Spark reads the larger
    files and blocks first, so a line's place is its file, its block and its number."""
    place = ("file", "block", "line")
    found = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.split("value", " ").alias("p"))
    first = found.orderBy(*place).limit(1).collect()  # one line
    if not first:
        return spark.createDataFrame([], "word string, vec array<float>")
    head = first[0].p
    has_header = len(head) == 2 and all(x.isdigit() for x in head)
    width = int(head[1]) if has_header else len([x for x in head[1:] if x])
    is_first = (F.col("file") == first[0].file) & (F.col("block") == first[0].block) & (F.col("line") == first[0].line)
    body = found.where(~is_first) if has_header else found
    numbers = F.filter(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x != "")
    rows = body.select(*place, F.get("p", F.lit(0)).alias("word"), F.transform(numbers, lambda x: x.try_cast("float")).alias("vec"))
    rows = rows.where((F.size("vec") == width) & ~F.exists("vec", lambda x: x.isNull()))
    if limit is not None:
        rows = rows.orderBy(*place).limit(limit)
    return rows.groupBy("word").agg(F.max_by("vec", F.struct(*place)).alias("vec"))


def translation_pairs(spark: SparkSession, path: str) -> DataFrame:
    """source_word, target_word: cut at a tab, else at the first blank; lines
    without either are skipped."""
    v = F.trim("value")
    at = lambda sep: F.split(v, sep, 2)
    p = F.when(v.contains("\t"), at("\t")).otherwise(at(" "))
    return spark.read.text(path).select(p.alias("p")).where(F.size("p") == 2).select(F.trim(F.col("p")[0]).alias("source_word"), F.trim(F.col("p")[1]).alias("target_word")).where("source_word != '' and target_word != ''")


def _uniform(*seed):
    return (F.pmod(F.xxhash64(*seed), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def random_documents(spark: SparkSession, n_docs: int, vocabulary: int = 500, least: int = 50, most: int = 200, seed: int = 0) -> DataFrame:
    """doc_id, text: documents of random words of 3 to 10 letters, drawn with
    replacement.  Every value is a hash of its place and the seed, so rows do not
    depend on the partitioning."""
    length = (F.floor(_uniform(F.lit("length"), F.col("doc_id"), F.lit(seed)) * (most - least + 1)) + least).cast("int")
    letter = lambda w, i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.floor(_uniform(F.lit("letter"), w, i, F.lit(seed)) * 26) + 1).cast("int"), F.lit(1))
    size = lambda w: (F.floor(_uniform(F.lit("size"), w, F.lit(seed)) * 8) + 3).cast("int")
    which = lambda i: F.floor(_uniform(F.lit("word"), F.col("doc_id"), i, F.lit(seed)) * vocabulary)
    word = lambda i: F.array_join(F.transform(F.sequence(F.lit(1), size(which(i))), lambda j: letter(which(i), j)), "")
    return spark.range(n_docs).select(F.col("id").alias("doc_id")).select("doc_id", F.array_join(F.transform(F.sequence(F.lit(1), length), word), " ").alias("text"))


_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)


def keyed_round(key: str, constants: tuple[int, int, int, int]) -> str:
    """The SQL of a number below 2^31 drawn by a key: two linear steps modulo different
    primes."""
    a, b, c, e = constants
    return f"((({key} * {a} + {b}) % {_PRIMES[0]}) * {c} + {e}) % {_PRIMES[1]}"


def round_constants(seed: int, rounds: int = 6) -> list[tuple[int, int, int, int]]:
    """Numbers of the keyed rounds of random_postings(), from the seed alone."""
    import random

    rng = random.Random(seed)
    return [tuple(rng.randrange(1 << 20, 1 << 31) for _ in range(4)) for _ in range(rounds)]


def random_postings(spark: SparkSession, n_terms: int = 1000, n_docs: int = 10_000, n_pairs: int = 1_000_000, seed: int = 0) -> DataFrame:
    """term, doc_id: exactly n_pairs different pairs (or all there are), ids from 1.

    Pair numbers go through a keyed permutation of all pairs: a pair (term, document)
    has a hash of one part added to the other, by turns (a Feistel network over two
    ranges), so no pair is drawn twice and nothing is shuffled."""
    total = n_terms * n_docs
    rows = spark.range(min(n_pairs, total)).selectExpr(f"id div {n_docs} as t", f"id % {n_docs} as d")
    for i, constants in enumerate(round_constants(seed)):
        key, to, size = ("t", "d", n_docs) if i % 2 == 0 else ("d", "t", n_terms)
        rows = rows.selectExpr(key, f"({to} + {keyed_round(key, constants)}) % {size} as {to}")
    return rows.select(F.concat(F.lit("term"), F.col("t").cast("string")).alias("term"), (F.col("d") + 1).alias("doc_id"))


# The sample corpus's words and its seven documents for tests of queries.
SAMPLE_WORDS = (
    "informace", "vyhledávání", "index", "dokument", "text", "data",
    "systém", "model", "korpus", "slovo", "analýza", "počítač",
    "algoritmus", "web", "stránka", "dotaz", "výsledek", "relevantní",
    "unikátní", "specifický", "vzácný", "běžný",
)
SAMPLE_ENDING = ("je", "to", "test", "pro", "a", "na", "index", "dokument")
SAMPLE_DOCUMENTS = (
    "informace o vyhledávání a indexech jsou základ",
    "systém pro analýzu dat a relevantní informace",
    "vyhledávání informací na webu pomocí systému",
    "dokumenty a texty bez systému, pouze data",
    "index a data, data, data!",
    "velmi specifický unikátní dokument o ničem jiném",
    "běžný text obsahující běžný systém",
)


def sample_corpus(spark: SparkSession, n_docs: int, seed: int = 0) -> DataFrame:
    """doc_id, text: n_docs documents of the sample words (half drawn freely, half drawn
    again from those, all with the ending's words, in random order), then the seven.
    Every value is a hash of its place and the seed."""
    half = (F.floor(_uniform(F.lit("length"), F.col("doc_id"), F.lit(seed)) * 26 + 15) / 2).cast("int")
    words = F.array(*[F.lit(w) for w in SAMPLE_WORDS])
    pick = lambda kind, i, n: F.floor(_uniform(F.lit(kind), F.col("doc_id"), i, F.lit(seed)) * n).cast("int")
    drawn = F.transform(F.sequence(F.lit(1), F.col("half")), lambda i: F.get(words, pick("word", i, len(SAMPLE_WORDS))))
    again = F.concat(F.col("drawn"), F.array(F.lit("test"), F.lit("pro"), F.lit("a")))
    more = F.transform(F.sequence(F.lit(1), F.col("half")), lambda i: F.get(F.col("again"), pick("again", i, F.size("again"))))
    every = F.concat("drawn", more, F.array(*[F.lit(w) for w in SAMPLE_ENDING]))
    placed = F.transform(every, lambda w, i: F.struct(_uniform(F.lit("place"), F.col("doc_id"), i, F.lit(seed)).alias("at"), w.alias("w")))
    text = F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")
    rows = spark.range(n_docs).select(F.col("id").alias("doc_id")).withColumn("half", half).withColumn("drawn", drawn).withColumn("again", again)
    last = spark.createDataFrame([(n_docs + i, t) for i, t in enumerate(SAMPLE_DOCUMENTS)], "doc_id long, text string")
    return rows.select("doc_id", text.alias("text")).unionAll(last)
