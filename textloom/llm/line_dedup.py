"""Line dedup by a deletion-neighbourhood join, in DataFrame operations alone.

A line (a text is cut at line feeds) goes if an earlier line of the corpus equals
it, or, where both have `least` characters or more, is within one edit of it
(code points).  Earlier means a smaller document, then a smaller place in it;
lines are judged on the input, so a line may go because of one that goes itself.
Lines without a word always stay.

Equal lines become one by aggregation.  Two lines within one edit share their
first or their last half; only lines that share such a half with another take
part in the join, which loses nothing.  Each of those emits, as hashed keys, itself
and every variant with one character deleted.  The hash of a line combines its words'
hashes at their places, so the key of a variant costs only the words around the
deletion, however long the line, and stands for one text (64 bits).  Lines with one
variant, deleted at the same place, are within a substitution of each other, so the
earliest of such a group removes the others without pairs; a variant that is a line
itself gives an insertion or deletion.  Every decision is verified with levenshtein().

Defined results: null texts are empty; documents with a null id come after all
others; rows with equal id and text are one document, and all its copies get the
same lines; documents of equal id are ordered by a hash of their text; an empty
table gives an empty result; other columns are kept by drop_repeated_lines and
ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_names, materialize

_HAS_WORD = r"[^\x20\x09-\x0D]"


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _half_keys(line: Column) -> Column:
    """Hashes of the first and last half, for either length a mate may have."""
    n = F.length(line)
    big, small = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    key = lambda side, s: F.xxhash64(F.lit(side), s, F.left(line, s) if side == 0 else F.right(line, s))
    return F.array_distinct(F.array(key(0, big), key(1, big), key(0, small), key(1, small)))


def _variants(lines: DataFrame) -> DataFrame:
    """id, k, pos of each line(id, line) itself (pos -1) and with each character
    deleted.  The key of a line is the exclusive or of the hashes of its words, each
    with its number in the line, and the length.  h is a word's hash at its own
    number, g at the one before, which it has once two words before it are joined."""
    w = F.split("line", " ", -1)
    lines = lines.select("id", F.length("line").alias("n"), w.alias("w"))
    two = F.arrays_zip(F.col("w").alias("b"), F.slice("w", F.lit(2), F.size("w")).alias("c"))
    rows = lines.select("id", "n", F.posexplode(two).alias("j", "x")).select("id", "n", "j", "x.b", "x.c")
    rows = rows.withColumn("h", F.xxhash64("j", "b")).withColumn("g", F.xxhash64(F.col("j") - 1, "b"))
    whole = Window.partitionBy("id")
    before = whole.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda x: F.coalesce(x.over(before), F.lit(0))
    rows = rows.withColumn("all_h", F.bit_xor("h").over(whole)).withColumn("all_g", F.bit_xor("g").over(whole))
    rows = rows.withColumn("off", earlier(F.sum(F.length("b") + 1))).withColumn("pre_h", earlier(F.bit_xor("h"))).withColumn("pre_g", earlier(F.bit_xor("g")))
    itself = rows.where("j = 0").select("id", F.xxhash64("all_h", "n").alias("k"), F.lit(-1).cast("long").alias("pos"))
    last = F.when(F.col("c").isNull(), F.length("b") - 1).otherwise(F.length("b"))
    cut = rows.where((F.length("b") > 0) | F.col("c").isNotNull()).withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    xor = lambda first, *rest: xor(first.bitwiseXOR(rest[0]), *rest[1:]) if rest else first
    short = F.concat(F.expr("left(b, i)"), F.expr("substring(b, i + 2)"))
    inside = xor(F.col("all_h"), F.col("h"), F.xxhash64("j", short))
    # The blank after the word is deleted: both words are one, and the later ones move.
    joined = xor(F.col("pre_h"), F.xxhash64("j", F.concat("b", "c")), F.col("all_g"), F.col("pre_g"), F.col("g"), F.xxhash64("j", "c"))
    key = F.xxhash64(F.when(F.col("i") == F.length("b"), joined).otherwise(inside), F.col("n") - 1)
    return itself.unionAll(cut.select("id", key.alias("k"), (F.col("off") + F.col("i")).cast("long").alias("pos")))


def kept_places(docs: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, rk (hash of the text), places: per document the sorted places of the
    lines with a word that stay."""
    text = _text(docs)
    source = docs.select("doc_id", F.xxhash64(text).alias("rk"), text.alias("_text"))
    lines = source.select("doc_id", "rk", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(_HAS_WORD))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rk", "pos")
    keyed = lines.select(order.alias("o"), F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"), F.when(F.length("line") >= least, F.col("line")).alias("line"))
    # Equal lines meet before the shuffle; long ones carry their text from here on.
    one = materialize(keyed.groupBy("id", "id2").agg(F.min("o").alias("o"), F.any_value("line").alias("line")))

    halves = one.where("line is not null").select("id", F.explode(_half_keys(F.col("line"))).alias("half"))
    shared = halves.groupBy("half").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("half")
    part = halves.join(shared, "half", "left_semi").select("id").distinct()
    cand = materialize(one.join(part, "id", "left_semi").select("id", "o", "line"))
    part = cand.select("id", "o")

    variants = materialize(_variants(cand.select("id", "line")))
    hot = variants.groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("k")
    met = materialize(variants.join(hot, "k", "left_semi").join(part, "id").select("k", "pos", "id", F.struct("o", "id").alias("who")))
    deleted = met.where("pos >= 0").groupBy("k", "pos").agg(F.min("who").alias("first"))
    full = met.where("pos < 0").select("k", F.col("who").alias("line_of"))
    changed = met.where("pos >= 0").join(deleted, ["k", "pos"]).where("who != first").select("id", F.col("first.id").alias("by"))
    longer = met.where("pos >= 0").join(full, "k").where("line_of < who").select("id", F.col("line_of.id").alias("by"))
    first_longer = deleted.groupBy("k").agg(F.min("first").alias("first"))
    shorter = full.join(first_longer, "k").where("first < line_of").select(F.col("line_of.id").alias("id"), F.col("first.id").alias("by"))
    claims = changed.unionAll(longer).unionAll(shorter).where("id != by").distinct()
    text_of = cand.select(F.col("id").alias("by"), F.col("line").alias("by_line"))
    near = claims.join(cand.select("id", "line"), "id").join(text_of, "by").where(F.levenshtein("line", "by_line", 1) >= 0).select("id").distinct()
    near = materialize(near)
    discard(variants, met, cand)

    stay = one.select("id", "o").join(near, "id", "left_anti")
    return stay.groupBy(F.col("o.doc_id").alias("doc_id"), F.col("o.rk").alias("rk")).agg(F.sort_array(F.collect_list("o.pos")).alias("places"))


def dedup_lines(docs: DataFrame, least: int = 20) -> DataFrame:
    """docs with _n_lines (lines with a word), _n_removed and _kept (the text that is
    left) beside its own columns; where docs has such a column, it stays and the new
    one gets a further underscore."""
    return _dedup(docs, least)[0]


def _dedup(docs: DataFrame, least: int) -> tuple[DataFrame, list[str]]:
    """dedup_lines() and the names of its three columns."""
    rk, p_id, p_rk, places, every, flag, *added = free_names(docs, "rk", "p_id", "p_rk", "places", "every", "flag", "_n_lines", "_n_removed", "_kept")
    found = kept_places(docs.select("doc_id", "text"), least).select(F.col("doc_id").alias(p_id), F.col("rk").alias(p_rk), F.col("places").alias(places))
    text = _text(docs)
    rows = docs.withColumn(rk, F.xxhash64(text)).withColumn(every, F.split(text, "\n", -1))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col(p_id)) & (F.col(rk) == F.col(p_rk)), "left")
    gap = lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1), F.lit("1"))
    flags = F.split(F.array_join(F.transform(places, gap), ""), "")
    rows = rows.withColumn(flag, flags)
    worded = F.size(F.filter(every, lambda x: x.rlike(_HAS_WORD)))
    # Zipped, since a lambda would work its outer columns out again for each line.
    both = F.arrays_zip(F.col(every).alias("line"), F.coalesce(flag, F.array().cast("array<string>")).alias("stays"))
    kept = F.transform(F.filter(both, lambda x: x["line"].isNotNull() & (~x["line"].rlike(_HAS_WORD) | F.coalesce(x["stays"] == "1", F.lit(False)))), lambda x: x["line"])
    n_kept = F.when(F.col(places).isNull(), F.lit(0)).otherwise(F.size(places))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], worded.cast("long").alias(added[0]), (worded - n_kept).cast("long").alias(added[1]), F.array_join(kept, "\n").alias(added[2])), added


def drop_repeated_lines(docs: DataFrame, least: int = 20) -> DataFrame:
    """docs with the lines that stay as text (and its length as n_chars, if there is
    such a column); documents that had words and lost all of them go."""
    out, (n_lines, n_removed, kept) = _dedup(docs, least)
    fewer = F.col(n_removed) > 0
    new = {"text": F.when(fewer, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(fewer, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    left = out.where((F.col(n_lines) == 0) | (F.col(n_removed) < F.col(n_lines)))
    return left.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op10(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut
), full_lines AS (
  SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM lines
), one AS (
  SELECT line, min((doc_id, pos)) AS o, length(line) AS n FROM full_lines WHERE worded GROUP BY line
), halves AS (
  SELECT line, o, n, unnest(list_distinct([
    '0' || (n // 2)::VARCHAR || ':' || left(line, n // 2), '1' || (n // 2)::VARCHAR || ':' || right(line, n // 2),
    '0' || ((n - 1) // 2)::VARCHAR || ':' || left(line, (n - 1) // 2), '1' || ((n - 1) // 2)::VARCHAR || ':' || right(line, (n - 1) // 2)])) AS half
  FROM one WHERE n >= 20
), pairs AS (
  SELECT DISTINCT a.line AS early, b.line AS late FROM halves a JOIN halves b ON a.half = b.half AND a.o < b.o AND abs(a.n - b.n) <= 1
), near AS (
  SELECT DISTINCT late AS line FROM pairs
  WHERE len(list_filter(range(0, greatest(length(early), length(late))::BIGINT), lambda i:
      left(early, i) = left(late, i) AND (
        (length(early) = length(late) AND substr(early, i + 2) = substr(late, i + 2))
        OR (length(early) = length(late) + 1 AND substr(early, i + 2) = substr(late, i + 1))
        OR (length(early) + 1 = length(late) AND substr(early, i + 1) = substr(late, i + 2))))) > 0
), judged AS (
  SELECT f.doc_id, f.pos, f.line, f.worded,
         f.worded AND ((f.doc_id, f.pos) <> one.o OR near.line IS NOT NULL) AS gone
  FROM full_lines f LEFT JOIN one ON f.worded AND f.line = one.line LEFT JOIN near ON f.line = near.line
)
SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
