"""Token counts and searches over a stream of documents.

Tokenizing and matching are stateless; counts keep one row of state per term (or
per term and window), the latter dropped as the watermark passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_tokens
from ..plans.boolean import membership, parse, terms


def term_counts(docs: DataFrame, tokens=index_tokens) -> DataFrame:
    """term, tf, df over everything seen so far (output mode complete or update)."""
    words = docs.select(F.array_sort(tokens(docs["text"])).alias("w"))
    own = words.select(F.explode(F.map_entries(_counted(F.col("w")))).alias("e"))
    return own.groupBy(F.col("e.key").alias("term")).agg(F.sum("e.value").alias("tf"), F.count("*").alias("df"))


def windowed_term_counts(docs: DataFrame, time: str, window: str = "10 minutes", late: str = "5 minutes", tokens=index_tokens) -> DataFrame:
    """window, term, tf per event-time window; rows later than `late` are dropped by
    the watermark, as Spark defines it."""
    rows = docs.withWatermark(time, late).select(time, F.explode(tokens(F.col("text"))).alias("term"))
    return rows.groupBy(F.window(time, window), "term").agg(F.count("*").alias("tf"))


def _counted(words):
    """term -> count within one document, from its sorted tokens."""
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.size(F.filter(words, lambda x: x == w)).cast("long"))))


def matching(docs: DataFrame, query: str, tokens=index_tokens) -> DataFrame:
    """The documents of a stream that a boolean query selects, as they come."""
    node = parse(query)
    if node is None:
        return docs.where(F.lit(False))
    own = F.filter(tokens(docs["text"]), lambda x: x.isin(*terms(node)))
    has = {w: F.array_contains("_own", w) for w in terms(node)}
    return docs.withColumn("_own", own).where(membership(node, has)).drop("_own")
