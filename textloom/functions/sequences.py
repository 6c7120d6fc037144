"""What an encoder-decoder reads: positions, masks, scaled vectors, batches.

All are closed forms over rows or arrays; nothing is shuffled but in collate().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def position_code(pos: Column, dim: Column, width: Column) -> Column:
    """The sine (even places) or cosine (odd) of pos at the place's wavelength."""
    angle = pos * F.exp(-math.log(10_000.0) * (2 * F.floor(dim / 2)) / width)
    return F.when(dim % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def positions(spark: SparkSession, n: int, width: int) -> DataFrame:
    """pos, dim, value: the table of position codes."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("dim"))
    return rows.select("pos", "dim", position_code(F.col("pos"), F.col("dim"), F.lit(width)).alias("value"))


def model_input(vector: Column, pos: Column) -> Column:
    """A token's vector times the root of its width, plus its position's code."""
    width = F.size(vector)
    return F.transform(vector, lambda x, i: x.cast("double") * F.sqrt(width) + position_code(pos, i, width))


def causal_mask(spark: SparkSession, n: int) -> DataFrame:
    """i, j, hidden: place i must not see place j, which comes after it."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    return rows.select("i", "j", (F.col("j") > F.col("i")).alias("hidden"))


def padding_mask(ids: Column, pad: int = 0) -> Column:
    """Whether each id is padding."""
    return F.transform(ids, lambda x: x == pad)


def collate(rows: DataFrame, batch: str, order: str, ids: str) -> DataFrame:
    """batch, place, ids: each batch's sequences (of one length) turned from a row a
    sequence to a row a place."""
    held = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, ids))).alias("x"))
    own = F.transform("x", lambda s: F.get(s[ids], F.col("place")))
    return held.select(batch, "x", F.explode(F.sequence(F.lit(0), F.size(F.col("x")[0][ids]) - 1)).alias("place")).select(batch, "place", own.alias("ids"))
