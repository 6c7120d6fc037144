"""Batches of id sequences for an encoder and a decoder: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences
from ..functions.text import encode_batch, lookup, shift_right, word_tokens
from ..operators import overlap
from ..operators.cbow import vocabulary
from .text import _WORDS, _table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LENGTH, LABELS, PREFIX, WIDTH = 24, 8, ("summarize", ":"), 16


def sequence_batches(spark, sf_dir):
    """Turns of dialogues by a vocabulary of 500 words: ids of the prefixed turn and
    their mask, the reply's ids as labels and, shifted, as decoder inputs."""
    turns = _table(spark, sf_dir, "conversations")
    docs = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    words = vocabulary(docs, 500, word_tokens).select("word", (F.col("ix") + 1).alias("ix")).orderBy("ix").collect()  # 500 rows
    find = lookup([(r.word, r.ix) for r in words])
    pairs = overlap.dialogue_pairs(turns).where("reference is not null and prediction is not null")
    own = encode_batch(word_tokens(F.col("reference")), find, LENGTH, PREFIX)
    reply = encode_batch(word_tokens(F.col("prediction")), find, LABELS)
    rows = pairs.select("conv_id", "turn", own.alias("own"), reply.alias("reply"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return rows.select("conv_id", "turn", text(F.col("own.ids")).alias("ids"), text(F.col("own.mask")).alias("mask"), text(F.col("reply.ids")).alias("labels"), text(shift_right(F.col("reply.ids"))).alias("decoder"))


def sequence_collated(spark, sf_dir):
    """The labels of each dialogue's pairs, turned from rows of ids to rows of places."""
    rows = sequence_batches(spark, sf_dir).select("conv_id", "turn", F.transform(F.split("labels", " "), lambda x: x.cast("int")).alias("ids"))
    out = sequences.collate(rows, "conv_id", "turn", "ids")
    return out.select("conv_id", "place", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def positional_encoding(spark, sf_dir):
    return sequences.positions(spark, 64, WIDTH).select("pos", "dim", F.round("value", 6).alias("value"))


def causal_mask(spark, sf_dir):
    return sequences.causal_mask(spark, LENGTH)


def embedding_inputs(spark, sf_dir):
    """Every vector scaled by the root of its width, with the code of a place added."""
    e = _table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    scaled = sequences.model_input(F.col("embedding"), F.col("vec_id") % 64)
    return e.select("vec_id", F.posexplode(scaled).alias("dim", "value")).select("vec_id", "dim", F.round("value", 4).alias("value"))


QUERIES |= {f.__name__: f for f in (sequence_batches, sequence_collated, positional_encoding, causal_mask, embedding_inputs)}

_VOCAB = f"SELECT word, row_number() OVER (ORDER BY cnt DESC, first_pos) + 1 AS ix FROM (SELECT word, count(*) AS cnt, min(doc_id * 16777216 + pos) AS first_pos FROM (SELECT conv_id * 1000 + turn AS doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) - 1 AS pos FROM conversations) GROUP BY word) QUALIFY ix <= 501"
_PAIRS = "SELECT a.conv_id, a.turn, a.text AS r, b.text AS p FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant' WHERE a.text IS NOT NULL AND b.text IS NOT NULL"
_R, _P = _WORDS.replace("text", "r"), _WORDS.replace("text", "p")


def _ids(words: str, n: int) -> str:
    """Per pair the list of ids of its words, and how many words it has."""
    coded = f"SELECT conv_id, turn, i, coalesce(ix, 1) AS id FROM (SELECT conv_id, turn, unnest({words}) AS word, generate_subscripts({words}, 1) AS i FROM pairs) LEFT JOIN vocab USING (word)"
    return f"SELECT p.conv_id, p.turn, count(i) AS n, coalesce(list(id ORDER BY i) FILTER (i <= {n}), []) AS ids FROM pairs p LEFT JOIN ({coded}) c ON p.conv_id = c.conv_id AND p.turn = c.turn GROUP BY p.conv_id, p.turn"


_PAD = "array_to_string(list_concat({ids}, list_transform(range(0, {n} - len({ids})), lambda i: 0)), ' ')"
_BATCHES = f"""
WITH vocab AS MATERIALIZED ({_VOCAB}), pairs AS MATERIALIZED ({_PAIRS}),
a AS ({_ids(f"list_concat(['summarize', ':'], {_R})", LENGTH)}), b AS ({_ids(_P, LABELS)})
SELECT a.conv_id, a.turn, {_PAD.format(ids="a.ids", n=LENGTH)} AS ids, array_to_string(list_transform(range(0, {LENGTH}), lambda i: (i < a.n)::INT), ' ') AS mask, {_PAD.format(ids="b.ids", n=LABELS)} AS labels,
  array_to_string(list_concat([0], list_concat(b.ids, list_transform(range(0, {LABELS} - len(b.ids)), lambda i: 0))[1 : {LABELS - 1}]), ' ') AS decoder
FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn"""
ORACLE_SQL["sequence_batches"] = _BATCHES
ORACLE_SQL["sequence_collated"] = f"SELECT conv_id, place::INT AS place, string_agg(id, ' ' ORDER BY turn) AS ids FROM (SELECT conv_id, turn, unnest(string_split(labels, ' ')) AS id, unnest(range(0, {LABELS})) AS place FROM ({_BATCHES})) GROUP BY conv_id, place"
_ANGLE = "{pos} * exp(-ln(10000.0) * (2 * ({dim} // 2)) / {width})"
_WAVE = "CASE WHEN {dim} % 2 = 0 THEN sin(" + _ANGLE + ") ELSE cos(" + _ANGLE + ") END"
ORACLE_SQL["positional_encoding"] = f"SELECT pos::INT AS pos, dim::INT AS dim, round({_WAVE.format(pos='pos', dim='dim', width=WIDTH)}, 6) AS value FROM range(64) a(pos), range({WIDTH}) b(dim)"
ORACLE_SQL["causal_mask"] = f"SELECT i::INT AS i, j::INT AS j, j > i AS hidden FROM range({LENGTH}) a(i), range({LENGTH}) b(j)"
ORACLE_SQL["embedding_inputs"] = f"SELECT vec_id, dim::INT AS dim, round(x * sqrt(d) + {_WAVE.format(pos='(vec_id % 64)', dim='dim', width='d')}, 4) AS value FROM (SELECT vec_id, len(embedding) AS d, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings WHERE embedding IS NOT NULL)"
