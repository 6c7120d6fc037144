"""Boolean and ranked boolean queries, compiled to one Column.

A query is read on the driver into a tree, before any Spark job; its leaves are the
only terms counted.  Every document is judged in place: the leaves' counts come
from its own tokens, so a query shuffles nothing but the counts of documents per
leaf (one row) and, if asked for, the top rows.

Two readings: `boolean` is set algebra.  `ranked` scores a term with
(1 + log10 tf) * log10(N / df); a term that every document has, or none, has no
members; NOT is unscored, and two unscored sides of an AND give nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_of, index_tokens, snippet

_APART = re.compile(r"\b(?:AND|OR)\b|\bNOT\b(?!\s)|[()]", re.IGNORECASE)
_EDGES = re.compile(r"^\W+|\W+$")
_BINDS = {"NOT": 3, "AND": 2, "OR": 1}


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class Both:
    left: Node
    right: Node


@dataclass(frozen=True)
class Either:
    left: Node
    right: Node


Node = Term | Not | Both | Either


def lex(query: str) -> list[str]:
    """Operators in capitals, parentheses, and terms in lower case without what is
    not a word character at their ends."""
    out = []
    for piece in _APART.sub(r" \g<0> ", query).split():
        if piece in "()" or piece.upper() in _BINDS:
            out.append(piece.upper())
        elif word := _EDGES.sub("", piece.lower()):
            out.append(word)
    return out


def _is_term(token: str) -> bool:
    return token not in _BINDS and token not in "()"


def parse(query: str, strict: bool = False) -> Node | None:
    """The tree of a query; None if it is empty.

    Neighbouring operands are joined by AND, but not before NOT (`a NOT b` is an
    error).  NOT groups from the left, so `a AND NOT NOT b` reads as
    (NOT a) AND (NOT b) and `a NOT` as NOT a; strict=True rejects both."""
    tokens = lex(query)
    if not tokens:
        return None
    done: list[Node] = []
    waiting: list[str] = []

    def reduce(op: str) -> None:
        need = 1 if op == "NOT" else 2
        if len(done) < need:
            raise QuerySyntaxError(f"{op} lacks an operand")
        args = done[-need:]
        del done[-need:]
        done.append(Not(*args) if op == "NOT" else Both(*args) if op == "AND" else Either(*args))

    def operator(op: str) -> None:
        while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[op]:
            reduce(waiting.pop())
        waiting.append(op)

    before = None
    for token in tokens:
        closes = before is not None and (before == ")" or _is_term(before))
        if closes and (token == "(" or _is_term(token)):
            operator("AND")
        if strict and token == "NOT" and (before == "NOT" or before == ")" or (before is not None and _is_term(before))):
            raise QuerySyntaxError("NOT stands for one operand and needs AND or OR before it")
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                reduce(waiting.pop())
            if not waiting:
                raise QuerySyntaxError("a closing parenthesis too many")
            waiting.pop()
        elif token in _BINDS:
            operator(token)
        else:
            done.append(Term(token))
        before = token
    while waiting:
        op = waiting.pop()
        if op == "(":
            raise QuerySyntaxError("a parenthesis is not closed")
        reduce(op)
    if len(done) != 1:
        raise QuerySyntaxError("an operator is missing")
    return done[0]


def terms(node: Node | None) -> list[str]:
    """The distinct terms, in order."""
    if node is None:
        return []
    if isinstance(node, Term):
        return [node.word]
    parts = [node.of] if isinstance(node, Not) else [node.left, node.right]
    return list(dict.fromkeys(w for p in parts for w in terms(p)))


def membership(node: Node, has: dict[str, Column]) -> Column:
    """Set algebra over `has`, the Columns that say whether a document has a term."""
    match node:
        case Term(word):
            return has[word]
        case Not(of):
            return ~membership(of, has)
        case Both(left, right):
            return membership(left, has) & membership(right, has)
        case Either(left, right):
            return membership(left, has) | membership(right, has)
    raise TypeError(node)


@dataclass(frozen=True)
class Ranked:
    member: Column
    score: Column
    scored: bool


def ranking(node: Node, weights: dict[str, Column]) -> Ranked:
    """Membership and score over `weights`, null where a document is no member of a
    term.  Whether a node is scored is known from the tree alone."""
    zero, never = F.lit(0.0), F.lit(False)
    match node:
        case Term(word):
            w = weights[word]
            return Ranked(w.isNotNull(), F.coalesce(w, zero), True)
        case Not(of):
            return Ranked(~ranking(of, weights).member, zero, False)
        case Both(left, right):
            a, b = ranking(left, weights), ranking(right, weights)
            if not a.scored and not b.scored:
                return Ranked(never, zero, False)
            m = a.member & b.member
            return Ranked(m, F.when(m, a.score + b.score).otherwise(zero), True)
        case Either(left, right):
            a, b = ranking(left, weights), ranking(right, weights)
            m = a.member | b.member
            return Ranked(m, F.when(m, a.score + b.score).otherwise(zero), True)
    raise TypeError(node)


def _counts(docs: DataFrame, words: list[str], tokens) -> DataFrame:
    """docs with tf_0, tf_1, ...: how often each word stands in the document."""
    own = F.filter(tokens(docs["text"]), lambda x: x.isin(*words))
    rows = docs.select("doc_id", "text", own.alias("_own"))
    return rows.select("doc_id", "text", *[count_of(F.col("_own"), w).alias(f"tf_{i}") for i, w in enumerate(words)])


def find(docs: DataFrame, query: str, strict: bool = False, tokens=index_tokens) -> DataFrame:
    """doc_id of the documents that a query selects.  An empty query selects none."""
    node = parse(query, strict)
    if node is None:
        return docs.select("doc_id").where(F.lit(False))
    words = terms(node)
    has = {w: F.col(f"tf_{i}") > 0 for i, w in enumerate(words)}
    return _counts(docs, words, tokens).where(membership(node, has)).select("doc_id")


def find_stored(spark, path: str, everything: DataFrame, query: str, strict: bool = False) -> DataFrame:
    """doc_id of the documents that a query selects, from an index written by
    index.store().  `everything` has every doc_id; it is read only by queries that
    select documents without any of their terms."""
    from ..operators import index

    node = parse(query, strict)
    if node is None:
        return everything.select("doc_id").where(F.lit(False))
    words = terms(node)
    own = index.load(spark, path, words).groupBy("doc_id").agg(*[F.bool_or(F.col("term") == w).alias(f"has_{i}") for i, w in enumerate(words)])
    has = {w: F.coalesce(F.col(f"has_{i}"), F.lit(False)) for i, w in enumerate(words)}
    without_any = spark.range(1).select(membership(node, {w: F.lit(False) for w in words})).first()[0]
    rows = everything.select("doc_id").join(own, "doc_id", "left") if without_any else own
    return rows.where(membership(node, has)).select("doc_id")


def rank(docs: DataFrame, query: str, k: int | None = None, strict: bool = False, tokens=index_tokens) -> DataFrame:
    """doc_id, score of the members of a ranked query; if k is given, the first k by
    falling score and then doc_id, with their snippet."""
    node = parse(query, strict)
    schema = "doc_id long, score double" + ", snippet string" * (k is not None)
    if node is None or isinstance(node, Not):
        return docs.sparkSession.createDataFrame([], schema)
    words = terms(node)
    counted = _counts(docs, words, tokens)
    dfs = counted.agg(F.count("*").alias("n_docs"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(words))])
    rows = counted.crossJoin(F.broadcast(dfs))  # one row
    weights = {}
    for i, w in enumerate(words):
        tf, idf = F.col(f"tf_{i}"), F.log10(F.col("n_docs") / F.col(f"df_{i}"))
        weights[w] = F.when((tf > 0) & (F.col(f"df_{i}") < F.col("n_docs")), (1 + F.log10(tf)) * idf)
    found = ranking(node, weights)
    if not found.scored:
        return docs.sparkSession.createDataFrame([], schema)
    out = rows.where(found.member).select("doc_id", found.score.alias("score"), snippet(F.col("text")).alias("snippet"))
    return out.orderBy(F.desc("score"), "doc_id").limit(k) if k is not None else out.drop("snippet")
