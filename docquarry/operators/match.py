"""Boolean, phrase and prefix matching with BM25 on postings, as one SQL statement.

One scan of the postings keeps the terms that a query names, and one exchange by key gives every phrase's
weighted frequency; the query tree is then an expression over these columns.  The statement is text, as
its parts are made for each query and a single analysis is all that the driver does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ast import And, Node, Not, Or, Phrase, phrases, simplified

#: Fixed values of the ranking formula.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Corpus:
    """What ranking needs of the whole index, filters or not: keys, and their mean length."""

    n: int
    mean_tokens: float

    @classmethod
    def of(cls, stats: DataFrame) -> Corpus:
        n, mean = stats.agg(F.count("*"), F.coalesce(F.avg("n_tokens"), F.lit(0.0))).first()
        return cls(n, mean)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _wanted(phrase: Phrase, k: int) -> str:
    """The condition of a phrase's k-th token on a posting."""
    token = _quoted(phrase.tokens[k])
    last = phrase.prefix and k == len(phrase.tokens) - 1
    # the bounds of a prefix let Parquet skip files; startswith decides
    found = f"term >= {token} AND startswith(term, {token})" if last else f"term = {token}"
    return f"({found} AND field = {_quoted(phrase.field)})" if phrase.field else f"({found})"


def _frequencies(wanted: list[Phrase], weights: dict[str, float] | None, postings: str) -> str:
    """SELECT of ``key, w0, w1...``: how often each phrase stands in a key, by its fields' weights.

    A prefix counts each of its terms.
    """
    tests = [[_wanted(p, k) for k in range(len(p.tokens))] for p in wanted]
    named = " OR ".join(dict.fromkeys(t for of in tests for t in of))
    cases = " ".join(f"WHEN {_quoted(f)} THEN {float(w)}D" for f, w in (weights or {}).items())
    weight = f"CASE field {cases} ELSE 1D END" if cases else "1D"
    # a filter that joins would add to one use of the exchange of hits only, which would then not be shared
    scan = f"{postings} WHERE key IS NOT NULL AND ({named})"
    if all(len(of) == 1 for of in tests):
        sums = ", ".join(f"coalesce(sum(CASE WHEN {t} THEN tf * {weight} END), 0D) AS w{i}" for i, (t,) in enumerate(tests))
        return f"SELECT key, {sums} FROM {scan} GROUP BY key"
    # places of the k-th token, moved back by k: what all tokens have in common are the phrase's starts.  One
    # exchange by key serves this and what follows by key
    parts, times = [], []
    for i, of in enumerate(tests):
        if len(of) == 1:
            parts.append(f"coalesce(sum(CASE WHEN {of[0]} THEN tf END), 0) AS t{i}")
            times.append(f"t{i}")
        else:
            parts += [f"flatten(collect_list(CASE WHEN {t} THEN positions END)) AS t{i}_{k}" for k, t in enumerate(of)]
            common = f"t{i}_0"
            for k in range(1, len(of)):
                common = f"array_intersect({common}, transform(t{i}_{k}, x -> x - {k}))"
            times.append(f"size({common})")
    by_field = f"SELECT key, field, {', '.join(parts)} FROM (SELECT /*+ REPARTITION(key) */ * FROM {scan}) GROUP BY key, field"
    sums = ", ".join(f"sum({t} * {weight}) AS w{i}" for i, t in enumerate(times))
    return f"SELECT key, {sums} FROM ({by_field}) GROUP BY key"


def names(query: Node) -> Callable[[Column], Column]:
    """Whether the query names a term, in any field."""
    wanted = phrases(simplified(query))
    equal = sorted({t for p in wanted for t in (p.tokens[:-1] if p.prefix else p.tokens)})
    starts = sorted({p.tokens[-1] for p in wanted if p.prefix and p.tokens})
    return lambda term: reduce(lambda a, b: a | b, (term.startswith(t) for t in starts), term.isin(equal) if equal else F.lit(False))


def phrase_counts(postings: DataFrame, phrase: Phrase) -> DataFrame:
    """``key, times``: how often a phrase stands in each key that has it."""
    found = _frequencies([phrase], None, "{postings}")
    return postings.sparkSession.sql(f"SELECT key, CAST(w0 AS BIGINT) AS times FROM ({found}) WHERE w0 > 0", postings=postings)


def matched(node: Node, at: dict[int, str]) -> str:
    """The query tree over phrases' weighted frequencies, by the phrases' identity in the tree."""
    if isinstance(node, Phrase):
        return f"{at[id(node)]} > 0"
    left, right = matched(node.left, at), matched(node.right, at)
    if isinstance(node, And):
        return f"({left} AND {right})"
    return f"({left} OR {right})" if isinstance(node, Or) else f"({left} AND NOT ({right}))"


def _rank(node: Node, at: dict[int, str], parts: dict[int, str]) -> str:
    """Sum of the parts of phrases whose conjunct matched; what NOT excludes adds nothing."""
    if isinstance(node, Phrase):
        return parts[id(node)]
    value = _rank(node.left, at, parts)
    if not isinstance(node, Not):
        value = f"{value} + {_rank(node.right, at, parts)}"
    return f"CASE WHEN {matched(node, at)} THEN {value} ELSE 0D END"


def _numbered(node: Node | None) -> tuple[Node | None, list[Phrase]]:
    """A copy of the tree whose phrases are objects of their own, and these."""
    def copy(n: Node) -> Node:
        return replace(n) if isinstance(n, Phrase) else type(n)(copy(n.left), copy(n.right))

    node = None if node is None else copy(node)
    return node, phrases(node)


def search(postings: DataFrame, stats: DataFrame, query: Node, weights: dict[str, float] | None = None, corpus: Corpus | None = None, literal: Node | None = None, ranked: bool = True, more_of: tuple[str, ...] = ()) -> DataFrame:
    """``key, rank`` of every key that matches; lower ranks are better.  Without ``ranked``, only keys.

    ``weights`` are those of the fields (1 where absent).  With ``literal``, ``literal`` says whether
    that query matches as well, from the same scan.  ``more_of`` are columns of ``stats`` to go along.  In how many keys a phrase is comes from the same
    exchange of hits, as one row, and so does ``corpus`` where it isn't given.
    """
    tree, wanted = _numbered(simplified(query))
    other, more = _numbered(simplified(literal)) if literal is not None else (None, [])
    if tree is None:
        return stats.where(F.lit(False)).select("key", *([F.lit(0.0).alias("rank")] if ranked else []), *([F.lit(False).alias("literal")] if literal is not None else []))
    at = {id(p): f"w{i}" for i, p in enumerate(wanted + more)}
    flag = "" if literal is None else f", {matched(other, at) if other is not None else 'false'} AS literal"
    found = f"WITH found AS ({_frequencies(wanted + more, weights, '{postings}')}) "
    if not ranked:
        return postings.sparkSession.sql(f"{found} SELECT key{flag} FROM found WHERE {matched(tree, at)}", postings=postings)
    counts = ", ".join(f"count_if(w{i} > 0) AS d{i}" for i in range(len(wanted)))
    total = f"named_struct('n', {corpus.n}D, 'mean', {float(corpus.mean_tokens)}D)" if corpus else "(SELECT struct(CAST(count(*) AS DOUBLE) AS n, coalesce(avg(n_tokens), 0D) AS mean) FROM {stats})"
    along = "".join(f", {c}" for c in more_of)
    hits = f"SELECT found.*, s.n_tokens{''.join(f', s.{c}' for c in more_of)}, (SELECT struct({counts}) FROM found) AS df, {total} AS corpus FROM found JOIN {{stats}} s ON s.key = found.key WHERE {matched(tree, at)}"
    length = "n_tokens / CASE WHEN corpus.mean > 0 THEN corpus.mean ELSE 1D END"
    parts = {}
    for i, p in enumerate(wanted):
        idf = f"ln((corpus.n - df.d{i} + 0.5D) / (df.d{i} + 0.5D))"
        parts[id(p)] = f"CASE WHEN {idf} > 0 THEN {idf} ELSE {LEAST_IDF}D END * w{i} * {K1 + 1}D / (w{i} + {K1}D * ({1 - B}D + {B}D * {length}))"
    return postings.sparkSession.sql(f"{found} SELECT key, -({_rank(tree, at, parts)}) AS rank{flag}{along} FROM ({hits})", postings=postings, stats=stats)
