"""Searches: query text to ranked hits with snippets."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import SearchError
from ..functions.morph import Morphology
from ..functions.snippet import result_snippet
from ..plans.ast import Node, phrases, simplified
from ..plans.parser import Filters, ParsedQuery, expansion, needles, parse, plain, query_tree
from ..schema import FIELD_WEIGHTS, HITS
from . import match
from .store import IndexStore

CONTENT, FILENAME = "content", "filename"
EXACT, MORPHOLOGICAL = "EXACT", "MORPHOLOGICAL"
#: So many hits can be sent to all tasks.
FEW = 100_000


@dataclass(frozen=True)
class SearchRequest:
    query: str
    mode: str = CONTENT
    #: Rows at most; negative for all.
    limit: int = 10


def like_part(value: str) -> str:
    """A LIKE pattern for texts that contain the value, in which ``%`` and ``_`` stay wildcards."""
    return "%" + value.replace("\\", "\\\\") + "%"


def filter_columns(filters: Filters) -> list[Column]:
    """Predicates over paths joined with their documents.  Times compare as text; null ones never do."""
    out = []
    if filters.extension is not None:
        out.append(F.col("extension") == filters.extension)
    if filters.path is not None:
        out.append(F.col("path").ilike(like_part(filters.path)))
    if filters.tier is not None:
        out.append(F.col("index_tier") == filters.tier)
    if filters.drm is not None:
        marked = F.col("drm_status").eqNullSafe("DRM")
        out.append(marked if filters.drm else ~marked)
    if filters.modified_after is not None:
        out.append(F.col("modified_at") > filters.modified_after)
    if filters.modified_before is not None:
        out.append(F.col("modified_at") < filters.modified_before)
    return out


def filtered(rows: DataFrame, filters: Filters) -> DataFrame:
    for condition in filter_columns(filters):
        rows = rows.where(condition)
    return rows


def one_path_each(paths: DataFrame) -> DataFrame:
    """Of each document's paths the smallest, with the rest of its row: a document has one rank."""
    rest = [c for c in paths.columns if c not in ("document_id", "path")]
    return paths.groupBy("document_id").agg(F.min(F.struct("path", *rest)).alias("p")).select("document_id", "p.*")


def top(rows: DataFrame, limit: int) -> DataFrame:
    rows = rows.orderBy("rank", "path")
    return rows if limit < 0 else rows.limit(limit)


@contextmanager
def planned_once(spark: SparkSession):
    """Without plans being made anew between stages, which costs more than it brings where all stages are short."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@dataclass(frozen=True)
class Tables:
    """What a search reads."""

    documents: DataFrame
    paths: DataFrame
    bodies: DataFrame
    content_postings: DataFrame
    content_stats: DataFrame
    filename_postings: DataFrame
    filename_stats: DataFrame
    #: ``content_stats`` with one path of each document, where that is kept; else it is found in ``paths``.
    first_paths: DataFrame | None = None

    @classmethod
    def of(cls, store: IndexStore) -> Tables:
        return cls(*(store.read(n) for n in ("documents", "paths", "document_bodies", "content_postings", "content_stats", "filename_postings", "filename_stats")))

    def cached(self) -> Tables:
        """With postings and statistics in memory, for many searches."""
        kept = {n: getattr(self, n).cache() for n in ("documents", "paths", "content_postings", "content_stats", "filename_postings", "filename_stats")}
        first = one_path_each(self.paths.select("document_id", "path", "filename")).withColumnRenamed("document_id", "key")
        return Tables(bodies=self.bodies, first_paths=self.content_stats.join(first, "key").cache(), **kept)


class Searcher:
    def __init__(self, tables: Tables, morphology: Callable[[], Morphology] | None = None, expand: bool = True, strict: bool = False):
        """``expand``: keywords also match other word forms; ``strict``: filters alone are an error."""
        self.tables, self.morphology, self.expand, self.strict = tables, morphology, expand, strict
        self._content = self._names = None

    @property
    def content_corpus(self) -> match.Corpus:
        self._content = self._content or match.Corpus.of(self.tables.content_stats)
        return self._content

    @property
    def name_corpus(self) -> match.Corpus:
        self._names = self._names or match.Corpus.of(self.tables.filename_stats)
        return self._names

    def search(self, request: SearchRequest) -> DataFrame:
        """``path, filename, snippet, rank, match_kind``, best first."""
        query = parse(request.query)
        if request.mode not in (CONTENT, FILENAME):
            raise SearchError(f"unknown mode {request.mode}")
        if not query.terms and query.filters != Filters() and not self.strict:
            return self._by_filters(query, request)
        return self._content_hits(query, request) if request.mode == CONTENT else self._name_hits(query, request)

    def hits(self, request: SearchRequest) -> list[Row]:
        """The rows of ``search``, at most ``limit``, which must not be negative; their bodies are looked up by id."""
        query = parse(request.query)
        if request.limit < 0 or request.mode != CONTENT or not query.terms:
            return self.search(request).collect()  # at most `limit` rows, or asked for all
        found, *shown = self._ranked(query, request)
        with planned_once(found.sparkSession):
            rows = found.collect()  # at most `limit` rows
            bodies = self.tables.bodies.where(F.col("document_id").isin([r["document_id"] for r in rows])).collect() if rows else []
        text = {r["document_id"]: r["body"] for r in bodies}
        show = snippet_maker(*shown)
        return [Row(path=r["path"], filename=r["filename"], snippet=show(text.get(r["document_id"])), rank=r["rank"], match_kind=EXACT if r["literal"] else MORPHOLOGICAL) for r in rows]

    def _found_paths(self, filters: Filters) -> DataFrame:
        """Paths that pass the filters; documents are read only where a filter is on them."""
        rows = self.tables.paths
        if filters.tier is not None or filters.drm is not None:
            rows = rows.join(self.tables.documents.select("document_id", "index_tier", "drm_status"), "document_id")
        return filtered(rows, filters).select("document_id", "path", "filename")

    def _by_filters(self, query: ParsedQuery, request: SearchRequest) -> DataFrame:
        rows = self._found_paths(query.filters)
        rows = top((one_path_each(rows) if request.mode == CONTENT else rows).withColumn("rank", F.lit(0.0)), request.limit)
        return rows.select("path", "filename", F.lit(None).cast("string").alias("snippet"), "rank", F.lit(EXACT).alias("match_kind"))

    def _name_hits(self, query: ParsedQuery, request: SearchRequest) -> DataFrame:
        t = self.tables
        hits = match.search(t.filename_postings, t.filename_stats, query_tree(query), corpus=self.name_corpus)
        rows = self._found_paths(query.filters).join(hits.withColumnRenamed("key", "path"), "path")
        return top(rows, request.limit).select("path", "filename", F.lit(None).cast("string").alias("snippet"), "rank", F.lit(EXACT).alias("match_kind"))

    def _forms(self, query: ParsedQuery) -> tuple[Node, list[str], bool]:
        """The tree with word forms, the forms, and whether there are any."""
        morphology = self.morphology() if self.morphology and self.expand else None
        forms: list[str] = []

        def expand(term: str) -> Node | None:
            if morphology is None or not plain(term):
                return None
            own = [f for f in dict.fromkeys(morphology.words(term)) if f != term]
            forms.extend(own)
            return expansion(term, own)

        return query_tree(query, expand), forms, bool(forms)

    def _ranked(self, query: ParsedQuery, request: SearchRequest) -> tuple:
        """``document_id, path, filename, rank, literal`` of the best, and what their snippets are made with."""
        t = self.tables
        tree, forms, expanded = self._forms(query)
        literal = query_tree(query) if expanded else None
        if t.first_paths is not None and query.filters == Filters():
            rows = match.search(t.content_postings, t.first_paths, tree, FIELD_WEIGHTS, self.content_corpus, literal, more_of=("path", "filename"))
        else:
            hits = match.search(t.content_postings, t.content_stats, tree, FIELD_WEIGHTS, self.content_corpus, literal)
            rows = hits.join(one_path_each(self._found_paths(query.filters)).withColumnRenamed("document_id", "key"), "key")
        rows = top(rows, request.limit).selectExpr("key AS document_id", "path", "filename", "rank", "literal" if expanded else "true AS literal")
        return rows, tree, needles(query.terms, forms), forms, self.morphology if expanded else None

    def _content_hits(self, query: ParsedQuery, request: SearchRequest) -> DataFrame:
        rows, *shown = self._ranked(query, request)
        bodies = self.tables.bodies
        # whatever has postings has a body; a few hits go to the bodies, which stay where they are
        found = bodies.join(F.broadcast(rows), "document_id") if 0 <= request.limit <= FEW else rows.join(bodies, "document_id", "left")
        return top(with_snippets(found, *shown), -1)


def snippet_maker(tree: Node, wanted: list[str], forms: Iterable[str], morphology: Callable[[], Morphology] | None) -> Callable[[str | None], str]:
    """A function from a body to what is shown of it."""
    shown, forms, analyser = phrases(simplified(tree)), list(forms), morphology() if morphology else None
    return lambda body: result_snippet(body or "", shown, wanted, forms, analyser)


def with_snippets(rows: DataFrame, tree: Node, wanted: list[str], forms: Iterable[str], morphology: Callable[[], Morphology] | None) -> DataFrame:
    """Hits of the rows of a result ``document_id, path, filename, rank, literal, body``."""
    forms = list(forms)
    rows = rows.select("path", "filename", "body", "rank", "literal")

    def work(batches):
        show = snippet_maker(tree, wanted, forms, morphology)
        for batch in batches:
            kinds = [EXACT if x else MORPHOLOGICAL for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([show(b) for b in batch.column(2).to_pylist()], pa.string()), batch.column(3), pa.array(kinds, pa.string())], names=HITS.names)

    return rows.mapInArrow(work, HITS)
