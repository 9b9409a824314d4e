"""Whole searches composed from the search operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.config import DEFAULT_LIMIT, WEB_LIMIT
from doccat.operators import search as Q
from doccat.operators.postings import TextIndex
from doccat.operators.sync import live


@dataclass(frozen=True)
class Result:
    """A page of documents, the number of all matches, and facet counts if asked for."""

    docs: DataFrame
    num_found: DataFrame
    facets: DataFrame | None
    start: int


def concern_matches(catalog: DataFrame, index: TextIndex, request: str = "*", concern: str = "*") -> DataFrame:
    """Documents whose text has one of the request's words and whose concern fits the pattern.

    The concern is tested on the catalogue rows themselves, so only those that
    pass meet the postings.
    """
    rows = live(catalog)
    rows = rows.where(Q.field_pattern(rows, "concern", Q.concern_pattern(concern)))
    ids = Q.match_all(index) if (request or "*") == "*" else Q.match_terms(index, request)
    return Q.documents(rows, ids)


def search_concern(catalog: DataFrame, index: TextIndex, request: str = "*", concern: str = "*",
                   limit: int = WEB_LIMIT, offset: int = 0) -> DataFrame:
    """The web search: one page of ``id, title, concern`` by concern."""
    return Q.listing(Q.page(concern_matches(catalog, index, request, concern), "concern asc", limit, offset))


def _scored(matches: DataFrame, scores: DataFrame) -> DataFrame:
    return matches.join(scores, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def search(catalog: DataFrame, ids: DataFrame, scores: DataFrame | None = None, filter: Column | None = None,
           sort: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0,
           facets: list[str] | None = None) -> Result:
    """The structured query: matches of ``ids`` under ``filter``, sorted or ranked, paged, counted.

    ``filter`` restricts without touching the scores. Without ``sort`` the
    documents come by relevance if ``scores`` (id, score) are given, else by id.
    A match without a score has score 0; ``sort`` may name ``score`` too.
    """
    rows = live(catalog) if filter is None else live(catalog).where(filter)
    matches = Q.documents(rows, ids)
    if sort is not None:
        by_score = scores is not None and Q.sorts_by(sort, "score")
        docs = Q.page(_scored(matches, scores) if by_score else matches, sort, limit, offset)
    elif scores is not None:
        docs = Q.top_ranked(_scored(matches, scores), limit, offset)
    else:
        docs = Q.page(matches, "id asc", limit, offset)
    counts = None if facets is None else Q.facets(matches, facets)
    return Result(Q.returnable(docs), Q.hits(matches), counts, offset)
