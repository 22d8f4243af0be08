"""Searches as a user asks them."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import DataFrame

from litspark.operators import encode, search, semantic
from litspark.operators.semantic import semantic_search


def keyword(
    papers: DataFrame, query: str = "", journals: list[str] | None = None, full_journals: bool = False,
    year_from: int = 1980, year_to: int | None = None, sort: str = "recent", max_show: int = 100,
    search_author: bool = False, random_roll: bool = False, seed: int | None = None,
) -> DataFrame:
    """Papers of a keyword request; journal groups may be named, all core journals by default.

    An empty list of journals finds nothing. A random roll is drawn afresh unless a seed is given.
    """
    codes = search.expand_journals(["all"] if journals is None else journals, full=full_journals)
    until = year_to or datetime.date.today().year
    if random_roll:
        found = search.keyword_filter(search.prefilter(papers, codes, year_from, until), query, search_author)
        return search.random_paper(found, random.getrandbits(31) if seed is None else seed)
    return search.keyword_search(papers, query, codes, year_from, until, sort, max_show, search_author)


def similar(
    papers: DataFrame, embeddings: DataFrame, query: str, dim: int, journals: list[str] | None = None,
    full_journals: bool = False, year_from: int = 1980, year_to: int | None = None, min_similarity: float = 0.5,
    sort: str = "recent_similar", max_show: int = 100, encoder=None,
) -> DataFrame:
    """Papers close to a query text, with their abstracts; a blank text finds nothing."""
    spark = papers.sparkSession
    codes = search.expand_journals(["all"] if journals is None else journals, full=full_journals)
    until = year_to or datetime.date.today().year
    asked = spark.createDataFrame([(0, query)], "query_id bigint, query string")
    vector = encode.encode_queries(asked, dim, encoder)[0][1]
    result = semantic_search(papers, embeddings, vector, codes, year_from, until, min_similarity, sort, max_show)
    # only the papers that are shown fetch their abstract
    result = result.join(papers.select("paper_id", "abstract"), "paper_id")
    return result.orderBy(*search.result_order(sort)) if query.strip() else result.limit(0)


def similarity_count(papers: DataFrame, embeddings: DataFrame, vector, min_similarity: float, **where) -> DataFrame:
    found = semantic.similar_papers(papers, embeddings, vector, min_similarity=min_similarity, **where)
    return found.groupBy().count()
