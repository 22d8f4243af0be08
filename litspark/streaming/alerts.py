"""Saved searches over arriving papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions import keywords, text
from litspark.operators.search import info_upper, listed_requests, matching_rows

LITERALS = 100  # saved queries that stand in the expression itself


def saved_search_stream(papers: DataFrame, queries: list[tuple[int, str]], search_author: bool = False) -> DataFrame:
    """(query_id, paper columns…) for every arriving paper and saved query it matches.

    The saved queries are an argument and the stream keeps no state. A few stand in the expression; more are indexed by their
    rarest gram in every task, so an arriving paper is held against those it shares a gram with. Queries that ask for nothing
    match every paper.
    """
    if len(queries) > LITERALS:
        requests = [(i, [[t.upper() for t in g] for g in keywords.query_groups(q)], None, None, None) for i, q in queries]
        names = papers.sparkSession.createDataFrame(listed_requests(requests), "q bigint, query_id bigint")
        hits = matching_rows(papers, requests, papers.columns, search_author)
        return hits.join(F.broadcast(names), "q").select("query_id", *papers.columns)
    hit = text.bind(info_upper(search_author), lambda info: F.array_compact(F.array(*[
        F.when(keywords.keyword_predicate(q, info), F.lit(i).cast("bigint")) for i, q in queries
    ])))
    return papers.select(F.explode(hit).alias("query_id"), *papers.columns)
