"""Pre-filter, keyword search and result shaping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark import schema
from litspark.functions import keywords, periods, text
from litspark.functions.grams import QueryIndex
from litspark.operators.ranks import BROADCAST_ROWS, sample_k, small, top_k

QUERIES_PER_PASS = 200_000  # queries that every task holds in its index; more are answered in further passes


def journal_dimension(spark: SparkSession, full: bool = True) -> DataFrame:
    """(journal, journal_name, core): the selectable codes and the codes that only have a name."""
    names = schema.journal_names()
    codes = schema.CORE_JOURNALS + (schema.EXTRA_JOURNALS if full else [])
    codes = codes + [c for c in names if c not in schema.CORE_JOURNALS + schema.EXTRA_JOURNALS]
    rows = [(c, names.get(c), c in schema.CORE_JOURNALS) for c in codes]
    return spark.createDataFrame(rows, "journal string, journal_name string, core boolean")


def group_dimension(spark: SparkSession, groups: dict[str, list[str]] | None = None, full: bool = False) -> DataFrame:
    """(grp, journal) rows of the named groups, ``all`` included."""
    if groups is None:
        groups = schema.JOURNAL_GROUPS | {"all": schema.CORE_JOURNALS + (schema.EXTRA_JOURNALS if full else [])}
    rows = [(g, j) for g, js in groups.items() for j in js]
    return spark.createDataFrame(rows, "grp string, journal string")


def expand_journals(selected: list[str], groups: dict[str, list[str]] | None = None, full: bool = False) -> list[str]:
    """Journal codes of a selection that may name groups."""
    groups = groups or schema.JOURNAL_GROUPS | {
        "all": schema.CORE_JOURNALS + (schema.EXTRA_JOURNALS if full else [])
    }
    codes = {j for s in selected for j in groups.get(s, [s])}
    return sorted(codes)


def in_journal_groups(papers: DataFrame, groups: DataFrame, selected: list[str]) -> DataFrame:
    """Papers of the selected groups.

    The selected codes are counted up to a limit first: a list of codes is broadcast, so a journal
    with a third of all papers is not brought together; anything larger is left to the planner.
    """
    wanted = groups.filter(F.col("grp").isin(selected)).select("journal").distinct()
    return papers.join(small(wanted, wanted.limit(BROADCAST_ROWS + 1).count()), "journal", "left_semi")


def prefilter(
    papers: DataFrame, journals: list[str] | None = None, year_from: int | None = None, year_to: int | None = None
) -> DataFrame:
    """Journal and year filter, either bound may be None; on a table partitioned by period it also prunes partitions."""
    if journals is not None:
        papers = papers.filter(F.col("journal").isin(journals))
    if year_from is not None:
        papers = papers.filter(F.col("year") >= year_from)
    if year_to is not None:
        papers = papers.filter(F.col("year") <= year_to)
    if "period" in papers.columns and (year_from is not None or year_to is not None):
        papers = papers.filter(F.col("period").isin(periods.periods_between(year_from, year_to)))
    return papers


def info_upper(search_author: bool = False) -> Column:
    authors = F.col("authors") if search_author else None
    return F.upper(text.search_text(F.col("title"), F.col("abstract"), authors))


def keyword_filter(papers: DataFrame, query: str, search_author: bool = False) -> DataFrame:
    """Papers that match; the upper-cased text is made once, not once per term."""
    info = info_upper(search_author)
    return papers.filter(F.exists(F.array(info), lambda i: keywords.keyword_predicate(query, i)))


def result_order(sort: str) -> list[Column]:
    """Order of a result list; ties always end in row order."""
    sim = [F.col("similarity").desc()]
    return {
        "recent": [F.col("year").desc(), F.col("ord")],
        "early": [F.col("year").asc(), F.col("ord")],
        "recent_similar": [F.col("year").desc(), *sim, F.col("ord")],
        "early_similar": [F.col("year").asc(), *sim, F.col("ord")],
        "best": [*sim, F.col("ord")],
    }[sort]


def keyword_search(
    papers: DataFrame, query: str, journals: list[str] | None = None, year_from: int | None = None,
    year_to: int | None = None, sort: str = "recent", limit: int = 100, search_author: bool = False,
) -> DataFrame:
    """First papers that match a boolean keyword query, by year."""
    hits = keyword_filter(prefilter(papers, journals, year_from, year_to), query, search_author)
    return top_k(hits, limit, result_order(sort))


def request_list(queries: DataFrame) -> list[tuple]:
    """(query_id, groups in upper case, journals, year_from, year_to) of a request table; absent filters are None.

    Requests are an argument of the search and come back to the driver as such; one without a query is none.
    """
    groups = F.transform(keywords.query_groups_col(F.col("query")), lambda g: F.transform(g, lambda t: F.upper(t)))
    kinds = {"journals": "array<string>", "year_from": "int", "year_to": "int"}
    filters = [(F.col(c) if c in queries.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    return [tuple(r) for r in queries.filter(F.col("query").isNotNull()).select("query_id", groups.alias("groups"), *filters).collect()]


def matching_rows(papers: DataFrame, requests: list[tuple], keep: list[str], search_author: bool = False) -> DataFrame:
    """(q, kept columns): q, the number of a request, for every paper that it matches.

    Requests stand in an index by their rarest required gram, so a paper is held against those that share a gram with it.
    Requests that ask for no text are grouped by their filters and only the first of each group is listed. A map over the
    papers, for tables and streams.
    """
    read = papers.select(*keep, F.col("journal").alias("_j"), F.col("year").alias("_y"), info_upper(search_author).alias("_i"))
    schema_out = T.StructType([T.StructField("q", T.LongType()), *(papers.schema[c] for c in keep)])
    asked = papers.sparkSession.sparkContext.broadcast(requests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = asked.value
        index = QueryIndex([r[1] for r in rows])
        filters = [(None if r[2] is None else frozenset(r[2]), r[3], r[4]) for r in rows]
        blank = sorted({filters[k]: k for k in reversed(index.blank)}.values())

        def eligible(k: int, journal: str | None, year: int | None) -> bool:
            journals, low, high = filters[k]
            return (
                (journals is None or journal in journals)
                and (low is None or year is not None and year >= low)
                and (high is None or year is not None and year <= high)
            )

        for batch in batches:
            journals, years, infos = (batch.column(c).to_pylist() for c in ("_j", "_y", "_i"))
            q, at = [], []
            for i, (journal, year, info) in enumerate(zip(journals, years, infos, strict=True)):
                met = index.find(info) if info is not None else ()
                found = [k for k in (*met, *blank) if eligible(k, journal, year)]
                q += found
                at += [i] * len(found)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), *(batch.column(c).take(taken) for c in keep)], names=schema_out.names)

    return read.mapInArrow(run, schema_out)


def listed_requests(requests: list[tuple]) -> list[tuple]:
    """(q, query_id): the request that stands for each in ``matching_rows``."""
    first: dict[tuple, int] = {}
    out = []
    for k, (query_id, groups, journals, low, high) in enumerate(requests):
        q = k
        if all("" in g for g in groups):
            q = first.setdefault((None if journals is None else frozenset(journals), low, high), k)
        out.append((q, query_id))
    return out


def keyword_search_batch(
    papers: DataFrame, queries: DataFrame, limit: int = 100, sort: str = "recent", search_author: bool = False
) -> DataFrame:
    """(query_id, paper columns…, rank): first papers of every request in (query_id, query), with its own filters.

    ``queries`` may hold journals (array), year_from and year_to; null or absent ones filter nothing, no journals find
    nothing. One pass over the papers answers QUERIES_PER_PASS requests; only (request, key, order) rows leave it, and the
    papers that are shown are fetched by their unique paper_id.
    """
    requests = request_list(queries)
    id_type = queries.schema["query_id"].dataType
    spark, order = papers.sparkSession, result_order(sort)
    found = None
    for at in range(0, max(1, len(requests)), QUERIES_PER_PASS):
        part = requests[at : at + QUERIES_PER_PASS]
        hits = top_k(matching_rows(papers, part, ["paper_id", "ord", "year"], search_author), limit, order, by=["q"])
        names = spark.createDataFrame(listed_requests(part), T.StructType([T.StructField("q", T.LongType()), T.StructField("query_id", id_type)]))
        hits = numbered(hits, order, ["q"]).join(F.broadcast(names), "q").select("query_id", "paper_id", "rank")
        found = hits if found is None else found.unionByName(hits)
    return found.join(papers, "paper_id").select("query_id", *papers.columns, "rank")


def numbered(result: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Add rank 1, 2, … to a limited result."""
    return result.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def citations(result: DataFrame, sort: str = "recent") -> DataFrame:
    """(rank, line) of a limited result."""
    similarity = F.col("similarity") if "similarity" in result.columns else None
    ranked = numbered(result, result_order(sort))
    return ranked.select("rank", text.citation_line(F.col("rank"), similarity).alias("line"))


def random_paper(papers: DataFrame, seed: int, key: str = "paper_id") -> DataFrame:
    return sample_k(papers, 1, seed, [key])


def journal_frequency(papers: DataFrame) -> DataFrame:
    return papers.filter(F.col("journal").isNotNull()).groupBy("journal").agg(F.count(F.lit(1)).alias("n"))


def top_journals(papers: DataFrame, k: int = 5) -> DataFrame:
    return journal_frequency(papers).orderBy(F.col("n").desc(), "journal").limit(k)


def journal_year_groups(papers: DataFrame, at_least: int = 2) -> DataFrame:
    """(journal, year, n) of the groups that can form pairs."""
    grouped = papers.filter(F.col("journal").isNotNull()).groupBy("journal", "year")
    return grouped.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
