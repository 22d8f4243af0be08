"""One runnable query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import fixtures as fx
from litspark import schema
from litspark.functions import keywords, periods, text, vectors
from litspark.operators import audit, clean, encode, maintain, pairs, ranks, search, semantic, vocab
from litspark.plans import curate, training
from litspark.sources import listing
from litspark.sources import manifest as mf
from litspark.sources.staging import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WHERE = {"journals": fx.GROUPS["general"], "year_from": 1990, "year_to": 2022}
SIX = 6
BATCH_QUERIES = [
    (1, "er wh"), (2, "wh|eaux er"), (3, '"the of"'), (4, ""), (5, "the  wh"), (6, "eaux||wh"), (7, '"'), (8, 'un"der the'),
]
TEXT_QUERY = "the and of that with eaux"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _vector(spark, sf, paper_id=0) -> list[float]:
    """The query vector of the similarity searches, an argument of them."""
    return list(fx.embeddings(spark, sf).filter(F.col("paper_id") == paper_id).first().embedding)


def _texts(spark, sf) -> DataFrame:
    return encode.with_text(fx.papers(spark, sf)).select("paper_id", "text")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, SIX) for c in columns})


# ---- scans and curation


@query
def scan_papers(spark, sf):
    return fx.papers_raw(spark, sf).withColumn("year", F.col("year").cast("string"))


@query
def na_normalise(spark, sf):
    return clean.normalise_missing(fx.cell_texts(spark, sf).select("ord", "journal"), ["journal"])


@query
def type_year(spark, sf):
    good, bad = clean.type_year(fx.cell_texts(spark, sf).select("ord", F.col("year"), F.col("year").alias("year_text")))
    rejects = bad.select("ord", F.lit(None).cast("smallint").alias("year"), "year_text", F.lit(True).alias("rejected"))
    both = good.withColumn("rejected", F.lit(False)).unionByName(rejects)
    return both.withColumn("year", F.col("year").cast("string"))


@query
def rejects(spark, sf):
    return curate.rejected_records(fx.raw_texts(spark, sf)).select("ord", "year", "reason")


@query
def scan_embeddings(spark, sf):
    return _rounded(fx.embeddings(spark, sf).select(
        "paper_id", "label", F.size("embedding").alias("width"), vectors.norm(F.col("embedding")).alias("norm")
    ), "norm")


@query
def distinct_ratio(spark, sf):
    ratios = clean.distinct_ratio(fx.papers_raw(spark, sf), ["title", "authors", "abstract", "url", "journal"], exact=True)
    return _rounded(ratios, "ratio")


@query
def book_review_filter(spark, sf):
    return clean.drop_book_reviews(clean.drop_missing_year(fx.papers_raw(spark, sf))).select("ord", "title")


@query
def title_clean(spark, sf):
    return clean.clean_titles(fx.papers_raw(spark, sf)).select("ord", "title")


@query
def dedupe_papers(spark, sf):
    kept = clean.drop_book_reviews(clean.drop_missing_year(fx.papers_raw(spark, sf)))
    return clean.dedupe(clean.clean_titles(kept)).select("ord", "title", "url")


@query
def broken_links(spark, sf):
    return clean.clean_papers(fx.papers_raw(spark, sf)).select("ord", "url")


@query
def clean_papers(spark, sf):
    return clean.clean_papers(fx.papers_raw(spark, sf))


@query
def clean_stage_counts(spark, sf):
    return clean.stage_counts(fx.papers_raw(spark, sf))


@query
def embedding_text(spark, sf):
    return _texts(spark, sf)


@query
def period_counts(spark, sf):
    return audit.period_counts(fx.papers(spark, sf))


@query
def period_range_join(spark, sf):
    return periods.by_range(fx.papers(spark, sf).select("paper_id", "year"), periods.period_dimension(spark))


# ---- search


@query
def prefilter(spark, sf):
    return search.prefilter(fx.papers(spark, sf), **WHERE).select("paper_id", "journal", "year")


@query
def journal_groups(spark, sf):
    papers = fx.papers(spark, sf)
    every = papers.select(F.lit("all").alias("grp"), "journal").distinct()
    groups = search.group_dimension(spark, fx.GROUPS).unionByName(every)
    return search.in_journal_groups(papers, groups, ["top5", "survey"]).select("paper_id", "journal")


@query
def top_journals(spark, sf):
    return search.top_journals(fx.papers(spark, sf))


@query
def journal_year_groups(spark, sf):
    return search.journal_year_groups(fx.papers(spark, sf))


@query
def query_terms(spark, sf):
    asked = fx.requests(fx.papers(spark, sf))
    terms = keywords.query_terms_col(F.col("query"))
    parsed = asked.withColumn("terms", terms).withColumn("groups", keywords.query_groups_col(F.col("query")))
    return parsed.select(
        "query_id", F.array_join("terms", "\n").alias("terms"), F.size("terms").alias("n_terms"),
        F.array_join(F.filter("terms", lambda t: ~F.contains(t, F.lit("|"))), "\n").alias("plain_terms"),
        F.array_join(F.transform("groups", lambda g: F.size(g).cast("string")), ",").alias("group_sizes"),
    )


def _keyword(name: str, text_query: str, **options) -> None:
    def run(spark, sf):
        return search.keyword_filter(fx.papers(spark, sf), text_query, **options).select("paper_id")

    QUERIES[name] = run


_keyword("keyword_and", "er wh")
_keyword("keyword_or", "wh|eaux er")
_keyword("keyword_phrase", '"the of"')
_keyword("keyword_blank", "")
_keyword("keyword_author", '"author 7"', search_author=True)


@query
def keyword_count(spark, sf):
    found = search.keyword_filter(search.prefilter(fx.papers(spark, sf), **WHERE), "er wh|the")
    return found.agg(F.count(F.lit(1)).alias("papers_found"))


@query
def keyword_search(spark, sf):
    found = search.keyword_search(fx.papers(spark, sf), "er wh|the", **WHERE)
    return found.select("paper_id", "title", "authors", "url", "journal", "year")


@query
def keyword_early(spark, sf):
    found = search.keyword_search(fx.papers(spark, sf), "er wh|the", sort="early", limit=50, **WHERE)
    return found.select("paper_id", "title", "authors", "url", "journal", "year")


@query
def keyword_batch(spark, sf):
    asked = spark.createDataFrame(BATCH_QUERIES, "query_id int, query string")
    return search.keyword_search_batch(fx.papers(spark, sf), asked).select("query_id", "rank", "paper_id")


#: query_id, query, journals, year_from, year_to of requests with filters of their own
FILTERED_QUERIES = [
    (1, "er wh", fx.GROUPS["top5"], 1990, 2010), (2, "wh|eaux er", None, None, 2005), (3, '"the of"', fx.GROUPS["survey"], None, None),
    (4, "", fx.GROUPS["general"], 2000, None), (5, "", None, None, 1995), (6, "er", [], None, None), (7, "zq jx", None, None, None),
]


@query
def keyword_batch_filtered(spark, sf):
    asked = spark.createDataFrame(FILTERED_QUERIES, "query_id int, query string, journals array<string>, year_from int, year_to int")
    return search.keyword_search_batch(fx.papers(spark, sf), asked, 50).select("query_id", "rank", "paper_id", "year")


@query
def prefilter_open(spark, sf):
    return search.prefilter(fx.papers(spark, sf), year_from=2001).select("paper_id", "journal", "year")


@query
def citation_lines(spark, sf):
    return search.citations(search.keyword_search(fx.papers(spark, sf), "er wh|the", **WHERE))


@query
def random_roll(spark, sf):
    found = search.keyword_filter(search.prefilter(fx.papers(spark, sf), **WHERE), "er wh|the")
    return search.random_paper(found, 42).select("paper_id", "title")


@query
def sample_k(spark, sf):
    return ranks.sample_k(fx.papers(spark, sf), 100, 42, ["paper_id"]).select("paper_id", "journal", "year")


# ---- vectors


@query
def dot_scores(spark, sf):
    return _rounded(semantic.dot_scores(fx.embeddings(spark, sf), _vector(spark, sf)), "similarity")


def _elements(df: DataFrame, column) -> DataFrame:
    return df.select("paper_id", F.posexplode(column).alias("pos", "value"))


@query
def half_round(spark, sf):
    return _elements(fx.embeddings(spark, sf), vectors.half_round(F.col("embedding")))


@query
def l2_normalise(spark, sf):
    half = fx.embeddings(spark, sf).withColumn("half", vectors.half_round(F.col("embedding")))
    return _rounded(_elements(half, vectors.l2_normalise(F.col("half"))), "value")


def _semantic(name: str, sort: str) -> None:
    def run(spark, sf):
        found = semantic.semantic_search(
            fx.papers(spark, sf), fx.embeddings(spark, sf), _vector(spark, sf), min_similarity=0.1, sort=sort, **WHERE
        )
        return _rounded(found.select("paper_id", "title", "journal", "year", "similarity"), "similarity")

    QUERIES[name] = run


_semantic("semantic_search", "best")
_semantic("semantic_recent", "recent_similar")
_semantic("semantic_early", "early_similar")


@query
def semantic_citations(spark, sf):
    found = semantic.semantic_search(
        fx.papers(spark, sf), fx.embeddings(spark, sf), _vector(spark, sf), min_similarity=0.1, **WHERE
    )
    return search.citations(found, "recent_similar")


@query
def semantic_batch(spark, sf):
    stored = fx.embeddings(spark, sf)
    first = stored.groupBy("label").agg(F.min_by("embedding", "paper_id").alias("embedding"))
    asked = [(r.label, list(r.embedding)) for r in first.collect()]  # one query vector per label
    found = semantic.semantic_search_batch(fx.papers(spark, sf), stored, asked, 0.1, 20)
    return _rounded(found, "similarity")


SEMANTIC_FILTERS = [(fx.GROUPS["top5"], 1990, 2010), (None, None, 2005), (fx.GROUPS["survey"], 2000, None), ([], None, None)]


@query
def semantic_batch_filtered(spark, sf):
    stored = fx.embeddings(spark, sf)
    first = stored.groupBy("label").agg(F.min_by("embedding", "paper_id").alias("embedding"))
    asked = [(r.label, list(r.embedding), *SEMANTIC_FILTERS[r.label % 4]) for r in first.collect()]  # one request per label
    return _rounded(semantic.semantic_search_batch(fx.papers(spark, sf), stored, asked, 0.1, 20), "similarity")


@query
def knn_self_match(spark, sf):
    stored = fx.vectors(spark, sf).select("paper_id", "embedding")
    probes = [(r.paper_id, list(r.embedding)) for r in ranks.sample_k(stored, 8, 42, ["paper_id"]).collect()]
    return _rounded(semantic.self_match(fx.embeddings(spark, sf), probes), "similarity")


@query
def encode_hashing(spark, sf):
    return _rounded(encode.hashed_weights(_texts(spark, sf), fx.DIM), "weight")


@query
def semantic_text_query(spark, sf):
    papers = fx.papers(spark, sf)
    stored = encode.hashing_encode(_texts(spark, sf), fx.DIM)
    asked = spark.createDataFrame([(0, TEXT_QUERY)], "query_id bigint, query string")
    vector = encode.encode_queries(asked, fx.DIM)[0][1]
    found = semantic.semantic_search(papers, stored, vector, min_similarity=0.2, sort="best", **WHERE)
    return _rounded(found.select("paper_id", "year", "similarity"), "similarity")


@query
def papers_with_vectors(spark, sf):
    joined = maintain.papers_with_vectors(fx.papers(spark, sf), fx.embeddings(spark, sf))
    return joined.select("paper_id", "title", "period", "label", F.size("embedding").alias("width"))


# ---- maintenance


@query
def changed_files(spark, sf):
    papers = fx.papers(spark, sf).withColumn("name", F.concat_ws("/", "journal", F.col("year").cast("string")))
    stored = fx.embeddings(spark, sf).select("paper_id")
    columns = ["title", "authors", "url"]
    old = listing.content_fingerprint(papers.join(stored, "paper_id", "left_semi"), "name", columns)
    return listing.changed_entries(old, listing.content_fingerprint(papers, "name", columns))


@query
def manifest_build(spark, sf):
    return _rounded(fx.build_manifest(spark, sf), "file_size_mb").withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@query
def manifest_rollup(spark, sf):
    return _rounded(maintain.manifest_totals(fx.manifest(spark, sf)), "file_size_mb")


@query
def manifest_rows(spark, sf):
    document = mf.manifest_document(fx.manifest(spark, sf), schema.DEFAULT_MODEL, fx.DIM)
    written = document.select(F.to_json(F.struct("*")).alias("json"))
    rows = _rounded(mf.manifest_rows(mf.parse_manifest(written)), "file_size_mb")
    as_text = {c: F.col(c).cast("string") for c in ("first_index", "last_index")}
    return rows.withColumns(as_text).withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@query
def manifest_vs_actual(spark, sf):
    return audit.manifest_vs_actual(fx.manifest(spark, sf), audit.period_counts(fx.papers(spark, sf)))


def _merged(spark, sf) -> DataFrame:
    stored = fx.vectors(spark, sf)
    new = maintain.delta_by_key(fx.papers(spark, sf), stored)
    made = encode.hashing_encode(encode.with_text(new).select("paper_id", "text"), fx.DIM)
    fresh = new.select("paper_id", "ord", "year", "period").join(made, "paper_id")
    merged = stage(maintain.merge_embeddings(stored, fresh))
    order, block = maintain.merged_order(merged)
    return maintain.half_split(merged, order, block)


@query
def merge_embeddings(spark, sf):
    total = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return _rounded(_merged(spark, sf).select("paper_id", "period", "batch", "part", total.alias("total")), "total")


@query
def manifest_upsert(spark, sf):
    late = F.col("period").isin("2020s", "2025s")
    new = maintain.manifest_build(
        _merged(spark, sf).filter(late), fx.minutes_after("2026-04-01 00:00:00", F.col("num_papers"))
    )
    merged = maintain.manifest_upsert(fx.manifest(spark, sf), new)
    return _rounded(merged, "file_size_mb").withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@query
def stale_periods(spark, sf):
    return maintain.stale_periods(fx.source_times(spark, sf), fx.manifest(spark, sf))


@query
def delta_by_key(spark, sf):
    return maintain.delta_by_key(fx.papers(spark, sf), fx.embeddings(spark, sf)).select("paper_id", "period")


@query
def delta_by_count(spark, sf):
    previous = fx.vectors(spark, sf).groupBy("period").agg(F.count(F.lit(1)).alias("previous"))
    return maintain.delta_by_count(fx.papers(spark, sf), previous).select("paper_id", "period")


@query
def half_split(spark, sf):
    return maintain.half_split(fx.papers(spark, sf).select("paper_id", "ord", "period")).select("paper_id", "period", "part")


@query
def split_boundary(spark, sf):
    return maintain.split_boundary(fx.papers(spark, sf)).select("idx", "paper_id", "title", "year")


# ---- vocabulary and pairs


@query
def vocab_df(spark, sf):
    return vocab.document_frequency(_texts(spark, sf))


@query
def vocab_tfidf(spark, sf):
    return vocab.ranked(vocab.tfidf_vocabulary(_texts(spark, sf)))


@query
def paper_terms(spark, sf):
    papers = fx.papers(spark, sf)
    found = pairs.paper_terms(papers, training.title_terms(papers))
    return found.select("paper_id", F.array_join("terms", "|").alias("terms"))


def _pairs_out(df: DataFrame) -> DataFrame:
    return df.select("kind", "pair_key", "text_a", "text_b", "label")


@query
def pairs_title_abstract(spark, sf):
    return _pairs_out(pairs.title_abstract(fx.papers(spark, sf)))


@query
def pairs_journal_year(spark, sf):
    return _pairs_out(pairs.journal_year(fx.papers(spark, sf)))


@query
def pairs_query(spark, sf):
    papers = fx.papers(spark, sf)
    return _pairs_out(training.query_pairs(papers, training.title_terms(papers)))


@query
def pairs_negative(spark, sf):
    return _pairs_out(pairs.negative(fx.papers(spark, sf)))


@query
def pairs_consecutive(spark, sf):
    return pairs.small_fixed(fx.papers(spark, sf))


@query
def pairs_all(spark, sf):
    papers = fx.papers(spark, sf)
    return _pairs_out(training.training_pairs(papers, training.title_terms(papers)))


@query
def pair_summary(spark, sf):
    papers = fx.papers(spark, sf)
    vocabulary = stage(vocab.tfidf_vocabulary(_texts(spark, sf)))
    made = training.training_pairs(papers, vocab.top_terms(vocabulary, 500))
    size = vocabulary.agg(F.count(F.lit(1))).scalar()
    return pairs.pair_summary(made, vocab.top_terms(vocabulary, 50), size)


# ---- audits


@query
def missing_periods(spark, sf):
    late = fx.manifest(spark, sf).join(fx.source_times(spark, sf), "period").filter("created >= mtime")
    return audit.missing_entries(late)


@query
def count_match(spark, sf):
    return audit.count_match(fx.papers(spark, sf), fx.embeddings(spark, sf))


@query
def norm_stats(spark, sf):
    return _rounded(audit.norm_stats(fx.embeddings(spark, sf), fx.DIM), "min_norm", "max_norm", "mean_norm")


@query
def split_check(spark, sf):
    return audit.split_check(fx.papers(spark, sf))


@query
def text_consistency(spark, sf):
    return audit.text_consistency(fx.papers(spark, sf))


@query
def reencode_check(spark, sf):
    texts = _texts(spark, sf)
    stored = encode.hashing_encode(texts, fx.DIM)
    half = stored.withColumn("embedding", vectors.half_round(F.col("embedding")))
    checked = audit.reencode_check(texts, half, lambda df: encode.hashing_encode(df, fx.DIM))
    return _rounded(checked, "mean_similarity", "min_similarity")


@query
def diagnose(spark, sf):
    raw = audit.period_counts(fx.papers_raw(spark, sf)).withColumn("period", F.coalesce("period", F.lit("none")))
    stored = fx.vectors(spark, sf).groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    return audit.diagnose(raw, audit.period_counts(fx.papers(spark, sf)), stored)


@query
def audit_report(spark, sf):
    return audit.audit_report(
        fx.papers(spark, sf), fx.embeddings(spark, sf), fx.manifest(spark, sf), fx.source_times(spark, sf), fx.DIM
    )
