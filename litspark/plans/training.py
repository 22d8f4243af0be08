"""The training pair set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from litspark import schema
from litspark.operators import encode, pairs, vocab
from litspark.sources.staging import stage


def title_terms(papers: DataFrame, n_terms: int = 3000, used: int = 500, seed: int = 42) -> list[str]:
    texts = encode.with_text(papers).select("paper_id", "text")
    return vocab.top_terms(vocab.tfidf_vocabulary(texts, n_terms, seed=seed), used)


def query_pairs(papers: DataFrame, terms: list[str], n: int = schema.PAIR_TOTAL, seed: int = 42) -> DataFrame:
    # the title index is staged: counting, drawing and joining would each match all titles again
    return pairs.query_document(papers, stage(pairs.paper_terms(papers, terms)), n, seed)


def training_pairs(papers: DataFrame, terms: list[str], n: int = schema.PAIR_TOTAL, seed: int = 42) -> DataFrame:
    """All four kinds, at most n pairs. The kinds are staged, being counted before they are cut."""
    parts = [
        pairs.title_abstract(papers, n, seed), pairs.journal_year(papers, n, seed=seed),
        query_pairs(papers, terms, n, seed), pairs.negative(papers, n, seed),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return pairs.assemble([stage(union)], n, seed)
