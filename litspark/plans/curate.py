"""From CSV drops to the curated papers table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.functions import periods
from litspark.operators import clean
from litspark.sources.papers import read_papers, read_raw_papers
from litspark.sources.staging import snapshot, stage


def with_period(papers: DataFrame) -> DataFrame:
    return papers.withColumn("period", periods.period_of(F.col("year")))


def curate(records: DataFrame) -> DataFrame:
    """Clean, key and place records that carry ``ord``.

    Rows are staged once between dedupe and the key, which needs several narrow passes.
    """
    kept = clean.drop_book_reviews(clean.drop_missing_year(records))
    unique = stage(clean.dedupe(clean.clean_titles(kept)))
    return with_period(clean.null_broken_links(clean.with_paper_id(unique)))


def rejected_records(records: DataFrame) -> DataFrame:
    """Records of texts that curation leaves out for what they lack: a whole-number year or a title, with the reason."""
    typed, bad = clean.type_year(records)
    return bad.unionByName(clean.rejected(typed).withColumn("year", F.col("year").cast("string")).select(bad.columns))


def rejects(spark: SparkSession, data_dir: str) -> DataFrame:
    """The rejected records of a folder of drops."""
    return rejected_records(read_raw_papers(spark, data_dir))


def load_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    """The curated papers under a folder, kept as a snapshot until its files change."""
    return snapshot(spark, "papers", data_dir, lambda: curate(read_papers(spark, data_dir)[0]), ["period"])
