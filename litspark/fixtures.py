"""Papers, vectors, manifest and source times derived from the driver's tables.

Every document becomes one raw paper record with its whole text as abstract. Its other fields are
computed from the document so that each cleaning step has work: some lack a url, an author or a
year, some titles carry page marks or bracketed lines, and equal documents give equal papers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import schema
from litspark.operators import clean, maintain
from litspark.plans.curate import with_period
from litspark.sources.staging import snapshot

DIM = 64
GROUPS = {
    "top5": [f"src{i}" for i in range(5)],
    "general": [f"src{i}" for i in range(11)],
    "survey": [f"src{i}" for i in range(5, 8)],
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def papers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    tail = (
        F.when(n % 97 == 13, " pp. 12-34").when(n % 89 == 7, "\n[Working Title]")
        .when(n % 5 == 1, F.concat(F.lit("\n"), F.col("source"))).otherwise("")
    )
    url = (
        F.when(n % 13 == 5, None).when(n % 17 == 6, "http://hdl.handle.net/")
        .otherwise(F.concat(F.lit("https://papers.example.org/"), (n % 997).cast("string")))
    )
    author = F.concat(F.lit("Author "), (F.col("doc_id") % 41).cast("string"))
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("ord"), F.col("doc_id").alias("paper_id"),
        F.concat(F.split_part("text", F.lit("."), F.lit(1)), tail).alias("title"),
        F.nullif(author, F.lit("Author 3")).alias("authors"),
        F.when(n % 11 != 4, F.col("text")).alias("abstract"),
        url.alias("url"), F.col("source").alias("journal"),
        F.nullif(n % 43 + 1985, F.lit(2027)).cast("smallint").alias("year"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated papers as a snapshot, partitioned by period."""
    return snapshot(
        spark, "papers", f"{sf_dir}/documents.parquet",
        lambda: with_period(clean.clean_papers(papers_raw(spark, sf_dir))), ["period"],
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "paper_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of papers: (paper_id, ord, year, period, embedding, batch)."""

    def build() -> DataFrame:
        narrow = papers(spark, sf_dir).select("paper_id", "ord", "year", "period")
        stored = embeddings(spark, sf_dir).select("paper_id", "embedding")
        return narrow.join(stored, "paper_id").withColumn("batch", F.lit(0))

    return snapshot(spark, "vectors", [f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet"], build, ["period"])


def minutes_after(start: str, minutes):
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + minutes * 60)


def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the stored vectors, made two minutes per paper after a fixed start."""
    return maintain.manifest_build(
        maintain.half_split(vectors(spark, sf_dir)), minutes_after("2026-03-01 00:00:00", F.col("num_papers") * 2)
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same entries as they were stored."""
    return snapshot(spark, "manifest", [f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet"], lambda: build_manifest(spark, sf_dir))


def source_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(period, mtime): sources changed one minute per paper after the same start."""
    counts = papers(spark, sf_dir).groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("period", minutes_after("2026-03-01 00:00:00", F.col("n")).alias("mtime"))


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cell texts as a CSV would hold them: (ord, journal, year)."""
    n = F.col("n_chars")
    tokens = F.array(*[F.lit(t) for t in schema.NA_TOKENS])
    missing = F.element_at(tokens, (F.floor(n / 4) % len(schema.NA_TOKENS) + 1).cast("int"))
    year = (n % 43 + 1985).cast("string")
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("ord"),
        F.when(n % 4 == 0, missing).otherwise(F.col("source")).alias("journal"),
        F.when(n % 5 == 0, F.concat(year, F.lit(".0"))).when(n % 5 == 1, F.concat(year, F.lit(".5")))
        .when(n % 5 == 2, F.col("lang")).when(n % 5 == 3, year).alias("year"),
    )


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records as a CSV would hold them, years as texts; short titles are missing."""
    years = cell_texts(spark, sf_dir).select("ord", "year")
    title = F.when(F.length("title") >= 12, F.col("title"))
    return papers_raw(spark, sf_dir).drop("year").withColumn("title", title).join(years, "ord")


def requests(papers_df: DataFrame) -> DataFrame:
    """(query_id, query): one query text per paper, made of its whole title in four writings."""
    kind = F.length("title") % 4
    title = F.col("title")
    query = (
        F.when(kind == 0, title)
        .when(kind == 1, F.concat(F.lit('"'), title, F.lit('" '), F.col("journal")))
        .when(kind == 2, F.replace(title, F.lit(" "), F.lit("|")))
        .otherwise(F.concat(title, F.lit('"')))
    )
    return papers_df.select(F.col("paper_id").alias("query_id"), query.alias("query"))
