"""From raw documents to a training mix, in five stages.

Each stage takes what the one before kept and returns the columns of documents; the last returns the mix.
``run`` writes every stage as Parquet to the shared folder and reads it again, so a lost executor costs a stage
at most. The rows hold true for any table with doc_id, text and source; other columns pass through.

* quality: documents that the classifier scores below 0.5 go. Where no labelled text can be learnt all stay.
* near_duplicates: of each linked group the smallest doc_id stays; rows without doc_id stay.
* substrings: passages that a smaller doc_id holds are cut out; a text that loses all its words goes.
* contamination: documents that the benchmark contaminates go.
* mixing: one row per document: doc_id, size, source_size, target, taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm.components import small
from litspark.llm.contamination import contaminated_spans, hit_words, is_contaminated
from litspark.llm.mixing import mix_sources
from litspark.llm.near_duplicates import near_duplicates
from litspark.llm.quality_classifier import held_out, quality_scores
from litspark.llm.queries import table
from litspark.llm.substrings import remove_repeats
from litspark.llm.words import free_name
from litspark.sources.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""
    labels = table(spark, sf_dir, "labels")
    known = labels.where(F.col("quality").cast("int").isin(0, 1) & ~held_out("doc_id", 3, 1)).select(F.col("doc_id").cast("long").alias("id"))
    texts = docs.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(F.col("doc_id").cast("long").alias("id"))
    if not texts.join(known, "id", "left_semi").head(1):
        return docs
    score = free_name(docs, "score_")
    return quality_scores(docs, labels, docs.columns, score=score).where(F.col(score) >= 0.5).select(docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each linked group."""
    gone = stage(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct())
    known = docs.where(F.col("doc_id").isNotNull()).join(small(gone), "doc_id", "left_anti").select(docs.columns)
    return known.unionByName(docs.where(F.col("doc_id").isNull()))  # apart, as a join would bring them to one task


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that smaller documents hold; n_chars follows the text."""
    had, word = free_name(docs, "had_"), "[^\\x20\\x09-\\x0D]"
    cut = remove_repeats(docs.withColumn(had, F.coalesce(F.col("text").rlike(word), F.lit(False))))
    cut = cut.where(~F.col(had) | F.col("text").rlike(word))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(kind)))
    return cut.select(docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column meets an output's name
    judged = contaminated_spans(docs.toDF(*names), table(spark, sf_dir, "benchmark"), names, names[docs.columns.index("text")])
    return judged.where(~is_contaminated(F.col("n_words"), hit_words())).select(names).toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicate),
    ("substring_dedup", substrings),
    ("decontamination", contamination),
    ("mixing", mixing),
]

#: The classifier and the seeded hash are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, work in STAGES:
        docs = stage(work(spark, docs, sf_dir))
    return docs
