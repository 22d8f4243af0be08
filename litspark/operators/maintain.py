"""Keeping the embedding table in step with the papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark import schema
from litspark.operators.ranks import count_blocks, ord_block, values_at

ENTRY_COLUMNS = [
    "file_entry", "period", "num_papers", "min_year", "max_year", "first_index", "last_index", "file_size_mb",
    "created", "papers_added",
]


def papers_with_vectors(papers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Papers joined with their vectors by key."""
    return papers.join(embeddings.drop("period", "ord", "year"), "paper_id")


def delta_by_key(papers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Papers that have no vector yet."""
    return papers.join(embeddings.select("paper_id"), "paper_id", "left_anti")


def delta_by_count(papers: DataFrame, previous: DataFrame) -> DataFrame:
    """The first ``current - previous`` papers of each period in (period, previous).

    Right only while new papers are put in front of old ones; a period that shrank gives nothing.
    """
    narrow = papers.select("period", "ord")
    blocks = count_blocks(narrow, ord_block(narrow), ["period"])
    totals = blocks.select("period", "total").distinct()
    targets = totals.join(previous, "period", "left").select(
        "period", (F.col("total") - F.coalesce("previous", F.lit(0)) - 1).alias("pos"), F.lit(0).alias("tag")
    )
    last = values_at(narrow, targets, ord_block(narrow), F.col("ord"), ["period"], blocks, len(schema.PERIODS))
    return (
        papers.join(F.broadcast(last.select("period", "value")), "period")
        .filter(F.col("ord") <= F.col("value"))
        .drop("value")
    )


def half_split(df: DataFrame, order: Column | None = None, block: Column | None = None) -> DataFrame:
    """Add part 1 or 2: the first ``n // 2`` rows of a period, and the rest.

    The order value at the half is looked up per period (one row each, broadcast), then every row is
    compared with it in place.
    """
    order = F.col("ord") if order is None else order
    block = ord_block(df) if block is None else block
    blocks = count_blocks(df, block, ["period"])
    targets = blocks.select("period", (F.floor(F.col("total") / 2) - 1).alias("pos"), F.lit(0).alias("tag")).distinct()
    last = values_at(df, targets, block, order, ["period"], blocks, len(schema.PERIODS)).select("period", F.col("value").alias("_half"))
    part = F.when(order <= F.col("_half"), 1).otherwise(2)
    return df.join(F.broadcast(last), "period", "left").withColumn("part", part).drop("_half")


def split_boundary(papers: DataFrame, period: str = schema.SPLIT_PERIOD) -> DataFrame:
    """(idx, paper columns…): two rows before and two after the half of a period, counted from 0."""
    one = papers.filter(F.col("period") == period)
    narrow = one.select("period", "ord")
    blocks = count_blocks(narrow, ord_block(narrow), ["period"])
    split = blocks.select("period", F.floor(F.col("total") / 2).cast("bigint").alias("split")).distinct()
    targets = split.select("period", F.explode(F.expr("sequence(split - 2, split + 1)")).alias("pos")).withColumn(
        "tag", F.col("pos")
    )
    rows = values_at(narrow, targets, ord_block(narrow), F.col("ord"), ["period"], blocks, 4)
    wanted = rows.select(F.col("tag").alias("idx"), F.col("value").alias("ord"))
    return one.join(F.broadcast(wanted), "ord")


def merge_embeddings(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new vectors; ``batch`` grows by one, and new rows stand before old ones.

    Row order is (batch descending, ord), so nothing stored has to move.
    """
    next_batch = existing.agg(F.coalesce(F.max("batch"), F.lit(-1)) + 1).scalar()
    return existing.unionByName(new.withColumn("batch", next_batch.cast("int")))


def merged_order(df: DataFrame) -> tuple[Column, Column]:
    """Order and block of a merged table."""
    newest = (-F.col("batch")).alias("newest")
    return F.struct(newest, F.col("ord")), F.struct(newest, ord_block(df).alias("run"))


def file_entry(period: Column, part: Column) -> Column:
    split = period == schema.SPLIT_PERIOD
    return F.when(split, F.concat(period, F.lit("_part"), part.cast("string"))).otherwise(period)


def manifest_build(vectors: DataFrame, created: Column, papers_added: Column | None = None) -> DataFrame:
    """One entry row per stored file, from (period, part, year, embedding).

    Sizes count two bytes per element. Index ranges of the two halves follow from the counts.
    """
    grouped = vectors.groupBy(file_entry(F.col("period"), F.col("part")).alias("file_entry"), "period").agg(
        F.count(F.lit(1)).alias("num_papers"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        (F.sum(F.size("embedding") * 2) / 1048576.0).alias("file_size_mb"),
    )
    # at most seven rows from here on
    earlier = Window.partitionBy("period").orderBy("file_entry").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("num_papers").over(earlier), F.lit(0))
    return grouped.withColumn("first_index", first.cast("bigint")).select(
        "file_entry", "period", "num_papers", "min_year", "max_year", "first_index",
        (F.col("first_index") + F.col("num_papers") - 1).alias("last_index"), "file_size_mb",
        created.alias("created"), (F.lit(0) if papers_added is None else papers_added).cast("bigint").alias("papers_added"),
    )


def manifest_totals(entries: DataFrame) -> DataFrame:
    """Entries and their total (file_entry null) in one pass."""
    return entries.rollup("file_entry").agg(
        F.sum("num_papers").alias("num_papers"), F.sum("file_size_mb").alias("file_size_mb")
    )


def manifest_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace old ones of the same file, the others stay; papers_added is the growth."""
    fields = [c for c in ENTRY_COLUMNS if c not in ("file_entry", "papers_added")]
    joined = old.alias("o").join(new.alias("n"), "file_entry", "full_outer")
    added = F.when(
        F.col("n.num_papers").isNotNull(), F.col("n.num_papers") - F.coalesce(F.col("o.num_papers"), F.lit(0))
    ).otherwise(F.col("o.papers_added"))
    return joined.select(
        "file_entry", *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in fields], added.alias("papers_added")
    )


def expected_entries(spark: SparkSession) -> DataFrame:
    """(file_entry, period) of the seven files a complete table has."""
    rows = [(e, e.split("_part")[0]) for e in schema.FILE_ENTRIES]
    return spark.createDataFrame(rows, "file_entry string, period string")


def stale_periods(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """(period, stale): a source is newer than any of its entries, or an entry is missing."""
    expected = expected_entries(sources.sparkSession)
    known = entries.select("file_entry", "created")
    joined = sources.join(F.broadcast(expected), "period").join(known, "file_entry", "left")
    late = F.col("created").isNull() | (F.col("mtime") > F.col("created"))
    return joined.groupBy("period").agg(F.bool_or(late).alias("stale"))
