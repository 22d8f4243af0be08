"""Corpus curation: missing years, book reviews, titles, duplicates, broken links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark import schema
from litspark.functions import text
from litspark.operators.ranks import number_within, ord_block


def normalise_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: text.na_normalise(F.col(c)) for c in columns})


def type_year(df: DataFrame, column: str = "year") -> tuple[DataFrame, DataFrame]:
    """Rows with a smallint year (or none), and the rows whose year text is not a whole number."""
    typed = df.withColumn("_year", text.year_from_text(F.col(column)))
    bad = F.col(column).isNotNull() & F.col("_year").isNull()
    good = typed.filter(~bad).withColumn(column, F.col("_year")).drop("_year")
    return good, typed.filter(bad).drop("_year").withColumn("reason", F.lit("year"))


def drop_missing_year(df: DataFrame) -> DataFrame:
    return df.filter(F.col("year").isNotNull())


def drop_book_reviews(df: DataFrame) -> DataFrame:
    """Null titles cannot be judged and go too; ``rejected`` lists them."""
    return df.filter(~text.is_book_review(F.col("title")))


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("year").isNotNull() & F.col("title").isNull()).withColumn("reason", F.lit("title"))


def clean_titles(df: DataFrame) -> DataFrame:
    return df.withColumn("title", text.clean_title(F.col("title")))


def dedupe(df: DataFrame) -> DataFrame:
    """First row of each (title, url); rows without url are all kept.

    ``row_number() = 1`` is applied on the map side before the shuffle, so copies leave a task as one
    row whatever their number. Rows without url get their own order value as a third key part: they
    spread evenly instead of meeting in one (title, null) group, and the source is scanned once.
    """
    alone = F.when(F.col("url").isNull(), F.col("ord"))
    first = Window.partitionBy("title", "url", alone).orderBy("ord")
    return df.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).drop("_rn")


def null_broken_links(df: DataFrame) -> DataFrame:
    # after dedupe: a broken link still tells two rows apart there
    return df.withColumn("url", text.null_broken_link(F.col("url")))


def clean_papers(df: DataFrame) -> DataFrame:
    """The whole chain, in the order that decides its result."""
    kept = drop_book_reviews(drop_missing_year(df))
    return null_broken_links(dedupe(clean_titles(kept)))


def _marked(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))


def with_paper_id(df: DataFrame) -> DataFrame:
    """Content key of deduplicated rows whose broken links still stand.

    Title and url are unique where there is a url. Rows without one are told apart by all their
    fields, and equal rows among them by their count so far.
    """
    with_url = df.filter(F.col("url").isNotNull()).withColumn(
        "paper_id", F.sha2(F.concat_ws("\u0001", F.lit("u"), _marked("title"), _marked("url")), 256)
    )
    fields = ["title", "authors", "abstract", "journal", "year"]
    content = F.sha2(F.concat_ws("\u0001", F.lit("n"), *[_marked(c) for c in fields]), 256)
    without = df.filter(F.col("url").isNull()).withColumn("_content", content)
    numbered = number_within(without, ["_content"], ord_block(df), F.col("ord"), "_copy")
    keyed = numbered.withColumn("paper_id", F.sha2(F.concat_ws("\u0001", "_content", F.col("_copy").cast("string")), 256))
    return with_url.unionByName(keyed.drop("_content", "_copy"))


def stage_counts(df: DataFrame) -> DataFrame:
    """(step, rows): rows in, rows each step removes or changes, rows out, from one pass.

    Rows are first counted per (fate, title, url), combined on the map side, so copies cost nothing.
    """
    fate = (
        F.when(F.col("year").isNull(), "missing_years")
        .when(F.col("title").isNull(), "null_titles")
        .when(text.is_book_review(F.col("title")), "book_reviews")
        .otherwise("kept")
    )
    keyed = F.col("url").isNotNull() & (fate == "kept")
    groups = df.groupBy(
        fate.alias("fate"), F.when(keyed, text.clean_title(F.col("title"))).alias("title"),
        F.when(keyed, F.col("url")).alias("url"),
    ).agg(F.count(F.lit(1)).alias("n"))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    dup = F.when(F.col("url").isNotNull(), F.col("n") - 1).otherwise(F.lit(0))
    steps = {
        "raw": total(F.col("n")),
        "missing_years": total(F.when(F.col("fate") == "missing_years", F.col("n"))),
        "null_titles": total(F.when(F.col("fate") == "null_titles", F.col("n"))),
        "book_reviews": total(F.when(F.col("fate") == "book_reviews", F.col("n"))),
        "duplicates": total(dup),
        "broken_links": total(F.when(F.col("url").isin(schema.BROKEN_LINKS), F.lit(1))),
        "kept": total(F.when(F.col("fate") == "kept", F.col("n") - dup)),
    }
    one = groups.agg(*[c.alias(s) for s, c in steps.items()])
    return one.unpivot([], list(steps), "step", "rows")


def distinct_ratio(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """(column, distinct_values, rows, ratio, repetitive): how repetitive each column is.

    Counts are approximate unless asked otherwise; exact ones compare 128-bit digests, which keeps
    long texts out of the shuffle.
    """
    count = (lambda c: F.count_distinct(F.unhex(F.md5(c)))) if exact else F.approx_count_distinct
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[count(F.col(c).cast("string")).alias(c) for c in columns])
    long = counted.unpivot(["rows"], columns, "column", "distinct_values")
    ratio = F.col("distinct_values") / F.col("rows")
    return long.select("column", "distinct_values", "rows", ratio.alias("ratio"), (ratio < 0.5).alias("repetitive"))
