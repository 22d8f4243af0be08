"""Text expressions: missing values, years, titles, search text, words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark import schema


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row.

    Named columns do not ensure that: the optimiser puts their definition in place of every use.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def na_normalise(c: Column) -> Column:
    """Null for the cell texts that stand for a missing value."""
    return F.when(~c.isin(schema.NA_TOKENS), c)


def year_from_text(c: Column) -> Column:
    """Whole-number year text, ``2002``, ``2002.0`` or ``2.002e3``; anything else gives null."""
    number = F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), c.try_cast("double"))
    return F.when(number == F.floor(number), number.try_cast("smallint"))


def is_book_review(title: Column) -> Column:
    upper = F.upper(title)
    found = F.lit(False)
    for mark in schema.REVIEW_MARKS:
        found = found | F.contains(upper, F.lit(mark.upper()))
    return found


def clean_title(title: Column) -> Column:
    """Drop bracketed lines, then turn the line breaks that are left into spaces."""
    # (?d): only \n ends a line, so other separators may stand inside the brackets
    return F.translate(F.regexp_replace(title, r"(?d)\n\[.*?\]", ""), "\n", " ")


def null_broken_link(url: Column) -> Column:
    return F.when(~url.isin(schema.BROKEN_LINKS), url)


def embedding_text(title: Column, abstract: Column) -> Column:
    """Title and abstract; without an abstract the separating space stays."""
    return F.concat(title, F.lit(" "), F.coalesce(abstract, F.lit("")))


def search_text(title: Column, abstract: Column, authors: Column | None = None) -> Column:
    text = embedding_text(title, abstract)
    return text if authors is None else F.concat(text, F.lit(" "), F.coalesce(authors, F.lit("")))


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(schema.BLANKS))


def has_real_abstract(abstract: Column) -> Column:
    """More than 50 characters besides blanks at the ends; false for null."""
    return F.coalesce(F.length(strip_blanks(abstract)) > 50, F.lit(False))


def words(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(schema.TOKEN_PATTERN), F.lit(0))


def seeded_hash(seed: int, *parts: Column) -> Column:
    """Hex md5 of seed and parts: the repeatable source of every random order and draw."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_number(hex_text: Column, digits: int = 15) -> Column:
    """The first hex digits as a number; 15 digits fill a bigint."""
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("bigint")


def citation_line(rank: Column, similarity: Column | None = None) -> Column:
    """One numbered reference line; papers without url get no link."""
    title = F.when(
        F.coalesce(F.col("url"), F.lit("")) != "", F.format_string("[%s](%s)", F.col("title"), F.col("url"))
    ).otherwise(F.col("title"))
    lead = F.format_string("%d. ", rank)
    if similarity is not None:
        lead = F.concat(lead, F.format_string("%.3f ", similarity))
    return F.concat(
        lead, title, F.lit(". "), F.coalesce(F.col("authors"), F.lit("<NA>")), F.lit(". "),
        F.col("year").cast("string"), F.lit(". "), F.col("journal"), F.lit("."),
    )
