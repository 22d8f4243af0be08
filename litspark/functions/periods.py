"""Years and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark import schema


def in_period(year: Column, name: str) -> Column:
    lo, hi = next((lo, hi) for n, lo, hi in schema.PERIODS if n == name)
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (year >= lo)
    if hi is not None:
        inside = inside & (year < hi)
    return inside


def period_of(year: Column) -> Column:
    """Period name of a year, null for a null year."""
    named = F.when(year.isNull(), None)
    for name, _, hi in schema.PERIODS:
        named = named.when(year < hi, name) if hi is not None else named.otherwise(name)
    return named


def period_rank(period: Column) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in schema.PERIOD_NAMES]), period).cast("int")


def periods_between(year_from: int | None, year_to: int | None) -> list[str]:
    """Names of the periods a year range, open where a bound is None, touches: the partitions a scan must read."""
    return [
        name
        for name, lo, hi in schema.PERIODS
        if (hi is None or year_from is None or year_from < hi) and (lo is None or year_to is None or year_to >= lo)
    ]


def period_dimension(spark):
    """(period, lo, hi) rows, six of them."""
    return spark.createDataFrame(schema.PERIODS, "period string, lo int, hi int")


def by_range(papers, dimension):
    """Period by range lookup in a dimension table instead of a fixed expression.

    The dimension has one row per period and is broadcast; every paper meets exactly one of them.
    """
    dim = F.broadcast(dimension.withColumnRenamed("period", "found_period"))
    inside = (F.coalesce("lo", F.lit(-32768)) <= F.col("year")) & (F.col("year") < F.coalesce("hi", F.lit(32767)))
    return papers.join(dim, inside).drop("lo", "hi")
