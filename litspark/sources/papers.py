"""Paper records from CSV drops: one file, or one folder of part files, per period."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import schema
from litspark.operators.clean import normalise_missing, type_year
from litspark.sources.csv_records import header_of, read_csv_records

_NAME = r"papers_([0-9a-z]+)\.csv"


def list_sources(spark: SparkSession, data_dir: str) -> DataFrame:
    """(period, path, size, mtime) of every source file; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(data_dir)
    period = F.regexp_extract("path", _NAME, 1)
    return files.select(
        period.alias("period"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    ).filter(F.col("period").isin(schema.PERIOD_NAMES))


def scan_period(spark: SparkSession, path: str, period: str) -> DataFrame:
    """Raw text records of one period, columns bound by header name, with their place in the files.

    A file is read by as many tasks as its size asks for, line breaks in quoted cells or not. Part files of one
    folder must have one header; the read fails where a file has another.
    """
    missing = [c for c in schema.PAPER_COLUMNS if c not in header_of(spark, path)]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    ordinal = F.struct(F.lit(schema.PERIOD_NAMES.index(period)).alias("period"), "file", "block", "line")
    return read_csv_records(spark, path).select(
        *[F.col("cells")[c].alias(c) for c in schema.PAPER_COLUMNS], ordinal.alias("ord"), F.lit(period).alias("source_period")
    )


def read_raw_papers(spark: SparkSession, data_dir: str) -> DataFrame:
    """All periods in their fixed order, every value still text, missing values as null.

    An absent period is a warning, no period at all an error.
    """
    present = {r.period for r in list_sources(spark, data_dir).select("period").distinct().collect()}
    absent = [p for p in schema.PERIOD_NAMES if p not in present]
    if absent:
        warnings.warn(f"no source file for {absent} in {data_dir}", stacklevel=2)
    if not present:
        raise ValueError(f"no source files in {data_dir}")
    scans = [
        scan_period(spark, f"{data_dir}/papers_{p}.csv", p) for p in schema.PERIOD_NAMES if p in present
    ]
    union = scans[0]
    for scan in scans[1:]:
        union = union.unionByName(scan)
    return normalise_missing(union, schema.PAPER_COLUMNS)


def read_papers(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """Typed records, and the records whose year is not a whole number."""
    return type_year(read_raw_papers(spark, data_dir))
