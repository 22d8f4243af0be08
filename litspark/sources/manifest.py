"""The manifest: header fields and one entry per stored file, kept as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY_TYPE = T.StructType([
    T.StructField("num_papers", T.LongType()),
    T.StructField("file_size_mb", T.DoubleType()),
    T.StructField("year_range", T.StringType()),
    T.StructField("index_range", T.StringType()),
    T.StructField("source_csv", T.StringType()),
    T.StructField("creation_date", T.StringType()),
    T.StructField("papers_added", T.LongType()),
])
MANIFEST_TYPE = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("embedding_dim", T.IntegerType()),
    T.StructField("creation_date", T.StringType()),
    T.StructField("last_update", T.StringType()),
    T.StructField("total_papers", T.LongType()),
    T.StructField("note", T.StringType()),
    T.StructField("embedding_structure", T.ArrayType(T.StringType())),
    T.StructField("files", T.MapType(T.StringType(), ENTRY_TYPE)),
    T.StructField("total_size_mb", T.DoubleType()),
])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_TYPE).option("multiLine", True).json(path)


def parse_manifest(texts: DataFrame, column: str = "json") -> DataFrame:
    """The same from a column of JSON texts."""
    return texts.select(F.from_json(column, MANIFEST_TYPE).alias("m")).select("m.*")


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """One row per file entry, ranges as numbers, times as timestamps.

    An entry without its own time takes the manifest's.
    """
    entries = manifest.select(
        "model_name", "embedding_dim", F.col("creation_date").alias("made"), F.explode("files").alias("file_entry", "e")
    )

    def number(c, i):
        return F.regexp_extract(c, r"^(\d+)-(\d+)", i).try_cast("bigint")

    return entries.select(
        "file_entry", "model_name", "embedding_dim", F.col("e.num_papers").alias("num_papers"),
        F.col("e.file_size_mb").alias("file_size_mb"),
        number(F.col("e.year_range"), 1).cast("smallint").alias("min_year"),
        number(F.col("e.year_range"), 2).cast("smallint").alias("max_year"),
        number(F.col("e.index_range"), 1).alias("first_index"),
        number(F.col("e.index_range"), 2).alias("last_index"),
        F.regexp_extract("e.source_csv", r"papers_([0-9a-z]+)\.csv", 1).alias("period"),
        F.to_timestamp(F.coalesce(F.col("e.creation_date"), F.col("made"))).alias("created"),
        F.coalesce(F.col("e.papers_added"), F.lit(0)).cast("bigint").alias("papers_added"),
    )


def manifest_document(entries: DataFrame, model_name: str, dim: int, note: str = "") -> DataFrame:
    """One row in the manifest's own shape, from entry rows (at most one per stored file)."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    index_range = F.when(
        F.col("file_entry") != F.col("period"), F.format_string("%d-%d of %s", "first_index", "last_index", "period")
    )
    entry = F.struct(
        F.col("num_papers"), F.col("file_size_mb"),
        F.format_string("%d-%d", "min_year", "max_year").alias("year_range"),
        index_range.alias("index_range"),
        F.format_string("papers_%s.csv", "period").alias("source_csv"),
        F.date_format("created", iso).alias("creation_date"),
        F.col("papers_added"),
    )
    sorted_entries = F.array_sort(F.collect_list(F.struct(F.col("file_entry"), entry.alias("e"))))
    return entries.agg(
        F.date_format(F.min("created"), iso).alias("creation_date"),
        F.date_format(F.max("created"), iso).alias("last_update"),
        F.coalesce(F.sum("num_papers"), F.lit(0)).alias("total_papers"),
        F.coalesce(F.sum("file_size_mb"), F.lit(0.0)).alias("total_size_mb"),
        sorted_entries.alias("entries"),
    ).select(
        F.lit(model_name).alias("model_name"), F.lit(dim).alias("embedding_dim"), "creation_date", "last_update",
        "total_papers", F.lit(note).alias("note"),
        F.transform("entries", lambda x: x["file_entry"]).alias("embedding_structure"),
        F.map_from_entries("entries").alias("files"), "total_size_mb",
    )


def write_manifest(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").json(path)
