"""The embedding table: (paper_id, ord, year, embedding, batch, model_name), partitioned by period, in versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.sources.versions import COMMIT, Version, VersionedTable

PARTITION = "period"


def table_of(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, PARTITION)


def of_width(embedding: Column, dim: int) -> Column:
    """The vector; the query fails at one of another width, so that none goes missing unseen."""
    wrong = F.concat(F.lit(f"a vector of width other than {dim}: "), F.coalesce(F.size(embedding).cast("string"), F.lit("none")))
    return F.when(F.size(embedding) == dim, embedding).otherwise(F.raise_error(wrong))


def read_embeddings(
    spark: SparkSession, path: str, model_name: str | None = None, dim: int | None = None, version: int | None = None
) -> DataFrame:
    """The vectors of the last version, or of a named one; with a model name, only vectors made with it.

    With a width, a vector of another one stops the query that reads it. A folder without versions is read as it is.
    """
    table = table_of(spark, path)
    found = table.version(version)
    stored = spark.read.parquet(path) if found is None else table.read(found).drop(COMMIT)
    if model_name is not None:
        stored = stored.filter(F.col("model_name") == model_name)
    if dim is not None:
        stored = stored.withColumn("embedding", of_width(F.col("embedding"), dim))
    return stored


def size_of(version: Version) -> dict[str, float]:
    """Megabytes of the files of each period, as the file system has them."""
    sizes: dict[str, float] = {}
    for p in version.parts:
        sizes[p.partition] = sizes.get(p.partition, 0.0) + p.bytes / 1048576.0
    return sizes


def file_sizes(stored: DataFrame) -> DataFrame:
    """(period, file_size_mb) of the files behind a stored table."""
    files = stored.select("period", "_metadata.file_path", "_metadata.file_size").distinct()
    return files.groupBy("period").agg((F.sum("file_size") / 1048576.0).alias("file_size_mb"))
