"""Comparing two drops of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size) of the files of a folder, names relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    tail = F.substring_index("path", "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.select(tail.alias("name"), F.col("length").alias("size"), "content")


def changed_files(spark: SparkSession, old_dir: str, new_dir: str) -> DataFrame:
    """(name) of the files of the new drop that are absent from the old one or differ from it.

    Sizes are compared first, from the listing alone. Contents are read and hashed only for files
    of equal size.
    """
    old, new = list_files(spark, old_dir), list_files(spark, new_dir)
    sizes_old, sizes_new = old.select("name", "size"), new.select("name", "size")
    other_size = sizes_new.join(sizes_old, ["name", "size"], "left_anti").select("name")
    same_size = sizes_new.join(sizes_old, ["name", "size"], "left_semi").select("name")

    def hashed(files: DataFrame) -> DataFrame:
        return files.select("name", F.sha2("content", 256).alias("sha")).join(same_size, "name", "left_semi")

    return other_size.unionByName(changed_entries(hashed(old), hashed(new)))


def changed_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names whose (name, sha) pair the old listing does not hold."""
    return new.join(old, ["name", "sha"], "left_anti").select("name")


def content_fingerprint(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(name, sha): order-free fingerprint of the rows of each group.

    A sum of row hashes, combined on the map side, so a group of any size never meets in one task.
    """
    code = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))
    low = F.conv(F.substring(code, 1, 12), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(code, 13, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(F.col(name).alias("name")).agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(low).cast("string"), F.sum(high).cast("string")).alias("sha")
    )
