"""Tables written to the shared folder: snapshots of a corpus, and results read several times."""

from __future__ import annotations

import functools
import hashlib
import json
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.session import shared_dir
from litspark.sources.versions import Folder


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage on storage that outlives executors, and later readers prune columns and
    partitions of it.
    """
    path = f"{shared_dir(df.sparkSession)}/litspark/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; files elsewhere are left alone."""
    for df in tables:
        spark = df.sparkSession
        own = f"/litspark/{spark.sparkContext.applicationId}/"
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if own in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_snapshots: dict[tuple, DataFrame] = {}

SNAPSHOTS = "litspark/snapshots"


def source_stamp(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files under some paths, of any number of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    code = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    row = files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime").cast("string"), F.sum(code).cast("string")).first()
    return hashlib.sha256(repr((sorted(paths), *row)).encode()).hexdigest()[:24]


@functools.cache
def code_stamp() -> str:
    """A digest of this library's code, which says how snapshots are made."""
    digest = hashlib.sha256()
    root = Path(__file__).parent.parent
    for part in ("", "functions", "operators", "plans", "sources"):
        for file in sorted((root / part).glob("*.py")):
            digest.update(file.name.encode() + file.read_bytes())
    return digest.hexdigest()[:12]


def snapshot(
    spark: SparkSession, name: str, path: str | list[str], build: Callable[[], DataFrame], partition_by: list[str] | None = None
) -> DataFrame:
    """The stored result of ``build()``, made again only when the files under the path or this library's code change.

    It stands in the shared folder under a name that says what it was made of, so later applications find it. It is written
    beside and then renamed: readers see it whole, and of writers at the same time the first one counts.
    """
    paths = [path] if isinstance(path, str) else list(path)
    called = f"{name}-{source_stamp(spark, *paths)}-{code_stamp()}"
    key = (spark.sparkContext.applicationId, shared_dir(spark), called)
    if key not in _snapshots:
        folder = Folder(spark, f"{shared_dir(spark)}/{SNAPSHOTS}")
        if not folder.exists(called):
            made, beside = build(), f"{called}.{uuid.uuid4().hex}.tmp"
            writer = made.write.mode("errorifexists")
            writer = writer.partitionBy(*partition_by) if partition_by else writer
            writer.parquet(f"{folder.path}/{beside}")
            folder.publish(f"{beside}/_schema.json", made.schema.json())
            try:
                folder.move(beside, called)
            except FileExistsError:
                folder.delete(beside)
        schema = T.StructType.fromJson(json.loads(folder.read(f"{called}/_schema.json")))
        _snapshots[key] = spark.read.schema(schema).parquet(f"{folder.path}/{called}")
    return _snapshots[key]


def evict_snapshots(spark: SparkSession, max_age: float) -> list[str]:
    """Delete snapshots, and what stopped writers left, older than some seconds; returns their names.

    An application that still reads one of them fails there, so the age should be longer than any application lives.
    """
    folder = Folder(spark, f"{shared_dir(spark)}/{SNAPSHOTS}")
    old = [name for name, _, changed in folder.list() if time.time() - changed >= max_age]
    for name in old:
        folder.delete(name)
    for key in [k for k in _snapshots if k[2] in old]:
        del _snapshots[key]
    return old
