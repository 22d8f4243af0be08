"""New CSV drops: clean them and add the papers not seen before."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark import schema
from litspark.operators import clean
from litspark.operators.encode import with_text
from litspark.plans.curate import with_period
from litspark.sources.csv_records import first_bytes, header_cells, read_csv_records
from litspark.sources.seen import index_parts, parts, seen_keys
from litspark.sources.staging import stage

FILES = "path string, modificationTime timestamp, length long, content binary"
RECORD = T.StructType([*(T.StructField(c, T.StringType()) for c in schema.PAPER_COLUMNS), T.StructField("file", T.StringType()),
                       T.StructField("block", T.LongType()), T.StructField("line", T.LongType())])


def drops(spark: SparkSession, data_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the names of arriving files. Their contents are read batch by batch, by what each file's header says."""
    found = spark.readStream.schema(FILES).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(data_dir)
    return found.select("path", "length")


def read_drops(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Raw records of some files, and (file, reason) of the files that hold none.

    Files are grouped by header, so columns may stand in any order and others may be there. Only the start of a file is read
    here in the driver, and a trigger names a bounded number of files.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    bad = []
    for path in sorted(paths):
        header = header_cells(first_bytes(spark, path))
        missing = [c for c in schema.PAPER_COLUMNS if c not in header]
        if missing:
            bad.append((path, f"missing columns {missing}" if header else "no header"))
        elif len({c.lower() for c in header}) < len(header):
            bad.append((path, "repeated columns"))
        else:
            groups.setdefault(tuple(header), []).append(path)
    records = spark.createDataFrame([], RECORD)
    for header, files in groups.items():
        found = read_csv_records(spark, files, list(header))
        records = records.unionByName(found.select(*[F.col("cells")[c].alias(c) for c in schema.PAPER_COLUMNS], "file", "block", "line"))
    return records, bad


def typed_batch(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed records of one batch, and those whose year is not a whole number."""
    line = F.col("line") if "line" in batch.columns else F.monotonically_increasing_id()
    numbered = batch.withColumn("ord", F.struct("file", "block", line.alias("line")))
    return clean.type_year(clean.normalise_missing(numbered.select(*schema.PAPER_COLUMNS, "ord"), schema.PAPER_COLUMNS))


def rejected_batch(batch: DataFrame) -> DataFrame:
    """Records of one batch left out for a bad year or a null title, with the reason; years stay text."""
    typed, bad = typed_batch(batch)
    return bad.unionByName(clean.rejected(typed).withColumn("year", F.col("year").cast("string")).select(bad.columns)).drop("ord")


def rejects_path(table: str) -> str:
    """Where the rejects of a table's batches are written."""
    return f"{table.rstrip('/')}_rejects"


def clean_batch(batch: DataFrame) -> DataFrame:
    """Curated, keyed papers of one batch."""
    typed, _ = typed_batch(batch)
    kept = clean.drop_book_reviews(clean.drop_missing_year(typed))
    unique = stage(clean.dedupe(clean.clean_titles(kept)))
    return with_period(clean.null_broken_links(clean.with_paper_id(unique)))


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave a checkpoint when it was made; restarts keep it."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def add_unseen(
    spark: SparkSession, batch: DataFrame, batch_id: int, table: str, encoder=None, run_id: str = "none",
    bad_files: list[tuple[str, str]] | None = None,
) -> None:
    """Write the batch's unseen papers as partition (run_id, batch_id) of the table.

    What is seen is the table itself, less this batch, by the key index beside it (``sources/seen.py``): run again after a failure the same partition
    is written again, so a batch counts once. Batches count from 0 in every checkpoint, so the run's id
    tells them apart. The batch's rejects go to ``rejects_path(table)``, by run_id and batch_id too: records, and a row for
    each file (file, reason) that could not be read.
    """
    rejects = rejected_batch(batch)
    if bad_files:
        said = spark.createDataFrame([(f"file {path}: {reason}",) for path, reason in bad_files], "reason string")
        rejects = rejects.unionByName(said, allowMissingColumns=True)
    rejects = rejects.withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id)})
    rejects.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch_id").parquet(rejects_path(table))
    new = clean_batch(batch)
    seen = seen_keys(new, table, run_id, batch_id)
    if seen is not None:
        new = new.join(seen, "paper_id", "left_anti")
    if encoder is not None:
        new = stage(new)
        texts = with_text(new).select("paper_id", "text")
        new = new.join(encoder(texts), "paper_id")
    out = new.drop("ord").withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch_id", "period").parquet(table)
    index_parts(spark, table, parts(spark, table) & {(run_id, batch_id)})


def add_drops(spark: SparkSession, files: DataFrame, batch_id: int, table: str, encoder, run_id: str) -> None:
    """Take in the files of one trigger; those that cannot be read are recorded and do not hold up the others."""
    records, bad = read_drops(spark, [r.path for r in files.select("path").collect()])
    add_unseen(spark, records, batch_id, table, encoder, run_id, bad)


def ingest_available(spark: SparkSession, data_dir: str, table: str, checkpoint: str, encoder=None, files_per_batch: int = 1000):
    """Take in all drops that have arrived, then stop. Returns the finished query."""
    query = (
        drops(spark, data_dir, files_per_batch).writeStream
        .foreachBatch(lambda df, i: add_drops(df.sparkSession, df, i, table, encoder, checkpoint_id(df.sparkSession, checkpoint)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
