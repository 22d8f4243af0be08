"""Building and updating the embedding table.

Every change is one commit of a versioned table: vectors, emptied periods, orphans and the manifest go together, so a run that
stops anywhere leaves the version before, and the next run does the work again. A manifest file that a caller names is a
copy of the committed one, brought up to date at the end of each run, also of one that finds nothing to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import schema
from litspark.functions import vectors
from litspark.operators import encode, maintain
from litspark.operators.ranks import small
from litspark.sources import embeddings as table
from litspark.sources import manifest as mf
from litspark.sources.staging import stage
from litspark.sources.versions import COMMIT, Folder, Part, Version, VersionedTable, now, timestamp

Encoder = Callable[[DataFrame], DataFrame]


def encode_papers(papers: DataFrame, encoder: Encoder, model_name: str, batch: int) -> DataFrame:
    """Vectors in storage form: half-rounded, with order, year, period, batch and model."""
    made = encoder(encode.with_text(papers).select("paper_id", "text"))
    kept = made.withColumn("embedding", vectors.half_round(F.col("embedding")).cast("array<float>"))
    return papers.select("paper_id", "ord", "year", "period").join(kept, "paper_id").select(
        "paper_id", "ord", "year", "embedding", F.lit(batch).alias("batch"), F.lit(model_name).alias("model_name"), "period"
    )


def entries_of(stored: DataFrame, created, papers_added=None) -> DataFrame:
    """Manifest entries of a stored table."""
    order, block = maintain.merged_order(stored)
    return maintain.manifest_build(maintain.half_split(stored, order, block), created, papers_added)


def _entries(tbl: VersionedTable, draft: Version, touched: set[str]) -> DataFrame:
    """Entries of the touched periods, with the sizes of their files; a half has its share of the period's by rows."""
    stored = tbl.read(draft, [p for p in draft.parts if p.partition in touched]).drop(COMMIT)
    made = entries_of(stored, timestamp(draft.created))
    sizes = [(p, mb, sum(x.rows for x in draft.parts if x.partition == p)) for p, mb in table.size_of(draft).items()]
    real = tbl.spark.createDataFrame(sizes, "period string, mb double, rows long")
    share = F.col("num_papers") / F.col("rows")
    return made.join(F.broadcast(real), "period").withColumn("file_size_mb", F.col("mb") * share).select(*maintain.ENTRY_COLUMNS)


def _commit(
    tbl: VersionedTable, last: Version | None, kept: list[Part], rows: DataFrame, touched: set[str], operation: str,
    model_name: str, dim: int, growth: bool,
) -> Version:
    """Write rows, make the manifest of what the new version will hold, publish both.

    Entries of other periods stay as they are; a touched period that has become empty loses its entries.
    """
    parts = kept + tbl.write(rows)
    draft = Version(-1, now(), operation, rows.schema.json(), parts)
    held = {p.partition for p in parts}
    spark = tbl.spark
    entries = _entries(tbl, draft, touched & held)
    if last is not None:
        old = mf.manifest_rows(manifest(spark, last)).select(*maintain.ENTRY_COLUMNS)
        if growth:
            entries = maintain.manifest_upsert(old, entries).join(F.broadcast(entries.select("file_entry")), "file_entry", "left_semi")
        entries = entries.unionByName(old.filter(F.col("period").isin(sorted(held - touched))))
    document = mf.manifest_document(entries, model_name, dim).select(F.to_json(F.struct("*")).alias("json")).first()[0]
    return tbl.publish(last, parts, rows.schema, operation, {"model_name": model_name, "dim": dim, "manifest": document}, draft.created)


def manifest(spark: SparkSession, version: Version) -> DataFrame:
    """The manifest that a version was committed with."""
    return mf.parse_manifest(spark.createDataFrame([(version.extra["manifest"],)], "json string"))


def _told(spark: SparkSession, version: Version, manifest_path: str | None) -> DataFrame:
    if manifest_path is None:
        return manifest(spark, version)
    folder, name = manifest_path.rstrip("/").rpartition("/")[::2]
    Folder(spark, folder).publish(name, version.extra["manifest"], replace=True)
    return mf.read_manifest(spark, manifest_path)


def full_build(
    papers: DataFrame, path: str, encoder: Encoder, model_name: str, dim: int, manifest_path: str | None = None,
    periods: list[str] | None = None,
) -> DataFrame:
    """Encode all papers, or those of some periods, in place of what these periods held; returns the manifest.

    Vectors of papers that are gone go, and so do periods that have none left. Other periods keep their files and entries.
    """
    spark = papers.sparkSession
    tbl = table.table_of(spark, path)
    last = tbl.version()
    chosen = papers if periods is None else papers.filter(F.col("period").isin(periods))
    kept = [] if last is None or periods is None else [p for p in last.parts if p.partition not in periods]
    touched = set(schema.PERIOD_NAMES if periods is None else periods)
    if kept:
        _same_model(last, model_name, dim)
    rows = encode_papers(chosen, encoder, model_name, 0)
    rows = rows.withColumn("embedding", table.of_width(F.col("embedding"), dim))
    made = _commit(tbl, last, kept, rows, touched, "build", model_name, dim, False)
    return _told(spark, made, manifest_path)


def _same_model(last: Version, model_name: str, dim: int) -> None:
    has = (last.extra["model_name"], last.extra["dim"])
    if has != (model_name, dim):
        raise ValueError(f"the table holds vectors of {has}, not of {(model_name, dim)}: build it anew")


def model_of(spark: SparkSession, manifest_path: str) -> str:
    """Model name the manifest records, the default name where it records none."""
    found = mf.read_manifest(spark, manifest_path).select("model_name").first()
    return (found and found[0]) or schema.DEFAULT_MODEL


def differences(papers: DataFrame, stored: DataFrame) -> DataFrame:
    """(paper_id, period, old_period, commit): papers without a vector in their period, and vectors without a paper there."""
    here = papers.select("paper_id", "period")
    there = stored.select("paper_id", F.col("period").alias("old_period"), COMMIT)
    joined = here.join(there, "paper_id", "full_outer")
    moved = F.col("period") != F.col("old_period")
    return joined.filter(F.col("period").isNull() | F.col("old_period").isNull() | moved)


def update(
    papers: DataFrame, path: str, encoder: Encoder, model_name: str | None = None, dim: int | None = None, manifest_path: str | None = None
) -> DataFrame:
    """Encode the papers that have no vector, remove vectors that have no paper, and return the manifest; one commit.

    The model is the table's own; a named one must be the same. New vectors are a batch beside the stored ones, which are not
    rewritten, but for those parts that lose a vector. Where nothing differs, nothing is committed.
    """
    spark = papers.sparkSession
    tbl = table.table_of(spark, path)
    last = tbl.version()
    if last is None:
        raise ValueError(f"{path} has no version yet: build it first")
    model_name, dim = model_name or last.extra["model_name"], dim or last.extra["dim"]
    _same_model(last, model_name, dim)
    stored = tbl.read(last)
    found = stage(differences(papers, stored))
    counted = found.groupBy("period", "old_period", COMMIT).count().collect()  # parts and periods, not papers
    if not counted:
        return _told(spark, last, manifest_path)
    n = sum(r["count"] for r in counted)
    losing = {(r[COMMIT], r.old_period) for r in counted if r.old_period is not None}
    touched = {r.period for r in counted if r.period is not None} | {p for _, p in losing}
    new = papers.join(small(found.filter(F.col("period").isNotNull()).select("paper_id"), n), "paper_id", "left_semi")
    batch = stored.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0] + 1
    rows = encode_papers(new, encoder, model_name, batch)
    rows = rows.withColumn("embedding", table.of_width(F.col("embedding"), dim))
    rewritten = [p for p in last.parts if (p.commit, p.partition) in losing]
    if rewritten:
        gone = found.filter(F.col(COMMIT).isNotNull()).select("paper_id", COMMIT)
        rows = rows.unionByName(tbl.read(last, rewritten).join(small(gone, n), ["paper_id", COMMIT], "left_anti").select(rows.columns))
    kept = [p for p in last.parts if (p.commit, p.partition) not in losing]
    return _told(spark, _commit(tbl, last, kept, rows, touched, "update", model_name, dim, True), manifest_path)
