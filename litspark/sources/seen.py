"""Which keys a growing table holds: Bloom filters by key prefix, and the keys themselves behind them.

Beside a table with parts (run_id, batch_id) stand the keys of each part, sorted by prefix, and a row for each of its prefixes
with a Bloom filter. A new batch reads the filters of its own prefixes, and the keys only of prefixes where a filter said
perhaps; sorted files let Parquet skip the others. What a filter says is always verified on the keys, so its false answers cost
reading, not results. Neither the table nor its keys are shuffled as a whole.

A part is indexed after it is written, keys before filters, so a part with filters is whole. Parts that lack them, because a
run stopped there or the table is older than its index, are indexed before the next batch looks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.operators.ranks import small
from litspark.sources.staging import stage

PREFIXES = 4096
#: Bits of a filter for each key, and how many of them a key sets: about 3 false answers in 1,000.
BITS, TRIES = 12, 8
_PART = ["run_id", "batch_id"]


def keys_path(table: str) -> str:
    return f"{table.rstrip('/')}_seen/keys"


def filters_path(table: str) -> str:
    return f"{table.rstrip('/')}_seen/filters"


def with_prefix(df: DataFrame) -> DataFrame:
    """Rows with the hash and the prefix of their key."""
    return df.withColumn("hash", F.xxhash64("paper_id")).withColumn("prefix", F.pmod("hash", F.lit(PREFIXES)).cast("int"))


def _places(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """The bits of each hash, a row a hash."""
    wide = hashes.astype(np.int64, copy=False).view(np.uint64)
    # The low bits are the prefix. An odd factor moves what the high bits say into another place.
    first, step = wide >> np.uint64(12), ((wide * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(12)) | np.uint64(1)
    return (first[:, None] + step[:, None] * np.arange(TRIES, dtype=np.uint64)) % np.uint64(n_bits)


def bloom(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-len(hashes) * BITS // 8) * 8), dtype=np.uint8)
    bits[_places(hashes, len(bits)).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def perhaps(hashes: np.ndarray, kept: bytes) -> np.ndarray:
    """Whether a filter may hold each hash."""
    raw = np.frombuffer(kept, dtype=np.uint8)
    at = _places(hashes, len(raw) * 8)
    return ((raw[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _fill(part: pa.Table) -> pa.Table:
    hashes = part.column("hash").to_numpy()
    given = {c: part.column(c)[:1] for c in [*_PART, "prefix"]}
    return pa.table(given | {"n": pa.array([len(hashes)], pa.int64()), "bloom": pa.array([bloom(hashes)], pa.binary())})


def _ask(keys: pa.Table, filters: pa.Table) -> pa.Table:
    found = np.zeros(len(keys), dtype=bool)
    hashes = keys.column("hash").to_numpy()
    for kept in filters.column("bloom"):
        found |= perhaps(hashes, kept.as_py())
    return keys.filter(pa.array(found)).select(["paper_id", "prefix"])


def parts(spark: SparkSession, path: str) -> set[tuple[str, int]]:
    """The parts (run_id, batch_id) that stand under a path, by its folders; none where nothing is written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/run_id=*/batch_id=*")) or []
    names = [str(x.getPath().toString()).rstrip("/").split("/")[-2:] for x in found]
    return {(run.partition("=")[2], int(batch.partition("=")[2])) for run, batch in names}


def index_parts(spark: SparkSession, table: str, wanted: set[tuple[str, int]]) -> None:
    """Write the keys and filters of some parts of a table; what stands for them is replaced."""
    if not wanted:
        return
    named = F.broadcast(spark.createDataFrame(sorted(wanted), "run_id string, batch_id int"))
    stored = spark.read.parquet(table).select(F.col("run_id").cast("string").alias("run_id"), F.col("batch_id").cast("int").alias("batch_id"), "paper_id")
    rows = with_prefix(stored.join(named, _PART).where(F.col("paper_id").isNotNull()))

    def write(df: DataFrame, path: str) -> None:
        df = df.repartitionByRange(*_PART, "prefix").sortWithinPartitions(*_PART, "prefix")
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PART).parquet(path)

    write(rows.select(*_PART, "prefix", "paper_id"), keys_path(table))
    shape = "run_id string, batch_id int, prefix int, n bigint, bloom binary"
    write(rows.select(*_PART, "prefix", "hash").groupBy(*_PART, "prefix").applyInArrow(_fill, shape), filters_path(table))


def _others(spark: SparkSession, path: str, columns: str, run_id: str, batch_id: int, prefixes: list[int]) -> DataFrame:
    """Index rows of some prefixes, of all parts but one. At most PREFIXES values reach the scan's filter."""
    rows = spark.read.schema(f"prefix int, {columns}, run_id string, batch_id int").parquet(path)
    return rows.where(((F.col("run_id") != run_id) | (F.col("batch_id") != batch_id)) & F.col("prefix").isin(prefixes))


def _prefixes(df: DataFrame) -> list[int]:
    return sorted(r.prefix for r in df.select("prefix").distinct().collect())


def seen_keys(batch: DataFrame, table: str, run_id: str, batch_id: int) -> DataFrame | None:
    """The keys (paper_id) of a batch that other parts of the table hold; None where there can be none.

    Null keys are never seen. Parts without filters are indexed first.
    """
    spark = batch.sparkSession
    own = (run_id, batch_id)
    stored = parts(spark, table) - {own}
    index_parts(spark, table, stored - parts(spark, filters_path(table)))
    if not stored:
        return None
    kind = batch.schema["paper_id"].dataType.simpleString()
    keys = stage(with_prefix(batch.select("paper_id").where(F.col("paper_id").isNotNull()).distinct()))
    filters = _others(spark, filters_path(table), "n bigint, bloom binary", *own, _prefixes(keys))
    asked = keys.groupBy("prefix").cogroup(filters.select("prefix", "bloom").groupBy("prefix"))
    candidates = stage(asked.applyInArrow(_ask, f"paper_id {kind}, prefix int"))
    if not (hit := _prefixes(candidates)):
        return None
    known = _others(spark, keys_path(table), f"paper_id {kind}", *own, hit)
    # Few candidates are held against the keys where those are read; many meet them by key.
    return known.join(small(candidates.select("paper_id"), candidates.count()), "paper_id", "left_semi").select("paper_id").distinct()
