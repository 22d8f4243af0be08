"""Ranks over a whole table, without ever sorting the whole table in one task.

Rows are counted per *block*, a run of neighbouring order values that holds a bounded number of rows.
Running totals over the (few) blocks say which block holds a wanted rank, and only the rows of that
block are numbered. Tables are read narrow (keys and order value) in these passes and never shuffled
as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.functions.text import hash_number, seeded_hash

BLOCK_BITS = 20  # a block of unique whole numbers holds at most 2^20 rows
HASH_DIGITS = 5  # 16^5 hash blocks
BROADCAST_ROWS = 1_000_000  # narrow tables known to hold at most this many rows are broadcast
PRUNED_K = 1000  # Spark cuts rank filters on the map side up to this rank


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row bound is known and small; leave the join to Spark beyond."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ord_block(df: DataFrame, order: str = "ord") -> Column:
    """Block of a row-order column.

    Unique whole numbers are cut into runs of 2^20, so no block can grow past that. The struct order
    of a file scan is cut at the splits of the scan, which the reader bounds in bytes.
    """
    kind = df.schema[order].dataType
    if isinstance(kind, T.StructType):
        return F.struct(*[F.col(f"{order}.{n}").alias(n) for n in kind.fieldNames()[:-1]])
    return F.shiftright(F.col(order), BLOCK_BITS)


def count_blocks(df: DataFrame, block: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by…, block, n, before, total): rows per block, rows in earlier blocks, rows of the key."""
    counts = df.groupBy(*by, block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy(*by).orderBy("block")
    whole = Window.partitionBy(*by)
    return counts.select(
        *by, "block", "n",
        (F.sum("n").over(ordered) - F.col("n")).alias("before"),
        F.sum("n").over(whole).alias("total"),
    )


def locate(blocks: DataFrame, targets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add to targets (by…, tag, pos; pos counts from 0) the block and the place inside it.

    Block starts and targets are merged in one running pass per key, so no pairs are formed. Its size
    is the number of blocks plus the number of targets.
    """
    starts = blocks.select(
        *by, F.col("before").alias("pos"), F.lit(0).alias("is_target"), F.lit(None).cast("bigint").alias("tag"),
        F.struct("block", "before", "n").alias("at"),
    )
    wanted = targets.select(
        *by, "pos", F.lit(1).alias("is_target"), F.col("tag").cast("bigint").alias("tag"),
        F.lit(None).cast(starts.schema["at"].dataType).alias("at"),
    )
    run = Window.partitionBy(*by).orderBy("pos", "is_target").rowsBetween(Window.unboundedPreceding, 0)
    return (
        starts.unionByName(wanted)
        .withColumn("at", F.last("at", ignorenulls=True).over(run))
        .filter((F.col("is_target") == 1) & (F.col("pos") >= 0) & (F.col("pos") < F.col("at.before") + F.col("at.n")))
        .select(*by, "tag", F.col("at.block").alias("block"), (F.col("pos") - F.col("at.before")).alias("place"))
    )


def values_at(
    df: DataFrame, targets: DataFrame, block: Column, order: Column, by: Sequence[str] = (),
    blocks: DataFrame | None = None, n_targets: int = 1,
) -> DataFrame:
    """(by…, tag, value): the order value at each wanted position.

    ``n_targets`` is the caller's bound on the number of targets. Few targets are broadcast, so only
    the rows of their blocks leave the scan.
    """
    blocks = count_blocks(df, block, by) if blocks is None else blocks
    located = locate(blocks, targets, by)
    narrow = df.select(*by, block.alias("block"), order.alias("value"))
    needed = narrow.join(small(located.select(*by, "block").distinct(), n_targets), [*by, "block"], "left_semi")
    inside = Window.partitionBy(*by, "block").orderBy("value")
    return (
        needed.withColumn("place", F.row_number().over(inside) - 1)
        .withColumn("place", F.col("place").cast("bigint"))
        .join(small(located, n_targets), [*by, "block", "place"])
        .select(*by, "tag", "value")
    )


def number_within(df: DataFrame, by: Sequence[str], block: Column, order: Column, name: str) -> DataFrame:
    """Number the rows of each key from 1 in order, however many rows one key holds.

    Rows are numbered inside (key, block) and shifted by the rows of earlier blocks, so a key with a
    third of the table is spread over its blocks.
    """
    blocked = df.withColumn("block", block)
    before = count_blocks(blocked, F.col("block"), by).select(*by, "block", "before")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "block"]]
    inside = Window.partitionBy(*by, "block").orderBy(order)
    return (
        blocked.withColumn("place", F.row_number().over(inside)).alias("l")
        .join(before.alias("r"), same)
        .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("place") + F.col("before")).alias(name))
    )


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = (), fan: int = 64) -> DataFrame:
    """First k rows in order, per key if keys are given.

    Two steps: each of ``fan`` groups of map tasks keeps its k best rows, then k are chosen from
    those. The last task sees at most ``fan * k`` rows, not k rows of every map task. The ranking
    filter also runs before the first shuffle, so a hot key leaves each map task as k rows. Spark
    does that up to rank 1000. Beyond, and without keys, an ordered limit keeps a heap of k rows per task;
    with keys the rows of a key are cut by ``fan`` tasks after the first shuffle.
    """
    if k > PRUNED_K and not by:
        return df.orderBy(*order).limit(k)
    part = Window.partitionBy(*by, "_fan").orderBy(*order)
    best = (
        df.withColumn("_fan", F.pmod(F.spark_partition_id(), F.lit(fan)))
        .withColumn("_rn", F.row_number().over(part))
        .filter(F.col("_rn") <= k)
        .drop("_fan", "_rn")
    )
    if not by:
        return best.orderBy(*order).limit(k)
    whole = Window.partitionBy(*by).orderBy(*order)
    return best.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= k).drop("_rn")


def first_k(df: DataFrame, k: int, order: Column, block: Column) -> DataFrame:
    """Exactly min(k, n) rows: those with the smallest order values, which must be unique.

    ``block`` groups neighbouring order values. The k-th value is found from counts per block, then
    one filter keeps the rows. They stay where they are, nothing is gathered or shuffled.
    """
    if k <= 0:
        return df.limit(0)
    blocks = count_blocks(df, block)
    target = blocks.agg((F.least(F.lit(k), F.sum("n")) - 1).alias("pos")).select("pos", F.lit(0).alias("tag"))
    last = values_at(df, target, block, order, blocks=blocks).select(F.max("value").alias("value")).scalar()
    return df.filter(order <= last)


def _hash_order(key: Sequence[str], seed: int) -> tuple[Column, Column]:
    code = seeded_hash(seed, *[F.col(c) for c in key])
    return hash_number(code, HASH_DIGITS), F.struct(code.alias("h"), *[F.col(c) for c in key])


def sample_k(df: DataFrame, k: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Exactly min(k, n) rows: those whose seeded hash of the key, which must be unique, comes first.

    A small sample takes one scan: each task keeps its k smallest hashes, the k smallest of those are the sample. A larger one
    is cut by counts per hash range, so that no task gathers k rows of every other.
    """
    block, order = _hash_order(key, seed)
    if 0 < k <= PRUNED_K:
        return top_k(df.withColumn("_hash", order), k, [F.col("_hash")]).drop("_hash")
    return first_k(df, k, order, block)


def draw_position(seed: int, what: str, draw: Column, n: Column) -> Column:
    """Uniform position in 0..n-1 for a draw number."""
    return F.pmod(hash_number(seeded_hash(seed, F.lit(what), draw)), n)


def rows_at(
    df: DataFrame, positions: DataFrame, seed: int, key: Sequence[str], blocks: DataFrame, n_positions: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by…, tag, key…): the keys standing at the given positions of the seeded hash order."""
    block, order = _hash_order(key, seed)
    found = values_at(df, positions, block, order, by, blocks, n_positions)
    return found.select(*by, "tag", *[F.col(f"value.{c}").alias(c) for c in key])


def hash_blocks(df: DataFrame, seed: int, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts per hash block, to be shared by several lookups."""
    block, _ = _hash_order(key, seed)
    return count_blocks(df, block, by)
