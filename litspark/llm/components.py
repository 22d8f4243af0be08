"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.sources.staging import discard, stage

#: Rows of two 64-bit columns that may be broadcast: some 50 MB in a hash table.
SMALL_ROWS = 500_000
#: Files of a table of at most so many rows.
SMALL_FILES = 8
#: Pointers followed in a round.
HOPS = 3


def small(df: DataFrame, rows: int | None = None, limit: int = SMALL_ROWS) -> DataFrame:
    """A stored table, marked for broadcast where its counted rows allow it; beyond, Spark shuffles."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def _narrow(df: DataFrame) -> DataFrame:
    """Edges (a, b), each once, the larger node first."""
    return df.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Nodes of edges (a, b) with ``label``, the smallest node that each reaches.

    Each round points every node at its smallest neighbour, follows the pointers ``HOPS`` times and
    contracts the edges; what is left shrinks by half or more a round. n edges have at most 2 * n nodes,
    which says without another count whether the pointers may be broadcast. All tables stay distributed
    and each round is written to the shared folder, so lineage does not grow; what a round no longer
    needs is deleted. Rounds over few edges write few files.
    """
    left = stage(_narrow(edges))
    labels = None
    while n := left.count():

        def put(df: DataFrame, few: bool = 2 * n <= SMALL_ROWS) -> DataFrame:
            return stage(df.coalesce(SMALL_FILES) if few else df)

        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = put(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        over = small(first.where(F.col("node") != F.col("up")).select(F.col("node").alias("up"), F.col("up").alias("top")), 2 * n)
        up = first
        for _ in range(HOPS):
            up = up.join(over, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        up = put(up)
        moved, before = small(up, 2 * n), [left, first]
        if labels is None:
            labels = up.select("node", F.col("up").alias("label"))
        else:
            before += [labels, up]
            to = moved.select(F.col("node").alias("label"), "up")
            labels = stage(labels.join(to, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        for side in ("a", "b"):
            to = moved.select(F.col("node").alias(side), "up")
            left = left.join(to, side).drop(side).withColumnRenamed("up", side)
        left = put(_narrow(left))
        discard(*before)
    discard(left)
    if labels is None:
        return edges.sparkSession.createDataFrame([], edges.select("a", "b").schema).toDF("node", "label")
    return labels
