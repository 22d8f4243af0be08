"""Turning text into vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark import schema
from litspark.functions import text, vectors


def _place_counts(df: DataFrame, dim: int, key: str, body: str) -> DataFrame:
    """(key, pos, count): signed word counts; a text without words keeps one row with a null place.

    A word adds +1 or -1 at the place its md5 names. Texts are spread by key once; the counts here
    and all later steps per key work inside those partitions.
    """
    spread = df.select(key, F.col(body).alias("_text")).repartition(F.col(key))
    code = spread.select(key, F.explode_outer(text.words(F.col("_text"))).alias("word")).select(key, F.md5("word").alias("h"))
    place = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    sign = F.lit(1) - 2 * (F.conv(F.substring("h", 9, 1), 16, 10).cast("int") % 2)
    return code.groupBy(key, place.alias("pos")).agg(F.sum(sign).alias("count"))


def hashed_weights(df: DataFrame, dim: int, key: str = "paper_id", body: str = "text") -> DataFrame:
    """(key, pos, weight): unit-length feature-hashed word counts, non-zero places only."""
    length = F.sqrt(F.sum(F.col("count") * F.col("count")).over(Window.partitionBy(key)))
    counted = _place_counts(df, dim, key, body).filter(F.col("count") != 0)
    return counted.select(key, "pos", (F.col("count") / length).alias("weight"))


def hashing_encode(df: DataFrame, dim: int = schema.DEFAULT_DIM, key: str = "paper_id", body: str = "text") -> DataFrame:
    """(key, embedding array<float>): the stand-in encoder, word overlap rather than meaning.

    Texts without any word give the zero vector.
    """
    entry = F.when(F.col("count") != 0, F.struct("pos", "count"))
    places = _place_counts(df, dim, key, body).groupBy(key).agg(
        F.map_from_entries(F.collect_list(entry)).alias("at"),
        F.sqrt(F.sum(F.col("count") * F.col("count"))).alias("length"),
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.col("at")[i] / F.col("length"), F.lit(0.0)).cast("float"),
    )
    return places.select(key, dense.alias("embedding"))


def model_encode(
    df: DataFrame, make_predict: Callable, key: str = "paper_id", body: str = "text", batch_size: int = schema.ENCODE_BATCH
) -> DataFrame:
    """(key, embedding): encode with any model, normalised. A map stage, no shuffle.

    ``make_predict`` loads the model once per Python worker and returns a function from an array of
    texts to a matrix.
    """
    encode = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    raw = df.select(key, encode(F.col(body)).alias("embedding"))
    return raw.withColumn("embedding", vectors.l2_normalise(F.col("embedding")).cast("array<float>"))


def with_text(papers: DataFrame) -> DataFrame:
    return papers.withColumn("text", text.embedding_text(F.col("title"), F.col("abstract")))


def encode_queries(queries: DataFrame, dim: int, encoder: Callable | None = None) -> list[tuple]:
    """(query_id, vector) of a small request table, encoded like the papers.

    The requests come back to the driver because they are arguments of the searches that follow.
    """
    encoder = encoder or (lambda df, key, body: hashing_encode(df, dim, key, body))
    return [(r[0], list(r[1])) for r in encoder(queries, "query_id", "query").collect()]
