"""Substring dedup by content-defined chunks with a gear rolling hash.

The gear hash of a text (word bytes, A-Z lower-cased, blanks skipped) shifts by one bit a byte, so its
32 bits tell the last 32 bytes; where the last ``REACH`` words are shorter, only their bits are taken. A word end is a chunk border where its hash is the least of some
``SPREAD`` consecutive word ends; borders then depend on nearby bytes only, are at most ``SPREAD`` words
apart and return after an insertion. From each border a chunk reaches to the first border at least
``LEAST`` words on. Of a shared passage all word ends from the eighth on have equal hashes, so a border is
found by the 15th, a chunk's end at most 27 words later, and 7 more words make it the same in both documents:
two documents that share more than 50 words share whole chunks, however short the words. Chunks meet
by their 64-bit digest; the smallest document that holds a chunk keeps it, others lose its words.
A chunk of very many places is not dealt to one task: see ``HOT_PLACES``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.components import small
from litspark.llm.contamination import slide
from litspark.llm.words import _BACK, _LENGTH, _STEP, NOT_BLANK, U64, _powers, constants, free_name, map_text, mix, slices, split_words
from litspark.sources.staging import stage

SPREAD = 8
LEAST = 20
REACH = 8
#: A chunk with more places than this, and more than one place in HOT_SHARE, is hot: its owner is broadcast and its places stay
#: where they are. There are fewer than HOT_SHARE hot chunks at any size of the input.
HOT_PLACES = 1_000
HOT_SHARE = 100_000
_GEAR = (constants(21, 256) >> U64(32)).astype(np.uint32)
_NEVER = np.uint32(0xFFFFFFFF)
_NO_ID = (1 << 63) - 1

CHUNKS = T.StructType([
    T.StructField("whole", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("firsts", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
])
_SPAN = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def gear(words) -> np.ndarray:
    """The gear hash at each word's end; words that end within a text's first 32 bytes and REACH words are no border."""
    size = words.end - words.start
    sums = _GEAR[words.data[NOT_BLANK[words.data]]]
    for k in range(5):
        shifted = sums.copy()
        shifted[1 << k :] += sums[: -(1 << k)] << np.uint32(1 << k)
        sums = shifted
    ends = np.cumsum(size)
    first = np.repeat(words.lo[:-1], words.counts())
    from_word = np.maximum(np.arange(len(ends)) - (REACH - 1), first)
    reach = np.minimum(ends - np.concatenate([[0], ends])[from_word], 32)
    out = sums[ends - 1] << (32 - reach).astype(np.uint32) if len(ends) else np.empty(0, np.uint32)
    out[(reach < 32) & (np.arange(len(ends)) - first < REACH - 1)] = _NEVER
    return out


def borders(words) -> np.ndarray:
    """Word places that start a chunk: each text's first and those after a border."""
    counts = words.counts()
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(text)) + (text + 1) * (SPREAD - 1)
    wide = np.full(len(text) + (len(counts) + 1) * (SPREAD - 1), _NEVER, dtype=np.uint32)
    wide[place] = gear(words)
    least = slide(wide, SPREAD, np.minimum)
    edge = np.zeros(SPREAD - 1, np.uint32)
    chosen = (slide(np.concatenate([edge, np.where(least == _NEVER, 0, least), edge]), SPREAD, np.maximum) == wide) & (wide != _NEVER)
    return np.union1d(words.lo[:-1][counts > 0], np.flatnonzero(chosen[place]) + 1)


def _digests(words):
    """A function that gives the digests of the words s to e, e not included."""
    hashes = words.hashes()
    n = len(hashes)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(hashes * _powers(_STEP, n + 1)[:n], out=sums[1:])
    back = _powers(_BACK, n + 1)
    return lambda s, e: mix((sums[e] - sums[s]) * back[s] + (e - s).astype(U64) * _LENGTH).view(np.int64)


def _chunks():
    def work(column):
        words = split_words(column, NOT_BLANK, lower=True)
        lo, digest = words.lo, _digests(words)
        all_borders = np.union1d(borders(words), lo)
        starts = all_borders[:-1]
        at = np.searchsorted(all_borders, starts + LEAST)
        ends = all_borders[np.minimum(at, len(all_borders) - 1)]
        text = np.searchsorted(lo, starts, "right") - 1
        good = (at < len(all_borders)) & (ends <= lo[np.minimum(text + 1, len(lo) - 1)])
        starts, ends, text = starts[good], ends[good], text[good]
        offsets = pa.array(np.searchsorted(text, np.arange(len(lo))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (digest(starts, ends), (starts - lo[text]).astype(np.int32), (ends - starts).astype(np.int32))]
        return pa.array(digest(lo[:-1], lo[1:])), pa.array(words.counts(), pa.int64()), *lists

    return work


def _merge(batches):
    """Sorted spans of each row's chunk places, joined where they touch."""
    for batch in batches:
        out = []
        for places in batch.column("places").to_pylist():
            spans: list = []
            for first, size in sorted((p["first"], p["size"]) for p in places):
                if spans and first <= spans[-1]["last"] + 1:
                    spans[-1]["last"] = max(spans[-1]["last"], first + size - 1)
                else:
                    spans.append({"first": first, "last": first + size - 1})
            out.append(spans)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        rest = [c for c in batch.schema.names if c != "places"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, kind)], names=[*rest, "spans"])


def _spans(found: DataFrame) -> DataFrame:
    grouped = found.groupBy("id", "whole").agg(F.min("n_words").alias("n_words"), F.min("owner").alias("owner"), F.collect_list(F.struct("first", "size")).alias("places"))
    return grouped.mapInArrow(_merge, T.StructType([f for f in grouped.schema if f.name != "places"] + [T.StructField("spans", _SPAN)]))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_text: bool = False) -> DataFrame:
    """Chunks that two documents hold, one row per place: id, whole (digest of the text's words), n_words, first, size, owner.

    ``owner`` is the smallest id that holds the chunk, ``id`` is the largest value where it is null. With ``by_text``
    whole is Spark's xxhash64 of the text instead, which tells texts of equal words apart.
    """
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text"))
    if by_text:
        made = map_text(d.withColumn("hash", F.xxhash64("text")), _chunks, CHUNKS, ["id", "hash"])
        made = made.drop("whole").withColumnRenamed("hash", "whole")
    else:
        made = map_text(d, _chunks, CHUNKS, ["id"])
    rows = stage(made.where(F.size("keys") > 0))
    keys = rows.select("id", F.explode("keys").alias("key"))
    counted = keys.groupBy("key").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = stage(counted.where("owner != last").select("key", "owner", "n"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > max(HOT_PLACES, total // HOT_SHARE)
    hot, others = F.broadcast(shared.where(is_hot).select("key", "owner")), shared.where(~is_hot).select("key", "owner")
    places = rows.select("id", "whole", "n_words", F.explode(F.arrays_zip("keys", "firsts", "sizes")).alias("c"))
    places = places.select("id", "whole", "n_words", F.col("c.keys").alias("key"), F.col("c.firsts").alias("first"), F.col("c.sizes").alias("size"))
    cold = places.join(hot.select("key"), "key", "left_anti").join(others.hint("shuffle_hash"), "key")
    return places.join(hot, "key").unionByName(cold).drop("key")


def substring_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that shares a chunk with another one.

    id, n_words, n_repeat_words (words in shared chunks), n_removed_words (those of them that a smaller
    document holds), first_doc_id (the smallest document that holds one of the chunks) and spans (all shared
    words). Null, blank and short texts have no chunks. Rows that repeat an id are one document: they
    share nothing with each other, each text has a row. Rows without id come after all others, and also
    share nothing among themselves. Repeats within one document don't count. Other columns are not read.
    """
    found = stage(repeated_chunks(docs, id_col, text_col).distinct())
    lost = _spans(found.where("owner < id")).select("id", "whole", _length("spans").alias("n_removed_words"))
    out = _spans(found).join(lost, ["id", "whole"], "left")
    return out.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_col), "n_words", _length("spans").alias("n_repeat_words"),
        F.coalesce("n_removed_words", F.lit(0).cast("long")).alias("n_removed_words"), F.col("owner").alias("first_doc_id"), "spans",
    )


def _length(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def _cut(columns: list[str], text: str, hits: str):
    """Removes the words of the spans; the blanks after them go too."""

    def cut(value: str, found: list) -> str:
        words = split_words(pa.array([value]), NOT_BLANK, lower=True)
        raw, out, at = value.encode(), [], 0
        for span in found:
            out.append(raw[at : words.start[span["first"]]])
            after = span["last"] + 1
            at = words.start[after] if after < len(words.start) else len(raw)
        return b"".join([*out, raw[at:]]).decode()

    def run(batches):
        for part in slices(batches, text):
            texts, found = part.column(text), part.column(hits)
            if found.null_count < len(found):
                made = [t if h is None or t is None else cut(t, h) for t, h in zip(texts.to_pylist(), found.to_pylist(), strict=True)]
                texts = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == text else part.column(c) for c in columns], names=columns)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the chunks that a smaller document holds; all rows and columns stay."""
    found = repeated_chunks(docs, id_col, text_col, by_text=True).where(F.col("owner") < F.col("id")).distinct()
    spans = stage(_spans(found).select("id", "whole", "spans"))
    hits, key, whole = (free_name(docs, name) for name in ("hits_", "id_", "whole_"))
    spans = spans.toDF(key, whole, hits)
    total = spans.agg(F.sum(F.size(hits))).first()[0] or 0
    # Spans meet the rows of their text, so rows that share an id, or have none, don't meet in one group. Texts go by a hash
    # of Spark's: a digest by Python here would be a second worker in each task, beside that which cuts.
    rows = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))).withColumn(whole, F.xxhash64(text_col))
    joined = rows.join(small(spans, total), [key, whole], "left").drop(key, whole)
    return joined.mapInArrow(_cut(docs.columns, text_col, hits), docs.schema)
