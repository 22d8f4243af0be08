"""Words of whole Arrow batches, for the few steps that count inside a task.

A batch is cut into slices of a megabyte, so what a task holds does not follow the batch size. The character class of a
word is asked of the session once, so words are cut here as ``functions.text.words`` cuts them in an expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from litspark import schema

SLICE_BYTES = 1 << 20
_classes: dict[str, np.ndarray] = {}


def word_characters(spark: SparkSession) -> np.ndarray:
    """By code point, whether a character belongs to words; asked once of each application."""
    app = spark.sparkContext.applicationId
    if app not in _classes:
        character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        every = spark.range(0x110000).filter((F.col("id") < 0xD800) | (F.col("id") >= 0xE000))
        of_words = every.filter(character.rlike(f"^{schema.WORD_CHARACTER}$")).toArrow().column(0).to_numpy()
        table = np.zeros(0x110000, bool)
        table[of_words] = True
        _classes[app] = np.packbits(table)
    return _classes[app]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the texts of a column pass a number of bytes; a text is never split."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Returns to the system what Arrow and numpy use no longer; Python workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # the C heap, where numpy's arrays are


class WordCutter:
    """Cuts lower-cased texts into their words of two or more characters."""

    def __init__(self, characters: np.ndarray):
        self.inside = np.unpackbits(characters).astype(bool)

    def __call__(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, the number of each word in the order of the texts, and the text of each."""
        texts = column.fill_null("").to_pylist()
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        inside = self.inside[cp]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.append(0, edge) if inside[0] else edge  # the last character is a line break, so runs end
        start, end = edge[0::2], edge[1::2]
        long = end - start >= 2
        start, end = start[long], end[long]
        if not len(start):
            return pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
        mark = np.zeros(len(cp) + 1, np.int8)
        mark[start], mark[end] = 1, -1
        keep = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
        data = joined.encode()
        if len(data) == len(cp):
            place, raw = np.append(0, np.cumsum(end - start)), np.frombuffer(data, np.uint8)[keep]
        else:
            width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
            at = np.append(0, np.cumsum(width, dtype=np.int64))
            place, raw = np.append(0, np.cumsum(at[end] - at[start])), np.frombuffer(data, np.uint8)[np.repeat(keep, width)]
        kind, offsets = (pa.string(), np.int32) if len(raw) < 1 << 31 else (pa.large_string(), np.int64)
        words = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(place.astype(offsets)), pa.py_buffer(raw)]).dictionary_encode()
        text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return words.dictionary.cast(pa.string()), words.indices.to_numpy().astype(np.int64), np.searchsorted(text_end, start, "right")
