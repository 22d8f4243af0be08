"""Words of Arrow text batches, their 64-bit hashes and hashes of word runs, in numpy.

A batch is cut into slices of a megabyte, so what a task holds does not follow the batch size.
One text is never split: its words take about 24 bytes each while it is handled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

U64 = np.uint64
SLICE_BYTES = 1 << 20
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finish)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values of a seed."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


_BYTE = constants(1, 256)
_STEP = int(constants(2, 1)[0]) | 1
_BACK = pow(_STEP, -1, 1 << 64)
_RUN = constants(3, 64) | U64(1)
_LENGTH = constants(4, 1)[0] | U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_forward, _backward = _powers(_STEP, _BLOCK + 1), _powers(_BACK, _BLOCK + 1)

#: Words `[^\x20\x09-\x0D]+`, and words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text, by byte.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n+1 offsets of them; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the texts of a column pass a number of bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of some texts: byte places in ``data``, and the words ``lo[d] : lo[d + 1]`` of text d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out, at, n = np.empty(len(self.start), dtype=U64), 0, len(self.start)
        while at < n:
            first = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, first + _BLOCK, "right")))
            size = int(self.end[to - 1] - first)
            ahead, back = (_forward, _backward) if size <= _BLOCK else (_powers(_STEP, size + 1), _powers(_BACK, size + 1))
            sums = np.zeros(size + 1, dtype=U64)
            np.cumsum(_BYTE[self.data[first : first + size]] * ahead[:size], out=sums[1:])
            s, e = self.start[at:to] - first, self.end[at:to] - first
            out[at:to] = (sums[e] - sums[s]) * back[s] + (e - s).astype(U64) * _LENGTH
            at = to
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.lo)

    def runs_of(self, n: int) -> np.ndarray:
        """How many runs of n consecutive words each text has."""
        return np.maximum(self.counts() - (n - 1), 0)


def split_words(column: pa.Array, is_word: np.ndarray, lower: bool = False) -> Words:
    """The maximal runs of bytes of a class."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = is_word[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets] = False
    start = np.flatnonzero(inside[:-1] & ~before[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(inside[:-1] & ~after[:-1]) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each word on; the runs that pass a text's end are the caller's to skip."""
    if len(words) < n:
        return np.empty(0, dtype=U64)
    size = len(words) - n + 1
    out = words[:size] * _RUN[0]
    for k in range(1, n):
        out += words[k : k + size] * _RUN[k]
    return mix(out)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_text(docs: DataFrame, make, fields: T.StructType, keep: list[str], text: str = "text") -> DataFrame:
    """Columns computed from a text column in Arrow slices, beside the columns in ``keep``.

    ``make()`` runs once in each task and returns a function from a string array to one array per
    field. Other columns of the table are not read. A field takes the place of a kept column of its name.
    """
    fresh = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in fresh]
    names = [f.name for f in fields]
    schema = T.StructType([docs.schema[c] for c in keep] + list(fields))
    inner = text if text in keep else free_name(docs, "text_")
    read = docs.select(*[docs[c] for c in keep], *([] if text in keep else [docs[text].alias(inner)]))

    def run(batches):
        work = make()
        for part in slices(batches, inner):
            made = work(part.column(inner))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, *names])

    return read.mapInArrow(run, schema)
