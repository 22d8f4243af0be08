"""Best-fit packing of tokenised documents into sequences, planned over a histogram of lengths.

Documents are tokenised where they lie and cut into pieces of at most ``capacity`` tokens; only a row of a few
numbers per piece travels. The driver packs *lengths with counts*, the longest first, each into the open sequences
with the least room that still holds it. Sequences of equal history are one entry, so the plan depends on the
histogram, of at most ``capacity`` rows, and not on the number of documents. Each planned entry is a range of ranks
within a length; pieces take their slots by that rank.

Ranks need no global order: a length with many pieces is split into blocks by hash, blocks are counted, and a
piece's rank is its number within its block plus the pieces of earlier blocks. So neither a common length nor a
group of copies meets in one task.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.token_counts import known_characters, load
from litspark.llm.token_ids import Memo, distinct, gather, kept, library_encoder
from litspark.llm.words import free_name, slices
from litspark.sources.staging import stage

CAPACITY = 4096
#: Blocks of pieces that are numbered apart, besides one for each length, and the least rows of one.
BLOCKS, BLOCK_ROWS = 200_000, 128
#: Bits of a rank within a length.
RANK_BITS = 40

SPACE, LETTER, NUMBER, OTHER = range(4)
_CHUNK = regex.compile(r"[^ \t-\r]+")
_PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def _classes(space: str) -> np.ndarray:
    """White space, letter, number or other by code point, as the tokenizer's splitter has them."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{space}]+")):
        for run in regex.finditer(pattern, every):
            out[[ord(c) for c in run[0]]] = kind
    return out


class PreTokens:
    """Cuts texts into the tokenizer's pre-tokens, whole batches at once.

    Characters outside of the ranges in which the cut is known to agree with the library, and the tokenizer's
    special strings, are left to the library, together with what stands beside them up to the next white space.
    """

    def __init__(self, special: list[str]):
        strange, space = known_characters()
        self.strange, self.special = re.compile(strange), special
        self.classes = _classes(space)

    def odd(self, text: str) -> bool:
        return bool(self.strange.search(text)) or any(s in text for s in self.special)

    def _parts(self, texts: list[str]) -> tuple[list[str], list[int], list[str], list[int]]:
        """Plain parts with the text of each, and strange parts with the number of plain parts before each."""
        plain, owner, strange, before = [], [], [], []
        for k, text in enumerate(texts):
            if not self.odd(text):
                plain.append(text)
                owner.append(k)
                continue
            run: list[str] = []
            for chunk in _CHUNK.findall(text):
                if self.odd(chunk):
                    plain.append(" ".join(run))
                    owner.append(k)
                    strange.append(chunk)
                    before.append(len(plain))
                    run = []
                else:
                    run.append(chunk)
            plain.append(" ".join(run))
            owner.append(k)
        return plain, owner, strange, before

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pre-tokens, their numbers in the order of the texts, and how many each text has."""
        plain, owner, strange, before = self._parts(texts)
        plain = [unicodedata.normalize("NFC", x).lower() for x in plain]
        joined = "\n".join(plain)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[cp]
        start = np.zeros(len(cp) + 3, bool)
        if len(cp):
            start[0] = kind[0] != SPACE
            start[1 : len(cp)] = (kind[1:] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER))
            self._contractions(cp, kind, start)
        at = np.flatnonzero(start[: len(cp)])
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        keep = kind != SPACE
        ends = np.cumsum(np.where(keep, width, 0))
        data = np.frombuffer(joined.encode(), np.uint8)[np.repeat(keep, width)]
        values, codes = distinct(data, np.append(ends[at] - width[at], len(data)))
        edges = np.cumsum([len(x) + 1 for x in plain])
        tokens_to = np.searchsorted(at, edges)
        owner = np.array(owner, np.int64)
        counts = np.bincount(owner, np.diff(tokens_to, prepend=0), len(texts)).astype(np.int64)
        if strange:
            own = {v: len(values) + k for k, v in enumerate(dict.fromkeys(strange))}
            before = np.array(before)
            codes = np.insert(codes, tokens_to[before - 1], [own[s] for s in strange])
            counts += np.bincount(owner[before - 1], minlength=len(texts))
            values += own
        return values, codes, counts

    @staticmethod
    def _contractions(cp: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        """A lone apostrophe takes the letters s, t, m, d, re, ve or ll that follow."""
        letter = np.zeros(len(cp) + 3, bool)
        letter[: len(cp)] = kind == LETTER
        chars = np.zeros(len(cp) + 3, np.uint32)
        chars[: len(cp)] = cp
        at = np.flatnonzero((chars == ord("'")) & start)
        at = at[letter[at + 1]]
        one = at[np.isin(chars[at + 1], [ord(c) for c in "stmd"])]
        pair = (chars[at + 1].astype(np.int64) << 21) | chars[at + 2]
        two = at[letter[at + 2] & np.isin(pair, [(ord(a) << 21) | ord(b) for a, b in ("re", "ve", "ll")])]
        for where, size in ((one, 1), (two, 2)):
            start[where + 1] = False
            start[where + size + 1] |= letter[where + size + 1]


def _tools(path: str) -> tuple[PreTokens, Memo]:
    tokenizer = load(path)
    return PreTokens([t.content for t in tokenizer.get_added_tokens_decoder().values()]), Memo(library_encoder(tokenizer))


def token_pieces(
    docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, where asked for, the token ``ids``.

    A document's tokens are its ids without added special tokens, then ``end_id``; every ``capacity`` of them are a
    piece and the last may be shorter. Null and empty texts have ``end_id`` alone. Rows count as given, repeated
    and null ids too; other columns are not read. An empty table gives an empty result.
    """
    inner = free_name(docs.select(id_col), "text_")
    read = docs.select(F.col(id_col), F.col(text_col).alias(inner))
    fields = [docs.schema[id_col], *_PIECES] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, memo = kept(("packing", path), lambda: _tools(path))
        for part in slices(batches, inner):
            values, codes, counts = pre.cut(part.column(inner).fill_null("").to_pylist())
            flat, sizes = memo.ids(values)
            flat, taken = gather(flat, np.cumsum(sizes) - sizes, sizes, codes)
            ends = np.append(0, np.cumsum(taken))[np.append(0, np.cumsum(counts))]
            flat = np.insert(flat, ends[1:], end_id).astype("<u4")
            ends += np.arange(len(ends))
            size = np.diff(ends)
            n = (size + capacity - 1) // capacity
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            at = ends[:-1][row] + start
            raw, to = memoryview(flat.tobytes()), (at + length) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((at * 4).tolist(), to.tolist(), strict=True)]
            made = [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if ids:
                made.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(row)), *made], names=[f.name for f in fields])

    return read.mapInArrow(run, T.StructType(fields))


@dataclass
class Plan:
    """Entries by (length, first): ranks from ``first`` on fill ``each`` places per sequence, from ``offset`` on."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def slots(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of pieces, by their length and their rank within it."""
        entry = np.searchsorted((self.length << RANK_BITS) + self.first, (length << RANK_BITS) + rank, "right") - 1
        nth = rank - self.first[entry]
        return self.sequence[entry] + nth // self.each[entry], self.offset[entry] + nth % self.each[entry] * length


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Plan the pieces of a histogram {length: count}, the longest first, each where the least room is left.

    Open sequences are kept as ranges with the same room. A sequence takes as many pieces of one length as it
    holds before the next is looked at: with one taken it has less room than the others, so best fit picks it again.
    """
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    entries: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(room: int, first: int, count: int) -> None:
        if not room or not count:
            return
        if room not in ranges:
            insort(rooms, room)
            ranges[room] = []
        ranges[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, count = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[k]
            else:
                room, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            each = room // length
            full = min(count, left // each)
            if full:
                entries.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:  # the last sequence that this length reaches, not filled by it
                entries.append((length, rank, first + full, each, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, count - full)
    columns = np.array(entries, np.int64).reshape(-1, 5)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    return Plan(*columns.T, sequences)


def best_fit_slots(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of a stored table with ``sequence_id`` and ``offset``, the place where each goes.

    Sequences hold at most ``capacity``; places in one follow each other without gaps from 0 on. Equal rows take
    any of their places; else the result depends on the rows alone. Lengths must lie between 1 and the capacity.
    Columns of the results' names give way to them.
    """
    spark = pieces.sparkSession
    taken = pieces.drop("sequence_id", "offset")
    names = taken.columns
    counted = {r[0]: r[1] for r in taken.groupBy(F.col(length_col).cast("long")).count().collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(best_fit(counted, capacity))
    block_rows = max(block_rows, sum(counted.values()) // BLOCKS)
    block, rank, base, nth = (free_name(taken, f"{x}_") for x in ("block", "rank", "base", "nth"))
    split = [(n, -(-c // block_rows)) for n, c in counted.items()]
    split = spark.createDataFrame(split, T.StructType([T.StructField(length_col, T.LongType()), T.StructField(nth, T.LongType())]))
    cut = taken.join(F.broadcast(split), length_col).withColumn(block, F.pmod(F.xxhash64(*names), nth)).drop(nth)
    keys = [length_col, block]
    counts = cut.groupBy(keys).agg(F.count(F.lit(1)).alias(nth))
    before = Window.partitionBy(length_col).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(counts.select(*keys, F.coalesce(F.sum(nth).over(before), F.lit(0)).cast("long").alias(base)))
    rows = cut.withColumn(nth, F.row_number().over(Window.partitionBy(keys).orderBy(*[c for c in names if c != length_col])) - 1)
    rows = rows.join(F.broadcast(bases), keys)  # one row per block
    rows = rows.select(*names, (F.col(base) + F.col(nth)).alias(rank))
    schema = T.StructType([*taken.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length_col, rank)]
            made = plan.value.slots(*at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, made)], names=schema.names)

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of ``token_pieces`` with its ``sequence_id`` and ``offset``."""
    return best_fit_slots(stage(token_pieces(docs, path, end_id, capacity, id_col, text_col)), capacity)
