"""Spelling variants by permuterm rotations.

A word is ended by a mark and rotated: ``y$x`` for every cut of the word into x and y. Without its last character the
rotation ``y$xc`` of the word x c y is ``y$x``, the range of all rotations that begin so. Such a range holds, besides
the rotation ``y$x`` of the word x y itself, every word with one character in that place: all words that come of one
another by replacing, inserting or deleting it, and nothing else. A range so has at most one word per letter and one
without, whatever the corpus. Sorting the rotations brings ranges together; a scan of the sorted ranges gives each member
the number of its neighbours there and the best of them, without writing out pairs.

A replaced character has one place, so two words meet in one range. A deleted character may be any of a run of equal ones;
only the first of the run counts, so such words meet once too.

Words are numbered in the order of their frequency, so that a neighbour's rank is all that travels and the best is the least.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.components import small
from litspark.llm.token_ids import distinct
from litspark.llm.words import _LOWER, constants, free_name, mix, slices, text_bytes
from litspark.sources.staging import discard, stage

MIN_LENGTH, MIN_COUNT = 5, 3
#: One run in so many loses a character.
DAMAGE = 97
#: Distinct words that a task counts, or bytes of letters that it reads, before it writes the counts out.
HELD, HELD_BYTES = 300_000, 128 << 20
#: Characters of a range's key that stands as text; a longer one is named by 128 bits.
PLAIN_KEY = 64
MARK = "$"

#: The bytes of A-Z and a-z; of U+00C0 to U+00FF, the first byte is _WIDE.
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_WIDE = 0xC3


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts without what lies between, the offsets of runs in them, and the runs before each text."""
    data, offsets = text_bytes(column)
    letter = _ASCII[data] | (data == _WIDE)
    letter[1:] |= data[:-1] == _WIDE
    before = np.append(False, letter[:-1]) if len(data) else letter
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(letter & ~before)
    place = np.append(0, np.cumsum(letter))
    return _LOWER[data[letter]], place[np.append(start, len(data))], np.searchsorted(start, offsets)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = DAMAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of the letters A-Z, a-z and U+00C0 to U+00FF of whole texts, with A-Z lower-cased.

    Where ``damage`` divides the crc32 of ``<id>:<run>``, a run loses the character in the place crc32 % length; a null
    id reads as empty there. None leaves all runs as they are.
    """
    inner = free_name(docs.select(id_col), "text_")
    read = docs.select(F.col(id_col).cast("string").alias(id_col), F.col(text_col).alias(inner))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        crc, read_bytes = zlib.crc32, 0
        for part in slices(batches, inner):
            data, offsets, lo = _runs(part.column(inner))
            words, codes = distinct(data, offsets)
            seen = np.bincount(codes, minlength=len(words))
            if damage:
                raw, codes_, lo_ = [w.encode() for w in words], codes.tolist(), lo.tolist()
                for doc, s, e in zip(part.column(id_col).to_pylist(), lo_[:-1], lo_[1:], strict=True):
                    head = crc(f"{'' if doc is None else doc}:".encode())
                    for code in codes_[s:e]:
                        h = crc(raw[code], head)
                        if h % damage == 0:
                            word = words[code]
                            k = h % len(word)
                            seen[code] -= 1
                            if len(word) > min_length:
                                held[word[:k] + word[k + 1 :]] += 1
            for word, n in zip(words, seen.tolist(), strict=True):
                if n and len(word) >= min_length:
                    held[word] += n
            read_bytes += len(data)
            if len(held) > HELD or read_bytes > HELD_BYTES:
                yield out(held)
                held, read_bytes = Counter(), 0
        if held:
            yield out(held)

    return read.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


_BASES = constants(7, 2) | np.uint64(1)


def _long_keys(word: str) -> tuple[list[bytes], list[bytes]]:
    """128 bits of every ``y$x`` with and without the character between, in a time linear in the word."""
    cp = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    mark, n, sides = mix(np.array([ord(MARK)], np.uint64))[0], len(cp), []
    for base in _BASES:
        power = np.full(n + 2, base, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        head, size = np.zeros(n + 1, np.uint64), np.arange(n + 1)  # head: the hash of the first characters
        for k, v in enumerate(mix(cp).tolist()):
            head[k + 1] = (int(head[k]) * int(base) + v) & 0xFFFFFFFFFFFFFFFF
        tail = head[n] - head * power[n - size]  # the hash of the characters from a place on
        sides.append((tail * power[size + 1] + mark * power[size] + head, tail[1:] * power[size[1:]] + mark * power[size[:-1]] + head[:-1]))
    whole, cut = (np.stack([mix(sides[0][k]), mix(sides[1][k])], axis=1).astype("<u8") for k in (0, 1))
    return [b"\0" + x.tobytes() for x in whole], [b"\0" + x.tobytes() for x in cut]


def rotation_ranges(word: str) -> tuple[list[bytes], list[bytes]]:
    """The ranges that a word belongs to: by its own rotations, and by those without each of its characters."""
    n = len(word)
    if n > PLAIN_KEY:
        return _long_keys(word)
    cut = [(word[k + 1 :] + MARK + word[:k]).encode() for k in range(n)]
    if n == PLAIN_KEY:
        return _long_keys(word)[0], cut
    return [(word[k:] + MARK + word[:k]).encode() for k in range(n + 1)], cut


def _rotations(words: DataFrame) -> DataFrame:
    """key, rank, kind of every range of every word; kind 0: its own rotation, 1: without the first of a run of equal
    characters, 2: without another one.
    """
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("rank", T.LongType()), T.StructField("kind", T.ByteType())])

    def rows(key: list, rank: list, kind: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(rank, pa.int64()), pa.array(kind, pa.int8())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rank, kind = [], [], []
            for word, r in zip(batch.column("word").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                whole, cut = rotation_ranges(word)
                key += whole + cut
                rank += [r] * (len(whole) + len(cut))
                kind += [0] * len(whole) + [1] + [1 + (a == b) for a, b in zip(word, word[1:], strict=False)]
                if len(key) > 50_000:
                    yield rows(key, rank, kind)
                    key, rank, kind = [], [], []
            if key:
                yield rows(key, rank, kind)

    return words.select("word", "rank").mapInArrow(run, schema)


def _scanned(rotations: DataFrame) -> DataFrame:
    """rank, n_near, best: how many neighbours a word has in a range, and the least rank among them."""
    key = Window.partitionBy("key")
    first = key.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rotations.withColumns(
        {
            "size": F.count(F.lit(1)).over(first),
            "without": F.max(F.when(F.col("kind") == 0, F.col("rank"))).over(first),
            "repeats": F.max(F.when(F.col("kind") == 2, F.col("rank"))).over(first),
            **{f"r{k}": F.nth_value("rank", k).over(first) for k in (1, 2, 3)},
        }
    ).where(F.col("size") > 1)
    #: The word without the character and the one that repeats the character before count in another range.
    apart = F.when(F.col("kind") == 0, F.col("repeats")).when(F.col("kind") == 2, F.col("without"))
    rows = rows.withColumn("apart", F.coalesce(apart, F.lit(-1)))
    fits = [F.when((F.col(r) != F.col("rank")) & (F.col(r) != F.col("apart")), F.col(r)) for r in ("r1", "r2", "r3")]
    near = F.col("size") - 1 - (F.col("apart") >= 0).cast("long")
    return rows.select("rank", near.alias("n_near"), F.coalesce(*fits).alias("best")).where(F.col("n_near") > 0)


def _roots(forms: DataFrame) -> DataFrame:
    """rank, root: where the forms of a stored table (rank, up) lead. Each round doubles the steps taken."""
    up = forms
    while True:
        ahead = up.select(F.col("rank").alias("up"), F.col("up").alias("next"))
        step = stage(up.join(small(ahead), "up", "left").select("rank", "up", "next"))
        going = step.where(F.col("next").isNotNull()).head(1)
        before, up = up, step.select("rank", F.coalesce("next", "up").alias("up"))
        discard(before)
        if not going:
            return up.withColumnRenamed("up", "root")


def spelling_variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of words with their counts.

    Near words differ by one inserted, deleted or replaced character. A word's form is its near word of largest n (ties:
    the smallest in code-point order) where that n is at least twice its own, else null; its root is where forms lead.
    Words must be distinct and not null. An empty table gives an empty result.
    """
    ranked = words.select("word", "n").orderBy(F.col("n").desc(), "word").withColumn("rank", F.monotonically_increasing_id())
    ranked = stage(ranked)
    near = _scanned(_rotations(ranked)).groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    best = ranked.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = ranked.join(near.join(best, "best"), "rank", "left")  # words without neighbours have no key to meet under
    is_form = F.col("form_n") >= 2 * F.col("n")
    forms = [F.when(is_form, F.col(c)).alias(c) for c in ("form", "form_n")]
    found = stage(found.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *forms, F.when(is_form, F.col("best")).alias("up")))
    roots = _roots(stage(found.where(F.col("up").isNotNull()).select("rank", "up")))
    names = ranked.select(F.col("rank").alias("root"), F.col("word").alias("name"))
    roots = roots.join(names, "root").select("rank", F.col("name").alias("root"))
    return found.join(roots, "rank", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def corpus_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spelling_variants`` of the words of whole texts. Null texts have none; other columns are not read."""
    counts = stage(word_counts(docs, id_col=id_col, text_col=text_col))
    return spelling_variants(counts)
