"""Alignment of two tokenizers over the same texts, and how often their ids end together.

Both tokenizers' tokens cover the same bytes, so their end offsets are two increasing lists that end alike. Merging
the lists yields every overlap of an A and a B token; where both end, a group closes. The merge is a path through
the grid of both lists, and each diagonal of the grid meets the path once: a binary search on the diagonal finds
where. Diagonals at equal distances therefore cut the merge into pieces of equal work that know nothing of each
other. All pieces of a slice of texts advance together, step by step, whatever the lengths of the texts; groups that
pass from one piece into the next are stitched by the running number of groups closed before.

Texts are tokenised in segments cut before a blank that follows a character which is surely no white space. No
token of either vocabulary can reach over such a cut (checked for the piece vocabulary when it is loaded), and a
task encodes each distinct segment once while it remembers it.

How often two ids end together is counted over all texts. The most frequent pairs, of a bounded number, are
broadcast for the second look at each document; the others, each of which is rare, meet the documents in a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.components import small
from litspark.llm.token_counts import byte_of_letter, load
from litspark.llm.token_ids import Memo, distinct, gather, kept
from litspark.llm.words import free_name, slices, text_bytes
from litspark.sources.staging import stage

#: Steps of a merge piece.
WORK = 64
#: Pairs whose counts are broadcast: 24 bytes each.
HEAVY_PAIRS = 1_000_000
_BLANK = "▁"


@dataclass
class Merge:
    """The overlaps (a, b) of two token lists in the order of their ends, and the group of each.

    ``closes`` marks the overlaps whose tokens end together, the last ones of their groups.
    """

    a: np.ndarray
    b: np.ndarray
    group: np.ndarray
    closes: np.ndarray


def split_points(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of ``a`` are among the first ``d`` of the merge, for each diagonal d; of equal ends, a's come first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        ahead = np.zeros(len(mid), bool)  # whether a[mid] comes before b[d - mid - 1], so that more of a belongs here
        ahead[open_] = a[mid[open_]] <= b[diagonals[open_] - mid[open_] - 1]
        low, high = np.where(open_ & ahead, mid + 1, low), np.where(open_ & ~ahead, mid, high)
    return low


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> Merge:
    """Merge two increasing lists of ends that have the same last end, in pieces of ``work`` steps."""
    total = len(a) + len(b)
    diagonals = np.arange(0, total, work)
    i = split_points(a, b, diagonals)
    j = diagonals - i
    shape = (len(diagonals), work)
    at_a, at_b = np.empty(shape, np.int64), np.empty(shape, np.int64)
    emits, closes = np.zeros(shape, bool), np.zeros(shape, bool)
    far = np.iinfo(np.int64).max
    a_, b_ = np.append(a, far), np.append(b, far)
    before = np.append(-1, a)  # the end before a[i] is before[i]
    for step in range(work):
        inside = diagonals + step < total
        takes_a = (a_[i] <= b_[j]) & inside
        takes_b = ~takes_a & inside
        together = takes_b & (before[i] == b_[j])  # a's end of the same place was the step before
        at_a[:, step], at_b[:, step] = i, j
        emits[:, step] = takes_a | takes_b & ~together
        closes[:, step] = together
        i, j = i + takes_a, j + takes_b
    inside_piece = np.cumsum(closes, axis=1) - closes
    closed = closes.sum(axis=1)
    group = inside_piece + (np.cumsum(closed) - closed)[:, None]  # stitches groups that reach over pieces
    out = Merge(at_a[emits], at_b[emits], group[emits], np.zeros(int(emits.sum()), bool))
    # the step that closes a group follows the overlap of the same two tokens, maybe in another piece
    out.closes[np.cumsum(emits.ravel())[closes.ravel()] - 1] = True
    return out


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments start, of texts that each start with a blank; ends with the length of the data.

    A cut needs a blank after a character that is no white space to either tokenizer. Characters of the UTF-8 blocks
    that hold white space count as such.
    """
    padded = np.concatenate([np.zeros(3, np.uint8), data])
    one, two, three = padded[2:-1], padded[1:-2], padded[:-3]  # the bytes 1, 2 and 3 before
    safe = (one >= 0x21) & (one <= 0x7E) | (one >= 0x80) & (two != 0xC2) & ~np.isin(three, [0xE1, 0xE2, 0xE3, 0xEF])
    starts = (data == 0x20) & safe
    starts[offsets[:-1]] = True
    return np.append(np.flatnonzero(starts), len(data))


#: Segments whose characters every splitter classes alike, that end in no white space: they may stand beside each other.
_PLAIN = re.compile("[ ][\\t\\n\\r -~\u00c0-\u024f\u0400-\u045f\u4e00-\u9fa5\uac00-\ud7a3]*[!-~\u00c0-\u024f\u0400-\u045f\u4e00-\u9fa5\uac00-\ud7a3]")
#: The split that byte-level vocabularies of this kind fix.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Segments that B encodes in one call; its time grows faster than a text.
_TOGETHER = 200


class Tokenizers:
    """Both tokenizers with the bytes of their tokens; A writes bytes as letters, B pieces with a mark for blanks.

    Segments of plain characters are encoded many in one text, which a cut between segments does not change; where
    each ends is read off the tokens' bytes. Others are encoded alone.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        self.a, self.b = load(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte, special = byte_of_letter(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, at in vocabulary.items():
            self.a_bytes[at] = token.encode() if token in special else bytes(byte[c] for c in token)
        ranks = {self.a_bytes[at]: at for token, at in vocabulary.items() if token not in special}
        self.a_joined = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in pieces):
            raise ValueError("pieces with a blank inside: texts can't be cut at blanks")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_BLANK, " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.blank = [self.b.piece_to_id(_BLANK)]
        self.memo = Memo(self.encode)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per segment the number of A's tokens, A's tokens and B's; a segment that either does not give back has -1 alone."""
        plain = np.fromiter((_PLAIN.fullmatch(s) is not None for s in segments), bool, len(segments))
        parts: list = [None] * len(segments)
        at = np.flatnonzero(plain).tolist()
        left = np.flatnonzero(~plain).tolist()
        for lo in range(0, len(at), _TOGETHER):
            group = at[lo : lo + _TOGETHER]
            made = self._together([segments[k] for k in group])
            if made is None:
                left += group
                continue
            for k, x in zip(group, made, strict=True):
                parts[k] = x
        for k in left:
            parts[k] = self._alone(segments[k])
        return np.fromiter(chain.from_iterable(parts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts))

    def _together(self, segments: list[str]) -> list[list[int]] | None:
        text = "".join(segments)
        raw = text.encode()
        ends = np.cumsum([len(s) for s in segments]) if len(raw) == len(text) else np.cumsum([len(s.encode()) for s in segments])
        sides = []
        for ids, made, size in ((self.a_joined.encode_ordinary(text), self.a_bytes, self.a_size), (self.b.encode(text[1:]), self.b_bytes, self.b_size)):
            to = np.searchsorted(token_ends := np.cumsum(size[ids]), ends)
            if b"".join([made[t] for t in ids]) != raw or (token_ends[to] != ends).any():
                return None
            to = (to + 1).tolist()
            sides.append([ids[x:y] for x, y in zip([0, *to[:-1]], to, strict=True)])
        return [[len(x), *x, *y] for x, y in zip(*sides, strict=True)]

    def _alone(self, segment: str) -> list[int]:
        a = self.a.encode(segment, add_special_tokens=False).ids
        b = self.b.encode(segment[1:]) or self.blank  # B adds the first blank itself, but not to nothing
        raw = segment.encode()
        same = all(b"".join([made[t] for t in ids]) == raw for ids, made in ((a, self.a_bytes), (b, self.b_bytes)))
        return [len(a), *a, *b] if same else [-1]


@dataclass
class Aligned:
    """Tokens of a slice of texts, by text: A's are a_lo[t] : a_lo[t + 1], and so on. Texts that can't be aligned have none."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_lo: np.ndarray
    b_lo: np.ndarray
    base: np.ndarray
    merge: Merge


def align(tokenizers: Tokenizers, column: pa.Array) -> Aligned:
    """Tokenise and merge the texts of a slice, all in one."""
    data, offsets = text_bytes(column)
    data = np.insert(data, offsets[:-1], 0x20)
    offsets = offsets + np.arange(len(offsets))
    starts = _cuts(data, offsets)
    lo = np.searchsorted(starts, offsets)
    values, codes = distinct(data, starts)
    flat, sizes = tokenizers.memo.ids(values)
    first = np.cumsum(sizes) - sizes
    n_a = flat[first].astype(np.int64)
    lost = (n_a < 0)[codes]
    ok = (np.add.reduceat(lost.astype(np.int64), lo[:-1]) == 0) & (np.diff(offsets) > 1)  # each text has a segment; its blank alone is no text
    segments = codes[np.repeat(ok, np.diff(lo))]
    count = np.append(0, np.cumsum(np.where(ok, np.diff(lo), 0)))
    out = []
    for start, taken, size in ((first + 1, n_a, tokenizers.a_size), (first + 1 + n_a, sizes - 1 - n_a, tokenizers.b_size)):
        ids, taken = gather(flat, start, taken, segments)
        out += [ids, np.cumsum(size[ids]), np.append(0, np.cumsum(taken))[count]]
    a, a_end, a_lo, b, b_end, b_lo = out
    length = np.where(ok, np.diff(offsets), 0)
    return Aligned(a, b, a_end, b_end, a_lo, b_lo, np.cumsum(length) - length, merge_path(a_end, b_end))


class _Texts:
    """Token ids as decimal text, each with the separator before it."""

    def __init__(self, n: int):
        self.n, digits = n, [str(k).encode() for k in range(n)]
        self.text = [sep + d for sep in (b",", b"|", b";") for d in digits]

    def of(self, x: Aligned) -> list[bytes]:
        """The groups of each text as a1,a2|b1;a3|b2,b3."""
        m = x.merge
        ends_a, ends_b = m.a[m.closes], m.b[m.closes]  # the last tokens of each group
        first_a, first_b = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
        first_a[np.append(0, ends_a + 1)[:-1]] = True
        first_b[np.append(0, ends_b + 1)[:-1]] = True
        group_a, group_b = np.cumsum(first_a) - 1, np.cumsum(first_b) - 1
        codes = np.empty(len(x.a) + len(x.b), np.int64)
        codes[np.arange(len(x.a)) + np.append(0, ends_b + 1)[group_a]] = x.a + np.where(first_a, 2 * self.n, 0)
        codes[np.arange(len(x.b)) + (ends_a + 1)[group_b]] = x.b + np.where(first_b, self.n, 0)
        parts, lo = list(map(self.text.__getitem__, codes.tolist())), (x.a_lo + x.b_lo).tolist()
        return [b"".join(parts[s:e])[1:] for s, e in zip(lo[:-1], lo[1:], strict=True)]


_LONGS = T.ArrayType(T.LongType(), False)
_FOUND = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", _LONGS), T.StructField("times", _LONGS)]
)
_OVERLAP = T.StructType([T.StructField(c, T.LongType()) for c in ("group", "a_at", "b_at", "a_id", "b_id", "start", "end")] + [T.StructField("link", T.BooleanType())])


def _mapped(docs: DataFrame, id_col: str, text_col: str, fields: T.StructType, make) -> DataFrame:
    inner = free_name(docs.select(id_col), "text_")
    read = docs.select(F.col(id_col), F.col(text_col).alias(inner))
    schema = T.StructType([docs.schema[id_col], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, inner):
            yield pa.RecordBatch.from_arrays(work(part.column(id_col), part.column(inner)), names=schema.names)

    return read.mapInArrow(run, schema)


def token_overlaps(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per overlap of an A and a B token: id, group, places and ids of both tokens, the common bytes
    (``start`` to ``end`` in the blank and the text), and whether both tokens end there (``link``).
    """

    def make():
        tokenizers = kept(("alignment", a_path, b_path), lambda: Tokenizers(a_path, b_path))

        def work(ids, texts):
            x = align(tokenizers, texts)
            m = x.merge
            doc = np.searchsorted(x.a_lo, m.a, "right") - 1
            first = np.append(m.group, 0)[np.searchsorted(m.a, x.a_lo[:-1])]
            start = np.maximum(np.append(0, x.a_end)[m.a], np.append(0, x.b_end)[m.b]) - x.base[doc]
            end = np.minimum(x.a_end[m.a], x.b_end[m.b]) - x.base[doc]
            made = [m.group - first[doc], m.a - x.a_lo[doc], m.b - x.b_lo[doc], x.a[m.a].astype(np.int64), x.b[m.b].astype(np.int64), start, end, m.closes]
            return [ids.take(pa.array(doc)), *map(pa.array, made)]

        return work

    return _mapped(docs, id_col, text_col, _OVERLAP, make)


def token_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups_sha256 and its distinct linked id pairs with
    their ``times``; and the number by which a pair is a * number + b.
    """
    import sentencepiece

    step = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()

    def make():
        tokenizers = kept(("alignment", a_path, b_path), lambda: Tokenizers(a_path, b_path))
        texts_of = kept(("texts", a_path, b_path), lambda: _Texts(max(len(tokenizers.a_bytes), len(tokenizers.b_bytes))))

        def work(ids, texts):
            x = align(tokenizers, texts)
            a, b = x.merge.a[x.merge.closes], x.merge.b[x.merge.closes]
            doc = np.searchsorted(x.a_lo, a, "right") - 1
            n = len(ids)
            links = np.bincount(doc, minlength=n)
            code = x.a[a].astype(np.int64) * step + x.b[b]
            order = np.lexsort((code, doc))
            code, doc = code[order], doc[order]
            fresh = np.ones(len(code), bool)
            fresh[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(fresh)
            to = pa.array(np.append(0, np.cumsum(np.bincount(doc[at], minlength=n))), pa.int32())
            sha = [hashlib.sha256(t).hexdigest() if t else "" for t in texts_of.of(x)]
            pairs = [pa.ListArray.from_arrays(to, pa.array(v, pa.int64())) for v in (code[at], np.diff(np.append(at, len(code))))]
            return [ids, pa.array(np.diff(x.a_lo)), pa.array(np.diff(x.b_lo)), pa.array(links), pa.array(links), pa.array(sha), *pairs]

        return work

    return _mapped(docs, id_col, text_col, _FOUND, make), step


def pair_counts(links: DataFrame, step: int) -> DataFrame:
    """pair, ``count`` over all documents, and ``best``: whether no pair of its B id has a higher count."""
    pair = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    pair = stage(pair)
    top = pair.groupBy(F.pmod("pair", F.lit(step)).alias("b")).agg(F.max("count").alias("top"))  # at most one row per B id
    return pair.withColumn("b", F.pmod("pair", F.lit(step))).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def _heavy(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs count as much or more."""
    sizes = {r[0]: r[1] for r in counts.groupBy(F.length(F.bin("count")).alias("bits")).count().collect()}  # at most 64 rows
    total, bits = 0, max(sizes, default=0) + 1
    while bits > 1 and total + sizes.get(bits - 1, 0) <= most:
        bits -= 1
        total += sizes.get(bits, 0)
    return 1 << (bits - 1)


def link_counts(links: DataFrame, counts: DataFrame, heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """A stored table of ``token_links`` with ``n_best`` and ``count_sum`` instead of its pairs."""
    spark = links.sparkSession
    bound = _heavy(counts, heavy_pairs)
    rows = counts.where(F.col("count") >= bound).toArrow()
    order = np.argsort(rows.column("pair").to_numpy())
    known = spark.sparkContext.broadcast(tuple(rows.column(c).to_numpy()[order] for c in ("pair", "count", "best")))
    keep = [f for f in links.schema if f.name not in ("pairs", "times")]
    names, extra = [f.name for f in keep], ["n_best", "count_sum"]
    rare = ["rare_pairs", "rare_times"]
    schema = T.StructType([*keep, *(T.StructField(c, T.LongType()) for c in extra), *(T.StructField(c, _LONGS) for c in rare)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = known.value
        for batch in batches:
            to = batch.column("pairs").offsets.to_numpy().astype(np.int64)
            code, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            to = to - to[0]
            at = np.minimum(np.searchsorted(pair, code), max(len(pair) - 1, 0))
            hit = pair[at] == code if len(pair) else np.zeros(len(code), bool)
            value, top = (count[at] * hit, best[at] & hit) if len(pair) else (np.zeros(len(code), np.int64), hit)
            sums = [np.diff(np.append(0, np.cumsum(v))[to]) for v in (times * top, times * value)]
            left = np.append(0, np.cumsum(~hit))[to]
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(v[~hit])) for v in (code, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, sums), *rest], names=schema.names)

    seen = links.mapInArrow(run, schema)
    if bound == 1:  # every pair is known
        return seen.drop(*rare)
    row = [F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("row_")]
    seen = stage(seen)
    rest = seen.select(*row, F.explode(F.arrays_zip(*rare)).alias("x")).select("file_", "row_", F.col("x.rare_pairs").alias("pair"), F.col("x.rare_times").alias("times"))
    rest = rest.join(counts.where(F.col("count") < bound), "pair").groupBy("file_", "row_")
    rest = rest.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b_"), F.sum(F.col("times") * F.col("count")).alias("s_"))
    seen = seen.select(*names, *extra, *row).join(small(stage(rest)), ["file_", "row_"], "left")
    return seen.select(*names, *((F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c) for c, x in (("n_best", "b_"), ("count_sum", "s_"))))


def token_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum.

    A is a byte-level vocabulary and encodes a blank and the text; B is a piece vocabulary that adds the blank itself. Texts
    that are null, empty, or not given back byte by byte by the tokens of either have no tokens: zeros and ''. Rows
    count as given, repeated and null ids too; other columns are not read. An empty table gives an empty result.
    """
    links, step = token_links(docs, a_path, b_path, id_col, text_col)
    links = stage(links)
    return link_counts(links, pair_counts(links, step), heavy_pairs)
