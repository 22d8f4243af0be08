"""Benchmark decontamination by winnowing.

Of both sides every run of ``GRAM`` words is hashed, and of each ``GUARD`` consecutive hashes the
smallest is kept as a fingerprint. ``GRAM + GUARD - 1`` words are one window, so two texts that share a
window share a fingerprint: none is missed. Fingerprints that meet are extended word by word in both
directions; a shared run of a window or more marks its words. Items shorter than a window have no such
guarantee and are matched whole, by the hash of as many words as they have.

The benchmark reaches the tasks as a broadcast of at most ``BLOCK_BYTES`` of text. A larger one is taken
in blocks by hash of the item, one pass over the documents each, and the spans are merged by text.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.words import LETTERS, U64, _RUN, free_name, map_text, mix, run_hashes, split_words
from litspark.sources.staging import stage

WINDOW = 13
GRAM = 5
GUARD = WINDOW - GRAM + 1
BLOCK_BYTES = 64 << 20
_NONE = np.iinfo(U64).max

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
])
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` over each n consecutive values."""
    for k in range(1, n.bit_length()):
        half = 1 << (k - 1)
        x = pick(x[:-half], x[half:])
    rest = n - (1 << (n.bit_length() - 1))
    return pick(x[:-rest], x[rest:]) if rest else x


def fingerprints(hashes: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs that winnowing keeps, of texts of a window's length and more."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, U64)
    grams = run_hashes(hashes, GRAM)
    ends = lo[1:]
    for back in range(1, GRAM):
        past = ends - back
        grams[past[(past >= 0) & (past < len(grams))]] = _NONE
    least = slide(grams, GUARD, np.minimum)
    wide = np.concatenate([np.zeros(GUARD - 1, U64), least, np.zeros(GUARD - 1, U64)])
    kept = np.flatnonzero((slide(wide, GUARD, np.maximum) == grams) & (grams != _NONE))
    return kept, grams[kept]


class Benchmark:
    """Word hashes, fingerprints and short items of some benchmark texts; empty items never occur."""

    def __init__(self, ids: list, texts: list):
        words = split_words(pa.array(texts, pa.string()), LETTERS, lower=True)
        self.ids, self.lo, self.hashes = ids, words.lo, words.hashes()
        at, found = fingerprints(self.hashes, self.lo)
        item = np.searchsorted(self.lo, at, "right") - 1
        long = np.diff(self.lo)[item] >= WINDOW if len(at) else np.empty(0, bool)
        order = np.argsort(found[long], kind="stable")
        self.prints, self.places = found[long][order], at[long][order]
        self.items = item[long][order]
        self.short = {}
        for n in range(1, WINDOW):
            which = np.flatnonzero(np.diff(self.lo) == n)
            if len(which):
                keys = np.concatenate([run_hashes(self.hashes[self.lo[i] : self.lo[i + 1]], n) for i in which])
                order = np.argsort(keys, kind="stable")
                self.short[n] = keys[order], which[order]

    def long_hits(self, hashes: np.ndarray, lo: np.ndarray, found: dict) -> None:
        at, prints = fingerprints(hashes, lo)
        if not len(at) or not len(self.prints):
            return
        left = np.searchsorted(self.prints, prints, "left")
        meet = np.flatnonzero(self.prints[np.minimum(left, len(self.prints) - 1)] == prints)
        text = np.searchsorted(lo, at[meet], "right") - 1
        done: dict = {}
        for p, l, d in zip(at[meet].tolist(), left[meet].tolist(), text.tolist(), strict=True):
            for k in range(l, int(np.searchsorted(self.prints, self.prints[l], "right"))):
                q, item = int(self.places[k]), int(self.items[k])
                if p < done.get((d, p - q), -1):
                    continue
                ahead = int(min(lo[d + 1] - p, self.lo[item + 1] - q))
                differ = np.flatnonzero(hashes[p : p + ahead] != self.hashes[q : q + ahead])
                end = p + (int(differ[0]) if len(differ) else ahead)
                behind = int(min(p - lo[d], q - self.lo[item]))
                differ = np.flatnonzero(hashes[p - behind : p] != self.hashes[q - behind : q])
                start = p - (behind - 1 - int(differ[-1]) if len(differ) else behind)
                done[d, p - q] = end
                if end - start >= WINDOW:
                    found[d].append((start, end, item))

    def short_hits(self, hashes: np.ndarray, lo: np.ndarray, found: dict) -> None:
        if not self.short or not len(hashes):
            return
        sums = np.zeros(len(hashes), dtype=U64)
        for n in range(1, max(self.short) + 1):
            size = len(hashes) - n + 1
            if size <= 0:
                return
            sums = sums[:size] + hashes[n - 1 :] * _RUN[n - 1]
            if n not in self.short:
                continue
            keys, which = self.short[n]
            runs = mix(sums)
            left = np.searchsorted(keys, runs, "left")
            meet = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == runs)
            text = np.searchsorted(lo, meet, "right") - 1
            for p, l, d in zip(meet.tolist(), left[meet].tolist(), text.tolist(), strict=True):
                if p + n <= lo[d + 1]:
                    for k in range(l, int(np.searchsorted(keys, keys[l], "right"))):
                        found[d].append((p, p + n, int(which[k])))

    def hits(self, column: pa.Array):
        words = split_words(column, LETTERS, lower=True)
        hashes, found = words.hashes(), defaultdict(list)
        self.long_hits(hashes, words.lo, found)
        self.short_hits(hashes, words.lo, found)
        spans, items = [], []
        for d in range(len(column)):
            merged: list = []
            for start, end, _ in sorted(found.get(d, ())):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([start, end])
            base = int(words.lo[d])
            spans.append([{"first": s - base, "last": e - base - 1} for s, e in merged])
            items.append(sorted({str(self.ids[i]) for _, _, i in found.get(d, ())}))
        return pa.array(words.counts(), pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = part.collect()
        yield Benchmark([r.item for r in rows], [r.text for r in rows])


def _matcher(shared):
    return lambda: shared.value.hits


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns ``keep`` with n_words, the hit word spans and the ids of the items that occur.

    Null or blank texts have no words and no hits. Items that are null, blank or without id never
    occur; items that repeat a text all occur together, and ids that repeat are listed once. Without
    items every document comes back without hits. A kept column named as an output gives way to it.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    if not shared:
        shared = [docs.sparkSession.sparkContext.broadcast(Benchmark([], []))]
    if len(shared) == 1:
        return map_text(docs, _matcher(shared[0]), HITS, keep, text_col)
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    found = None
    for block in shared:
        part = map_text(docs, _matcher(block), HITS, [text_col], text_col).where(F.size("spans") > 0).select(key.alias("k"), "spans", "item_ids").dropDuplicates(["k"])
        found = part if found is None else found.unionByName(part)
    found = stage(found).groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    merged = F.aggregate(
        F.array_sort("spans"), F.lit([]).cast("array<struct<first:bigint,last:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["first"] <= F.element_at(done, -1)["last"] + 1),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    found = found.select("k", merged.alias("spans"), "item_ids")
    k, words = free_name(docs, "k_"), map_text(docs, _matcher(docs.sparkSession.sparkContext.broadcast(Benchmark([], []))), HITS, [*dict.fromkeys([*keep, text_col])], text_col)
    keep = [c for c in keep if c not in ("n_words", "spans", "item_ids")]
    words = words.select(*keep, "n_words", key.alias(k))
    found = found.select(F.col("k").alias(k), F.struct("spans", "item_ids").alias(f"{k}f"))
    empty = F.lit([])
    return words.join(found, k, "left").select(
        *keep, "n_words", F.coalesce(F.col(f"{k}f.spans"), empty.cast(HITS["spans"].dataType)).alias("spans"),
        F.coalesce(F.col(f"{k}f.item_ids"), empty.cast(HITS["item_ids"].dataType)).alias("item_ids"),
    )


def hit_words(spans="spans"):
    """How many words the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def is_contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spans = contaminated_spans(docs, benchmark, [id_col], text_col).withColumn("n_hit", hit_words())
    return spans.select(
        id_col, "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )
