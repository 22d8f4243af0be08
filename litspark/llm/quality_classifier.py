"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its hashed words, and the hashed shapes of its words (capitals, symbols, digits,
closing marks, length, equal to the word before). Both kinds are weighted by log count and rarity and
scaled to length 1 apart. A bounded sample of labelled texts gives the term space, a truncated singular
value decomposition its latent axes; the sample's vectors are broadcast. Every document's vector is
multiplied with all of them, block by block, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.words import _LOWER, NOT_BLANK, U64, constants, map_text, mix, split_words

#: Labelled texts of either label that are broadcast; latent axes; neighbours that vote.
SAMPLE = 2000
AXES = 48
NEIGHBOURS = 15
_BUCKETS = 1 << 13
_SHAPES = 1 << 9
_TERMS = _BUCKETS + _SHAPES
_BLOCK = 512
_PART = 1 << 14
_SALT = constants(31, 2)

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def terms(column: pa.Array):
    """Text, term and count of all texts, sorted by text and term."""
    w = split_words(column, NOT_BLANK)
    if not len(w.start):
        return (np.empty(0, np.int64),) * 3
    sums = [np.concatenate([[0], np.cumsum(flags[w.data], dtype=np.int64)]) for flags in (_UPPER, _DIGIT, _MARK)]
    upper, digit, mark = (s[w.end] - s[w.start] for s in sums)
    size = w.end - w.start
    # After the last byte's class, how many marks close the word.
    closing = np.where(_MARK[w.data[w.end - 1]], np.where((size > 1) & _MARK[w.data[np.maximum(w.end - 2, w.start)]], 2, 1), 0)
    exact = w.hashes()
    w.data = _LOWER[w.data]
    hashes = w.hashes()
    same = np.zeros(len(exact), bool)
    same[1:] = exact[1:] == exact[:-1]
    same[w.lo[:-1][w.counts() > 0]] = False
    shape = np.minimum(upper, 2) + 3 * (2 * upper > size) + 6 * (digit > 0) + 12 * closing + 36 * (mark > closing) + 72 * np.minimum(np.log2(size), 4).astype(np.int64)
    shape = (mix(np.where(same, -1, shape).astype(np.int64).view(U64) ^ _SALT[0]) % U64(_SHAPES)).astype(np.int64) + _BUCKETS
    word = (mix(hashes ^ _SALT[1]) % U64(_BUCKETS)).astype(np.int64)
    text = np.repeat(np.arange(len(w.lo) - 1), w.counts())
    keys, counts = np.unique(np.concatenate([text * _TERMS + word, text * _TERMS + shape]), return_counts=True)
    return keys // _TERMS, keys % _TERMS, counts


def weights(text: np.ndarray, term: np.ndarray, count: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Log counts times rarity, the words and the shapes of each text at length 1."""
    value = np.log1p(count) * rarity[term]
    half = text * 2 + (term >= _BUCKETS)
    length = np.sqrt(np.bincount(half, value * value)) if len(half) else np.empty(0)
    return (value / np.maximum(length, 1e-12)[half]).astype(np.float32) if len(half) else value.astype(np.float32)


def gather(n: int, group: np.ndarray, pick: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of rows x[pick] * value by sorted group, a bounded part of the rows at a time."""
    out = np.zeros((n, x.shape[1]), dtype=x.dtype)
    for at in range(0, len(group), _PART):
        g = group[at : at + _PART]
        first = np.flatnonzero(np.diff(g, prepend=-1))
        out[g[first]] += np.add.reduceat(x[pick[at : at + _PART]] * value[at : at + _PART, None], first, axis=0)
    return out


def project(n: int, text: np.ndarray, term: np.ndarray, value: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Vectors of length 1 of n texts on the axes; zero for a text without terms."""
    out = gather(n, text, term, value, axes)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def latent_axes(text: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The first k right singular vectors of a sparse matrix, by randomised subspace iteration."""
    order = np.argsort(term, kind="stable")
    by_term = term[order], text[order], value[order]
    k = min(k, n, len(np.unique(term)))
    base = np.random.default_rng(7).standard_normal((_TERMS, min(k + 8, n))).astype(np.float32)
    for _ in range(4):
        base, _ = np.linalg.qr(gather(_TERMS, *by_term, gather(n, text, term, value, base)))
    _, _, turn = np.linalg.svd(gather(n, text, term, value, base), full_matrices=False)
    return (base @ turn.T)[:, :k].astype(np.float32)


class Voters:
    """The axes and the labelled vectors."""

    def __init__(self, labels: np.ndarray, sizes: np.ndarray, term: np.ndarray, count: np.ndarray, axes: int):
        """Labels, numbers of terms, and the terms with their counts, text after text."""
        n, self.labels = len(labels), labels.astype(np.float32)
        text = np.repeat(np.arange(n), sizes)
        self.rarity = np.log((1 + n) / (1 + np.bincount(term, minlength=_TERMS))) + 1
        value = weights(text, term, count, self.rarity)
        self.axes = latent_axes(text, term, value, n, axes) if len(text) else np.zeros((_TERMS, 1), np.float32)
        # Votes are ranked on products of doubles, so they don't hang on which texts share a batch.
        self.axes = self.axes.astype(np.float64)
        self.vectors = project(n, text, term, value, self.axes)

    def scores(self, column: pa.Array) -> np.ndarray:
        text, term, count = terms(column)
        made = project(len(column), text, term, weights(text, term, count, self.rarity), self.axes)
        return np.concatenate([self.votes(made[at : at + _BLOCK]) for at in range(0, len(made), _BLOCK)] or [np.empty(0)])

    def votes(self, made: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; similarities equal to nine digits go by the sample's order, its ids."""
        n = len(self.labels)
        best = np.full((len(made), 0), -1, dtype=np.int64)
        for at in range(0, n, _BLOCK):
            near = np.rint(made @ self.vectors[at : at + _BLOCK].T * 1e9).astype(np.int64)
            rank = near * n + (n - 1 - np.arange(at, at + near.shape[1]))
            best = np.concatenate([best, rank], axis=1)
            if best.shape[1] > NEIGHBOURS:
                best = -np.partition(-best, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
        weight = np.maximum(best // n, 0) / 1e9 if n else np.zeros((len(made), 0))
        total = weight.sum(axis=1)
        share = (weight * self.labels[n - 1 - best % n]).sum(axis=1) if n else total
        return np.where(total > 0, share / np.maximum(total, 1e-12), 0.0)


_TERMS_OF = T.StructType([T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def _terms():
    def work(column):
        text, term, count = terms(column)
        offsets = pa.array(np.searchsorted(text, np.arange(len(column) + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (term, count)]

    return work


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, learn: Column, per_label: int) -> DataFrame:
    """At most ``per_label`` texts of either label: label, id and text, the first by hash of their id.

    Of labels that clash for an id the smaller stands, of texts that repeat one the smallest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.min("label").alias("label")).where(learn)
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_label) for y in (0, 1)]
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def _fitted(axes: int):
    """The classifier of all rows of a partition, pickled."""

    def work(batches):
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks().sort_by("id")
        terms_of, counts_of = (rows.column(c).combine_chunks() for c in ("terms", "counts"))
        sizes = np.diff(terms_of.offsets.to_numpy())
        made = Voters(rows.column("label").to_numpy(), sizes, terms_of.flatten().to_numpy(), counts_of.flatten().to_numpy(), axes)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["model"])

    return work


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, learn: Column, per_label: int, axes: int) -> Voters:
    """The classifier of the bounded sample, fitted in a task; only the axes and vectors reach the driver."""
    sample = labelled_sample(docs, labels, "quality", id_col, text_col, learn, per_label)
    rows = map_text(sample, _terms, _TERMS_OF, ["id", "label"])
    made = rows.repartition(1).mapInArrow(_fitted(axes), "model binary").head()
    none = np.empty(0, np.int64)
    return pickle.loads(made.model) if made else Voters(none, none, none, none, axes)


def _voting(voters):
    return lambda: lambda column: (pa.array(voters.value.scores(column).astype(np.float64)),)


def quality_scores(
    docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", parts: int = 3, part: int = 1,
    per_label: int = SAMPLE, axes: int = AXES, score: str = "score",
) -> DataFrame:
    """The columns ``keep`` with the score: the share of votes for label 1.

    Learns from labelled rows that are not held out, of either label ``per_label`` at most; only texts
    are inputs. Texts that are null, blank or have no neighbour score 0, and so does every text where
    nothing is labelled. Of rows that repeat an id the smallest text stands in the sample, of clashing labels the
    smaller; all rows are scored.
    """
    voters = fit(docs, labels, id_col, text_col, ~held_out("id", parts, part), per_label, axes)
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    return map_text(docs, _voting(shared), T.StructType([T.StructField(score, T.DoubleType())]), keep, text_col)


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 if score >= 0.5). Other columns are not read."""
    scored = quality_scores(docs, labels, [id_col], id_col, text_col)
    return scored.select(id_col, held_out(id_col, 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
