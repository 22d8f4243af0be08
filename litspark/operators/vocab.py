"""TF-IDF vocabulary without moving texts or the tail of the vocabulary.

Texts are split where they are read; a row is a document, so counts per document need no shuffle. To find the n most
frequent usable terms, each task counts its rows in chunks of a bounded number of terms and sends only the leading terms of a
chunk, together with the count that no unsent term of the chunk passes (its floor). The sum of what was sent is the
least that a term can have; adding the floors of the chunks that did not send it gives the most. The n-th best least
value is a threshold: a term whose most lies below it is out, without ever having travelled. Terms between the bounds are counted
again, exactly. Where the floors do not suffice for that, chunks send more, and where that would not fit a task any more all
terms are counted by shuffle. So what a task holds follows neither its rows nor the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark import schema
from litspark.functions.batches import SLICE_BYTES, WordCutter, give_back, slices, word_characters
from litspark.operators.ranks import sample_k
from litspark.sources.staging import discard, stage

SCORE_DIGITS = 6  # scores are rounded here, so terms that always occur together tie
HELD = 1 << 18  # counts of slices that a task holds before it adds them up and keeps the leading ones
SENT_PER_TERM = 8  # leading terms that a chunk sends at first, for each wanted term
SENT = 1 << 18  # leading terms that a chunk sends in a later attempt at most
RECOUNTED = 1 << 17  # terms that are held in each task to be counted again

PART_BYTES = 4 << 20  # of texts whose terms one task adds up, while the parts are few
UNSORTED = 200  # so many parts Spark writes without holding rows in memory (spark.shuffle.sort.bypassMergeThreshold)
LARGE_BYTES = 32 << 20  # of texts whose terms one task adds up, where the parts are many
COUNT_ROWS = 1 << 16  # of a batch of counts

_COUNTS = "term string, ctf bigint, df bigint, floor bigint"


class Occurrences:
    """Terms of slices of lower-cased texts: words without stop words, and every two that stand next to each other."""

    def __init__(self, characters: np.ndarray):
        self.cut, self.stop = WordCutter(characters), pa.array(schema.STOP_WORDS)

    def words(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, the number of each that is no stop word, and its text."""
        values, codes, text = self.cut(column)
        kept = ~pc.is_in(values, self.stop).to_numpy(zero_copy_only=False)[codes]
        return values, codes[kept], text[kept]

    def counts(self, column: pa.Array) -> Iterator[pa.Table]:
        """(term, ctf, df) of a slice, each term once."""
        values, codes, text = self.words(column)
        if not len(codes):
            return
        at, *counted = _counted(codes, text)
        yield _table(values.take(pa.array(at)), *counted)
        beside, n = text[1:] == text[:-1], len(values)
        at, *counted = _counted(codes[:-1][beside] * n + codes[1:][beside], text[1:][beside])
        yield _table(pc.binary_join_element_wise(values.take(pa.array(at // n)), values.take(pa.array(at % n)), " "), *counted)


def _counted(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, their occurrences, and the texts that hold them."""
    order = np.argsort(codes, kind="stable")  # texts stay in order within a code
    codes, text = codes[order], text[order]
    first = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
    at = np.flatnonzero(first)
    first[1:] |= text[1:] != text[:-1]
    df = np.add.reduceat(first.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
    return codes[at], np.diff(np.append(at, len(codes))), df


def _added(tables: list[pa.Table]) -> pa.Table:
    """Counts of slices, each term once."""
    return pa.concat_tables(tables).group_by("term").aggregate([("ctf", "sum"), ("df", "sum")]).rename_columns(["term", "ctf", "df"])


def _table(terms: pa.Array, ctf: np.ndarray, df: np.ndarray) -> pa.Table:
    return pa.table({"term": terms, "ctf": pa.array(ctf, pa.int64()), "df": pa.array(df, pa.int64())})


class TermIndex:
    """Finds given terms, of one or two words, in slices of texts."""

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        self.word = {w: k for k, w in enumerate(dict.fromkeys(w for s in split for w in s))}
        self.n, self.known = len(self.word), pa.array(list(self.word), pa.string())
        self.single = np.full(self.n + 1, -1, np.int64)
        pairs = []
        for k, s in enumerate(split):
            if len(s) == 1:
                self.single[self.word[s[0]]] = k
            else:
                pairs.append((self.word[s[0]] * self.n + self.word[s[1]], k))
        pairs.sort()
        self.pair, self.of_pair = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))

    def find(self, values: pa.Array, codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term number, text) of every occurrence."""
        if not len(codes) or not self.n:
            return codes[:0], text[:0]
        known = pc.fill_null(pc.index_in(values, self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        one = self.single[known]
        two = np.full(len(codes), -1, np.int64)
        if len(self.pair):
            beside = np.flatnonzero((text[1:] == text[:-1]) & (known[1:] >= 0) & (known[:-1] >= 0))
            pairs = known[beside] * self.n + known[beside + 1]
            at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
            hit = self.pair[at] == pairs
            two[beside[hit]] = self.of_pair[at[hit]]
        return np.concatenate([one[one >= 0], two[two >= 0]]), np.concatenate([text[one >= 0], text[two >= 0]])


def _lower(texts: DataFrame, body: str) -> DataFrame:
    return texts.select(F.lower(body).alias("body"))


class Leaders:
    """The leading terms of a task: what each has for certain, and what it may have besides.

    Chunks give their leading terms and a floor, which no other term of theirs passes. ``covered`` is the sum of the floors
    of the chunks that did give a term; ``total`` less that is what it may still have.
    """

    def __init__(self, sent: int, held: int):
        self.sent, self.held, self.total = sent, held, 0
        self.known: pa.Table | None = None

    def add(self, tables: list[pa.Table]) -> None:
        """One chunk, as counts of slices."""
        found = _added(tables)
        ctf = found.column("ctf").to_numpy()
        floor = self._above(ctf, self.sent)
        found = found.filter(pa.array(ctf > floor))
        found = found.append_column("covered", pa.array(np.full(found.num_rows, floor, np.int64)))
        self.total += floor
        both = found if self.known is None else pa.concat_tables([self.known, found]).group_by("term").aggregate(
            [(c, "sum") for c in ("ctf", "df", "covered")]
        ).rename_columns(["term", "ctf", "df", "covered"])
        self.known = both
        if both.num_rows > self.held:
            self.cut(self.held // 2)

    @staticmethod
    def _above(values: np.ndarray, n: int) -> int:
        """The least value such that at most n are greater."""
        return int(np.partition(values, len(values) - n - 1)[len(values) - n - 1]) if len(values) > n else 0

    def cut(self, n: int) -> None:
        """Keep n terms at most; no other passes ``total`` then."""
        most = self.known.column("ctf").to_numpy() + self.total - self.known.column("covered").to_numpy()
        total = max(self.total, self._above(most, n))
        self.known = self.known.filter(pa.array(most > total)) if len(most) > n else self.known
        covered = pa.array(self.known.column("covered").to_numpy() + (total - self.total))
        self.known, self.total = self.known.set_column(3, "covered", covered), total


def _chunk_counts(texts: DataFrame, body: str, sent: int, held: int, slice_bytes: int) -> DataFrame:
    """(term, ctf, df, floor): the leading terms of a task, and one row without a term.

    There ``floor`` is what no other term of the task passes; with a term, how much of that is not open for it.
    """
    characters = word_characters(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, leaders, tables, rows = Occurrences(characters), Leaders(sent, held), [], 0
        for part in slices(batches, "body", slice_bytes):
            for counted in found.counts(part.column("body")):
                tables.append(counted)
                rows += counted.num_rows
            if rows > held:
                leaders.add(tables)
                tables, rows = [], 0
                give_back()
        if tables:
            leaders.add(tables)
        if leaders.known is not None:
            leaders.cut(sent)
            columns = [leaders.known.column(c).combine_chunks() for c in ("term", "ctf", "df", "covered")]
            columns = [pa.concat_arrays([x, pa.array([y], x.type)]) for x, y in zip(columns, (None, 0, 0, leaders.total), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "ctf", "df", "floor"])

    return _lower(texts, body).mapInArrow(run, _COUNTS)


def document_frequency(texts: DataFrame, body: str = "text") -> DataFrame:
    """(term, df, ctf): documents that hold a term, and its occurrences in all of them. A row is a document.

    All terms are the result, so all travel. They are counted beforehand in chunks of a bounded number of counts, not in whole
    tasks, and added up in as many parts as the texts' size asks for.
    """
    characters = word_characters(texts.sparkSession)
    size = texts.agg(F.coalesce(F.sum(F.octet_length(body)), F.lit(0))).first()[0]
    parts = -(-size // PART_BYTES)
    parts = parts if parts <= UNSORTED else max(UNSORTED, -(-size // LARGE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, tables, rows = Occurrences(characters), [], 0
        for part in slices(batches, "body"):
            for counted in found.counts(part.column("body")):
                tables.append(counted)
                rows += counted.num_rows
            if rows > HELD:
                yield from _added(tables).to_batches(COUNT_ROWS)
                tables, rows = [], 0
                give_back()
        if tables:
            yield from _added(tables).to_batches(COUNT_ROWS)

    counts = _lower(texts, body).mapInArrow(run, "term string, ctf bigint, df bigint")
    # dealt by term before anything is added up: the terms of a whole task would not stay in bounds
    counts = counts.repartition(parts, "term") if parts > 1 else counts
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def recount(texts: DataFrame, terms: list[str], body: str = "text") -> DataFrame:
    """(term, df, ctf) of given terms only, with at most one row per task and term on the way."""
    spark = texts.sparkSession
    characters, wanted = word_characters(spark), spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, index = Occurrences(characters), TermIndex(wanted.value)
        ctf, df = np.zeros(len(wanted.value), np.int64), np.zeros(len(wanted.value), np.int64)
        for part in slices(batches, "body"):
            term, text = index.find(*found.words(part.column("body")))
            ctf += np.bincount(term, minlength=len(ctf))
            df += np.bincount(np.unique(term * part.num_rows + text) // part.num_rows, minlength=len(df))
        at = np.flatnonzero(ctf)
        yield from _table(pa.array(wanted.value, pa.string()).take(pa.array(at)), ctf[at], df[at]).to_batches()

    return _lower(texts, body).mapInArrow(run, "term string, ctf bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def frequent_terms(
    texts: DataFrame, documents: int, n_terms: int, min_df: int, max_df: float, body: str = "text",
    sent: int | None = None, held: int = HELD, slice_bytes: int = SLICE_BYTES,
) -> list[tuple[str, int]]:
    """(term, df) of exactly the n_terms most frequent terms that are neither too rare nor too common; ties go by term."""
    sent, most = sent or SENT_PER_TERM * n_terms, max_df * documents
    ctf, df, floor = F.col("ctf"), F.col("df"), F.col("floor")
    while True:
        chunks = stage(_chunk_counts(texts, body, sent, held, slice_bytes))
        total = chunks.filter(F.col("term").isNull()).agg(F.coalesce(F.sum("floor"), F.lit(0))).first()[0]
        known = chunks.filter(F.col("term").isNotNull()).groupBy("term").agg(
            F.sum("ctf").alias("ctf"), F.sum("df").alias("df"), (F.lit(total) - F.sum("floor")).alias("floor")
        )  # floor: what a term may still gain
        sure = known.filter((df >= min_df) & (df + floor <= most))
        leading = [r.ctf for r in sure.orderBy(ctf.desc()).limit(n_terms).select("ctf").collect()]
        threshold = leading[-1] if len(leading) == n_terms else 0
        # unsent terms are out if they have too few documents or occurrences at the most
        closed = total == 0 or total < min_df or total < threshold
        if closed:
            candidates = known.filter((ctf + floor >= threshold) & (df + floor >= min_df) & (df <= most))
            exact = candidates.filter(floor == 0).orderBy(ctf.desc(), "term").limit(n_terms)
            unsure = candidates.filter(floor > 0).limit(RECOUNTED + 1)
            rows = exact.unionByName(unsure).collect() if total else exact.collect()
        discard(chunks)
        if closed and len(rows) <= RECOUNTED:
            break
        sent, held = 8 * sent, max(held, 16 * sent)
        if sent > SENT:
            usable = document_frequency(texts, body).filter((df >= min_df) & (df <= most))
            return [(r.term, r.df) for r in usable.orderBy(ctf.desc(), "term").limit(n_terms).collect()]
    found = [(r.ctf, r.term, r.df) for r in rows if not r.floor]
    again = [r.term for r in rows if r.floor]
    if again:
        found += [(r.ctf, r.term, r.df) for r in recount(texts, again, body).filter((df >= min_df) & (df <= most)).collect()]
    return [(term, n) for _, term, n in sorted(found, key=lambda r: (-r[0], r[1].encode()))[:n_terms]]


def tfidf_scores(texts: DataFrame, kept: list[tuple[str, int]], documents: int, body: str = "text") -> DataFrame:
    """(term, score): sum over documents of the unit-length tf-idf weights of the kept (term, df).

    Each task adds up its rows and sends one row per kept term that it has seen.
    """
    spark = texts.sparkSession
    characters, terms = word_characters(spark), spark.sparkContext.broadcast([t for t, _ in kept])
    idf = np.log((1 + documents) / (1 + np.array([d for _, d in kept], np.float64))) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, index = Occurrences(characters), TermIndex(terms.value)
        score = np.zeros(len(idf))
        for part in slices(batches, "body"):
            n = part.num_rows
            term, text = index.find(*found.words(part.column("body")))
            key, tf = np.unique(text * len(idf) + term, return_counts=True)
            text, term = key // max(1, len(idf)), key % max(1, len(idf))
            weight = tf * idf[term]
            length = np.sqrt(np.bincount(text, weight * weight, n))
            score += np.bincount(term, weight / length[text], len(idf))
        at = np.flatnonzero(score)
        names = [terms.value[k] for k in at.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(score[at])], names=["term", "score"])

    sums = _lower(texts, body).mapInArrow(run, "term string, score double")
    return sums.groupBy("term").agg(F.round(F.sum("score"), SCORE_DIGITS).alias("score"))


def tfidf_vocabulary(
    texts: DataFrame, n_terms: int = 3000, sample: int | None = None, seed: int = 42, min_df: int = 3,
    max_df: float = 0.3, key: str = "paper_id",
) -> DataFrame:
    """(term, score) of a corpus in (key, text); the highest score comes first when ordered by score, term.

    Every text is taken unless a smaller ``sample`` is asked for. A row is a document; null texts count as documents without
    terms. ``n_terms`` bounds what the driver holds.
    """
    documents = texts.count()
    if sample is not None and documents > sample:
        texts = sample_k(texts.select(key, "text"), sample, seed, [key])
        documents = sample
    return tfidf_scores(texts, frequent_terms(texts, documents, n_terms, min_df, max_df), documents)


def ranked(vocabulary: DataFrame, n: int | None = None) -> DataFrame:
    """Vocabulary with its rank, first n terms; a vocabulary has at most n_terms rows."""
    order = [F.col("score").desc(), F.col("term")]
    numbered = vocabulary.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return numbered if n is None else numbered.filter(F.col("rank") <= n)


def top_terms(vocabulary: DataFrame, n: int = 500) -> list[str]:
    """The first n terms as a list, an argument of the title index."""
    return [r.term for r in ranked(vocabulary, n).orderBy("rank").select("term").collect()]
