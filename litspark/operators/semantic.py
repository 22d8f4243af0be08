"""Scoring against query vectors, similarity search, nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.functions import periods, text
from litspark.operators.ranks import top_k
from litspark.operators.search import numbered, prefilter, result_order

SCORE_DIGITS = 9  # scores are rounded here, so equal vectors tie whatever the order of summation
QUERY_VALUES = 4_000_000  # query matrix held by a task (32 MB); more queries take further passes
TILE_VALUES = 1 << 20  # scores of one tile of rows and probes (8 MB)
KEPT_ROWS = 1_000_000  # results that a task holds before it cuts them to k per probe


def right_width(embeddings: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    return embeddings.filter(F.size(F.col(column)) == dim)


def dot_scores(
    embeddings: DataFrame, query: Sequence[float], key: str = "paper_id", min_similarity: float | None = None
) -> DataFrame:
    """(key, similarity) against one query vector, one matrix product per Arrow batch.

    Rows below the threshold are dropped before anything goes back to the JVM.
    """
    wanted = [float(x) for x in query]
    sized = right_width(embeddings, len(wanted)).select(key, "embedding")
    out = T.StructType([embeddings.schema[key], T.StructField("similarity", T.DoubleType())])
    digits = SCORE_DIGITS

    def score(batches):
        import numpy as np
        import pyarrow as pa

        vector = np.asarray(wanted)
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), dtype=np.float64)
            scores = flat.reshape(batch.num_rows, len(vector)) @ vector
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(scores, digits))], names=[key, "similarity"])
            yield made if min_similarity is None else made.filter(pa.array(scores >= min_similarity))

    return sized.mapInArrow(score, out)


def semantic_search(
    papers: DataFrame, embeddings: DataFrame, query: Sequence[float], journals: list[str] | None = None,
    year_from: int | None = None, year_to: int | None = None, min_similarity: float = 0.0,
    sort: str = "recent_similar", limit: int = 100,
) -> DataFrame:
    """First papers whose vector is close enough to the query vector and that have a real abstract.

    Vectors are scored and cut by the threshold where they are read, so only (paper_id, similarity)
    meets the papers, and the papers bring their abstract's test result, not the abstract.
    """
    return top_k(
        similar_papers(papers, embeddings, query, journals, year_from, year_to, min_similarity),
        limit, result_order(sort),
    )


def similar_papers(
    papers: DataFrame, embeddings: DataFrame, query: Sequence[float], journals: list[str] | None = None,
    year_from: int | None = None, year_to: int | None = None, min_similarity: float = 0.0,
) -> DataFrame:
    """All papers of a similarity search, in no order."""
    if (year_from is not None or year_to is not None) and "period" in embeddings.columns:
        embeddings = embeddings.filter(F.col("period").isin(periods.periods_between(year_from, year_to)))
    close = dot_scores(embeddings, query, min_similarity=min_similarity)
    wanted = prefilter(papers, journals, year_from, year_to).filter(text.has_real_abstract(F.col("abstract")))
    return wanted.drop("abstract").join(close, "paper_id")


def nearest(
    candidates: DataFrame, probes: Sequence[tuple], k: int, key: str = "paper_id", min_similarity: float | None = None,
    filters: Sequence[tuple] | None = None,
) -> DataFrame:
    """(query_id, key, similarity): the k candidates closest to each probe (id, vector).

    Every task multiplies tiles of rows and probes, each of at most TILE_VALUES scores, and keeps its k best per probe, so it
    holds a bounded number of values and sends out at most ``k * probes`` rows; no pair table exists. Equal scores are ordered by
    key, so masses of equal vectors do not grow the kept set either.

    ``filters`` names (journals, year_from, year_to) per probe, None meaning any; the candidates then hold journal and
    year. Rows of one journal and year share a mask of the probes that accept them.
    """
    probes = list(probes)
    if not probes:
        raise ValueError("no probes")
    width = len(probes[0][1])
    per_pass = max(1, min(QUERY_VALUES // width, KEPT_ROWS // max(1, k)))
    found = None
    columns = [key, "embedding", *(["journal", "year"] if filters is not None else [])]
    sized = right_width(candidates, width).select(*columns)
    for i in range(0, len(probes), per_pass):
        asked = None if filters is None else list(filters[i : i + per_pass])
        part = _nearest_pass(sized, probes[i : i + per_pass], k, key, candidates.schema[key], min_similarity, asked)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, [F.col("similarity").desc(), F.col(key)], by=["query_id"])


class _Best:
    """The k best (score, key) of each probe, of what has been offered; ties go to the smaller key."""

    def __init__(self, probes: int, k: int):
        self.probes, self.k = probes, k
        self.floor = np.full(probes, -np.inf)  # what a score must reach
        self.kept, self.offered, self.waiting = None, [], 0

    def offer(self, probe: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if len(probe):
            self.offered.append((probe, score, key))
            self.waiting += len(probe)
        if self.waiting > max(KEPT_ROWS, self.probes * self.k):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Cut everything to k per probe, all probes in one sort."""
        parts = ([self.kept] if self.kept else []) + self.offered
        if not parts:
            return None
        probe, score, key = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((key, -score, probe))
        probe, score, key = probe[order], score[order], key[order]
        first = np.searchsorted(probe, probe)
        good = np.arange(len(probe)) - first < self.k
        self.kept = probe, score, key = probe[good], score[good], key[good]
        last = np.flatnonzero(np.append(probe[1:] != probe[:-1], True))
        full = last[np.bincount(probe, minlength=self.probes)[probe[last]] == self.k]
        self.floor[probe[full]] = score[full]
        self.offered, self.waiting = [], 0
        return self.kept


def _masks(filters: list[tuple], journals: list, years: list) -> tuple[np.ndarray, np.ndarray]:
    """Probes that accept a journal and year, one row per pair that occurs, and the pair of each paper."""
    number: dict[tuple, int] = {}
    pair = np.fromiter((number.setdefault(p, len(number)) for p in zip(journals, years, strict=True)), np.int64, len(years))
    low = np.array([-np.inf if f[1] is None else f[1] for f in filters])
    high = np.array([np.inf if f[2] is None else f[2] for f in filters])
    dated = np.array([f[1] is not None or f[2] is not None for f in filters])
    lists: dict[frozenset | None, list[int]] = {}
    for q, (wanted, _, _) in enumerate(filters):
        lists.setdefault(None if wanted is None else frozenset(wanted), []).append(q)
    masks = np.zeros((len(number), len(filters)), bool)
    for (journal, year), at in number.items():
        for wanted, queries in lists.items():
            if wanted is None or journal in wanted:
                masks[at, queries] = True
        masks[at] &= ~dated if year is None else (low <= year) & (year <= high)
    return masks, pair


def _nearest_pass(sized, probes, k, key, key_field, min_similarity, filters):
    matrix = sized.sparkSession.sparkContext.broadcast((np.array([int(p[0]) for p in probes]), np.array([p[1] for p in probes], np.float64)))
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(key, key_field.dataType), T.StructField("similarity", T.DoubleType())])
    digits, values = SCORE_DIGITS, TILE_VALUES

    def keep_best(batches):
        ids, queries = matrix.value
        best = _Best(len(ids), k)
        rows = max(1, min(1024, values // queries.shape[1]))
        wide = max(1, values // rows)
        for batch in batches:
            names = batch.column(0).to_pylist()
            names = np.array(names, dtype=object if None in names else None)
            accepts, pair = (None, None) if filters is None else _masks(filters, batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for lo in range(0, batch.num_rows, rows):
                part = batch.column(1).slice(lo, rows)
                vectors = np.asarray(part.flatten(), dtype=np.float64).reshape(len(part), queries.shape[1])
                for q in range(0, len(ids), wide):
                    scores = np.round(vectors @ queries[q : q + wide].T, digits)
                    good = scores >= best.floor[q : q + wide]
                    if min_similarity is not None:
                        good &= scores >= min_similarity
                    if accepts is not None:
                        good &= accepts[pair[lo : lo + rows], q : q + wide]
                    row, probe = np.nonzero(good)
                    best.offer(probe + q, scores[row, probe], names[lo + row])
        kept = best.settle()
        if kept is not None:
            for at in range(0, len(kept[0]), 10_000):
                probe, score, name = (c[at : at + 10_000] for c in kept)
                columns = [pa.array(ids[probe]), pa.array(name.tolist(), key_type), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(key_field.dataType)
    return sized.mapInArrow(keep_best, out)


def semantic_search_batch(
    papers: DataFrame, embeddings: DataFrame, queries: Sequence[tuple], min_similarity: float = 0.0, limit: int = 100
) -> DataFrame:
    """(query_id, rank, paper_id, similarity) for many requests at once, best match first.

    A request is (id, vector) or (id, vector, journals, year_from, year_to) with filters of its own, None meaning any.
    Papers without a real abstract are taken out before the per-task cut, or it would not be exact.
    """
    queries = list(queries)
    filters = [tuple(q[2:]) + (None,) * (5 - len(q)) for q in queries] if any(len(q) > 2 for q in queries) else None
    columns = ["paper_id", *(["journal", "year"] if filters else [])]
    eligible = papers.filter(text.has_real_abstract(F.col("abstract"))).select(*columns)
    vectors = embeddings.select("paper_id", "embedding")
    rows = vectors.join(eligible, "paper_id") if filters else vectors.join(eligible, "paper_id", "left_semi")
    found = nearest(rows, [q[:2] for q in queries], limit, "paper_id", min_similarity, filters)
    return numbered(found, [F.col("similarity").desc(), F.col("paper_id")], ["query_id"])


def self_match(embeddings: DataFrame, probes: Sequence[tuple], k: int = 5) -> DataFrame:
    """(probe_id, rank, paper_id, similarity, aligned): is each probe its own nearest neighbour?"""
    found = nearest(embeddings, probes, k)
    ranked = numbered(found, [F.col("similarity").desc(), F.col("paper_id")], ["query_id"])
    return ranked.select(
        F.col("query_id").alias("probe_id"), "rank", "paper_id", "similarity",
        (F.col("paper_id") == F.col("query_id")).alias("aligned"),
    )
