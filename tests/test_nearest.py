"""Nearest neighbours in tiles, with filters per request, against a full matrix product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.operators import semantic


def table_of(spark, n, dim, seed, strings=False):
    rnd = np.random.default_rng(seed)
    vectors = rnd.integers(-3, 4, (n, dim)) / 4  # coarse, so that scores tie
    journals = [None if x == 3 else "abc"[x] for x in rnd.integers(0, 4, n)]
    years = [None if x == 9 else int(1990 + x) for x in rnd.integers(0, 10, n)]
    keys = [f"k{i}" if strings else i for i in range(n)]
    rows = [(k, v.tolist(), j, y) for k, v, j, y in zip(keys, vectors, journals, years)]
    df = spark.createDataFrame(rows, f"paper_id {'string' if strings else 'bigint'}, embedding array<float>, journal string, year int")
    return df.repartition(4), vectors, journals, years, keys


def plain(vectors, journals, years, keys, probes, k, least, filters):
    out = []
    for n, (i, v) in enumerate(probes):
        wanted, low, high = filters[n] if filters else (None, None, None)
        scores = np.round(vectors @ np.array(v), 9)
        rows = [
            (-s, key) for s, key, j, y in zip(scores, keys, journals, years)
            if (least is None or s >= least) and (wanted is None or j in wanted)
            and (low is None or y is not None and y >= low) and (high is None or y is not None and y <= high)
        ]
        out += [(i, key, -s) for s, key in sorted(rows)[:k]]
    return sorted(out)


FILTERS = [(None, None, None), (["a"], None, None), (["a", "b"], 1993, None), (None, 1991, 1996), ([], None, None), (None, None, 1990), (["c", "zz"], 1995, 1992)]


@pytest.mark.parametrize("tile, kept, strings", [(1 << 20, 10**6, False), (16, 40, False), (1, 1, False), (64, 100, True)])
@pytest.mark.parametrize("k, least, filtered", [(3, None, True), (7, 0.5, True), (5, 0.0, False)])
def test_equals_plain_product(spark, monkeypatch, tile, kept, strings, k, least, filtered):
    """With tiles of one row and probe, and heaps cut all the time, too."""
    monkeypatch.setattr(semantic, "TILE_VALUES", tile)
    monkeypatch.setattr(semantic, "KEPT_ROWS", kept)
    df, *rows = table_of(spark, 150, 6, 1, strings)
    rnd = np.random.default_rng(2)
    probes = [(i, (rnd.integers(-3, 4, 6) / 4).tolist()) for i in range(14)]
    filters = [FILTERS[i % len(FILTERS)] for i in range(14)] if filtered else None
    if kept < 50:
        probes, filters = probes[:7], filters and filters[:7]
    got = semantic.nearest(df, probes, k, min_similarity=least, filters=filters).collect()
    assert sorted(map(tuple, got)) == plain(*rows, probes, k, least, filters)


def test_what_a_task_holds_is_bounded():
    """Masses of equal vectors and many probes stay within the bound before each cut."""
    best, rnd = semantic._Best(50, 4), np.random.default_rng(0)
    limit = max(semantic.KEPT_ROWS, 50 * 4)
    for start in range(0, 3_000_000, 100_000):
        probe = rnd.integers(0, 50, 100_000)
        score = np.ones(100_000)
        good = score >= best.floor[probe]
        best.offer(probe[good], score[good], np.arange(start, start + 100_000)[good])
        assert best.waiting <= limit + 100_000
    probe, _, key = best.settle()
    assert len(probe) == 200 and key.max() < 1000


def test_requests_with_filters(spark, papers_of):
    long = "abstract " * 10
    papers = papers_of([(0, "a", long, "u", "aer", 2001), (1, "b", long, "u", "jpe", 2005), (2, "c", "short", "u", "aer", 2005), (3, "d", long, "u", None, 1990)])
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(4)], "paper_id bigint, embedding array<float>")
    asked = [(1, [1, 1], ["aer"], None, None), (2, [1, 1], None, 2002, None), (3, [1, 1], None, None, None), (4, [1, 1], [], None, None), (5, [1, 1])]
    got = semantic.semantic_search_batch(papers, v, asked, 0.0, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.paper_id) for r in got] == [(1, 0), (2, 1), (3, 3), (3, 1), (3, 0), (5, 3), (5, 1), (5, 0)]
    plan = semantic.semantic_search_batch(papers, v, asked, 0.0, 5).select(F.count("*"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
