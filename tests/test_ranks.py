import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from litspark.operators import maintain, ranks


def hashed(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def test_number_within_spreads_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "ord bigint, k string").repartition(5)
    got = ranks.number_within(df, ["k"], F.shiftright("ord", 7), F.col("ord"), "no")
    want, seen = {}, defaultdict(int)
    for o, k in rows:
        seen[k] += 1
        want[o] = seen[k]
    assert {r.ord: r.no for r in got.collect()} == want


def test_number_within_null_key(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, "a")], "ord bigint, k string")
    got = ranks.number_within(df, ["k"], F.shiftright("ord", 1), F.col("ord"), "no")
    assert {r.ord: r.no for r in got.collect()} == {0: 1, 1: 2, 2: 1}


@pytest.mark.parametrize("k", [0, 1, 17, 500, 1000])
def test_sample_k(spark, k):
    df = spark.range(500).withColumnRenamed("id", "paper_id")
    want = sorted(range(500), key=lambda i: (hashed(42, i), i))[:k]
    for parts in (1, 7):
        got = ranks.sample_k(df.repartition(parts), k, 42, ["paper_id"])
        assert sorted(r.paper_id for r in got.collect()) == sorted(want)


def test_sample_of_nothing(spark):
    assert ranks.sample_k(spark.range(0), 5, 42, ["id"]).count() == 0


@pytest.mark.parametrize("k", [1, 5, 10, 11, 12, 100])
def test_first_k_cuts_inside_a_block(spark, k):
    rows = [(i // 7, i) for i in range(60)]
    df = spark.createDataFrame(rows, "b int, v int").repartition(4)
    got = ranks.first_k(df, k, F.struct("b", "v"), F.col("b"))
    assert sorted(r.v for r in got.collect()) == list(range(min(k, 60)))


def test_top_k_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 4}", (i * 7919) % 1009) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(9)
    order = [F.col("v").desc(), F.col("id")]
    got = ranks.top_k(df, 10, order, by=["k"], fan=4)
    want = set()
    for key in {r[1] for r in rows}:
        want |= {r[0] for r in sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))[:10]}
    assert {r.id for r in got.collect()} == want
    best = ranks.top_k(df, 25, order, fan=4).collect()
    assert [r.id for r in best] == [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:25]]
    most = ranks.top_k(df, 1001, order).collect()
    assert [r.id for r in most] == [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:1001]]
    each = ranks.top_k(df, 1001, order, by=["k"])
    assert each.count() == sum(min(1001, sum(r[1] == k for r in rows)) for k in {r[1] for r in rows})


def test_draws_name_rows_in_hash_order(spark):
    df = spark.range(300).withColumnRenamed("id", "paper_id").repartition(3)
    blocks = ranks.hash_blocks(df, 7, ["paper_id"])
    wanted = spark.createDataFrame([(0, 0), (1, 299), (2, 5), (3, 5), (4, 300), (5, -1)], "tag bigint, pos bigint")
    got = {r.tag: r.paper_id for r in ranks.rows_at(df, wanted, 7, ["paper_id"], blocks, 6).collect()}
    order = sorted(range(300), key=lambda i: (hashed(7, i), i))
    assert got == {0: order[0], 1: order[299], 2: order[5], 3: order[5]}


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 0)
    df = spark.range(200).withColumnRenamed("id", "paper_id")
    assert ranks.sample_k(df, 9, 42, ["paper_id"]).count() == 9


def by_period(spark, sizes, step=1):
    rows = [(o * step, p) for p, n in sizes.items() for o in range(n)]
    rows = [(i * step, p) for i, (_, p) in enumerate(rows)]
    return spark.createDataFrame(rows, "ord bigint, period string").repartition(3), rows


@pytest.mark.parametrize("step", [1, 1 << 19])  # one block, and many blocks
def test_halves(spark, step):
    df, rows = by_period(spark, {"a": 0, "b": 1, "c": 2, "d": 5, "e": 40}, step)
    got = {r.ord: r.part for r in maintain.half_split(df).collect()}
    for p, first in {"b": 0, "c": 1, "d": 2, "e": 20}.items():
        parts = [got[o] for o, q in sorted(rows) if q == p]
        assert parts == [1] * first + [2] * (len(parts) - first)


@pytest.mark.parametrize("step", [1, 1 << 19])
def test_delta_by_count(spark, step):
    df, rows = by_period(spark, {"grown": 10, "shrunk": 5, "same": 4, "new": 3}, step)
    previous = spark.createDataFrame([("grown", 6), ("shrunk", 9), ("same", 4)], "period string, previous bigint")
    got = {r.ord for r in maintain.delta_by_count(df, previous).collect()}
    want = [o for o, p in rows if p == "grown"][:4] + [o for o, p in rows if p == "new"]
    assert got == set(want)


def test_split_boundary(spark, papers_of):
    df = papers_of([(i * (1 << 18), f"t{i}", None, None, "j", 1990) for i in range(11)]).withColumn("period", F.lit("b2000"))
    got = maintain.split_boundary(df).orderBy("idx").collect()
    assert [(r.idx, r.title) for r in got] == [(3, "t3"), (4, "t4"), (5, "t5"), (6, "t6")]
