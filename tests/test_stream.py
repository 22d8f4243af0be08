import shutil

import numpy as np
from pyspark.sql import functions as F

from litspark.operators import search
from litspark.plans import curate
from litspark.sources import papers, seen
from litspark.streaming import alerts, ingest
from tests.test_sources import write_csv


def rows(first, n, url=True):
    return [[f"T{i % 9}", "a", f"text {i % 9}", f"http://u/{i % 9}" if url else "", "aer", str(1990 + i % 9)] for i in range(first, first + n)]


def keys(df):
    return sorted(r.paper_id for r in df.select("paper_id").collect())


def test_stream_equals_batch(spark, tmp_path):
    data, table, state = (str(tmp_path / d) for d in ("in", "table", "state"))
    write_csv(data, "", rows(0, 5) + rows(0, 2, url=False), name="papers_b2000.csv")
    ingest.ingest_available(spark, data, table, state)
    assert spark.read.parquet(table).count() == 7
    # the drop is sent again with more in it; the old rows are known
    write_csv(data, "", rows(0, 2, url=False) + rows(3, 9), name="papers_2000s.csv")
    ingest.ingest_available(spark, data, table, state, files_per_batch=1)
    streamed = spark.read.parquet(table)
    assert streamed.filter("batch_id = 1").count() == 4

    whole = str(tmp_path / "whole")
    write_csv(whole, "", rows(0, 5) + rows(0, 2, url=False) + rows(3, 9), name="papers_b2000.csv")
    batch = curate.curate(papers.read_papers(spark, whole)[0])
    assert keys(streamed) == keys(batch)
    # nothing new arrives
    ingest.ingest_available(spark, data, table, state)
    assert keys(spark.read.parquet(table)) == keys(batch)


def test_a_second_checkpoint_keeps_what_is_stored(spark, tmp_path):
    table = str(tmp_path / "table")
    for k in range(2):
        write_csv(str(tmp_path / f"in{k}"), "", [[f"T{k}", "a", "x", f"http://u/{k}", "aer", "1999"]], name="papers_b2000.csv")
        ingest.ingest_available(spark, str(tmp_path / f"in{k}"), table, str(tmp_path / f"state{k}"))
    assert sorted(r.title for r in spark.read.parquet(table).collect()) == ["T0", "T1"]


def test_more_saved_searches_than_an_expression_holds(spark, papers_of):
    papers = papers_of([(0, "Minimum wage", "a", "u", "aer", 2001), (1, "Tax", None, "u", "aer", 2002)])
    queries = [(i, f"none{i}") for i in range(2000)] + [(2000, "wage"), (2001, "tax|levy")]
    got = sorted((r.query_id, r.paper_id) for r in alerts.saved_search_stream(papers, queries).collect())
    assert got == [(2000, 0), (2001, 1)]


def test_a_batch_run_twice_counts_once(spark, tmp_path):
    table = str(tmp_path / "table")
    batch = spark.createDataFrame(
        [("T", "a", "x", "http://u", "aer", "1999", "f", 0)],
        "title string, authors string, abstract string, url string, journal string, year string, file string, block bigint",
    )
    ingest.add_unseen(spark, batch, 0, table)
    ingest.add_unseen(spark, batch, 0, table)
    ingest.add_unseen(spark, batch, 1, table)
    assert [r.batch_id for r in spark.read.parquet(table).collect()] == [0]


def batch_of(spark, ids):
    rows = [(f"T{i}", "a", "x", f"http://u/{i}", "aer", "1999", "f", i) for i in ids]
    return spark.createDataFrame(rows, "title string, authors string, abstract string, url string, journal string, year string, file string, block bigint")


def test_seen_keys_by_prefix(spark, tmp_path, monkeypatch):
    """Filters with and without false answers, a batch without index, a table older than its index."""
    table = str(tmp_path / "table")
    for bits in (12, 1):
        monkeypatch.setattr(seen, "BITS", bits)
        run = f"run{bits}"
        base = 1000 * bits
        ingest.add_unseen(spark, batch_of(spark, range(base, base + 300)), 0, table, run_id=run)
        ingest.add_unseen(spark, batch_of(spark, range(base + 200, base + 400)), 1, table, run_id=run)
        ingest.add_unseen(spark, batch_of(spark, range(base, base + 400)), 2, table, run_id=run)
        counts = {r.batch_id: r.n for r in spark.read.parquet(table).where(F.col("run_id") == run).groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
        assert counts == {0: 300, 1: 100}
    # a part whose index was never written is indexed before the next batch looks
    shutil.copytree(f"{table}/run_id=run12", f"{tmp_path}/older/run_id=run12")
    older = str(tmp_path / "older")
    assert seen.parts(spark, older) == {("run12", 0), ("run12", 1)} and seen.parts(spark, seen.filters_path(older)) == set()
    ingest.add_unseen(spark, batch_of(spark, [12_000, 12_399, 5]), 7, older, run_id="next")
    assert seen.parts(spark, seen.filters_path(older)) == {("run12", 0), ("run12", 1), ("next", 7)}
    assert [r.title for r in spark.read.parquet(older).where("run_id = 'next'").collect()] == ["T5"]


def test_seen_keys_are_pruned_and_verified(spark, tmp_path):
    table = str(tmp_path / "table")
    stored = spark.range(5000).select(F.col("id").alias("paper_id"), F.lit("r").alias("run_id"), F.lit(0).alias("batch_id"))
    stored.write.partitionBy("run_id", "batch_id").parquet(table)
    asked = spark.createDataFrame([(3,), (4999,), (7000,), (None,), (3,)], "paper_id bigint")
    found = seen.seen_keys(asked, table, "new", 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "_seen" in x)
    assert "PushedFilters: [In(prefix" in scan and "SortMergeJoin" not in plan
    assert sorted(r.paper_id for r in found.collect()) == [3, 4999]
    assert seen.seen_keys(asked, table, "r", 0) is None and seen.seen_keys(asked, str(tmp_path / "none"), "r", 0) is None
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 40_000)
    kept = seen.bloom(hashes[:20_000])
    assert seen.perhaps(hashes[:20_000], kept).all() and seen.perhaps(hashes[20_000:], kept).mean() < 0.01
    assert not seen.perhaps(hashes[:9], seen.bloom(hashes[:0])).any()


def test_rejects_of_each_batch_are_written(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = [("T", "a", "x", "http://u", "aer", "1999", "f", 0), ("Bad", "a", "x", "http://v", "aer", "20x4", "f", 0), (None, "a", "x", "http://w", "aer", "2001", "f", 0)]
    batch = spark.createDataFrame(rows, "title string, authors string, abstract string, url string, journal string, year string, file string, block bigint")
    for batch_id in (0, 0, 1):
        ingest.add_unseen(spark, batch, batch_id, table, run_id="r")
    got = spark.read.parquet(ingest.rejects_path(table)).collect()
    assert sorted((r.run_id, r.batch_id, str(r.title), r.year, r.reason) for r in got) == [
        ("r", k, t, y, why) for k in (0, 1) for t, y, why in (("Bad", "20x4", "year"), ("None", "2001", "title"))]
    assert [r.title for r in spark.read.parquet(table).collect()] == ["T"]


def test_saved_searches(spark, tmp_path, papers_of):
    arriving = papers_of([(0, "Minimum wage", "a", "u", "aer", 2001), (1, "Tax", None, "u", "aer", 2002)])
    path = str(tmp_path / "arriving")
    arriving.write.parquet(path)
    queries = [(1, "wage"), (2, ""), (3, "tax|levy"), (4, "none")]
    stream = alerts.saved_search_stream(spark.readStream.schema(arriving.schema).parquet(path), queries)
    run = stream.writeStream.format("memory").queryName("alerts").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r.query_id, r.paper_id) for r in spark.table("alerts").collect())
    assert got == [(1, 0), (2, 0), (2, 1), (3, 1)]
    asked = spark.createDataFrame(queries, "query_id int, query string")
    batch = search.keyword_search_batch(arriving, asked).select(F.col("query_id"), "paper_id").collect()
    assert sorted(map(tuple, batch)) == got


def test_bad_drops_are_recorded_and_passed_over(spark, tmp_path):
    """Files without the wanted columns, blank ones, other column orders and more columns; then good ones again."""
    data, table, state = tmp_path / "in", str(tmp_path / "papers"), str(tmp_path / "state")
    data.mkdir()
    row = {"title": "Good", "authors": "a", "abstract": "x", "url": "http://u/1", "journal": "aer", "year": "2001"}

    def drop(name, header, cells):
        (data / name).write_text(",".join(header) + "\n" + ",".join(cells) + "\n")

    drop("p0.csv", list(row), row.values())
    drop("p1.csv", ["title", "year"], ["Lost", "2001"])
    (data / "p2.csv").write_text("\n\n")  # one of no bytes is not even listed
    drop("p3.csv", [*list(row), "TITLE"], [*row.values(), "z"])
    other = row | {"title": "Turned", "url": "http://u/2"}
    drop("p4.csv", [*reversed(list(row)), "more"], [*reversed(list(other.values())), "m"])
    for later in (False, True):
        if later:
            drop("p5.csv", list(row), (row | {"title": "Later", "url": "http://u/3"}).values())
            drop("p6.csv", ["nothing"], ["x"])
        ingest.ingest_available(spark, str(data), table, state, files_per_batch=2)
    assert sorted((r.title, r.url, r.year) for r in spark.read.parquet(table).collect()) == [
        ("Good", "http://u/1", 2001), ("Later", "http://u/3", 2001), ("Turned", "http://u/2", 2001)]
    reasons = sorted(r.reason.rsplit("/", 1)[1].split("[")[0].strip() for r in spark.read.parquet(ingest.rejects_path(table)).collect())
    assert reasons == ["p1.csv: missing columns", "p2.csv: no header", "p3.csv: repeated columns", "p6.csv: missing columns"]
