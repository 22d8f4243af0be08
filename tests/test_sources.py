import csv
import os
import warnings

import pytest
from pyspark.sql import functions as F

from litspark import schema, session
from litspark.functions.vectors import half_round
from litspark.operators import encode, maintain
from litspark.plans import curate, embed
from litspark.sources import embeddings as table
from litspark.sources import listing, papers, staging
from litspark.sources import manifest as mf

HEAD = ["title", "authors", "abstract", "url", "journal", "year"]


def write_csv(folder, period, rows, head=HEAD, name=None):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name or f"papers_{period}.csv")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(head)
        out.writerows(rows)
    return path


@pytest.fixture
def drop(tmp_path):
    folder = str(tmp_path / "Data")
    write_csv(folder, "b2000", [
        ["A\n[r] \"q\"", "x, y", "line one\nline two", "http://u/1", "aer", "1990"],
        ["Dup", "x", "NA", "http://u/2", "aer", "1991.0"],
        ["No url", "x", "t", "", "aer", "1992"],
        ["No url", "x", "t", "", "aer", "1992"],
    ])
    # other column order, an extra column, part files in a folder
    head = ["year", "extra", "title", "url", "authors", "journal", "abstract"]
    write_csv(folder, "2000s", [["2003", "e", "Dup", "http://u/2", "later", "jpe", "z"]], head, "papers_2000s.csv/part-0.csv")
    write_csv(folder, "2000s", [["2004", "e", "New", "http://u/5", "n", "jpe", "null"], ["20x4", "", "Bad", "u", "n", "j", ""]],
              head, "papers_2000s.csv/part-1.csv")
    return folder


def test_scan(spark, drop):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        good, bad = papers.read_papers(spark, drop)
    assert any("2010s" in str(w.message) for w in seen)
    rows = {(r.title, r.ord.period, r.ord.line % (1 << 33)): r for r in good.collect()}
    assert len(rows) == 6
    first = next(r for r in rows.values() if r.title.startswith("A\n"))
    assert first.title == 'A\n[r] "q"' and first.abstract == "line one\nline two" and first.year == 1990
    dup = [r for r in rows.values() if r.title == "Dup"]
    assert {(r.year, r.journal, r.authors, r.abstract) for r in dup} == {(1991, "aer", "x", None), (2003, "jpe", "later", "z")}
    assert [r.abstract for r in rows.values() if r.title == "New"] == [None]
    assert [(r.title, r.year) for r in bad.collect()] == [("Bad", "20x4")]


def test_part_files_of_unlike_headers_fail(spark, tmp_path):
    folder = str(tmp_path / "d")
    write_csv(folder, "2000s", [["t", "a", "x", "u", "aer", "2001"]], HEAD, "papers_2000s.csv/part-0.csv")
    write_csv(folder, "2000s", [["2012", "t", "a", "x", "u", "aer"]], [HEAD[-1], *HEAD[:-1]], "papers_2000s.csv/part-1.csv")
    with pytest.raises(Exception, match="header|Header"):
        papers.read_raw_papers(spark, folder).collect()


def test_rejects(spark, drop):
    assert [(r.title, r.year, r.reason) for r in curate.rejects(spark, drop).collect()] == [("Bad", "20x4", "year")]


def test_no_source_at_all(spark, tmp_path):
    write_csv(str(tmp_path / "d"), "x", [["t"] * 6], name="other.csv")
    with pytest.raises(ValueError):
        papers.read_raw_papers(spark, str(tmp_path / "d"))


def test_missing_column(spark, tmp_path):
    write_csv(str(tmp_path / "d"), "2000s", [["t"] * 5], HEAD[:5])
    with pytest.raises(ValueError):
        papers.read_raw_papers(spark, str(tmp_path / "d"))


def test_order_follows_periods_and_lines(spark, tmp_path):
    folder = str(tmp_path / "d")
    # the larger, later period would be read first by size
    write_csv(folder, "2020s", [["Same", str(i), "a" * 500, "http://u", "j", "2021"] for i in range(200)])
    write_csv(folder, "b2000", [["Same", "first", "a", "http://u", "j", "1990"], ["Same", "second", "a", "http://u", "j", "1990"]])
    kept = curate.curate(papers.read_papers(spark, folder)[0]).collect()
    assert [r.authors for r in kept] == ["first"]


def test_corpus_snapshot(spark, drop):
    corpus = curate.load_corpus(spark, drop)
    assert sorted((r.title, r.period) for r in corpus.collect()) == [
        ('A "q"', "b2000"), ("Dup", "b2000"), ("New", "2000s"), ("No url", "b2000"), ("No url", "b2000"),
    ]
    assert len({r.paper_id for r in corpus.collect()}) == 5
    assert curate.load_corpus(spark, drop) is corpus
    write_csv(drop, "2010s", [["More", "m", "a", "http://u/9", "jet", "2012"]])
    assert curate.load_corpus(spark, drop).count() == 6


def test_halves_over_file_order(spark, drop):
    corpus = curate.load_corpus(spark, drop)
    parts = maintain.half_split(corpus.select("paper_id", "ord", "period", "title"))
    got = {(r.ord.line % (1 << 33), r.part) for r in parts.filter("period = 'b2000'").collect()}
    assert sorted(p for _, p in got) == [1, 1, 2, 2]
    assert [p for _, p in sorted(got)] == [1, 1, 2, 2]


def test_sources_listing(spark, drop):
    rows = papers.list_sources(spark, drop).collect()
    assert sorted(r.period for r in rows) == ["2000s", "2000s", "b2000"]
    assert all(r.size > 0 and r.mtime is not None for r in rows)


def test_changed_files(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    for folder, row in ((old, "abc"), (new, "abd")):
        write_csv(folder, "b2000", [["same"] * 6])
        write_csv(folder, "2000s", [[row] * 6])  # equal size, other content
        write_csv(folder, "2010s", [["x" * (1 if folder == old else 2)] * 6])
    write_csv(new, "2015s", [["only new"] * 6])
    got = sorted(r.name for r in listing.changed_files(spark, old, new).collect())
    assert got == ["papers_2000s.csv", "papers_2010s.csv", "papers_2015s.csv"]


def test_stage_keeps_rows_and_partitions(spark):
    df = spark.createDataFrame([(1, "2000s"), (2, "b2000")], "i int, period string")
    back = staging.stage(df, ["period"])
    assert sorted(map(tuple, back.select("i", "period").collect())) == [(1, "2000s"), (2, "b2000")]


def test_discard_deletes_staged_tables_only(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "other"))
    other, staged = spark.read.parquet(str(tmp_path / "other")), staging.stage(spark.range(3))
    folder = staged.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    staging.discard(other, staged)
    assert other.count() == 3 and not os.path.exists(folder)


def test_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(session, "_named_dir", lambda _: "/named/")
    assert session.shared_dir(spark) == "/named"
    monkeypatch.setattr(session, "_named_dir", lambda _: None)
    assert session.shared_dir(spark) == session.shared_dir(spark)
    assert staging.stage(spark.range(3)).count() == 3


def toy_encoder(df):
    return encode.hashing_encode(df, 16)


def test_build_and_update(spark, drop, tmp_path):
    path, manifest = str(tmp_path / "emb"), str(tmp_path / "manifest")
    corpus = curate.load_corpus(spark, drop)
    written = embed.full_build(corpus, path, toy_encoder, "toy", 16, manifest)
    head = written.first()
    assert (head.model_name, head.embedding_dim, head.total_papers) == ("toy", 16, 5)
    entries = {r.file_entry: r for r in mf.manifest_rows(written).collect()}
    assert {e: r.num_papers for e, r in entries.items()} == {"b2000_part1": 2, "b2000_part2": 2, "2000s": 1}
    assert (entries["b2000_part2"].first_index, entries["b2000_part2"].last_index) == (2, 3)
    assert entries["2000s"].first_index is None and entries["2000s"].period == "2000s"
    assert head.files["b2000_part1"].year_range == "1990-1991"
    assert head.files["b2000_part1"].index_range == "0-1 of b2000"
    assert embed.model_of(spark, manifest) == "toy"

    stored = table.read_embeddings(spark, path, "toy", 16)
    assert stored.count() == 5 and table.read_embeddings(spark, path, "other").count() == 0
    exact = stored.select((F.col("embedding") == half_round(F.col("embedding")).cast("array<float>")).alias("same"))
    assert all(r.same for r in exact.collect())
    sizes = {r.period: r.file_size_mb for r in table.file_sizes(stored).collect()}
    assert set(sizes) == {"b2000", "2000s"} and all(s > 0 for s in sizes.values())

    # nothing new: nothing changes
    embed.update(corpus, path, toy_encoder, "toy", 16, manifest)
    assert table.read_embeddings(spark, path).agg(F.max("batch")).first()[0] == 0

    write_csv(drop, "2010s", [["More", "m", "a word", "http://u/9", "jet", "2012"]])
    grown = curate.load_corpus(spark, drop)
    again = embed.update(grown, path, toy_encoder, "toy", 16, manifest)
    stored = table.read_embeddings(spark, path)
    assert stored.groupBy("batch").count().orderBy("batch").collect() == [(0, 5), (1, 1)]
    rows = {r.file_entry: (r.num_papers, r.papers_added) for r in mf.manifest_rows(again).collect()}
    assert rows["2010s"] == (1, 1) and rows["b2000_part1"] == (2, 0)
    assert again.first().total_papers == 6

    # rebuild of one period replaces it and leaves the others
    embed.full_build(grown, path, toy_encoder, "toy", 16, manifest, ["2010s"])
    assert table.read_embeddings(spark, path).groupBy("batch").count().collect() == [(0, 6)]


def test_manifest_defaults(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(
        '{"model_name": null, "creation_date": "2026-03-01T10:00:00.5", "files": '
        '{"2000s": {"num_papers": 3, "year_range": "2000-2009", "source_csv": "papers_2000s.csv"}}}'
    )
    row = mf.manifest_rows(mf.read_manifest(spark, str(path))).first()
    assert (row.file_entry, row.num_papers, row.min_year, row.max_year, row.papers_added) == ("2000s", 3, 2000, 2009, 0)
    assert row.created.isoformat() == "2026-03-01T10:00:00.500000"
    assert embed.model_of(spark, str(path)) == schema.DEFAULT_MODEL


def test_stale(spark):
    entries = spark.sql("""select * from values ('b2000_part1', 'b2000', timestamp'2026-01-02'),
      ('b2000_part2', 'b2000', timestamp'2026-01-04'), ('2000s', '2000s', timestamp'2026-01-02'),
      ('2010s', '2010s', timestamp'2026-01-02') as t(file_entry, period, created)""")
    sources = spark.sql("""select * from values ('b2000', timestamp'2026-01-03'), ('2000s', timestamp'2026-01-02'),
      ('2010s', timestamp'2026-01-03'), ('2015s', timestamp'2026-01-01') as t(period, mtime)""")
    got = {r.period: r.stale for r in maintain.stale_periods(sources, entries).collect()}
    assert got == {"b2000": True, "2000s": False, "2010s": True, "2015s": True}


def test_merge_and_upsert(spark):
    old = spark.createDataFrame([(1, 10, 0), (2, 20, 0)], "paper_id int, ord int, batch int")
    merged = maintain.merge_embeddings(old, spark.createDataFrame([(3, 5)], "paper_id int, ord int"))
    order, _ = maintain.merged_order(merged.withColumn("ord", F.col("ord").cast("bigint")))
    assert [r.paper_id for r in merged.withColumn("ord", F.col("ord").cast("bigint")).orderBy(order).collect()] == [3, 1, 2]
    cols = "file_entry string, period string, num_papers bigint, min_year smallint, max_year smallint, first_index bigint, " \
           "last_index bigint, file_size_mb double, created string, papers_added bigint"
    a = spark.createDataFrame([("x", "x", 5, 1, 2, 0, 4, 1.0, "old", 2), ("y", "y", 3, 1, 2, 0, 2, 1.0, "old", 1)], cols)
    b = spark.createDataFrame([("x", "x", 7, 1, 3, 0, 6, 2.0, "new", 0), ("z", "z", 1, 1, 1, 0, 0, 0.1, "new", 0)], cols)
    got = {r.file_entry: (r.num_papers, r.created, r.papers_added) for r in maintain.manifest_upsert(a, b).collect()}
    assert got == {"x": (7, "new", 2), "y": (3, "old", 1), "z": (1, "new", 1)}
    total = {r.file_entry: r.num_papers for r in maintain.manifest_totals(a).collect()}
    assert total == {None: 8, "x": 5, "y": 3}
