"""Versioned tables, and the embedding table's plans stopped at every step."""

import pytest
from pyspark.sql import functions as F

from litspark.operators import encode
from litspark.plans import embed
from litspark.sources import embeddings as table
from litspark.sources import manifest as mf
from litspark.sources.versions import ConcurrentCommit, VersionedTable

DIM = 8


def encoder(df):
    return encode.hashing_encode(df, DIM)


def corpus(papers_of, rows):
    """Papers from (id, year)."""
    from litspark.plans.curate import with_period

    return with_period(papers_of([(i, f"title number{i} words", f"abstract {i}", f"http://u/{i}", "aer", y) for i, y in rows]))


FIRST = [(i, 1990 + i) for i in range(1, 9)] + [(i, 2000 + i) for i in range(20, 26)]
GROWN = [(0, 1985)] + FIRST + [(40, 2013), (41, 2021)]


def agrees(spark, path, papers):
    """The table holds one vector per paper, in its period, and the manifest counts them with their files' sizes."""
    tbl = table.table_of(spark, path)
    last = tbl.version()
    stored = table.read_embeddings(spark, path, dim=DIM)
    assert sorted((r.paper_id, r.period) for r in stored.select("paper_id", "period").collect()) == sorted(
        (r.paper_id, r.period) for r in papers.collect()
    )
    want = encoder(encode.with_text(papers).select("paper_id", "text")).withColumnRenamed("embedding", "e")
    assert stored.join(want, "paper_id").filter(F.abs(F.col("embedding")[0] - F.col("e")[0]) > 1e-3).count() == 0
    entries = mf.manifest_rows(embed.manifest(spark, last)).collect()
    counts = {r.period: r["count"] for r in papers.groupBy("period").count().collect()}
    assert {p: sum(e.num_papers for e in entries if e.period == p) for p in {e.period for e in entries}} == counts
    size = table.size_of(last)
    assert all(abs(sum(e.file_size_mb for e in entries if e.period == p) - size[p]) < 1e-9 for p in counts) and set(size) == set(counts)
    assert not tbl.lost(last) and embed.manifest(spark, last).first().total_papers == sum(counts.values())
    return {e.file_entry: e for e in entries}


def test_build_update_and_rebuild(spark, papers_of, tmp_path):
    path = str(tmp_path / "t")
    first, grown = corpus(papers_of, FIRST), corpus(papers_of, GROWN)
    embed.full_build(first, path, encoder, "m", DIM)
    before = agrees(spark, path, first)
    assert set(before) == {"b2000_part1", "b2000_part2", "2020s", "2025s"}
    embed.update(grown, path, encoder)
    after = agrees(spark, path, grown)
    assert after["2010s"].papers_added == 1 and after["2020s"].papers_added == 1 and after["b2000_part2"].num_papers == 5
    assert after["2025s"].created == before["2025s"].created and after["2020s"].created > before["2020s"].created
    parts = {(p.commit, p.partition): p for p in table.table_of(spark, path).version(0).parts}
    assert parts.keys() <= {(p.commit, p.partition) for p in table.table_of(spark, path).version().parts}  # nothing stored was rewritten

    # nothing new: no version
    n = table.table_of(spark, path).numbers()
    embed.update(grown, path, encoder)
    assert table.table_of(spark, path).numbers() == n

    # a rebuild of one period stamps its own entries only, and one of fewer papers leaves nothing behind
    embed.full_build(grown, path, encoder, "m", DIM, periods=["b2000"])
    rebuilt = agrees(spark, path, grown)
    assert rebuilt["b2000_part1"].created > after["b2000_part1"].created
    assert all(rebuilt[e].created == after[e].created for e in rebuilt if not e.startswith("b2000"))
    few = corpus(papers_of, [(1, 1991), (2, 1992)])
    embed.full_build(few, path, encoder, "m", DIM)
    assert set(agrees(spark, path, few)) == {"b2000_part1", "b2000_part2"}
    embed.full_build(few.limit(0), path, encoder, "m", DIM, periods=["b2000"])
    assert agrees(spark, path, few.limit(0)) == {}

    # older versions are still there to read
    assert table.read_embeddings(spark, path, version=0).count() == len(FIRST)
    assert [r.rows for r in table.table_of(spark, path).history().orderBy("version").collect()] == [14, 17, 17, 2, 0]
    with pytest.raises(ValueError, match="no version 9"):
        table.read_embeddings(spark, path, version=9)


def test_orphans_and_moved_papers(spark, papers_of, tmp_path):
    path = str(tmp_path / "t")
    embed.full_build(corpus(papers_of, GROWN), path, encoder, "m", DIM)
    moved = [(i, y) for i, y in GROWN if i not in (2, 41)]
    moved = [(i, 2012 if i == 3 else y) for i, y in moved] + [(50, 2016)]
    papers = corpus(papers_of, moved)
    embed.update(papers, path, encoder)
    entries = agrees(spark, path, papers)
    assert "2020s" in entries and entries["2015s"].num_papers == 1 and entries["b2000_part1"].papers_added < 0
    only_old = corpus(papers_of, [(1, 1991), (4, 1994)])
    embed.update(only_old, path, encoder)
    assert set(agrees(spark, path, only_old)) == {"b2000_part1", "b2000_part2"}


@pytest.mark.parametrize("work, step", [
    ("build", "publish"), ("update", "write"), ("update", "publish"), ("update", "told"), ("rebuild", "write"), ("rebuild", "told"),
])
def test_a_run_that_stops_is_made_good_by_the_next(spark, papers_of, tmp_path, monkeypatch, work, step):
    path, told = str(tmp_path / "t"), str(tmp_path / "manifest.json")
    first, grown = corpus(papers_of, FIRST), corpus(papers_of, GROWN[3:])

    def run():
        if work == "update":
            return embed.update(grown, path, encoder, manifest_path=told)
        return embed.full_build(grown, path, encoder, "m", DIM, told, ["b2000", "2010s", "2020s"] if work == "rebuild" else None)

    if work != "build":
        embed.full_build(first, path, encoder, "m", DIM, told)
    seen = table.read_embeddings(spark, path).count() if work != "build" else None

    def stop(*a, **k):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        if step == "write":  # the rows are written, nothing more
            plain = VersionedTable.write
            m.setattr(VersionedTable, "write", lambda self, rows: (plain(self, rows), stop()))
        elif step == "publish":
            m.setattr(VersionedTable, "publish", stop)
        else:
            m.setattr(embed, "_told", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            run()
    if step != "told" and seen is not None:
        assert table.read_embeddings(spark, path).count() == seen
    manifest = run()
    papers = grown if work != "rebuild" else grown.filter(F.col("period").isin("b2000", "2010s", "2020s")).unionByName(first.filter("period = '2025s'"))
    agrees(spark, path, papers)
    assert manifest.first().total_papers == papers.count() == mf.read_manifest(spark, told).first().total_papers

    # the folder of the stopped run goes, the rows stay
    tbl = table.table_of(spark, path)
    gone = tbl.vacuum(keep=1, min_age=0)
    named = {p.commit for p in tbl.version().parts}
    assert {n.partition("=")[2] for n, _, _ in tbl.folder.list("data")} == named and (step == "told" or gone)
    agrees(spark, path, papers)


def test_two_writers(spark, papers_of, tmp_path):
    tbl = VersionedTable(spark, str(tmp_path / "t"), "period")
    rows = corpus(papers_of, FIRST).select("paper_id", "period")
    one, two = tbl.write(rows), tbl.write(rows.limit(3))
    v0 = tbl.publish(None, one, rows.schema, "one", {})
    with pytest.raises(ConcurrentCommit):
        tbl.publish(None, two, rows.schema, "two", {})
    assert tbl.read(tbl.version()).count() == len(FIRST) and tbl.numbers() == [0]
    assert not [n for n, _, _ in tbl.folder.list("_versions") if n.endswith(".tmp")]
    tbl.publish(v0, two, rows.schema, "two", {})
    assert tbl.read(tbl.version()).count() == 3
    assert tbl.vacuum(keep=1) == []  # young folders may belong to a writer
    assert len(tbl.vacuum(keep=1, min_age=0)) == 1 and tbl.read(tbl.version()).count() == 3
    with pytest.raises(ValueError):
        tbl.vacuum(keep=0)


def test_lost_files_are_found(spark, papers_of, tmp_path):
    tbl = VersionedTable(spark, str(tmp_path / "t"), "period")
    rows = corpus(papers_of, FIRST).select("paper_id", "period")
    made = tbl.publish(None, tbl.write(rows), rows.schema, "one", {})
    assert tbl.lost(made) == []
    part = made.parts[0]
    folder = f"data/commit={part.commit}/period={part.partition}"
    tbl.folder.delete(f"{folder}/{next(n for n, _, _ in tbl.folder.list(folder) if n.endswith('.parquet'))}")
    assert tbl.lost(made) == [part]


def test_models_and_widths_do_not_mix(spark, papers_of, tmp_path):
    path = str(tmp_path / "t")
    papers = corpus(papers_of, FIRST)
    with pytest.raises(ValueError, match="build it first"):
        embed.update(papers, path, encoder)
    with pytest.raises(Exception, match="width"):
        embed.full_build(papers, path, lambda df: encode.hashing_encode(df, DIM + 1), "m", DIM)
    assert table.table_of(spark, path).version() is None
    embed.full_build(papers, path, encoder, "m", DIM)
    for change in ({"model_name": "other"}, {"dim": DIM + 1}):
        with pytest.raises(ValueError, match="build it anew"):
            embed.update(corpus(papers_of, GROWN), path, encoder, **change)
    with pytest.raises(ValueError, match="build it anew"):
        embed.full_build(papers, path, encoder, "other", DIM, periods=["b2000"])
    with pytest.raises(Exception, match="width"):
        table.read_embeddings(spark, path, dim=DIM + 1).agg(F.sum(F.col("embedding")[0])).collect()
    embed.full_build(papers, path, encoder, "other", DIM)
    assert table.read_embeddings(spark, path, "other").count() == len(FIRST) and table.read_embeddings(spark, path, "m").count() == 0
