"""Snapshots that later applications find."""

import os
import time

import pytest

from litspark.sources import staging


@pytest.fixture
def source(tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(shared))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("one")
    return shared, str(tmp_path / "src")


def test_found_by_the_next_application(spark, source, monkeypatch):
    shared, src = source
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(1, "007"), (2, "x")], "i int, p string")

    def read():
        return sorted(map(tuple, staging.snapshot(spark, "t", src, build, ["p"]).collect()))

    assert read() == read() == [(1, "007"), (2, "x")] and len(built) == 1  # texts stay texts in folder names
    monkeypatch.setattr(staging, "_snapshots", {})  # what another application starts with
    assert read() == [(1, "007"), (2, "x")] and len(built) == 1
    with open(f"{src}/a.txt", "a") as f:
        f.write("more")
    read()
    assert len(built) == 2
    monkeypatch.setattr(staging, "code_stamp", lambda: "newer")
    read()
    assert len(built) == 3


def test_first_writer_counts_and_old_ones_go(spark, source, monkeypatch):
    shared, src = source

    def slow():  # another writer is done before this one
        monkeypatch.setattr(staging, "_snapshots", {})
        staging.snapshot(spark, "t", src, lambda: spark.range(1))
        return spark.range(5)

    assert staging.snapshot(spark, "t", src, slow).count() == 1
    folder = shared / staging.SNAPSHOTS
    assert len(os.listdir(folder)) == 1 and staging.evict_snapshots(spark, 3600) == []
    time.sleep(1.1)
    assert len(staging.evict_snapshots(spark, 1)) == 1 and not os.listdir(folder)
    assert staging.snapshot(spark, "t", src, lambda: spark.range(7)).count() == 7


def test_a_stopped_writer_leaves_nothing_to_read(spark, source, monkeypatch):
    shared, src = source
    with monkeypatch.context() as m:
        m.setattr(staging.Folder, "move", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            staging.snapshot(spark, "t", src, lambda: spark.range(5))
    assert staging.snapshot(spark, "t", src, lambda: spark.range(3)).count() == 3
