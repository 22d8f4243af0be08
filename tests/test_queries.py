"""Every registered query against its SQL, and the shape of its plan."""

import duckdb
import pytest

import __spark_entry__ as entry
from litspark import fixtures as fx
from litspark.oracle import ORACLE
from litspark.queries import QUERIES
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# the six periods are the only table another one is compared with by range
RANGE_JOINS = {"period_range_join"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan
    if name not in RANGE_JOINS:
        assert "BroadcastNestedLoopJoin" not in plan
    said, _ = compare(spark, con, name, lambda *_: df, ORACLE[name], SF)
    assert said.startswith("ok"), said


def test_scan_is_pruned(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    plan = plan_of(entry.queries()["prefilter"](spark, SF))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [period" in scan and "2025s" not in scan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(year,1990)" in scan
    assert "abstract" not in scan and "title" not in scan


def test_copies_are_cut_before_the_shuffle(spark):
    plan = plan_of(entry.queries()["dedupe_papers"](spark, SF))
    above, below = plan.split("Exchange", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1


def test_search_leaves_the_abstract_behind(spark):
    plan = plan_of(entry.queries()["semantic_search"](spark, SF))
    assert plan.count("MapInArrow") == 1 and "abstract" not in plan.split("Exchange", 1)[0]


def test_snapshot_is_made_once(spark):
    assert fx.papers(spark, SF) is fx.papers(spark, SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
