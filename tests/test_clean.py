from pyspark.sql import functions as F

from litspark.operators import clean

RAW = [
    (0, "Same\n[x]", "a0", "http://u/1", "j", 2001),
    (1, "Same", "a1", "http://u/1", "j", 2002),
    (2, "Same", "a2", None, "j", 2003),
    (3, "Same", "a3", None, "j", 2003),
    (4, "Broken", "b", "http://hdl.handle.net/", "j", 2004),
    (5, "Broken", "b", "http://hdl.handle.net/", "j", 2004),
    (6, "Broken", "b", "https://hdl.handle.net/", "j", 2004),
    (7, "Review pp. 3", "r", "http://u/2", "j", 2005),
    (8, "No year", "n", "http://u/3", "j", None),
    (9, None, "no title", "http://u/4", "j", 2006),
]


def test_chain(papers_of):
    got = {r.ord: (r.title, r.url) for r in clean.clean_papers(papers_of(RAW)).collect()}
    assert got == {
        0: ("Same", "http://u/1"), 2: ("Same", None), 3: ("Same", None), 4: ("Broken", None), 6: ("Broken", None),
    }


def test_chain_does_not_depend_on_partitions(papers_of):
    want = sorted(map(tuple, clean.clean_papers(papers_of(RAW, 1)).collect()))
    assert sorted(map(tuple, clean.clean_papers(papers_of(RAW, 7)).collect())) == want


def test_chain_is_idempotent(papers_of):
    once = clean.clean_papers(papers_of(RAW))
    assert sorted(r.ord for r in clean.clean_papers(once).collect()) == sorted(r.ord for r in once.collect())


def test_hot_copies_and_many_rows_without_url(papers_of):
    rows = [(i, "copy", "a", "http://u", "j", 2000) for i in range(600)] + [
        (600 + i, "copy", "a", None, "j", 2000) for i in range(300)
    ]
    got = clean.clean_papers(papers_of(rows, 6))
    assert sorted(r.ord for r in got.collect()) == [0, *range(600, 900)]


def test_stage_counts(papers_of):
    got = {r.step: r.rows for r in clean.stage_counts(papers_of(RAW)).collect()}
    assert got == {
        "raw": 10, "missing_years": 1, "null_titles": 1, "book_reviews": 1, "duplicates": 2, "broken_links": 2, "kept": 5,
    }


def test_rejects(papers_of):
    assert [r.ord for r in clean.rejected(papers_of(RAW)).collect()] == [9]


def test_paper_id(papers_of):
    unique = clean.dedupe(clean.clean_titles(papers_of([
        *RAW, (10, "Same", "a2", None, "j", 2003), (11, None, "x", "http://u/9", "j", 2000),
    ])))
    keyed = clean.with_paper_id(unique.drop("paper_id"))
    ids = {r.ord: r.paper_id for r in keyed.collect()}
    assert len(set(ids.values())) == len(ids) == unique.count()
    # equal rows without url are numbered in order, so their keys do not depend on what else is there
    alone = papers_of([RAW[2], (10, "Same", "a2", None, "j", 2003)]).drop("paper_id")
    again = {r.ord: r.paper_id for r in clean.with_paper_id(alone).collect()}
    assert again == {o: ids[o] for o in (2, 10)}


def test_distinct_ratio(spark):
    df = spark.createDataFrame([(c, str(i)) for i, c in enumerate("aabbaabbaa")] + [(None, "x")], "few string, many string")
    for exact in (True, False):
        got = {r.column: (r.distinct_values, r.repetitive) for r in clean.distinct_ratio(df, ["few", "many"], exact).collect()}
        assert got == {"few": (2, True), "many": (11, False)}


def test_type_year(spark):
    df = spark.createDataFrame([(1, "2002.0"), (2, "x"), (3, None), (4, "1.5")], "i int, year string")
    good, bad = clean.type_year(df)
    assert {r.i: r.year for r in good.collect()} == {1: 2002, 3: None}
    assert dict(good.dtypes)["year"] == "smallint"
    assert {r.i: r.year for r in bad.collect()} == {2: "x", 4: "1.5"}


def test_missing_values(spark):
    df = spark.createDataFrame([("NA", "ok")], "a string, b string")
    assert clean.normalise_missing(df, ["a", "b"]).first() == (None, "ok")
    assert df.filter(F.col("a").isNull()).count() == 0
