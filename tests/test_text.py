import re

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from litspark import schema
from litspark.functions import keywords, periods, text, vectors


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def apply(spark, values, fn, kind="string"):
    rows = column(spark, values, kind).select("i", fn(F.col("c")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_missing_tokens(spark):
    tokens = ["", "NA", "N/A", "n/a", "nan", "NaN", "null", "NULL", "None", "<NA>", "#N/A"]
    assert apply(spark, tokens, text.na_normalise) == [None] * len(tokens)
    assert apply(spark, ["none of it", " ", "na"], text.na_normalise) == ["none of it", " ", "na"]


def test_year_text(spark):
    values = ["2002", "2002.0", "2002.5", "abc", None, "99999", "2002d", "2002f", "NaN", "2.002e3"]
    assert apply(spark, values, text.year_from_text) == [2002, 2002, None, None, None, None, None, None, None, 2002]


def test_titles(spark):
    cases = {
        "A\n[x y] B\nC": "A B C",
        "A\n[x\ny] B": "A [x y] B",
        "A\n[x y\rz] B": "A B",
        "A\n[a] [b]\n[c]": "A [b]",
        "plain": "plain",
    }
    assert apply(spark, list(cases), text.clean_title) == list(cases.values())
    assert [re.sub(r"\n", " ", re.sub(r"\n\[.*?\]", "", c)) for c in cases] == list(cases.values())


def test_reviews(spark):
    values = ["Book, PP. 3", "Book P.4", "app.", "Mp.", "fine"]
    assert apply(spark, values, text.is_book_review) == [True, True, True, False, False]


def test_real_abstract(spark):
    for pad in ["", "\t", " ", "\x1c", "  \n"]:
        values = [pad + "x" * 50 + pad, pad + "x" * 51 + pad]
        assert apply(spark, values, text.has_real_abstract) == [False, True]
    assert apply(spark, [None], text.has_real_abstract) == [False]
    assert set(schema.BLANKS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_stop_words_are_those_of_spark(spark):
    shipped = {w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w}
    assert set(schema.STOP_WORDS) == shipped


def test_words_match_python(spark):
    values = ["Ein Straßen-Test_1 a bb", "l'été 2020s x", "", "日本 語"]
    assert apply(spark, values, text.words) == [re.findall(r"\b\w\w+\b", v.lower()) for v in values]


def test_query_groups_by_hand():
    assert keywords.query_groups("a  b") == [["a"], [""], ["b"]]
    assert keywords.query_groups('"minimum wage" tax|levy') == [["minimum wage"], ["tax", "levy"]]
    assert keywords.query_groups('"a b"|c d') == [["a b", "c"], ["d"]]
    assert keywords.query_groups('un"bal x') == [["un"], ["bal"], ["x"]]
    assert keywords.query_groups('"" x') == [[""], ["x"]]
    assert keywords.query_groups("") == [[""]]
    assert keywords.query_groups('"') == []


QUERY = st.text(alphabet='ab "| \x1c\t', max_size=12)


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(QUERY, min_size=1, max_size=30))
def test_column_and_argument_forms_agree(spark, queries):
    assert apply(spark, queries, keywords.query_groups_col) == [keywords.query_groups(q) for q in queries]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(QUERY, st.lists(st.text(alphabet="abAB c", max_size=10), min_size=1, max_size=20))
def test_predicate_matches_plain_python(spark, query, infos):
    want = [all(any(t.upper() in i.upper() for t in g) for g in keywords.query_groups(query)) for i in infos]
    assert apply(spark, infos, lambda c: keywords.keyword_predicate(query, F.upper(c))) == want


def test_case_folding(spark):
    assert apply(spark, ["straße", "ı"], lambda c: keywords.keyword_predicate("ss|i", F.upper(c))) == [True, True]


def test_half_rounding_matches_numpy(spark):
    values = [0.1234567, 3e-5, -5.9e-8, 6.1e-5, 0.0, 1.0, -0.99999, 0.333333, 2.0**-24, 1000.3]
    row = spark.createDataFrame([([float(np.float32(v)) for v in values],)], "v array<float>")
    got = row.select(vectors.half_round(F.col("v")).alias("h")).first().h
    assert got == [float(np.float16(np.float32(v))) for v in values]


def test_normalise_and_unit_test(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r.v for r in rows.select(vectors.l2_normalise(F.col("v")).alias("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    lengths = [1.001, 0.999, 1.00102, 0.99898]
    assert apply(spark, lengths, vectors.is_unit, "double") == [True, True, False, False]


def test_periods(spark):
    years = [1850, 1999, 2000, 2009, 2010, 2014, 2015, 2019, 2020, 2024, 2025, 2999, None]
    want = ["b2000"] * 2 + ["2000s"] * 2 + ["2010s"] * 2 + ["2015s"] * 2 + ["2020s"] * 2 + ["2025s"] * 2 + [None]
    assert apply(spark, years, periods.period_of, "smallint") == want
    by_range = periods.by_range(column(spark, years, "smallint").withColumnRenamed("c", "year"), periods.period_dimension(spark))
    assert [r.found_period for r in by_range.orderBy("i").collect()] == want[:-1]
    assert periods.periods_between(1990, 2012) == ["b2000", "2000s", "2010s"]
    assert periods.periods_between(2025, 2030) == ["2025s"]


def test_citation(spark):
    rows = spark.createDataFrame(
        [("T", "u", "A", 2001, "j"), ("T", None, None, 2002, "j")], "title string, url string, authors string, year int, journal string"
    )
    lines = [r[0] for r in rows.select(text.citation_line(F.lit(1))).collect()]
    assert lines == ["1. [T](u). A. 2001. j.", "1. T. <NA>. 2002. j."]
    assert rows.select(text.citation_line(F.lit(2), F.lit(0.12345))).first()[0] == "2. 0.123 [T](u). A. 2001. j."
