"""Many literal texts at once: the index against plain search, its cost, and requests with filters."""

import random

import pytest

from litspark.functions.grams import GramIndex, QueryIndex
from litspark.operators import pairs, search
from litspark.streaming import alerts


def words(rnd, letters, n):
    return [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 4))) for _ in range(n)]


@pytest.mark.parametrize("n", [3, 40, 500])
def test_index_finds_what_plain_search_finds(n):
    rnd = random.Random(n)
    needles = sorted(set(words(rnd, "abé", n)))
    index = GramIndex(needles)
    for text in ["", "a", *words(rnd, "abéc", 60), *(" ".join(words(rnd, "abé", 30)) for _ in range(10))]:
        assert sorted(index.find(text)) == [k for k, t in enumerate(needles) if t in text]


def test_queries():
    rnd = random.Random(7)
    queries = [[sorted(set(words(rnd, "abcd", rnd.randrange(1, 3)))) + [""] * (rnd.random() < 0.2) for _ in range(rnd.randrange(1, 4))] for _ in range(300)]
    index = QueryIndex(queries)
    assert index.blank == [k for k, q in enumerate(queries) if all("" in g for g in q)] and index.blank
    for text in words(rnd, "abcd", 200) + [" ".join(words(rnd, "abcd", 9)) for _ in range(50)]:
        want = {k for k, q in enumerate(queries) if all(any(t in text for t in g) for g in q)}
        assert index.find(text) == want - set(index.blank)


def test_cost_follows_shared_grams_only():
    """100,000 needles that share no gram with a text cost nothing to it."""
    rnd = random.Random(1)
    far = sorted({"".join(rnd.choice("klmnopqrstuvwxyz") for _ in range(8)) for _ in range(100_000)})
    index = GramIndex(far + ["abc abd"])
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)) + " abc abd"
    assert index.find(text) == [len(far)] and index.verified == 1
    assert max(map(len, index.at.values())) < 600


def test_many_terms_in_titles(spark, papers_of):
    rnd = random.Random(2)
    papers = papers_of([(i, t.title(), None, "u", "aer", 2000) for i, t in enumerate(words(rnd, "abcde", 150))] + [(999, None, None, "u", "aer", 2000)])
    terms = list(dict.fromkeys(words(rnd, "abcde", 3000) + ["x" * 5 + str(i) for i in range(20_000)]))
    rnd.shuffle(terms)
    got = {r.paper_id: r.terms for r in pairs.paper_terms(papers, terms).collect()}
    titles = {r.paper_id: r.title for r in papers.collect() if r.title}
    want = {k: [t for t in terms if t in title.lower()] for k, title in titles.items()}
    assert got == {k: v for k, v in want.items() if v}


@pytest.fixture(scope="module")
def papers(papers_of):
    rnd = random.Random(3)
    rows = [(i, t, " ".join(words(rnd, "abc", 4)), "u", rnd.choice(["aer", "jpe", None]), rnd.choice([1990, 2000, 2010])) for i, t in enumerate(words(rnd, "abcd", 120))]
    return papers_of(rows)


def test_requests_with_filters_equal_single_searches(spark, papers, monkeypatch):
    rnd = random.Random(4)
    asked = [
        (k, rnd.choice(["", " ", "a|b", *words(rnd, "abc", 20)]), rnd.choice([None, None, ["aer"], ["jpe", "aer"], []]), rnd.choice([None, 1995]), rnd.choice([None, 2005]))
        for k in range(120)
    ] + [(500, None, None, None, None)]
    queries = spark.createDataFrame(asked, "query_id long, query string, journals array<string>, year_from int, year_to int")
    rows = [(r.paper_id, f"{r.title} {r.abstract}".upper(), r.journal, r.year, r.ord) for r in papers.collect()]
    want = {}
    for k, q, journals, low, high in asked[:-1]:
        terms = [t.split("|") for t in q.split(" ")]
        hits = [
            r for r in rows if all(any(t.upper() in r[1] for t in g) for g in terms) and (journals is None or r[2] in journals)
            and (low is None or r[3] >= low) and (high is None or r[3] <= high)
        ]
        if hits:
            want[k] = [r[0] for r in sorted(hits, key=lambda r: (-r[3], r[4]))[:5]]
    for per_pass in (200_000, 50):
        monkeypatch.setattr(search, "QUERIES_PER_PASS", per_pass)
        got = search.keyword_search_batch(papers, queries, 5).orderBy("query_id", "rank").collect()
        assert {k: [r.paper_id for r in got if r.query_id == k] for k in {r.query_id for r in got}} == want
        assert all(r.title for r in got)


def test_blank_requests_are_listed_once_per_filter(spark, papers):
    requests = [(k, [[""]], None, None, None) for k in range(50)] + [(90, [["a", ""]], None, 2005, None), (91, [["A"]], None, None, None)]
    rows = search.matching_rows(papers, requests, ["paper_id"]).groupBy("q").count().collect()
    assert {r.q for r in rows} == {0, 50, 51} and next(r["count"] for r in rows if r.q == 0) == papers.count()
    assert search.listed_requests(requests)[49] == (0, 49)


def test_many_saved_searches_on_a_stream(spark, tmp_path, papers, monkeypatch):
    path = str(tmp_path / "in")
    papers.write.parquet(path)
    rnd = random.Random(5)
    queries = [(k, q) for k, q in enumerate(["", "", *words(rnd, "abcd", 150)])]
    stream = alerts.saved_search_stream(spark.readStream.schema(papers.schema).parquet(path), queries)
    stream.writeStream.format("memory").queryName("many").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.query_id, r.paper_id) for r in spark.table("many").collect())
    monkeypatch.setattr(alerts, "LITERALS", 10**6)
    few = alerts.saved_search_stream(papers, queries)
    assert got == sorted((r.query_id, r.paper_id) for r in few.collect())
