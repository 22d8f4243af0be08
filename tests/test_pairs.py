import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from litspark import schema
from litspark.operators import pairs, vocab
from litspark.plans import training


@pytest.fixture(scope="module")
def papers(papers_of):
    words = "wage tax trade bank growth policy labor market price demand".split()
    rows = []
    for i in range(240):
        journal = "hot" if i % 3 else f"j{i % 7}"
        title = f"{words[i % 10]} and {words[(i * 3 + 1) % 10]}"
        rows.append((i, title, (f"{words[i % 7]} study {i} " * 6) if i % 5 else None, f"u{i}", journal, 1990 + i % 36))
    return papers_of(rows)


def collect(df):
    return df.select("kind", "pair_key", "text_a", "text_b", "label").collect()


def test_title_abstract(papers):
    made = collect(pairs.title_abstract(papers, 100))
    assert len(made) == 40 and len({r.pair_key for r in made}) == 40
    assert all(r.label == 1.0 for r in made)
    cut = pairs.cut_texts(pairs.title_abstract(papers, 100), 12)
    assert {len(r.text_b) for r in collect(cut)} == {12}
    assert len(collect(pairs.title_abstract(papers, 100000))) == 192


def test_journal_year(papers):
    flat = papers.withColumn("year", F.lit(2000).cast("smallint"))
    made = pairs.journal_year(flat, 100000, per_group=20)
    by_id = {r.paper_id: r for r in flat.collect()}
    seen, groups = [], Counter()
    for r in made.collect():
        a, b = (int(x) for x in r.pair_key.split("/")[1].split("-"))
        assert by_id[a].journal == by_id[b].journal and a != b and r.label == 0.7
        seen += [a, b]
        groups[by_id[a].journal] += 1
    assert len(seen) == len(set(seen))
    sizes = Counter(r.journal for r in by_id.values())
    assert groups == {j: min(20, n // 2) for j, n in sizes.items()}


@pytest.mark.parametrize("balanced", [False, True])
def test_journal_year_cap(papers, balanced):
    flat = papers.withColumn("year", F.lit(2000).cast("smallint"))
    made = pairs.journal_year(flat, 48, balanced=balanced).collect()
    assert len(made) == 12
    if not balanced:
        first = {int(r.pair_key.split("/")[1].split("-")[0]) for r in made}
        journals = {r.journal for r in flat.filter(F.col("paper_id").isin(first)).collect()}
        assert journals == {"hot"}  # filled in key order


def test_paper_terms(papers):
    found = pairs.paper_terms(papers, ["trade", "wage", "and tax", "rad"])
    got = {r.paper_id: r.terms for r in found.collect()}
    for r in papers.collect():
        want = [t for t in ["trade", "wage", "and tax", "rad"] if t in r.title.lower()]
        assert got.get(r.paper_id, []) == want
    assert pairs.paper_terms(papers, []).count() == 0


def test_query_pairs(papers):
    terms = ["wage", "tax", "trade"]
    made = training.query_pairs(papers, terms, 400)
    rows = collect(made)
    assert len(rows) == 100
    shapes = [re.compile(t.replace("{}", "(.+)") + "$") for t in schema.QUERY_TEMPLATES]
    allowed = set(terms) | set(schema.TEMPLATE_FILLERS)
    for r in rows:
        fits = [m.groups() for m in (s.match(r.text_a) for s in shapes) if m]
        assert any(set(g) <= allowed and len(set(g)) == len(g) for g in fits)
        title = " ".join(r.text_b.split()[:3])
        assert any(t in title for t in terms) and r.label == 0.9
    assert collect(training.query_pairs(papers, ["nowhere"], 400)) == []


def test_negative_pairs(papers):
    rows = collect(pairs.negative(papers, 3000))
    old = papers.filter("year < 2000").count()
    new = papers.filter("year > 2015").count()
    years = {r.text: (r.year, r.journal) for r in papers.withColumn(
        "text", F.concat("title", F.lit(" "), F.coalesce("abstract", F.lit("")))).collect()}
    crossed = [r for r in rows if int(r.pair_key.split("/")[1]) < min(300, old, new)]
    assert len(crossed) == min(300, old, new)
    rest = [r for r in rows if r not in crossed]
    assert 0 < len(rest) <= 300 - len(crossed)
    assert all(r.label == 0.1 for r in rows)
    for r in rest:
        if "study" in r.text_a and "study" in r.text_b:
            assert years[r.text_a][1] != years[r.text_b][1]


def test_negative_pairs_without_old_papers(papers):
    new = papers.filter("year > 2015")
    rows = collect(pairs.negative(new, 500))
    assert 0 < len(rows) <= 50


def test_assemble_and_summary(papers):
    made = training.training_pairs(papers, ["wage", "tax"], 200)
    rows = collect(made)
    assert len(rows) <= 200 and len({r.pair_key for r in rows}) == len(rows)
    summary = pairs.pair_summary(made, ["wage"], F.lit(2)).first()
    assert summary.training_examples == len(rows) == sum(summary[f"{k}_pairs"] for k in schema.PAIR_LABELS)
    assert summary.query_pairs == 50 and summary.title_abstract_pairs == 80


def test_small_fixed(papers):
    rows = pairs.small_fixed(papers, journals=2, per_journal=4, abstracts=10).collect()
    assert Counter(r.kind for r in rows) == {"title_abstract": 10, "consecutive": 6}


def plain_tfidf(texts, n_terms, min_df, max_df):
    docs = []
    for t in texts:
        ws = [w for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in schema.STOP_WORDS]
        docs.append(Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]))
    n = len(docs)
    df, ctf = Counter(), Counter()
    for d in docs:
        df.update(d.keys())
        ctf.update(d)
    kept = sorted((t for t in df if min_df <= df[t] <= max_df * n), key=lambda t: (-ctf[t], t))[:n_terms]
    scores = Counter()
    for d in docs:
        w = {t: d[t] * (math.log((1 + n) / (1 + df[t])) + 1) for t in kept if t in d}
        length = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            scores[t] += x / length
    return {t: round(s, 6) for t, s in scores.items()}


@pytest.mark.parametrize("n_terms", [8, 3000])
def test_vocabulary_matches_plain_python(spark, papers, n_terms):
    texts = papers.select("paper_id", F.concat("title", F.lit(" "), F.coalesce("abstract", F.lit(""))).alias("text"))
    got = {r.term: r.score for r in vocab.tfidf_vocabulary(texts, n_terms, sample=None).collect()}
    want = plain_tfidf([r.text for r in texts.collect()], n_terms, 3, 0.3)
    assert got.keys() == want.keys()
    assert all(abs(got[t] - want[t]) < 2e-6 for t in got)
    ranked = vocab.top_terms(spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "term string, score double"), 2)
    assert ranked == ["c", "a"]
