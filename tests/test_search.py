import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark import schema
from litspark.functions import periods
from litspark.operators import audit, encode, search, semantic
from litspark.plans import search as plan

ROWS = [
    (0, "Minimum wage", "x" * 60, "u", "aer", 2001),
    (1, "Tax and wages", "minimum " * 10, None, "jpe", 2002),
    (2, "Levy", None, "u", "qje", 2002),
    (3, "Other", "short", "u", None, 2003),
    (4, "Trade tax", "y" * 80, "u", "jep", 1979),
]


@pytest.fixture(scope="module")
def papers(papers_of):
    return papers_of(ROWS)


def ids(df):
    return [r.paper_id for r in df.collect()]


def test_keyword_search(papers):
    assert ids(search.keyword_search(papers, "tax|levy")) == [1, 2, 4]
    assert ids(search.keyword_search(papers, "tax|levy", sort="early")) == [4, 1, 2]
    assert ids(search.keyword_search(papers, '"minimum wage"')) == [0]
    assert ids(search.keyword_search(papers, "wage minimum")) == [1, 0]
    assert ids(search.keyword_search(papers, "", limit=2)) == [3, 1]
    assert ids(search.keyword_search(papers, "author")) == []
    assert len(ids(search.keyword_search(papers, "author", search_author=True))) == 5
    assert ids(search.keyword_search(papers, "", ["aer", "jpe", "qje"], 2001, 2001)) == [0]


def test_null_journal_is_never_selected(papers):
    assert 3 not in ids(search.prefilter(papers, schema.CORE_JOURNALS))


def test_journal_groups(spark, papers):
    assert search.expand_journals(["top5", "jep"]) == sorted(["aer", "jpe", "qje", "ecta", "restud", "jep"])
    assert len(search.expand_journals(["all"])) == 36 and len(search.expand_journals(["all"], full=True)) == 91
    groups = search.group_dimension(spark)
    assert sorted(ids(search.in_journal_groups(papers, groups, ["top5"]))) == [0, 1, 2]
    names = {r.journal: r.journal_name for r in search.journal_dimension(spark).collect()}
    assert names["aer"] == "American Economic Review"
    assert sorted(j for j, n in names.items() if n is None) == ["ectt", "jems", "jes", "ntj"]
    assert {"jecsur", "jemstr"} <= set(names)


def test_batch_equals_single(spark, papers, monkeypatch):
    asked = [(1, "tax|levy"), (2, ""), (3, '"minimum wage"'), (4, "wage  minimum"), (5, "none such"), (6, '"')]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    want = {i: ids(search.keyword_search(papers, q, limit=3)) for i, q in asked}
    for per_pass in (2000, 2):
        monkeypatch.setattr(search, "QUERIES_PER_PASS", per_pass)
        got = search.keyword_search_batch(papers, queries, limit=3).orderBy("query_id", "rank").collect()
        assert {i: [r.paper_id for r in got if r.query_id == i] for i, _ in asked} == want


def test_plan_defaults(papers):
    assert ids(plan.keyword(papers, "tax")) == [1]  # from 1980, core journals
    assert ids(plan.keyword(papers, "", ["survey"], year_from=1900)) == [4]
    assert len(ids(plan.keyword(papers, "", random_roll=True))) == 1


def test_citations(papers):
    lines = [r.line for r in search.citations(search.keyword_search(papers, "tax|levy")).orderBy("rank").collect()]
    assert lines[0] == "1. Tax and wages. A. Author. 2002. jpe."
    assert lines[1] == "2. [Levy](u). A. Author. 2002. qje."


def make_vectors(spark, matrix, start=0):
    rows = [(start + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "paper_id bigint, embedding array<float>").repartition(5)


def unit(rng, n, d):
    m = rng.normal(size=(n, d)).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_nearest_is_exact_with_masses_of_equal_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m = unit(rng, 300, 8)
    m[100:250] = m[100]  # half of the table is one vector
    probes = [(i, m[i]) for i in (0, 100, 120, 299)]
    want = {}
    for i, v in probes:
        s = np.round(m.astype(float) @ np.asarray(v, dtype=float), 9)
        want[i] = [int(j) for j in np.lexsort((np.arange(300), -s))[:5]]
    for values in (4_000_000, 8):  # all probes at once, and one probe per pass
        monkeypatch.setattr(semantic, "QUERY_VALUES", values)
        got = semantic.self_match(make_vectors(spark, m), probes).orderBy("probe_id", "rank").collect()
        assert {i: [r.paper_id for r in got if r.probe_id == i] for i, _ in probes} == want
        aligned = {r.probe_id: r.aligned for r in got if r.rank == 1}
        assert aligned == {0: True, 100: True, 120: False, 299: True}


def test_vectors_of_another_width_are_left_out(spark):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None)], "paper_id bigint, embedding array<float>")
    assert [tuple(r) for r in semantic.dot_scores(odd, [0.5, 1.0]).collect()] == [(1, 0.5)]


def test_string_keys(spark):
    v = make_vectors(spark, np.eye(3)).withColumn("paper_id", F.col("paper_id").cast("string"))
    got = semantic.nearest(v, [(7, [1.0, 0.0, 0.0])], 2).orderBy(F.desc("similarity"), "paper_id").collect()
    assert [tuple(r) for r in got] == [(7, "0", 1.0), (7, "1", 0.0)]


def test_semantic_search(spark, papers):
    v = make_vectors(spark, [[1, 0], [0.6, 0.8], [0.9, 0.1], [0.8, 0.6], [0.7, 0.7]])
    assert ids(semantic.semantic_search(papers, v, [1, 0], min_similarity=0.5, sort="best")) == [0, 4, 1]
    assert ids(semantic.semantic_search(papers, v, [1, 0], min_similarity=0.5)) == [1, 0, 4]
    assert ids(semantic.semantic_search(papers, v, [1, 0], min_similarity=0.5, sort="early_similar")) == [4, 0, 1]
    assert ids(semantic.semantic_search(papers, v, [1, 0], min_similarity=0.65, sort="best", limit=1)) == [0]
    assert ids(semantic.semantic_search(papers, v, [1, 0], ["aer"], 1990, 2020)) == [0]
    assert plan.similarity_count(papers, v, [1, 0], 0.5).first()[0] == 3
    batch = semantic.semantic_search_batch(papers, v, [(1, [1, 0]), (2, [0, 1])], 0.1, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.paper_id) for r in batch] == [(1, 0), (1, 4), (2, 1), (2, 4)]


def test_period_pruning_of_vectors(spark, papers):
    v = make_vectors(spark, [[1, 0]] * 5).withColumn("period", F.when(F.col("paper_id") == 0, "2000s").otherwise("b2000"))
    assert ids(semantic.semantic_search(papers, v, [1, 0], None, 2001, 2005)) == [0]


def test_text_search_and_blank_query(spark, papers):
    stored = encode.hashing_encode(encode.with_text(papers), 32)
    assert stored.count() == 5
    assert ids(plan.similar(papers, stored, "minimum wage", 32, min_similarity=0.3, year_from=1900))[:1] in ([0], [1])
    assert ids(plan.similar(papers, stored, "  ", 32, min_similarity=0.0)) == []


def test_hashing_encoder_equals_a_model_that_hashes(spark, papers):
    def make_predict():
        import hashlib
        import re

        import numpy as np

        def predict(texts):
            out = np.zeros((len(texts), 32), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in re.findall(r"\w{2,}", t.lower()):
                    h = hashlib.md5(w.encode()).hexdigest()
                    out[i, int(h[:8], 16) % 32] += 1 - 2 * (int(h[8], 16) % 2)
            return out

        return predict

    texts = encode.with_text(papers).unionByName(
        encode.with_text(papers).limit(1).withColumns({"paper_id": F.lit(99).cast("bigint"), "text": F.lit("? !")})
    )
    a = {r.paper_id: r.embedding for r in encode.hashing_encode(texts, 32).collect()}
    b = {r.paper_id: r.embedding for r in encode.model_encode(texts, make_predict).collect()}
    assert a.keys() == b.keys() and a[99] == [0.0] * 32
    for k in a:
        assert np.allclose(a[k], b[k], atol=1e-6)


def test_reencode_check(spark, papers):
    texts = encode.with_text(papers).select("paper_id", "text")
    stored = encode.hashing_encode(texts, 32)
    good = audit.reencode_check(texts, stored, lambda df: encode.hashing_encode(df, 32), k=3).first()
    assert good.sampled == 3 and good.passed and abs(good.min_similarity - 1) < 1e-6
    wrong = stored.withColumn("embedding", F.reverse("embedding"))
    assert not audit.reencode_check(texts, wrong, lambda df: encode.hashing_encode(df, 32), k=3).first().passed


def test_counts_and_norms(spark, papers):
    v = make_vectors(spark, [[1.0, 0.0], [0.0, 2.0]], start=4)
    got = audit.count_match(papers, v).first()
    assert tuple(got) == (5, 2, 4, 1, False)
    norms = audit.norm_stats(v, 3).first()
    assert (norms.vectors, norms.min_norm, norms.max_norm, norms.not_unit, norms.wrong_width) == (2, 1.0, 2.0, 1, 2)


def test_audit_reads_each_table_once(spark, papers, tmp_path):
    wide = make_vectors(spark, [[1.0, 0.0], [0.0, 2.0], [1.0]], start=4)
    twice = papers.unionByName(papers.limit(1)).unionByName(papers.limit(1).withColumn("paper_id", F.lit(None).cast(papers.schema["paper_id"].dataType)))
    twice, stored = twice.withColumn("period", periods.period_of(F.col("year"))), []
    for name, df in (("papers", twice), ("vectors", wide)):
        df.write.parquet(f"{tmp_path}/{name}")
        stored.append(spark.read.parquet(f"{tmp_path}/{name}"))
    facts = audit.audit_facts(*stored, 2)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "Join" not in plan
    got = facts.agg(*[F.sum(c) for c in ("papers", "vectors", "without_vector", "without_paper", "not_unit", "wrong_width")]).first()
    assert tuple(got) == (7, 3, 6, 2, 1, 1)
    whole = facts.agg(F.min("min_year"), F.max("max_year")).first()
    assert tuple(whole) == tuple(twice.agg(F.min("year"), F.max("year")).first())
    empty = audit.audit_facts(stored[0].limit(0), stored[1].limit(0), 2)
    assert empty.count() == 0


def test_open_year_bounds(papers_of):
    papers = papers_of([(i, f"t{i}", "a", "u", "aer", 1990 + i) for i in range(30)])
    assert search.prefilter(papers, year_from=2010).count() == 10
    assert search.prefilter(papers, year_to=1999).count() == 10


def test_no_journal_selected_finds_nothing(papers_of):
    papers = papers_of([(0, "t", "a", "u", "aer", 1990)])
    assert plan.keyword(papers, "t", journals=[]).count() == 0
    assert plan.keyword(papers, "t").count() == 1
