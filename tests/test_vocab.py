"""Row-local counts, the threshold search for the leading terms, and word cutting in batches."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litspark import schema
from litspark.functions import text as text_functions
from litspark.functions.batches import WordCutter, word_characters
from litspark.operators import vocab

ODD = [
    None, "", "a b", "one_two 3x 4", "İstanbul ΣΑΣ straße Éa", "x́y ab́cd", "日本語 text 한국", "a\U00010400\U00010401 \U0001d7d8\U0001d7d9z",
    "tab\tnew\nline sep", "mixed-up it's e.g. U.S.A. ٣٤ ⅷⅸ", "the and of", "word " * 500,
]


def plain_counts(texts):
    ctf, df = Counter(), Counter()
    for words in texts:
        kept = [w for w in words if w not in schema.STOP_WORDS]
        found = kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])]
        ctf.update(found)
        df.update(set(found))
    return ctf, df


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of a skewed vocabulary, unlike from part to part, in many parts."""
    rnd = random.Random(5)
    common = [f"w{i:03d}" for i in range(300)]
    rows = []
    for d in range(240):
        own = [f"own{d // 60}x{i}" for i in range(40)]
        words = [common[min(299, int(rnd.expovariate(0.03)))] if rnd.random() < 0.7 else rnd.choice(own) for _ in range(rnd.randrange(0, 80))]
        rows.append((d, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "the of and"), (903, rows[5][1]), (903, rows[5][1])]
    return spark.createDataFrame(rows, "paper_id bigint, text string").repartition(6)


def test_batches_cut_words_as_expressions_do(spark):
    lowered = spark.createDataFrame([(t,) for t in ODD], "text string").select(F.lower("text").alias("text"))
    rows = lowered.select("text", text_functions.words(F.col("text")).alias("words")).collect()
    values, codes, of = WordCutter(word_characters(spark))(pa.array([r.text for r in rows], pa.string()))
    got = [[] for _ in rows]
    for c, d in zip(codes.tolist(), of.tolist()):
        got[d].append(values[c].as_py())
    assert got == [r.words or [] for r in rows]


def test_document_frequency(spark, corpus):
    rows = corpus.select(text_functions.words(F.lower("text")).alias("w")).collect()
    ctf, df = plain_counts([r.w or [] for r in rows])
    got = {r.term: (r.df, r.ctf) for r in vocab.document_frequency(corpus).collect()}
    assert got == {t: (df[t], ctf[t]) for t in ctf}
    plan = vocab.document_frequency(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "REPARTITION" not in plan


def test_terms_of_large_inputs_are_dealt_before_they_are_added_up(corpus, monkeypatch):
    """No aggregate holds the terms of a whole map task; the parts follow the texts' size."""
    want = {r.term: (r.df, r.ctf) for r in vocab.document_frequency(corpus).collect()}
    size = corpus.agg(F.sum(F.octet_length("text"))).first()[0]
    for name, value in (("PART_BYTES", 2000), ("UNSORTED", 4), ("LARGE_BYTES", size // 6), ("HELD", 50)):
        monkeypatch.setattr(vocab, name, value, raising=False)
    assert {r.term: (r.df, r.ctf) for r in vocab.document_frequency(corpus).collect()} == want
    plan = vocab.document_frequency(corpus)._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("hashpartitioning(term") :]
    assert "Aggregate" not in before and "MapInArrow" in before
    assert f"hashpartitioning(term#{before.split('term#')[1].split(',')[0]}, {-(-size // (size // 6))})" in before


@pytest.mark.parametrize("n, sent, held", [(10, 3, 400), (10, 12, 700), (40, 60, 10**6), (150, 20, 300), (25, 10**6, 10**6)])
@pytest.mark.parametrize("min_df, max_df", [(3, 0.3), (1, 1.0), (9, 0.08)])
def test_leading_terms_are_exact(spark, corpus, n, sent, held, min_df, max_df):
    rows = corpus.select(text_functions.words(F.lower("text")).alias("w")).collect()
    ctf, df = plain_counts([r.w or [] for r in rows])
    usable = [t for t in ctf if min_df <= df[t] <= max_df * len(rows)]
    want = [(t, df[t]) for t in sorted(usable, key=lambda t: (-ctf[t], t))[:n]]
    assert vocab.frequent_terms(corpus, len(rows), n, min_df, max_df, sent=sent, held=held, slice_bytes=700) == want


def test_unsent_terms_are_counted_again(spark, corpus, monkeypatch):
    asked = []
    plain = vocab.recount
    monkeypatch.setattr(vocab, "recount", lambda texts, terms, body: asked.append(len(terms)) or plain(texts, terms, body))
    vocab.frequent_terms(corpus, corpus.count(), 100, 1, 1.0, sent=120)
    assert asked and asked[0] < 100  # the few between the bounds, not the vocabulary


def test_later_attempts_hold_no_more_than_fits(spark, monkeypatch):
    """Of terms that are equally frequent no floor closes the rest: they are counted by shuffle, not all in each task."""
    rows = [(d, " ".join(f"t{d % 7}x{i}" for i in range(60))) for d in range(28)]
    flat = spark.createDataFrame(rows, "paper_id bigint, text string").repartition(4)
    ctf, df = plain_counts([t.split() for _, t in rows])
    asked = []
    plain = vocab._chunk_counts
    monkeypatch.setattr(vocab, "SENT", 40, raising=False)
    monkeypatch.setattr(vocab, "_chunk_counts", lambda texts, body, sent, held, size: asked.append((sent, held)) or plain(texts, body, sent, held, size))
    got = vocab.frequent_terms(flat, 28, 5, 1, 1.0, sent=3, held=20, slice_bytes=200)
    assert got == [(t, df[t]) for t in sorted(ctf, key=lambda t: (-ctf[t], t))[:5]]
    assert max(s for s, _ in asked) <= 40 and max(h for _, h in asked) <= 80


@pytest.mark.parametrize("sent, held", [(5, 30), (20, 60), (3, 8), (100, 50)])
def test_leaders_bound_every_term(sent, held):
    """Whatever was cut on the way: certain counts are too low, certain and open ones together are high enough."""
    rnd = random.Random(sent)
    leaders, ctf, df = vocab.Leaders(sent, held), Counter(), Counter()
    for _ in range(30):
        tables = []
        for _ in range(rnd.randrange(1, 4)):
            rows = {f"t{min(199, int(rnd.expovariate(0.05)))}": rnd.randrange(1, 9) for _ in range(rnd.randrange(40))}
            docs = {t: rnd.randrange(1, n + 1) for t, n in rows.items()}
            ctf.update(rows)
            df.update(docs)
            tables.append(vocab._table(pa.array(list(rows), pa.string()), list(rows.values()), list(docs.values())))
        leaders.add(tables)
    for last in (False, True):
        if last:
            leaders.cut(sent)
        known = {r["term"]: r for r in leaders.known.to_pylist()}
        assert len(known) <= (sent if last else max(held, sent))
        for t in ctf:
            if t not in known:
                assert ctf[t] <= leaders.total
            else:
                r, gain = known[t], leaders.total - known[t]["covered"]
                assert r["ctf"] <= ctf[t] <= r["ctf"] + gain and r["df"] <= df[t] <= r["df"] + gain


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "paper_id bigint, text string")
    assert vocab.tfidf_vocabulary(none).count() == 0
    assert vocab.document_frequency(none).count() == 0
    assert vocab.tfidf_vocabulary(spark.createDataFrame([(1, None), (2, "a")], "paper_id bigint, text string"), min_df=1).count() == 0
