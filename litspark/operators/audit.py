"""Integrity checks between papers, vectors, manifest and source files.

Checks give rows (check, period, expected, actual, passed, required); only required ones decide the
verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark import schema
from litspark.functions import periods, vectors
from litspark.functions.text import embedding_text
from litspark.operators.maintain import expected_entries, stale_periods
from litspark.operators.ranks import sample_k, small
from litspark.sources.staging import stage

CHECK_COLUMNS = ["check", "period", "expected", "actual", "passed", "required"]


def _check(df: DataFrame, name: str, period: Column, expected: Column, actual: Column, passed: Column, required: bool) -> DataFrame:
    return df.select(
        F.lit(name).alias("check"), period.cast("string").alias("period"), expected.cast("string").alias("expected"),
        actual.cast("string").alias("actual"), passed.alias("passed"), F.lit(required).alias("required"),
    )


def period_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy(periods.period_of(F.col("year")).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def missing_entries(entries: DataFrame) -> DataFrame:
    """(file_entry, present) for every file a complete table has."""
    known = entries.select("file_entry", F.lit(True).alias("known")).distinct()
    joined = expected_entries(entries.sparkSession).join(known, "file_entry", "left")
    return joined.select("file_entry", F.col("known").isNotNull().alias("present"))


def count_match(papers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: papers, vectors, papers without vector, vectors without paper, passed."""
    both = papers.select("paper_id", F.lit(1).alias("p")).join(
        embeddings.select("paper_id", F.lit(1).alias("v")), "paper_id", "full_outer"
    )
    return both.agg(
        F.count("p").alias("papers"), F.count("v").alias("vectors"),
        F.count(F.when(F.col("v").isNull(), 1)).alias("without_vector"),
        F.count(F.when(F.col("p").isNull(), 1)).alias("without_paper"),
    ).withColumn("passed", (F.col("without_vector") == 0) & (F.col("without_paper") == 0))


def manifest_vs_actual(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """(period, manifest_papers, actual_papers, passed); halves of a period are added up first."""
    listed = entries.groupBy("period").agg(F.sum("num_papers").alias("manifest_papers"))
    joined = listed.join(counts.withColumnRenamed("n", "actual_papers"), "period", "full_outer")
    filled = joined.select(
        "period", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("manifest_papers", "actual_papers")]
    )
    return filled.withColumn("passed", F.col("manifest_papers") == F.col("actual_papers"))


def norm_stats(embeddings: DataFrame, dim: int) -> DataFrame:
    """One row over all vectors: smallest, largest and mean length, not normalised, wrong width."""
    length = embeddings.select(vectors.norm(F.col("embedding")).alias("len"), F.size("embedding").alias("width"))
    return length.agg(
        F.count(F.lit(1)).alias("vectors"), F.min("len").alias("min_norm"), F.max("len").alias("max_norm"),
        F.avg("len").alias("mean_norm"), F.count(F.when(~vectors.is_unit(F.col("len")), 1)).alias("not_unit"),
        F.count(F.when(F.col("width") != dim, 1)).alias("wrong_width"),
    )


def split_check(papers: DataFrame) -> DataFrame:
    """(period, min_year, max_year, passed): the years of each stored period lie inside it."""
    return years_inside(papers.groupBy("period").agg(F.min("year").alias("min_year"), F.max("year").alias("max_year")))


def years_inside(ranges: DataFrame) -> DataFrame:
    """Ranges of years by stored period, with ``passed``: whether they lie inside it."""
    inside = F.lit(False)
    for name in schema.PERIOD_NAMES:
        here = periods.in_period(F.col("min_year"), name) & periods.in_period(F.col("max_year"), name)
        inside = inside | ((F.col("period") == name) & here)
    return ranges.withColumn("passed", inside)


def text_consistency(papers: DataFrame) -> DataFrame:
    """One row: papers whose text differs when a missing abstract is spelled out instead of left out."""
    spelled = F.concat(F.col("title"), F.lit(" "), F.coalesce("abstract", F.lit("<NA>")))
    differs = embedding_text(F.col("title"), F.col("abstract")) != spelled
    return papers.agg(
        F.count(F.lit(1)).alias("papers"), F.count(F.when(F.col("abstract").isNull(), 1)).alias("null_abstracts"),
        F.count(F.when(differs, 1)).alias("unequal"),
    )


def reencode_check(texts: DataFrame, stored: DataFrame, encode, k: int = 10, seed: int = 42) -> DataFrame:
    """One row: mean and smallest similarity of k re-encoded texts with their stored vectors.

    The few ids are broadcast, so neither table is shuffled.
    """
    chosen = sample_k(texts.select("paper_id"), k, seed, ["paper_id"])
    ids = small(chosen, k)
    fresh = encode(texts.join(ids, "paper_id", "left_semi")).select("paper_id", F.col("embedding").alias("fresh"))
    pairs = stored.join(ids, "paper_id", "left_semi").join(fresh, "paper_id")
    sims = pairs.select(vectors.dot(F.col("embedding"), F.col("fresh")).alias("s"))
    return sims.agg(
        F.count(F.lit(1)).alias("sampled"), F.avg("s").alias("mean_similarity"), F.min("s").alias("min_similarity"),
        (F.min("s") > 0.999).alias("passed"),
    )


def diagnose(raw_counts: DataFrame, paper_counts: DataFrame, vector_counts: DataFrame) -> DataFrame:
    """(section, period, n, verdict): counts per period and in total, and what their difference says."""
    def section(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.col("period"), F.col("n").cast("bigint").alias("n"))

    parts = section("raw", raw_counts).unionByName(section("papers", paper_counts)).unionByName(
        section("vectors", vector_counts)
    )
    totals = parts.groupBy("section").agg(F.sum("n").alias("n"))
    one = totals.agg(*[
        F.coalesce(F.sum(F.when(F.col("section") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("raw", "papers", "vectors")
    ])
    verdict = (
        F.when(F.col("vectors") > F.col("papers"), "more vectors than papers")
        .when(F.col("vectors") < F.col("papers"), "fewer vectors than papers")
        .otherwise("equal")
    )
    summary = one.select(
        verdict.alias("verdict"),
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("section"), c.cast("bigint").alias("n"))
            for s, c in {
                "raw_total": F.col("raw"), "papers_total": F.col("papers"), "vectors_total": F.col("vectors"),
                "removed_total": F.col("raw") - F.col("papers"),
            }.items()
        ])).alias("x"),
    ).select("x.section", F.lit("all").alias("period"), "x.n", "verdict")
    return parts.withColumn("verdict", F.lit("")).unionByName(summary)


def audit_facts(papers: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """What the checks need of both tables, from one scan of each: a few rows, by the period of the year and the stored period.

    year_period, period, papers, min_year, max_year, without_vector, vectors, without_paper, not_unit, wrong_width; vectors
    stand under null periods. Keys that repeat count as often as they stand, null keys match nothing. Rows of one key are
    added up before they meet, so a hot key is one row a task and a list of at most as many entries as there are periods.
    Spark's observed metrics would save the second grouping, but count rows of retried tasks again.
    """
    counted = {"papers": "bigint", "min_year": "int", "max_year": "int", "vectors": "bigint", "not_unit": "bigint", "wrong_width": "bigint"}
    of_papers = {"papers": F.lit(1), "min_year": F.col("year"), "max_year": F.col("year")}
    of_vectors = {
        "vectors": F.lit(1), "not_unit": (~vectors.is_unit(vectors.norm(F.col("embedding")))).cast("bigint"),
        "wrong_width": (F.size("embedding") != dim).cast("bigint"),
    }

    def rows(df: DataFrame, year_period: Column, period: Column, facts: dict[str, Column]) -> DataFrame:
        given = [facts.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in counted.items()]
        return df.select("paper_id", year_period.alias("year_period"), period.cast("string").alias("period"), *given)

    def added(**more: Column) -> list[Column]:
        ways = {"min_year": F.min, "max_year": F.max}
        return [F.coalesce(F.sum(c), F.lit(0)).alias(c) if c not in ways else ways[c](c).alias(c) for c in counted] + [x.alias(c) for c, x in more.items()]

    none = F.lit(None).cast("string")
    both = rows(papers, periods.period_of(F.col("year")), F.col("period"), of_papers).unionByName(rows(embeddings, none, none, of_vectors))
    by_key = both.groupBy("paper_id", "year_period", "period").agg(*added())
    met = by_key.groupBy("paper_id").agg(
        (F.sum("papers") > 0).alias("has_paper"), (F.sum("vectors") > 0).alias("has_vector"),
        F.collect_list(F.struct("year_period", "period", *counted)).alias("parts"),
    )
    flat = met.select("paper_id", "has_paper", "has_vector", F.explode("parts").alias("x")).select("paper_id", "has_paper", "has_vector", "x.*")
    known = F.col("paper_id").isNotNull()

    def alone(what: str, other: str) -> Column:
        return F.coalesce(F.sum(F.when(~(known & F.col(other)), F.col(what))), F.lit(0))

    return flat.groupBy("year_period", "period").agg(*added(without_vector=alone("papers", "has_vector"), without_paper=alone("vectors", "has_paper")))


def audit_report(
    papers: DataFrame, embeddings: DataFrame, entries: DataFrame, sources: DataFrame, dim: int = schema.DEFAULT_DIM
) -> DataFrame:
    """Every check as rows, and a last row ``all`` that holds when all required checks do.

    Each table is read once: what the checks need of papers and vectors, and the few manifest and source rows, are staged.
    """
    col, lit = F.col, F.lit
    none = lit("all")
    facts, entries, sources = (stage(df.coalesce(1)) for df in (audit_facts(papers, embeddings, dim), entries, sources))
    of_papers = facts.filter("papers > 0")
    counts = of_papers.groupBy(col("year_period").alias("period")).agg(F.sum("papers").alias("n"))
    names = ["papers", "vectors", "without_vector", "without_paper", "not_unit", "wrong_width"]
    match = facts.agg(*[F.coalesce(F.sum(c), lit(0)).alias(c) for c in names])
    versus = manifest_vs_actual(entries, counts)
    total = versus.agg(F.sum("manifest_papers").alias("m"), F.sum("actual_papers").alias("a"))
    years = years_inside(of_papers.groupBy("period").agg(F.min("min_year").alias("min_year"), F.max("max_year").alias("max_year")))
    checks = [
        _check(missing_entries(entries), "file_present", col("file_entry"), lit(True), col("present"), col("present"), True),
        _check(match, "count_match", none, col("papers"), col("vectors"), col("papers") == col("vectors"), True),
        _check(match, "papers_without_vector", none, lit(0), col("without_vector"), col("without_vector") == 0, True),
        _check(match, "vectors_without_paper", none, lit(0), col("without_paper"), col("without_paper") == 0, True),
        _check(total, "manifest_total", none, col("a"), col("m"), col("a") == col("m"), True),
        _check(versus, "manifest_period", col("period"), col("actual_papers"), col("manifest_papers"), col("passed"), True),
        _check(match, "vector_width", none, lit(0), col("wrong_width"), col("wrong_width") == 0, False),
        _check(match, "vector_norm", none, lit(0), col("not_unit"), col("not_unit") == 0, False),
        _check(years, "period_years", col("period"), lit(True), col("passed"), col("passed"), True),
        _check(stale_periods(sources, entries), "fresh", col("period"), lit(False), col("stale"), ~col("stale"), False),
        _check(entries, "file_size", col("file_entry"), lit(True), col("file_size_mb") < schema.MAX_FILE_MB,
               col("file_size_mb") < schema.MAX_FILE_MB, False),
    ]
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    # verdict by grouping the few rows twice: once as themselves, once as "all"
    overall = F.struct(
        lit("all").alias("check"), lit("all").alias("period"), lit("true").alias("expected"),
        lit(None).cast("string").alias("actual"), col("passed").alias("passed"), lit(True).alias("required"),
    )
    itself = F.struct(*[col(c).alias(c) for c in CHECK_COLUMNS])
    doubled = rows.select("passed", "required", F.explode(F.array(itself, overall)).alias("r"))
    verdict = F.bool_and(col("passed") | ~col("required"))
    grouped = doubled.groupBy("r.check", "r.period", "r.expected", "r.actual").agg(
        verdict.alias("ok"), F.bool_and("passed").alias("passed"), F.bool_and("r.required").alias("required")
    )
    is_all = col("check") == "all"
    return grouped.select(
        "check", "period", "expected", F.when(is_all, col("ok").cast("string")).otherwise(col("actual")).alias("actual"),
        F.when(is_all, col("ok")).otherwise(col("passed")).alias("passed"), "required",
    )
