"""Labelled text pairs for training."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark import schema
from litspark.functions import text
from litspark.functions.batches import slices
from litspark.functions.grams import GramIndex
from litspark.functions.text import seeded_hash
from litspark.operators.ranks import draw_position, first_k, hash_blocks, rows_at, sample_k, small, top_k
from litspark.operators.search import top_journals
from litspark.sources.staging import stage

COLUMNS = ["kind", "pair_key", "text_a", "text_b", "label"]


def cut_texts(df: DataFrame, text_chars: int) -> DataFrame:
    """Pairs with both texts cut to a length, for models that read no more."""
    return df.withColumns({c: F.substring(c, 1, text_chars) for c in ("text_a", "text_b")})


def _pairs(df: DataFrame, kind: str, key: Column, a: Column, b: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"), F.concat_ws("/", F.lit(kind), key).alias("pair_key"), a.alias("text_a"),
        b.alias("text_b"), F.lit(schema.PAIR_LABELS[kind]).alias("label"),
    )


def _key(c: str) -> Column:
    return F.col(c).cast("string")


def title_abstract(papers: DataFrame, n: int = schema.PAIR_TOTAL, seed: int = 42) -> DataFrame:
    """Title and abstract of up to 40 % n papers whose abstract has more than 50 characters."""
    valid = papers.filter(F.length("abstract") > 50)
    chosen = sample_k(valid, n * 4 // 10, seed, ["paper_id"])
    return _pairs(chosen, "title_abstract", _key("paper_id"), F.col("title"), F.col("abstract"))


def journal_year(
    papers: DataFrame, n: int = schema.PAIR_TOTAL, per_group: int = 20, seed: int = 42, balanced: bool = False
) -> DataFrame:
    """Pairs within a journal and year: at most ``per_group`` a group, n // 4 in all.

    The first ``2 * per_group`` rows of a group in hash order are cut off on the map side, so a group
    of any size costs the same, then neighbours are paired. The total is filled in key order, or in
    hash order if balanced.
    """
    group = ["journal", "year"]
    order = [seeded_hash(seed, F.col("paper_id")), F.col("paper_id")]
    rows = papers.filter(F.col("journal").isNotNull()).select(
        *group, "paper_id", text.embedding_text(F.col("title"), F.col("abstract")).alias("body")
    )
    few = top_k(rows, 2 * per_group, order, by=group)
    along = Window.partitionBy(*group).orderBy(*order)
    paired = (
        few.withColumns({
            "place": F.row_number().over(along), "next_body": F.lead("body").over(along),
            "next_id": F.lead("paper_id").over(along),
        })
        .filter((F.col("place") % 2 == 1) & F.col("next_id").isNotNull())
        .withColumn("pair_no", ((F.col("place") + 1) / 2).cast("int"))
    )
    # staged: at most per_group rows a group are left, and the cut to n // 4 reads them three times
    paired = stage(paired.select(*group, "pair_no", "paper_id", "next_id", "body", "next_body"))
    fill = F.struct("journal", "year", "pair_no")
    group_no = F.struct("journal", "year")
    if balanced:
        place = seeded_hash(seed, F.col("journal"), F.col("year"), F.col("pair_no"))
        fill, group_no = F.struct(place.alias("h"), "journal", "year", "pair_no"), F.substring(place, 1, 4)
    chosen = first_k(paired, n // 4, fill, group_no)
    key = F.concat_ws("-", _key("paper_id"), _key("next_id"))
    return _pairs(chosen, "journal_year", key, F.col("body"), F.col("next_body"))


def paper_terms(papers: DataFrame, terms: list[str]) -> DataFrame:
    """(paper_id, terms array): the given terms found in each title, in the given order.

    The terms, an argument, stand in an index by their rarest gram; a title looks up its own grams and verifies what they
    name, so its cost does not follow the number of terms. Nothing is joined.
    """
    schema_out = T.StructType([papers.schema["paper_id"], T.StructField("terms", T.ArrayType(T.StringType()))])
    wanted = papers.sparkSession.sparkContext.broadcast(list(dict.fromkeys(terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        index = GramIndex([t for t in known if t])
        number = [k for k, t in enumerate(known) if t]
        always = [k for k, t in enumerate(known) if not t]
        for batch in slices(batches, "_title"):
            found = [sorted([number[k] for k in index.find(t)] + always) for t in batch.column("_title").to_pylist()]
            at = [i for i, f in enumerate(found) if f]
            names = pa.array([[known[k] for k in found[i]] for i in at], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("paper_id").take(pa.array(at, pa.int64())), names], names=schema_out.names)

    titles = papers.filter(F.col("title").isNotNull()).select("paper_id", F.lower("title").alias("_title"))
    return titles.mapInArrow(run, schema_out)


def _fill_template(template: str, words: Column) -> Column:
    parts = template.split("{}")
    pieces = [F.lit(parts[0])]
    for i, tail in enumerate(parts[1:]):
        pieces += [F.element_at(words, i + 1), F.lit(tail)]
    return F.concat(*pieces)


def query_text(draw: Column, terms: Column, seed: int) -> Column:
    """A drawn template filled with drawn terms of one paper, fillers where terms are short."""
    choice = draw_position(seed, "template", draw, F.lit(len(schema.QUERY_TEMPLATES)))
    mixed = F.array_sort(
        F.transform(terms, lambda t: F.struct(seeded_hash(seed, F.lit("term"), draw, t).alias("h"), t.alias("t")))
    )
    drawn = F.transform(mixed, lambda x: x["t"])
    fillers = F.array(*[F.lit(w) for w in schema.TEMPLATE_FILLERS])
    made = F.lit(None).cast("string")
    for i, template in enumerate(schema.QUERY_TEMPLATES):
        slots = template.count("{}")
        words = F.concat(F.slice(drawn, 1, slots), fillers)
        made = F.when(choice == i, _fill_template(template, words)).otherwise(made)
    return made


def query_document(papers: DataFrame, termed: DataFrame, n: int = schema.PAIR_TOTAL, seed: int = 42) -> DataFrame:
    """n // 4 made-up queries, each for a paper drawn with replacement from (paper_id, terms).

    Draws name positions in hash order; only the hash blocks they fall into are numbered. The drawn
    keys, at most n // 4, then pick the papers.
    """
    spark = papers.sparkSession
    blocks = hash_blocks(termed, seed, ["paper_id"])
    total = blocks.agg(F.sum("n")).scalar()
    draws = spark.range(n // 4).select(
        F.col("id").alias("tag"), draw_position(seed, "query", F.col("id"), total).alias("pos")
    ).filter(F.col("pos").isNotNull())
    drawn = rows_at(termed.select("paper_id"), draws, seed, ["paper_id"], blocks, n // 4)
    asked = (
        termed.join(small(drawn, n // 4), "paper_id")
        .select("paper_id", "tag", query_text(F.col("tag"), F.col("terms"), seed).alias("query"))
    )
    joined = papers.select("paper_id", "title", "abstract").join(small(asked, n // 4), "paper_id")
    body = text.embedding_text(F.col("title"), F.col("abstract"))
    return _pairs(joined, "query", _key("tag"), F.col("query"), body)


def negative(papers: DataFrame, n: int = schema.PAIR_TOTAL, seed: int = 42) -> DataFrame:
    """n // 10 pairs meant to be unrelated: old with new papers, then random ones of unlike journals.

    Old and new papers are drawn apart and meet on the draw number. What is missing gets one attempt
    each with two different random papers, kept if their journals differ.
    """
    wanted = n // 10
    tag, old, new = F.col("tag"), F.col("year") < 2000, F.col("year") > 2015
    pools = F.array_compact(F.array(F.lit("any"), F.when(old, "old"), F.when(new, "new")))
    members = papers.select(F.explode(pools).alias("pool"), "paper_id")
    blocks = hash_blocks(members, seed, ["paper_id"], ["pool"])

    def size(pool: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("pool") == pool, F.col("n"))), F.lit(0)).alias(pool)

    sizes = blocks.agg(F.struct(size("old"), size("new"), size("any"))).scalar()
    draws = papers.sparkSession.range(wanted).select(F.col("id").alias("tag"), sizes.alias("size"))
    crossed = tag < F.least(F.col("size.old"), F.col("size.new"))
    n_any = F.col("size.any")
    first = draw_position(seed, "any_a", tag, n_any)
    second = F.pmod(first + draw_position(seed, "any_b", tag, F.greatest(n_any - 1, F.lit(1))) + 1, n_any)

    def end(side: str, pool: Column, pos: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), pool.alias("pool"), pos.alias("pos"))

    def cross(pool: str, otherwise: Column) -> Column:
        return F.when(crossed, draw_position(seed, pool, tag, F.col(f"size.{pool}"))).otherwise(otherwise)

    ends = F.array(
        end("a", F.when(crossed, "old").otherwise("any"), cross("old", first)),
        end("b", F.when(crossed, "new").otherwise("any"), cross("new", second)),
    )
    asked = draws.filter(n_any >= 2).select(tag, F.explode(ends).alias("e")).select(
        (tag * 2 + F.when(F.col("e.side") == "b", 1).otherwise(0)).alias("tag"), "e.pool", "e.pos"
    )
    drawn = rows_at(members, asked, seed, ["paper_id"], blocks, 2 * wanted, ["pool"])
    body = text.embedding_text(F.col("title"), F.col("abstract"))
    texts = papers.select("paper_id", "journal", body.alias("body")).join(small(drawn, 2 * wanted), "paper_id")
    here = F.struct("journal", "body", "pool")
    met = texts.groupBy(F.floor(tag / 2).alias("tag")).agg(
        F.max(F.when(tag % 2 == 0, here)).alias("a"), F.max(F.when(tag % 2 == 1, here)).alias("b")
    )
    unlike = F.coalesce(F.col("a.journal") != F.col("b.journal"), F.lit(True))
    kept = met.filter((F.col("a.pool") == "old") | unlike)
    return _pairs(kept, "negative", _key("tag"), F.col("a.body"), F.col("b.body"))


def assemble(parts: list[DataFrame], n: int = schema.PAIR_TOTAL, seed: int = 42) -> DataFrame:
    """All kinds together, at most n of them, chosen by seeded hash."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return sample_k(union, n, seed, ["pair_key"]) if union.count() > n else union


def small_fixed(papers: DataFrame, journals: int = 5, per_journal: int = 10, abstracts: int = 100) -> DataFrame:
    """A small pair set without draws: leading title-abstract pairs and neighbouring titles of top journals."""
    leading = top_k(papers.filter(F.col("abstract").isNotNull()), abstracts, [F.col("ord")])
    by_title = leading.select(
        F.lit("title_abstract").alias("kind"), F.col("title").alias("text_a"), F.col("abstract").alias("text_b"),
        F.lit(1.0).alias("label"),
    )
    busiest = top_journals(papers, journals).select("journal")
    rows = papers.select("journal", "ord", "title").join(F.broadcast(busiest), "journal", "left_semi")
    first = top_k(rows, per_journal, [F.col("ord")], by=["journal"])
    along = Window.partitionBy("journal").orderBy("ord")
    consecutive = first.withColumn("text_b", F.lead("title").over(along)).filter(F.col("text_b").isNotNull()).select(
        F.lit("consecutive").alias("kind"), F.col("title").alias("text_a"), "text_b", F.lit(0.7).alias("label")
    )
    return by_title.unionByName(consecutive)


def pair_summary(pairs: DataFrame, vocabulary_terms: list[str], vocabulary_size: Column) -> DataFrame:
    """One row: pairs by kind, vocabulary size and leading terms."""
    counted = pairs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in schema.PAIR_LABELS}
    return counted.agg(
        *[c.cast("bigint").alias(f"{k}_pairs") for k, c in kinds.items()],
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("training_examples"),
        vocabulary_size.cast("bigint").alias("vocabulary_terms"),
        F.lit("|".join(vocabulary_terms)).alias("top_terms"),
    )


def no_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "kind string, pair_key string, text_a string, text_b string, label double")
