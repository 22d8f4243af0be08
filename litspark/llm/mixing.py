"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources that they belong to). A flow
routes words from patterns to source quotas: each pass over a pattern's words is an arc of its own whose
cost grows with the pass, so nothing repeats while fresh words are left, and overlapping documents go
where they are needed. The solution says how many words each pattern gives; whole passes take all its
documents, the last one takes documents in seeded hash order until the words are met, the document on the
border with its first words only. So quotas are met to the word.

Words are summed before the running totals: hash ranges of a pattern give one row each, and only
the range on the border is ordered by document.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.components import SMALL_ROWS
from litspark.llm.words import NOT_BLANK, free_name, map_text, split_words
from litspark.sources.staging import stage

SHARE = 1.5
REPEATS = 2
WEIGHTS = (5, 2, 1)
#: Hash ranges of a pattern; the border range holds that part of its documents.
RANGES = 1 << 16

_SIZE = T.StructType([T.StructField("size", T.LongType())])


def _sizes():
    return lambda column: (pa.array(split_words(column, NOT_BLANK).counts(), pa.int64()),)


def targets(sizes: dict, share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS) -> dict:
    """Source to wanted words: ``share`` of all words by weight, none above ``repeats`` times its source.

    Sources go by code point, null last, and take the weights in turn. What a full source can't
    take is shared out again by weight. Exact fractions throughout.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, open_, out = Fraction(share) * sum(sizes.values()), set(order), {}
    while open_:
        per = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * per > repeats * sizes[s]}
        for s in full or open_:
            out[s] = Fraction(repeats * sizes[s]) if full else weight[s] * per
            rest -= out[s]
        open_ -= full or open_
    return out


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words that each pattern gives, of the cheapest flow that fills the quotas as far as it can.

    Pass k of a pattern's words costs k. Sources that no chain of patterns joins share no arc, so each joined
    set is a flow of its own. A source with a single pattern takes its quota or all passes.
    """
    parent = {s: s for pattern in patterns for s in pattern}

    def root(s):
        while parent[s] != s:
            parent[s] = s = parent[parent[s]]
        return s

    for pattern in patterns:
        for s in pattern[1:]:
            parent[root(s)] = root(pattern[0])
    joined: dict = {}
    for pattern, size in patterns.items():
        joined.setdefault(root(pattern[0]), {})[pattern] = size
    out = {}
    for part in joined.values():
        sources = {s for pattern in part for s in pattern}
        if len(part) == len(sources) == 1:
            out |= {p: min(repeats * size, quotas[p[0]]) for p, size in part.items()}
        else:
            out |= _flow(part, {s: quotas[s] for s in quotas if s in sources}, repeats)
    return out


def _flow(patterns: dict[tuple, int], quotas: dict, repeats: int) -> dict[tuple, int]:
    """The cheapest flow by cheapest augmenting paths, found by label correction."""
    first, last = "from", "to"
    capacity: dict = {}
    cost: dict = {}
    near: dict = {}

    def arc(a, b, room, price):
        for x, y, r, c in ((a, b, room, price), (b, a, 0, -price)):
            capacity[x, y] = capacity.get((x, y), 0) + r
            cost[x, y] = c
            near.setdefault(x, []).append(y)

    for pattern, size in patterns.items():
        for k in range(repeats):
            arc(first, ("pass", k, pattern), size, k)
            arc(("pass", k, pattern), ("pattern", pattern), size, 0)
        for s in pattern:
            arc(("pattern", pattern), ("source", s), repeats * size, 0)
    for s, quota in quotas.items():
        arc(("source", s), last, quota, 0)
    while True:
        best, back, queue = {first: 0}, {}, deque([first])
        waiting = {first}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for b in near.get(a, ()):
                if capacity[a, b] > 0 and best[a] + cost[a, b] < best.get(b, 1 << 60):
                    best[b], back[b] = best[a] + cost[a, b], a
                    if b not in waiting:
                        queue.append(b)
                        waiting.add(b)
        if last not in best:
            break
        path, b = [], last
        while b != first:
            path.append((back[b], b))
            b = back[b]
        flow = min(capacity[x] for x in path)
        for a, b in path:
            capacity[a, b] -= flow
            capacity[b, a] += flow
    return {p: sum(capacity[("pass", k, p), first] for k in range(repeats)) for p in patterns}


def _whole(quotas: dict) -> dict:
    """Fractions as whole words with the same total, the largest remainders rounded up."""
    out = {s: int(q) for s, q in quotas.items()}
    up = round(sum(quotas.values())) - sum(out.values())
    for s in sorted(quotas, key=lambda s: (out[s] - quotas[s], s is None, s or ""))[:up]:
        out[s] += 1
    return out


def mix_sources(
    docs: DataFrame, sources_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 17,
    share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS,
) -> DataFrame:
    """One row per document: id, size, source_size, target and taken (words that the mix takes, repeats counted).

    ``sources_col`` holds a source, or an array of sources where a document belongs to several; its
    source_size and target are then sums over them. A null source (or null or empty array) is a source
    of its own, last in order. Null and blank texts have size 0 and give nothing. Rows that repeat are mixed
    as documents of their own, ids may be null: ties of the seeded order differ in nothing that counts.
    The driver holds one sum per pattern. Other columns are not read; an empty table gives an empty result.
    """
    spark, p, c = docs.sparkSession, free_name(docs, "pattern"), F.col(sources_col)
    if isinstance(docs.schema[sources_col].dataType, T.ArrayType):
        c = F.when(F.size(c) > 0, F.array_sort(F.array_distinct(c.cast("array<string>")))).otherwise(F.array(F.lit(None).cast("string")))
    else:
        c = F.array(c.cast("string"))
    h = free_name(docs, "hash")
    read = docs.select(id_col, text_col, c.alias(p), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias(h))
    rows = stage(map_text(read, _sizes, _SIZE, [id_col, p, h], text_col).withColumn("range", F.shiftrightunsigned(F.col(h), 48).cast("int")))

    summed = {tuple(r[p]): r.s for r in rows.groupBy(p).agg(F.sum("size").alias("s")).collect()}
    sizes: dict = {}
    for pattern, n in summed.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + n
    wanted = targets(sizes, share * sum(summed.values()) / max(1, sum(sizes.values())) if sizes else share, repeats, weights)
    given = route(summed, _whole(wanted), repeats)

    bounded = F.broadcast if len(summed) <= SMALL_ROWS // 10 else lambda df: df
    rest = {q: given[q] % n if n else 0 for q, n in summed.items()}
    # As an Arrow table: Spark would deal out Python rows through workers of their own, beside those of the operators.
    columns = {
        p: pa.array([list(q) for q in summed], pa.list_(pa.string())),
        "passes": pa.array([int(given[q] // n) if n else 0 for q, n in summed.items()], pa.int64()),
        "rest": pa.array([int(rest[q]) for q in summed], pa.int64()),
        "source_size": pa.array([sum(sizes[s] for s in q) for q in summed], pa.int64()),
        "target": pa.array([float(sum(wanted[s] for s in q)) for q in summed], pa.float64()),
    }
    kinds = spark.createDataFrame(pa.table(columns))
    before = F.sum("s").over(Window.partitionBy(p).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = rows.groupBy(p, "range").agg(F.sum("size").alias("s")).withColumn("before", F.coalesce(before, F.lit(0)))
    border = ranges.join(bounded(kinds.select(p, "rest")), p).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("s")))
    border = border.select(p, F.col("range").alias("border"), (F.col("rest") - F.col("before")).alias("left"))
    plan = bounded(stage(kinds.join(border, p, "left")))
    known = rows.join(plan, p, "left")
    inside = known.where(F.col("range") == F.col("border"))
    outside = known.where(F.col("border").isNull() | (F.col("range") != F.col("border")))
    done = F.coalesce(F.sum("size").over(Window.partitionBy(p).orderBy(h, id_col, "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - done)))
    outside = outside.withColumn("extra", F.when(F.col("range") < F.col("border"), F.col("size")).otherwise(0))
    both = inside.unionByName(outside)
    return both.select(id_col, "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken"))
