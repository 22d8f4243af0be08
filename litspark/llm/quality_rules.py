"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose share of something passes a cutoff. All rules of a stratum (the
language) share one cutoff: the strictest of a fixed grid for which labelled good documents prove, by an
exact binomial test, that all rules together reject at most ``RISK`` of the good ones. The grid is tested
from the mildest cutoff on and ends at the first that fails (fixed sequence), so it needs no correction of
its own; the level ``LEVEL`` is divided by the number of strata (Bonferroni), so all strata hold together. A
stratum with too few labels to prove anything gets no cutoff: only the base rules judge its documents. At
``RISK`` and ``LEVEL`` one stratum alone needs 598 good labels, five need 919 each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.words import NOT_BLANK, Words, free_name, map_text, run_hashes, split_words
from litspark.sources.staging import stage

RUN = 5
#: Share of good documents that the rules of a stratum may reject, and the chance that any stratum breaks it.
RISK = 0.005
LEVEL = 0.05
#: Cutoffs lie at 1/GRID, 2/GRID, ... below 1.
GRID = 50


def _flags(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in characters]] = True
    return out


_SYMBOL = _flags("#*$%&|<>")
_CAPITAL = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _CAPITAL | _flags("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_words", "n_capitals", "n_letters")
MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in _COUNTS])


def rules() -> dict[str, Column]:
    """Rule to measured value; a document is rejected above the cutoff."""
    words, lines, letters = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_letters"))
    return {
        "symbols": F.col("n_symbols") / words,
        "repeated_words": F.col("n_repeat_words") / words,
        "repeated_lines": F.col("n_dup_lines") / lines,
        "same_words": F.col("n_same_words") / words,
        "capitals": F.col("n_capitals") / letters,
        "long_words": F.col("word_chars") / words / 40,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _between(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive places."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[places])


def _repeated(runs: np.ndarray) -> int:
    """Words in runs found twice or more, of the runs from each word on."""
    order = np.sort(runs)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(runs, twice))
    return int(np.minimum(np.diff(at, append=at[-1] + RUN), RUN).sum())


def _lines(words: Words) -> tuple[list[int], list[int]]:
    """Lines with a word, and those of them equal to an earlier line of the text."""
    lines, twice, raw = [], [], words.data.tobytes()
    for lo, hi in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        found = [x for x in raw[lo:hi].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        lines.append(len(found))
        twice.append(len(found) - len(set(found)))
    return lines, twice


def _measures():
    def work(column):
        w = split_words(column, NOT_BLANK)
        hashes = w.hashes()
        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
        runs = run_hashes(hashes, RUN)
        repeated = [_repeated(runs[lo : hi - RUN + 1]) if hi - lo >= RUN else 0 for lo, hi in zip(w.lo[:-1], w.lo[1:], strict=True)]
        same = np.zeros(len(hashes), dtype=bool)
        same[1:] = hashes[1:] == hashes[:-1]
        same[w.lo[:-1][w.counts() > 0]] = False
        lines, twice = _lines(w)
        counted = (
            w.counts(), _between(points[w.end] - points[w.start], w.lo), _between(_SYMBOL[w.data], w.offsets), twice, repeated,
            lines, _between(same, w.lo), _between(_CAPITAL[w.data], w.offsets), _between(_LETTER[w.data], w.offsets),
        )
        return [pa.array(x, pa.int64()) for x in counted]

    return work


def measures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with the measures of each whole text; null counts as empty."""
    return map_text(docs, _measures, MEASURES, keep, text_col)


def tail(n: int, k: int, p: float) -> float:
    """The chance of k or fewer among n of probability p, exactly."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def step(value: Column) -> Column:
    """How many cutoffs a value passes."""
    return F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.ceil(value * GRID).cast("int") - 1))


def strictest(cells: dict[int, int], risk: float, level: float) -> int | None:
    """The strictest proven cutoff, as the steps that are rejected from; cells: good documents by step."""
    n, best = sum(cells.values()), None
    for cutoff in range(GRID - 1, 0, -1):
        rejected = sum(c for passed, c in cells.items() if passed >= cutoff)
        if rejected >= risk * n or tail(n, rejected, risk) > level:
            return best
        best = cutoff
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str, stratum: str, risk: float = RISK, level: float = LEVEL) -> dict[str, int]:
    """Stratum to its cutoff, for those that have one.

    Only grid counts of strata with enough labels for any proof reach the driver: fewer cells than a
    fixed share of the labels.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias(id_col)).dropDuplicates()
    furthest = F.greatest(*(step(v) for v in rules().values()))
    rows = measured.join(good, id_col, "left_semi").select(F.col(stratum).alias("s"), furthest.alias("step"))
    counted = stage(rows.groupBy("s", "step").count())
    enough = math.log(level) / math.log1p(-risk)
    large = counted.groupBy("s").agg(F.sum("count").alias("n")).where(F.col("n") >= enough).select("s")
    found: dict = {}
    for r in counted.join(large, "s", "left_semi").collect():
        found.setdefault(r.s, {})[r.step] = r["count"]
    proven = {s: strictest(cells, risk, level / len(found)) for s, cells in found.items()}
    return {s: cutoff for s, cutoff in proven.items() if cutoff is not None}


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    risk: float = RISK, level: float = LEVEL,
) -> DataFrame:
    """One row per document: id, the measures, base_failed, rejected_by (rules, sorted) and kept.

    Null and blank texts have no words and fail. A null stratum counts as the stratum "". Labels that
    are null, repeat or have no document don't matter; without labels no rule gets a cutoff. Rows without
    id are judged like others. Other columns are not read.
    """
    s = free_name(docs, "stratum")
    read = docs.select(id_col, text_col, F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias(s))
    measured = stage(measures(read, [id_col, s], text_col))
    by_stratum = cutoffs(measured, labels, id_col, s, risk, level)
    rejected = F.lit([]).cast("array<string>")
    if by_stratum:
        cutoff = F.create_map(*(F.lit(x) for pair in sorted(by_stratum.items()) for x in pair))[F.col(s)]
        rejected = F.array_compact(F.array(*(F.when(step(value) >= cutoff, F.lit(rule)) for rule, value in sorted(rules().items()))))
    out = measured.withColumns({"base_failed": base_failed(), "rejected_by": rejected})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop(s)
