"""Toxicity by a counterfactual-regularised classifier.

Features are the distinct words of a text and their four- and five-byte beginnings. Counts over the
labelled sample choose those that occur with toxicity far beyond chance. A logistic model is fitted on
them with two penalties: the usual squared weights, and, for each labelled text that names an identity,
the squared change of its score when the term is swapped for the next of its kind. So a neutral
mention of a group moves no score. Weights are not negative: evidence only adds, and a long clean text
does not gather noise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.quality_classifier import held_out, labelled_sample
from litspark.llm.words import _LENGTH, LETTERS, U64, constants, map_text, mix, split_words
from litspark.sources.staging import stage

#: Labelled texts of either label, chosen features, and how far beyond chance a feature must be.
SAMPLE = 10_000
FEATURES = 5_000
SCORE_Z = 6.0
SWAP = 4.0
RIDGE = 1e-3
THRESHOLD = 0.3

#: Identity terms by kind; a swap takes the next of the kind.
IDENTITIES = [
    "women men girls boys mothers fathers wives husbands".split(),
    "woman man girl boy mother father wife husband".split(),
    "christian muslim jewish hindu buddhist sikh catholic protestant atheist".split(),
    "christians muslims jews hindus buddhists sikhs catholics protestants atheists".split(),
    "black white asian latino hispanic arab african european indigenous".split(),
    "american mexican chinese indian russian turkish polish nigerian german french spanish british".split(),
    "americans mexicans indians russians turks poles nigerians germans british".split(),
    "gay straight lesbian bisexual transgender heterosexual homosexual queer".split(),
    "blind deaf disabled autistic paralysed".split(),
    "young old elderly teenage".split(),
    "immigrants refugees migrants natives foreigners".split(),
    "frauen männer mädchen jungen".split(),
    "christen muslime juden buddhisten atheisten".split(),
    "femmes hommes filles garçons".split(),
    "chrétiens musulmans juifs bouddhistes athées".split(),
    "mujeres hombres chicas chicos".split(),
    "cristianos musulmanes judíos budistas ateos".split(),
]

_KIND = constants(41, 3)
_FOUND = T.StructType([T.StructField("features", T.ArrayType(T.LongType()))])


def features(column: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of all texts, distinct and sorted; of the chosen features only, where given."""
    w = split_words(column, LETTERS, lower=True)
    text = np.repeat(np.arange(len(w.lo) - 1), w.counts())
    size = w.end - w.start
    texts, found = [text], [mix(w.hashes() ^ _KIND[0])]
    for kind, n in ((1, 4), (2, 5)):
        long = np.flatnonzero(size > n)
        code = np.zeros(len(long), dtype=U64)
        for k in range(n):
            code = (code << U64(8)) | w.data[w.start[long] + k].astype(U64)
        texts.append(text[long])
        found.append(mix((code + U64(n) * _LENGTH) ^ _KIND[kind]))
    text, found = np.concatenate(texts), np.concatenate(found).view(np.int64)
    if chosen is not None:
        at = np.searchsorted(chosen, found)
        good = chosen[np.minimum(at, len(chosen) - 1)] == found if len(chosen) else np.zeros(len(found), bool)
        text, found = text[good], at[good]
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    return text[fresh], found[fresh]


def swaps() -> dict[tuple[int, ...], tuple[int, ...]]:
    """The features of each identity term to those of its stand-in."""
    out = {}
    for kind in IDENTITIES:
        made = [tuple(features(pa.array([t]))[1].tolist()) for t in kind]
        out |= {a: b for a, b in zip(made, made[1:] + made[:1], strict=True)}
    return out


def _features():
    def work(column):
        text, found = features(column)
        return (pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(column) + 1)).astype(np.int32)), pa.array(found)),)

    return work


class Model:
    """Sorted features with a weight each, and the bias."""

    def __init__(self, rows: list[tuple[int, set[int]]], chosen: list[int]):
        swap = swaps()
        named = sorted({x for pair in swap.items() for side in pair for x in side})
        self.features = np.unique(np.array([*chosen, *named], dtype=np.int64))
        place = {int(f): k for k, f in enumerate(self.features)}
        y = np.array([r[0] for r in rows], dtype=float)
        at = [(i, place[f]) for i, (_, fs) in enumerate(rows) for f in fs if f in place]
        i, j = (np.array(x, dtype=np.int64) for x in (zip(*at, strict=True) if at else ((), ())))
        change: dict = {}
        pair = 0
        for _, fs in rows:
            for old, new in swap.items():
                if fs.issuperset(old):
                    for sign, side in ((-1, old), (1, new)):
                        for f in side:
                            change[pair, place[f]] = change.get((pair, place[f]), 0) + sign
                    pair += 1
        p, q = (np.array(x, dtype=np.int64) for x in (zip(*change, strict=True) if change else ((), ())))
        d = np.array(list(change.values()), dtype=float)
        self.weights, self.bias = self._fit(y, i, j, p, q, d, pair)

    def _fit(self, y, i, j, p, q, d, pairs):
        n, m = max(len(y), 1), len(self.features)
        w, b = np.zeros(m), 0.0
        speed_w, speed_b = np.zeros(m), 0.0
        # The penalty's steepest curvature, by power iteration, bounds the steps.
        x, steep = np.random.default_rng(3).standard_normal(m), 0.0
        x /= max(np.linalg.norm(x), 1e-12)
        for _ in range(30 if pairs else 0):
            x = np.bincount(q, d * np.bincount(p, d * x[q], minlength=pairs)[p], minlength=m) * 2 * SWAP / n
            steep = float(np.linalg.norm(x))
            x /= max(steep, 1e-12)
        most, steps = min(4.0, 1.0 / max(steep, 1e-9)), 400 if steep < 0.25 else 3000
        for step in range(steps):
            z = np.bincount(i, w[j], minlength=len(y)) + b
            off = 1 / (1 + np.exp(-z)) - y
            slope = np.bincount(j, off[i], minlength=m) / n + RIDGE * w
            if pairs:
                moved = np.bincount(p, d * w[q], minlength=pairs)
                slope += 2 * SWAP * np.bincount(q, d * moved[p], minlength=m) / n
            rate = most if step < 0.75 * steps else most / 4
            speed_w, speed_b = 0.9 * speed_w - rate * slope, 0.9 * speed_b - rate * off.mean() if len(y) else 0.0
            w, b = np.maximum(w + speed_w, 0.0), b + speed_b
            speed_w[w == 0] = 0
        return w, b

    def scores(self, column: pa.Array) -> np.ndarray:
        text, at = features(column, self.features)
        return 1 / (1 + np.exp(-(np.bincount(text, self.weights[at], minlength=len(column)) + self.bias)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, learn: Column, per_label: int) -> Model | None:
    """None where no text is labelled. The driver gets feature counts past the test and the sample's rows of these."""
    sample = labelled_sample(docs, labels, "toxic", id_col, text_col, learn, per_label)
    rows = stage(map_text(sample, _features, _FOUND, ["id", "label"]))
    total = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not total:
        return None
    t, c = total.get(1, 0), total.get(0, 0)
    share = t / (t + c)
    counts = rows.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("label").alias("hit"), F.count(F.lit(1)).alias("n"))
    z = (F.col("hit") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-9))
    chosen = counts.where("n >= 3").withColumn("z", z).where(F.col("z") > min(SCORE_Z, 0.5 * np.sqrt(max(t, 1)))).orderBy(F.desc("z"), "feature").limit(FEATURES)
    chosen = [r.feature for r in chosen.collect()]
    wanted = sorted({*chosen, *(x for side in swaps() for x in side)})
    kept = rows.select("id", "label", F.array_intersect("features", F.lit(wanted).cast("array<bigint>")).alias("features"))
    return Model([(r.label, set(r.features)) for r in sorted(kept.collect(), key=lambda r: r.id)], chosen)


def _scoring(model):
    return lambda: lambda column: (pa.array(model.value.scores(column).astype(np.float64)),)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 4, part: int = 2, per_label: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 if score >= 0.3).

    Learns from labelled rows that are not held out, of either label ``per_label`` at most; only texts
    are inputs. Null and blank texts have no features and score the model's base. Where nothing is
    labelled every score is 0. Of rows that repeat an id the smallest text stands in the sample, of clashing labels the smaller. Other
    columns are not read.
    """
    model = fit(docs, labels, id_col, text_col, ~held_out("id", parts, part), per_label)
    if model is None:
        scored = docs.select(id_col, F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        scored = map_text(docs, _scoring(shared), T.StructType([T.StructField("score", T.DoubleType())]), [id_col], text_col)
    return scored.select(id_col, held_out(id_col, parts, part).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
