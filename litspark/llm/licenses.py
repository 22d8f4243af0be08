"""Licence scan: ordered signature rules behind a keyword prefilter.

One Aho-Corasick pass finds which words of keywords a text holds; only patterns whose keyword is complete
run. Words are looked for one by one, so a keyword that wraps over lines counts. A detection
that lies inside another of the same or a better rank is dropped, so a title inside a full notice, or a
short name inside a versioned one, does not count twice. Identifiers of one SPDX expression don't lie in each
other, so all of them count. The four base phrases are found on words, by
word hashes, and are not suppressed.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.license_rules import WORTH, rules
from litspark.llm.words import LETTERS, map_text, split_words

#: Base phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_WORTH = 0.5
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}

_DETECTION = T.StructType([T.StructField("label", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("base_places", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))),
    T.StructField("detections", T.ArrayType(_DETECTION)),
])


@cache
def _compiled():
    """Rules with their compiled patterns, in order; the word a rule waits for to all words it needs; the automaton of all words."""
    patterns, by_word, automaton = [], {}, ahocorasick.Automaton()
    for order, (label, rank, keyword, pattern) in enumerate(rules()):
        gaps = re.compile(pattern.replace("[- ]", "(?:-| )").replace(" ?", r"[\s#*/]*").replace(" ", r"[\s#*/]+"))
        patterns.append((label, rank, gaps))
        for words in map(str.split, keyword.split("|")):
            by_word.setdefault(words[0], []).append((order, frozenset(words)))
            for word in words:
                automaton.add_word(word, word)
    automaton.make_automaton()
    return patterns, by_word, automaton


def tried(text: str) -> set[int]:
    """The places in the list of rules of those whose keyword the text holds."""
    _, by_word, automaton = _compiled()
    words = {word for _, word in automaton.iter(text)}
    return {order for w in words for order, needs in by_word.get(w, ()) if needs <= words}


def detect(text: str) -> list[tuple[str, int, int, int]]:
    """(label, rank, first, last) of the detections that stay, by place; text with A-Z lower-cased, places in code points."""
    patterns = _compiled()[0]
    found = []
    for order in tried(text):
        label, rank, pattern = patterns[order]
        for m in pattern.finditer(text):
            first, end = m.span(m.lastgroup or 0)
            found.append((first, -end, rank, order, label))
    kept, reach = [], {}
    for first, end, rank, _, label in sorted(found):
        # Any detection before this one starts no later; it covers this one if it reaches as far.
        if not any(r <= rank and far >= -end for r, far in reach.items()):
            kept.append((label, rank, first, -end - 1))
        reach[rank] = max(reach.get(rank, 0), -end)
    return kept


def _scan():
    phrases = [(label, split_words(pa.array([phrase]), LETTERS, lower=True).hashes()) for phrase, label in BASE.items()]

    def work(column):
        w = split_words(column, LETTERS, lower=True)
        hashes, places = w.hashes(), {}
        for label, phrase in phrases:
            if len(hashes) < len(phrase):
                continue
            at = np.flatnonzero(hashes[: len(hashes) - len(phrase) + 1] == phrase[0])
            for k in range(1, len(phrase)):
                at = at[hashes[at + k] == phrase[k]]
            text = np.searchsorted(w.lo, at, "right") - 1
            for p, d in zip(at.tolist(), text.tolist(), strict=True):
                if p + len(phrase) <= w.lo[d + 1]:
                    places.setdefault(d, []).append({"label": label, "word": p - int(w.lo[d])})
        detections = [[dict(zip(_DETECTION.names, x, strict=True)) for x in detect(t.translate(_LOWER))] if t else [] for t in column.to_pylist()]
        base = [sorted(places.get(d, ()), key=lambda x: (x["word"], x["label"])) for d in range(len(column))]
        return (
            pa.array(w.counts(), pa.int64()),
            pa.array(base, pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
            pa.array(detections, pa.list_(pa.struct([("label", pa.string()), ("rank", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))),
        )

    return work


def license_detections(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with n_words, the places of base phrases and the detections that stay. Null counts as empty."""
    return map_text(docs, _scan, FOUND, keep, text_col)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Labels are distinct, sorted and comma-joined; empty where nothing is found. The score is the worth of the best
    detection. Null and blank texts have no words. Rows repeat as given; other columns are not read.
    """
    found = license_detections(docs, [id_col], text_col)
    base = F.array_distinct("base_places.label")
    worth = F.create_map(*(F.lit(x) for pair in WORTH.items() for x in pair))
    best = F.array_max(F.transform("detections.rank", lambda r: worth[r]))
    return found.select(
        id_col, "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min("base_places.word").alias("first_word"),
        F.array_max("base_places.word").alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.array_distinct("detections.label"))), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("base_places") > 0, BASE_WORTH).otherwise(0.0)).alias("score"),
    )
