"""Token counts with a whole-token shortcut.

The driver proves, by encoding every vocabulary string alone, which pre-tokens come out as one token.
Tasks cut a text as the tokenizer's own normalizer and splitter do, count the pre-tokens of that table
directly and merge only the others, each distinct one once while it stays in a bounded memo.

The cut is done here with a pattern for texts whose characters all lie in ranges where it is known to
agree with the library (tests compare every code point). Any other text, and any text that holds one of
the tokenizer's special strings, is encoded by the library as a whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.words import map_text

LIMIT = 2048
#: Pre-tokens that a task remembers.
MEMO = 500_000

#: Fixed values of the tokenizer file: its splitter, its white space and what ends a word.
END = "</w>"
_SPACE = r"\t-\r \x85\xa0 "
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
#: Outside of these characters the library cuts a text; sigma lower-cases by its place in Python.
_STRANGE = "[^\\x00-\\u024f\\u0370-\\u03a2\\u03a4-\\u03ff\\u0400-\\u04ff\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf\\u4e00-\\u9fff\\uac00-\\ud7a3]"

COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def known_characters() -> tuple[str, str]:
    """Patterns: a character that the cut done here is not known to agree on, and the inside of a class of white space."""
    return _STRANGE, _SPACE


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def pieces(text: str, split=regex.compile(_SPLIT)) -> list[str]:
    """The pre-tokens of a text of known characters."""
    return split.findall(unicodedata.normalize("NFC", text).lower())


def single_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings, as text, that are one pre-token and encode alone as one token."""
    tokenizer, strange = load(path), regex.compile(_STRANGE)
    byte = byte_of_letter()
    ends = [t.removesuffix(END) for t in tokenizer.get_vocab() if t.endswith(END)]
    texts = (bytes(byte[c] for c in t).decode(errors="replace") for t in ends if all(c in byte for c in t))
    texts = sorted({t for t in texts if t and not strange.search(t) and pieces(t) == [t]})
    return frozenset(t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Counter:
    """Counts tokens of texts; merges each pre-token that it does not know once, many in one call."""

    def __init__(self, single: frozenset[str], tokenizer):
        self.tokenizer, self.single, self.known = tokenizer, single, dict.fromkeys(single, 1)
        self.strange = regex.compile(_STRANGE)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def _learn(self, wanted: set[str]) -> None:
        fresh = wanted - self.known.keys()
        if len(self.known) + len(fresh) > len(self.single) + MEMO:
            self.known = dict.fromkeys(self.single, 1)
            fresh = wanted - self.known.keys()
        if not fresh:
            return
        fresh = list(fresh)
        sizes = np.bincount([w for w in self._encode(" ".join(fresh)).word_ids if w is not None], minlength=len(fresh)).tolist()
        if len(sizes) != len(fresh) or 0 in sizes:  # a piece that is cut otherwise in company
            sizes = [len(self._encode(x).ids) for x in fresh]
        self.known.update(zip(fresh, sizes, strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        cut = [None if self.strange.search(t) or any(s in t for s in self.special) else pieces(t) for t in texts]
        self._learn({x for c in cut if c is not None for x in c})
        size = self.known.__getitem__
        return [len(self._encode(t).ids) if c is None else sum(map(size, c)) for t, c in zip(texts, cut, strict=True)]


def _counter(path: str, single):
    def make():
        counter = Counter(single.value, load(path))

        def work(column):
            texts = column.fill_null("").to_pylist()
            return pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()), pa.array(counter.counts(texts), pa.int64())

        return work

    return make


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    ``path`` is a tokenizer file that every executor has. Null and empty texts count 0. Rows repeat as
    given, null ids too; other columns are not read. An empty table gives an empty result.
    """
    single = docs.sparkSession.sparkContext.broadcast(single_tokens(path))
    return map_text(docs, _counter(path, single), COUNTS, [id_col], text_col).withColumn("over_limit", F.col("n_tokens") > limit)
