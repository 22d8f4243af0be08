"""Token ids of many short strings: each distinct one is encoded once while a task remembers it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Strings that a worker remembers in either of two generations, and the characters of the longest: some 120 MB in all.
MEMO = 300_000
LONGEST = 64

_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a Python worker, which serves many tasks."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


class Memo:
    """Ids of strings, by an encoder of lists of strings that gives all ids and how many each string has.

    Known strings stand in two generations. A full one becomes the old one, and what is met there moves back.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], entries: int = MEMO):
        self.encode, self.entries, self.known, self.old = encode, entries, {}, {}

    def ids(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct strings after one another, and how many each has."""
        if len(self.known) > self.entries:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        found = [known.get(v) for v in values]
        missing = [k for k, x in enumerate(found) if x is None]
        for k in missing:
            found[k] = old.get(values[k])
        fresh = [k for k in missing if found[k] is None]
        if fresh:
            flat, sizes = self.encode([values[k] for k in fresh])
            raw, ends = flat.astype(np.int32).tobytes(), np.cumsum(sizes) * 4
            for k, e, n in zip(fresh, ends.tolist(), sizes.tolist(), strict=True):
                found[k] = raw[e - 4 * n : e]
        known.update((values[k], found[k]) for k in missing if len(values[k]) <= LONGEST)
        return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4


def library_encoder(tokenizer) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encodes each string of a list alone, all in one call."""

    def encode(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = tokenizer.encode(values, is_pretokenized=True, add_special_tokens=False)
        words = np.array(out.word_ids, dtype=np.int64)
        return np.array(out.ids, dtype=np.int32), np.bincount(words, minlength=len(values))

    return encode


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``codes`` name, after one another, and the size of each."""
    taken = sizes[codes]
    ends = np.cumsum(taken)
    at = np.repeat(starts[codes] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], taken


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct strings among UTF-8 byte runs, and the number of each run's string."""
    if len(offsets) < 2:
        return [], np.empty(0, np.int64)
    kind, at = (pa.string(), np.int32) if len(data) < 1 << 31 else (pa.large_string(), np.int64)
    runs = pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(at)), pa.py_buffer(data)])
    runs = runs.dictionary_encode()
    return runs.dictionary.to_numpy(zero_copy_only=False).tolist(), runs.indices.to_numpy().astype(np.int64)
