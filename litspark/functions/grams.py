"""Finding many literal texts in a text at once, for use inside tasks.

Each needle stands under one of its grams of three characters, the one that the fewest needles hold. A text looks up its
own distinct grams, so needles that share none with it cost nothing; those found are verified. Nothing is missed: a text
that holds a needle holds all of its grams.
"""

from __future__ import annotations

from collections import Counter, defaultdict

GRAM = 3
FEW = 64  # so few grams are sought in a text one by one


def grams_of(text: str, size: int = GRAM) -> set[str]:
    return {text[i : i + size] for i in range(len(text) - size + 1)}


class GramIndex:
    """Distinct texts of one character or more, by number."""

    def __init__(self, needles: list[str]):
        self.needles = needles
        grams = [grams_of(n, min(GRAM, len(n))) for n in needles]
        shared = Counter(g for gs in grams for g in gs)
        self.at: dict[str, list[int]] = defaultdict(list)
        self.rarity = []
        for k, gs in enumerate(grams):
            gram = min(gs, key=lambda g: (shared[g], g))
            self.at[gram].append(k)
            self.rarity.append(shared[gram])
        self.sizes = sorted({len(g) for g in self.at})
        self.verified = 0

    def find(self, text: str) -> list[int]:
        """Numbers of the needles that the text holds, in no order."""
        at = self.at
        if len(at) <= FEW:
            met = [g for g in at if g in text]
        else:
            met = [g for size in self.sizes for g in grams_of(text, size) if g in at]
        found = [k for g in met for k in at[g]]
        self.verified += len(found)
        return [k for k in found if self.needles[k] in text]


class QueryIndex:
    """Queries as groups of alternatives, all groups required; each stands under the alternatives of one group.

    That is the group whose alternatives are the rarest together. A group with an empty alternative asks for nothing; queries
    of such groups alone are ``blank`` and match every text.
    """

    def __init__(self, queries: list[list[list[str]]]):
        needed = [[sorted(set(g)) for g in q if "" not in g] for q in queries]
        self.blank = [k for k, q in enumerate(needed) if not q]
        needles = sorted({t for q in needed for g in q for t in g})
        number = {t: k for k, t in enumerate(needles)}
        rarity = GramIndex(needles).rarity
        under: dict[str, list[tuple[int, list[list[str]]]]] = defaultdict(list)
        for k, q in enumerate(needed):
            if q:
                lead = min(range(len(q)), key=lambda i: sum(rarity[number[t]] for t in q[i]))
                rest = q[:lead] + q[lead + 1 :]
                for t in q[lead]:
                    under[t].append((k, rest))
        self.index = GramIndex(sorted(under))
        self.under = [under[t] for t in self.index.needles]

    def find(self, text: str) -> set[int]:
        """Numbers of the queries that a text matches, blank ones apart."""
        found = set()
        for needle in self.index.find(text):
            for k, rest in self.under[needle]:
                if k not in found and all(any(t in text for t in g) for g in rest):
                    found.add(k)
        return found
