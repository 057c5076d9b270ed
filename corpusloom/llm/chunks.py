"""Cutting a text where byte-level tokenizers cut it anyway, so that what each part gives can be kept in a table.

The pattern of these tokenizers lets a word take at most one space before it. In a text without two
adjacent white-space characters each space and each newline starts a part of its own, whatever stands
around it; all other texts are not cut.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_ADJACENT = re.compile(r"\s\s")


class Table:
    """parts(text) gives what make(list of parts) gave for each part of the text, in order; make([text]) where it can't be cut.

    The first part stands as it is; each later one has the space or newline that it starts with. At most
    `most` parts are kept; of a full table only what the texts at hand need stays, which costs time and changes nothing.
    """

    def __init__(self, make: Callable[[list[str]], list], whole: str | None = None, most: int = 800_000):
        self.make, self.whole, self.most = make, whole, most
        self.first: dict = {}
        self.later: dict = {}

    def learn(self, texts: list[str]) -> list[list[str] | None]:
        """The texts' parts (None: not cut); all of them are in the tables afterwards."""
        cut = [
            None if _ADJACENT.search(t) or (self.whole and self.whole in t) else t.replace("\n", " \n").split(" ") for t in texts
        ]
        heads = {c[0] for c in cut if c}
        tails: set[str] = set().union(*[c[1:] for c in cut if c])
        if len(self.first) + len(self.later) + len(heads) + len(tails) > self.most:
            self.first = {h: self.first[h] for h in heads if h in self.first}
            self.later = {t: self.later[t] for t in tails if t in self.later}
        new = [h for h in heads if h not in self.first]
        if new:
            self.first.update(zip(new, self.make(new), strict=True))
        new = [t for t in tails if t not in self.later]
        if new:
            self.later.update(zip(new, self.make([t if t[:1] == "\n" else f" {t}" for t in new]), strict=True))
        return cut

    def all(self, texts: list[str]) -> list[list]:
        cut = self.learn(texts)
        later = self.later
        return [self.make([t]) if c is None else [self.first[c[0]], *map(later.__getitem__, c[1:])] for t, c in zip(texts, cut, strict=True)]
