"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A pretoken's bytes are a doubly linked list of symbols; a heap holds the ranks of adjacent pairs. The
lowest rank, leftmost first, is popped and merged until no pair has a rank: the count is the initial
symbols minus the merges. Counts of pretokens and of texts' parts are kept in bounded tables.

Cases: null and empty texts have 0 bytes and 0 tokens. The tokenizer's special string counts as one token.
Texts of any length are counted whole. Repeated rows count alike. An empty table gives an empty result. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import json

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from . import common
from .chunks import Table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
_CACHE = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable Latin-1, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.special = next((t["content"] for t in model["added_tokens"]), None)
        self.symbols = byte_symbols()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}
        self.table = Table(lambda parts: [self.text(p) for p in parts], self.special)

    def merged(self, data: bytes) -> int:
        """Symbols that are left of a pretoken's bytes."""
        symbols: list[str | None] = [self.symbols[b] for b in data]
        n = left = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.ranks
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = a + b, None
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return left

    def pretoken(self, part: str) -> int:
        n = self.known.get(part)
        if n is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            self.known[part] = n = self.merged(part.encode("utf-8", "replace"))
        return n

    def text(self, text: str) -> int:
        plain = text.split(self.special) if self.special and self.special in text else [text]
        return len(plain) - 1 + sum(self.pretoken(p) for piece in plain for p in self.pattern.findall(piece))

    def __call__(self, texts: list[str | None]) -> list[int]:
        return [sum(parts) for parts in self.table.all([t or "" for t in texts])]


def count_tokens(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def start():
        counter = Counter(path)

        def work(columns):
            tokens = counter(columns[1])
            return [columns[0], [len((t or "").encode("utf-8", "replace")) for t in columns[1]], tokens, [n > limit for n in tokens]]

        return work

    return common.map_text(docs, ["doc_id", "text"], "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", start)
