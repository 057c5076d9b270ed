"""Byte-level BPE encoding and decoding as a monoid reduction over a tree.

A pretoken's bytes are halved down to short leaves, which are merged directly. Two encoded neighbours
join by encoding anew a window around their boundary. The tokens outside the window stand if each seam's
two tokens, encoded together, stay two: token sequences whose adjacent tokens are all so compatible are
exactly the encodings, so whatever lies beyond a compatible seam can't change. A seam that isn't
compatible makes the window grow on its side. Decoding concatenates the tokens' bytes up a tree.

A pretoken that is itself a token is that token, as in the library. Cases: null and empty texts have no
tokens. Special strings are plain text. Texts of any length are encoded whole. Repeated rows encode alike. An empty table
gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from . import common
from .chunks import Table

RANKS = "byte_bpe_multi_50k.tiktoken"
LEAF = 8
_CACHE = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Codec:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = load_ranks(path)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.pattern = regex.compile(pattern)
        self.seams: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.table = Table(lambda parts: [self.text(p) for p in parts])

    def leaf(self, data: bytes) -> list[int]:
        """Merges the lowest-ranked adjacent pair, leftmost first, until none has a rank."""
        get, none = self.ranks.get, len(self.bytes)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.seams.get((a, b))
        if known is None:
            if len(self.seams) >= _CACHE:
                self.seams.clear()
            self.seams[a, b] = known = self.leaf(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of what a and b encode, one after the other."""
        if not a or not b:
            return a or b
        if self.compatible(a[-1], b[0]):
            return a + b
        left = right = 1
        while True:
            middle = self.leaf(b"".join([self.bytes[t] for t in a[-left:]] + [self.bytes[t] for t in b[:right]]))
            left_open = left < len(a) and not self.compatible(a[-left - 1], middle[0])
            right_open = right < len(b) and not self.compatible(middle[-1], b[right])
            if not (left_open or right_open):
                return a[: len(a) - left] + middle + b[right:]
            left = min(len(a), 2 * left) if left_open else left
            right = min(len(b), 2 * right) if right_open else right

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pretoken's bytes."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self._halves(data)

    def _halves(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaf(data)
        middle = len(data) // 2
        return self.join(self._halves(data[:middle]), self._halves(data[middle:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 256:
            return b"".join([self.bytes[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])

    def text(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        out = []
        for part in self.pattern.findall(text):
            made = self.known.get(part)
            if made is None:
                if len(self.known) >= _CACHE:
                    self.known.clear()
                self.known[part] = made = np.array(self.encode(part.encode("utf-8", "replace")), "<u4").tobytes()
            out.append(made)
        return b"".join(out)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(parts) for parts in self.table.all([t or "" for t in texts])]


def encode_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Per row: doc_id, ids (little-endian unsigned 32-bit)."""
    path = ranks or public_tokenizers.path(RANKS)

    def start():
        codec = Codec(path)
        return lambda columns: [columns[0], codec(columns[1])]

    return common.map_text(docs, ["doc_id", "text"], "doc_id bigint, ids binary", start)


def decode_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Per row: doc_id, data: the bytes that the ids stand for."""
    path = ranks or public_tokenizers.path(RANKS)

    def start():
        codec = Codec(path)
        return lambda columns: [columns[0], [codec.decode(np.frombuffer(i or b"", "<u4").tolist()) for i in columns[1]]]

    return common.map_text(encoded, ["doc_id", "ids"], "doc_id bigint, data binary", start, text="ids")


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; ids are encoded and decoded in one pass."""
    path = ranks or public_tokenizers.path(RANKS)

    def start():
        codec = Codec(path)

        def work(columns):
            made = codec(columns[1])
            digest = lambda b: hashlib.sha256(b).hexdigest()
            return [
                columns[0],
                [len(ids) // 4 for ids in made],
                [digest(ids) for ids in made],
                [digest(codec.decode(np.frombuffer(ids, "<u4").tolist())) for ids in made],
            ]

        return work

    return common.map_text(docs, ["doc_id", "text"], "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start)
