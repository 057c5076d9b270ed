"""Order-preserving packing of token streams into sequences by dynamic programming.

Each task packs the documents of its input partition in their order. Their ids (by the tokenizer, then
id 0) make one stream, which may be cut at document ends, at sentence ends and, in long passages without
either, every STEP tokens. The cuts minimise padding plus penalties: none for a document's end, SENTENCE
tokens within a document, MIDDLE within a sentence, ONE for each sequence. A sequence is padded to
`size` unless its length is a power of two. The best cut before a position is the smallest of
cost + place over the candidates of the last `size` tokens: a monotone queue hands it over in constant
time; sequences of a power of two are looked up at their one starting place. Near the stream's end it may also be cut
where what is left is a sum of up to three powers of two.

Nothing is shuffled, and a task run again gives the same sequences. sequence_id is the partition's
number times 2^32 plus a count. Costs go on over a partition's whole stream; after each STRETCH tokens or so the cuts on
which the cheapest ways to all of the last `size` tokens agree are given out, as nothing that follows can change them.
A task holds what is behind the last of these.

Cases: null and empty texts are one token (id 0). Texts of any length are packed whole. Repeated rows are
packed as often as they come. Of equally cheap cuts the one found first (the longest sequence) stands. An empty
table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common
from .chunks import Table

SIZE = 1024
SENTENCE, MIDDLE, ONE = 2, 12, 8
STEP, STRETCH = 128, 1 << 17
TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Encoder:
    """Ids of texts by a tokenizer file; parts of texts are kept in a table.

    same: the parts come from tiktoken with the file's own vocabulary, which is several times faster; texts
    that can't be cut into parts, and files that same_merges() does not hold for, go through the tokenizer itself.
    """

    def __init__(self, path: str, same: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.fast = _by_ranks(path) if same else None
        self.table = Table(self._make, special[0] if special else None)
        self.ends = np.zeros(vocabulary, bool)
        for i in range(vocabulary):
            self.ends[i] = self.tokenizer.decode([i], skip_special_tokens=False).rstrip(" ")[-1:] in tuple(".!?\n")

    def _make(self, parts: list[str]) -> list[bytes]:
        if self.fast is not None and len(parts) > 1:
            return [np.array(ids, self.kind).tobytes() for ids in map(self.fast.encode_ordinary, parts)]
        made = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in made]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(p), self.kind) for p in self.table.all([t or "" for t in texts])]


def same_merges(path: str) -> bool:
    """Whether merging by the ranks of whole tokens gives the ids that the file's merges give, for every text.

    Ranks join any two neighbours that make a token t, merges only the listed pair of t. They agree if ids rise
    with the merges and the merges make each token from its own bytes: then the symbols between the ends of a t in any
    text go through the states of merging t alone (nothing has crossed its ends, and the lowest pair comes first in
    both), and the one state of two symbols on that way is the listed pair.
    """
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model = data["model"]
    cut = data.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or data.get("normalizer") or model.get("ignore_merges"):
        return False
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in merges]
    if len(data["added_tokens"]) > 1 or any(a >= b for a, b in zip(ids, ids[1:])):
        return False
    special = {t["content"] for t in data["added_tokens"]}
    merged = Tokenizer.from_file(path).model
    return all(len(merged.tokenize(token)) == 1 for token in model["vocab"] if token not in special)


def _by_ranks(path: str):
    """A tiktoken encoding of the file's vocabulary."""
    import json

    import tiktoken

    from .token_counts import byte_symbols

    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    back = {c: b for b, c in enumerate(byte_symbols())}
    special = {t["content"] for t in data["added_tokens"]}
    ranks = {bytes(back[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def candidates(ends: np.ndarray, sentences: np.ndarray, total: int, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, 0 and total among them, and the penalty of each. more: further places within sentences."""
    known = np.unique(np.concatenate([[0, total], ends, sentences]))
    gaps = np.diff(known)
    long = np.flatnonzero(gaps > STEP + STEP // 2)
    steps = [np.arange(a + STEP, b, STEP) for a, b in zip(known[long].tolist(), known[long + 1].tolist(), strict=True)]
    places = np.unique(np.concatenate([known, *steps, *([] if more is None else [more])]))
    penalty = np.full(len(places), MIDDLE)
    penalty[np.searchsorted(places, sentences)] = SENTENCE
    penalty[np.searchsorted(places, ends)] = 0
    penalty[[0, -1]] = 0
    return places, penalty


def tails(total: int, size: int) -> np.ndarray:
    """Places from which on a sum of at most three powers of two, under `size`, is left."""
    left = np.arange(1, min(size, total))
    bits = sum((left >> k) & 1 for k in range(size.bit_length()))
    return total - left[bits <= 3]


class Cuts:
    """The cheapest way to each place of a stream that goes on. Places before the first one held are settled and gone."""

    def __init__(self, size: int):
        self.size, self.powers = size, [1 << k for k in reversed(range(size.bit_length())) if 1 << k < size]
        self.places, self.cost, self.came = [0], [0], [-1]
        self.queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + place, index), costs rising

    def apart(self, places: np.ndarray) -> tuple[list[int], list[int]]:
        """For each of new places the earlier ones that lie a power of two before it, the farthest first: indices, and where each place's begin."""
        held = np.concatenate([np.array(self.places, np.int64), places])
        own, other = [], []
        for power in self.powers:
            at = np.searchsorted(held, places - power)
            hit = np.flatnonzero(held[at] == places - power)
            own.append(hit)
            other.append(at[hit])
        own = np.concatenate(own)
        order = np.argsort(own, kind="stable")
        return np.concatenate(other)[order].tolist(), np.searchsorted(own[order], np.arange(len(places) + 1)).tolist()

    def extend(self, places: np.ndarray, penalty: np.ndarray) -> None:
        size, queue, known, cost, came = self.size, self.queue, self.places, self.cost, self.came
        others, begins = self.apart(places)
        a = 0
        for place, extra, b in zip(places.tolist(), penalty.tolist(), begins[1:], strict=True):
            while known[queue[0][1]] < place - size:
                queue.popleft()
            best, at = queue[0]
            best += size - place
            if a != b:
                for i in others[a:b]:
                    if cost[i] < best:
                        best, at = cost[i], i
                a = b
            best += extra + ONE
            key, j = best + place, len(known)
            known.append(place)
            cost.append(best)
            came.append(at)
            while queue and queue[-1][0] >= key:
                queue.pop()
            queue.append((key, j))

    def settled(self, whole: bool) -> list[int]:
        """Ends of sequences that are sure by now: all of them if the stream ends here, else those that lie on the ways to all places that a sequence can still start from."""
        last = len(self.places) - 1
        if not whole:
            ways = [-j for j in range(last, -1, -1) if self.places[j] > self.places[-1] - self.size]
            heapq.heapify(ways)
            while len(ways) > 1:
                last = -heapq.heappop(ways)
                if -ways[0] != last:
                    heapq.heappush(ways, -self.came[last])
            last = -ways[0]
        out, at = [], last
        while at > 0:
            out.append(self.places[at])
            at = self.came[at]
        self.places, self.cost, self.came = self.places[last:], self.cost[last:], [c - last for c in self.came[last:]]
        self.queue = deque((k, j - last) for k, j in self.queue if j >= last)
        return out[::-1]


class Packer:
    """Takes documents in order and gives the pieces of the sequences that are settled."""

    def __init__(self, size: int, sentence_ends: np.ndarray, first_id: int):
        self.size, self.sentence_ends, self.next = size, sentence_ends, first_id
        self.cuts, self.docs = Cuts(size), []  # docs: doc_id, ids with the final 0, how many of them have been packed
        self.fresh: list[np.ndarray] = []  # ids of the last documents, whose places are not known yet
        self.held = self.known = self.begin = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, np.append(ids.astype("<u4"), np.uint32(0)), 0])
        self.fresh.append(self.docs[-1][1])
        self.held += len(ids) + 1
        if self.held >= STRETCH:
            yield from self.settle(False)

    def settle(self, whole: bool) -> Iterator[tuple]:
        if not self.held:
            return
        kept, left = len(self.fresh), 0  # the stream's last `size` tokens stay fresh, as its end may ask for more places there
        while not whole and kept and left < self.size:
            kept -= 1
            left += len(self.fresh[kept])
        if kept:
            stream = np.concatenate(self.fresh[:kept])
            ends, n = np.cumsum([len(ids) for ids in self.fresh[:kept]]), len(stream)
            places, penalty = candidates(ends, np.flatnonzero(self.sentence_ends[stream]) + 1, n, tails(n, self.size) if whole else None)
            self.cuts.extend(places[1:] + self.known, penalty[1:])
            self.known, self.fresh, self.held = self.known + n, self.fresh[kept:], left
        at = 0
        for end in self.cuts.settled(whole):
            offset = 0
            while self.begin + offset < end:
                doc = self.docs[at]
                doc_id, ids, done = doc
                n = min(len(ids) - done, end - self.begin - offset)
                yield doc_id, done, n, zlib.crc32(ids[done : done + n].tobytes()), len(ids), self.next, offset
                doc[2] = done + n
                offset += n
                at += doc[2] == len(ids)
            self.next += 1
            self.begin = end
        self.docs = self.docs[at:]


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = common.schema_of(SCHEMA)
    same = same_merges(path)
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.arrow_schema(schema)
        encoder, packer = None, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        for batch in common.pieces(batches, "text"):
            if packer is None:
                encoder = Encoder(path, same)
                packer = Packer(size, encoder.ends, TaskContext.get().partitionId() << 32)
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1).to_pylist()), strict=True):
                rows += packer.add(doc_id, ids)
            if rows:
                yield made(rows)
        if packer is not None and (rows := list(packer.settle(True))):
            yield made(rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
