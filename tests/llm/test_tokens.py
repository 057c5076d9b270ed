import base64
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe_tree, packing, token_counts

from .tables import empty, frames

JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", " ", "  a", " a  b\n\n c\t\td ", "x<|endoftext|>y <|endoftext|>", "It's I'LL we're  don't", "\n", "a\n", "a\n b", "½ ² Ⅷ 一二 x", "\x1c\x1d a\x1fb",
    "naïve café 中文字符 🎉🎉 👨‍👩‍👧 é", "a" * 300, "ab" * 500, "\x85 z 　w", "don't've'd", "A\r\nB\r\n\r\nC", "__init__(self, *args) -> None:  # hi", "\x00\x01",
]
pieces = st.lists(st.sampled_from([*"abcthering' \n.,1é中\t<|>", "the", "ing", " ", "<|endoftext|>"]), max_size=120).map("".join) | st.text(max_size=60)


@pytest.fixture(scope="module")
def tools():
    codec = bpe_tree.Codec(MULTI)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    return Tokenizer.from_file(JSON), packing.Encoder(JSON, packing.same_merges(JSON)), token_counts.Counter(JSON), codec, library


@given(st.lists(pieces, max_size=4))
@settings(max_examples=150, deadline=None)
def test_any_text_as_the_libraries(tools, texts):
    tokenizer, encoder, counter, codec, library = tools
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in encoder(texts)] == want
    assert counter(texts) == [len(w) for w in want]
    made = [np.frombuffer(i, "<u4").tolist() for i in codec(texts)]
    assert made == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(m) for m in made] == [t.encode() for t in texts]


def test_odd_texts(tools):
    tokenizer, encoder, counter, codec, library = tools
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [i.tolist() for i in encoder(ODD)] == want and counter(ODD) == [len(w) for w in want]
    assert [np.frombuffer(i, "<u4").tolist() for i in codec(ODD)] == [library.encode_ordinary(t) for t in ODD]


@given(st.binary(max_size=60) | st.text(alphabet="thering ", max_size=60).map(str.encode))
@settings(max_examples=200, deadline=None)
def test_tree_equals_plain_merging(tools, data):
    codec = tools[3]
    assert codec._halves(data) == codec.leaf(data)


def test_full_tables_change_nothing(tools):
    tokenizer = tools[0]
    encoder = packing.Encoder(JSON, packing.same_merges(JSON))
    encoder.table.most = 5
    texts = ["one two three four", "five six seven", "one two eight", "nine ten"] * 3
    for i in range(0, len(texts), 2):
        assert [x.tolist() for x in encoder(texts[i : i + 2])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[i : i + 2]]


def brute_cost(places, penalty, size, powers):
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = places[j] - places[i]
            if n <= size and best[i] is not None:
                c = best[i] + (0 if n in powers else size - n) + penalty[j] + packing.ONE
                best[j] = c if best[j] is None else min(best[j], c)
    return best[-1]


@given(st.lists(st.integers(1, 300), min_size=1, max_size=40), st.randoms(use_true_random=False))
@settings(max_examples=100, deadline=None)
def test_cuts_are_the_cheapest(gaps, rng):
    size = 512
    places = np.concatenate([[0], np.cumsum(gaps)]).tolist()
    penalty = [rng.choice([0, 2, 12]) for _ in places]
    powers = {n for n in range(1, size + 1) if n & (n - 1) == 0}  # as the contract says: no padding at any power of two
    solver, cuts, at = packing.Cuts(size), [], 1
    while at < len(places):
        n = rng.randrange(1, 9)
        solver.extend(np.array(places[at : at + n]), np.array(penalty[at : at + n]))
        at += n
        cuts += solver.settled(at >= len(places))
    assert cuts[-1] == places[-1]
    cost, before = 0, 0
    for c in cuts:
        n = c - before
        assert 0 < n <= size
        cost += (0 if n in powers else size - n) + penalty[places.index(c)] + packing.ONE
        before = c
    assert cost == brute_cost(places, penalty, size, powers)


def packed(sizes, stretch, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    packer, rng = packing.Packer(1024, np.arange(100) < 5, 0), np.random.default_rng(4)
    out = []
    for i, n in enumerate(sizes):
        out += packer.add(i, rng.integers(0, 100, n))
    return out + list(packer.settle(True))


def test_stretches_change_nothing(monkeypatch):
    sizes = np.random.default_rng(5).integers(0, 700, 200).tolist() + [9000, 3, 0, 40]
    assert packed(sizes, 1500, monkeypatch) == packed(sizes, 20_000, monkeypatch) == packed(sizes, 1 << 30, monkeypatch)


def test_short_tails_are_not_padded(monkeypatch):
    pieces = packed([63, 31], 1 << 17, monkeypatch)  # 64 and 32 tokens with the final 0
    lengths = {}
    for p in pieces:
        lengths[p[5]] = lengths.get(p[5], 0) + p[2]
    assert sorted(lengths.values()) == [32, 64]


def test_packing(spark, tools):
    docs, _ = frames(spark)
    rows = packing.pack(docs).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for doc_id, own in texts.items():
        ids = np.array(tools[0].encode(own[0], add_special_tokens=False).ids + [0], "<u4")
        covered = sorted((r["start"], r["length"]) for r in pieces[doc_id])
        if len(own) == 1:
            assert [s for s, _ in covered] == [0, *np.cumsum([n for _, n in covered])[:-1].tolist()] and sum(n for _, n in covered) == len(ids)
        for r in pieces[doc_id]:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own]).tolist()
        assert [r["offset"] for r in own] == [0, *ends[:-1]] and ends[-1] <= 1024
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else 1024 - ends[-1]
        total += ends[-1]
    assert padding < 0.1 * total
    nothing, _ = empty(spark)
    assert packing.pack(nothing).count() == 0


def test_counts_and_round_trip(spark, tools):
    import hashlib

    docs, _ = frames(spark)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    counts = token_counts.count_tokens(docs).collect()
    trips = bpe_tree.round_trip(docs).collect()
    assert len(counts) == len(trips) == docs.count()
    for r in counts:
        n = len(tools[0].encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)
    for r in trips:
        ids = tools[4].encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    back = bpe_tree.decode_documents(bpe_tree.encode_documents(docs)).collect()
    assert all(bytes(r["data"]).decode() == texts[r["doc_id"]] for r in back)
    nothing, _ = empty(spark)
    assert token_counts.count_tokens(nothing).count() == bpe_tree.round_trip(nothing).count() == 0


def test_ranks_file():
    first = next(open(MULTI, "rb")).split()
    assert bpe_tree.load_ranks(MULTI)[base64.b64decode(first[0])] == int(first[1])
