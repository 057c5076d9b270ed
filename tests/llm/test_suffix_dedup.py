"""Repeated passages against a brute-force search of all windows."""

import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import suffix_dedup

from .tables import SCHEMA, empty, rows


def brute(docs, length):
    """doc -> (n_bytes, n_removed, n_spans, kept) for (doc_id, text) in order."""
    seen, out = set(), []
    for doc_id, text in docs:
        raw = (text or "").encode()
        covered = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                covered[p : p + length] = [True] * length
            seen.add(w)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((doc_id, len(raw), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(raw, covered) if not c)).hexdigest()))
    return sorted(out, key=str)


def found(spark, docs, **how):
    frame = spark.createDataFrame([(d, t, None, None, None, 0.5, "x", "k") for d, t in docs], SCHEMA).repartition(3)
    return sorted([tuple(r)[:5] for r in suffix_dedup.deduplicated(frame, **how).collect()], key=str)


def planted(seed, alphabet="abé \n"):
    """Texts with shared passages at other places, near copies, periods, and one very long text."""
    rng = random.Random(seed)

    def word(n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    passages = [word(rng.randrange(20, 90)) for _ in range(6)]
    docs = []
    for i in range(60):
        text = "".join(rng.choice([word(rng.randrange(30)), rng.choice(passages), rng.choice(passages)[rng.randrange(9) :]]) for _ in range(rng.randrange(8)))
        docs.append((i, text))
    near = list(docs[7][1] + passages[0] + passages[1])
    for i in range(60, 75):
        x = list(near)
        x[rng.randrange(len(x))] = "Z"
        docs.append((i, "".join(x)))
    docs += [(80, "ab" * 300), (81, "a" * 500), (82, "xab" * 40 + "a" * 90), (83, word(4000) + passages[2] + word(3000)), (84, passages[2]), (85, "")]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    docs = planted(seed)
    assert found(spark, docs, length=40, widths=(20,), symbol=5) == brute(docs, 40)


def test_two_rounds_of_names_and_two_widths(spark):
    docs = planted(3)
    assert found(spark, docs, length=40, widths=(15, 33), symbol=2) == brute(docs, 40)


def test_production_parameters_and_odd_rows(spark):
    docs = [(r[0], r[1]) for r in rows(60)[0]]
    docs += [(None, "later, without an id. " * 8), (500, "later, without an id. " * 8), (501, docs[11][1]), (501, docs[11][1]), (502, "short"), (502, "short"), (502, "another " * 30)]
    ties = {}
    for d, t in docs:
        ties.setdefault((d, t or ""), []).append((d, t))
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(t or "",) for _, t in docs], "t string").selectExpr("t", "xxhash64(t)").collect()}
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1] or ""]))
    assert found(spark, docs) == brute(order, 100)


def test_empty_table(spark):
    assert suffix_dedup.deduplicated(empty(spark)[0]).collect() == []


def test_spans_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPAN", 1000)
    docs = planted(4)
    assert found(spark, docs, length=40, widths=(20,), symbol=5) == brute(docs, 40)


def test_anchors_of_tiles_are_those_of_the_whole(monkeypatch):
    data = np.random.default_rng(5).integers(0, 3, 3000).astype(np.uint8)
    data[700:1900] = data[1750:2950]
    data[2000:2300] = 7
    monkeypatch.setattr(suffix_dedup, "TILE", 1 << 20)
    at, h = suffix_dedup.anchors(data, 100, 50)
    for tile in (64, 1000, 2900, 2901):
        monkeypatch.setattr(suffix_dedup, "TILE", tile)
        got = suffix_dedup.anchors(data, 100, 50)
        assert (got[0] == at).all() and (got[1] == h).all()
    raw = data.tobytes()
    assert all(raw[a : a + 50] in raw[i : i + 100] for i, a in enumerate(at.tolist()))
