"""Collocations and manifests against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import collocations, hashing, merkle

from .tables import SCHEMA, empty, rows


def mined(docs, top, least):
    """lang -> ranked phrases, counted one by one."""
    pieces = {}
    for lang, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            if words := re.findall("[^ \t]+", piece):
                pieces.setdefault(lang or "und", []).append(words)
    out = {}
    for lang, lists in pieces.items():
        f = Counter(tuple(w[i : i + k]) for w in lists for k in range(1, 5) for i in range(len(w) - k + 1))
        n = sum(map(len, lists))
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, cut = min((2_000_000 * a // (f[p[:c]] + f[p[c:]]), c) for c in range(1, len(p)))
            inside = any(len(q) > len(p) and g >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * g >= 80 * a for q, g in f.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out[lang] = [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(r for found in out.values() for r in found)


@pytest.mark.parametrize("share", [1000, 3])
def test_phrases_equal_brute_force(spark, monkeypatch, share):
    rng = random.Random(share)
    words = ["the", "of", "River", "tea", "é\x01b", "\x00", "a\x01", "x"]
    docs = []
    for _ in range(250):
        parts = [rng.choice([*words, "the River", "of the tea", "see you at noon", "..", ",", "\t", "\n", "  "]) for _ in range(rng.randrange(12))]
        docs.append((rng.choice(["en", "de", None]), " ".join(parts)))
    docs += [("en", None), ("en", ""), ("fr", " \n. "), ("en", "the " * 3000), ("de", "nul\x00nul " * 40)]
    monkeypatch.setattr(collocations, "SHARE", share)
    monkeypatch.setattr(collocations.common, "KEY_ROWS", 20)  # so that there are hot words
    monkeypatch.setattr(collocations, "HELD", 50)
    frame = spark.createDataFrame([(i, t, lang, None, None, 0.5, "x", "k") for i, (lang, t) in enumerate(docs)], SCHEMA).repartition(3)
    got = sorted(map(tuple, collocations.mined(frame, top=20, least=10).collect()))
    assert got == mined(docs, 20, 10)
    assert collocations.mined(empty(spark)[0]).collect() == []


def test_hashes_of_spans_depend_on_their_bytes_alone():
    import numpy as np

    data = np.frombuffer(b"abcabcab", np.uint8)
    starts, ends = np.array([0, 3, 1, 6, 4, 2, 2]), np.array([3, 6, 3, 8, 6, 2, 3])
    h = hashing.spans(data, starts, ends)
    assert h[0] == h[1] and h[2] == h[4] and len(set(h.tolist())) == 5


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, more=0):
    value = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in value))


def tree(nodes, fanout):
    """The root of [(digest, members)] and each member's siblings."""
    proofs = {m: "" for _, own in nodes for m in own}
    while len(nodes) > 1:
        above = []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            for h, own in run:
                for m in own:
                    proofs[m] += "".join(g for g, other in run if other is not own)
            above.append((digest("".join(h for h, _ in run)), [m for _, own in run for m in own]))
        nodes = above
    return nodes[0][0], proofs


@pytest.mark.parametrize(("levels", "fanout"), [(10, 2), (2, 2), (1, 3), (3, 5)])
def test_manifest_equals_a_tree_built_at_once(spark, levels, fanout):
    docs = [(r[0], r[1], r[2], r[3], None if k % 5 == 0 else k) for k, r in enumerate(rows(60)[0])] + [(900 + i, "x", None, "s", 3) for i in range(7)] + [(5, "twice", "de", "s", 1)] * 2
    frame = spark.createDataFrame([(*r, 0.5, "x", "k") for r in docs], SCHEMA).repartition(3)
    groups = {}
    for k, r in enumerate(docs):
        groups.setdefault(r[2], []).append(k)
    subroots, order, lower = {}, sorted(groups, key=lambda x: (x is not None, (x or "").encode())), {}
    for lang, own in groups.items():
        own.sort(key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, leaf(docs[k])))
        subroots[lang], proofs = tree([(leaf(docs[k]), [k]) for k in own], fanout)
        lower |= proofs
    root, upper = tree([(subroots[lang], [lang]) for lang in order], fanout)
    want = []
    for k, r in enumerate(docs):
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        want.append((r[0], leaf(r), subroots[r[2]], root, digest(lower[k] + upper[r[2]]), not tampered))
    got = merkle.verified(frame, levels, fanout).collect()
    assert sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in got], key=str) == sorted(want, key=str)
    assert all((r["folded_root"] == root) == r["verified"] for r in got)
    assert merkle.verified(empty(spark)[0]).collect() == []


def test_one_row_is_its_own_root(spark):
    frame = spark.createDataFrame([(1, "a", "en", "s", 1, 0.5, "x", "k")], SCHEMA)
    r = merkle.verified(frame).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == digest("") and r["verified"]


def test_tampering_is_found(spark):
    frame = spark.createDataFrame([(i, "a", "en", "s", 1, 0.5, "x", "k") for i in range(80)], SCHEMA)
    found = merkle.verified(frame)
    assert found.where(~F.col("verified")).count() == sum(zlib.crc32(str(i).encode()) % 7 == 0 for i in range(80)) > 0
