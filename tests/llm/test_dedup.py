import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints, simhash_dedup

from .tables import empty, frames


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, near):
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if near(a, b):
                parent[top(a)] = top(b)
    groups = defaultdict(set)
    for v in values:
        groups[top(v)].add(v)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("text", [None, "", "one", "One two  three", "a b c d e\tf\n\x0bg", "É é İ", "x " * 5000])
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) == brute_fingerprint(text)


@given(st.text(max_size=80))
@settings(max_examples=100, deadline=None)
def test_fingerprint_of_any_text(text):
    assert simhash_dedup.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_bit_sliced_forest_against_all_pairs(radius):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    values = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for s in seeds for _ in range(9)})
    a, b = simhash_dedup.forest(np.array(values, np.uint64).reshape(-1, 1), np.zeros(len(values), np.int64), radius)
    links = {(values[x], values[y]) for x, y in zip(a.tolist(), b.tolist())}
    got = components(values, lambda x, y: (x, y) in links or (y, x) in links)
    assert got == components(values, lambda x, y: (x ^ y).bit_count() <= radius)


def test_groups_stay_apart():
    values = np.array([1, 1, 3, 2, 3], np.uint64).reshape(-1, 1)
    a, b = simhash_dedup.forest(values, np.array([5, 5, 5, 9, 9]), 1)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (0, 2), (3, 4)]


def test_tables_hold_all_pairs_within_the_radius():
    masks = simhash_dedup.block_tables(64, 4, 2)
    rng = random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("tile", [3, 2048])
def test_links_with_small_tiles(spark, tile):
    rng = random.Random(tile)
    seeds = [rng.getrandbits(63) for _ in range(6)]
    values = sorted({s ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(4))) for s in seeds for _ in range(12)})
    fps = spark.createDataFrame([(v,) for v in values], "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash_dedup.components(simhash_dedup.links(fps, 4, tile=tile)).collect()}
    groups = defaultdict(set)
    for v in values:
        groups[roots.get(v, v)].add(v)
    assert {frozenset(g) for g in groups.values()} == components(values, lambda x, y: (x ^ y).bit_count() <= 4)
    assert all(root == min(groups[root]) for root in groups)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in simhash_dedup.components(edges).collect()}
    assert {found[i] for i in range(61)} == {0} and found[101] == 100


def test_near_duplicates(spark):
    docs, _ = frames(spark, 60)
    found = simhash_dedup.near_duplicates(docs)
    rows = found.collect()
    assert len(rows) == docs.count() and found.columns == ["doc_id", "fingerprint", "component_id"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    assert all(prints[i] == brute_fingerprint(texts[i]) for i in texts)
    ids = [i for i in texts if i is not None]
    for group in components(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4):
        assert {r["component_id"] for r in rows if r["doc_id"] in group} == {min(group)}
    blank = {r["component_id"] for r in rows if r["doc_id"] in (60, 61, 62)}
    assert blank == {60}
    nothing, _ = empty(spark)
    assert simhash_dedup.near_duplicates(nothing).count() == 0


def test_wide_fingerprints_catch_near_copies_and_leave_others(spark):
    docs, _ = frames(spark, 60)
    groups = simhash_dedup.near_duplicates_by_similarity(docs)
    by = {r["doc_id"]: r["component_id"] for r in groups.collect()}
    assert by[10] == by[11] == by[20] == by[30] == 10
    assert by[40] == 40 and by[41] == 41
    kept = simhash_dedup.one_of_each(docs, groups)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns
    assert 10 in ids and 11 not in ids and 20 not in ids and ids.count(3) == 1 and None in ids


def test_a_row_goes_by_its_id_and_text(spark):
    a, b = "one two three four five six seven", "entirely other words stand in this text here"
    rows = [(0, a), (1, a), (1, b), (1, b), (None, b), (None, "x y z"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, "p") for r in rows], "doc_id bigint, text string, node string")
    kept = simhash_dedup.one_of_each(docs, simhash_dedup.near_duplicates_by_similarity(docs.drop("node")))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(0, a), (1, b), (None, "x y z"), (2, None)], key=str)
    assert kept.columns == docs.columns
    nothing = docs.limit(0)
    assert simhash_dedup.one_of_each(nothing, simhash_dedup.near_duplicates_by_similarity(nothing)).count() == 0


@given(st.sets(st.integers(0, 1 << 64), max_size=60), st.sets(st.integers(0, 1 << 64), max_size=60))
@settings(max_examples=100, deadline=None)
def test_bitmaps_bound_what_sets_share(left, right):
    a, b = ({h & (1 << 64) - 1 for h in x} for x in (left, right))
    maps = [int.from_bytes(simhash_dedup.bitmap(np.array(sorted(x), np.uint64)), "little") for x in (a, b)]
    assert 2 * len(a & b) <= len(a) + len(b) - (maps[0] ^ maps[1]).bit_count()


@pytest.mark.parametrize("ids", [[-(1 << 63), -5, -5, 0, 3, (1 << 63) - 1, None, None], list(range(300)), [7] * 40 + [None] * 30 + [8], [1]])
def test_next_documents_whatever_the_ids(spark, monkeypatch, ids):
    """Every row's next document by (doc_id, hash of text), null ids first, with buckets of a few rows."""
    import hashlib

    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 4)
    texts = [f"text number {i} " * 3 for i in range(len(ids))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(3)
    hashed = docs.selectExpr("doc_id", "text", "xxhash64(text) as tie").collect()
    ordered = sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))
    want = set()
    for i, r in enumerate(ordered):
        after, cut = ordered[(i + 1) % len(ordered)]["text"], len(r["text"]) // 4
        want.add((r["doc_id"], hashlib.sha256((r["text"][: len(r["text"]) - cut] + after[:cut]).encode()).hexdigest()))
    assert {(r["doc_id"], r["edited_sha256"]) for r in fingerprints.edit_likeness(docs).collect()} == want


def test_neighbours_by_block_tables(spark):
    docs, _ = frames(spark, 40)
    made = fingerprints.with_neighbours(fingerprints.edit_likeness(docs), F.col("doc_id") % 5 == 0)
    rows = made.collect()
    assert len(rows) == docs.count()
    for r in rows:
        near = sum((int(r["fingerprint"], 16) ^ int(x["fingerprint"], 16)).bit_count() <= fingerprints.RADIUS for x in rows)
        assert r["neighbours"] == (near if r["doc_id"] is not None and r["doc_id"] % 5 == 0 else None)
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_native_fingerprints(spark):
    import hashlib

    docs, _ = frames(spark, 40)
    made = fingerprints.edit_likeness(docs)
    rows = made.collect()
    assert len(rows) == docs.count()
    ordered = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[-1 if r["doc_id"] is None else r["doc_id"]].append(r)
    prints = {}
    for i, (doc_id, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        found = [r for r in by[doc_id] if r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()]
        assert found or doc_id == 3  # rows of one doc_id follow each other in the order of their hashes
        for r in found:
            assert r["n_chars"] == len(text)
            assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
            far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count() / 128
            assert abs(1 - far(r["fingerprint"], r["edited_fingerprint"]) - r["near_edited"]) < 1e-12
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    nothing, _ = empty(spark)
    assert fingerprints.edit_likeness(nothing).count() == 0


def test_fingerprints_vote(spark):
    """The packed sums against a plain count of weighted votes."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("k", "aa bb ccc aa bb d")], "k string, text string")
    got = fingerprints.fingerprinted(df, ["k"], "text").first()
    pairs = ["aa bb", "bb ccc", "ccc aa", "aa bb", "bb d"]
    hashes = spark.createDataFrame([(p,) for p in pairs], "t string").select("t", F.xxhash64("t").alias("h0"), F.xxhash64("t", F.lit(1)).alias("h1")).collect()
    for name in ("0", "1"):
        ones = [sum(len(r["t"]) for r in hashes if r["h" + name] >> b & 1) for b in range(64)]
        want = sum(1 << b for b in range(64) if 2 * ones[b] > sum(map(len, pairs)))
        assert got["f" + name] & (1 << 64) - 1 == want


def test_block_tables_find_all_neighbours(spark):
    rng = random.Random(8)
    seeds = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(5)]
    rows = []
    for i in range(60):
        a, b = rng.choice(seeds)
        for _ in range(rng.randrange(5)):
            if rng.random() < 0.5:
                a ^= 1 << rng.randrange(63)
            else:
                b ^= 1 << rng.randrange(63)
        rows.append((i, a, b))
    rows += [(60, *rows[0][1:]), (61, *rows[0][1:])]
    prints = spark.createDataFrame(rows, "doc_id bigint, f0 bigint, f1 bigint")
    queries = prints.where("doc_id % 5 = 0")
    got = {(r["query_id"], r["doc_id"], r["distance"]) for r in fingerprints.within_radius(prints, queries, 3).collect()}
    far = lambda x, y: (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count()
    assert got == {(x[0], y[0], far(x, y)) for x in rows if x[0] % 5 == 0 for y in rows if far(x, y) <= 3}


def test_similarity_groups_are_those_of_all_pairs(spark):
    """Every pair against brute force: edits around a Jaccard similarity of 0.8, isolated pairs, a hub with far members, copies."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for i in range(150):
        base = [word() for _ in range(rng.choice([9, 40, 120, 300]))]
        other = list(base)
        for at in rng.sample(range(len(base)), max(1, round(len(base) * rng.uniform(0.005, 0.04)))):
            other[at] = word()
        texts += [" ".join(base), " ".join(other)]
    hub = [word() for _ in range(400)]
    texts.append(" ".join(hub))
    for _ in range(40):
        far = list(hub)
        for at in rng.sample(range(400), 7):
            far[at] = word()
        texts.append(" ".join(far))
    texts += [texts[0], texts[0].upper(), "", None, " \n", "one two", "One  two", "one three"]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for t in texts]
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = components(list(range(len(texts))), lambda a, b: share(a, b) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    groups = defaultdict(set)
    for r in simhash_dedup.near_duplicates_by_similarity(docs).collect():
        groups[r["component_id"]].add(r["doc_id"])
    assert {frozenset(g) for g in groups.values()} == want
    assert all(min(g) == i for i, g in groups.items())
    edge = [share(2 * i, 2 * i + 1) for i in range(150)]
    assert sum(0.8 <= s < 0.85 for s in edge) > 5 and sum(0.6 < s < 0.8 for s in edge) > 10
