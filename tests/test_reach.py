"""Reachability labels, merge bases and reuse proofs against walks over the whole graph."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import reach


def dag(seed, n):
    """commit -> parents in order; names are shuffled, so that their order says nothing."""
    rng = random.Random(seed)
    names = [f"c{i:03d}" for i in range(n)]
    rng.shuffle(names)
    parents = {}
    for i, c in enumerate(names):
        if i == 0 or rng.random() < 0.03:
            parents[c] = []
            continue
        near = names[max(0, i - 6) : i]
        parents[c] = list(dict.fromkeys([rng.choice(near)] + [rng.choice(names[max(0, i - 15) : i]) for _ in range(rng.choice([0, 0, 0, 1, 1, 2]))]))
    return names, parents


def walk(parents, tip):
    seen, todo = set(), [tip]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += parents[c]
    return seen


def tables(spark, names, parents):
    edges = [(c, p, k) for c in names for k, p in enumerate(parents[c])]
    return spark.createDataFrame([(c,) for c in names], "commit string"), spark.createDataFrame(edges, "commit string, parent string, place int")


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_reach_what_a_walk_reaches(spark, seed):
    names, parents = dag(seed, 70)
    cut = 45
    first = reach.labelled(*tables(spark, names[:cut], parents))
    history = reach.labelled(*tables(spark, names[cut:], parents), known=first)
    assert history.labels.count() == len(names) == history.labels.select("chain", "place").distinct().count()
    assert history.links.count() <= sum(map(len, parents.values()))
    old = {tuple(r) for r in first.labels.collect()}
    assert old <= {tuple(r) for r in history.labels.collect()}
    rng = random.Random(seed)
    tips = rng.sample(names, 12)
    found = reach.reached(history, spark.createDataFrame([(t,) for t in [*tips, "unknown"]], "commit string"))
    got = {}
    for r in reach.ancestors(history, found).collect():
        got.setdefault(r["tip"], set()).add(r["commit"])
    assert got == {t: walk(parents, t) for t in tips}
    docs = spark.createDataFrame([(i, c) for i, c in enumerate(names)], "id int, revision string")
    kept = {r["revision"] for r in reach.within(docs, "revision", history, found).collect()}
    assert kept == set().union(*(walk(parents, t) for t in tips))


@pytest.mark.parametrize("seed", [3, 4])
def test_merge_bases_equal_a_search(spark, seed):
    names, parents = dag(seed, 60)
    history = reach.labelled(*tables(spark, names, parents))
    rng = random.Random(seed)
    pairs = [tuple(rng.sample(names[20:], 2)) for _ in range(15)]
    want = set()
    for a, b in pairs:
        common = walk(parents, a) & walk(parents, b)
        want |= {(a, b, c) for c in common if not any(c != d and c in walk(parents, d) for d in common)}
    got = reach.merge_bases(history, spark.createDataFrame(pairs, "current string, previous string"))
    assert {tuple(r) for r in got.collect()} == want
    when = {c: i for i, c in enumerate(names)}
    times = spark.createDataFrame(list(when.items()), "base string, at int")
    best = {}
    for a, _, c in want:
        best[a] = max(best.get(a, (-1, "")), (when[c], c))
    near = reach.nearest_base(got.join(times, "base"), [-F.col("at")])
    assert {r["current"]: r["base"] for r in near.collect()} == {a: c for a, (_, c) in best.items()}


def test_a_nearer_ancestor_of_a_base_is_none(spark):
    # both tips reach b in two steps; a, below b, is a parent of both
    parents = {"a": [], "b": ["a"], "x": ["b"], "y": ["b"], "l": ["x", "a"], "r": ["y", "a"]}
    history = reach.labelled(*tables(spark, list(parents), parents))
    got = reach.merge_bases(history, spark.createDataFrame([("l", "r")], "current string, previous string"))
    assert [r["base"] for r in got.collect()] == ["b"]


def test_reuse_proofs(spark):
    names, parents = dag(5, 50)
    history = reach.labelled(*tables(spark, names, parents))
    rng = random.Random(5)
    indexed = [(f"p{rng.randrange(2)}", f"b{rng.randrange(3)}", rng.choice(names), rng.random() < 0.6) for _ in range(40)]
    entries = [(c, f"p{rng.randrange(2)}", f"b{rng.randrange(4)}") for c in names]
    got = reach.reuse_proofs(spark.createDataFrame(entries, "commit string, path string, blob string"), spark.createDataFrame(indexed, "path string, blob string, revision string, reusable boolean"), history)
    assert {tuple(r)[:3]: r["proof"] for r in got.collect()} == {(c, p, b): any(q == p and d == b and ok and v in walk(parents, c) for q, d, v, ok in indexed) for c, p, b in entries}


def test_reuse_proofs_meet_entries_on_their_own_chains(spark):
    """One blob proved on every chain: entries meet the proofs of chains that they reach, not all of the blob's."""
    names = [f"c{i:03d}" for i in range(300)]
    commits = spark.createDataFrame([(c,) for c in names], "commit string")
    history = reach.labelled(commits, spark.createDataFrame([], "commit string, parent string, place int"))
    entries = spark.createDataFrame([(c, "p", "b") for c in names], "commit string, path string, blob string")
    indexed = spark.createDataFrame([("p", "b", c, True) for c in names[::2]], "path string, blob string, revision string, reusable boolean")
    found = reach.reuse_proofs(entries, indexed, history)
    assert {r["commit"]: r["proof"] for r in found.collect()} == {c: i % 2 == 0 for i, c in enumerate(names)}
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line and "blob#" in line]
    assert joins and all("chain#" in line for line in joins)


def test_rounds_move_only_what_is_not_at_its_chain_s_head(spark, monkeypatch):
    sizes, write = [], reach.written

    def counted(df, root=None):
        out = write(df, root)
        sizes.append((root is not None, out.count()))
        return out

    monkeypatch.setattr(reach, "written", counted)
    commits = spark.range(1064).select(F.format_string("%04d", "id").alias("commit"))
    parents = spark.range(1, 64).select(F.format_string("%04d", "id").alias("commit"), F.format_string("%04d", F.col("id") - 1).alias("parent"), F.lit(0).alias("place"))
    labels = reach.labelled(commits, parents).labels
    rounds = [n for inner, n in sizes if inner]
    assert rounds[0] == 1064 and rounds[1:] == [63, 62, 60, 56, 48, 32]
    assert {(r["commit"], r["chain"], r["place"]) for r in labels.collect()} == {(f"{i:04d}", "0000" if i < 64 else f"{i:04d}", i if i < 64 else 0) for i in range(1064)}


def test_the_history_of_the_orders_is_written_once(spark, tmp_path):
    from corpusloom.life_queries import commits, parents_of

    rows = [(k, k % 3, f"2020-01-{k:02d}") for k in range(1, 28)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate string").write.parquet(str(tmp_path / "orders.parquet"))
    made = commits(spark, str(tmp_path))
    assert "Window" not in parents_of(made)._jdf.queryExecution().optimizedPlan().toString()
    assert {r["commit"]: r["nth"] for r in made.where("repo = 1").collect()} == {k: (25 - k) // 3 + 1 for k in range(1, 28, 3)}
