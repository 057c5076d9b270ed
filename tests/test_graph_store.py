"""The stored graph, both ways, and its contract."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.graph import EDGE_ORDER, contract_problems
from corpusloom.plans.graph_store import GraphStore

EDGE = "source string, target string, evidence_node string, start_line int, end_line int, start_byte int, end_byte int, relation string, extractor string, confidence int, verified boolean"


def made(spark, n=400):
    rng = random.Random(9)
    names = [f"n{i:03d}" for i in range(60)]
    edges = {(rng.choice(names), rng.choice(names + names[:1] * 40), rng.choice(names), a := rng.randrange(50), a + 2, a * 9, a * 9 + 5, rng.choice("ab"), "x", rng.randrange(3), rng.random() < 0.5) for _ in range(n)}
    return spark.createDataFrame([(x, "r", "v") for x in names], "node string, repository string, revision string"), spark.createDataFrame(sorted(edges), EDGE), sorted(edges)


def test_neighbours_are_read_from_few_files(spark, tmp_path):
    nodes, edges, rows = made(spark)
    store = GraphStore(spark, str(tmp_path / "graph"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store.write(nodes, edges)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for node in ("n000", "n031", "n059", "absent"):
        out = [tuple(r[c] for c in ["place", *EDGE_ORDER]) for r in store.neighbours(node).collect()]
        assert out == [(i, *e) for i, e in enumerate(rows) if e[0] == node]
        into = [tuple(r[c] for c in ["place", *EDGE_ORDER]) for r in store.neighbours(node, outgoing=False).collect()]
        assert into == [(i, *e) for i, e in enumerate(rows) if e[1] == node]
    assert len(store.files("n031")) < 3 and len(store.files("n031", outgoing=False)) < 3 and not store.files("absent")
    opened = store.neighbours("n031").select(F.input_file_name()).distinct().count()
    assert opened <= len(store.files("n031")) < spark.read.parquet(f"{store.root}/forward").select(F.input_file_name()).distinct().count()
    first = {r["node"]: (r["forward_place"], r["forward_edges"], r["reverse_edges"]) for r in store.nodes().collect()}
    for node, (place, n, m) in first.items():
        own = [i for i, e in enumerate(rows) if e[0] == node]
        assert (place, n, m) == (own[0] if own else None, len(own), sum(e[1] == node for e in rows))
    store.validate()
    more = store.expand(spark.createDataFrame([("n000",), ("n031",)], "node string"))
    assert more.count() == sum(e[0] in ("n000", "n031") for e in rows)


def test_edges_move_once_a_side(spark, tmp_path):
    """Repeated edges are stored once where that is asked for, in one order over all parts even with a column that is a constant; nothing is checkpointed."""
    nodes, edges, rows = made(spark)
    kept = lambda: set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("*/rdd-*"))
    store, before = GraphStore(spark, str(tmp_path / "graph")), kept()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        store.write(nodes, edges.unionByName(edges.limit(150)).withColumn("extractor", F.lit("x")), once=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert kept() == before
    for outgoing in (True, False):
        found = [tuple(r[c] for c in ["place", *EDGE_ORDER]) for r in store.edges(outgoing).collect()]
        assert sorted(found) == [(i, *e) for i, e in enumerate(rows)]
    store.validate()
    with pytest.raises(ValueError, match="repeated_edge: 150"):
        GraphStore(spark, str(tmp_path / "g")).write(nodes, edges.unionByName(edges.limit(150)).unionByName(edges.limit(150)))
    assert not (tmp_path / "g" / "forward").exists()


def test_files_out_of_order_are_found(spark, tmp_path):
    nodes, edges, _ = made(spark, 50)
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.write(nodes, edges)
    held = spark.createDataFrame(spark.read.parquet(f"{store.root}/forward").collect())
    held.orderBy(F.desc("place")).coalesce(1).write.parquet(f"{store.root}/forward", mode="overwrite")
    with pytest.raises(ValueError, match="not in order"):
        store.validate()


def test_each_broken_rule_is_named(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "r", "v"), ("b", "r", "v"), ("c", "q", "v"), ("c", "q", "v")], "node string, repository string, revision string")
    good = ("a", "b", "a", 1, 2, 3, 4, "rel", "x", 1, True)
    bad = [good, good, ("a", "z", "a", *good[3:]), ("a", "c", "a", *good[3:]), ("a", "b", "a", 5, 2, *good[5:]), ("a", "b", "a", 1, 2, 3, 4, " ", "x", 1, True)]
    frame = spark.createDataFrame(bad, EDGE)
    assert {r["problem"] for r in contract_problems(nodes, frame).collect()} == {"dangling", "crossing", "span", "metadata", "repeated_node", "repeated_edge"}
    with pytest.raises(ValueError):
        GraphStore(spark, str(tmp_path / "g")).write(nodes, frame)
    assert contract_problems(nodes.distinct(), spark.createDataFrame([good], EDGE)).count() == 0
