"""The adjacency graph of chunks: build, neighbours, offsets, bounded expansion, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.ranking import with_running


def adjacency(chunks: DataFrame, key: str, scope: list[str], order: str) -> DataFrame:
    """Edges from each chunk to the next one of its scope: a window, where a self-join would shuffle twice."""
    after = F.lead(key).over(Window.partitionBy(*scope).orderBy(order))
    edges = chunks.select(*scope, F.col(key).alias("source"), after.alias("target")).where("target is not null")
    return edges.select("*", F.lit("adjacent-next").alias("relation"), F.lit(True).alias("verified"), F.lit(255).alias("confidence"))


def offsets(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """How many edges each node has at `end`, and how many the nodes before it have together."""
    counts = nodes.select("node").join(edges.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("n")), "node", "left").fillna(0, ["n"])
    return with_running(counts, [F.asc("node")], F.col("n"), "_sum").select("node", "n", (F.col("_sum") - F.col("n")).alias("offset"))


def neighbours(edges: DataFrame, node, outgoing: bool = True) -> DataFrame:
    near, far = ("source", "target") if outgoing else ("target", "source")
    return edges.where(F.col(near) == node).select(F.col(far).alias("node"), "relation")


def expanded(edges: DataFrame, seeds: DataFrame, hops: int = 2, fan: int = 4, most: int = 24) -> DataFrame:
    """Nodes within `hops` of each seed, at most `fan` edges of a type from a node, `most` nodes a seed, no node twice on a path; the fewest hops count."""
    place = Window.partitionBy("source", "relation").orderBy(F.desc("confidence"), "target")
    kept = edges.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= fan).select("source", "target")
    found = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"), F.array("node").alias("path"))
    front = found
    for hop in range(1, hops + 1):
        front = (
            front.join(kept, front["node"] == kept["source"])
            .where(~F.array_contains("path", F.col("target")))
            .select("seed", F.col("target").alias("node"), F.lit(hop).alias("hop"), F.concat("path", F.array("target")).alias("path"))
        )
        found = found.unionByName(front)
    best = found.groupBy("seed", "node").agg(F.min("hop").alias("hop"))
    order = Window.partitionBy("seed").orderBy("hop", "node")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def problems(nodes: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """(problem, n): ends that are no nodes, edges between scopes, repeated nodes and edges to themselves; only those that occur."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).join(nodes, "node", "left_anti")
    a = nodes.select(F.col("node").alias("source"), F.col(scope).alias("_a"))
    b = nodes.select(F.col("node").alias("target"), F.col(scope).alias("_b"))
    crossing = edges.join(a, "source").join(b, "target").where("_a <> _b")
    twice = nodes.groupBy("node").count().where("count > 1")
    out = None
    for name, rows in (("dangling", ends), ("crossing", crossing), ("repeated", twice), ("loop", edges.where("source = target"))):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


#: The order of edges in which a graph is stored; two edges that agree in all of these are one.
EDGE_ORDER = ["source", "target", "evidence_node", "start_line", "end_line", "start_byte", "end_byte", "relation", "extractor", "confidence", "verified"]


def contract_problems(nodes: DataFrame, edges: DataFrame, repeats: int | None = None) -> DataFrame:
    """(problem, n) of nodes (node, repository, revision) and edges (EDGE_ORDER): only those that occur.

    dangling: an end, or the evidence, is no node. crossing: source, target and evidence differ in repository or revision.
    span: lines or bytes end before they start. metadata: a blank relation or extractor. repeated_node, repeated_edge.
    repeats: how many edges are repeated, where that is known already.
    """
    ends = edges.select(F.explode(F.array("source", "target", "evidence_node")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))  # combined before they move
    placed = edges.select("source", "target", "evidence_node").distinct()
    if nodes.select("repository", "revision").distinct().limit(2).count() < 2:  # with one scope nothing can cross
        placed = placed.limit(0)
    scope = lambda name: nodes.select(F.col("node").alias(name), F.struct("repository", "revision").alias(f"_{name}"))
    placed = placed.join(scope("source"), "source").join(scope("target"), "target").join(scope("evidence_node"), "evidence_node")
    found = {
        "dangling": ends.join(nodes, "node", "left_anti"),
        "crossing": placed.where((F.col("_source") != F.col("_target")) | (F.col("_source") != F.col("_evidence_node"))),
        "span": edges.where((F.col("start_line") > F.col("end_line")) | (F.col("start_byte") > F.col("end_byte"))),
        "metadata": edges.where((F.trim("relation") == "") | (F.trim("extractor") == "") | F.col("relation").isNull() | F.col("extractor").isNull()),
        "repeated_node": nodes.groupBy("node").count().where("count > 1"),
        "repeated_edge": edges.groupBy(*EDGE_ORDER).count().where("count > 1") if repeats is None else nodes.sparkSession.range(repeats),
    }
    out = None
    for name, rows in found.items():
        number = F.coalesce(F.sum("n"), F.lit(0)) if name == "dangling" else F.count("*")
        one = rows.agg(number.alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")
