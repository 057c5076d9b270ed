"""A graph on shared storage, its edges stored twice: in the order of sources and in the order of targets.

forward: edges in the canonical order, dealt out by ranges of it; a file holds one part, and place counts from the part's
first edge. reverse: the same edges by target, then canonical order, with their places in the whole order. bounds: for each file
its first and last node and its rows, a row a file; those of the forward side also have its part and the part's first place. nodes:
each node's first place and number of edges either way. Neighbours of a node are read from the files whose bounds hold it, and
within these from the row groups that do; of the other files nothing is opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from corpusloom.operators.graph import EDGE_ORDER, contract_problems
from corpusloom.plans.files import delete_path, exists, located
from corpusloom.plans.store import written

#: direction: (table, the end it is sorted by, its order)
_SIDES = {
    "forward": ("source", EDGE_ORDER),
    "reverse": ("target", ["target", *[c for c in EDGE_ORDER if c != "target"]]),
}


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, nodes: DataFrame, edges: DataFrame, once: bool = False) -> None:
        """nodes (node, repository, revision), edges (EDGE_ORDER). A graph that breaks its contract is refused, and nothing is stored.

        once: edges that are given repeatedly are stored once instead of being refused. Edges are moved twice, once for each side:
        equal ones meet in the range that the forward side deals them to, and its rows, stored aside, are what is checked.
        """
        nodes, stage, repeats = written(nodes.select("node", "repository", "revision")), f"{self.root}/staging/{uuid.uuid4().hex}", Observation()
        rows = edges.select(*EDGE_ORDER).repartitionByRange(*EDGE_ORDER).sortWithinPartitions(*EDGE_ORDER)
        schema = StructType([*rows.schema.fields, *_parse_datatype_string("place bigint, part int, repeated boolean").fields])
        placed = rows.mapInArrow(_placed(once), schema).observe(repeats, F.count_if("repeated").alias("n"))
        placed.drop("repeated").write.parquet(stage)
        if bad := contract_problems(nodes, self.spark.read.parquet(stage), 0 if once else repeats.get["n"]).collect():  # a row a kind
            delete_path(self.spark, stage)
            raise ValueError("; ".join(f"{r['problem']}: {r['n']}" for r in bad))
        if exists(self.spark, f"{self.root}/forward"):
            delete_path(self.spark, f"{self.root}/forward")
        target, fs = located(self.spark, f"{self.root}/forward")
        if not fs.rename(located(self.spark, stage)[0], target):
            raise OSError("the edges could not be moved into place")
        counts = nodes
        for side, (end, order) in _SIDES.items():
            if side == "reverse":  # dealt out from what the forward side has stored
                self.edges().repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{self.root}/{side}", mode="overwrite")
            held = self.spark.read.parquet(f"{self.root}/{side}")
            part = ["part"] if side == "forward" else []
            files = held.groupBy(F.input_file_name().alias("file"), *part).agg(F.min(end).alias("first"), F.max(end).alias("last"), F.count("*").alias("rows"))
            if part:  # a row a file
                files = files.withColumn("start", F.coalesce(F.sum("rows").over(Window.orderBy("part").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            files.coalesce(1).write.parquet(f"{self.root}/{side}_bounds", mode="overwrite")
            found = [F.count("*").alias(f"{side}_edges"), *([F.min("place").alias("forward_place")] if part else [])]
            counts = counts.join(self.edges(side == "forward").groupBy(F.col(end).alias("node")).agg(*found), "node", "left").fillna(0, [f"{side}_edges"])
        counts.select("node", "repository", "revision", "forward_edges", "reverse_edges", "forward_place").repartitionByRange("node").sortWithinPartitions("node").write.parquet(f"{self.root}/nodes", mode="overwrite")

    def edges(self, outgoing: bool = True, files: list[str] | None = None) -> DataFrame:
        """The edges (EDGE_ORDER, place) of one side, or those in some of its files, with their places in the whole order."""
        where = f"{self.root}/{'forward' if outgoing else 'reverse'}"
        schema = self.spark.read.parquet(where).schema
        rows = self.spark.read.schema(schema).parquet(*(files or [where])) if files != [] else self.spark.createDataFrame([], schema)
        if outgoing:
            starts = dict(self.spark.read.parquet(f"{where}_bounds").select("part", "start").collect())  # a row a file
            each = F.array(*[F.lit(starts.get(p, 0)).cast("bigint") for p in range(max(starts, default=0) + 1)])
            rows = rows.withColumn("place", F.col("place") + F.element_at(each, F.col("part") + 1))
        return rows.select(*EDGE_ORDER, "place")

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/nodes")

    def files(self, node, outgoing: bool = True) -> list[str]:
        """The files that may hold a node's edges."""
        side = "forward" if outgoing else "reverse"
        rows = self.spark.read.parquet(f"{self.root}/{side}_bounds").where((F.col("first") <= node) & (F.col("last") >= node))
        return [r["file"] for r in rows.orderBy("file").collect()]

    def neighbours(self, node, outgoing: bool = True) -> DataFrame:
        """A node's edges in canonical order with their place in it."""
        end, order = _SIDES["forward" if outgoing else "reverse"]
        return self.edges(outgoing, self.files(node, outgoing)).where(F.col(end) == node).orderBy(*order)

    def expand(self, nodes: DataFrame, outgoing: bool = True) -> DataFrame:
        """(node, …edge) for many nodes (node): a join on the sorted end."""
        end = _SIDES["forward" if outgoing else "reverse"][0]
        return self.edges(outgoing).join(nodes.select(F.col("node").alias(end)).distinct(), end)

    def validate(self) -> None:
        """Holds what is stored against the contract: counts, ends and spans, and the order of rows within and between files, in one pass a side."""
        nodes, problems = self.nodes(), []
        for side, (end, order) in _SIDES.items():
            held = self.spark.read.parquet(f"{self.root}/{side}")
            bounds = self.spark.read.parquet(f"{self.root}/{side}_bounds").orderBy("first", "last").collect()  # a row a file
            if any(a["last"] > b["first"] for a, b in zip(bounds, bounds[1:], strict=False)):
                problems.append(f"{side}: files overlap")
            problems += [f"{side}: {r['file']} is not in order" for r in held.select(F.input_file_name().alias("_file"), *order).mapInArrow(_disordered(order), "file string").distinct().collect()]
            counts = held.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("_n"))
            if counts.join(nodes, "node", "full").where(F.coalesce("_n", F.lit(0)) != F.coalesce(f"{side}_edges", F.lit(-1))).limit(1).count():
                problems.append(f"{side}: edges and counts differ")
        problems += [f"{r['problem']}: {r['n']}" for r in contract_problems(nodes, self.spark.read.parquet(f"{self.root}/forward")).collect()]
        if problems:
            raise ValueError("; ".join(problems))


def _placed(once: bool):
    """Sorted edges with place and part, and repeated: whether a row is the first to repeat the one before it. once: rows that repeat are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last, again = TaskContext.get().partitionId(), 0, None, False
        for batch in batches:
            if not len(batch):
                continue
            same = np.ones(len(batch) - (last is None), bool)
            for i, column in enumerate(batch.columns):
                both = column if last is None else pa.concat_arrays([last.column(i), column])
                a, b = both.slice(0, len(both) - 1), both.slice(1)
                same &= pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
            same = same if last is not None else np.r_[False, same]
            first, last, again = same & ~np.r_[again, same[:-1]], batch.slice(len(batch) - 1), same[-1]
            if once:
                batch, first = batch.filter(pa.array(~same)), first[~same]
            places = pa.array(np.arange(place, place := place + len(batch)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, places, pa.array(np.full(len(batch), part, np.int32)), pa.array(first)], names=[*batch.schema.names, "place", "part", "repeated"])

    return run


def _disordered(order: list[str]):
    """Names of files whose neighbouring rows are not in ascending order, all keys alike being out of order too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            names, keys = batch.column(0).to_pylist(), list(zip(*(batch.column(c).to_pylist() for c in order), strict=True))
            bad = set()
            for name, key in zip(names, keys, strict=True):
                if last and last[0] == name and last[1] >= key:
                    bad.add(name)
                last = (name, key)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(bad), pa.string())], names=["file"])

    return run
