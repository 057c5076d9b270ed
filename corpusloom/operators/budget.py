"""Greedy admission under a budget, in one global order.

A row takes from the budget of its group if it fits what is left, else it takes nothing: each verdict hangs on all before it,
and a running sum can't tell. Rows are dealt out by ranges of the order, and what a range needs to know is the state at its
start. For a group within one range that is the empty state. For a group over several ranges, few numbers a range (rows,
bytes, least and largest size for each power of two) tell what it takes from what is left: nothing if its least size is
more; all of the sizes that fit if these fit together. Only a range for which neither holds is read on the way, by one task, for
its end state. Then every range streams its own rows, all at the same time, in constant memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Budget:
    """Limits: bytes of one row, rows of a group, bytes of a group."""

    file_bytes: int
    files: int
    total_bytes: int

    def verdict(self, size: int, n: int, used: int) -> str:
        if size > self.file_bytes:
            return "oversized"
        if n >= self.files:
            return "file_limit"
        return "total_bytes" if used + size > self.total_bytes else "ok"


@dataclass(frozen=True)
class Sizes:
    """Rows of one power of two: how many, their bytes, the least and the largest."""

    rows: int
    total: int
    least: int
    most: int


def passed(budget: Budget, sizes: list[Sizes], n: int, used: int) -> tuple[int, int] | None:
    """The state after a range with these sizes (none over file_bytes), or None where its order decides."""
    left = budget.total_bytes - used
    if n >= budget.files:
        return n, used
    fitting = [s for s in sizes if s.least <= left]
    if not fitting:
        return n, used
    rows, total = sum(s.rows for s in fitting), sum(s.total for s in fitting)
    if all(s.most <= left for s in fitting) and n + rows <= budget.files and total <= left:
        return n + rows, used + total
    return None


def _folded(budget: Budget, batches: Iterator[pa.RecordBatch], n: int, used: int) -> tuple[int, int]:
    for batch in batches:
        for size in batch.column("_size").to_pylist():
            if budget.verdict(size, n, used) == "ok":
                n, used = n + 1, used + size
    return n, used


def admitted(df: DataFrame, size: Column, order: list[Column], budget: Budget, group: Column | None = None) -> DataFrame:
    """df with verdict: oversized, file_limit, total_bytes or ok, for the rows of each group in the order given.

    Nulls in size count 0. The order should have no ties: rows that tie may stand either way. One shuffle, by ranges; the rows are
    checkpointed, as the ranges must stay what they are.
    """
    order_columns = [F.coalesce(group.cast("string"), F.lit("")) if group is not None else F.lit(""), *order]
    rows = df.withColumn("_size", F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))).withColumn("_group", order_columns[0])
    sorts = [F.col("_group"), *order]
    placed = rows.repartitionByRange(*sorts).sortWithinPartitions(*sorts).withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()).checkpoint()

    ends = placed.groupBy("_group", "_part").agg(F.count("*").alias("_rows"))
    spread = ends.withColumn("_parts", F.count("*").over(Window.partitionBy("_group"))).where(F.col("_parts") > 1)  # at most two groups a range
    small = placed.where(F.col("_size") <= budget.file_bytes).withColumn("_log", F.floor(F.log2(F.greatest("_size", F.lit(1)))).cast("int"))
    sums = small.join(spread.select("_group", "_part"), ["_group", "_part"]).groupBy("_group", "_part", "_log").agg(
        F.count("*").alias("rows"), F.sum("_size").alias("total"), F.min("_size").alias("least"), F.max("_size").alias("most")
    )
    found: dict[tuple, list[Sizes]] = {(r["_group"], r["_part"]): [] for r in spread.select("_group", "_part").collect()}
    for r in sums.collect():
        found[r["_group"], r["_part"]].append(Sizes(r["rows"], r["total"], r["least"], r["most"]))

    starts: dict[tuple, tuple[int, int]] = {}
    last, state = None, (0, 0)
    for name, part in sorted(found):
        state = state if name == last else (0, 0)
        last = name
        starts[name, part] = state
        state = passed(budget, found[name, part], *state) or _streamed(placed, name, part, budget, state)
    return _verdicts(placed, starts, budget, df.columns)


def _streamed(placed: DataFrame, name: str, part: int, budget: Budget, state: tuple[int, int]) -> tuple[int, int]:
    """The state after one range, read by one task."""
    rows = placed.where((F.col("_part") == part) & (F.col("_group") == name)).select("_mid", "_size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist([dict(zip(("n", "used", "rows"), (*_folded(budget, counted(batches, seen), *state), seen[0]), strict=True))])

    seen = [0]

    def counted(batches: Iterator[pa.RecordBatch], seen: list[int]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen[0] += len(b)
            yield b

    # a filter keeps the order and the partitions of the checkpoint: all rows of the range are in one task, in order
    r = rows.mapInArrow(run, "n bigint, used bigint, rows bigint").where("rows > 0").first()
    return (r["n"], r["used"]) if r else state


def _verdicts(placed: DataFrame, starts: dict[tuple, tuple[int, int]], budget: Budget, columns: list[str]) -> DataFrame:
    known = json.dumps([[g, p, *s] for (g, p), s in starts.items()])  # at most two entries a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = {(g, p): (n, used) for g, p, n, used in json.loads(known)}
        last, n, used = object(), 0, 0
        for batch in batches:
            verdicts = []
            for name, part, size in zip(*(batch.column(c).to_pylist() for c in ("_group", "_part", "_size")), strict=True):
                if name != last:
                    last, (n, used) = name, begin.get((name, part), (0, 0))
                verdict = budget.verdict(size, n, used)
                if verdict == "ok":
                    n, used = n + 1, used + size
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdicts, pa.string())], names=[*batch.schema.names, "verdict"])

    schema = T.StructType([*placed.schema.fields, T.StructField("verdict", T.StringType())])
    return placed.mapInArrow(run, schema).select(*columns, "verdict")
