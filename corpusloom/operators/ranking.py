"""Global order without a single task: places and running sums over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the running sum of `value` in the given order, the row itself included.

    Rows are dealt out by ranges of the order and summed within each; one total a range (a row for each
    partition) is summed in turn and sent back. The dealt rows are checkpointed: both sides must see the
    same ranges.
    """
    placed = df.withColumn("_v", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    inner = F.sum("_v").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = placed.groupBy("_part").agg(F.sum("_v").alias("_t"))
    before = totals.select("_part", (F.sum("_t").over(Window.orderBy("_part")) - F.col("_t")).alias("_b"))
    rows = placed.withColumn("_i", inner).join(F.broadcast(before), "_part")
    return rows.select(*df.columns, (F.col("_i") + F.col("_b")).alias(name))


def with_place(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place in the whole order, from 1."""
    return with_running(df, order, F.lit(1).cast("bigint"), name)
