"""Embedding that can stop anywhere and go on: rows in blocks, each landed by its own task, and a bitmap of what has landed.

Below `root`: identity.json (model, profile, what is embedded; another identity is refused), plan/ (each row's block and slot),
landed/ (vectors, written by the tasks of every run), complete.json. A block is one task's output and is committed when that
task ends, so a run that fails keeps the blocks that were done; rows of a block that have no sound vector are holes too.
The next run embeds the holes and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.ranking import with_place
from corpusloom.operators.vectors import Profile, normalised, verdict
from corpusloom.plans.files import exists, read_text, write_text
from corpusloom.plans.store import inventory

#: Rows of a block; a bitmap has one bit for each.
BLOCK_ROWS = 4096

Provider = Callable[[list[str]], list[list[float] | None]]


class EmbeddingRun:
    """rows (key, text): keys must not repeat. Opening a root that is there needs no rows, but the same identity."""

    def __init__(self, spark: SparkSession, root: str, key: str, model: str, profile: Profile, rows: DataFrame | None = None, block_rows: int = BLOCK_ROWS):
        if not 0 < block_rows <= 32768:
            raise ValueError("a block has 1 to 32768 rows")
        self.spark, self.root, self.key, self.profile = spark, root.rstrip("/"), key, profile
        if rows is not None:
            inputs = rows.select(key, F.concat(F.lit(profile.passage_prefix), "text").alias("text"))
            whole = inventory(inputs.select(F.concat(F.col(key).cast("string"), F.lit(":"), F.sha2("text", 256)).alias("row")), "row")
        own = {"model": model, "profile": vars(profile), "key": key, "block_rows": block_rows}
        if exists(spark, f"{self.root}/identity.json"):
            found = json.loads(read_text(spark, f"{self.root}/identity.json"))
            if found["settings"] != own or rows is not None and found["inputs"] != whole:
                raise ValueError("another model, profile or input than these vectors were begun with")
            return
        if rows is None:
            raise ValueError("nothing has been begun here")
        placed = with_place(inputs, [F.asc(key)]).withColumn("place", F.col("place") - 1)
        plan = placed.select(key, "text", F.floor(F.col("place") / block_rows).cast("bigint").alias("block"), (F.col("place") % block_rows).cast("int").alias("slot"))
        plan.write.parquet(f"{self.root}/plan", mode="overwrite")
        write_text(spark, f"{self.root}/identity.json", json.dumps({"settings": own, "inputs": whole}, sort_keys=True), overwrite=False)

    def plan(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/plan")

    def vectors(self) -> DataFrame:
        """(key, block, slot, embedding) of what has landed, each row once."""
        schema = T.StructType([*self.plan().drop("text").schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
        if not exists(self.spark, f"{self.root}/landed"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/landed")
        return rows.dropDuplicates(["block", "slot"])

    def progress(self) -> DataFrame:
        """(block, rows, landed, bitmap): the bitmap has a bit for each slot whose vector is there."""
        found = self.vectors().groupBy("block").agg(F.count("*").alias("landed"), F.bitmap_construct_agg(F.col("slot").cast("bigint")).alias("bitmap"))
        return self.plan().groupBy("block").agg(F.count("*").alias("rows")).join(found, "block", "left").select("block", "rows", F.coalesce("landed", F.lit(0)).alias("landed"), "bitmap")

    def holes(self) -> DataFrame:
        """Rows without a vector: only blocks whose bitmap isn't full are looked into."""
        left = self.progress().where(F.col("landed") < F.col("rows")).select("block", "bitmap")
        rows = self.plan().join(left, "block")
        byte = F.when(F.col("bitmap").isNotNull(), F.conv(F.hex(F.substring("bitmap", F.floor(F.col("slot") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"))
        bit = F.coalesce(F.expr("shiftright(_byte, slot % 8) & 1"), F.lit(0))
        return rows.withColumn("_byte", byte).where(bit == 0).drop("bitmap", "_byte")

    def run(self, provider: Provider) -> int:
        """Embeds the holes, one task a block; how many are left. provider: vectors of texts, None for one that it can't embed."""
        holes = self.holes()
        key, size = self.key, self.profile.dimension
        schema = self.vectors().schema

        def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = provider(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "block", "slot")), pa.array(made, pa.list_(pa.float64()))], names=[key, "block", "slot", "embedding"])

        blocks = max(1, holes.select("block").distinct().count())
        rows = holes.repartition(blocks, "block").mapInArrow(embed, schema)
        sound = rows.where(verdict(F.col("embedding"), size, unit=False).isNull())
        if self.profile.normalised:
            sound = sound.withColumn("embedding", normalised(F.col("embedding")))
        # by version 2 a task's files are in place when the task commits, whatever becomes of the job
        sound.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("mapreduce.fileoutputcommitter.cleanup-failures.ignored", "true").parquet(f"{self.root}/landed", mode="append")
        return self.holes().count()

    def finish(self) -> DataFrame:
        """(key, embedding) of all rows; an error while there are holes. What is complete is marked with its count and digest."""
        if left := self.holes().count():
            raise ValueError(f"{left} rows have no vector yet")
        found = self.vectors().select(self.key, "embedding")
        mark = f"{self.root}/complete.json"
        counted = inventory(found, self.key)
        if exists(self.spark, mark):
            if json.loads(read_text(self.spark, mark)) != counted:
                raise ValueError("vectors differ from what was complete")
        else:
            write_text(self.spark, mark, json.dumps(counted))
        return found
