"""What the operators of this subpackage share: inputs, shared storage, Arrow mapping, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: UTF-8 bytes of text that a Python operator holds at a time, besides its models and caches.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Only a local session without one gets a temporary folder; on a cluster its lack is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="corpusloom-")
            context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"


#: Of each open scratch(): the tables written since.
_OPEN: list[list[str]] = []


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again. An open scratch() deletes it unless `keep`."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside (but for kept ones) are deleted at the end: what is returned must have been written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete_path(spark, path)


#: A key with more than one row in SHARE (and more than KEY_ROWS) is hot; there are at most SHARE of them.
SHARE, KEY_ROWS = 1000, 2000


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join on `keys`, whose hot keys on the left are dealt out by salt; the right side's rows of a hot key go to each salt.

    Hot keys are found by counting first (narrow, combined before the shuffle); their list has at most SHARE
    rows, which bounds what is broadcast. Columns other than the keys must have different names.
    """
    limit = max(KEY_ROWS, left.count() // SHARE)
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    hot = written(counts.select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_salts")), "hot")
    if not hot.limit(1).count():
        return left.join(right, keys, how)
    salt = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int"), F.lit(0))
    many = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    few = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", each).drop("_salts")
    return many.join(few, [*keys, "_salt"], how).drop("_salt")


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id's decimal text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pieces(batches: Iterable[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about `most` bytes of the column `text`, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        if len(column) == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def map_text(
    df: DataFrame, columns: list[str], ddl: str, start: Callable[[], Callable[[list[list]], list[list]]], text: str = "text"
) -> DataFrame:
    """Runs a batch function over `columns` (and no others) in Arrow batches, in place, without a shuffle.

    start() makes the batch function once for each task; the function takes the columns as lists and
    returns the columns of `ddl` as lists.
    """
    schema = schema_of(ddl)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, work = arrow_schema(schema), start()
        for batch in pieces(batches, text):
            made = work([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, out, strict=True)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows: texts can be long, and the default of 10,000 rows has no bound in bytes. Smaller settings stay."""
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(option, "0")) <= 1000:
        spark.conf.set(option, "1000")


def bounded_sample(rows: DataFrame, key: str, order: str, most: int, classes: int = 1000) -> DataFrame:
    """(key, order): at most `most` different values of `order` for each value of `key`, those that come first by a hash.

    Two narrow scans: counts for each key (combined before the shuffle), then only rows whose hash lies under
    the rate that yields about 1.3 * most rows meet in a window. Repeated rows count as one. More than
    `classes` keys are an error: each would have its model on the driver.
    """
    rows = rows.select(key, order).where(F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(key).count().orderBy(key).limit(classes + 1).collect()}
    if len(counts) > classes:
        raise ValueError(f"{key} has more than {classes} values")
    if not counts:
        return rows.limit(0)
    point = F.pmod(F.xxhash64(F.col(order), F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    kind = T.StructType([rows.schema[key], T.StructField("_rate", T.DoubleType())])
    rates = rows.sparkSession.createDataFrame([(value, min(1.0, 1.3 * most / n + 20.0 / n)) for value, n in counts.items()], kind)
    first = Window.partitionBy(key).orderBy(F.xxhash64(F.col(order), F.lit("sample")), F.col(order))
    return rows.join(F.broadcast(rates), key).where(point < F.col("_rate")).drop("_rate").distinct().withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= most).drop("_place")


#: Bytes of text that the driver may take of a sample, whatever the number of its keys.
SAMPLE_BYTES = 64 << 20


def sampled_texts(docs: DataFrame, chosen: DataFrame, key: str, on: list[str], size: int) -> list[tuple[str, object]]:
    """(text, key) of the chosen rows (a bounded table, broadcast), in the order of doc_id: one text for each (the smallest of
    several), no text over `size` bytes, and about `size` bytes of each key, or its share of SAMPLE_BYTES if that is less."""
    size = min(size, SAMPLE_BYTES // max(1, chosen.select(key).distinct().count()))
    rows = docs.select("text", *on).where(F.octet_length("text") <= size).join(F.broadcast(chosen), on)
    rows = rows.groupBy(key, "doc_id").agg(F.min("text").alias("text"))
    first = Window.partitionBy(key).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id")
    held = rows.withColumn("_bytes", F.sum(F.octet_length("text")).over(first)).where(F.col("_bytes") <= size)
    return [(r["text"], r[key]) for r in sorted(held.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r[key]))]


def text_column(start: Callable[[], Callable[[list], list]], kind: str) -> Callable[[Column], Column]:
    """A column function of texts, in Arrow batches, for filters that must leave a table's other columns where they are.

    start() makes, once for each task, the function of a list of texts; it sees about PIECE_BYTES at a time.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        work = start()
        for batch in batches:
            texts, out, held, size = batch.tolist(), [], [], 0
            for t in texts:
                held.append(t)
                size += len(t or "")
                if size >= PIECE_BYTES // 2:
                    out += work(held)
                    held, size = [], 0
            yield pd.Series(out + (work(held) if held else []))

    return F.pandas_udf(run, kind)
