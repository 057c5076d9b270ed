"""Small files and folders on shared storage, through Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def located(spark: SparkSession, where: str):
    """A Hadoop path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, where: str, text: str, overwrite: bool = True) -> None:
    """Without overwrite, a file that is there already is an error: of two writers one fails."""
    path, fs = located(spark, where)
    out = fs.create(path, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, where: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(where, wholetext=True).collect())


def replace_text(spark: SparkSession, where: str, text: str) -> None:
    """One rename that replaces the old file: a reader finds either text, whenever the driver stops."""
    temporary = f"{where}-{uuid.uuid4().hex}"
    write_text(spark, temporary, text)
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    source, target = (located(spark, p)[0] for p in (temporary, where))
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), configuration).rename(source, target, options)


def exists(spark: SparkSession, where: str) -> bool:
    path, fs = located(spark, where)
    return fs.exists(path)


def delete_path(spark: SparkSession, where: str) -> None:
    path, fs = located(spark, where)
    fs.delete(path, True)


def listed_files(spark: SparkSession, where: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of last change) of the Parquet files below a folder, in order."""
    path, fs = located(spark, where)
    found, files = [], fs.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        if f.getPath().getName().endswith(".parquet"):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def listed_folders(spark: SparkSession, where: str) -> list[str]:
    path, fs = located(spark, where)
    return [f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()]
