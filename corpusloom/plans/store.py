"""Generations on shared storage: staged tables, a manifest with counts and digests, atomic publication, version listing."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.files import located, read_text, replace_text, write_text


def inventory(df: DataFrame, key: str) -> dict:
    """Rows and an order-independent digest of the keys, summed in the tasks; repeated keys are refused."""
    part = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    row = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d"), F.sum(part).alias("s")).first()
    if row["n"] != row["d"]:
        raise ValueError(f"{key} repeats")
    return {"rows": row["n"], "digest": hashlib.sha256(str(row["s"]).encode()).hexdigest()}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only a local session may do without one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, root: str | None = None) -> DataFrame:
    """df as a Parquet table below `root`, read again: for what is read several times, which is dear from a checkpoint's serialised rows."""
    path = f"{root or scratch_dir(df.sparkSession)}/corpusloom-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Tables of one corpus below `root`: generations/<id>/<table> and active.json, the name of the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, tables: dict[str, tuple[DataFrame, str]], versions: dict[str, str] | None = None) -> str:
        """Stages the tables (DataFrame, key), names the generation by its contents, moves it into place and makes it current.

        A generation that is there already is reused; a build that stops before the move leaves nothing that a reader sees.
        """
        stage = f"{self.root}/staging/{uuid.uuid4().hex}"
        parts = {}
        for name, (df, key) in tables.items():
            df.write.parquet(f"{stage}/{name}")
            parts[name] = inventory(self.spark.read.parquet(f"{stage}/{name}"), key) | {"key": key}
        manifest = {"schema": 1, "tables": parts, "component_versions": versions or {}}
        name = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
        write_text(self.spark, f"{stage}/manifest.json", json.dumps(manifest, sort_keys=True))
        target, fs = located(self.spark, f"{self.root}/generations/{name}")
        if fs.exists(target):
            fs.delete(located(self.spark, stage)[0], True)
        else:
            fs.mkdirs(target.getParent())
            if not fs.rename(located(self.spark, stage)[0], target):
                raise OSError("the generation could not be moved into place")
        self.activate(name)
        return name

    def activate(self, name: str) -> None:
        replace_text(self.spark, f"{self.root}/active.json", json.dumps({"generation": name}))

    def active(self) -> str:
        return json.loads(read_text(self.spark, f"{self.root}/active.json"))["generation"]

    def manifest(self, name: str | None = None) -> dict:
        found = json.loads(read_text(self.spark, f"{self.root}/generations/{name or self.active()}/manifest.json"))
        if found.get("schema") != 1:
            raise ValueError("the manifest has another schema")
        return found

    def table(self, table: str, name: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/generations/{name or self.active()}/{table}")

    def validate(self, name: str | None = None) -> None:
        """Counts every table anew and holds it against the manifest."""
        for table, part in self.manifest(name)["tables"].items():
            if inventory(self.table(table, name), part["key"]) != {k: part[k] for k in ("rows", "digest")}:
                raise ValueError(f"{table} differs from the manifest")


    def stage(self, label: str, contract: dict, make: Callable[[], DataFrame], key: str) -> DataFrame:
        """The table of a build's stage: made only if there is no complete one for this contract (its inputs, settings, versions).

        The marker with count and digest is written last, so a stage that stopped half-way is made anew; one whose rows differ from its marker too.
        """
        name = hashlib.sha256(json.dumps(contract, sort_keys=True).encode()).hexdigest()
        where = f"{self.root}/stages/{label}-{name}"
        marker, fs = located(self.spark, f"{where}/complete.json")
        if fs.exists(marker):
            held = self.spark.read.parquet(f"{where}/rows")
            if inventory(held, key) == json.loads(read_text(self.spark, f"{where}/complete.json")):
                return held
            fs.delete(marker, False)
        made = make()
        made.write.parquet(f"{where}/rows", mode="overwrite")
        held = self.spark.read.schema(made.schema).parquet(f"{where}/rows")
        write_text(self.spark, f"{where}/complete.json", json.dumps(inventory(held, key)))
        return held


def snapshot_id(repositories: dict[str, str], configuration: str, versions: dict[str, str], model: str) -> str:
    """One name for a selection of commits: what is equal has an equal id, in whatever order it was given."""
    identity = {"repositories": sorted(repositories.items()), "configuration": configuration, "versions": sorted(versions.items()), "model": model}
    return hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()


def overhead(manifest_bytes: int, artifact_bytes: int) -> tuple[int, bool]:
    """Manifest bytes in hundredths of the artifacts', and whether that is material (5 or more)."""
    share = manifest_bytes * 100 // max(1, artifact_bytes)
    return share, share >= 5


def listed_versions(refs: DataFrame, snapshots: DataFrame, repositories: list[str] | None = None, kinds: list[str] | None = None, prefix: str = "") -> DataFrame:
    """refs with prepared: whether a snapshot has their commit."""
    rows = refs.where(F.col("name").startswith(prefix))
    if repositories:
        rows = rows.where(F.col("repository").isin(repositories))
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    held = snapshots.select("repository", "commit").distinct().withColumn("_h", F.lit(True))
    return rows.join(held, ["repository", "commit"], "left").select(*refs.columns, F.col("_h").isNotNull().alias("prepared"))


def resource(chunks: DataFrame, kind: str, value: str) -> DataFrame:
    """The JSON of a chunk, or of a document's chunks in order."""
    rows = chunks.where(F.col("chunk_id" if kind == "chunk" else "document_id") == value).orderBy("ordinal")
    return rows.select(F.to_json(F.struct(*chunks.columns)).alias("json"))
