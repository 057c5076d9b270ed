"""Snapshots of selected commits: what is equal is reused, what is near is derived, and only the rest is worked on.

A request names a commit for each repository (history.resolved finds them from branches, tags and ids). Its identity is
that selection with the configuration, the versions and the model. A snapshot that has this identity is handed out as it is.
Otherwise the nearest one with the same configuration, versions and model is the base: documents that it has keep their
chunks, contents that it has keep their vectors, and new documents are chunked and new contents embedded (an
embedding.EmbeddingRun, which goes on where a former attempt stopped). Each snapshot's tables are whole, so a base may be deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.vectors import Profile
from corpusloom.plans.embedding import EmbeddingRun, Provider
from corpusloom.plans.files import delete_path, exists, listed_folders, read_text, write_text
from corpusloom.plans.store import snapshot_id, written


@dataclass(frozen=True)
class Answer:
    """How a request was met: reused, derived or built, and what was worked on for it."""

    name: str
    how: str
    base: str | None
    chunked: int
    embedded: int


class Snapshots:
    """chunk: documents (document_id, …) to chunks (document_id, chunk_id, content_key, text), for each document by itself."""

    def __init__(self, spark: SparkSession, root: str, chunk: Callable[[DataFrame], DataFrame], provider: Provider, model: str, profile: Profile, configuration: str = "", versions: dict[str, str] | None = None):
        self.spark, self.root, self.chunk, self.provider = spark, root.rstrip("/"), chunk, provider
        self.model, self.profile, self.configuration, self.versions = model, profile, configuration, versions or {}

    def known(self) -> dict[str, dict]:
        """The records of complete snapshots: a few numbers each."""
        where = f"{self.root}/snapshots"
        if not exists(self.spark, where):
            return {}
        marks = {n: f"{where}/{n}/complete.json" for n in listed_folders(self.spark, where)}
        return {n: json.loads(read_text(self.spark, m)) for n, m in marks.items() if exists(self.spark, m)}

    def table(self, name: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/snapshots/{name}/{table}")

    def nearest(self, commits: dict[str, str]) -> str | None:
        """The snapshot of the same kind with most of the commits, then with most of the repositories, then the latest."""
        kind = [self.configuration, self.versions, self.model]
        alike = {n: r for n, r in self.known().items() if r["kind"] == kind}
        same = lambda r: sum(r["commits"].get(k) == v for k, v in commits.items())
        return max(alike, key=lambda n: (same(alike[n]), len(commits.keys() & alike[n]["commits"].keys()), alike[n]["number"], n), default=None)

    def request(self, commits: dict[str, str], documents: DataFrame) -> Answer:
        """commits: repository to commit; documents: those of the commits' trees (document_id, …), read only if the snapshot isn't there."""
        name = snapshot_id(commits, self.configuration, self.versions, self.model)
        path = f"{self.root}/snapshots/{name}"
        if exists(self.spark, f"{path}/complete.json"):
            return Answer(name, "reused", None, 0, 0)
        base = self.nearest(commits)
        documents.write.parquet(f"{path}/documents", mode="overwrite")
        held = self.table(name, "documents")
        fresh = held if base is None else held.join(self.table(base, "documents").select("document_id"), "document_id", "left_anti")
        self.chunk(fresh).select("document_id", "chunk_id", "content_key", "text").write.parquet(f"{path}/chunks", mode="overwrite")
        # the base has the vectors of all that it has chunks of, so only new documents' contents can be missing
        missing = self.table(name, "chunks").groupBy("content_key").agg(F.min("text").alias("text"))
        if base is not None:
            missing = missing.join(self.table(base, "vectors").select("content_key"), "content_key", "left_anti")
        missing = written(missing, f"{path}/embedding")  # it is read several times
        if base is not None:
            kept = self.table(base, "chunks").join(held.select("document_id"), "document_id", "left_semi")
            kept.select("document_id", "chunk_id", "content_key", "text").write.parquet(f"{path}/chunks", mode="append")
        keys = self.table(name, "chunks").select("content_key").distinct()
        have = None if base is None else self.table(base, "vectors").join(keys, "content_key", "left_semi")
        n, vectors = missing.count(), have
        if n:
            run = EmbeddingRun(self.spark, f"{path}/embedding/run", "content_key", self.model, self.profile, missing)
            if left := run.run(self.provider):
                raise ValueError(f"{left} contents could not be embedded")
            vectors = run.finish() if have is None else have.unionByName(run.finish())
        if vectors is None:
            vectors = self.spark.createDataFrame([], "content_key string, embedding array<double>")
        vectors.select("content_key", "embedding").write.parquet(f"{path}/vectors", mode="overwrite")
        delete_path(self.spark, f"{path}/embedding")
        record = {"commits": commits, "kind": [self.configuration, self.versions, self.model], "number": len(self.known()), "base": base}
        answer = Answer(name, "built" if base is None else "derived", base, fresh.count(), n)
        write_text(self.spark, f"{path}/complete.json", json.dumps(record, sort_keys=True), overwrite=False)
        return answer
