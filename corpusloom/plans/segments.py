"""A lexical index that changes: immutable segments, deletions, a manifest, a merge policy, and views that searches read.

Below `root`: segments/<id>/ as lexical.write_rows makes them, deletes/<version>/segment=<id>/ with the rows of what that
version deleted, manifest-<version>.json, and current.json, which names the manifest that readers take. A change writes
new files and a new manifest, and moves current.json last; nothing that is there is ever changed, so a reader of an
older version goes on, and of two writers of one version the second fails.

Statistics are of live documents only: each segment has its totals and its dictionary, and what a deletion takes away
is kept with it, so that neither needs postings or texts.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import lexical
from corpusloom.plans.files import delete_path, listed_folders, read_text, replace_text, write_text

#: Beyond this many segments the two with the fewest live documents become one.
MOST_SEGMENTS = 32


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class SegmentedIndex:
    """key: the column that names a document, alike in all segments; fields: the columns that are searched; filters: columns that views filter by."""

    def __init__(self, spark: SparkSession, root: str, key: str = "", fields: tuple[str, ...] = (), filters: tuple[str, ...] = (), most: int = MOST_SEGMENTS):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most
        if key:
            self._publish({"version": 0, "key": key, "fields": list(fields), "filters": list(filters), "segments": {}, "deletes": []})
        state = self.state()
        self.key, self.fields, self.filters = state["key"], state["fields"], tuple(state["filters"])

    def state(self) -> dict:
        found = json.loads(read_text(self.spark, f"{self.root}/current.json"))
        return json.loads(read_text(self.spark, f"{self.root}/{found['manifest']}"))

    def _publish(self, state: dict) -> None:
        name = f"manifest-{state['version']}.json"
        write_text(self.spark, f"{self.root}/{name}", json.dumps(state, sort_keys=True), overwrite=False)
        replace_text(self.spark, f"{self.root}/current.json", json.dumps({"manifest": name}))

    def _read(self, state: dict, table: str) -> DataFrame:
        return _union([self.spark.read.parquet(f"{self.root}/segments/{s}/{table}").withColumn("segment", F.lit(s)) for s in sorted(state["segments"])])

    def _deleted(self, state: dict) -> DataFrame | None:
        """Rows of deleted documents that the segments still hold."""
        if not state["deletes"]:
            return None
        rows = _union([self.spark.read.option("basePath", f"{self.root}/deletes/{v}").parquet(f"{self.root}/deletes/{v}") for v in state["deletes"]])
        return rows.withColumn("segment", F.col("segment").cast("string")).where(F.col("segment").isin(sorted(state["segments"])))

    def _live(self, state: dict, table: str, where: Column | None = None) -> DataFrame:
        rows, gone = self._read(state, table), self._deleted(state)
        if where is not None:
            rows = rows.where(where)
        if gone is None:
            return rows
        return rows.join(gone.where(F.col("term").isNull() & (F.col("field") == self.fields[0])).select("segment", self.key), ["segment", self.key], "left_anti")

    def _written(self, rows: DataFrame | None, docs: DataFrame | None = None) -> tuple[str, int]:
        """A new segment and its documents: of documents, or of occurrences that were read from others."""
        name = uuid.uuid4().hex
        path = f"{self.root}/segments/{name}"
        if docs is not None:
            lexical.write_index(docs, self.key, self.fields, path, self.filters)
        else:
            rows.write.parquet(f"{path}/documents")
            lexical.write_rows(self.spark, self.key, path, self.filters)
        totals = self.spark.read.parquet(f"{path}/fields").where(F.col("field") == self.fields[0])
        return name, totals.agg(F.sum("documents")).first()[0] or 0

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """One version on: without the documents in `removed` (by key), with those in `added`, which replace what has their key.

        Keys of `added` must not repeat. Written are the new documents' segment and the rows of the deleted ones.
        """
        state = self.state()
        version = state["version"] + 1
        keys = [d.select(self.key) for d in (added, removed) if d is not None]
        if state["segments"] and keys:
            gone = self._live(state, "documents").join(_union(keys).distinct(), self.key, "left_semi")
            path = f"{self.root}/deletes/{version}-{uuid.uuid4().hex}"
            gone.write.partitionBy("segment").parquet(path)
            rows = self.spark.read.option("basePath", path).schema(gone.schema).parquet(path)
            counts = rows.where(F.col("term").isNull() & (F.col("field") == self.fields[0])).groupBy("segment").count().collect()  # a row a segment
            for r in counts:
                state["segments"][r["segment"]] -= r["count"]
            if counts:
                state["deletes"].append(path.rsplit("/", 1)[1])
        if added is not None:
            name, n = self._written(None, added)
            state["segments"][name] = n
        self._publish(state | {"version": version})
        while len(state["segments"]) > self.most:
            state = self.merge(sorted(state["segments"], key=lambda s: (state["segments"][s], s))[:2])

    def merge(self, names: list[str]) -> dict:
        """One segment of the live documents of several, without reading their texts; the others stay as they are."""
        state = self.state()
        part = state | {"segments": {n: state["segments"][n] for n in names}}
        name, n = self._written(self._live(part, "documents").drop("segment"))
        kept = {s: c for s, c in state["segments"].items() if s not in names}
        state = state | {"version": state["version"] + 1, "segments": kept | ({name: n} if n else {})}
        self._publish(state)
        return state

    def view(self, where: Column | None = None) -> lexical.Index:
        """What searches read: live documents, and only those that `where` (over the filter columns) lets through.

        The condition stands in the scans of postings and totals; statistics are of what is left by it.
        """
        state = self.state()
        totals, gone = self._read(state, "fields"), self._deleted(state)
        if where is not None:
            totals = totals.where(where)
        if gone is not None:
            gone = gone if where is None else gone.where(where)
            less = lexical.field_totals(gone)
            totals = totals.select("field", "documents", "tokens").unionByName(less.select("field", (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens")))
        return lexical.Index(self._live(state, "postings", where).drop("segment"), lexical.mean_lengths(totals), self.terms() if where is None else None)

    def terms(self) -> DataFrame:
        """(field, term, df, occurrences) of live documents, in order of terms: the segments' sorted dictionaries merged by ranges of terms.

        Each range is merged by one task; terms whose documents are all deleted are left out. Only dictionaries and the deleted documents' rows are read.
        """
        state = self.state()
        rows, gone = self._read(state, "terms").drop("segment"), self._deleted(state)
        if gone is not None:
            less = gone.where(F.col("term").isNotNull()).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
            rows = rows.unionByName(less.select("field", "term", (-F.col("df")).alias("df"), (-F.col("occurrences")).alias("occurrences")))
        merged = rows.repartitionByRange("term", "field").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))
        return merged.where(F.col("df") > 0).sortWithinPartitions("term", "field")

    def vacuum(self) -> None:
        """Deletes segments that the current version doesn't name: no reader may be on an older one."""
        state = self.state()
        for name in listed_folders(self.spark, f"{self.root}/segments"):
            if name not in state["segments"]:
                delete_path(self.spark, f"{self.root}/segments/{name}")
