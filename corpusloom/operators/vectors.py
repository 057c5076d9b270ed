"""Vector retrieval: validation, exact top-k, reuse, reconciliation, pooling, window scores, length plans."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    # the norm is bound to a name first: inside the inner function it would be computed for each component
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def verdict(v: Column, dimension: int, unit: bool = True) -> Column:
    """null for a sound vector, else dimension, not_finite, zero or not_unit (by more than 0.01)."""
    length = norm(v)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    out = F.when(v.isNull() | (F.size(v) != dimension), "dimension").when(bad, "not_finite").when(length == 0, "zero")
    return out.when(F.abs(length - 1) > 0.01, "not_unit") if unit else out


def top_k(vectors: DataFrame, key: str, query: list[float], k: int) -> DataFrame:
    """One query: dot products in the scan, then a bounded heap in each task."""
    target = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(dot(F.col("embedding"), target), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


#: Vectors that meet a block of queries at a time: the score matrix has at most this many times `block` numbers.
BLOCK_ROWS = 4096


def top_k_batch(vectors: DataFrame, key: str, queries: DataFrame, k: int, block: int = 2048, most: int = 20_000) -> DataFrame:
    """Many queries (query_id, embedding): each task multiplies its rows by the query matrix and keeps k a query before anything is shuffled.

    The matrix is sent to every task, so its rows are counted first; beyond `most` they go in several rounds.
    """
    rows = queries.select("query_id", "embedding").limit(most + 1).collect()
    if len(rows) > most:
        part = F.pmod(F.xxhash64("query_id"), F.lit(math.ceil(queries.count() / (most / 2))))
        parts = [r[0] for r in queries.select(part.alias("p")).distinct().collect()]
        out = None
        for p in sorted(parts):
            one = top_k_batch(vectors, key, queries.where(part == p), k, block, most)
            out = one if out is None else out.unionByName(one)
        return out
    names = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1).T
    kind = queries.schema["query_id"].dataType.simpleString()
    sent = vectors.sparkSession.sparkContext.broadcast((names, matrix))
    own = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        held: tuple | None = None  # query columns, keys, scores: at most k of each column
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)
            parts = [] if held is None else [held]
            for lo in range(0, len(whole), BLOCK_ROWS):  # a block of rows by a block of queries at a time
                keys, rows = whole[lo : lo + BLOCK_ROWS], flat[lo : lo + BLOCK_ROWS]
                for first in range(0, q.shape[1], block):
                    scores = np.round(rows @ q[:, first : first + block], 6)
                    if len(keys) > k:  # whatever ties with the k-th best stays for the order by key
                        at, column = np.nonzero(scores >= np.partition(scores, len(keys) - k, axis=0)[len(keys) - k])
                    else:
                        at, column = (x.ravel() for x in np.indices(scores.shape))
                    parts.append((column + first, keys[at], scores[at, column]))
            column, keys, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((keys, -scores, column))
            column, keys, scores = column[order], keys[order], scores[order]
            starts = np.searchsorted(column, np.arange(q.shape[1]))
            best = np.arange(len(column)) - starts[column] < k
            held = column[best], keys[best], scores[best]
        if held is not None and len(ids):
            names = [ids[c] for c in held[0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(held[1]), pa.array(held[2])], names=["query_id", key, "similarity"])

    best = vectors.select(key, "embedding").mapInArrow(run, f"query_id {kind}, {key} {own}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reuse_plan(wanted: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """key, action: reuse where the previous table has the key with the same model, else embed."""
    had = previous.select(key, F.col("model").alias("_model"))
    return wanted.join(had, key, "left").select(key, F.when(F.col("_model") == F.col("model"), "reuse").otherwise("embed").alias("action"))


def reconciled(wanted: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Vectors for wanted (key, content_key): by the same key, else by the smallest previous key with the same content key; null: to be embedded."""
    same = previous.select(key, F.col("embedding").alias("_own"))
    alias = previous.groupBy("content_key").agg(F.min_by("embedding", key).alias("_alias"))
    return wanted.join(same, key, "left").join(alias, "content_key", "left").select(key, "content_key", F.coalesce("_own", "_alias").alias("embedding"))


def inconsistencies(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """key, problem: missing vectors and unknown chunks; empty means consistent."""
    missing = chunks.select(key).join(vectors.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.unionByName(vectors.select(key).join(chunks.select(key), key, "left_anti").select(key, F.lit("unknown").alias("problem")))


def pooled(windows: DataFrame, owner: str, weight: Column | None = None) -> DataFrame:
    """Mean (or weighted mean) of each owner's window vectors, normalised; summed by position with a map-side combine."""
    w = weight if weight is not None else F.lit(1.0)
    rows = windows.select(owner, w.alias("_w"), F.posexplode("embedding").alias("_i", "_x"))
    sums = rows.groupBy(owner, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"])
    return sums.groupBy(owner).agg(vector.alias("mean")).select(owner, normalised(F.col("mean")).alias("embedding"))


def best_window(windows: DataFrame, owner: str, query: list[float], k: int = 50) -> DataFrame:
    target = F.array(*[F.lit(float(x)) for x in query])
    return (
        windows.groupBy(owner).agg(F.max(F.round(dot(F.col("embedding"), target), 6)).alias("score")).orderBy(F.desc("score"), owner).limit(k)
    )


def fake_embedding(values: list[str], dimension: int) -> list[list[float]]:
    """The deterministic stand-in for a model: byte i adds b / 255 to component i mod dimension, then unit length."""
    out = []
    for v in values:
        if not v.strip():
            raise ValueError("blank text")
        data = np.frombuffer(v.encode(), np.uint8) / 255
        made = np.bincount(np.arange(len(data)) % dimension, data, dimension)
        out.append((made / np.linalg.norm(made)).tolist())
    return out


def embedded(df: DataFrame, column: str, provider: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """df with `embedding` by any provider of batches; models load once a task inside it."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(provider(texts.tolist()))

    return df.withColumn("embedding", run(F.col(column)))


@dataclass(frozen=True)
class Profile:
    """What a model asks of its inputs and gives: the same for passages when they are embedded and for queries later."""

    pooling: str
    dimension: int
    max_length: int
    query_prefix: str = ""
    passage_prefix: str = ""
    normalised: bool = True

    def __post_init__(self) -> None:
        if self.pooling not in ("cls", "mean") or min(self.dimension, self.max_length) < 1:
            raise ValueError("a profile pools by cls or mean and has positive sizes")


def profile_of(model: str, profiles: dict[str, Profile]) -> Profile:
    """The profile of the longest name that the model's id contains, in whatever case."""
    found = [n for n in profiles if n.lower() in model.lower()]
    if not found:
        raise ValueError(f"no profile for {model}")
    return profiles[max(found, key=lambda n: (len(n), n))]


def embedded_by(df: DataFrame, column: str, provider: Callable[[list[str]], list[list[float]]], profile: Profile, query: bool = False) -> DataFrame:
    """embedded() with the profile's prefix before each text and its normalisation after; a vector of another size is an error."""
    prefix = profile.query_prefix if query else profile.passage_prefix
    rows = embedded(df.withColumn("_input", F.concat(F.lit(prefix), F.col(column))), "_input", provider).drop("_input")
    v = F.col("embedding")
    wrong = F.concat(F.lit(f"a vector of this profile has {profile.dimension} components, not "), F.size(v).cast("string"))
    v = F.when(F.size(v) == profile.dimension, v).otherwise(F.raise_error(wrong).cast("array<double>"))
    return rows.withColumn("embedding", normalised(v) if profile.normalised else v)


def length_order(df: DataFrame, length: str, ties: list[str]) -> DataFrame:
    """Rows of like length next to each other, to keep batches free of padding."""
    return df.repartitionByRange(F.col(length)).sortWithinPartitions(length, *ties)


def sequence_census(windows: DataFrame, buckets: list[int], budget: int) -> DataFrame:
    """For each bucket length (a row goes to the smallest that holds it, the last takes the rest): windows, batches, real and padded tokens, padding in parts a million."""
    bucket = F.lit(buckets[-1])
    for b in reversed(buckets):
        bucket = F.when(F.col("tokens") <= b, F.lit(b)).otherwise(bucket)
    if any(budget // b == 0 for b in buckets):
        raise ValueError("a bucket is longer than the budget")
    n, real = F.count("*"), F.sum(F.least("tokens", "bucket"))
    rows = windows.withColumn("bucket", bucket).groupBy("bucket").agg(n.alias("windows"), real.cast("bigint").alias("real_tokens"))
    size = F.floor(F.lit(budget) / F.col("bucket"))
    padded = F.col("windows") * F.col("bucket")
    return rows.select(
        "bucket", "windows", F.ceil(F.col("windows") / size).cast("bigint").alias("batches"), "real_tokens", padded.cast("bigint").alias("padded_tokens"),
        F.floor((padded - F.col("real_tokens")) * 1_000_000 / padded).cast("bigint").alias("padding_ppm"),
    )
