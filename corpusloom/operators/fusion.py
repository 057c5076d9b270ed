"""Fusion of ranked lists, diversity, context and collapse of repeated history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
#: With the lexical floor, so many of the first lexical ranks go before all fused scores.
FLOOR = 2


def reciprocal_rank(lexical: DataFrame, semantic: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Full outer join of (query_id, key, rank): 1 / (k + rank) summed over the lists that have the row."""
    left = lexical.withColumnRenamed("rank", "lexical_rank")
    right = semantic.withColumnRenamed("rank", "semantic_rank")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return left.join(right, ["query_id", key], "full_outer").withColumn("score", part("lexical_rank") + part("semantic_rank"))


def fused_order(key: str, exact: Column | None = None, registered: Column | None = None, floor: bool = False) -> list[Column]:
    """Sort keys: exact first (among them the lexical rank), registered, the floor if asked for, score, key."""
    out: list[Column] = []
    if exact is not None:
        out += [F.desc(F.coalesce(exact, F.lit(False))), F.asc(F.when(exact, F.col("lexical_rank")))]
    if registered is not None:
        out.append(F.asc(registered.isNull()))
    if floor:
        held = F.coalesce(F.col("lexical_rank") <= FLOOR, F.lit(False))
        out += [F.desc(held), F.asc(F.when(held, F.col("lexical_rank")))]
    return [*out, F.desc("score"), F.asc(key)]


def capped(ranked: DataFrame, query: str, rank: str, document: str, digest: str, cap: int, limit: int) -> DataFrame:
    """Greedy in rank order: a document's rows beyond the cap are passed over and leave no trace; then repeated contents, which take nothing from the cap.

    Two independent row numbers give other rows. Candidate lists are bounded by the over-fetch, so an ordered fold holds them.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(document).alias("d"), F.col(digest).alias("g"))))
    kinds = {c: t for c, t in ranked.dtypes}
    empty = F.array().cast(f"array<struct<r:{kinds[rank]},d:{kinds[document]},g:{kinds[digest]}>>")

    def step(out: Column, row: Column) -> Column:
        full = F.size(F.filter(out, lambda o: o["d"] == row["d"])) >= cap
        seen = F.exists(out, lambda o: o["g"] == row["g"])
        return F.when(full | seen | (F.size(out) >= max(1, limit)), out).otherwise(F.concat(out, F.array(row)))

    kept = ranked.groupBy(query).agg(F.explode(F.aggregate(rows, empty, step)).alias("x"))
    return kept.select(query, F.col("x.r").alias(rank), F.col("x.d").alias(document), F.col("x.g").alias(digest))


def with_context(anchors: DataFrame, chunks: DataFrame, budget: int, reach: int = 3, joiner: str = "\n\n") -> DataFrame:
    """The anchor's text, then up to `reach` chunks before it in document order, then after it, while the whole fits into `budget` bytes; the first that doesn't ends it.

    One join on the document with an ordinal range; the byte count is a running sum, cut at its first overflow.
    """
    near = chunks.select("document_id", F.col("ordinal").alias("n_ordinal"), F.col("text").alias("n_text"))
    gap = F.col("n_ordinal") - F.col("ordinal")
    met = anchors.join(near, "document_id").where((gap >= -reach) & (gap <= reach))
    turn = F.when(gap == 0, 0).when(gap < 0, F.lit(reach + 1) + gap).otherwise(F.lit(reach) + gap)
    order = Window.partitionBy("anchor_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    sized = met.select("anchor_id", turn.alias("turn"), "n_text").withColumn(
        "used", F.sum(F.octet_length("n_text") + F.when(F.col("turn") == 0, 0).otherwise(len(joiner.encode()))).over(order)
    )
    fits = sized.where((F.col("used") <= budget) | (F.col("turn") == 0))
    parts = F.array_sort(F.collect_list(F.struct("turn", "n_text")))
    return fits.groupBy("anchor_id").agg(
        F.array_join(F.transform(parts, lambda p: p["n_text"]), joiner).alias("passage"), (F.count("*") - 1).alias("neighbor_count")
    )


def collapsed(ranked: DataFrame, key: list[str], rank: str, revision: str, preferred: str | None = None, most: int = 8) -> DataFrame:
    """One row for each key, the first in rank order (or the preferred revision's), with how often it occurs and at most `most` revisions in rank order."""
    each = ranked.groupBy(*key, F.col(revision).alias("_v")).agg(F.min(rank).alias("_r"), F.count("*").alias("_n"))  # a hot key shrinks to its revisions here
    other = (F.col("_v") != preferred) if preferred else F.lit(False)
    # places by the same key, so nothing is shuffled again; only the first `most` revisions are collected
    each = each.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy("_r", "_v")))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("_place") <= most, F.struct("_r", "_v")))), lambda s: s["_v"])
    return each.groupBy(*key).agg(
        F.min("_r").alias(rank), F.sum("_n").alias("occurrences"), ordered.alias("revisions"),
        F.min("_v").alias("first_revision"), F.max("_v").alias("last_revision"), F.min(F.struct(other.alias("p"), F.col("_r"), F.col("_v")))["_v"].alias("representative"),
    )


def facet_top_k(candidates: DataFrame, facets: DataFrame, quota: int) -> DataFrame:
    """Best `quota` candidates of each facet (repository, stage, era or null): by rerank score, retrieval score, id; non-finite scores are left out."""
    if not 1 <= quota <= 4:
        raise ValueError("the quota is 1 to 4")
    fits = (F.col("era").isNull()) | (F.col("era") == F.col("revision"))
    met = candidates.where(~F.isnan("score") & (F.abs("score") < float("inf"))).join(facets, ["repository", "stage"]).where(fits)
    order = Window.partitionBy("facet_id").orderBy(F.desc("score"), F.desc("retrieval_score"), "candidate_id")
    # equal ids in a row count once; the same id with another score between stays
    changed = met.withColumn("_before", F.lag("candidate_id").over(order)).where(F.col("_before").isNull() | (F.col("_before") != F.col("candidate_id")))
    return changed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota).drop("_before")
