"""Fetching by id: metadata and passages, embedding texts in a given order, content keys, inventories, filter rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.operators import lexical

METADATA = ["chunk_id", "document_id", "registered_id", "content_digest"]
#: Rows of a request that may be sent to all tasks; larger requests meet their table in a shuffle.
REQUEST_ROWS = 10_000


def _sent(wanted: DataFrame) -> DataFrame:
    return F.broadcast(wanted) if wanted.limit(REQUEST_ROWS + 1).count() <= REQUEST_ROWS else wanted


def metadata(chunks: DataFrame, wanted: DataFrame, **filters) -> DataFrame:
    """The narrow columns of the wanted chunk_ids that pass the filters; unknown ids are dropped."""
    return lexical.filtered(chunks, **filters).join(_sent(wanted.select("chunk_id").distinct()), "chunk_id", "left_semi").select(*METADATA)


def passages(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole chunks of the wanted ids; an id that the table lacks fails the query."""
    rows = _sent(wanted.select("chunk_id").distinct()).join(chunks.withColumn("_there", F.lit(True)), "chunk_id", "left")
    return rows.where(F.assert_true(F.col("_there").isNotNull(), F.lit("a chunk is missing")).isNull()).drop("_there")


def embedding_texts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(position, chunk_id, embedding_text) for wanted (position, chunk_id), in that order."""
    made = T.embedding_text(F.col("title"), F.col("heading_path"), F.col("identifiers"), F.col("tags"), F.col("text"))
    return passages(chunks, wanted).join(wanted, "chunk_id").select("position", "chunk_id", made.alias("embedding_text")).orderBy("position")


def document_chunks(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("ordinal")


def embedding_ids(chunks: DataFrame) -> DataFrame:
    return chunks.select("document_id", "chunk_id").orderBy("document_id", "chunk_id")


def chunks_of_keys(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The smallest chunk_id with each wanted content key."""
    return chunks.join(wanted.select("content_key").distinct(), "content_key", "left_semi").groupBy("content_key").agg(F.min("chunk_id").alias("chunk_id"))


def known_keys(wanted: DataFrame, chunks: DataFrame, removed: DataFrame | None = None, revision: str | None = None) -> DataFrame:
    """wanted (content_key) with known: whether a chunk that isn't removed (and has the revision) holds it."""
    rows = chunks if revision is None else chunks.where(F.col("revision") == revision)
    if removed is not None:
        rows = rows.join(removed.select("document_id"), "document_id", "left_anti")
    held = rows.select("content_key").distinct().withColumn("_k", F.lit(True))
    return wanted.join(held, "content_key", "left").select("content_key", F.col("_k").isNotNull().alias("known"))


def parsed_filters(raw: dict, categories: set[str]) -> dict:
    """Filters as ranking takes them: an unknown category is ignored, blank paths are dropped, tags are lower-cased and must not be blank."""
    out = {k: v for k, v in raw.items() if v not in (None, "", [])}
    if out.get("category") not in categories:
        out.pop("category", None)
    if "paths" in out:
        out["paths"] = [p for p in out["paths"] if p.strip()]
    if "tags" in out:
        if any(not t.strip() for t in out["tags"]):
            raise ValueError("a tag is blank")
        out["tags"] = sorted({t.strip().lower() for t in out["tags"]})
    return out


def filter_effects(filters: dict) -> list[str]:
    """`name=value` of each filter that applies."""
    order = ("category", "repository", "paths", "revision", "source_kind", "trust_tier", "tags")
    return [f"{k.removesuffix('s') if isinstance(filters[k], list) else k}={v}" for k in order if filters.get(k) for v in (filters[k] if isinstance(filters[k], list) else [filters[k]])]


def with_default_repository(filters: dict, selected: str | None) -> dict:
    """The session's repository where the request names none."""
    return filters if filters.get("repository") or not selected else filters | {"repository": selected}


def aliased(chunks: DataFrame, aliases: DataFrame, repository: str, reached: DataFrame, tip: str) -> DataFrame:
    """Chunks of a repository and of those with the same corpus contract; an aliased chunk must stem from an ancestor of the tip.

    aliases: repository, contract. reached: tip, commit.
    """
    same = aliases.join(aliases.where(F.col("repository") == repository).select("contract"), "contract", "left_semi").select("repository")
    own = chunks.where(F.col("repository") == repository)
    other = chunks.where(F.col("repository") != repository).join(same, "repository", "left_semi")
    old = reached.where(F.col("tip") == tip).select(F.col("commit").alias("revision"))
    return own.unionByName(other.join(old, "revision", "left_semi").select(*chunks.columns))


def reranked(candidates: DataFrame, scorer, limit: int, batch: int = 8) -> DataFrame:
    """candidates (query_id, query, chunk_id, text, rank) by a pair scorer: scorer(list of (query, text)) gives scores; batches keep memory bounded."""
    @F.pandas_udf("double")
    def score(query: pd.Series, body: pd.Series) -> pd.Series:
        pairs = list(zip(query, body, strict=True))
        return pd.Series([s for i in range(0, len(pairs), batch) for s in scorer(pairs[i : i + batch])])

    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", "chunk_id")
    rows = candidates.withColumn("rerank_score", score("query", "text")).where(~F.isnan("rerank_score"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
