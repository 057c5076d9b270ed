"""The search service: validation, modes, the lexical and hybrid plans, response bounds, feedback."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.operators import fusion, lexical, vectors
from corpusloom.plans.segments import SegmentedIndex
from corpusloom.plans.store import written

QUERY_BYTES, RESPONSE_BYTES, PASSAGE_BYTES, MOST, DEFAULT = 4096, 65_536, 8192, 50, 10
MODES, DETAILS = ("lexical", "semantic", "hybrid", "auto"), ("compact", "full")
KINDS = {"trust_tier": ("official", "maintainer", "community", "unverified"), "source_kind": ("catalog", "repository", "commit", "feedback")}


@dataclass
class Request:
    query: str
    limit: int = DEFAULT
    mode: str = "auto"
    detail: str = "compact"
    max_response_bytes: int | None = None
    max_context_bytes: int | None = None
    filters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.query.strip() or len(self.query.encode()) > QUERY_BYTES:
            raise ValueError(f"a query has 1 to {QUERY_BYTES} bytes")
        self.limit = self.limit or DEFAULT
        if not 1 <= self.limit <= MOST:
            raise ValueError(f"the limit is at most {MOST}")
        if self.mode not in MODES or self.detail not in DETAILS:
            raise ValueError("unknown mode or detail")
        if self.max_response_bytes is not None and not 1 <= self.max_response_bytes <= RESPONSE_BYTES:
            raise ValueError(f"a response has 1 to {RESPONSE_BYTES} bytes")
        if self.max_context_bytes is not None and self.max_context_bytes < 1:
            raise ValueError("a context has a byte at least")
        for name, allowed in KINDS.items():
            if (value := self.filters.get(name)) is not None and value not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")


def capabilities() -> dict:
    return {
        "modes": list(MODES), "details": list(DETAILS), "max_limit": MOST, "default_limit": DEFAULT, "query_bytes": QUERY_BYTES,
        "response_bytes": RESPONSE_BYTES, "passage_bytes": PASSAGE_BYTES,
    }


def search(
    chunks: DataFrame, request: Request, semantic: DataFrame | None = None, neighbours: int = 3, index: str | SegmentedIndex | None = None
) -> tuple[DataFrame, list[str]]:
    """Ranked passages of chunks (chunk_id, document_id, ordinal, text, content_digest, path, revision, repository, …) and warnings.

    semantic: hits (chunk_id, rank). Filters come before lexical ranking and after semantic retrieval.
    index: path of lexical.write_index over the chunks (chunk_id, text): then only its postings are read, and scores take
    their statistics from all of it; without filters both ways give the same rows. A SegmentedIndex whose filter columns are those
    that are filtered by (all but paths and tags) takes them into its scans, and gives the same rows with filters too.
    Passages are fetched for the winners only. chunks are read several times: a caller who cuts them writes them first.
    """
    warnings: list[str] = []
    if request.mode in ("semantic", "hybrid") and semantic is None:
        raise ValueError("semantic retrieval is not available")
    if request.mode == "auto" and semantic is None:
        warnings.append("semantic_unavailable: answered lexically")
    pool = lexical.filtered(chunks, **{k: v for k, v in request.filters.items() if v})
    k = min(max(5 * request.limit, 20), 100)
    if index is not None:
        asked = {k: v for k, v in request.filters.items() if v}
        terms = lexical.query_terms(request.query)
        if isinstance(index, str):
            scored = lexical.scored_index(lexical.open_index(chunks.sparkSession, index), "chunk_id", "text", terms)
            pushed = set()
        else:
            pushed, where = {k for k in asked if k in index.filters}, None
            for name in sorted(pushed):
                where = F.col(name) == asked[name] if where is None else where & (F.col(name) == asked[name])
            scored = lexical.scored_index(index.view(where), "chunk_id", "text", terms)
        if set(asked) - pushed:
            scored = scored.join(pool.select("chunk_id"), "chunk_id", "left_semi")
        found = lexical.passes(scored, "chunk_id", request.query, k)
    else:
        # the passes read the scores, not the texts again
        scored = lexical.scored(pool.select("chunk_id", "text"), "chunk_id", "text", lexical.query_terms(request.query))
        found = lexical.passes(written(scored.where("coverage > 0").select("chunk_id", "coverage", "score")), "chunk_id", request.query, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("score"), "chunk_id")
    ranked = found.select(F.lit(0).alias("query_id"), "chunk_id", "coverage", "score")
    left = ranked.select("query_id", "chunk_id", F.row_number().over(order).alias("rank"))
    if request.mode == "semantic":
        left = left.limit(0)
    none = left.limit(0)
    hits = none if semantic is None or request.mode == "lexical" else semantic.join(pool.select("chunk_id"), "chunk_id", "left_semi").select(F.lit(0).alias("query_id"), "chunk_id", "rank")
    fused = fusion.reciprocal_rank(left, hits, "chunk_id")
    meta = pool.select("chunk_id", "document_id", "content_digest")
    # the passes give at most 300 candidates, semantic retrieval a page: small sides are sent to the tables
    placed = meta.join(F.broadcast(fused), "chunk_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*fusion.fused_order("chunk_id"))))
    kept = fusion.capped(placed, "query_id", "rank", "document_id", "content_digest", 2, request.limit)
    winners = kept.join(placed.select("rank", "chunk_id", "score"), "rank")
    rows = chunks.select("chunk_id", "ordinal", "path", "revision", "repository").join(F.broadcast(winners), "chunk_id")
    budget = min(request.max_context_bytes or PASSAGE_BYTES, PASSAGE_BYTES)
    anchors = rows.select(F.col("chunk_id").alias("anchor_id"), "document_id", "ordinal")
    passages = fusion.with_context(F.broadcast(anchors), chunks, budget, neighbours)
    out = rows.join(passages, rows["chunk_id"] == passages["anchor_id"]).select(
        "rank", "chunk_id", "document_id", "repository", "revision", "path", F.round("score", 9).alias("score"), "passage", "neighbor_count"
    )
    if request.filters.get("revision") is None:
        keyed = out.withColumn("_p", T.normalised_space(F.col("passage")))
        groups = fusion.collapsed(keyed, ["repository", "path", "_p"], "rank", "revision").select("rank", "occurrences", "revisions")
        out = out.join(groups, "rank")
    else:
        out = out.withColumn("occurrences", F.lit(1).cast("bigint")).withColumn("revisions", F.array("revision"))
    return out.orderBy("rank").limit(request.limit), warnings


def bounded(rows: list[dict], request: Request, warnings: list[str]) -> dict:
    """A response within its bytes: passages cut, lowest rows dropped, detail reduced, at last no rows at all; every step is named."""
    if request.max_context_bytes and request.max_context_bytes > PASSAGE_BYTES:
        warnings = [*warnings, f"context_bytes_clamped: max_context_bytes was clamped to {PASSAGE_BYTES} bytes"]
    limit = min(request.max_response_bytes or RESPONSE_BYTES, RESPONSE_BYTES)
    passage = min(request.max_context_bytes or PASSAGE_BYTES, PASSAGE_BYTES)
    held = [dict(r, passage=cut_utf8(r.get("passage", ""), passage)) for r in rows[: request.limit]]
    codes = [w.split(":")[0].strip() for w in warnings]
    detail = request.detail

    def over() -> bool:
        return len(json.dumps({"results": held, "warnings": warnings, "codes": codes, "detail": detail}, ensure_ascii=False, default=str).encode()) > limit

    def shorten() -> None:
        n = len(held)
        while over() and len(held) > 1:
            held.pop()
        if len(held) < n:
            codes.append("results_dropped")

    shorten()
    if over() and detail == "full":
        held = [{k: cut_utf8(v, 256) if isinstance(v, str) else v for k, v in r.items() if k in ("rank", "chunk_id", "path", "score", "passage")} for r in held]
        detail = "compact"
        codes += ["detail_degraded", "provenance_removed"]
        shorten()
    if over():
        held = []
        codes.append("results_dropped")
    if over():
        codes.append("response_budget_exceeded")
    return {"results": held, "warnings": warnings, "codes": codes, "detail": detail}


def cut_utf8(value: str, limit: int) -> str:
    return value.encode()[:limit].decode(errors="ignore")


def compact(rows: list[dict]) -> dict:
    """Sources once, in first-seen order; rows carry their number."""
    sources: dict[tuple, int] = {}
    out = [dict(r, source_index=sources.setdefault((r["repository"], r["path"]), len(sources))) for r in rows]
    return {"sources": [{"repository": a, "path": b} for a, b in sources], "results": [{k: v for k, v in r.items() if k not in ("repository", "path")} for r in out]}


def semantic_hits(vector_table: DataFrame, key: str, query: list[float], limit: int) -> DataFrame:
    hits = vectors.top_k(vector_table, key, query, min(max(5 * limit, 20), 100))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), key)))


# --- feedback ---------------------------------------------------------------


def active(records: DataFrame) -> DataFrame:
    """Records that nothing supersedes and that are not covered."""
    gone = records.where("supersedes is not null").select(F.col("supersedes").alias("record_id"))
    return records.where(~F.coalesce(F.col("covered"), F.lit(False))).join(gone, "record_id", "left_anti")


def inserted(records: DataFrame, new: DataFrame, capacity: int = 1000) -> DataFrame:
    """records with the new ones: known ids change nothing; a superseded record must be there and current."""
    fresh = new.join(records.select("record_id"), "record_id", "left_anti")
    targets = fresh.where("supersedes is not null").select(F.col("supersedes").alias("record_id"))
    if targets.join(active(records), "record_id", "left_anti").limit(1).count():
        raise ValueError("a superseded record is unknown or not current")
    out = records.unionByName(fresh)
    if out.count() > capacity:
        raise ValueError(f"more than {capacity} records")
    return out


def covered(records: DataFrame, record_id: str) -> DataFrame:
    return records.withColumn("covered", F.coalesce(F.col("covered"), F.lit(False)) | (F.col("record_id") == record_id))


def current(corrections: DataFrame, resources: DataFrame) -> DataFrame:
    """record_id, current: whether all evidence (uri, digest) still equals the resources' digests."""
    rows = corrections.select("record_id", F.explode("evidence").alias("e")).select("record_id", "e.uri", "e.digest")
    now = resources.select("uri", F.col("digest").alias("_now"))
    return rows.join(now, "uri", "left").groupBy("record_id").agg(F.bool_and(F.coalesce(F.col("digest") == F.col("_now"), F.lit(False))).alias("current"))


def overlay(records: DataFrame, query: str, limit: int, resources: DataFrame, least: float = 0.5) -> DataFrame:
    """The best active records for a query: record_id, kind, score, rank.

    records: record_id, kind, text, supersedes, covered, evidence (array of uri, digest). Statistics are those of the active
    records alone. A record of kind `correction` needs a score of `least` and evidence that resources (uri, digest) still bear out;
    evidence is compared for the candidates only, of which there are 200 at most.
    """
    pool = active(records)
    found = lexical.candidates(pool.select("record_id", "text"), "record_id", "text", query, limit)
    held = pool.select("record_id", "kind", "evidence").join(F.broadcast(found), "record_id")
    sound = current(held.where((F.col("kind") == "correction") & (F.col("score") >= least)), resources).where("current").select("record_id", F.lit(True).alias("_sound"))
    rows = held.drop("evidence").join(F.broadcast(sound), "record_id", "left").where((F.col("kind") != "correction") | F.col("_sound"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("coverage"), F.desc("score"), "record_id")  # a result page
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("record_id", "kind", "score", "rank")


def merged(results: DataFrame, notes: DataFrame, limit: int) -> DataFrame:
    """Results cut to what the notes (at most `limit`) leave of the limit, the notes after them."""
    kept = notes.orderBy("rank").limit(limit)
    n = kept.count()
    base = results.where(F.col("rank") <= limit - n)
    return base.unionByName(kept.withColumn("rank", F.col("rank") + F.lit(limit - n)))


def annotated(results: DataFrame, corrections: DataFrame, ids: list[str]) -> DataFrame:
    """Each result with the corrections whose affected list names any of its ids."""
    own = results.select("rank", F.explode(F.array(*ids)).alias("id")).distinct()
    hits = own.join(corrections.select("record_id", F.explode("affected").alias("id")), "id")
    found = hits.groupBy("rank").agg(F.array_sort(F.collect_set("record_id")).alias("corrections"))
    return results.join(found, "rank", "left").withColumn("corrections", F.coalesce("corrections", F.array().cast("array<string>")))


def replayed(decisive: DataFrame, results: DataFrame, ids: list[str]) -> DataFrame:
    """decisive (id) with matched: whether any id column of the results has it."""
    seen = results.select(F.explode(F.array(*ids)).alias("id")).distinct().withColumn("_s", F.lit(True))
    return decisive.join(seen, "id", "left").select("id", F.col("_s").isNotNull().alias("matched"))
