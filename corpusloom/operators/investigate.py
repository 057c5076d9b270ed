"""Bounded investigation: contracts of facets and relationships, audits, answers, planning, rounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RoundBudget:
    rounds: int = 4
    queries: int = 8
    evidence: int = 64

    def __post_init__(self) -> None:
        if not (1 <= self.rounds <= 16 and 1 <= self.queries <= 64 and 1 <= self.evidence <= 1024):
            raise ValueError("a budget is out of bounds")


def check_contract(facets: DataFrame, relationships: DataFrame) -> None:
    n, m = facets.count(), relationships.count()
    if not 1 <= n <= 64 or m > 128:
        raise ValueError("a contract has 1 to 64 facets and at most 128 relationships")
    ends = relationships.select(F.explode(F.array("from_facet", "to_facet")).alias("facet_id"))
    if ends.join(facets, "facet_id", "left_anti").limit(1).count():
        raise ValueError("a relationship's end is no facet")


def extended(facets: DataFrame, additions: DataFrame) -> DataFrame:
    """facet_id, change: new, kept or conflict (equal id, other requirement)."""
    fields = ["repository", "stage", "era"]
    new = additions.select("facet_id", *[F.col(f).alias(f"_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    change = F.when(F.col("repository").isNull(), "new").when(F.col("_repository").isNull() | same, "kept").otherwise("conflict")
    return facets.join(new, "facet_id", "full_outer").select("facet_id", change.alias("change"))


def classified(evidence: DataFrame, facets: DataFrame) -> DataFrame:
    """Each evidence against its facet: adjacent, else the first of repository, stage and era that is wrong, else qualifying."""
    wanted = facets.select("facet_id", F.col("repository").alias("_r"), F.col("stage").alias("_s"), F.col("era").alias("_e"))
    verdict = (
        F.when(F.col("_r").isNull(), "unknown_facet").when(F.col("adjacent"), "adjacent").when(F.col("repository") != F.col("_r"), "wrong_repository")
        .when(F.col("stage") != F.col("_s"), "wrong_stage").when(F.col("_e").isNotNull() & (F.col("revision") != F.col("_e")), "wrong_era").otherwise("qualifying")
    )
    return evidence.join(wanted, "facet_id", "left").select("evidence_id", "facet_id", verdict.alias("verdict"))


def missing_facets(evidence: DataFrame, facets: DataFrame) -> DataFrame:
    good = classified(evidence, facets).where("verdict = 'qualifying'")
    return facets.select("facet_id").join(good, "facet_id", "left_anti")


def missing_relationships(required: DataFrame, observed: DataFrame, evidence: DataFrame, facets: DataFrame) -> DataFrame:
    """Required (from_facet, to_facet, kind) without an observed relationship between qualifying evidence."""
    good = classified(evidence, facets).where("verdict = 'qualifying'")
    start = good.select(F.col("evidence_id").alias("from_evidence"), F.col("facet_id").alias("from_facet"))
    end = good.select(F.col("evidence_id").alias("to_evidence"), F.col("facet_id").alias("to_facet"))
    met = observed.join(start, "from_evidence").join(end, "to_evidence").select("from_facet", "to_facet", "kind")
    return required.join(met, ["from_facet", "to_facet", "kind"], "left_anti")


def uncited(facets: DataFrame, evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """Facets without a cited qualifying evidence: an answer is valid if there are none."""
    cited = classified(evidence, facets).where("verdict = 'qualifying'").join(citations.select("evidence_id"), "evidence_id", "left_semi")
    return facets.select("facet_id").join(cited, "facet_id", "left_anti")


#: Bytes of one query, additions and queries of one proposal.
QUERY_BYTES, ADDITIONS, PROPOSED = 256, 8, 8


def planned(facets: DataFrame, missing: DataFrame, most: int = 8, asked: DataFrame | None = None) -> DataFrame:
    """One query for each of at most `most` missing facets: those that were asked for the fewest times (asked: facet_id, times), then by id.

    A query over QUERY_BYTES is an error: it is refused, not cut.
    """
    query = F.concat_ws(" ", "repository", "stage", "era", "question")
    rows = facets.join(missing, "facet_id", "left_semi")
    times = F.lit(0)
    if asked is not None:
        rows, times = rows.join(asked, "facet_id", "left"), F.coalesce("times", F.lit(0))
    held = F.when(F.octet_length(query) <= QUERY_BYTES, query).otherwise(F.raise_error(F.concat(F.lit("the query of a facet is too long: "), F.col("facet_id").cast("string"))))
    return rows.select("facet_id", held.alias("query"), times.alias("_times")).orderBy("_times", "facet_id").limit(most).drop("_times")


def proposal_problems(facets: DataFrame, additions: DataFrame, relationships: DataFrame, queries: DataFrame) -> DataFrame:
    """(problem, n) that a proposal is refused for; none if it can be applied.

    additions are facets, relationships (from_facet, to_facet, kind), queries (facet_id, query). limit: over ADDITIONS or PROPOSED;
    conflict: a known facet with another requirement; unknown_facet: a query's, or an end's, that is neither known nor added;
    query: blank, over QUERY_BYTES, with control characters, or repeated.
    """
    known = facets.select("facet_id").unionByName(additions.select("facet_id")).distinct()
    ends = relationships.select(F.explode(F.array("from_facet", "to_facet")).alias("facet_id")).unionByName(queries.select("facet_id"))
    text = F.col("query")
    bad = text.isNull() | (F.trim(text) == "") | (F.octet_length(text) > QUERY_BYTES) | text.rlike(r"\p{Cc}")
    over = [d.agg(F.count("*").alias("n")).where(F.col("n") > most) for d, most in ((additions, ADDITIONS), (relationships, ADDITIONS), (queries, PROPOSED))]
    twice = queries.groupBy("facet_id", "query").count().where("count > 1").select("query")
    found = [
        ("limit", over[0].unionByName(over[1]).unionByName(over[2])), ("conflict", extended(facets, additions).where("change = 'conflict'")),
        ("unknown_facet", ends.join(known, "facet_id", "left_anti")), ("query", queries.where(bad).select("query").unionByName(twice)),
    ]
    out = None
    for name, rows in found:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def sound_provenance(evidence: DataFrame) -> DataFrame:
    """At least one signal, ranks over zero, and as many hops as the path is long."""
    signal = F.col("lexical_rank").isNotNull() | F.col("semantic_rank").isNotNull() | (F.size("graph_path") > 0)
    ranks = (F.coalesce("lexical_rank", F.lit(1)) > 0) & (F.coalesce("semantic_rank", F.lit(1)) > 0)
    return evidence.where(signal & ranks & (F.col("hops") == F.size("graph_path")))


def investigate(facets: DataFrame, acquire: Callable[[DataFrame], DataFrame], budget: RoundBudget | None = None) -> tuple[str, DataFrame]:
    """Rounds of planning and acquiring until no facet is missing ("answered") or the budget ends ("insufficient").

    Facets that had their turn without success wait for the others. An evidence that comes again must say the same, and
    more evidence than the budget has room for is an error: neither is settled by dropping rows. Evidence with provenance
    columns (graph_path) must be sound.
    """
    bounds = budget or RoundBudget()
    held: DataFrame | None = None
    asked = facets.select("facet_id", F.lit(0).alias("times")).checkpoint()
    for _ in range(bounds.rounds):
        missing = missing_facets(held, facets) if held is not None else facets.select("facet_id")
        if not missing.limit(1).count():
            return "answered", held
        plan = planned(facets, missing, bounds.queries, asked).checkpoint()
        asked = asked.join(plan.select("facet_id", F.lit(1).alias("_more")), "facet_id", "left").select("facet_id", (F.col("times") + F.coalesce("_more", F.lit(0))).alias("times")).checkpoint()
        found = acquire(plan)
        held = (found if held is None else held.unionByName(found)).distinct().checkpoint()
        if held.groupBy("evidence_id").count().where("count > 1").limit(1).count():
            raise ValueError("an evidence contradicts an earlier one with its id")
        if "graph_path" in held.columns and held.join(sound_provenance(held), "evidence_id", "left_anti").limit(1).count():
            raise ValueError("an evidence has no sound provenance")
        if held.limit(bounds.evidence + 1).count() > bounds.evidence:
            raise ValueError(f"over {bounds.evidence} pieces of evidence")
    return ("insufficient" if missing_facets(held, facets).limit(1).count() else "answered"), held
