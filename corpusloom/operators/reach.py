"""Reachability in revision histories by labels, without a row for each pair of a tip and a commit.

A history is cut into chains: of a commit's children by first parent one goes on with its chain, the others begin new ones.
A commit's label is (chain, place), and all edges that leave a chain are links (chain, place, to_chain, to_place):
one row a commit and at most one an edge. What a commit reaches is a largest place on each chain, as whatever is
below that place is reached along the chain; it is found by following links from what is new, a round for each change of
chains, not for each commit. Ancestor tests, merge bases and reuse proofs are joins on (chain, place).

Chains are found by pointer jumping, in a logarithmic number of joins. New commits go on with the chains that are there;
older labels and links never change.

Cases: repeated edges count once; a parent that has no row of its own in `commits` is a root; a first parent has place 0 in
`parents`, and a commit without one begins a chain. A history without commits gives empty tables.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.files import delete_path
from corpusloom.plans.store import scratch_dir, written


@dataclass(frozen=True)
class Labels:
    """labels (commit, chain, place) and links (chain, place, to_chain, to_place)."""

    labels: DataFrame
    links: DataFrame


def labelled(commits: DataFrame, parents: DataFrame, known: Labels | None = None) -> Labels:
    """Labels of commits (commit) and parents (commit, parent, place), added to what is known.

    With `known`, commits and parents are only the new ones; a new commit's parents are new or known.
    commits and parents are read several times: a caller who computes them writes them first.
    """
    edges = parents.select("commit", "parent", "place")
    new = commits.select("commit")
    if known is None:
        new = new.unionByName(edges.select(F.col("parent").alias("commit")))
    heirs = edges.where("place = 0").groupBy("parent").agg(F.min("commit").alias("commit"))
    # pointer: the commit before in the chain; steps: how far that is
    pointer, steps, head = F.col("parent"), F.when(F.col("parent").isNull(), 0).otherwise(1), F.when(F.col("parent").isNull(), F.col("commit"))
    if known is not None:
        at = known.labels.select(F.col("commit").alias("parent"), F.col("chain").alias("_chain"), F.col("place").alias("_place"))
        heirs = heirs.join(at, "parent", "left")
        inner = known.labels.select(F.col("chain").alias("_chain"), (F.col("place") - 1).alias("_place"))
        heirs = heirs.join(inner, ["_chain", "_place"], "left_anti")  # a commit inside a chain has its heir already
        pointer, steps, head = F.when(F.col("_chain").isNull(), pointer), steps + F.coalesce("_place", F.lit(0)), F.coalesce(head, "_chain")
    root = f"{scratch_dir(commits.sparkSession)}/corpusloom-chains/{uuid.uuid4().hex}"
    rows = written(new.distinct().join(heirs, "commit", "left").select("commit", pointer.alias("pointer"), steps.cast("bigint").alias("steps"), head.alias("head")), root)
    done, front = rows.where("pointer is null"), rows.where("pointer is not null")
    while front.limit(1).count():
        # only rows that have not come to their chain's head are moved on and written again
        to = done.unionByName(front).select(F.col("commit").alias("pointer"), F.col("pointer").alias("_pointer"), F.col("steps").alias("_steps"), F.col("head").alias("_head"))
        moved = front.join(to, "pointer", "left").select(
            "commit", F.col("_pointer").alias("pointer"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("head", "_head").alias("head")
        )
        moved = written(moved, root)
        done, front = done.unionByName(moved.where("pointer is null")), moved.where("pointer is not null")
    labels = written(done.select("commit", F.col("head").alias("chain"), F.col("steps").alias("place")))
    delete_path(commits.sparkSession, root)
    whole = labels if known is None else known.labels.unionByName(labels)
    low = whole.select(F.col("commit").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    links = edges.select("commit", "parent").join(labels, "commit").join(low, "parent").where((F.col("chain") != F.col("to_chain")) | (F.col("place") != F.col("to_place") + 1))
    links = written(links.select("chain", "place", "to_chain", "to_place").distinct())
    return Labels(whole, links if known is None else known.links.unionByName(links))


def reached(history: Labels, tips: DataFrame) -> DataFrame:
    """(tip, chain, place): the largest place on each chain that each of tips (commit) reaches, itself included; unknown tips reach nothing."""
    seen = written(tips.select("commit").distinct().join(history.labels, "commit").select(F.col("commit").alias("tip"), "chain", "place"))
    front = seen.withColumn("below", F.lit(-1).cast("bigint"))
    links = history.links.withColumnRenamed("place", "_at")
    while True:
        met = front.join(links, "chain").where((F.col("_at") <= F.col("place")) & (F.col("_at") > F.col("below")))
        step = met.groupBy("tip", F.col("to_chain").alias("chain")).agg(F.max("to_place").alias("_new"))
        below = F.coalesce("place", F.lit(-1).cast("bigint"))
        both = written(seen.join(step, ["tip", "chain"], "full").select("tip", "chain", F.greatest("place", "_new").alias("place"), below.alias("below"), (F.col("_new") > below).alias("_fresh")))
        seen, front = both.select("tip", "chain", "place"), both.where("_fresh").drop("_fresh")
        if not front.limit(1).count():
            return seen


def within(rows: DataFrame, commit: str, history: Labels, reach: DataFrame) -> DataFrame:
    """rows that some tip reaches: an ancestor filter for any table with a revision column."""
    most = reach.groupBy("chain").agg(F.max("place").alias("_most"))
    held = history.labels.join(most, "chain").where(F.col("place") <= F.col("_most")).select(F.col("commit").alias(commit))
    return rows.join(held, commit, "left_semi")


def ancestors(history: Labels, reach: DataFrame) -> DataFrame:
    """(tip, commit) of all that each tip reaches: as many rows as there are pairs."""
    most = reach.select("tip", "chain", F.col("place").alias("_most"))
    return history.labels.join(most, "chain").where(F.col("place") <= F.col("_most")).select("tip", "commit")


def merge_bases(history: Labels, pairs: DataFrame) -> DataFrame:
    """(current, previous, base) for pairs (current, previous): all common ancestors that no other common ancestor reaches.

    On each chain only the highest common place can be one, and it is none if a link leads to it from a common place of another chain.
    """
    pairs = written(pairs.select("current", "previous").distinct())
    tips = pairs.select(F.col("current").alias("commit")).unionByName(pairs.select(F.col("previous").alias("commit")))
    reach = reached(history, tips)
    left = reach.select(F.col("tip").alias("current"), "chain", F.col("place").alias("_left"))
    right = reach.select(F.col("tip").alias("previous"), "chain", F.col("place").alias("_right"))
    common = written(pairs.join(left, "current").join(right, ["previous", "chain"]).select("current", "previous", "chain", F.least("_left", "_right").alias("place")))
    links = history.links.withColumnRenamed("place", "_at")
    stale = common.join(links, "chain").where(F.col("_at") <= F.col("place")).select("current", "previous", F.col("to_chain").alias("chain"), F.col("to_place").alias("place"))
    top = common.join(stale.distinct(), ["current", "previous", "chain", "place"], "left_anti")
    return top.join(history.labels, ["chain", "place"]).select("current", "previous", F.col("commit").alias("base"))


def nearest_base(bases: DataFrame, order: list[Column]) -> DataFrame:
    """(current, base): of each current commit's bases with its previous ones the first in the order of its walk (say newest first)."""
    first = F.min(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], F.col("base"))).alias("x")
    return bases.groupBy("current").agg(first).select("current", F.col("x.base").alias("base"))


def reuse_proofs(entries: DataFrame, indexed: DataFrame, history: Labels) -> DataFrame:
    """entries (commit, path, blob) with proof: whether their path and blob were indexed for reuse at a commit that theirs reaches.

    indexed (path, blob, revision, reusable). Of a blob's proofs the lowest place on each chain is enough, so many proofs of one blob are few rows.
    """
    at = history.labels.select(F.col("commit").alias("revision"), "chain", "place")
    proofs = indexed.where("reusable").join(at, "revision").groupBy("path", "blob", "chain").agg(F.min("place").alias("_proof"))
    reach = reached(history, entries.select("commit")).select(F.col("tip").alias("commit"), "chain", "place")
    keys = entries.select("commit", "path", "blob").distinct()
    # an entry meets its own commit's chains first: one blob may be proved on any number of chains
    met = keys.join(reach, "commit").join(proofs, ["path", "blob", "chain"]).where(F.col("_proof") <= F.col("place"))
    held = met.select("commit", "path", "blob").distinct().withColumn("_held", F.lit(True))
    return entries.join(held, ["commit", "path", "blob"], "left").select(*entries.columns, F.col("_held").isNotNull().alias("proof"))
