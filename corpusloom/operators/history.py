"""Revision history: reachability, merge bases, tree differences, first occurrences, reconciliation, versions."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import release_numbers
from corpusloom.operators.budget import Budget, admitted


def ancestors(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, commit, depth): all that each tip reaches, itself included, at its smallest depth.

    A frontier join a generation, each cut off by a checkpoint every 16, so that neither plan nor lineage grows with the history.
    """
    seen = tips.select(F.col("commit").alias("tip"), "commit", F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in count(1):
        step = front.join(parents, "commit").select("tip", F.col("parent").alias("commit")).distinct()
        front = step.join(seen, ["tip", "commit"], "left_anti").withColumn("depth", F.lit(depth))
        front = front.checkpoint()
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
        if depth % 16 == 0:
            seen = seen.checkpoint()
    return seen


def tree_changes(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """Added and changed paths of each commit against its first parent: (commit, path, blob, change)."""
    first = parents.where("place = 0").select("commit", "parent")
    old = entries.select(F.col("commit").alias("parent"), "path", F.col("blob").alias("old_blob"))
    rows = entries.join(first, "commit", "left").join(old, ["parent", "path"], "left")
    change = F.when(F.col("old_blob").isNull(), "added").when(F.col("old_blob") != F.col("blob"), "changed")
    return rows.select("commit", "path", "blob", change.alias("change")).where("change is not null")


def first_seen(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """Each key's first row; min_by over a struct combines before the shuffle, where a row number could not."""
    rest = [c for c in rows.columns if c not in key]
    first = F.min(F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], *[c for c in rest if c not in order]))
    return rows.groupBy(*key).agg(first.alias("_f")).select(*key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def reconciled(known: DataFrame, reachable: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """known documents with keep: whether their revision is still reachable and they are not removed."""
    rows = known.join(reachable.select(F.col("commit").alias("revision")).distinct().withColumn("_r", F.lit(True)), "revision", "left")
    if removed is not None:
        rows = rows.join(removed.select("document_id").distinct().withColumn("_x", F.lit(True)), "document_id", "left")
    else:
        rows = rows.withColumn("_x", F.lit(None).cast("boolean"))
    return rows.select(*known.columns, (F.col("_r").isNotNull() & F.col("_x").isNull()).alias("keep"))


def complete_documents(states: DataFrame) -> DataFrame:
    """document_id, complete: ordinals 0 to the largest all there once, and one path and kind."""
    whole = (F.min("ordinal") == 0) & (F.count("*") == F.max("ordinal") + 1) & (F.countDistinct("ordinal") == F.count("*"))
    return states.groupBy("document_id").agg((whole & (F.countDistinct("path") == 1)).alias("complete"))


def reused_occurrences(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Content keys that a revision's tree shares with blobs already worked on."""
    return entries.join(known.select("path", "blob", "content_key").distinct(), ["path", "blob"]).select("commit", "path", "blob", "content_key")


def tips(refs: DataFrame) -> DataFrame:
    return refs.select("commit").distinct().orderBy("commit")


def resolved(selectors: DataFrame, refs: DataFrame, reached: DataFrame) -> DataFrame:
    """selector → commit: a ref's full name, its display name, else a 40-digit id that is reachable; null where nothing fits."""
    names = refs.select(F.explode(F.array(F.struct(F.lit(0).alias("p"), F.col("full_name").alias("n")), F.struct(F.lit(1).alias("p"), F.col("name").alias("n")))).alias("x"), "commit")
    by_name = names.select(F.col("x.n").alias("selector"), F.struct("x.p", "commit").alias("c"))
    by_id = reached.select(F.col("commit").alias("selector"), F.struct(F.lit(2).alias("p"), "commit").alias("c")).where(F.col("selector").rlike("^[0-9a-f]{40}$"))
    best = by_name.unionByName(by_id).groupBy("selector").agg(F.min("c").alias("c"))
    return selectors.join(best, "selector", "left").select("selector", F.col("c.commit").alias("commit"))


def version_order(default: str, name: str, full_name: str) -> list[Column]:
    """The default first, numbered releases by their numbers, then all others by name."""
    numbers = release_numbers(F.col(name))
    return [F.desc(default), F.asc(numbers.isNull()), F.asc(numbers), F.asc(full_name)]


def page(df: DataFrame, order: list[Column], cursor: str | None = None, limit: int = 50, most: int = 200) -> tuple[DataFrame, str]:
    """A page and the next cursor (v1:<offset>)."""
    offset = 0
    if cursor:
        version, _, number = cursor.partition(":")
        if version != "v1" or not number.isdigit():
            raise ValueError("a malformed cursor")
        offset = int(number)
    size = min(limit or 50, most)
    return df.orderBy(*order).offset(offset).limit(size), f"v1:{offset + size}"


def newest_admitted(rows: DataFrame, size: str, order: list[Column], limits: Budget) -> DataFrame:
    """Rows that a budget admits in order, each reserved for itself: what doesn't fit is passed over, and later rows that fit are admitted."""
    return admitted(rows, F.col(size), order, limits).where(F.col("verdict") == "ok").drop("verdict")


def reserved(entries: DataFrame, current: DataFrame) -> DataFrame:
    """Blobs (path, blob, size) with priority 0 where a current tree has them and 1 else: current trees spend a budget before deleted history."""
    held = current.select("path", "blob").distinct().withColumn("_c", F.lit(0))
    return entries.select("path", "blob", "size").distinct().join(held, ["path", "blob"], "left").withColumn("priority", F.coalesce("_c", F.lit(1))).drop("_c")


def tip_first(entries: DataFrame, current: DataFrame, limits: Budget) -> DataFrame:
    """Blobs (path, blob, size, priority, verdict): the budget is spent on the current trees' blobs first, then on history, in order of path and blob."""
    return admitted(reserved(entries, current), F.col("size"), [F.col("priority"), F.col("path"), F.col("blob")], limits)


def passages_once(chunks: DataFrame) -> DataFrame:
    """The first chunk (by sequence) of each content key and revision."""
    return first_seen(chunks, ["content_key", "revision"], ["sequence"])


def changed_index(previous: DataFrame, removed: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """previous without the removed documents, plus what was added; an added document replaces its old form."""
    gone = removed.select(key).unionByName(added.select(key)).distinct()
    return previous.join(gone, key, "left_anti").unionByName(added)
