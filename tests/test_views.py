"""Passages cut from blobs against stored chunks."""

from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__
from corpusloom.operators import chunking, views


def test_cut_passages_are_the_stored_chunks(spark):
    texts = {f"b{i}": " ".join(f"wörd{i}x{j}" for j in range(400 + i)) for i in range(6)}
    blobs = spark.createDataFrame(list(texts.items()), "blob string, content string")
    seen = [(f"v{r:02d}", f"d/{b}", b) for b in texts for r in range(30)]
    occurrences = spark.createDataFrame(seen, "revision string, path string, blob string")
    kinds = blobs.withColumns({"path": F.lit("a.txt"), "media_type": F.lit("text/plain")})
    places = views.locators(kinds)
    stored = chunking.chunk_documents(kinds.withColumn("document_id", F.col("blob"))).select(F.col("document_id").alias("blob"), "ordinal", "text")
    for page in (1000, 3):  # sent to the blobs, or met in a shuffle
        cut = views.with_passages(places, blobs, page).select("blob", "ordinal", "passage")
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, stored.collect()))
    virtual = views.virtual_chunks(occurrences, places)
    assert virtual.count() == 30 * places.count() and "text" not in virtual.columns
    repeated = stored.join(occurrences, "blob").agg(F.sum(F.octet_length("text"))).first()[0]
    held = blobs.agg(F.sum(F.octet_length("content"))).first()[0]
    assert held == sum(len(t.encode()) for t in texts.values()) and repeated > 29 * held  # 30 revisions store each text once


def test_winners_get_their_history(spark):
    occurrences = spark.createDataFrame([(f"v{r}", f"p{r % 2}", "b") for r in range(9)] + [("v0", "p0", "b"), ("v1", "q", "c")], "revision string, path string, blob string")
    ranked = spark.createDataFrame([(1, "b"), (2, "c")], "rank int, blob string")
    got = {r["blob"]: (r["occurrences"], r["paths"], [(x["revision"], x["path"]) for x in r["first"]]) for r in views.with_history(ranked, occurrences, most=3).collect()}
    assert got == {"b": (10, 2, [("v0", "p0"), ("v1", "p1"), ("v2", "p0")]), "c": (1, 1, [("v1", "q")])}


def test_history_search_indexes_numbers(spark):
    """The postings' key is a number: a digest on each of them took nine tenths of the index."""
    place = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "corpusloom-index"
    before = set(place.glob("*"))
    assert len(__spark_entry__.queries()["history_search"](spark, "/root/testdata/sf0.001").collect()) == 10
    (made,) = set(place.glob("*")) - before
    assert dict(spark.read.parquet(f"{made}/postings").dtypes) == {"field": "string", "term": "string", "number": "bigint", "length": "int", "tf": "bigint"}


def test_contents_stay_where_they_are(spark):
    rows = [(i, f"b{i % 7}" if i < 40 else f"c{i}", f"text {i}") for i in range(60)]
    for kept, given in ((27, rows), (7, rows[:40])):  # the keys that go are sent, then those that stay
        found = views.firsts(spark.createDataFrame(given, "n bigint, blob string, content string"), "n")
        assert sorted(tuple(r) for r in found.select("n", "blob", "content").collect()) == [r for i, r in enumerate(given) if r[1] not in {x[1] for x in given[:i]}]
        assert found.count() == kept and "content" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in x)
