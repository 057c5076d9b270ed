import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking
from corpusloom.plans import search, store
from corpusloom.streaming import watch


def chunks(spark):
    rows = [(f"d{i}", f"p{i}", "text/plain", f"alpha {'beta ' * (i % 3)}gamma document number {i}. " * 3) for i in range(12)]
    docs = spark.createDataFrame(rows, "document_id string, path string, media_type string, content string")
    made = chunking.chunk_documents(docs).join(docs.select("document_id", "path"), "document_id")
    return made.withColumn("repository", F.lit("r")).withColumn("revision", F.lit("v1"))


def test_modes(spark):
    table = chunks(spark)
    rows, warnings = search.search(table, search.Request("alpha beta", limit=5))
    found = rows.collect()
    assert warnings and [r["rank"] for r in found] == sorted(r["rank"] for r in found) and all("beta" in r["passage"] for r in found)
    hits = table.where("path = 'p0'").select("chunk_id", F.lit(1).alias("rank"))
    mixed, none = search.search(table, search.Request("alpha beta", limit=9, mode="hybrid"), hits)
    assert not none and "p0" in [r["path"] for r in mixed.collect()]
    with pytest.raises(ValueError):
        search.search(table, search.Request("alpha", mode="hybrid"))
    only, _ = search.search(table, search.Request("alpha", filters={"paths": ["p3"]}))
    assert [r["path"] for r in only.collect()] == ["p3"]


@pytest.mark.parametrize("wrong", [{"query": " "}, {"query": "x" * 5000}, {"query": "x", "limit": 51}, {"query": "x", "mode": "y"}, {"query": "x", "max_response_bytes": 0}, {"query": "x", "filters": {"trust_tier": "z"}}])
def test_refused_requests(wrong):
    with pytest.raises(ValueError):
        search.Request(**wrong)


def test_bounded_responses():
    rows = [{"rank": i, "chunk_id": f"c{i}", "path": "p", "repository": "r", "score": 1.0, "passage": "é" * 900} for i in range(10)]
    full = search.bounded(rows, search.Request("q", limit=10), [])
    assert len(full["results"]) == 10 and not full["codes"]
    less = search.bounded(rows, search.Request("q", limit=10, max_response_bytes=5000), ["a_code: text"])
    assert 0 < len(less["results"]) < 10 and less["codes"] == ["a_code", "results_dropped"]
    tiny = search.bounded(rows, search.Request("q", limit=10, max_response_bytes=20, detail="full"), [])
    assert not tiny["results"] and "response_budget_exceeded" in tiny["codes"] and "detail_degraded" in tiny["codes"]
    assert search.cut_utf8("é" * 3, 3) == "é"
    assert search.compact(rows)["sources"] == [{"repository": "r", "path": "p"}]
    assert search.capabilities()["max_limit"] == 50


def test_feedback(spark):
    records = spark.createDataFrame([("n1", None, False), ("n2", None, False)], "record_id string, supersedes string, covered boolean")
    new = spark.createDataFrame([("n3", "n1", False)], records.schema)
    after = search.inserted(records, new)
    assert {r["record_id"] for r in search.active(after).collect()} == {"n2", "n3"}
    assert {r["record_id"] for r in search.active(search.covered(after, "n2")).collect()} == {"n3"}
    with pytest.raises(ValueError):
        search.inserted(after, spark.createDataFrame([("n4", "n1", False)], records.schema))
    with pytest.raises(ValueError):
        search.inserted(records, new, capacity=2)
    results = spark.createDataFrame([(i, f"c{i}") for i in range(1, 6)], "rank int, chunk_id string")
    notes = spark.createDataFrame([(1, "n")], "rank int, chunk_id string")
    assert [r["chunk_id"] for r in search.merged(results, notes, 4).orderBy("rank").collect()] == ["c1", "c2", "c3", "n"]
    replay = search.replayed(spark.createDataFrame([("c1",), ("zz",)], "id string"), results, ["chunk_id"])
    assert {r["id"]: r["matched"] for r in replay.collect()} == {"c1": True, "zz": False}
    fixes = spark.createDataFrame([("k", [("u", "d1")]), ("l", [("u", "old")])], "record_id string, evidence array<struct<uri:string,digest:string>>")
    now = spark.createDataFrame([("u", "d1")], "uri string, digest string")
    assert {r["record_id"]: r["current"] for r in search.current(fixes, now).collect()} == {"k": True, "l": False}


def test_generations(spark, tmp_path):
    root = store.Store(spark, f"file://{tmp_path}/store")
    table = spark.range(20).withColumn("v", F.col("id") * 2)
    first = root.build({"numbers": (table, "id")}, {"engine": "1"})
    assert root.build({"numbers": (table.repartition(7), "id")}, {"engine": "1"}) == first == root.active()
    second = root.build({"numbers": (spark.range(21).withColumn("v", F.lit(1).cast("bigint")), "id")})
    assert root.active() == second != first and root.table("numbers", first).count() == 20
    root.validate()
    spark.range(3).withColumn("v", F.lit(0).cast("bigint")).write.mode("append").parquet(f"file://{tmp_path}/store/generations/{second}/numbers")
    with pytest.raises(ValueError):
        root.validate()
    with pytest.raises(ValueError):
        root.build({"numbers": (table.unionAll(table), "id")})
    assert store.snapshot_id({"a": "1", "b": "2"}, "c", {}, "m") == store.snapshot_id({"b": "2", "a": "1"}, "c", {}, "m")
    assert store.overhead(5, 100) == (5, True)


def test_change_stream_equals_batch(spark, tmp_path):
    rows = [("u", 1), ("u", 1), ("v", 5), ("u", 2), ("u", 2), ("v", 5), ("v", 6)]
    source = str(tmp_path / "in")
    for r in rows:
        spark.createDataFrame([r], "key string, stamp bigint").coalesce(1).write.mode("append").parquet(source)

    stream = spark.readStream.schema("key string, stamp bigint").option("maxFilesPerTrigger", 1).parquet(source)
    query = watch.change_stream(stream, "key", "stamp").writeStream.format("memory").queryName("changes_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["key"], r["stamp"]) for r in spark.table("changes_out").collect()} == {("u", 2), ("v", 6)}


def test_appends_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("id bigint").parquet(source)
        watch.append_once(stream, "id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        spark.range(5, 15).write.mode("append").parquet(source)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(15))


def test_late_events(spark, tmp_path):
    """Rows ten minutes out of order still count in their windows; the stream gives the batch's totals of closed windows."""
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", 1.0) for m in (0, 9, 5, 14, 6, 20, 40, 59)]
    events = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    made = watch.windowed_totals(stream, "ts", ["event_type"], "value", "10 minutes")
    made.writeStream.format("memory").queryName("late_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r["window_start"]: r["events"] for r in spark.table("late_out").collect()}
    batch = {r["window_start"]: r["events"] for r in watch.windowed_totals(events, "ts", ["event_type"], "value", "10 minutes").collect()}
    assert got.items() <= batch.items() and sum(batch.values()) == len(rows)


def test_a_complete_stage_is_not_made_again(spark, tmp_path):
    kept, made = store.Store(spark, str(tmp_path)), []

    def make():
        made.append(1)
        return spark.range(5)

    for contract in ({"v": 1}, {"v": 1}, {"v": 2}):
        assert kept.stage("ids", contract, make, "id").count() == 5
    assert len(made) == 2
    marker = next(p for p in (tmp_path / "stages").glob("ids-*/complete.json"))
    marker.unlink()  # stopped before the marker
    kept.stage("ids", {"v": 1}, make, "id")
    kept.stage("ids", {"v": 2}, make, "id")
    assert len(made) == 3
    spark.range(9).write.parquet(str(marker.parent / "rows"), mode="overwrite")  # rows are no longer those of the marker
    kept.stage("ids", {"v": 1}, make, "id")
    assert kept.stage("ids", {"v": 2}, make, "id").count() == 5 and len(made) == 4


def test_overlay_holds_corrections_to_score_and_evidence(spark):
    rows = [("a", "correction", "gear ratio", None, None, "1"), ("b", "correction", "gear ratio", None, None, "2"), ("c", "note", "gear", None, None, "9"),
            ("d", "note", "gear ratio", None, True, "1"), ("e", "note", "gear ratio", "c", None, "1")]
    records = spark.createDataFrame(rows, "record_id string, kind string, text string, supersedes string, covered boolean, u string")
    records = records.withColumn("evidence", F.array(F.struct(F.col("u").alias("uri"), F.lit("x").alias("digest")))).drop("u")
    resources = spark.createDataFrame([("1", "x"), ("2", "changed")], "uri string, digest string")
    assert [r["record_id"] for r in search.overlay(records, "gear ratio", 5, resources, least=0.1).orderBy("rank").collect()] == ["a", "e"]
    assert [r["record_id"] for r in search.overlay(records, "gear ratio", 5, resources, least=99.0).collect()] == ["e"]
    assert search.overlay(records.limit(0), "gear", 5, resources).count() == 0


def test_the_service_s_chunks_are_cut_once(spark, tmp_path):
    from corpusloom.queries import QUERIES

    rows = [(i, f"this with that {i}", "en", "src0", 16) for i in range(5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["search_service"](spark, str(tmp_path))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 5
