"""Resumed embedding and derived snapshots: what each run works on."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.vectors import Profile, fake_embedding
from corpusloom.plans.embedding import EmbeddingRun
from corpusloom.plans.files import listed_files
from corpusloom.plans.snapshots import Snapshots

PROFILE = Profile("mean", 4, 512, passage_prefix="p: ")


def rows(spark, n=50):
    return spark.createDataFrame([(f"k{i:02d}", f"text {i}") for i in range(n)], "k string, text string").repartition(3)


def test_a_run_that_stops_goes_on_with_the_rest(spark, tmp_path):
    root, log = str(tmp_path / "run"), str(tmp_path / "log")

    def provider(broken):
        def embed(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            if broken and any(t.endswith(" 25") for t in texts):
                raise OSError("the model is gone")
            return fake_embedding(texts, 4)

        return embed

    run = EmbeddingRun(spark, root, "k", "m", PROFILE, rows(spark), block_rows=10)
    with pytest.raises(Exception, match="the model is gone"):
        run.run(provider(True))
    landed = {r["block"]: r["landed"] for r in run.progress().collect()}
    assert landed[2] == 0 and set(landed.values()) <= {0, 10}
    first = listed_files(spark, f"{root}/landed") if sum(landed.values()) else []
    with pytest.raises(ValueError, match="no vector yet"):
        run.finish()

    open(log, "w").close()
    again = EmbeddingRun(spark, root, "k", "m", PROFILE, rows(spark), block_rows=10)
    assert again.run(provider(False)) == 0
    seen = sorted(open(log).read().split("\n")[:-1])
    assert len(seen) == sum(10 - n for n in landed.values()) == len(set(seen))  # exactly the rest, each once
    assert set(first) <= set(listed_files(spark, f"{root}/landed"))
    found = {r["k"]: r["embedding"] for r in again.finish().collect()}
    assert found == {f"k{i:02d}": pytest.approx(fake_embedding([f"p: text {i}"], 4)[0]) for i in range(50)}
    assert again.run(provider(True)) == 0  # nothing left to ask the model for
    again.finish()


def test_holes_within_blocks(spark, tmp_path):
    run = EmbeddingRun(spark, str(tmp_path / "run"), "k", "m", PROFILE, rows(spark), block_rows=16)
    odd = {"p: text 3", "p: text 17", "p: text 49"}
    bad = {"p: text 3": None, "p: text 17": [float("nan")] * 4, "p: text 49": [1.0]}
    assert run.run(lambda texts: [bad.get(t, fake_embedding([t], 4)[0]) for t in texts]) == 3
    assert {r["text"] for r in run.holes().collect()} == odd
    assert {(r["block"], r["rows"], r["landed"]) for r in run.progress().collect()} == {(0, 16, 15), (1, 16, 15), (2, 16, 16), (3, 2, 1)}
    asked = []
    assert run.holes().count() == 3
    assert run.run(lambda texts: fake_embedding(texts, 4)) == 0 and not asked
    assert run.vectors().count() == 50


def test_another_identity_is_refused(spark, tmp_path):
    root = str(tmp_path / "run")
    EmbeddingRun(spark, root, "k", "m", PROFILE, rows(spark), block_rows=10)
    EmbeddingRun(spark, root, "k", "m", PROFILE, block_rows=10)
    for how in (dict(model="other"), dict(profile=Profile("mean", 5, 512, passage_prefix="p: ")), dict(rows=rows(spark, 49))):
        settings = dict(model="m", profile=PROFILE, rows=None) | how
        with pytest.raises(ValueError, match="another model"):
            EmbeddingRun(spark, root, "k", settings["model"], settings["profile"], settings["rows"], block_rows=10)


def test_three_requests(spark, tmp_path):
    def chunk(docs):
        lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
        return lines.select("document_id", F.concat_ws("#", "document_id", "i").alias("chunk_id"), F.sha2("text", 256).alias("content_key"), "text")

    snapshots = Snapshots(spark, str(tmp_path / "s"), chunk, lambda t: fake_embedding(t, 4), "m", Profile("mean", 4, 512))
    one = spark.createDataFrame([("d1", "a\nb"), ("d2", "b\nc")], "document_id string, text string")
    two = spark.createDataFrame([("d1", "a\nb"), ("d3", "c\nd\ne")], "document_id string, text string")
    first = snapshots.request({"r": "c1"}, one)
    assert (first.how, first.chunked, first.embedded) == ("built", 2, 3)
    equal = snapshots.request({"r": "c1"}, one)
    assert (equal.name, equal.how, equal.chunked, equal.embedded) == (first.name, "reused", 0, 0)
    on = snapshots.request({"r": "c2"}, two)
    assert (on.how, on.base, on.chunked, on.embedded) == ("derived", first.name, 1, 2)
    assert sorted(r["text"] for r in snapshots.table(on.name, "chunks").collect()) == ["a", "b", "c", "d", "e"]
    vectors = {r["content_key"]: r["embedding"] for r in snapshots.table(on.name, "vectors").collect()}
    assert len(vectors) == 5
    other = Snapshots(spark, str(tmp_path / "s"), chunk, lambda t: fake_embedding(t, 4), "m2", Profile("mean", 4, 512))
    assert other.request({"r": "c2"}, two).how == "built"  # another model has nothing to derive from


def test_what_is_embedded_is_written_once_before(spark, tmp_path, monkeypatch):
    from corpusloom.plans import snapshots as module

    plans, run = [], module.EmbeddingRun

    def seen(spark, root, key, model, profile, rows):
        plans.append((rows._jdf.queryExecution().optimizedPlan().toString(), {r["text"] for r in rows.collect()}))
        return run(spark, root, key, model, profile, rows)

    monkeypatch.setattr(module, "EmbeddingRun", seen)
    chunk = lambda docs: docs.select("document_id", F.col("document_id").alias("chunk_id"), F.sha2("text", 256).alias("content_key"), "text")
    held = Snapshots(spark, str(tmp_path / "s"), chunk, lambda t: fake_embedding(t, 4), "m", Profile("mean", 4, 512))
    held.request({"r": "c1"}, spark.createDataFrame([("d1", "a"), ("d2", "b")], "document_id string, text string"))
    on = held.request({"r": "c2"}, spark.createDataFrame([("d1", "a"), ("d3", "b"), ("d4", "c"), ("d5", "c")], "document_id string, text string"))
    assert not any(word in plan for plan, _ in plans for word in ("Aggregate", "Join"))
    assert [texts for _, texts in plans] == [{"a", "b"}, {"c"}]
    assert (on.how, on.chunked, on.embedded) == ("derived", 3, 1)
    assert held.table(on.name, "chunks").count() == 4 and held.table(on.name, "vectors").count() == 3
