import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, evaluate, lexical, lookup, vectors
from corpusloom.sources import catalog


def test_filters():
    assert lookup.parsed_filters({"category": "nope", "paths": ["a", " "], "tags": ["B", "a"], "revision": None}, {"x"}) == {"paths": ["a"], "tags": ["a", "b"]}
    with pytest.raises(ValueError):
        lookup.parsed_filters({"tags": [" "]}, set())
    assert lookup.filter_effects({"paths": ["a", "b"], "category": "x"}) == ["category=x", "path=a", "path=b"]
    assert lookup.with_default_repository({}, "r") == {"repository": "r"} and lookup.with_default_repository({"repository": "q"}, "r") == {"repository": "q"}


def test_passages_fail_on_unknown_ids(spark):
    chunks = spark.createDataFrame([("c1", "d", 0, "t", ["h"], ["i"], [], "x"), ("c2", "d", 1, "t", [], [], ["z"], "y")], "chunk_id string, document_id string, ordinal int, title string, heading_path array<string>, identifiers array<string>, tags array<string>, text string")
    wanted = spark.createDataFrame([(1, "c2"), (0, "c1")], "position int, chunk_id string")
    rows = lookup.embedding_texts(chunks, wanted).collect()
    assert [r["chunk_id"] for r in rows] == ["c1", "c2"] and rows[1]["embedding_text"] == "Title: t\nTags: z\nContent: y"
    with pytest.raises(Exception, match="missing"):
        lookup.passages(chunks, spark.createDataFrame([("zz",)], "chunk_id string")).collect()
    assert [r["ordinal"] for r in lookup.document_chunks(chunks, "d").collect()] == [0, 1]


def test_aliases(spark):
    chunks = spark.createDataFrame([("a", "r1", "v1"), ("b", "r2", "v1"), ("c", "r2", "v9"), ("d", "r3", "v1")], "chunk_id string, repository string, revision string")
    aliases = spark.createDataFrame([("r1", "k"), ("r2", "k"), ("r3", "m")], "repository string, contract string")
    reached = spark.createDataFrame([("t", "v1")], "tip string, commit string")
    assert sorted(r["chunk_id"] for r in lookup.aliased(chunks, aliases, "r1", reached, "t").collect()) == ["a", "b"]


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "q", "a", "xx", 1), (1, "q", "b", "xxxx", 2), (1, "q", "c", "x", 3)], "query_id int, query string, chunk_id string, text string, rank int")
    got = lookup.reranked(rows, lambda pairs: [float(len(t)) for _, t in pairs], 2).orderBy("place").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a"]


def test_suites(spark, tmp_path):
    bare = '[{"id": "q1", "text": "t", "intent": "i", "relevant": {"a": 2, "b": 1}}]'
    for name, text in (("bare", bare), ("full", '{"schema": 1, "queries": ' + bare + "}")):
        (tmp_path / name).write_text(text)
        queries, qrels = evaluate.suite(spark, str(tmp_path / name))
        assert queries.count() == 1 and {(r["id"], r["grade"]) for r in qrels.collect()} == {("a", 2), ("b", 1)}


def test_roots(spark):
    df = spark.createDataFrame([("/a/b",), ("/ab",), ("/a/../b",)], "p string")
    assert [r["x"] for r in df.select(catalog.under_root(F.col("p"), "/a").alias("x")).collect()] == [True, False, False]


def test_boolean_search_over_fields(spark, tmp_path):
    docs = spark.createDataFrame([(1, "motor", "the gear turns"), (2, "gear", "a motor"), (3, "motor", None), (4, "", "nvm page")], "id int, title string, body string")
    path = str(tmp_path / "index")
    lexical.write_index(docs, "id", ["title", "body"], path)
    found = lambda q, **k: [r["id"] for r in lexical.boolean_index(lexical.open_index(spark, path), "id", q, 10, **k).collect()]
    assert sorted(found("gear motor")) == [1, 2]  # both, in whatever field
    assert sorted(found("gear motor absent")) == [1, 2, 3]  # any of three
    assert found("persistence") == []  # an expansion alone is not enough
    assert found("persistence x y") == [4]
    assert sorted(found("gear motor", exact=docs.where("id = 4").select("id"))) == [1, 2, 4]
    with pytest.raises(ValueError):
        found(" - ")


def test_windows_join_to_the_text(spark):
    docs = spark.createDataFrame([(1, " a b  c\nd e "), (2, ""), (3, None), (4, "   "), (5, "wwwwwwwwww")], "id int, text string")
    rows = chunking.windowed(docs, "id", "text", 2).orderBy("id", "ordinal").collect()
    assert [(r["id"], r["ordinal"], r["window"]) for r in rows] == [(1, 0, " a b  "), (1, 1, "c\nd "), (1, 2, "e "), (4, 0, "   "), (5, 0, "wwwwwwwwww")]
    chars = lambda text: [(i, i + 1) for i in range(len(text))] + ([(0, 0)] if len(text) > 3 else [])  # noqa: E731  a tokenizer that adds a token
    again = chunking.windowed(docs.where("id = 5"), "id", "text", 4, chars).orderBy("ordinal").collect()
    assert "".join(r["window"] for r in again) == "w" * 10 and all(r["tokens"] <= 4 for r in again)
    assert chunking.windowed(docs.limit(0), "id", "text", 2).count() == 0
    with pytest.raises(ValueError):
        chunking.windowed(docs, "id", "text", 0)


def test_profiles(spark):
    known = {"small": vectors.Profile("cls", 8, 512, "query: "), "small-long": vectors.Profile("mean", 4, 8192, normalised=False)}
    assert vectors.profile_of("org/Small-Long-v2", known).max_length == 8192 and vectors.profile_of("x/small", known).dimension == 8
    with pytest.raises(ValueError):
        vectors.profile_of("other", known)
    with pytest.raises(ValueError):
        vectors.Profile("max", 8, 1)
    docs = spark.createDataFrame([(1, "text")], "id int, text string")
    provider = lambda texts: vectors.fake_embedding(texts, 8)
    row = vectors.embedded_by(docs, "text", provider, known["small"], query=True).first()
    assert row["embedding"] == pytest.approx(vectors.fake_embedding(["query: text"], 8)[0])
    with pytest.raises(Exception, match="components"):
        vectors.embedded_by(docs, "text", provider, known["small-long"]).collect()


def test_texts_are_cut_in_slices_of_bounded_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 4, None, "b" * 4, "c" * 30, "", "é" * 2])], names=["k", "t"])
    parts = list(chunking.text_slices(iter([batch, batch.slice(0, 0), batch.slice(3)]), 1, most=8))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5], [3], [4, 5]]
