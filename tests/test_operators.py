import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import chunking, fusion, graph, history, investigate, lexical, vectors
from corpusloom.sources import catalog


@pytest.mark.parametrize(
    ("text", "target", "least", "want"),
    [("aaaa bbbb cccc", 6, 2, ["aaaa ", "bbbb ", "cccc"]), ("abcdefghij", 4, 1, ["abcd", "efgh", "ij"]), ("a bcdefgh", 4, 3, ["a bc", "defg", "h"])],
)
def test_bounded_split(text, target, least, want):
    assert [text[a:b] for a, b in chunking.split_bounded(text, target, least)] == want


@given(st.text(alphabet="ab é\n", max_size=200), st.integers(1, 20), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_split_keeps_all_but_blanks(text, target, least):
    spans = chunking.split_bounded(text, target, min(least, target))
    assert all(0 < b - a <= target for a, b in spans)
    assert "".join(text[a:b] for a, b in spans).split() == text.split() or any(not c.isspace() for c in text)
    assert [c for a, b in spans for c in text[a:b] if not c.isspace()] == [c for c in text if not c.isspace()]


def test_markdown_blocks():
    text = "# A\n\npara\n\n## B\ntext\n\n```\n# no heading\n\nmore\n```\n\ntail\n"
    blocks = [(text[s:e], h) for s, e, _, h in chunking.markdown_blocks(text)]
    assert blocks[0] == ("# A\n\npara\n", ["A"]) and blocks[1] == ("## B\ntext\n", ["A", "B"])
    assert blocks[2][0] == "```\n# no heading\n\nmore\n```\n" and blocks[3] == ("tail\n", ["A", "B"])
    deep = "".join(f"{'#' * i} h{i}\n\n" for i in range(1, 8)) + "body\n"
    assert chunking.markdown_blocks(deep)[-1][3] == [f"h{i}" for i in range(1, 8)]


def test_code_is_kept_whole():
    config = chunking.ChunkConfig(target=20, hard=40, minimum=5)
    made = chunking.chunk_text("intro\n\n```\n" + "x = 1\n" * 20 + "```\n", "text/markdown", "a.md", config)
    assert len(made) == 2 and made[1][0].count("x = 1") == 20


def test_spans_and_ids(spark):
    docs = spark.createDataFrame([("d1", "a.txt", "text/plain", "é line\n" * 500), ("d2", "b.md", "text/markdown", "# H\n\ntext"), ("d3", "c.txt", "text/plain", " \n")], "document_id string, path string, media_type string, content string")
    rows = chunking.linked(chunking.chunk_documents(docs)).collect()
    known = chunking.chunk_documents(docs, carry=("path",), neighbours=True)
    assert "Exchange" not in known._jdf.queryExecution().executedPlan().toString()
    near = lambda rs: {r["chunk_id"]: (r["previous_chunk"], r["next_chunk"]) for r in rs}
    assert near(known.collect()) == near(rows)
    text = "é line\n" * 500
    for r in (r for r in rows if r["document_id"] == "d1"):
        assert text.encode()[r["start_byte"] : r["end_byte"]].decode() == r["text"]
        assert r["start_line"] == 1 + text.encode()[: r["start_byte"]].count(b"\n")
    assert {r["document_id"] for r in rows} == {"d1", "d2"} and next(r for r in rows if r["document_id"] == "d2")["heading_path"] == ["H"]
    ids = {r["chunk_id"] for r in rows}
    assert all(r["next_chunk"] is None or r["next_chunk"] in ids for r in rows)
    whole = {r["document_id"]: r["content"] for r in chunking.reassembled(chunking.chunk_documents(docs)).collect()}
    assert whole["d1"] == text


def test_index_gives_the_scan_scores(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randrange(1, 30)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    lexical.write_index(docs, "id", ["text"], str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "alpha gamma")], "query_id int, query string")
    found = lexical.search_index(lexical.open_index(spark, str(tmp_path / "index")), "id", asked, 10)
    scan = lexical.scored(docs, "id", "text", ["alpha", "gamma"]).where("coverage > 0").orderBy(F.desc("coverage"), F.desc("score"), "id").limit(10)
    assert [(r["id"], round(r["score"], 6)) for r in found.orderBy("rank").collect()] == [(r["id"], r["score"]) for r in scan.collect()]


def test_filters_come_before_the_limit(spark):
    rows = [(f"n{i:03d}", "alpha beta", "noise") for i in range(128)] + [("target", "alpha beta and much more text", "wanted")]
    chunks = spark.createDataFrame(rows, "id string, text string, category string")
    pool = lexical.filtered(chunks, category="wanted")
    assert [r["id"] for r in lexical.candidates(pool, "id", "text", "alpha beta", 1).collect()] == ["target"]
    with pytest.raises(ValueError):
        lexical.candidates(pool, "id", "text", " - ", 1)


def test_full_coverage_pass(spark):
    rows = [(f"n{i:03d}", "alpha beta") for i in range(128)] + [("target", "alpha beta gamma " + "filler " * 60)]
    found = lexical.candidates(spark.createDataFrame(rows, "id string, text string"), "id", "text", "alpha beta gamma", 1)
    best = lexical.final_order(found, "id", 1, "alpha beta gamma")
    assert best.first()["id"] == "target"


def test_tags_and_paths(spark):
    rows = [("a", "p1", ["x", "y"]), ("b", "p2", ["x"])]
    df = spark.createDataFrame(rows, "id string, path string, tags array<string>")
    assert [r["id"] for r in lexical.filtered(df, tags=["X", "y"]).collect()] == ["a"]
    assert [r["id"] for r in lexical.filtered(df, paths=["p2", " "]).collect()] == ["b"]
    with pytest.raises(ValueError):
        lexical.filtered(df, tags=[" "])


def test_vectors(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 8))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, embedding array<double>").repartition(3)
    queries = table.where("id < 5").withColumnRenamed("id", "query_id")
    scores = np.round(data @ data.T, 6)
    for rows in (vectors.top_k_batch(table, "id", queries, 4), vectors.top_k_batch(table, "id", queries, 4, most=2)):
        got = {(r["query_id"], r["rank"]): r["id"] for r in rows.collect()}
        for q in range(5):
            want = sorted(range(60), key=lambda i: (-scores[q, i], i))[:4]
            assert [got[q, k + 1] for k in range(4)] == want
    bad = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, None)], "id int, embedding array<double>")
    got = {r["id"]: r["v"] for r in bad.select("id", vectors.verdict(F.col("embedding"), 2).alias("v")).collect()}
    assert got == {1: None, 2: "zero", 3: "not_unit", 4: "not_finite", 5: "dimension", 6: "dimension"}


def test_fake_embedding():
    got = vectors.fake_embedding(["abcd!"], 4)[0]
    assert np.allclose(got, [0.604129, 0.455420, 0.460067, 0.464714], atol=1e-6)
    with pytest.raises(ValueError):
        vectors.fake_embedding([" "], 4)


def test_embedding_by_provider(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    got = vectors.embedded(df, "t", lambda v: vectors.fake_embedding(v, 2)).collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in got)


def test_fusion_example(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (1, "a", 3)], "query_id int, id string, rank int")
    got = {r["id"]: r["score"] for r in fusion.reciprocal_rank(a, b, "id").collect()}
    assert got["a"] == got["c"] == pytest.approx(1 / 61 + 1 / 63) and got["b"] == got["d"] == pytest.approx(1 / 62)


@given(st.lists(st.tuples(st.sampled_from("ABC"), st.sampled_from("xyzw")), max_size=14))
@settings(max_examples=15, deadline=None)
def test_cap_and_dedup_against_a_loop(spark, rows):
    if not rows:
        return
    df = spark.createDataFrame([(1, i, d, g) for i, (d, g) in enumerate(rows)], "q int, r int, d string, g string")
    got = [r["r"] for r in fusion.capped(df, "q", "r", "d", "g", 2, 5).orderBy("r").collect()]
    want, seen, counts = [], set(), {}
    for i, (d, g) in enumerate(rows):
        if len(want) < 5 and counts.get(d, 0) < 2 and g not in seen:
            want.append(i)
            seen.add(g)
            counts[d] = counts.get(d, 0) + 1
    assert got == want


def test_facet_quota(spark):
    rows = [(f"f{i}", "fw", "load", "v1", 1.0 - i / 100, 0.0) for i in range(20)] + [("p", "pk", "build", "v1", 0.1, 0.0), ("n", "pk", "build", "v1", float("nan"), 0.0)]
    candidates = spark.createDataFrame(rows, "candidate_id string, repository string, stage string, revision string, score double, retrieval_score double")
    facets = spark.createDataFrame([("a", "fw", "load", "v1"), ("b", "pk", "build", None), ("c", "fw", "load", "v9")], "facet_id string, repository string, stage string, era string")
    got = {(r["facet_id"], r["candidate_id"]) for r in fusion.facet_top_k(candidates, facets, 1).collect()}
    assert got == {("a", "f0"), ("b", "p")}


def test_graph_expansion_has_no_cycles(spark):
    edges = spark.createDataFrame([(1, 2, "n", 9), (2, 1, "n", 9), (2, 3, "n", 9), (3, 4, "n", 9)], "source int, target int, relation string, confidence int")
    got = {(r["node"], r["hop"]) for r in graph.expanded(edges, spark.createDataFrame([(1,)], "node int"), hops=2).collect()}
    assert got == {(1, 0), (2, 1), (3, 2)}


def test_long_histories(spark):
    parents = spark.createDataFrame([(f"c{i:03d}", f"c{i - 1:03d}") for i in range(1, 40)], "commit string, parent string")
    got = history.ancestors(parents, spark.createDataFrame([("c039",)], "commit string"))
    assert got.count() == 40 and got.agg(F.max("depth")).first()[0] == 39


def test_pages_cover_everything_once(spark):
    df = spark.range(23)
    seen, cursor = [], None
    while True:
        rows, cursor = history.page(df, [F.asc("id")], cursor, 5)
        part = [r["id"] for r in rows.collect()]
        if not part:
            break
        seen += part
    assert seen == list(range(23))
    with pytest.raises(ValueError):
        history.page(df, [F.asc("id")], "v2:3")


def test_investigation_rounds(spark):
    facets = spark.createDataFrame([("f1", "r1", "s", None, "q"), ("f2", "r2", "s", None, "q")], "facet_id string, repository string, stage string, era string, question string")
    investigate.check_contract(facets, spark.createDataFrame([("f1", "f2", "k")], "from_facet string, to_facet string, kind string"))

    def acquire(plan):
        return plan.orderBy("facet_id").limit(1).join(facets, "facet_id").select(F.concat(F.lit("e"), "facet_id").alias("evidence_id"), "facet_id", "repository", "stage", F.lit("v").alias("revision"), F.lit(False).alias("adjacent"))

    state, held = investigate.investigate(facets, acquire)
    assert state == "answered" and held.count() == 2
    state, _ = investigate.investigate(facets, acquire, investigate.RoundBudget(rounds=1))
    assert state == "insufficient"
    with pytest.raises(ValueError):
        investigate.RoundBudget(rounds=0)


def package(fields, magic=b"Magic"):
    raw = magic + b"\0" + b"".join(k.encode() + b"\0" + struct.pack(">i", len(v)) + v for k, v in fields)
    return struct.pack(">I", len(raw)) + zlib.compress(raw)


def test_packages(spark):
    good = package([("name", b"x"), ("data", b"\0\1\2")])
    files = spark.createDataFrame([("a", good), ("b", good[:-4]), ("c", b"xx"), ("d", package([("n", b"")], b"Other"))], "path string, content binary")
    rows = catalog.packages(files, "Magic").collect()
    assert {(r["key"], bytes(r["value"])) for r in rows if r["path"] == "a"} == {("name", b"x"), ("data", b"\0\1\2")}
    assert {r["path"] for r in rows if r["error"]} == {"b", "c", "d"}
    code = b"(code)\0"
    head = struct.pack(">h", 0) + code + struct.pack(">h", 1) + b"tag\0"
    offset = len(head) + 8 - 2
    assert catalog.imports(head + struct.pack(">ii", offset, 3) + b"xyz") == ("(code)", [("tag", offset, 3, b"xyz")])


def test_yaml_and_paths(spark):
    text = "version: 1\ncommands:\n  - id: a\n    path: src/x.c\n  - id: b\n    path: http/no\n    doc: {path: docs/y.md}\n"
    records = catalog.yaml_records(spark.createDataFrame([("f.yaml", text), ("g.yaml", "a: 1")], "path string, text string"))
    rows = records.collect()
    assert [(r["path"], r["key"], r["position"], r["line"]) for r in rows] == [("f.yaml", "commands", 0, 2), ("f.yaml", "commands", 1, 2), ("g.yaml", "root", 0, 1)]
    assert [r["path"] for r in catalog.referenced_paths(records).collect()] == ["docs/y.md", "src/x.c"]


def test_scanned_files(spark):
    specs = spark.createDataFrame([("a", 10, True), ("b", 2, False), ("c", 10, False), ("../d", 10, False), ("e", 10, False)], "path string, max_bytes int, required boolean")
    files = spark.createDataFrame([("a", b"x\r\ny"), ("b", b"long"), ("e", b"\xff\xfe")], "path string, data binary")
    got = {r["path"]: (r["rejection"], r["content"]) for r in catalog.scanned_files(specs, files).collect()}
    assert got == {"a": (None, "x\ny"), "b": ("oversized", None), "c": ("missing", None), "../d": ("outside", None), "e": ("encoding", None)}
    with pytest.raises(Exception, match="required"):
        catalog.scanned_files(specs, files.where("path <> 'a'")).collect()


def test_descriptors_and_profiles(spark):
    row = spark.createDataFrame([("o:l:q:1:r:n",), ("o:l:q:2:r:n",), ("a:b",)], "s string").select(catalog.colon_descriptor(F.col("s")).alias("x")).collect()
    assert row[0]["x"]["fullscreen"] is True and row[1]["x"] is None and row[2]["x"] is None
    flames = spark.createDataFrame([("<title>f (a) (1,234 samples, 5.6%)</title>",), ("other",)], "line string")
    assert [tuple(r) for r in catalog.flame_frames(flames).collect()] == [("f (a)", 1234, 5.6)]


def test_symbols(spark):
    groups = spark.createDataFrame([("g1", ["a", "b"]), ("g2", ["c"])], "id string, symbols array<string>")
    assert [r["symbol"] for r in catalog.symbol_entries(groups, ["g2", "g1"]).orderBy("place", "symbol").collect()] == ["c", "a", "b"]
    with pytest.raises(ValueError, match="missing"):
        catalog.symbol_entries(groups, ["g3"])
    with pytest.raises(ValueError, match="header"):
        catalog.symbol_entries(groups, ["g1"], spark.createDataFrame([("only a",)], "text string"))


def test_a_large_batch_of_queries_loses_no_term(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id bigint, text string")
    terms = spark.range(100_500).select(F.col("id").alias("query_id"), F.lit("alpha").alias("term"))
    found = lexical.query_postings(docs, "doc_id", "text", terms)
    assert found.select("query_id").distinct().count() == found.count() == 100_500


def test_facets_take_turns_and_nothing_is_dropped(spark):
    facets = spark.createDataFrame([(f"f{i:02d}", f"r{i}", "s", None, "q") for i in range(12)], "facet_id string, repository string, stage string, era string, question string")
    plans = []

    def acquire(plan):
        plans.append([r["facet_id"] for r in plan.collect()])
        last = plan.where("facet_id >= 'f08'")  # the first eight have no answer
        return last.join(facets, "facet_id").select(F.concat(F.lit("e"), "facet_id").alias("evidence_id"), "facet_id", "repository", "stage", F.lit("v").alias("revision"), F.lit(False).alias("adjacent"))

    state, held = investigate.investigate(facets, acquire, investigate.RoundBudget(rounds=2))
    assert state == "insufficient" and held.count() == 4
    assert plans[0] == [f"f{i:02d}" for i in range(8)] and plans[1][:4] == ["f08", "f09", "f10", "f11"]
    with pytest.raises(ValueError, match="over 3 pieces"):
        investigate.investigate(facets, acquire, investigate.RoundBudget(rounds=2, evidence=3))
    turns = []

    def contradict(plan):
        turns.append(1)
        return facets.limit(1).select(F.lit("e").alias("evidence_id"), "facet_id", F.lit(f"r{len(turns)}").alias("repository"), "stage", F.lit("v").alias("revision"), F.lit(False).alias("adjacent"))

    with pytest.raises(ValueError, match="contradicts"):
        investigate.investigate(facets, contradict)
    long = facets.withColumn("question", F.repeat(F.lit("ü"), 130))
    with pytest.raises(Exception, match="too long"):
        investigate.planned(long, facets.select("facet_id")).collect()


def test_proposals(spark):
    facets = spark.createDataFrame([("a", "r", "s", None), ("b", "r", "s", None)], "facet_id string, repository string, stage string, era string")
    new = spark.createDataFrame([("c", "r", "s", None), ("a", "r", "s", None)], facets.schema)
    links = spark.createDataFrame([("a", "c", "k")], "from_facet string, to_facet string, kind string")
    asked = "facet_id string, query string"
    assert investigate.proposal_problems(facets, new, links, spark.createDataFrame([("c", "x"), ("a", "x")], asked)).count() == 0
    bad = spark.createDataFrame([("z", "x"), ("a", " "), ("a", "x\ty"), ("b", "y"), ("b", "y"), ("b", "ü" * 129)] + [("b", str(i)) for i in range(5)], asked)
    clash = spark.createDataFrame([("a", "other", "s", None)], facets.schema)
    got = {r["problem"]: r["n"] for r in investigate.proposal_problems(facets, clash, links, bad).collect()}
    assert got == {"limit": 1, "conflict": 1, "unknown_facet": 2, "query": 4}


def test_records_have_anchors_and_names(spark):
    text = "# list\nitems:\n- id: x\n  name: n\n- command: [1]\n- plain\nother: 1\n"
    rows = catalog.yaml_records(spark.createDataFrame([("f.yaml", text), ("g.json", '{"a": {"id": "q"}}')], "path string, text string")).collect()
    assert [(r["anchor"], r["identifiers"], r["line"]) for r in rows] == [("items[0]", ["items[0]", "n", "x"], 2), ("items[1]", ["items[1]"], 2), ("items[2]", ["items[2]"], 2), ("root", ["root"], 1)]
    records = spark.createDataFrame([("r1", "f", '{"path": "a/b", "x": [{"path": "c/d"}]}'), ("r2", "g", '{"path": "a/b"}')], "repository string, path string, record string")
    assert [tuple(r) for r in catalog.path_references(records).collect()] == [("r1", "a/b", "f"), ("r1", "c/d", "f"), ("r2", "a/b", "g")]
    with pytest.raises(Exception, match="no repository"):
        catalog.path_references(records.withColumn("repository", F.lit(None).cast("string"))).collect()
    ids = spark.createDataFrame([("x", "b.yaml"), ("x", "a.yaml"), ("y", "a.yaml"), ("x", "c.yaml"), (None, "d")], "id string, path string")
    assert [tuple(r) for r in catalog.repeated_ids(ids).collect()] == [("x", "a.yaml", "b.yaml"), ("x", "a.yaml", "c.yaml")]


def test_every_row_of_a_header_counts(spark):
    groups = spark.createDataFrame([("g1", ["a", "b"])], "id string, symbols array<string>")
    header = spark.createDataFrame([("int a(void);",), ("int b(void);",)], "text string")
    assert catalog.symbol_entries(groups, ["g1"], header).count() == 2
