import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import ids, text
from corpusloom.operators import documents


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_identity_recipes(spark):
    """Documented ids of one document and one of its chunks, with a domain other than the default."""
    import hashlib

    def lp(v):
        return len(v.encode()).to_bytes(8, "big") + v.encode()

    digest = "sha256:" + hashlib.sha256(b"content").hexdigest()
    want = "doc-" + hashlib.sha256(b"d/document/v1" + b"".join(map(lp, ("r", "abc", "docs/x.md", digest)))).hexdigest()
    got = one(spark, ids.document_id(F.lit("r"), F.lit("abc"), F.lit("docs/x.md"), ids.content_digest(F.lit("content")), "d"))
    assert got == want
    chunk = "chunk-" + hashlib.sha256(b"d/chunk/v1" + b"".join(map(lp, (want, "7", "a/b", digest)))).hexdigest()
    assert one(spark, ids.chunk_id(F.lit(want), F.lit(7), F.array(F.lit("a"), F.lit("b")), ids.content_digest(F.lit("content")), "d")) == chunk
    assert one(spark, ids.is_typed_id(F.lit(chunk), "chunk-")) and not one(spark, ids.is_typed_id(F.lit(chunk.upper()), "chunk-"))


def test_node_id(spark):
    import hashlib

    fields = b"".join(len(v).to_bytes(8, "little") + v.encode() for v in ("r", "v", "p", "t#0", "chunk"))
    span = b"".join(n.to_bytes(4, "little") for n in (1, 2, 0, 300))
    want = hashlib.sha256(b"d-graph-node-v1\0" + fields + span).hexdigest()
    assert one(spark, ids.node_id(*map(F.lit, ("r", "v", "p", "t#0", "chunk")), [F.lit(n) for n in (1, 2, 0, 300)], "d")) == want


@pytest.mark.parametrize("query", ["Write_NVM read-only data", "__ -- ", "a_b-c persistent Paths", "", "transport custom custom"])
def test_columns_agree_with_their_twins(spark, query):
    assert one(spark, text.raw_terms(F.col("q")), q=query) == text.raw_terms_of(query)
    assert one(spark, text.symbol_terms(F.col("q")), q=query) == text.symbol_terms_of(query)
    assert one(spark, text.expanded_terms(F.col("q")), q=query) == text.expanded_terms_of(query)


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 7, 100])
def test_truncated_utf8(spark, limit):
    value = "aé中🎉z"
    assert one(spark, text.truncated_utf8(F.col("v"), limit), v=value) == value.encode()[:limit].decode(errors="ignore")


def test_excerpts_and_anchors(spark):
    body = "x" * 600 + " set_value " + "y" * 600
    at = one(spark, text.symbol_anchor(F.col("b"), F.array(F.lit("set_value"))), b=body)
    assert at == 602
    cut = one(spark, text.excerpt(F.col("b"), F.lit(at)), b=body)
    assert "set_value" in cut and cut.startswith("…") and len(cut.encode()) <= 384
    assert one(spark, text.symbol_anchor(F.col("b"), F.array().cast("array<string>")), b="plain my_name") == 7
    assert one(spark, text.symbol_anchor(F.col("b"), F.array(F.lit("et_v"))), b="set_value") == 1


def test_small_text_functions(spark):
    lit = F.lit
    assert one(spark, text.release_numbers(lit("release_6_05"))) == [6, 5]
    assert one(spark, text.release_numbers(lit("v1.10"))) == [1, 10] and one(spark, text.release_numbers(lit("main"))) is None
    assert one(spark, text.safe_name(lit("a b/c"))) == "a-b-c"
    assert one(spark, text.percent_encoded(lit("a b/ü~*+"))) == "a%20b/%C3%BC~%2A%2B"
    assert one(spark, text.percent_decoded(lit("a%20b+c"))) == "a b+c"
    assert one(spark, text.warning_code(lit(" code: rest"))) == "code"
    assert one(spark, text.normalised_list(F.array(lit(" b"), lit("a"), lit("b ")))) == ["a", "b"]
    assert one(spark, text.remote_identity(lit("https://me:pw@host/x.git"))) == "https://host/x"
    assert one(spark, text.attribution(lit("r"), lit("p"), lit(3))) == "r:p:3"
    assert one(spark, text.morphology(lit("Persistence hence evidence"))) == ["Persist", "evid"]
    assert one(spark, text.function_category(lit("Alloc::grow"), [("memory", ["alloc"]), ("io", ["read"])])) == "memory"
    assert one(spark, text.semantic_query(lit("Encoding x"), [(["encod"], "A"), (["zzz"], "B")])) == "Encoding x\nConcept aliases: A"
    assert one(spark, text.file_stem(lit("a/b.tar.gz"))) == "b.tar" and one(spark, text.file_stem(lit("a/.hidden"))) == ".hidden"


def test_embedding_text(spark):
    made = text.embedding_text(F.lit("T"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"), F.lit("y")), F.array().cast("array<string>"), F.lit("body"), {"y": "why"})
    assert one(spark, made) == "Title: T\nHeadings: a / b\nIdentifiers: x, y\nConcepts: why\nContent: body"


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.md", "a/b.md", True), ("a/*", "a/b/c", False), ("a/**", "a/b/c", True), ("**/c", "c", True), ("**/c", "a/b/c", True), ("a?c", "abc", True), ("a/?", "a/", False), ("docs/**/x", "docs/x", True)],
)
def test_globs(spark, pattern, path, hit):
    assert one(spark, documents.matches_glob(F.lit(path), pattern)) == hit


@pytest.mark.parametrize("pattern", ["", "/a", "a/../b", "a[b]", "a\\b", "a**", "**b"])
def test_refused_globs(pattern):
    with pytest.raises(ValueError):
        documents.glob_regex(pattern)


def test_invalid_documents_fail(spark):
    row = spark.createDataFrame([("t", "../x")], "t string, p string")
    with pytest.raises(Exception, match="relative path"):
        documents.document(row, F.col("t"), F.lit("r"), F.lit("v"), F.col("p"), F.lit("c")).collect()


def test_crc_is_the_public_one(spark):
    assert one(spark, F.crc32(F.lit(17).cast("string"))) == zlib.crc32(b"17")


def test_identifiers_read_a_text_once(spark):
    rows = spark.createDataFrame([("a/b.txt", "foo Bar_1 xx foo é_é9ab A" + "b" * 127 + " A" + "b" * 128 + " 9ab _ab ab_ Bar_1"), ("c", None)], "path string, content string")
    found = rows.select(text.identifiers(F.col("path"), F.col("content")).alias("x"))
    assert [r["x"] for r in found.collect()] == [sorted(["a/b.txt", "b", "foo", "Bar_1", "A" + "b" * 127, "ab_"]), None]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(content") == 1 and "split(content" not in plan
