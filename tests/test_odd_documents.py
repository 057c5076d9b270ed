"""The queries over the corpus on documents without a first line, text, language or source, held against their SQL."""

import duckdb
import pytest

import __spark_entry__

ROWS = [
    (1, "plain words Foo_bar x9 here", "en", "a"), (2, "\nfirst line blank Abc", "en", "a"), (3, "", "en", "b"), (4, "   ", "de", "b"), (5, None, "en", "a"), (6, None, "en", "a"),
    (7, "no lang Zed9", None, "a"), (8, "no source Quux_1", "fr", None), (9, "neither Bar_2 " * 400, None, "c"), (10, "this with that " * 300, "en", "a"), (11, " \n \nlate title", "en", "a"),
    (12, "same text", "en", "b"), (13, "same text", "fr", "b"), (14, "\r\nx crlf", "en", "b"), (15, "\n" + "w " * 3000, "en", "c"), (16, "neither Bar_3 " * 400, None, None),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("odd"))
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    rows.selectExpr("*", "cast(length(text) as bigint) as n_chars").coalesce(1).write.parquet(f"{where}/documents.parquet")
    return where


@pytest.mark.parametrize("name", ["chunk_bounded_split", "chunk_spans", "chunk_adjacency", "document_reassembly", "completeness_check", "identifier_extraction", "document_identity", "corpus_inventory", "exact_duplicate_groups", "content_keys"])
def test_equal_to_sql(spark, odd, name):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()[name]).fetchall()
    found = [tuple(r) for r in __spark_entry__.queries()[name](spark, odd).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_search_service_finds_all_documents(spark, odd):
    assert {r["path"] for r in __spark_entry__.queries()["search_service"](spark, odd).collect()} == {"en/10.txt"}


def test_budget_admission_of_null_texts_and_languages(spark, odd):
    found = {(r["grp"], r["path"], r["size"], r["verdict"]) for r in __spark_entry__.queries()["budget_admission"](spark, odd).collect() if r["grp"] == "a"}
    assert found == {("a", "en/1.txt", 27, "ok"), ("a", "en/2.txt", 21, "ok"), ("a", "en/10.txt", 4500, "ok"), ("a", "en/11.txt", 14, "ok"), ("a", None, 12, "ok")}
