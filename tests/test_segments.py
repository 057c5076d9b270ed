"""The segmented index against fresh indexes over the live documents."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lexical
from corpusloom.plans.files import listed_files
from corpusloom.plans.segments import SegmentedIndex

WORDS = "alpha beta gamma delta eps zeta eta".split()


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string, lang string")


def rows_of(first, n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 25))) or None, rng.choice("ab")) for i in range(first, first + n)]


def found(view, terms=("alpha", "zeta")):
    return sorted(map(tuple, lexical.scored_index(view, "id", "text", list(terms)).collect()))


def fresh(spark, path, live):
    lexical.write_index(table(spark, live), "id", ["text"], path)
    index = lexical.open_index(spark, path)
    return found(index), sorted((r["field"], r["term"], r["df"], r["occurrences"]) for r in index.terms.collect())


def dictionary(index):
    return sorted((r["field"], r["term"], r["df"], r["occurrences"]) for r in index.terms().collect())


def test_appends_deletions_and_merges_equal_a_fresh_index(spark, tmp_path):
    root = str(tmp_path / "index")
    index = SegmentedIndex(spark, root, "id", ("text",), ("lang",), most=2)
    live = {r[0]: r for r in rows_of(0, 40, 1)}
    index.change(table(spark, list(live.values())))
    first = listed_files(spark, f"{root}/segments")
    more = rows_of(40, 20, 2)
    live |= {r[0]: r for r in more}
    index.change(table(spark, more))
    assert found(index.view()) == fresh(spark, str(tmp_path / "f1"), list(live.values()))[0]
    assert set(first) < set(listed_files(spark, f"{root}/segments"))  # the older segment's files are untouched

    new = [(3, "alpha only here unique", "a"), (70, "zeta", "b")]
    gone = [5, 6, 41, 999]
    live |= {r[0]: r for r in new}
    for k in gone:
        live.pop(k, None)
    index.change(table(spark, new), spark.createDataFrame([(k,) for k in gone], "id bigint"))
    assert len(index.state()["segments"]) == 2  # three, of which the two smallest were merged
    assert found(index.view()) == fresh(spark, str(tmp_path / "f2"), list(live.values()))[0]
    assert dictionary(index) == fresh(spark, str(tmp_path / "f3"), list(live.values()))[1]
    assert set(first) < set(listed_files(spark, f"{root}/segments"))

    index.change(removed=spark.createDataFrame([(3,)], "id bigint"))
    live.pop(3)
    assert "unique" not in {r[1] for r in dictionary(index)}
    assert dictionary(index) == fresh(spark, str(tmp_path / "f4"), list(live.values()))[1]
    assert sum(index.state()["segments"].values()) == len(live)

    again = SegmentedIndex(spark, root)  # another reader
    again.merge(list(again.state()["segments"]))
    again.vacuum()
    assert len({f[0].split("/segments/")[1].split("/")[0] for f in listed_files(spark, f"{root}/segments")}) == 1
    assert found(again.view()) == fresh(spark, str(tmp_path / "f5"), list(live.values()))[0]


def test_filters_stand_in_the_scan(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"), "id", ("text",), ("lang",))
    live = rows_of(0, 60, 3)
    index.change(table(spark, live[:30]))
    index.change(table(spark, live[30:]))
    index.change(removed=spark.createDataFrame([(7,), (31,)], "id bigint"))
    view = index.view(F.col("lang") == "a")
    left = [r for r in live if r[0] not in (7, 31) and r[2] == "a"]
    scan = lexical.scored(table(spark, left), "id", "text", ["alpha", "zeta"]).where("coverage > 0").select("id", "coverage", "score")
    assert found(view) == sorted(map(tuple, scan.collect()))
    plan = lexical.scored_index(view, "id", "text", ["alpha"])._jdf.queryExecution().toString()
    assert "EqualTo(lang,a)" in plan and "EqualTo(term,alpha)" in plan


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"), "id", ("text",))
    state = index.state()
    index.change(spark.createDataFrame([(1, "alpha")], "id bigint, text string"))
    with pytest.raises(Exception):
        index._publish(state | {"version": 1})


def test_a_term_in_every_row_is_in_many_files(spark, tmp_path):
    rows = [(i, "common " + " ".join(f"w{i}x{j}" for j in range(3))) for i in range(4000)]
    path = str(tmp_path / "index")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        lexical.write_index(spark.createDataFrame(rows, "id bigint, text string"), "id", ["text"], path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    posted = spark.read.parquet(f"{path}/postings")
    sizes = [r["count"] for r in posted.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert posted.where("term = 'common'").select(F.input_file_name()).distinct().count() >= 2


def test_postings_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b a", None), (2, None, "c")], "id int, text string, title string")
    made = lexical.postings(docs, "id", ["text", "title"])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["field"], r["term"], r["id"], r["tf"], r["length"]) for r in made.collect()) == [("text", "a", 1, 2, 3), ("text", "b", 1, 1, 3), ("title", "c", 2, 1, 1)]


def test_the_service_takes_filters_into_the_index(spark, tmp_path):
    from corpusloom.plans import search

    rng = random.Random(8)
    rows = [(f"c{i:02d}", f"d{i // 2}", i % 2, " ".join(rng.choice(WORDS) for _ in range(12)), f"x{i}", f"p{i // 2}", rng.choice(["v1", "v2"]), rng.choice(["r1", "r2"])) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, ordinal int, text string, content_digest string, path string, revision string, repository string")
    index = SegmentedIndex(spark, str(tmp_path / "index"), "chunk_id", ("text",), ("repository", "revision"))
    index.change(chunks.where("ordinal = 0").select("chunk_id", "text", "repository", "revision"))
    index.change(chunks.where("ordinal = 1").select("chunk_id", "text", "repository", "revision"))
    for filters in ({}, {"repository": "r1"}, {"repository": "r2", "revision": "v1"}, {"repository": "r1", "paths": ["p1", "p2", "p3"]}):
        request = search.Request("alpha zeta gamma", limit=8, filters=filters)
        plain, served = (search.search(chunks, request, index=i)[0].collect() for i in (None, index))
        if "paths" in filters:  # what the index doesn't know is filtered afterwards: the same rows, with scores by the index's statistics
            assert {r["chunk_id"] for r in plain} == {r["chunk_id"] for r in served}
        else:
            assert plain == served and plain


def test_an_index_sorts_its_rows_once(spark, tmp_path, monkeypatch):
    """Only postings are dealt out with all rows; what the occurrences were written to is the documents' table itself."""
    frame, dealt = type(spark.range(1)), []
    real = frame.repartitionByRange

    def seen(self, *columns):
        dealt.append((columns, set(self.columns)))
        return real(self, *columns)

    monkeypatch.setattr(frame, "repartitionByRange", seen)
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "b a b"), (2, "a"), (3, "")], "id bigint, text string")
    lexical.write_index(docs, "id", ["text"], path)
    assert [columns for columns, names in dealt if "tf" in names] == [("term", "id")]
    held = spark.read.parquet(f"{path}/documents")
    assert sorted((r["id"], r["term"] or "", r["tf"], r["length"]) for r in held.collect()) == [(1, "", 0, 3), (1, "a", 1, 3), (1, "b", 2, 3), (2, "", 0, 1), (2, "a", 1, 1), (3, "", 0, 0)]
    assert [tuple(r) for r in spark.read.parquet(f"{path}/terms").select("term", "df", "occurrences").orderBy("term").collect()] == [("a", 2, 2), ("b", 1, 2)]
