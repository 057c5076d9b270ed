"""Admission against a loop over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import budget
from corpusloom.operators.budget import Budget, Sizes, admitted, passed


def loop(rows, limits):
    """id -> verdict for (id, grp, size) in order of grp and id."""
    out, states = {}, {}
    for i, g, size in sorted(rows, key=lambda r: (r[1], r[0])):
        n, used = states.get(g, (0, 0))
        out[i] = limits.verdict(size or 0, n, used)
        if out[i] == "ok":
            states[g] = (n + 1, used + (size or 0))
    return out


@pytest.mark.parametrize(("seed", "limits"), [(1, Budget(900, 400, 30_000)), (2, Budget(5000, 10_000, 20_000)), (3, Budget(300, 50, 10**9)), (4, Budget(2000, 10_000, 400_000))])
def test_equals_a_loop_over_many_ranges(spark, seed, limits):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaaab") if i % 9 else f"g{i}", rng.choice([None, 0, 1, rng.randrange(50), rng.randrange(1000), rng.randrange(4000)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, grp string, size bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {r["id"]: r["verdict"] for r in admitted(df.repartition(5), F.col("size"), [F.col("id")], limits, F.col("grp")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found == loop(rows, limits)


def test_later_rows_that_fit_are_admitted(spark):
    rows = spark.createDataFrame([(1, 50), (2, 200), (3, 40)], "id int, size int")
    found = admitted(rows, F.col("size"), [F.col("id")], Budget(1000, 10, 100)).orderBy("id").collect()
    assert [r["verdict"] for r in found] == ["ok", "total_bytes", "ok"]


def test_few_ranges_are_read_on_the_way(spark, monkeypatch):
    read = []
    stream = budget._streamed
    monkeypatch.setattr(budget, "_streamed", lambda *a: read.append(a[2]) or stream(*a))
    rng = random.Random(7)
    rows = [(i, "all", rng.randrange(1, 1000)) for i in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        limits = Budget(1000, 10**6, 400_000)
        found = {r["id"]: r["verdict"] for r in admitted(spark.createDataFrame(rows, "id bigint, grp string, size bigint"), F.col("size"), [F.col("id")], limits, F.col("grp")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found == loop(rows, limits)
    assert len(read) <= 8  # the others are settled by their sums


def test_ranges_by_their_sizes():
    limits = Budget(100, 10, 100)
    assert passed(limits, [Sizes(2, 30, 10, 20)], 1, 50) == (3, 80)
    assert passed(limits, [Sizes(2, 130, 60, 70)], 1, 50) == (1, 50)
    assert passed(limits, [Sizes(2, 30, 10, 20), Sizes(1, 60, 60, 60)], 0, 50) == (2, 80)
    assert passed(limits, [Sizes(2, 60, 25, 35)], 0, 50) is None
    assert passed(limits, [Sizes(2, 2, 1, 1)], 9, 0) is None
    assert passed(limits, [Sizes(2, 2, 1, 1)], 10, 0) == (10, 0)
