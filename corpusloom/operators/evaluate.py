"""Retrieval metrics, gates, samples and profile comparison: joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.ranking import with_place

#: What a release must reach.
GATE = {"recall_at_5": 0.90, "mrr_at_10": 0.80, "ndcg_at_10": 0.80, "exact_identifier_top_one": 1.0}
MEANS = ("recall_at_5", "mrr_at_10", "ndcg_at_10")


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + F.lit(1.0))


def query_metrics(run: DataFrame, qrels: DataFrame, queries: DataFrame, identifier: Column | None = None) -> DataFrame:
    """Per query of queries (query_id, …): recall_at_5, mrr_at_10, ndcg_at_10 of run (query_id, id, rank) by qrels (query_id, id, grade).

    Also whether it has no result, whether it asks for an identifier (a condition on queries), and if so whether its first result has grade 2.
    """
    asks = F.coalesce(identifier, F.lit(False)) if identifier is not None else F.lit(False)
    judged = run.join(qrels, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.count_if((F.col("rank") <= 5) & (F.col("grade") > 0)).alias("hits"),
        F.min(F.when((F.col("grade") > 0) & (F.col("rank") <= 10), F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("rank") <= 10) & (F.col("grade") > 0), _gain(F.col("grade"), F.col("rank")))).alias("dcg"),
        F.count("*").alias("results"), F.count_if((F.col("rank") == 1) & (F.col("grade") == 2)).alias("best"),
    )
    place = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = qrels.where("grade > 0").withColumn("rank", F.row_number().over(place)).groupBy("query_id").agg(
        F.count("*").alias("relevant"), F.sum(F.when(F.col("rank") <= 10, _gain(F.col("grade"), F.col("rank")))).alias("idcg")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return queries.join(judged, "query_id", "left").join(ideal, "query_id", "left").select(
        *queries.columns,
        F.round(zero(F.col("hits") / F.col("relevant")), 6).alias("recall_at_5"),
        F.round(zero(F.lit(1.0) / F.col("first")), 6).alias("mrr_at_10"),
        F.round(zero(F.col("dcg") / F.col("idcg")), 6).alias("ndcg_at_10"),
        F.coalesce("results", F.lit(0)).alias("results"),
        (F.coalesce("results", F.lit(0)) == 0).alias("zero_result"),
        asks.alias("identifier_query"),
        (asks & (F.coalesce("best", F.lit(0)) > 0)).alias("top_one_exact"),
    )


def duplicate_rate(run: DataFrame, document: str, k: int = 5) -> DataFrame:
    top = run.where(F.col("rank") <= k).groupBy("query_id").agg((F.countDistinct(F.coalesce(F.col(document).cast("string"), F.col("id").cast("string"))) / F.count("*")).alias("_d"))
    return top.select("query_id", F.round(1 - F.col("_d"), 6).alias("duplicate_rate"), F.round("_d", 6).alias("diversity"))


def grouped_metrics(metrics: DataFrame, dimensions: list[str]) -> DataFrame:
    """Means (and sums in millionths, which don't depend on the order of rows) for each value of each dimension, in one pass of grouping sets."""
    sets = ", ".join(f"({d})" for d in dimensions)
    spark = metrics.sparkSession
    means = ", ".join(f"round(avg({m}), 6) as {m}, cast(sum(round({m} * 1000000)) as bigint) as {m}_sum" for m in MEANS)
    labels = ", ".join(f"coalesce(cast({d} as string), 'unknown') as {d}" for d in dimensions)
    kind = "case " + " ".join(f"when grouping({d}) = 0 then '{d}'" for d in dimensions) + " end"
    return spark.sql(
        f"select {kind} as dimension, coalesce({', '.join(dimensions)}) as value, count(*) as queries, {means} from (select {labels}, {', '.join(MEANS)} from {{m}}) group by grouping sets ({sets})",
        m=metrics,
    )


def suite_means(metrics: DataFrame) -> DataFrame:
    """One row: queries, the means over them, the share without a result, and over identifier queries the share whose first result is exact (0 without any)."""
    share = lambda c: F.avg(c.cast("double"))
    found = [share(F.col(m)).alias(m) for m in MEANS]
    exact = share(F.when(F.col("identifier_query"), F.col("top_one_exact").cast("int"))).alias("exact_identifier_top_one")
    row = metrics.agg(F.count("*").alias("queries"), F.count_if("identifier_query").alias("identifier_queries"), *found, share(F.col("zero_result").cast("int")).alias("zero_result_rate"), exact)
    return row.fillna(0.0)


def gate(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """metric, actual, required, passed over all queries; a suite passes if every row does."""
    wanted = thresholds or GATE
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m), 6).alias("actual"), F.lit(v).alias("required")) for m, v in wanted.items()])
    return suite_means(metrics).select(F.explode(rows).alias("x")).select("x.*").withColumn("passed", F.col("actual") >= F.col("required"))


def regressions(metrics: DataFrame) -> DataFrame:
    """The queries that a failed gate is to be explained by: without a result, or identifier queries whose first result isn't exact."""
    return metrics.where(F.col("zero_result") | (F.col("identifier_query") & ~F.col("top_one_exact")))


def suite_problems(queries: DataFrame, qrels: DataFrame, ids: DataFrame, categories: list[str], prefix: str = "", most_grade: int = 2) -> DataFrame:
    """(problem, query_id, id): everything that makes a suite unfit for a corpus; a sound one gives no rows.

    queries (query_id, text, failure_category), qrels (query_id, id, grade), ids (id) of the corpus. Each kind of error is
    found by itself: empty_suite; empty_query_id, repeated_query_id, empty_text, no_category, unknown_category, no_judgments of
    queries; unknown_query, foreign_id (without the prefix), unknown_id, bad_grade of judgments; missing_category of the suite.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    none = F.lit(None).cast("string")
    q, j = F.col("query_id").cast("string").alias("query_id"), F.col("id").cast("string").alias("id")

    def rows(df: DataFrame, problem: str, query: Column, other: Column) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), query.alias("query_id"), other.alias("id"))

    known = F.col("failure_category").isin(categories)
    wanted = queries.sparkSession.createDataFrame([(c,) for c in categories], "id string")
    named = queries.select(F.col("failure_category").alias("id")).distinct()
    parts = [
        rows(queries.agg(F.count("*").alias("n")).where("n = 0"), "empty_suite", none, none),
        rows(queries.where(blank("query_id")), "empty_query_id", q, none),
        rows(queries.where(~blank("query_id")).groupBy("query_id").count().where("count > 1"), "repeated_query_id", q, none),
        rows(queries.where(blank("text")), "empty_text", q, none),
        rows(queries.where(F.col("failure_category").isNull()), "no_category", q, none),
        rows(queries.where(~known), "unknown_category", q, F.col("failure_category")),
        rows(wanted.join(named, "id", "left_anti"), "missing_category", none, F.col("id")),
        rows(queries.join(qrels.select("query_id").distinct(), "query_id", "left_anti"), "no_judgments", q, none),
        rows(qrels.join(queries.select("query_id").distinct(), "query_id", "left_anti"), "unknown_query", q, j),
        rows(qrels.where(~F.startswith(F.col("id").cast("string"), F.lit(prefix))), "foreign_id", q, j),
        rows(unknown_judgments(qrels, ids), "unknown_id", q, j),
        rows(qrels.where((F.col("grade") > most_grade) | (F.col("grade") < 0) | F.col("grade").isNull()), "bad_grade", q, j),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def percentiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(share * n) of the sorted column."""
    aggregates = [F.expr(f"percentile_disc({p}) within group (order by {value})").cast("bigint").alias(n) for n, p in shares.items()]
    return df.groupBy(*by).agg(F.count("*").alias("samples"), *aggregates)


def stratified(df: DataFrame, strata: list[str], order: list[str], n: int) -> DataFrame:
    """Round robin: each stratum's first row, then each one's second, up to n rows. No task keeps more than n rows of a stratum."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", *strata, *order).limit(n)


def judged_sample(df: DataFrame, key: str, judged: DataFrame, n: int) -> DataFrame:
    """All judged rows and evenly stepped others, n in all."""
    own = df.join(judged.select(key), key, "left_semi").withColumn("judged", F.lit(True))
    rest = df.join(judged.select(key), key, "left_anti")
    held, others = own.count(), rest.count()
    step = max(1, others // max(1, n - held))
    placed = with_place(rest.select(key), [F.asc(key)], "_p").withColumn("_p", F.col("_p") - 1)
    decoys = placed.where(F.col("_p") % step == 0).where(F.col("_p") / step < max(0, n - held))
    return own.unionByName(rest.join(decoys.select(key), key, "left_semi").withColumn("judged", F.lit(False)))


def profile_totals(frames: DataFrame, n: int, least: int = 0) -> DataFrame:
    """Samples a function, the n largest of at least `least`."""
    sums = frames.groupBy("function").agg(F.sum("samples").cast("bigint").alias("samples"))
    return sums.where(F.col("samples") >= least).orderBy(F.desc("samples"), "function").limit(n)


def profile_diff(before: DataFrame, after: DataFrame, least: float = 0.01) -> DataFrame:
    """Share of samples in either profile and its change, where that is at least `least` percent."""
    share = lambda d, name: d.groupBy("function").agg(F.sum("percent").alias(name))
    joined = share(before, "before").join(share(after, "after"), "function", "full_outer").fillna(0.0, ["before", "after"])
    delta = F.round(F.col("after") - F.col("before"), 6)
    return joined.select("function", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), delta.alias("delta")).where(F.abs("delta") >= least)


def self_and_inclusive(stacks: DataFrame) -> DataFrame:
    """stacks (frames leaf first): a leaf counts as self, each different frame of a stack once as inclusive."""
    leaf = stacks.select(F.element_at("frames", 1).alias("function")).groupBy("function").agg(F.count("*").alias("self_samples"))
    every = stacks.select(F.explode(F.array_distinct("frames")).alias("function")).groupBy("function").agg(F.count("*").alias("inclusive_samples"))
    return every.join(leaf, "function", "left").select("function", F.coalesce("self_samples", F.lit(0)).alias("self_samples"), "inclusive_samples")


def gold_matches(results: DataFrame, gold: DataFrame) -> DataFrame:
    """gold (gold_id, repository, prefix, required_terms) with the first result rank that fits repository, path prefix and all terms."""
    fits = F.startswith("path", F.col("prefix")) & F.forall("required_terms", lambda t: F.contains(F.lower("passage"), F.lower(t)))
    met = gold.join(results, "repository").where(fits).groupBy("gold_id").agg(F.min("rank").alias("rank"))
    return gold.select("gold_id").join(met, "gold_id", "left").select("gold_id", "rank", F.col("rank").isNotNull().alias("matched"))


def unknown_judgments(qrels: DataFrame, ids: DataFrame) -> DataFrame:
    """Judgments of ids that the corpus doesn't have: a sound suite has none."""
    return qrels.join(ids.select("id"), "id", "left_anti")


def combined_reports(reports: list[DataFrame], shared: list[str]) -> DataFrame:
    """Reports one after another; their shared fields must agree."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    same = out.agg(*[F.countDistinct(c).alias(c) for c in shared]).first()
    if any(same[c] > 1 for c in shared):
        raise ValueError("the reports' shared fields differ")
    return out


def evidence_counters(rows: DataFrame) -> DataFrame:
    """Per query: rows, rows with provenance, different paths, different and repeated contents."""
    return rows.groupBy("query_id").agg(
        F.count("*").alias("rows"), F.count("path").alias("with_provenance"), F.countDistinct("path").alias("paths"),
        F.countDistinct("content_digest").alias("contents"), (F.count("content_digest") - F.countDistinct("content_digest")).alias("repeated"),
    )


def path_metrics(evidence: DataFrame, facets: DataFrame) -> DataFrame:
    """One row: facet coverage, whether the path is complete, shares of evidence of a wrong era and of use, repeated contents and shortcuts.

    evidence: evidence_id, facet_id, verdict, content_key; a shortcut is a qualifying facet whose predecessor (facets: facet_id, after) has none.
    """
    total = facets.agg(F.count("*").alias("facets"))
    good = evidence.where("verdict = 'qualifying'").select("facet_id").distinct()
    met = facets.join(good.withColumn("_g", F.lit(1)), "facet_id", "left").join(good.select(F.col("facet_id").alias("after"), F.lit(1).alias("_p")), "after", "left")
    found = met.agg(F.count("_g").alias("covered"), F.count_if(F.col("_g").isNotNull() & F.col("after").isNotNull() & F.col("_p").isNull()).alias("shortcuts"))
    seen = evidence.agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "wrong_era").alias("wrong"), F.count_if(F.col("verdict") == "qualifying").alias("used"),
        (F.count("content_key") - F.countDistinct("content_key")).alias("repeated"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return total.crossJoin(found).crossJoin(seen).select(  # single rows
        share("covered", "facets").alias("facet_coverage"), (F.col("covered") == F.col("facets")).alias("complete"), share("wrong", "n").alias("wrong_era_rate"),
        share("used", "n").alias("utilisation"), share("repeated", "n").alias("duplicate_waste"), share("shortcuts", "facets").alias("shortcut_rate"),
    )


def suite(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries and judgments of a JSON suite file: a bare list, or an object with `queries`; relevant maps ids to grades."""
    schema = "id string, text string, intent string, failure_category string, relevant map<string,int>"
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    bare = F.ltrim("v").startswith("[")
    rows = text.select(F.explode(F.when(bare, F.from_json("v", f"array<struct<{_ddl(schema)}>>")).otherwise(F.from_json("v", f"struct<queries:array<struct<{_ddl(schema)}>>>")["queries"])).alias("q")).select("q.*")
    qrels = rows.select(F.col("id").alias("query_id"), F.explode("relevant").alias("id", "grade"))
    return rows.select(F.col("id").alias("query_id"), "text", "intent", "failure_category"), qrels


def _ddl(schema: str) -> str:
    """The inside of a struct from a column list: `name type` pairs as `name:type`; commas within brackets stay."""
    out, depth = "", 0
    expect = True
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == " " and expect and depth == 0 and out and not out.endswith(","):
            out, expect = out + ":", False
            continue
        if c == "," and depth == 0:
            expect = True
        if not (c == " " and (not out or out.endswith(","))):
            out += c
    return out
