"""Lexical retrieval: postings, BM25, boolean rules, coverage and the final order.

Two physical ways with one result: over texts (two narrow aggregates, then a top-k without any shuffle of
texts), and over a postings table, where only the rows of the query's terms are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T

K1, B = 1.2, 0.75


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


#: Rows of (query_id, term) that may be sent to all tasks; larger batches meet the tokens in a shuffle.
TERM_ROWS = 100_000
#: Winners that may be sent to all tasks.
PAGE_ROWS = 1000


def term_score(tf: Column, length: Column, mean: Column, idf: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (F.lit(1.0 - B) + B * length / mean))


@dataclass(frozen=True)
class Index:
    """What a search reads: postings (field, term, <key>, tf, length), fields (field, documents, mean) and terms (field, term, df).

    Without terms, document frequencies are counted in the postings: for views that a filter cuts before statistics.
    """

    postings: DataFrame
    fields: DataFrame
    terms: DataFrame | None = None

    def of(self, terms: list[str], field: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The postings of some terms and their (field, term, df): the conditions are constants, which prune files and row groups."""
        hit = F.col("term").isin(terms)
        if field is not None:
            hit = hit & (F.col("field") == field)
        found = self.postings.where(hit)
        return found, found.groupBy("field", "term").agg(F.count("*").alias("df")) if self.terms is None else self.terms.where(hit).select("field", "term", "df")


#: Tokens that are counted at a time.
TOKENS_AT_ONCE = 500_000


def occurrences(docs: DataFrame, key: str, fields: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """(<key>, <carry>, field, term, tf, length): each row's terms with their counts, and one row for each field with no term and its length.

    Terms are counted within their row, in Arrow batches: nothing is shuffled.
    """
    each = docs.select(key, *carry, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), T.tokens(F.col(f)).alias("terms")) for f in fields])).alias("x"))
    each = each.select(key, *carry, "x.field", "x.terms")
    schema = each.drop("terms").schema.add("term", "string").add("tf", "long").add("length", "integer")
    names = [key, *carry, "field"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False)
            reach, start = np.cumsum(sizes), 0
            while start < len(batch):
                before = reach[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(reach, before + TOKENS_AT_ONCE, "right")))
                part, length = batch.slice(start, end - start), sizes[start:end].astype(np.int32)
                start = end
                coded = part.column("terms").flatten().dictionary_encode()
                many = max(1, len(coded.dictionary))
                pair, tf = np.unique(np.repeat(np.arange(len(part)), length) * many + coded.indices.to_numpy(), return_counts=True)
                row = np.r_[pair // many, np.arange(len(part))]
                terms = pa.concat_arrays([coded.dictionary.take(pa.array(pair % many)), pa.nulls(len(part), coded.dictionary.type)])
                columns = [part.column(n).take(pa.array(row)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(np.r_[tf, np.zeros(len(part), np.int64)]), pa.array(length[row])], names=schema.names)

    return each.mapInArrow(run, schema)


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, term, <key>, tf, length), without a shuffle."""
    return occurrences(docs, key, fields).where(F.col("term").isNotNull()).select("field", "term", key, "length", "tf")


def query_postings(docs: DataFrame, key: str, field: str, terms: DataFrame) -> DataFrame:
    """Postings of one field for the terms (query_id, term) alone: other tokens are gone before anything is shuffled."""
    rows = docs.select(key, T.tokens(F.col(field)).alias("_t")).select(key, F.size("_t").alias("length"), F.explode("_t").alias("term"))
    sent = terms.limit(TERM_ROWS + 1).count() <= TERM_ROWS
    met = rows.join(F.broadcast(terms) if sent else terms, "term")
    return met.groupBy("query_id", "term", key, "length").agg(F.count("*").alias("tf")).withColumn("field", F.lit(field))


def write_index(docs: DataFrame, key: str, fields: list[str], path: str, carry: tuple[str, ...] = ()) -> None:
    """An index of the fields below `path`; write_rows says what it holds. Texts are tokenised once."""
    occurrences(docs, key, fields, carry).write.parquet(f"{path}/documents", mode="overwrite")
    write_rows(docs.sparkSession, key, path, carry)


def write_rows(spark: SparkSession, key: str, path: str, carry: tuple[str, ...] = ()) -> None:
    """The other tables of an index whose occurrences are written to {path}/documents, in whatever order; these stay as they are.

    postings: in the order of term and key, dealt out by ranges of both, so that a frequent term's list is in many files
    and a query's terms prune the rest. terms: the dictionary with document frequencies, in order, counted in the postings,
    where a term's rows stand together: a task sends on about a row for each of its terms. fields: documents and tokens of
    each field for each combination of the carried columns. Only the postings' sort moves all rows.
    """
    rows = spark.read.parquet(f"{path}/documents")
    rows.where(F.col("term").isNotNull()).repartitionByRange("term", key).sortWithinPartitions("term", "field", key).write.parquet(f"{path}/postings", mode="overwrite")
    counts = spark.read.parquet(f"{path}/postings").groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
    counts.repartitionByRange("term", "field").sortWithinPartitions("term", "field").write.parquet(f"{path}/terms", mode="overwrite")
    field_totals(rows, carry).write.parquet(f"{path}/fields", mode="overwrite")


def field_totals(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    ends = rows.where(F.col("term").isNull())
    return ends.groupBy(*carry, "field").agg(F.count("*").alias("documents"), F.sum("length").cast("bigint").alias("tokens"))


def mean_lengths(totals: DataFrame) -> DataFrame:
    """(field, documents, mean) of field_totals, whatever they carry."""
    rows = totals.groupBy("field").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return rows.select("field", "documents", (F.col("tokens") / F.col("documents")).alias("mean"))


def open_index(spark, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), mean_lengths(spark.read.parquet(f"{path}/fields")), spark.read.parquet(f"{path}/terms"))


def search_index(index: Index, key: str, queries: DataFrame, limit: int) -> DataFrame:
    """queries (query_id, query) against an index with terms: each query's best rows.

    Frequencies come from the dictionary; the queries' terms with these are sent to the postings when they are few, and else meet them in a shuffle.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
    few = terms.limit(TERM_ROWS + 1).count() <= TERM_ROWS
    asked = index.terms.join(F.broadcast(terms) if few else terms, "term").join(F.broadcast(index.fields), "field").select("query_id", "field", "term", "df", "documents", "mean")
    scored = index.postings.join(F.broadcast(asked) if few else asked, ["field", "term"])
    score = term_score(F.col("tf"), F.col("length"), F.col("mean"), inverse_frequency(F.col("documents"), F.col("df")))
    each = scored.groupBy("query_id", key).agg(F.sum(score).alias("score"), F.countDistinct("term").alias("coverage"))
    order = Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc(F.round("score", 6)), key)
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def scored(docs: DataFrame, key: str, field: str, terms: list[str]) -> DataFrame:
    """docs with coverage (how many of the terms occur) and the BM25 score of the terms in one field; a null text is empty.

    Term counts are taken from each row's own tokens; lengths and document frequencies are one global
    aggregate, which joins back as a single row.
    """
    found = T.tokens(F.col(field))
    counts = F.array(*[F.size(F.filter(F.col("_tokens"), _equals(x))) for x in terms])
    rows = docs.withColumn("_tokens", found).withColumn("_tf", counts).withColumn("_length", F.coalesce(F.size("_tokens"), F.lit(0))).drop("_tokens")
    stats = rows.agg(
        F.count("*").alias("_n"), F.avg("_length").alias("_mean"), F.array(*[F.count_if(F.col("_tf")[i] > 0) for i in range(len(terms))]).alias("_df")
    )
    score = F.lit(0.0)
    coverage = F.lit(0)
    for i in range(len(terms)):
        score = score + term_score(F.col("_tf")[i], F.col("_length"), F.col("_mean"), inverse_frequency(F.col("_n"), F.col("_df")[i]))
        coverage = coverage + (F.col("_tf")[i] > 0).cast("int")
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    return joined.select(*docs.columns, coverage.alias("coverage"), F.round(score, 6).alias("score"))


def _equals(term: str):
    return lambda t: t == F.lit(term)


def scored_index(index: Index, key: str, field: str, terms: list[str]) -> DataFrame:
    """(key, coverage, score) of what has any of the terms: equal to scored() over the same rows, without their texts."""
    found, frequencies = index.of(terms, field)
    fields = index.fields.where(F.col("field") == field).select(F.col("documents").alias("_n"), F.col("mean").alias("_mean"))
    df = frequencies.agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("df"))), F.lit(0)).alias(f"_d{i}") for i, t in enumerate(terms)])
    rows = found.groupBy(key).agg(F.max("length").alias("_length"), *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"_f{i}") for i, t in enumerate(terms)])
    score, coverage = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        score = score + term_score(F.col(f"_f{i}"), F.col("_length"), F.col("_mean"), inverse_frequency(F.col("_n"), F.col(f"_d{i}")))
        coverage = coverage + (F.col(f"_f{i}") > 0).cast("int")
    joined = rows.crossJoin(F.broadcast(fields.crossJoin(df)))  # one row
    return joined.select(key, coverage.alias("coverage"), F.round(score, 6).alias("score"))


def boolean_terms(query: str, aliases: dict[str, list[str]] | None = None) -> tuple[list[str], list[str]]:
    """(asked, more): the tokens of the query's own terms, and those that only its expansions have."""
    asked = query_terms(query)
    wide = dict.fromkeys(p for t in T.expanded_terms_of(query, aliases) for p in T.tokens_of(t))
    return asked, [t for t in wide if t not in asked]


def boolean_index(index: Index, key: str, query: str, limit: int, aliases: dict[str, list[str]] | None = None, exact: DataFrame | None = None) -> DataFrame:
    """(key, coverage, score) of the best `limit` rows over all fields of an index; each term scores in every field that has it.

    With one or two terms all tokens that were asked for must occur, in whatever field; with more any will do. Expansions
    add to the score alone. exact: keys (distinct) whose identifier equals the whole query, which match in any case. What is
    sent to all tasks has a row a field and term.
    """
    asked, more = boolean_terms(query, aliases)
    found, frequencies = index.of([*asked, *more])
    sizes = frequencies.join(F.broadcast(index.fields), "field")
    met = found.join(F.broadcast(sizes), ["field", "term"])
    score = term_score(F.col("tf"), F.col("length"), F.col("mean"), inverse_frequency(F.col("documents"), F.col("df")))
    own = F.when(F.col("term").isin(asked), F.col("term"))
    rows = met.groupBy(key).agg(F.round(F.sum(score), 6).alias("score"), F.count_distinct(own).cast("int").alias("coverage"))
    enough = F.col("coverage") >= (len(asked) if len(T.raw_terms_of(query)) <= 2 else 0)
    if exact is not None:
        rows = rows.join(exact.select(key).withColumn("_exact", F.lit(True)), key, "full")
        rows = rows.select(key, F.coalesce("coverage", F.lit(0)).alias("coverage"), F.coalesce("score", F.lit(0.0)).alias("score"), "_exact")
        enough = enough | F.col("_exact").isNotNull()
    return rows.where(enough).select(key, "coverage", "score").orderBy(F.desc("score"), key).limit(limit)


def query_terms(query: str) -> list[str]:
    if not T.raw_terms_of(query):
        raise ValueError("the query has no terms")
    return list(dict.fromkeys(p for t in T.raw_terms_of(query) for p in T.tokens_of(t)))


def candidates(docs: DataFrame, key: str, field: str, query: str, limit: int, commits: Column | None = None) -> DataFrame:
    """passes() over texts."""
    return passes(scored(docs, key, field, query_terms(query)), key, query, limit, commits)


def passes(rows: DataFrame, key: str, query: str, limit: int, commits: Column | None = None) -> DataFrame:
    """Of scored rows the union of the passes: best scores, best without commit messages, best with all terms; the over-fetch is min(10 * limit, 100)."""
    raw, terms = T.raw_terms_of(query), query_terms(query)
    k = min(10 * limit, 100)
    rows = rows.where("coverage > 0")
    if len(raw) <= 2:
        rows = rows.where(F.col("coverage") == len(terms))
    best = lambda d: d.orderBy(F.desc("score"), key).limit(k)
    parts = [best(rows)]
    if commits is not None:
        parts.append(best(rows.where(~commits)))
    if len(raw) > 2:
        parts.append(best(rows.where(F.col("coverage") == len(terms))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([key])


def final_order(rows: DataFrame, key: str, limit: int, query: str, identifiers: str | None = None, registered: str | None = None, commit: str | None = None) -> DataFrame:
    """Exact identifiers first (registered ones before others), then coverage, commits last, score, key."""
    symbols = T.symbol_terms_of(query)
    exact = F.arrays_overlap(F.transform(F.col(identifiers), F.lower), F.array(*map(F.lit, symbols))) if identifiers and symbols else F.lit(False)
    known = F.col(registered).isNotNull() if registered else F.lit(False)
    last = F.col(commit) if commit else F.lit(False)
    ranked = rows.withColumn("exact_identifier", F.coalesce(exact, F.lit(False)))
    return ranked.orderBy(
        F.desc("exact_identifier"), F.desc(F.when(F.col("exact_identifier"), known).otherwise(F.lit(False))), F.desc("coverage"), last.cast("int"), F.desc("score"), key
    ).limit(limit)


def filtered(
    df: DataFrame, category: str | None = None, repository: str | None = None, paths: list[str] | None = None, revision: str | None = None,
    source_kind: str | None = None, trust_tier: str | None = None, tags: list[str] | None = None,
) -> DataFrame:
    """All given filters hold; applied before ranking, so a limit never hides a match."""
    for name, value in (("category", category), ("repository", repository), ("revision", revision), ("source_kind", source_kind), ("trust_tier", trust_tier)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if paths := [p for p in paths or [] if p.strip()]:
        df = df.where(F.col("path").isin(paths))
    if tags:
        if any(not t.strip() for t in tags):
            raise ValueError("a tag is blank")
        df = df.where(F.size(F.array_except(F.array(*[F.lit(t.lower()) for t in tags]), F.col("tags"))) == 0)
    return df


def hydrate(ranked: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Passages for the winners only: a result page is sent to the chunks, a longer list meets them in a shuffle."""
    page = ranked.limit(PAGE_ROWS + 1).count() <= PAGE_ROWS
    return chunks.join(F.broadcast(ranked) if page else ranked, key)
