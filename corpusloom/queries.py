"""The registered queries of the engine's own operators, and their DuckDB counterparts.

Each is a thin use of one or a few operators on the driver tables, or on small inline tables where those
have no such data. Both sides are cast to the same column types.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import ids
from corpusloom.functions import text as T
from corpusloom.operators import budget, chunking, documents, evaluate, fusion, graph, history, investigate, lexical, lookup, vectors
from corpusloom.operators.ranking import with_place
from corpusloom.plans import search, store
from corpusloom.plans.files import delete_path, listed_files
from corpusloom.sources import catalog
from corpusloom.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, columns: str, sql: str | None):
    """columns: `name:type …`, the result's columns on both sides."""
    spec = [c.split(":") for c in columns.split()]

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).select(*[F.col(c).cast(t).alias(c) for c, t in spec])

        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = f"select {', '.join(f'cast({c} as {_duck(t)}) as {c}' for c, t in spec)} from ({sql}) as q"
        return f

    return wrap


def _duck(kind: str) -> str:
    return {"string": "VARCHAR", "timestamp": "TIMESTAMP"}.get(kind, kind.upper())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, table: tuple[str, str]) -> DataFrame:
    return spark.sql(f"select * from values {table[1]} as v({table[0]})")


def duck(table: tuple[str, str]) -> str:
    return f"(select * from (values {table[1]}) as v({table[0]}))"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents as normalised ones, all of them: without a first line the path is the title, a null lang or source gets a stand-in."""
    d = read(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("lang", F.lit("und")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    title = F.coalesce(F.nullif(F.trim(F.substring_index("text", "\n", 1)), F.lit("")), path)
    return documents.document(d.select("doc_id", "lang", "source", F.col("text")), title, F.coalesce("source", F.lit("")), F.lit("v1"), path, F.col("text"))


def unless_null(value: Column, *columns: str) -> Column:
    """value, but null where one of the columns that it is made of is null: what SQL gives where corpus() has a stand-in."""
    return F.when(F.size(F.array_compact(F.array(*columns))) == len(columns), value)


_CORPUS = """(select doc_id, lang, source as repository, 'v1' as revision, lang || '/' || doc_id || '.txt' as path, text as content,
 'sha256:' || sha256(text) as content_digest from documents)"""
_LP = "unhex(lpad(to_hex(strlen({0})), 16, '0')) || encode({0})"


def _doc_id(r: str, v: str, p: str, d: str) -> str:
    return f"'doc-' || sha256(encode('corpusloom/document/v1') || {' || '.join(_LP.format(x) for x in (r, v, p, d))})"


_TOKENS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"

# --- lexical ----------------------------------------------------------------

TERMS = ["this", "with", "that"]

_INDEXES: dict[tuple[str, str, str], tuple[list, str]] = {}


def text_index(spark: SparkSession, sf_dir: str) -> str:
    """The path of a written index of the documents' texts: built when first asked for in a session, then read by every search."""
    return kept_index(spark, sf_dir, "text", lambda path: lexical.write_index(read(spark, sf_dir, "documents"), "doc_id", ["text"], path))


def kept_index(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None]) -> str:
    """The path of an index that `build` writes: kept as long as the documents' files are the same, and replaced when they have changed."""
    place, state = (spark.sparkContext.applicationId, sf_dir, name), listed_files(spark, f"{sf_dir}/documents.parquet")
    held = _INDEXES.get(place)
    if held is None or held[0] != state:
        path = f"{store.scratch_dir(spark)}/corpusloom-index/{uuid.uuid4().hex}"
        build(path)
        _INDEXES[place] = (state, path)
        if held is not None:
            delete_path(spark, held[1])
    return _INDEXES[place][1]


def by_terms(spark: SparkSession, sf_dir: str, terms: list[str]) -> DataFrame:
    return lexical.scored_index(lexical.open_index(spark, text_index(spark, sf_dir)), "doc_id", "text", terms)


def bm25_sql(terms: list[str], where: str = "true") -> str:
    """Scores of all matching documents; where: a condition on documents, before statistics."""
    n = range(len(terms))
    counts = ", ".join(f"len(list_filter(toks, lambda t: t = '{t}')) as t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (t{i} > 0) as d{i}" for i in n)
    part = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in n)
    cover = " + ".join(f"(t{i} > 0)::INT" for i in n)
    return f"""(with w as (select doc_id, {_TOKENS.format('text')} as toks from documents where {where}),
 l as (select doc_id, len(toks) as len, {counts} from w), s as (select count(*) as n, avg(len) as mean, {df} from l)
 select doc_id, {cover} as coverage, round({part}, 6) as score from l, s where {cover} > 0)"""


@register("lexical_search_topk", "doc_id:bigint coverage:bigint score:double", f"select * from {bm25_sql(TERMS)} order by coverage desc, score desc, doc_id limit 10")
def _(spark, sf_dir):
    rows = by_terms(spark, sf_dir, TERMS)
    return rows.orderBy(F.desc("coverage"), F.desc("score"), "doc_id").limit(10)


@register("postings_build", "term:string doc_id:bigint tf:bigint length:bigint", f"""select term, doc_id, count(*) as tf, any_value(n) as length from
 (select doc_id, len(toks) as n, unnest(toks) as term from (select doc_id, {_TOKENS.format('text')} as toks from documents)) group by term, doc_id""")
def _(spark, sf_dir):
    return lexical.postings(read(spark, sf_dir, "documents"), "doc_id", ["text"])


@register("term_dictionary", "term:string documents:bigint occurrences:bigint", f"""select term, count(distinct doc_id) as documents, count(*) as occurrences from
 (select doc_id, unnest({_TOKENS.format('text')}) as term from documents) group by term""")
def _(spark, sf_dir):
    return lexical.postings(read(spark, sf_dir, "documents"), "doc_id", ["text"]).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@register("term_coverage", "doc_id:bigint coverage:bigint", f"select doc_id, coverage from {bm25_sql(TERMS)}")
def _(spark, sf_dir):
    return lexical.scored(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", TERMS).where("coverage > 0")


@register("filtered_search", "doc_id:bigint score:double", f"""select * from {bm25_sql(TERMS, "lang = 'en' and source in ('src0', 'src1')")} order by score desc, doc_id limit 20""")
def _(spark, sf_dir):
    pool = read(spark, sf_dir, "documents").where((F.col("lang") == "en") & F.col("source").isin("src0", "src1"))
    return lexical.scored(pool.select("doc_id", "text"), "doc_id", "text", TERMS).where("coverage > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@register("boolean_must_search", "doc_id:bigint score:double", f"select doc_id, score from {bm25_sql(['this', 'with'])} where coverage = 2 order by score desc, doc_id limit 100")
def _(spark, sf_dir):
    return lexical.candidates(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "This with", 10)


@register("candidate_union", "doc_id:bigint score:double", f"""with s as {bm25_sql(TERMS)}
 select doc_id, score from (select doc_id, score from s order by score desc, doc_id limit 20) union
 select doc_id, score from (select doc_id, score from s where doc_id % 3 <> 0 order by score desc, doc_id limit 20) union
 select doc_id, score from (select doc_id, score from s where coverage = 3 order by score desc, doc_id limit 20)""")
def _(spark, sf_dir):
    return lexical.passes(by_terms(spark, sf_dir, TERMS), "doc_id", "this with that", 2, commits=F.col("doc_id") % 3 == 0)


QUERY_TABLE = ("query_id, query", "(1, 'this with'), (2, 'for the reason'), (3, 'und der die'), (4, 'les des pour')")


@register("multi_query_topk", "query_id:bigint doc_id:bigint rank:bigint score:double", f"""with p as (select doc_id, len(toks) as n, unnest(toks) as term from (select doc_id, {_TOKENS.format('text')} as toks from documents)),
 q as (select distinct query_id, unnest({_TOKENS.format('query')}) as term from {duck(QUERY_TABLE)}),
 f as (select query_id, q.term, doc_id, any_value(n) as len, count(*) as tf from p join q on p.term = q.term group by all),
 d as (select query_id, term, count(*) as df from f group by all),
 s as (select (select count(*) from documents) as docs, (select avg(len({_TOKENS.format('text')})) from documents) as mean),
 e as (select query_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score, count(*) as coverage from f join d using (query_id, term), s group by all)
 select query_id, doc_id, row_number() over (partition by query_id order by coverage desc, round(score, 6) desc, doc_id) as rank, round(score, 6) as score from e qualify rank <= 5""")
def _(spark, sf_dir):
    return lexical.search_index(lexical.open_index(spark, text_index(spark, sf_dir)), "doc_id", values(spark, QUERY_TABLE), 5).withColumn("score", F.round("score", 6))


@register("query_postings", "query_id:bigint term:string doc_id:bigint tf:bigint", f"""with p as (select doc_id, unnest(toks) as term from (select doc_id, {_TOKENS.format('text')} as toks from documents)),
 q as (select distinct query_id, unnest({_TOKENS.format('query')}) as term from {duck(QUERY_TABLE)}) select query_id, term, doc_id, count(*) as tf from p join q using (term) group by all""")
def _(spark, sf_dir):
    terms = values(spark, QUERY_TABLE).select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
    return lexical.query_postings(read(spark, sf_dir, "documents"), "doc_id", "text", terms)


_NAMED = "(select p_partkey as chunk_id, replace(p_name, ' ', '_') as name from part)"


@register("exact_identifier_rank", "chunk_id:bigint exact_identifier:boolean", f"select chunk_id, name = (select max(name) from {_NAMED}) as exact_identifier from {_NAMED} order by exact_identifier desc, chunk_id limit 100")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.array(F.initcap(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("names"), F.lit(0).alias("coverage"), F.lit(0.0).alias("score"))
    asked = read(spark, sf_dir, "part").agg(F.max(F.replace("p_name", F.lit(" "), F.lit("_")))).first()[0]
    return lexical.final_order(rows, "chunk_id", 100, asked.upper(), identifiers="names")


@register("prose_is_no_symbol", "chunk_id:bigint exact_identifier:boolean", "select p_partkey as chunk_id, false as exact_identifier from part order by 1 limit 100")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.array("p_name").alias("names"), F.lit(0).alias("coverage"), F.lit(0.0).alias("score"))
    asked = read(spark, sf_dir, "part").agg(F.max("p_name")).first()[0]  # words without a symbol's signs equal a name and don't count as one
    return lexical.final_order(rows, "chunk_id", 100, asked, identifiers="names")


@register("query_analysis", "id:bigint raw:string symbols:string expanded:bigint", rf"""select id, array_to_string(raw, '|') as raw, array_to_string(sym, '|') as symbols,
 len(raw) + 0 * len(sym) as expanded from (select id, list_transform(list_filter(parts, lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]')), lambda t: lower(t)) as raw,
 list_transform(list_filter(parts, lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]') and regexp_matches(t, '[_0-9\p{{Lu}}]')), lambda t: lower(t)) as sym
 from (select id, string_split_regex(q, '[^\p{{L}}\p{{N}}_-]+') as parts from (select doc_id as id, text || ' Write_NVM -- a_b-c x1' as q from documents)))""")
def _(spark, sf_dir):
    q = F.col("q")
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" Write_NVM -- a_b-c x1")).alias("q"))
    return rows.select("id", F.array_join(T.raw_terms(q), "|").alias("raw"), F.array_join(T.symbol_terms(q), "|").alias("symbols"), F.size(T.raw_terms(q)).alias("expanded"))


@register("identifier_extraction", "doc_id:bigint names:string", r"""select doc_id, array_to_string(list_sort(list_slice(list_distinct_ordered, 1, 32)), '|') as names from (
 select doc_id, list_filter(allv, lambda x, i: list_position(allv, x) = i) as list_distinct_ordered from (
 select doc_id, list_concat([lang || '/' || doc_id || '.txt', doc_id::VARCHAR], list_filter(f, lambda t: regexp_matches(t, '[_0-9A-Z]')), f) as allv from (
 select doc_id, lang, list_filter(string_split_regex(text, '[^A-Za-z0-9_]'), lambda t: regexp_matches(t, '^[A-Za-z][A-Za-z0-9_]{2,127}$')) as f from documents)))""")
def _(spark, sf_dir):
    found = T.identifiers(F.col("path"), F.coalesce("content", F.lit("")))
    own = F.filter(found, lambda n: F.col("lang").isNotNull() | (n != F.col("path")))  # a stand-in takes its place among the first, but is no name
    return corpus(spark, sf_dir).select("doc_id", F.array_join(own, "|").alias("names"))


@register("morphology_aliases", "doc_id:bigint stems:bigint", "select doc_id, len(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: regexp_matches(w, '^.{4,}ence$'))) as stems from documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.morphology(F.col("text"))).alias("stems"))


@register("normalised_passages", "doc_id:bigint digest:string", r"select doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) as digest from documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalised_space(F.col("text")), 256).alias("digest"))


# --- identity and corpus ----------------------------------------------------


@register("document_identity", "doc_id:bigint content_digest:string document_id:string", f"select doc_id, content_digest, {_doc_id('repository', 'revision', 'path', 'content_digest')} as document_id from {_CORPUS}")
def _(spark, sf_dir):
    return corpus(spark, sf_dir).withColumn("document_id", unless_null(F.col("document_id"), "lang", "source"))


@register("corpus_inventory", "documents:bigint digests:bigint bytes:bigint", "select count(*) as documents, count(distinct sha256(text)) as digests, sum(strlen(text)) as bytes from documents")
def _(spark, sf_dir):
    return corpus(spark, sf_dir).agg(F.count("*").alias("documents"), F.countDistinct("content_digest").alias("digests"), F.sum(F.octet_length("content")).alias("bytes"))


@register("exact_duplicate_groups", "content_digest:string first_id:bigint copies:bigint", "select 'sha256:' || sha256(text) as content_digest, min(doc_id) as first_id, count(*) as copies from documents group by 1 having count(*) > 1")
def _(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("content_digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


@register("content_keys", "doc_id:bigint content_key:string", "select doc_id, sha256(encode(source) || unhex('00') || encode(lang || '/' || doc_id || '.txt') || unhex('00') || encode('sha256:' || sha256(text))) as content_key from documents")
def _(spark, sf_dir):
    key = ids.content_key(F.col("repository"), F.col("path"), F.col("content"))
    return corpus(spark, sf_dir).select("doc_id", unless_null(key, "lang", "source").alias("content_key"))


@register("source_census", "source:string lang:string documents:bigint bytes:bigint oversized:bigint", "select source, lang, count(*) as documents, sum(strlen(text)) as bytes, count(*) filter (strlen(text) > 8192) as oversized from documents group by all")
def _(spark, sf_dir):
    size = F.octet_length("text")
    return read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum(size).alias("bytes"), F.count_if(size > 8192).alias("oversized"))


BUDGET = budget.Budget(8192, 20, 40_000)


@register("budget_admission", "grp:string path:string size:bigint verdict:string", """with recursive r as (
 select source as grp, lang || '/' || doc_id || '.txt' as path, strlen(text) as size from documents),
 o as (select *, row_number() over (partition by grp order by path) as rn from r where size <= 8192),
 w as (select grp, path, size, rn, 'ok' as verdict, 1::BIGINT as n, size::BIGINT as b from o where rn = 1 union all
 select o.grp, o.path, o.size, o.rn, case when n >= 20 then 'file_limit' when b + o.size > 40000 then 'total_bytes' else 'ok' end,
 n + (n < 20 and b + o.size <= 40000)::INT, b + case when n < 20 and b + o.size <= 40000 then o.size else 0 end from w join o on o.grp = w.grp and o.rn = w.rn + 1)
 select grp, path, size, verdict from w union all select grp, path, size, 'oversized' from r where size > 8192""")
def _(spark, sf_dir):
    rows = corpus(spark, sf_dir).where("content is not null").select(F.col("source").alias("grp"), unless_null(F.col("path"), "lang").alias("path"), F.octet_length("content").alias("size"))
    return budget.admitted(rows, F.col("size"), [F.asc_nulls_last("path")], BUDGET, F.col("grp"))


@register("rejection_sample", "source:string doc_id:bigint place:bigint total:bigint", "select source, doc_id, row_number() over (partition by source order by doc_id) as place, count(*) over (partition by source) as total from documents where strlen(text) > 4096 qualify place <= 3")
def _(spark, sf_dir):
    rejected = read(spark, sf_dir, "documents").where(F.octet_length("text") > 4096)
    return documents.rejection_report(rejected, ["source"], ["doc_id"], 3)


@register("path_policy", "path:string media_type:string selected:boolean", f"""select path, case when regexp_matches(lower(path), '\\.(c|h)$') then 'text/x-c' when lower(path) like '%.cpp' then 'text/x-c++' when path like '%.md' then 'text/markdown'
 when path like '%.qml' then 'text/x-qml' when path like '%.yaml' then 'application/yaml' else 'text/plain' end as media_type,
 regexp_matches(lower(path), '\\.(c|h|cpp)$') or (not regexp_matches(path, '^docs/old(/|$)') and (regexp_matches(path, '^docs/(?:[^/]*/)*[^/]*\\.md$') or regexp_matches(path, '^x/[^/]*\\.qml$') or path like 'a/b/%')) as selected from (select ['src/', 'docs/', 'docs/old/', 'x/', 'a/b/', 'docs/deep/er/'][1 + doc_id % 6] || source || '_' || doc_id || ['.CPP', '.md', '.qml', '.yaml', '', '.h', '.txt'][1 + doc_id % 7] as path from documents)""")
def _(spark, sf_dir):
    policy = documents.PathPolicy(include_prefixes=("a/b",), exclude_prefixes=("docs/old",), include_patterns=("docs/**/*.md", "x/*.qml"))
    folder = F.element_at(F.array(*map(F.lit, ["src/", "docs/", "docs/old/", "x/", "a/b/", "docs/deep/er/"])), (1 + F.col("doc_id") % 6).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, [".CPP", ".md", ".qml", ".yaml", "", ".h", ".txt"])), (1 + F.col("doc_id") % 7).cast("int"))
    paths = read(spark, sf_dir, "documents").select(F.concat(folder, "source", F.lit("_"), F.col("doc_id").cast("string"), suffix).alias("path"))
    return paths.select("path", documents.media_type(F.col("path")).alias("media_type"), documents.selected(F.col("path"), policy).alias("selected"))


_MESSAGES = "(select doc_id, case when doc_id % 9 = 0 then '  ' || chr(10) || ' ' else ' ' || chr(10) || '  ' || source || ' of ' || doc_id || '  ' || chr(10) || chr(10) || text || chr(10) || ' ' end as message from documents)"


@register("commit_documents", "path:string title:string content:string", f"""select 'commits/' || doc_id as path, trim(regexp_extract(m, '^[^' || chr(10) || ']*')) as title, sha256(m || chr(10)) as content from
 (select doc_id, regexp_replace(regexp_replace(message, '^\\s+', ''), '\\s+$', '') as m from {_MESSAGES}) where m <> '' and strlen(m) + 1 <= 5000""")
def _(spark, sf_dir):
    d, key = read(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    message = F.when(F.col("doc_id") % 9 == 0, "  \n ").otherwise(F.concat(F.lit(" \n  "), "source", F.lit(" of "), key, F.lit("  \n\n"), "text", F.lit("\n ")))
    found = documents.commit_messages(d.select(key.alias("commit_id"), message.alias("message")), 5000)
    return found.withColumn("content", F.sha2("content", 256))


@register("catalog_order", "place:bigint id:string", "select row_number() over (order by case r_name when 'ASIA' then 0 when 'EUROPE' then 1 when 'AMERICA' then 2 when 'AFRICA' then 3 else 4 end, n_name) as place, n_name as id from nation join region on n_regionkey = r_regionkey")
def _(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = lambda r: n.where(F.col("r_name") == r).select(F.col("n_name").alias("id"), F.col("r_name").alias("category"))
    ranks = {"ASIA": 0, "EUROPE": 1, "AMERICA": 2, "AFRICA": 3, "MIDDLE EAST": 4}
    rows = catalog.catalog_union([part(r) for r in sorted(ranks)], ranks)
    order = [F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("category")), F.col("id")]
    return with_place(rows, order).select("place", "id")


# --- chunks -----------------------------------------------------------------


def chunk_table(spark: SparkSession, sf_dir: str, neighbours: bool = False) -> DataFrame:
    return chunking.chunk_documents(corpus(spark, sf_dir), carry=("doc_id", "repository", "revision", "path"), neighbours=neighbours)


_CUT = "coalesce(nullif(length(regexp_extract(substr(content, pos + 1, 1200), '^(.*\\s)', 1, 's')), 0), 0)"
_PIECES = f"""(with recursive p as (
 select doc_id, content, 0 as ordinal, 0::BIGINT as pos, case when length(content) <= 2400 then length(content)
  when {_CUT.replace('pos + 1', '1')} >= 120 then {_CUT.replace('pos + 1', '1')} else 1200 end as n from {_CORPUS} where trim(content) <> ''
 union all
 select doc_id, content, ordinal + 1, pos, case when length(content) - pos <= 1200 then length(content) - pos when {_CUT} >= 120 then {_CUT} else 1200 end
 from (select doc_id, content, ordinal, pos + n as pos from p) where pos < length(content))
 select doc_id, ordinal, pos, substr(content, pos + 1, n) as text, content from p)"""


@register("chunk_bounded_split", "doc_id:bigint ordinal:bigint char_count:bigint byte_count:bigint content_digest:string", f"select doc_id, ordinal, length(text) as char_count, strlen(text) as byte_count, 'sha256:' || sha256(text) as content_digest from {_PIECES}")
def _(spark, sf_dir):
    return chunk_table(spark, sf_dir)


@register("chunk_spans", "doc_id:bigint ordinal:bigint start_line:bigint end_line:bigint start_byte:bigint end_byte:bigint", f"""select doc_id, ordinal, 1 + length(pre) - length(replace(pre, chr(10), '')) as start_line,
 1 + length(pre || text) - length(replace(pre || text, chr(10), '')) as end_line, strlen(pre) as start_byte, strlen(pre) + strlen(text) as end_byte from (select *, substr(content, 1, pos) as pre from {_PIECES})""")
def _(spark, sf_dir):
    return chunk_table(spark, sf_dir)


@register("chunk_adjacency", "doc_id:bigint ordinal:bigint has_previous:boolean has_next:boolean", f"select doc_id, ordinal, ordinal > 0 as has_previous, ordinal < max(ordinal) over (partition by doc_id) as has_next from {_PIECES}")
def _(spark, sf_dir):
    rows = chunk_table(spark, sf_dir, neighbours=True)
    return rows.select("doc_id", "ordinal", F.col("previous_chunk").isNotNull().alias("has_previous"), F.col("next_chunk").isNotNull().alias("has_next"))


@register("document_reassembly", "doc_id:bigint digest:string chunks:bigint", f"select doc_id, sha256(any_value(content)) as digest, count(*) as chunks from {_PIECES} group by doc_id")
def _(spark, sf_dir):
    rows = chunk_table(spark, sf_dir)
    whole = chunking.reassembled(rows).select("document_id", F.sha2("content", 256).alias("digest"), "chunks")
    return rows.where("ordinal = 0").select("document_id", "doc_id").join(whole, "document_id")


@register("completeness_check", "doc_id:bigint complete:boolean", "select doc_id, true as complete from documents where trim(text) <> ''")
def _(spark, sf_dir):
    rows = chunk_table(spark, sf_dir)
    return history.complete_documents(rows).join(rows.where("ordinal = 0").select("document_id", "doc_id"), "document_id")


# --- vectors ----------------------------------------------------------------

_DOT = "round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 5)"


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


@register("vector_topk", "vec_id:bigint similarity:double", f"select a.vec_id, {_DOT.replace(', 5)', ', 6)')} as similarity from embeddings a, embeddings b where b.vec_id = 7 order by round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6) desc, a.vec_id limit 10")
def _(spark, sf_dir):
    return vectors.top_k(read(spark, sf_dir, "embeddings"), "vec_id", vector_of(spark, sf_dir, 7), 10)


@register("vector_topk_batch", "query_id:bigint vec_id:bigint rank:bigint", """select b.vec_id as query_id, a.vec_id, row_number() over (partition by b.vec_id order by
 round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6) desc, a.vec_id) as rank from embeddings a, embeddings b where b.vec_id % 50 = 0 qualify rank <= 5""")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return vectors.top_k_batch(e, "vec_id", e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@register("vector_validate", "verdict:string n:bigint", "select 'sound' as verdict, count(*) as n from embeddings")
def _(spark, sf_dir):
    v = F.coalesce(vectors.verdict(F.col("embedding"), 64), F.lit("sound"))
    return read(spark, sf_dir, "embeddings").groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@register("vector_reuse", "vec_id:bigint action:string", "select vec_id, case when vec_id % 3 <> 0 and label % 2 = 0 then 'reuse' else 'embed' end as action from embeddings")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("model", F.lit("m1"))
    old = e.where("vec_id % 3 <> 0").withColumn("model", F.when(F.col("label") % 2 == 0, "m1").otherwise("m0"))
    return vectors.reuse_plan(e, old, "vec_id")


@register("vector_reconcile", "vec_id:bigint first:double", """with old as (select vec_id, label, embedding from embeddings where vec_id % 4 = 0), al as (select label, min_by(embedding, vec_id) as e from old group by label)
 select n.vec_id, round(coalesce(old.embedding, al.e)[1]::DOUBLE, 6) as first from embeddings n left join old using (vec_id) left join al on al.label = n.label""")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("content_key", F.col("label"))
    made = vectors.reconciled(e.select("vec_id", "content_key"), e.where("vec_id % 4 = 0"), "vec_id")
    return made.select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@register("vector_consistency", "vec_id:bigint problem:string", "select vec_id, 'missing' as problem from embeddings where vec_id % 11 = 0 union all select vec_id, 'unknown' from embeddings where vec_id % 13 = 0 and vec_id % 11 <> 0")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return vectors.inconsistencies(e.where("vec_id % 13 <> 0 or vec_id % 11 = 0"), e.where("vec_id % 11 <> 0"), "vec_id")


@register("centroid_pooling", "label:bigint position:bigint value:double", """with m as (select label, i, avg(embedding[i]::DOUBLE) as v from embeddings, range(1, 65) r(i) group by label, i), n as (select label, sqrt(sum(v * v)) as l from m group by label)
 select label, i - 1 as position, round(v / l, 5) as value from m join n using (label)""")
def _(spark, sf_dir):
    made = vectors.pooled(read(spark, sf_dir, "embeddings"), "label")
    return made.select("label", F.posexplode("embedding").alias("position", "v")).select("label", "position", F.round("v", 5).alias("value"))


@register("max_window_score", "label:bigint score:double", f"select a.label, max({_DOT.replace(', 5)', ', 6)')}) as score from embeddings a, embeddings b where b.vec_id = 3 group by a.label order by score desc, label limit 50")
def _(spark, sf_dir):
    return vectors.best_window(read(spark, sf_dir, "embeddings"), "label", vector_of(spark, sf_dir, 3))


@register("sequence_census", "bucket:bigint windows:bigint batches:bigint real_tokens:bigint padded_tokens:bigint padding_ppm:bigint", f"""select bucket, count(*) as windows, ceil(count(*) / floor(8192 / bucket)) as batches, sum(least(t, bucket)) as real_tokens, count(*) * bucket as padded_tokens,
 floor((count(*) * bucket - sum(least(t, bucket))) * 1000000 / (count(*) * bucket)) as padding_ppm from (select t, case when t <= 64 then 64 when t <= 256 then 256 else 1024 end as bucket from (select len({_TOKENS.format('text')}) as t from documents)) group by bucket""")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.size(T.tokens(F.col("text"))).alias("tokens"))
    return vectors.sequence_census(rows, [64, 256, 1024], 8192)


@register("token_statistics", "lang:string samples:bigint least:bigint median:bigint p95:bigint most:bigint", f"""select lang, count(*) as samples, min(t) as least, quantile_disc(t, 0.5) as median, quantile_disc(t, 0.95) as p95, max(t) as most from (select lang, len({_TOKENS.format('text')}) as t from documents) group by lang""")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("lang", F.size(T.tokens(F.col("text"))).alias("t"))
    return evaluate.percentiles(rows, "t", ["lang"], {"median": 0.5, "p95": 0.95}).join(rows.groupBy("lang").agg(F.min("t").alias("least"), F.max("t").alias("most")), "lang")


# --- fusion -----------------------------------------------------------------

_LISTS = """l as (select o_custkey as query_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders),
 s as (select o_custkey as query_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rank from orders where o_orderkey % 3 <> 0)"""


def lists(spark, sf_dir):
    """Two ranked lists a customer: the dearest orders, and the newest of those that the second list knows."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")
    place = lambda d, by: d.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "id")).alias("rank"))
    return place(o, "o_totalprice"), place(o.where("id % 3 <> 0"), "o_orderdate")


@register("rrf_fusion", "query_id:bigint id:bigint place:bigint score:double", f"""with {_LISTS} select query_id, id, row_number() over (partition by query_id order by score desc, id) as place, round(score, 9) as score from (select coalesce(l.query_id, s.query_id) as query_id, coalesce(l.id, s.id) as id,
 coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) as score from (select * from l where rank <= 12) l full join (select * from s where rank <= 12) s on l.query_id = s.query_id and l.id = s.id)""")
def _(spark, sf_dir):
    left, right = (d.where("rank <= 12") for d in lists(spark, sf_dir))
    made = fusion.reciprocal_rank(left, right, "id")
    return made.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*fusion.fused_order("id")))).withColumn("score", F.round("score", 9))


@register("rrf_over_tables", "doc_id:bigint score:double", f"""with l as (select doc_id, row_number() over (order by coverage desc, score desc, doc_id) as r from {bm25_sql(TERMS)} qualify r <= 50),
 s as (select a.vec_id as doc_id, row_number() over (order by round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6) desc, a.vec_id) as r from embeddings a, embeddings b where b.vec_id = 7 qualify r <= 50)
 select coalesce(l.doc_id, s.doc_id) as doc_id, round(coalesce(1.0::DOUBLE / (60 + l.r), 0) + coalesce(1.0::DOUBLE / (60 + s.r), 0), 9) as score from l full join s on l.doc_id = s.doc_id""")
def _(spark, sf_dir):
    top = by_terms(spark, sf_dir, TERMS).orderBy(F.desc("coverage"), F.desc("score"), "doc_id").limit(50).withColumn("query_id", F.lit(1))
    left = top.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("score"), "doc_id")).alias("rank"))
    right = search.semantic_hits(read(spark, sf_dir, "embeddings"), "vec_id", vector_of(spark, sf_dir, 7), 10).select(F.lit(1).alias("query_id"), F.col("vec_id").alias("doc_id"), "rank")
    return fusion.reciprocal_rank(left, right, "doc_id").withColumn("score", F.round("score", 9))


@register("document_cap_dedup", "q:bigint r:bigint d:string g:string", """with recursive c as (select o_custkey as q, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r, o_orderstatus as d, (o_orderkey % 4)::VARCHAR as g from orders),
 w as (select q, 0::BIGINT as r, []::VARCHAR[] as ds, []::VARCHAR[] as gs, false as kept, null::VARCHAR as d, null::VARCHAR as g from (select distinct q from c) union all
 select q, r, case when ok then list_append(ds, d) else ds end, case when ok then list_append(gs, g) else gs end, ok, d, g from (select c.q, c.r, c.d, c.g, w.ds, w.gs,
 len(list_filter(w.ds, lambda x: x = c.d)) < 2 and not list_contains(w.gs, c.g) and len(w.gs) < 3 as ok from w join c on c.q = w.q and c.r = w.r + 1))
 select q, r, d, g from w where kept""")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    rows = o.select(F.col("o_custkey").alias("q"), place.alias("r"), F.col("o_orderstatus").alias("d"), (F.col("o_orderkey") % 4).cast("string").alias("g"))
    return fusion.capped(rows, "q", "r", "d", "g", 2, 3)


PARTS = ("document_id, ordinal, text", "('d', 0, 'zero'), ('d', 1, 'one'), ('d', 2, 'two'), ('d', 3, 'three'), ('d', 4, 'four'), ('e', 0, 'other')")


@register("history_collapse", "lang:string digest:string rank:bigint occurrences:bigint first_revision:string representative:string", """select lang, digest, min(doc_id) as rank, count(*) as occurrences, min(source) as first_revision, min_by(source, doc_id) as representative from
 (select lang, sha256(text) as digest, doc_id, source from documents) group by all""")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return fusion.collapsed(d.withColumnRenamed("doc_id", "rank"), ["lang", "digest"], "rank", "source")


@register("history_collapse_preferred", "lang:string digest:string rank:bigint occurrences:bigint last_revision:string representative:string", """select lang, digest, min(doc_id) as rank, count(*) as occurrences, max(source) as last_revision, case when bool_or(source = 'src3') then 'src3' else min_by(source, doc_id) end as representative from
 (select lang, sha256(replace(text, 'e', '')[1:2]) as digest, doc_id, source from documents) group by all""")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", F.sha2(F.left(F.replace("text", F.lit("e"), F.lit("")), F.lit(2)), 256).alias("digest"), F.col("doc_id").alias("rank"), "source")
    return fusion.collapsed(d, ["lang", "digest"], "rank", "source", preferred="src3")


@register("facet_topk", "facet_id:bigint candidate_id:bigint rank:bigint", """select n_regionkey as facet_id, c_custkey as candidate_id, row_number() over (partition by n_regionkey order by c_acctbal desc, c_custkey) as rank from customer join nation on c_nationkey = n_nationkey qualify rank <= 2""")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("c_custkey").alias("candidate_id"), F.col("n_regionkey").alias("repository"), F.lit("s").alias("stage"), F.lit("v1").alias("revision"), F.col("c_acctbal").alias("score"), F.lit(0.0).alias("retrieval_score"))
    facets = spark.sql("select id as facet_id, id as repository, 's' as stage, cast(null as string) as era from range(5)")
    return fusion.facet_top_k(rows, facets, 2)


# --- evaluation -------------------------------------------------------------


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, judgments and a run: customers ask, their orders are judged by priority and ranked by price."""
    o = read(spark, sf_dir, "orders")
    run = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    grade = F.when(F.col("o_orderkey") % 7 == 0, 2).when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    qrels = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), grade.alias("grade"))
    queries = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("intent"), F.col("c_nationkey").cast("string").alias("category"))
    return queries, qrels, run


_METRICS = """(with o as (select o_custkey as query_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank,
 case when o_orderkey % 7 = 0 then 2 when o_orderkey % 3 = 0 then 1 else 0 end as grade from orders),
 j as (select query_id, count(*) filter (rank <= 5 and grade > 0) as hits, min(case when grade > 0 and rank <= 10 then rank end) as first,
 sum(case when rank <= 10 and grade > 0 then (pow(2, grade) - 1) / log2(rank + 1.0::DOUBLE) end) as dcg from o group by query_id),
 g as (select query_id, grade, row_number() over (partition by query_id order by grade desc, id) as r from o where grade > 0),
 i as (select query_id, count(*) as relevant, sum(case when r <= 10 then (pow(2, grade) - 1) / log2(r + 1.0::DOUBLE) end) as idcg from g group by query_id)
 select c_custkey as query_id, c_mktsegment as intent, c_nationkey::VARCHAR as category, round(coalesce(hits / relevant, 0), 6) as recall_at_5, round(coalesce(1.0::DOUBLE / first, 0), 6) as mrr_at_10,
 round(coalesce(dcg / idcg, 0), 6) as ndcg_at_10 from customer left join j on j.query_id = c_custkey left join i on i.query_id = c_custkey)"""


@register("retrieval_metrics", "query_id:bigint recall_at_5:double mrr_at_10:double ndcg_at_10:double", f"select * from {_METRICS}")
def _(spark, sf_dir):
    queries, qrels, run = judged(spark, sf_dir)
    return evaluate.query_metrics(run, qrels, queries)


@register("metrics_by_group", "dimension:string value:string queries:bigint recall_at_5_sum:bigint mrr_at_10_sum:bigint ndcg_at_10_sum:bigint", f"""select case when grouping(intent) = 0 then 'intent' else 'category' end as dimension, coalesce(intent, category) as value, count(*) as queries,
 sum(round(recall_at_5 * 1000000)) as recall_at_5_sum, sum(round(mrr_at_10 * 1000000)) as mrr_at_10_sum, sum(round(ndcg_at_10 * 1000000)) as ndcg_at_10_sum from {_METRICS} group by grouping sets ((intent), (category))""")
def _(spark, sf_dir):
    queries, qrels, run = judged(spark, sf_dir)
    return evaluate.grouped_metrics(evaluate.query_metrics(run, qrels, queries), ["intent", "category"])


@register("duplicate_rate", "query_id:bigint duplicate_rate:double diversity:double", """with o as (select o_custkey as q, o_orderstatus as d, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders qualify rank <= 5)
 select q as query_id, round(1 - count(distinct d) / count(*), 6) as duplicate_rate, round(count(distinct d) / count(*), 6) as diversity from o group by q""")
def _(spark, sf_dir):
    _, _, run = judged(spark, sf_dir)
    status = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return evaluate.duplicate_rate(run.join(status, "id"), "o_orderstatus")


@register("latency_percentiles", "event_type:string samples:bigint p50:bigint p95:bigint", "select event_type, count(*) as samples, quantile_disc(event_id, 0.5) as p50, quantile_disc(event_id, 0.95) as p95 from events group by event_type")
def _(spark, sf_dir):
    return evaluate.percentiles(read(spark, sf_dir, "events"), "event_id", ["event_type"], {"p50": 0.5, "p95": 0.95})


@register("stratified_sample", "doc_id:bigint turn:bigint", """select doc_id, row_number() over (partition by lang, b order by doc_id) as turn from (select doc_id, lang, case when length(text) <= 512 then 0 when length(text) < 4096 then 1 else 2 end as b from documents)
 order by turn, lang, b, doc_id limit 40""")
def _(spark, sf_dir):
    size = F.length("text")
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.when(size <= 512, 0).when(size < 4096, 1).otherwise(2).alias("b"))
    return evaluate.stratified(d, ["lang", "b"], ["doc_id"], 40)


@register("judged_sample", "doc_id:bigint judged:boolean", """with j as (select doc_id from labels where quality = 1), n as (select count(*) as held from documents where doc_id in (from j)),
 r as (select doc_id, row_number() over (order by doc_id) - 1 as p, count(*) over () as others from documents where doc_id not in (from j)),
 s as (select doc_id, p, greatest(1, others // greatest(1, 100 - held)) as step, held from r, n)
 select doc_id, true as judged from documents where doc_id in (from j) union all select doc_id, false from s where p % step = 0 and p / step < greatest(0, 100 - held)""")
def _(spark, sf_dir):
    j = read(spark, sf_dir, "labels").where("quality = 1")
    return evaluate.judged_sample(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", j, 100)


@register("profile_totals", "function:string samples:bigint", "select event_type || '.' || (user_id % 10) as function, count(*) as samples from events group by 1 having count(*) >= 5 order by samples desc, function limit 20")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    name = F.concat("event_type", F.lit("."), (F.col("user_id") % 10).cast("string"))
    return evaluate.profile_totals(e.select(name.alias("function"), F.lit(1).alias("samples")), 20, 5)


@register("profile_diff", "function:string before:double after:double delta:double", """with a as (select event_type as f, count(*) as b from events where event_id % 2 = 0 and event_type <> 'click' group by 1), c as (select event_type as f, count(*) * 1.5::DOUBLE as n from events where event_id % 3 = 0 group by 1)
 select coalesce(a.f, c.f) as function, coalesce(b, 0) as before, coalesce(n, 0) as after, round(coalesce(n, 0) - coalesce(b, 0), 6) as delta from a full join c on a.f = c.f where abs(coalesce(n, 0) - coalesce(b, 0)) >= 0.01""")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    before = e.where("event_id % 2 = 0 and event_type <> 'click'").select(F.col("event_type").alias("function"), F.lit(1.0).alias("percent"))
    after = e.where("event_id % 3 = 0").select(F.col("event_type").alias("function"), F.lit(1.5).alias("percent"))
    return evaluate.profile_diff(before, after)


_STACK = "(select [o_orderpriority, o_orderstatus, 'f' || o_custkey % 5, o_orderstatus, 'main'] as f from orders)"


@register("self_inclusive", "function:string self_samples:bigint inclusive_samples:bigint", f"""with s as {_STACK}, i as (select x as function, count(*) as n from (select unnest(list_distinct(f)) as x from s) group by 1), l as (select f[1] as function, count(*) as n from s group by 1)
 select i.function, coalesce(l.n, 0) as self_samples, i.n as inclusive_samples from i left join l using (function)""")
def _(spark, sf_dir):
    frames = F.array("o_orderpriority", "o_orderstatus", F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string")), "o_orderstatus", F.lit("main"))
    return evaluate.self_and_inclusive(read(spark, sf_dir, "orders").select(frames.alias("frames")))


@register("gold_matching", "gold_id:bigint rank:bigint matched:boolean", """select item_id as gold_id, coalesce(min(doc_id), -1) as rank, min(doc_id) is not null as matched from benchmark left join documents on contains(lower(documents.text), lower(benchmark.text)) and lang = 'en' group by item_id""")
def _(spark, sf_dir):
    results = read(spark, sf_dir, "documents").select(F.col("lang").alias("repository"), F.lit("p/x").alias("path"), F.col("text").alias("passage"), F.col("doc_id").alias("rank"))
    gold = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("gold_id"), F.lit("en").alias("repository"), F.lit("p/").alias("prefix"), F.array("text").alias("required_terms"))
    return evaluate.gold_matches(results, gold).withColumn("rank", F.coalesce("rank", F.lit(-1)))


@register("unknown_judgments", "doc_id:bigint", "select doc_id from labels where doc_id not in (select doc_id from documents where doc_id % 9 <> 0)")
def _(spark, sf_dir):
    known = read(spark, sf_dir, "documents").where("doc_id % 9 <> 0").select(F.col("doc_id").alias("id"))
    return evaluate.unknown_judgments(read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"), known).select(F.col("id").alias("doc_id"))


@register("evidence_counters", "query_id:string rows:bigint with_provenance:bigint paths:bigint contents:bigint repeated:bigint", "select source as query_id, count(*) as rows, count(lang) as with_provenance, count(distinct lang) as paths, count(distinct sha256(text)) as contents, count(*) - count(distinct sha256(text)) as repeated from documents group by source")
def _(spark, sf_dir):
    return evaluate.evidence_counters(read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("lang").alias("path"), F.sha2("text", 256).alias("content_digest")))


# --- graph ------------------------------------------------------------------

_EDGES = "(select l_orderkey as scope, l_orderkey * 10 + l_linenumber as source, lead(l_orderkey * 10 + l_linenumber) over (partition by l_orderkey order by l_linenumber) as target from (select distinct l_orderkey, l_linenumber from lineitem))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return rows.select(F.col("l_orderkey").alias("scope"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"), "l_linenumber")


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(lines(spark, sf_dir), "node", ["scope"], "l_linenumber")


@register("adjacency_edges", "scope:bigint source:bigint target:bigint", f"select * from {_EDGES} where target is not null")
def _(spark, sf_dir):
    return line_edges(spark, sf_dir)


@register("graph_offsets", "node:bigint n:bigint start:bigint", f"select node, n, total - n as start from (select node, n, sum(n) over (order by node) as total from (select source as node, (target is not null)::INT as n from {_EDGES}))")
def _(spark, sf_dir):
    return graph.offsets(line_edges(spark, sf_dir), lines(spark, sf_dir), "source").withColumnRenamed("offset", "start")


@register("graph_neighbours", "node:bigint relation:string", f"select source as node, 'adjacent-next' as relation from {_EDGES} where target = (select min(target) from {_EDGES}) union all select target, 'adjacent-next' from {_EDGES} where source = (select min(target) from {_EDGES}) and target is not null")
def _(spark, sf_dir):
    e = line_edges(spark, sf_dir)
    node = e.agg(F.min("target")).first()[0]
    return graph.neighbours(e, node, outgoing=False).unionByName(graph.neighbours(e, node))


@register("bounded_expansion", "seed:bigint node:bigint hop:bigint", f"""with recursive e as (select source, target from {_EDGES} where target is not null), w as (select source as seed, source as node, 0 as hop from {_EDGES} union all
 select seed, target, hop + 1 from w join e on e.source = w.node where hop < 2) select * from w""")
def _(spark, sf_dir):
    return graph.expanded(line_edges(spark, sf_dir), lines(spark, sf_dir).select("node"))


@register("graph_validate", "problem:string n:bigint", f"select 'dangling' as problem, count(*) as n from (select unnest([source, target]) as x from {_EDGES} where target is not null) where x % 7 = 0 having count(*) > 0")
def _(spark, sf_dir):
    return graph.problems(lines(spark, sf_dir).where("node % 7 <> 0"), line_edges(spark, sf_dir).drop("scope"), "scope")


# --- history ----------------------------------------------------------------

PARENTS = ("commit, parent, place", "('c2', 'c1', 0), ('c3', 'c2', 0), ('d1', 'c2', 0), ('d2', 'd1', 0), ('m1', 'c3', 0), ('m1', 'd1', 1), ('e1', 'm1', 0)")
TREE = ("commit, path, blob", "('c1', 'a', 'b1'), ('c1', 'b', 'b2'), ('c2', 'a', 'b3'), ('c2', 'b', 'b2'), ('c3', 'a', 'b3'), ('c3', 'c', 'b4'), ('d1', 'a', 'b3'), ('d1', 'b', 'b5')")


@register("blob_first_seen", "digest:string doc_id:bigint source:string", "select sha256(text) as digest, min(doc_id) as doc_id, min_by(source, doc_id) as source from documents group by 1")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return history.first_seen(d, ["digest"], ["doc_id"])


@register("incremental_reconcile", "doc_id:bigint keep:boolean", "select doc_id, source not in ('src1', 'src2') and doc_id % 7 <> 0 as keep from documents")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("revision"), F.col("doc_id").alias("document_id"))
    alive = d.where(~F.col("revision").isin("src1", "src2")).select(F.col("revision").alias("commit")).distinct()
    return history.reconciled(d, alive, d.where("doc_id % 7 = 0"))


REFS = ("name, full_name, commit, is_default", "('main', 'refs/heads/main', 'e1', true), ('v1.10', 'refs/tags/v1.10', 'c3', false), ('v1.9', 'refs/tags/v1.9', 'c2', false), ('release_2_0', 'refs/tags/release_2_0', 'd1', false), ('topic', 'refs/heads/topic', 'd2', false)")


@register("version_page", "c_custkey:bigint c_name:string", "select c_custkey, c_name from customer order by c_acctbal desc, c_custkey limit 50 offset 100")
def _(spark, sf_dir):
    return history.page(read(spark, sf_dir, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], "v1:100")[0]


# --- investigation and feedback ---------------------------------------------

_FACETS = "(select n_nationkey as facet_id, r_name as repository, case when n_nationkey % 2 = 0 then 'BUILDING' else 'MACHINERY' end as stage, case when n_nationkey % 3 = 0 then 'v1' end as era, n_name as question from nation join region on r_regionkey = n_regionkey)"
_EVIDENCE = """(select o_orderkey as evidence_id, c_nationkey as facet_id, r_name as repository, c_mktsegment as stage, case when o_orderkey % 4 = 0 then 'v2' else 'v1' end as revision, o_orderkey % 5 = 0 as adjacent
 from orders join customer on c_custkey = o_custkey join nation on n_nationkey = (c_nationkey + (o_orderkey % 11 = 0)::INT) % 25 join region on r_regionkey = n_regionkey where o_orderkey % 7 <> 0 or c_nationkey > 6)"""
_VERDICT = f"""(select evidence_id, e.facet_id, case when e.adjacent then 'adjacent' when e.repository <> f.repository then 'wrong_repository' when e.stage <> f.stage then 'wrong_stage'
 when f.era is not null and e.revision <> f.era then 'wrong_era' else 'qualifying' end as verdict from {_EVIDENCE} e join {_FACETS} f on e.facet_id = f.facet_id)"""


def facets_of(spark, sf_dir):
    """A facet a nation."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    return n.select(key.alias("facet_id"), F.col("r_name").alias("repository"), F.when(key % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("stage"), F.when(key % 3 == 0, "v1").alias("era"), F.col("n_name").alias("question"))


def evidence_of(spark, sf_dir):
    """Orders as evidence of their customer's nation; some name the next nation's region."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    key = F.col("o_orderkey")
    o = o.where((key % 7 != 0) | (F.col("c_nationkey") > 6)).withColumn("n_nationkey", (F.col("c_nationkey") + (key % 11 == 0).cast("int")) % 25)
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return o.join(n, "n_nationkey").select(
        key.alias("evidence_id"), F.col("c_nationkey").alias("facet_id"), F.col("r_name").alias("repository"), F.col("c_mktsegment").alias("stage"), F.when(key % 4 == 0, "v2").otherwise("v1").alias("revision"), (key % 5 == 0).alias("adjacent")
    )


@register("coverage_audit", "evidence_id:bigint facet_id:bigint verdict:string", f"select * from {_VERDICT}")
def _(spark, sf_dir):
    return investigate.classified(evidence_of(spark, sf_dir), facets_of(spark, sf_dir))


@register("missing_facets", "facet_id:bigint query:string", f"select facet_id, concat_ws(' ', repository, stage, era, question) as query from {_FACETS} where facet_id not in (select facet_id from {_VERDICT} where verdict = 'qualifying' and evidence_id % 40 = 1) order by facet_id limit 8")
def _(spark, sf_dir):
    facets = facets_of(spark, sf_dir)
    few = evidence_of(spark, sf_dir).where("evidence_id % 40 = 1")  # what a first round may have brought
    return investigate.planned(facets, investigate.missing_facets(few, facets))


@register("round_rotation", "facet_id:bigint", f"""with m as (select facet_id, facet_id < 12 as asked from {_FACETS} where facet_id not in (select facet_id from {_VERDICT} where verdict = 'qualifying' and evidence_id % 40 = 1))
 select facet_id from m order by asked, facet_id limit 8""")
def _(spark, sf_dir):
    facets = facets_of(spark, sf_dir)
    few = evidence_of(spark, sf_dir).where("evidence_id % 40 = 1")
    asked = facets.where("facet_id < 12").select("facet_id", F.lit(1).alias("times"))
    return investigate.planned(facets, investigate.missing_facets(few, facets), asked=asked)


RECORDS = ("record_id, supersedes, covered", "('n1', null, false), ('n2', 'n1', false), ('n3', null, true), ('n4', null, null)")


@register("conversation_notes", "conv_id:bigint turn:bigint question:string lesson:string", "select conv_id, turn, sha256(text) as question, sha256(nxt) as lesson from (select *, lead(text) over (partition by conv_id order by turn) as nxt, lead(role) over (partition by conv_id order by turn) as r2 from conversations) where role = 'user' and r2 = 'assistant'")
def _(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").select("*", F.lead("text").over(order).alias("nxt"), F.lead("role").over(order).alias("r2"))
    return rows.where("role = 'user' and r2 = 'assistant'").select("conv_id", "turn", F.sha2("text", 256).alias("question"), F.sha2("nxt", 256).alias("lesson"))


# --- whole service, sources, streams ----------------------------------------


@register("search_service", "rank:bigint path:string occurrences:bigint score:double", None)
def _(spark, sf_dir):
    chunks = store.written(chunk_table(spark, sf_dir))
    return search.search(chunks, search.Request("this with that", limit=10))[0]


_URIS = """(select doc_id, case doc_id % 5 when 0 then 'corpus://knowledge/chunk/a%20' || doc_id when 1 then 'corpus://knowledge/snapshots/' || sha256(source) || '/document/' || doc_id
 when 2 then 'corpus://knowledge/other/' || doc_id when 3 then 'http://knowledge/chunk/' || doc_id else 'corpus://knowledge/feedback/x/' || doc_id end as uri from documents)"""


@register("resource_uris", "doc_id:bigint kind:string snapshot:string id:string", f"""select doc_id, case doc_id % 5 when 0 then 'chunk' when 1 then 'document' end as kind, case when doc_id % 5 = 1 then regexp_extract(uri, '[0-9a-f]{{64}}') end as snapshot,
 case doc_id % 5 when 0 then 'a ' || doc_id when 1 then doc_id::VARCHAR end as id from {_URIS}""")
def _(spark, sf_dir):
    key, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    uri = (
        F.when(kind == 0, F.concat(F.lit("corpus://knowledge/chunk/a%20"), key)).when(kind == 1, F.concat(F.lit("corpus://knowledge/snapshots/"), F.sha2("source", 256), F.lit("/document/"), key))
        .when(kind == 2, F.concat(F.lit("corpus://knowledge/other/"), key)).when(kind == 3, F.concat(F.lit("http://knowledge/chunk/"), key)).otherwise(F.concat(F.lit("corpus://knowledge/feedback/x/"), key))
    )
    rows = read(spark, sf_dir, "documents").select("doc_id", T.resource_uri(uri).alias("u"))
    return rows.select("doc_id", "u.kind", "u.snapshot", F.when(F.col("u.kind").isNotNull(), F.col("u.id")).alias("id"))


@register("change_detection", "user_id:bigint event_id:bigint event_type:string change:string", """select user_id, event_id, event_type, case when row_number() over w = 1 then 'baseline' when lag(event_type) over w = event_type then 'same' else 'changed' end as change from events window w as (partition by user_id order by event_id)""")
def _(spark, sf_dir):
    return watch.changes(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@register("windowed_totals", "window_start:timestamp event_type:string events:bigint total:double", "select time_bucket(interval '1 hour', ts::TIMESTAMP) as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by all")
def _(spark, sf_dir):
    return watch.windowed_totals(read(spark, sf_dir, "events"), "ts", ["event_type"], "value", "1 hour")


PRIORITIES = ("id, category, summary, catalog_ref", "('a-b', 'x', 'Fix the (bug), now!', 'p.json'), ('c', 'y', 'one one', 'q.json')")


# --- lookups, admission, further sources -------------------------------------


@register("metadata_lookup", "chunk_id:bigint document_id:string content_digest:string", "select doc_id as chunk_id, lang as document_id, sha256(text) as content_digest from documents where doc_id % 50 = 0 and source = 'src0'")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("document_id"), F.lit(None).cast("string").alias("registered_id"), F.sha2("text", 256).alias("content_digest"), F.col("source").alias("repository"))
    return lookup.metadata(d, d.where("chunk_id % 50 = 0").select("chunk_id"), repository="src0")


@register("content_key_lookup", "content_key:string chunk_id:bigint", "select sha256(text) as content_key, min(doc_id) as chunk_id from documents group by 1")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_key"), F.col("doc_id").alias("chunk_id"))
    return lookup.chunks_of_keys(d, d)


@register("content_key_known", "content_key:string known:boolean", "with w as (select distinct sha256(text) as content_key from documents) select content_key, content_key in (select sha256(text) from documents where doc_id % 10 <> 0 and source <> 'src1') as known from w")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_key"), "doc_id", F.col("source").alias("document_id"))
    gone = spark.createDataFrame([("src1",)], "document_id string")
    return lookup.known_keys(d.select("content_key").distinct(), d.where("doc_id % 10 <> 0"), gone)


@register("passage_dedup", "content_key:string revision:string sequence:bigint", "select sha256(text) as content_key, lang as revision, min(doc_id) as sequence from documents group by all")
def _(spark, sf_dir):
    return history.passages_once(read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_key"), F.col("lang").alias("revision"), F.col("doc_id").alias("sequence")))


@register("index_change", "c_custkey:bigint c_acctbal:double", "select c_custkey, case when c_custkey % 5 = 0 then 0 else c_acctbal end as c_acctbal from customer where c_custkey % 3 <> 0 or c_custkey % 5 = 0")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return history.changed_index(c, c.where("c_custkey % 3 = 0"), c.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.lit(0.0)), "c_custkey")


@register("path_metrics", "facet_coverage:double complete:boolean wrong_era_rate:double utilisation:double duplicate_waste:double shortcut_rate:double", f"""with v as (select e.*, v.verdict from {_EVIDENCE} e join {_VERDICT} v using (evidence_id)), f as (select facet_id, case when facet_id > 0 then facet_id - 1 end as after from {_FACETS}),
 g as (select distinct facet_id from v where verdict = 'qualifying' and evidence_id % 40 = 1), e as (select * from v where evidence_id % 40 = 1)
 select round((select count(*) from g) / (select count(*) from f), 6) as facet_coverage, (select count(*) from g) = (select count(*) from f) as complete, round(avg((verdict = 'wrong_era')::INT), 6) as wrong_era_rate, round(avg((verdict = 'qualifying')::INT), 6) as utilisation,
 round((count(*) - count(distinct stage || revision)) / count(*), 6) as duplicate_waste, round((select count(*) from f where facet_id in (from g) and after is not null and after not in (from g)) / (select count(*) from f), 6) as shortcut_rate from e""")
def _(spark, sf_dir):
    facets, evidence = facets_of(spark, sf_dir), evidence_of(spark, sf_dir).where("evidence_id % 40 = 1")
    judged = investigate.classified(evidence, facets).join(evidence.select("evidence_id", F.concat("stage", "revision").alias("content_key")), "evidence_id")
    return evaluate.path_metrics(judged, facets.select("facet_id", F.when(F.col("facet_id") > 0, F.col("facet_id") - 1).alias("after")))
