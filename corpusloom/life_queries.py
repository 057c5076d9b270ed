"""Registered queries of what changes over time: indexes with segments, budgets, revision histories, stored graphs, quality gates.

Histories, trees and graphs are derived from the driver's orders and line items on both sides; the SQL walks row by row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import chunking, evaluate, history, lexical, reach, vectors, views
from corpusloom.operators.budget import Budget
from corpusloom.operators.graph import EDGE_ORDER
from corpusloom.plans import store
from corpusloom.plans.embedding import EmbeddingRun
from corpusloom.plans.graph_store import GraphStore
from corpusloom.plans.segments import SegmentedIndex
from corpusloom.plans.snapshots import Snapshots
from corpusloom.queries import _METRICS, _PIECES, _TOKENS, TERMS, bm25_sql, judged, read, register

# --- an index with segments -----------------------------------------------------


def fresh_root(spark, label):
    return f"{store.scratch_dir(spark)}/corpusloom-{label}/{uuid.uuid4().hex}"


def appended(spark, sf_dir, most=32):
    """An index of all documents, in three appends."""
    index = SegmentedIndex(spark, fresh_root(spark, "segments"), "doc_id", ("text",), ("lang", "source"), most)
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    for part in range(3):
        index.change(d.where(F.pmod("doc_id", F.lit(3)) == part))
    return index, d


def changed(spark, sf_dir):
    """That index after a sixth of the documents has been deleted and a tenth replaced, with at most two segments."""
    index, d = appended(spark, sf_dir, most=2)
    index.change(d.where("doc_id % 10 = 1").withColumn("text", F.concat("text", F.lit(" this with that"))), d.where("doc_id % 6 = 0").select("doc_id"))
    return index


_CHANGED = "(select doc_id, lang, source, text || case when doc_id % 10 = 1 then ' this with that' else '' end as text from documents where doc_id % 6 <> 0 or doc_id % 10 = 1)"
_SCORED = "doc_id:bigint coverage:bigint score:double"


@register("index_append_search", _SCORED, bm25_sql(TERMS))
def _(spark, sf_dir):
    index, _ = appended(spark, sf_dir)
    return lexical.scored_index(index.view(), "doc_id", "text", TERMS)


@register("index_delete_search", _SCORED, bm25_sql(TERMS).replace("from documents", f"from {_CHANGED}"))
def _(spark, sf_dir):
    return lexical.scored_index(changed(spark, sf_dir).view(), "doc_id", "text", TERMS)


@register("index_filtered_search", _SCORED, bm25_sql(TERMS, "lang = 'en' and source in ('src1', 'src2', 'src3')").replace("from documents", f"from {_CHANGED}"))
def _(spark, sf_dir):
    view = changed(spark, sf_dir).view((F.col("lang") == "en") & F.col("source").isin("src1", "src2", "src3"))
    return lexical.scored_index(view, "doc_id", "text", TERMS)


@register("merged_terms", "term:string df:bigint occurrences:bigint", f"select term, count(distinct doc_id) as df, count(*) as occurrences from (select doc_id, unnest({_TOKENS.format('text')}) as term from {_CHANGED}) group by term")
def _(spark, sf_dir):
    return changed(spark, sf_dir).terms()


# --- budgets --------------------------------------------------------------------

LIMITS = Budget(8192, 400, 600_000)


def _folded(rows: str, order: str, limits: Budget) -> str:
    """Row by row: what of `rows` (id, size) is admitted in an order."""
    return f"""with recursive o as (select *, row_number() over (order by {order}) as rn from ({rows})),
 w as (select 0::BIGINT as rn, 0::BIGINT as n, 0::BIGINT as used, null::BIGINT as id, null::VARCHAR as verdict union all
 select rn, n + (v = 'ok')::INT, used + case when v = 'ok' then size else 0 end, id, v from (select o.rn, o.id, o.size, w.n, w.used,
 case when size > {limits.file_bytes} then 'oversized' when n >= {limits.files} then 'file_limit' when used + size > {limits.total_bytes} then 'total_bytes' else 'ok' end as v from w join o on o.rn = w.rn + 1))"""


@register("newest_admitted", "doc_id:bigint", f"{_folded('select doc_id as id, strlen(text) as size from documents', 'id desc', LIMITS)} select id as doc_id from w where verdict = 'ok'")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return history.newest_admitted(d, "size", [F.desc("doc_id")], LIMITS)


@register("tip_first_blobs", "doc_id:bigint priority:bigint verdict:string", f"""{_folded("select doc_id as id, strlen(text) as size, (source not in ('src1', 'src2'))::INT as priority from documents", "priority, 'p' || id, 'b' || id", LIMITS)}
 select w.id as doc_id, priority, verdict from w join o on o.id = w.id""")
def _(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("p"), key).alias("path"), F.concat(F.lit("b"), key).alias("blob"), F.octet_length("text").alias("size"), "source")
    return history.tip_first(d, d.where("source in ('src1', 'src2')"), LIMITS).withColumn("doc_id", F.substring("blob", 2, 20).cast("bigint"))


# --- histories ------------------------------------------------------------------
# each customer is a repository: an order's first parent is the customer's order before it, or, for every fifth key, the one before that; every third key merges the order three before

_PARENTS = """o as (select o_custkey as repo, o_orderkey as c, o_orderdate as day, lag(o_orderkey, 1) over w as l1, lag(o_orderkey, 2) over w as l2, lag(o_orderkey, 3) over w as l3,
 row_number() over (partition by o_custkey order by o_orderkey desc) as nth from orders window w as (partition by o_custkey order by o_orderkey)),
 p as (select c, case when c % 5 = 0 then coalesce(l2, l1) else l1 end as parent, 0 as place from o where l1 is not null union all select c, l3, 1 from o where c % 3 = 0 and l3 is not null)"""


def commits(spark, sf_dir):
    """(repo, commit, at, nth, first, second): nth counts from the newest. Written once, in one sort a customer: what is made of it reads it many times."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    l1, l2, l3 = (F.lag("o_orderkey", k).over(w) for k in (1, 2, 3))
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"), (F.count("*").over(Window.partitionBy("o_custkey")) - F.row_number().over(w) + 1).alias("nth"),
        F.when(F.col("o_orderkey") % 5 == 0, F.coalesce(l2, l1)).otherwise(l1).alias("first"), F.when(F.col("o_orderkey") % 3 == 0, l3).alias("second"),
    )
    return store.written(rows)


def parents_of(rows):
    first = rows.select("commit", F.col("first").alias("parent"), F.lit(0).alias("place"))
    return first.unionByName(rows.select("commit", F.col("second").alias("parent"), F.lit(1).alias("place"))).where("parent is not null")


def labels_of(rows):
    """Labels in two steps: of commits older than a customer's four newest, then of these."""
    old, new = rows.where("nth > 4"), rows.where("nth <= 4")
    known = reach.labelled(old, parents_of(old))
    return reach.labelled(new, parents_of(new), known=known)


@register("reachable_commits", "o_orderkey:bigint reachable:boolean", f"""with recursive {_PARENTS}, w as (select c as tip, c from o where nth in (2, 5) union select w.tip, p.parent from w join p on p.c = w.c)
 select o_orderkey, o_orderkey in (select c from w) as reachable from orders""")
def _(spark, sf_dir):
    rows = commits(spark, sf_dir)
    labels = labels_of(rows)
    found = reach.within(rows.select("commit"), "commit", labels, reach.reached(labels, rows.where("nth in (2, 5)")))
    return rows.select("commit").join(found.withColumn("_r", F.lit(True)), "commit", "left").select(F.col("commit").alias("o_orderkey"), F.col("_r").isNotNull().alias("reachable"))


@register("merge_base", "current:bigint base:bigint", f"""with recursive {_PARENTS}, pairs as (select a.c as cur, b.c as prev from o a join o b on b.repo = a.repo where a.nth = 1 and b.nth in (2, 4)),
 w as (select c as tip, c from o where nth in (1, 2, 4) union select w.tip, p.parent from w join p on p.c = w.c),
 common as (select cur, prev, x.c from pairs join w x on x.tip = cur join w y on y.tip = prev and y.c = x.c),
 top as (select * from common t where not exists (select 1 from common u join p on p.c = u.c where u.cur = t.cur and u.prev = t.prev and p.parent = t.c))
 select cur as current, arg_max(c, (day, c)) as base from top join (select c, day from o) using (c) group by cur""")
def _(spark, sf_dir):
    rows = commits(spark, sf_dir)
    pairs = rows.where("nth = 1").select("repo", F.col("commit").alias("current")).join(rows.where("nth in (2, 4)").select("repo", F.col("commit").alias("previous")), "repo")
    bases = reach.merge_bases(labels_of(rows), pairs).join(rows.select(F.col("commit").alias("base"), "at"), "base")
    return reach.nearest_base(bases, [-F.unix_timestamp(F.col("at").cast("timestamp")), -F.col("base")])


_ENTRIES = "(select distinct l_orderkey as c, 'p' || l_linenumber as path, l_suppkey % 10 as blob from lineitem)"


def entries(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("path"), (F.col("l_suppkey") % 10).alias("blob")).distinct()


@register("tree_changes", "commit:bigint path:string blob:bigint change:string", f"""with {_PARENTS}, t as (select c, path, min(blob) as blob from {_ENTRIES} group by c, path)
 select t.c as "commit", t.path, t.blob, 'added' as change from t left join p on p.c = t.c and place = 0 where not exists (select 1 from t x where x.c = p.parent and x.path = t.path)
 union all select t.c, t.path, t.blob, 'changed' from t join p on p.c = t.c and place = 0 join t x on x.c = p.parent and x.path = t.path where x.blob <> t.blob""")
def _(spark, sf_dir):
    one = entries(spark, sf_dir).groupBy("commit", "path").agg(F.min("blob").alias("blob"))
    return history.tree_changes(one, parents_of(commits(spark, sf_dir)))


@register("blob_reuse", "commit:bigint path:string blob:bigint proof:boolean", f"""with recursive {_PARENTS}, w as (select c as tip, c from o union select w.tip, p.parent from w join p on p.c = w.c), t as {_ENTRIES},
 i as (select distinct l_orderkey as c, 'p' || l_linenumber as path, l_suppkey % 10 as blob from lineitem where l_quantity > 25 and l_orderkey % 2 = 0)
 select t.c as "commit", path, blob, exists (select 1 from w join i on i.c = w.c where w.tip = t.c and i.path = t.path and i.blob = t.blob) as proof from t""")
def _(spark, sf_dir):
    rows = commits(spark, sf_dir)
    sure = (F.col("l_quantity") > 25) & (F.col("l_orderkey") % 2 == 0)
    indexed = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("path"), (F.col("l_suppkey") % 10).alias("blob"), F.col("l_orderkey").alias("revision"), sure.alias("reusable"))
    return reach.reuse_proofs(entries(spark, sf_dir), indexed, labels_of(rows))


# --- a stored graph: parts to suppliers -------------------------------------------

_GRAPH = """(select distinct 'p' || lpad(l_partkey::VARCHAR, 9, '0') as source, 's' || lpad(l_suppkey::VARCHAR, 9, '0') as target, 'p' || lpad(l_partkey::VARCHAR, 9, '0') as evidence_node, l_linenumber as start_line,
 l_linenumber + 2 as end_line, 0 as start_byte, l_quantity::INT as end_byte, l_returnflag as relation, l_linestatus as extractor, l_linenumber % 3 as confidence, l_linenumber > 4 as verified from lineitem)"""
_LISTED = ", ".join(EDGE_ORDER)
_NUMBERED = f"(select *, row_number() over (order by {_LISTED}) - 1 as place from {_GRAPH})"
_EDGE_TYPES = "place:bigint source:string target:string start_line:bigint end_byte:bigint relation:string extractor:string verified:boolean"


def stored_graph(spark, sf_dir):
    def name(letter, column):
        return F.concat(F.lit(letter), F.lpad(F.col(column).cast("string"), 9, "0"))

    line = F.col("l_linenumber")
    edges = read(spark, sf_dir, "lineitem").select(
        name("p", "l_partkey").alias("source"), name("s", "l_suppkey").alias("target"), name("p", "l_partkey").alias("evidence_node"), line.alias("start_line"), (line + 2).alias("end_line"),
        F.lit(0).alias("start_byte"), F.col("l_quantity").cast("int").alias("end_byte"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("extractor"), (line % 3).alias("confidence"), (line > 4).alias("verified"),
    )
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().select("node", F.lit("r").alias("repository"), F.lit("v").alias("revision"))
    graph = GraphStore(spark, fresh_root(spark, "graph"))
    graph.write(nodes, edges, once=True)
    return graph


@register("graph_outgoing", _EDGE_TYPES, f"select * from {_NUMBERED} where source = (select min(source) from {_GRAPH})")
def _(spark, sf_dir):
    graph = stored_graph(spark, sf_dir)
    return graph.neighbours(graph.nodes().where("forward_edges > 0").agg(F.min("node")).first()[0])


@register("graph_incoming", _EDGE_TYPES, f"select * from {_NUMBERED} where target = (select max(target) from {_GRAPH})")
def _(spark, sf_dir):
    graph = stored_graph(spark, sf_dir)
    return graph.neighbours(graph.nodes().where("reverse_edges > 0").agg(F.max("node")).first()[0], outgoing=False)


@register("graph_index", "node:string forward_place:bigint forward_edges:bigint reverse_edges:bigint", f"""with e as {_NUMBERED}, n as (select source as node from e union select target from e)
 select node, (select min(place) from e where source = node) as forward_place, (select count(*) from e where source = node) as forward_edges, (select count(*) from e where target = node) as reverse_edges from n""")
def _(spark, sf_dir):
    return stored_graph(spark, sf_dir).nodes()


# --- quality ----------------------------------------------------------------------

_FULL = f"""(select m.*, m.intent = 'BUILDING' as identifier_query, query_id not in (select o_custkey from orders) as zero_result,
 m.intent = 'BUILDING' and query_id in (select o_custkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r = 1 and o_orderkey % 7 = 0) as top_one_exact from {_METRICS} m)"""


def full_metrics(spark, sf_dir):
    queries, qrels, run = judged(spark, sf_dir)
    return evaluate.query_metrics(run, qrels, queries, F.col("intent") == "BUILDING")


@register("identifier_top1", "query_id:bigint identifier_query:boolean top_one_exact:boolean zero_result:boolean", f"select query_id, identifier_query, top_one_exact, zero_result from {_FULL}")
def _(spark, sf_dir):
    return full_metrics(spark, sf_dir)


@register("suite_means", "queries:bigint identifier_queries:bigint zero_result_rate:double exact_identifier_top_one:double", f"""select count(*) as queries, count(*) filter (identifier_query) as identifier_queries, round(avg(zero_result::INT), 6) as zero_result_rate,
 round(avg(top_one_exact::INT) filter (identifier_query), 6) as exact_identifier_top_one from {_FULL}""")
def _(spark, sf_dir):
    found = evaluate.suite_means(full_metrics(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("zero_result_rate", "exact_identifier_top_one")})


@register("quality_gate", "metric:string actual:double required:double passed:boolean", f"""select metric, actual, required, actual >= required as passed from (select unnest(['recall_at_5', 'mrr_at_10', 'ndcg_at_10', 'exact_identifier_top_one']) as metric,
 unnest([round(avg(recall_at_5), 4), round(avg(mrr_at_10), 4), round(avg(ndcg_at_10), 4), round(avg(top_one_exact::INT) filter (identifier_query), 4)]) as actual, unnest([0.9, 0.8, 0.8, 1.0]) as required from {_FULL})""")
def _(spark, sf_dir):
    return evaluate.gate(full_metrics(spark, sf_dir)).withColumn("actual", F.round("actual", 4))


@register("gate_regressions", "query_id:bigint zero_result:boolean", f"select query_id, zero_result from {_FULL} where zero_result or (identifier_query and not top_one_exact)")
def _(spark, sf_dir):
    return evaluate.regressions(full_metrics(spark, sf_dir))


CATEGORIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "WAREHOUSE"]
_SUITE = "(select case when c_custkey % 50 = 0 then 1 else c_custkey end as q, case when c_custkey % 11 = 0 then ' ' else c_name end as t, case when c_custkey % 13 <> 0 then c_mktsegment end as f from customer)"
_QRELS = "(select o_custkey as q, o_orderkey as id, case when o_orderkey % 97 = 0 then 3 else o_orderkey % 3 end as grade from orders)"
_LISTED_CATEGORIES = ", ".join(f"'{c}'" for c in CATEGORIES)


@register("suite_problems", "problem:string query_id:string id:string", f"""with s as {_SUITE}, j as {_QRELS}
 select 'repeated_query_id' as problem, q::VARCHAR as query_id, null as id from s group by q having count(*) > 1
 union all select 'empty_text', q::VARCHAR, null from s where trim(t) = '' union all select 'no_category', q::VARCHAR, null from s where f is null
 union all select 'unknown_category', q::VARCHAR, f from s where f not in ({_LISTED_CATEGORIES})
 union all select 'missing_category', null, c from (select unnest([{_LISTED_CATEGORIES}]) as c) where c not in (select f from s where f is not null)
 union all select 'no_judgments', q::VARCHAR, null from s where q not in (select q from j) union all select 'unknown_query', q::VARCHAR, id::VARCHAR from j where q not in (select q from s)
 union all select 'foreign_id', q::VARCHAR, id::VARCHAR from j where not starts_with(id::VARCHAR, '1') union all select 'unknown_id', q::VARCHAR, id::VARCHAR from j where id % 5 = 0 union all select 'bad_grade', q::VARCHAR, id::VARCHAR from j where grade > 2""")
def _(spark, sf_dir):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    queries = read(spark, sf_dir, "customer").select(
        F.when(k % 50 == 0, 1).otherwise(k).alias("query_id"), F.when(k % 11 == 0, " ").otherwise(F.col("c_name")).alias("text"), F.when(k % 13 != 0, F.col("c_mktsegment")).alias("failure_category")
    )
    orders = read(spark, sf_dir, "orders")
    qrels = orders.select(F.col("o_custkey").alias("query_id"), o.alias("id"), F.when(o % 97 == 0, 3).otherwise(o % 3).alias("grade"))
    return evaluate.suite_problems(queries, qrels, orders.where(o % 5 != 0).select(o.alias("id")), CATEGORIES, prefix="1")


# --- embedding that goes on, snapshots that derive ----------------------------------

PROFILE = vectors.Profile("mean", 8, 512)


@register("resumed_embedding", "doc_id:bigint block:bigint slot:bigint first_run:boolean dimension:bigint", "select doc_id, (row_number() over (order by doc_id) - 1) // 256 as block, (row_number() over (order by doc_id) - 1) % 256 as slot, doc_id % 3 <> 0 as first_run, 8 as dimension from documents")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat((F.col("doc_id") % 3).cast("string"), "text").alias("text"))
    run = EmbeddingRun(spark, fresh_root(spark, "embedding"), "doc_id", "stand-in", PROFILE, rows, block_rows=256)
    run.run(lambda texts: [None if t[0] == "0" else vectors.fake_embedding([t], 8)[0] for t in texts])  # a third doesn't come through
    first = run.vectors().select("doc_id", F.lit(True).alias("first_run")).checkpoint()
    run.run(lambda texts: [vectors.fake_embedding([t], 8)[0] if t[0] == "0" else None for t in texts])  # and only that third is asked for again
    whole = run.finish()
    placed = run.vectors().select("doc_id", "block", "slot").join(whole, "doc_id")
    return placed.join(first, "doc_id", "left").select("doc_id", "block", "slot", F.col("first_run").isNotNull().alias("first_run"), F.size("embedding").alias("dimension"))


_ONE = "(select sha256(doc_id || ':' || text) as document_id, text from documents where doc_id % 10 <> 0)"
_TWO = "(select sha256(doc_id || ':' || text || case when doc_id % 7 = 0 then chr(10) || 'changed ' || doc_id else '' end) as document_id, text || case when doc_id % 7 = 0 then chr(10) || 'changed ' || doc_id else '' end as text from documents)"
_LINES = "(select document_id, line from (select document_id, unnest(string_split(text, chr(10))) as line from {0}) where trim(line) <> '')"


@register("snapshot_derivation", "request:bigint how:string chunked:bigint embedded:bigint chunks:bigint vectors:bigint", f"""with a as {_ONE}, b as {_TWO}, la as {_LINES.format('a')}, lb as {_LINES.format('b')}
 select 1 as request, 'built' as how, (select count(*) from a) as chunked, (select count(distinct line) from la) as embedded, (select count(*) from la) as chunks, (select count(distinct line) from la) as vectors
 union all select 2, 'reused', 0, 0, (select count(*) from la), (select count(distinct line) from la)
 union all select 3, 'derived', (select count(*) from b where document_id not in (select document_id from a)), (select count(distinct line) from lb where line not in (select line from la)), (select count(*) from lb), (select count(distinct line) from lb)""")
def _(spark, sf_dir):
    def chunk(docs):
        lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.trim("text") != "")
        return lines.select("document_id", F.concat_ws("#", "document_id", "i").alias("chunk_id"), F.sha2("text", 256).alias("content_key"), "text")

    def named(docs, text):
        return docs.select(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), text), 256).alias("document_id"), text.alias("text"))

    d = read(spark, sf_dir, "documents")
    more = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("\nchanged "), F.col("doc_id").cast("string"))).otherwise("")
    one, two = named(d.where("doc_id % 10 <> 0"), F.col("text")), named(d, F.concat("text", more))
    snapshots = Snapshots(spark, fresh_root(spark, "snapshots"), chunk, lambda t: vectors.fake_embedding(t, 8), "stand-in", PROFILE)
    out = None
    for k, (commit, docs) in enumerate((("c1", one), ("c1", one), ("c2", two)), 1):
        a = snapshots.request({"documents": commit}, docs)
        counts = [snapshots.table(a.name, t).agg(F.count("*").alias(t)) for t in ("chunks", "vectors")]
        row = counts[0].crossJoin(counts[1]).select(F.lit(k).alias("request"), F.lit(a.how).alias("how"), F.lit(a.chunked).alias("chunked"), F.lit(a.embedded).alias("embedded"), "chunks", "vectors")  # single rows
        out = row if out is None else out.unionByName(row)
    return out


# --- Markdown -----------------------------------------------------------------------


@register("markdown_chunks", "doc_id:bigint ordinal:bigint text:string heading:string", r"""select doc_id, i - 1 as ordinal, list_extract(parts, i) as text, 'D' || doc_id as heading from (select doc_id, unnest([1, 2, 3, 4]) as i,
 ['# D' || doc_id || chr(10) || chr(10) || 'Of ' || source || chr(10), '1. item' || chr(10) || '   - inner' || chr(10),
  '     ```' || chr(10) || '     ' || lang || chr(10) || chr(10) || '     ' || md5(text) || chr(10) || '     ```' || chr(10), '> quoted' || chr(10) || '> ```' || chr(10) || '> ' || lang || chr(10)] as parts from documents)""")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    text = F.concat(
        F.lit("# D"), F.col("doc_id").cast("string"), F.lit("\n\nOf "), "source", F.lit("\n\n1. item\n   - inner\n\n     ```\n     "), "lang", F.lit("\n\n     "), F.md5("text"),
        F.lit("\n     ```\n\n> quoted\n> ```\n> "), "lang", F.lit("\n"),
    )
    docs = d.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("a.md").alias("path"), F.lit("text/markdown").alias("media_type"), text.alias("content"))
    return chunking.chunk_documents(docs).select(F.col("document_id").alias("doc_id"), "ordinal", "text", F.element_at("heading_path", 1).alias("heading"))


# --- history without stored texts -----------------------------------------------------
# each document's text is a blob that one to three revisions have

_SEEN = "(select doc_id, sha256(text) as blob, unnest(['v1', 'v2', 'v3'][1:1 + doc_id % 3]) as revision from documents)"


def occurrences(spark, sf_dir):
    """(blob, content, revision, path, media_type, doc_id)"""
    d = read(spark, sf_dir, "documents")
    revisions = F.explode(F.slice(F.array(F.lit("v1"), F.lit("v2"), F.lit("v3")), 1, (1 + F.col("doc_id") % 3).cast("int")))
    return d.select("doc_id", F.sha2("text", 256).alias("blob"), F.col("text").alias("content"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), revisions.alias("revision"))


def blobs_once(spark, sf_dir):
    """(number, blob, content): each blob once, as the document with the least number has it. An index names blobs by number: in the order of terms digests can't be compressed."""
    d = read(spark, sf_dir, "documents")
    return views.firsts(d.select(F.col("doc_id").alias("number"), F.sha2("text", 256).alias("blob"), F.col("text").alias("content")), "number")


@register("virtual_chunks", "doc_id:bigint revision:string ordinal:bigint start_byte:bigint passage:string", f"select p.doc_id, revision, ordinal, strlen(substr(content, 1, pos)) as start_byte, sha256(text) as passage from {_PIECES} p join {_SEEN} s on s.doc_id = p.doc_id")
def _(spark, sf_dir):
    blobs = blobs_once(spark, sf_dir)
    places = store.written(views.locators(blobs.select("blob", F.lit("a.txt").alias("path"), F.lit("text/plain").alias("media_type"), "content")))
    cut = views.with_passages(places, blobs)
    chunks = views.virtual_chunks(occurrences(spark, sf_dir).select("doc_id", "revision", "blob"), cut)
    return chunks.withColumn("passage", F.sha2("passage", 256))


@register("history_search", "rank:bigint blob:string score:double occurrences:bigint passage:string", f"""with b as (select sha256(text) as blob, min(text) as text from documents group by 1),
 r as (select doc_id as blob, coverage, score, row_number() over (order by coverage desc, score desc, doc_id) as rank from {bm25_sql(TERMS).replace("from documents", "from (select blob as doc_id, text from b)")})
 select rank, r.blob, score, (select count(*) from {_SEEN} s where s.blob = r.blob) as occurrences, sha256(substr(b.text, 1, greatest(0, length(b.text) - 1))) as passage from r join b using (blob) where rank <= 10""")
def _(spark, sf_dir):
    blobs = blobs_once(spark, sf_dir)
    path = fresh_root(spark, "index")
    lexical.write_index(blobs.select("number", F.col("content").alias("text")), "number", ["text"], path)
    scored = lexical.scored_index(lexical.open_index(spark, path), "number", "text", TERMS)
    best = scored.join(blobs.select("number", "blob"), "number").drop("number").orderBy(F.desc("coverage"), F.desc("score"), "blob").limit(10)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("coverage"), F.desc("score"), "blob"))).checkpoint()  # a result page
    last = blobs.select("blob", F.lit(0).alias("start_byte"), F.octet_length(F.substring("content", 1, F.length("content") - 1)).alias("end_byte"))
    page = views.with_history(ranked, occurrences(spark, sf_dir)).join(last, "blob")
    return views.with_passages(page, blobs).withColumn("passage", F.sha2("passage", 256))
