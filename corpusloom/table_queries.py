"""Registered queries of text functions, sources, feedback, versions and contracts, over the driver's whole tables.

Rows that these operators need and the driver does not have (descriptors, stacks, refs) are derived from its tables on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import ids
from corpusloom.functions import text as T
from corpusloom.operators import chunking, documents, fusion, history, investigate, lexical, lookup, vectors
from corpusloom.plans import search, store
from corpusloom.queries import _TOKENS, QUERIES, TERMS, bm25_sql, kept_index, read, register  # noqa: F401
from corpusloom.sources import catalog

# --- text functions -----------------------------------------------------------

_CUT = "list_max(list_filter(range(0, {n} + 1), lambda n: strlen(left(text, n)) <= {n}))"


@register("utf8_truncation", "doc_id:bigint short:string long:string", f"select doc_id, left(text, {_CUT.format(n=33)}) as short, sha256(left(text, {_CUT.format(n=257)})) as long from documents")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", T.truncated_utf8(F.col("text"), 33).alias("short"), F.sha2(T.truncated_utf8(F.col("text"), 257), 256).alias("long"))


@register("safe_names", "page_id:bigint name:string", "select page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g') as name from pages")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@register("percent_paths", "page_id:bigint coded:string path:string", "select page_id, replace(url_encode(p), '%2F', '/') as coded, p as path from (select page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') as p from pages)")
def _(spark, sf_dir):
    coded = T.percent_encoded(F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    return read(spark, sf_dir, "pages").select("page_id", coded.alias("coded"), T.percent_decoded(coded).alias("path"))


@register("remote_identities", "page_id:bigint remote:string", "select page_id, case when page_id % 2 = 0 then 'https://' else 'ssh://' end || split_part(split_part(url, '://', 2), '/', 1) || '/r' || page_id as remote from pages")
def _(spark, sf_dir):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    even = F.col("page_id") % 2 == 0
    url = F.concat(F.when(even, "https://u:secret@").otherwise("ssh://git@"), host, F.lit("/r"), F.col("page_id").cast("string"), F.when(even, ".git?x=1").otherwise(".git"))
    return read(spark, sf_dir, "pages").select("page_id", T.remote_identity(url).alias("remote"))


@register("warning_codes", "p_partkey:bigint code:string", "select p_partkey, replace(p_name, ' ', '_') as code from part")
def _(spark, sf_dir):
    warning = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" : "), "p_type", F.lit(": more"))
    return read(spark, sf_dir, "part").select("p_partkey", T.warning_code(warning).alias("code"))


@register("normalised_lists", "c_nationkey:bigint segments:string tags:string", "select c_nationkey, string_agg(distinct c_mktsegment, '|' order by c_mktsegment) as segments, string_agg(distinct c_mktsegment, '|' order by c_mktsegment) as tags from customer group by c_nationkey")
def _(spark, sf_dir):
    tags = F.collect_list(F.concat(F.lit(" "), "c_mktsegment", F.lit("  "))).alias("tags")
    rows = catalog.feedback_records(read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(tags))
    return rows.select("c_nationkey", F.array_join(T.normalised_list(F.col("tags")), "|").alias("segments"), F.array_join("sorted_tags", "|").alias("tags"))


@register("function_categories", "p_partkey:bigint category:string", "select p_partkey, case when p_name like '%widget%' or p_name like '%gear%' then 'mechanic' when p_name like '%cold%' then 'thermal' else 'other' end as category from part")
def _(spark, sf_dir):
    rules = [("mechanic", ["widget", "gear"]), ("thermal", ["cold"])]
    return read(spark, sf_dir, "part").select("p_partkey", T.function_category(F.upper("p_name"), rules).alias("category"))


@register("attribution_lines", "doc_id:bigint line:string", "select doc_id, source || ':' || lang || '/' || doc_id || '.txt:' || (1 + doc_id % 7) as line from documents")
def _(spark, sf_dir):
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select("doc_id", T.attribution(F.col("source"), path, 1 + F.col("doc_id") % 7).alias("line"))


@register("qualified_uris", "doc_id:bigint uri:string", "select doc_id, 'corpus://knowledge/' || case when doc_id % 3 = 2 then 'feedback/' else 'snapshots/' || sha256(source) || case when doc_id % 3 = 0 then '/chunk/' else '/document/' end end || doc_id as uri from documents")
def _(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "chunk/").when(F.col("doc_id") % 3 == 1, "document/").otherwise("feedback/")
    uri = F.concat(F.lit("corpus://knowledge/"), kind, F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", T.qualified_uri(uri, F.sha2("source", 256)).alias("uri"))


@register("semantic_rewrite", "p_partkey:bigint query:string", """select p_partkey, p_name || case when p_name like '%cold%' and p_name like '%widget%' then chr(10) || 'Concept aliases: low temperature; small part'
 when p_name like '%cold%' then chr(10) || 'Concept aliases: low temperature' when p_name like '%widget%' then chr(10) || 'Concept aliases: small part' else '' end as query from part""")
def _(spark, sf_dir):
    rules = [(["cold", "frozen"], "low temperature"), (["widget"], "small part")]
    return read(spark, sf_dir, "part").select("p_partkey", T.semantic_query(F.col("p_name"), rules).alias("query"))


_ALIASES = ", ".join(f"('{k}', [{', '.join(repr(x) for x in v)}])" for k, v in T.ALIASES.items())
_ASKED = "text || ' persistence over the Transport_layer source'"


@register("query_expansion", "item_id:bigint terms:string", rf"""with a as (select map_from_entries(list((k, v))) as m from (values {_ALIASES}) as t(k, v)),
 r as (select item_id, list_transform(list_filter(string_split_regex({_ASKED}, '[^\p{{L}}\p{{N}}_-]+'), lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]')), lambda t: lower(t)) as raw from benchmark),
 f as (select item_id, flatten(list_transform(raw, lambda t: list_concat([t], list_filter(string_split_regex(t, '[_-]'), lambda p: p <> ''), coalesce(m[t], [])))) as l from r, a)
 select item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as terms from f""")
def _(spark, sf_dir):
    asked = F.concat("text", F.lit(" persistence over the Transport_layer source"))
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.expanded_terms(asked), "|").alias("terms"))


@register("document_titles", "doc_id:bigint stem:string symbol:boolean identifier:boolean", r"""select doc_id, 'x' || doc_id as stem, regexp_matches(w, '[_0-9A-Z]') as symbol, regexp_full_match(w, '[A-Za-z][A-Za-z0-9_]{2,127}') as identifier
 from (select doc_id, split_part(trim(text), ' ', 1) as w from documents)""")
def _(spark, sf_dir):
    word = F.split_part(F.trim("text"), F.lit(" "), F.lit(1))
    path = F.concat("source", F.lit("/x"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select("doc_id", T.file_stem(path).alias("stem"), T.symbol_like(word).alias("symbol"), T.valid_identifier(word).alias("identifier"))


# --- sources --------------------------------------------------------------------


@register("blob_verdicts", "doc_id:bigint rejection:string digest:string", """select doc_id, case when strlen(text) + 1 > 4096 then 'oversized' when doc_id % 3 = 1 then 'binary' when doc_id % 3 = 2 then 'encoding' end as rejection,
 case when strlen(text) + 1 <= 4096 and doc_id % 3 = 0 then sha256(replace(text || chr(10), chr(13) || chr(10), chr(10))) end as digest from documents""")
def _(spark, sf_dir):
    mark = F.unhex(F.when(F.col("doc_id") % 3 == 1, "00").when(F.col("doc_id") % 3 == 2, "FF").otherwise("0A"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("text").cast("binary"), mark).alias("data"))
    return documents.loaded_blobs(rows, 4096).select("doc_id", "rejection", F.sha2("content", 256).alias("digest"))


@register("priority_entries", "id:string name:string keywords:string", r"""select 'priority.item-' || item_id as id, 'item_' || item_id as name, array_to_string(list_sort(list_distinct(list_filter(list_concat(['item', item_id::VARCHAR],
 list_transform(string_split_regex(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g'))), lambda w: w <> ''))), '|') as keywords from benchmark""")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("id"), F.lit("x").alias("category"), F.col("text").alias("summary"), F.lit("p.json").alias("catalog_ref"))
    return catalog.priority_entries(rows).withColumn("keywords", F.array_join("keywords", "|"))


@register("markdown_summaries", "p_partkey:bigint summary:string", "select p_partkey, p_name || case p_partkey % 3 when 0 then '. ' || p_brand || ' ' || p_type when 1 then '. ' || p_type else '' end as summary from part")
def _(spark, sf_dir):
    n, part = F.col("p_partkey") % 3, read(spark, sf_dir, "part")
    body = F.concat(F.lit("\n\n**Note:** x\n| a |\n"), "p_brand", F.lit("\n---\n"), "p_type", F.lit("\n\nrest"))
    text = F.concat(F.lit("# "), "p_name", F.when(n == 0, body).otherwise("\n\n"))
    return part.select("p_partkey", catalog.markdown_summary(text, F.when(n == 1, F.col("p_type")).otherwise("")).alias("summary"))


@register("descriptor_properties", "path:string name:string kind:string value:string duplicate:boolean", """select p_brand as path, 'size' || p_size as name, case when min(p_partkey) % 2 = 0 then 'string' else 'bool' end as kind,
 case when min(p_partkey) % 2 = 0 then min_by(p_name, p_partkey) else 'true' end as value, count(*) > 1 as duplicate from part where p_partkey % 5 <> 4 group by p_brand, p_size""")
def _(spark, sf_dir):
    named = F.concat(F.lit("size"), F.col("p_size").cast("string"), F.lit(": "))
    line = F.when(F.col("p_partkey") % 5 == 4, F.concat(F.lit("// property bool "), named, F.lit("true"))).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  property string "), named, F.lit('"'), "p_name", F.lit('"')))
    line = line.otherwise(F.concat(F.lit("property bool "), named, F.lit("true;")))
    return catalog.descriptor_properties(read(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("line_no"), line.alias("line")))


@register("missing_assets", "path:string name:string value:string", "select 'pkg/' || p_partkey || '/d' as path, n as name, p_partkey || '.' || n as value from part, (values ('lisp', 3), ('qml', 4)) as v(n, k) where p_partkey % k = 1 and not (n = 'qml' and p_partkey % 5 = 0)")
def _(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    part = read(spark, sf_dir, "part").withColumn("folder", F.concat(F.lit("pkg/"), key))
    each = part.select("p_partkey", "folder", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k")) for n, k in (("lisp", 3), ("qml", 4))])).alias("x")).select("p_partkey", "folder", "x.*")
    value = F.when((F.col("n") == "qml") & (F.col("p_partkey") % 5 == 0), "").otherwise(F.concat(key, F.lit("."), "n"))
    wanted = each.select(F.concat("folder", F.lit("/d")).alias("path"), F.col("n").alias("name"), value.alias("value"))
    there = each.where(F.col("p_partkey") % F.col("k") != 1).select(F.concat("folder", F.lit("/"), key, F.lit("."), "n").alias("path"))
    return catalog.missing_assets(wanted, there, ["lisp", "qml"])


_LINES = "(select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by all)"


def order_lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


@register("perf_stacks", "file:bigint sample:bigint stack:string", f"""select l_orderkey // 10 as file, dense_rank() over (partition by l_orderkey // 10 order by l_orderkey) as sample, string_agg('fn_' || l_partkey, '|' order by l_linenumber) as stack
 from {_LINES} group by l_orderkey""")
def _(spark, sf_dir):
    rows = order_lines(spark, sf_dir).withColumn("file", F.floor(F.col("l_orderkey") / 10).cast("bigint"))
    number = (F.col("l_orderkey") % 10) * 1000
    heads = rows.select("file", number.alias("line_no"), F.lit("app 1 cycles:").alias("line")).distinct()
    frames = rows.select("file", number + F.col("l_linenumber") + 1, F.concat(F.lit("\t  7f"), F.lit(" fn_"), F.col("l_partkey").cast("string"), F.lit("+0x1f (/bin/app)")))
    return catalog.perf_stacks(heads.union(frames)).select("file", "sample", F.array_join("frames", "|").alias("stack"))


@register("flame_frames", "function:string samples:bigint percent:double", "select 'fn_' || p_partkey as function, 1000 * p_size as samples, p_size / 100.0 as percent from part")
def _(spark, sf_dir):
    line = F.concat(F.lit("<g><title>fn_"), F.col("p_partkey").cast("string"), F.lit(" ("), F.format_number(1000 * F.col("p_size"), 0), F.lit(" samples, "), F.format_number(F.col("p_size") / 100, 2), F.lit("%)</title>"))
    return catalog.flame_frames(read(spark, sf_dir, "part").select(line.alias("line")))


@register("colon_descriptors", "p_partkey:bigint output:string fullscreen:boolean name:string", "select p_partkey, case when p_partkey % 4 < 2 then p_brand end as output, case when p_partkey % 4 < 2 then p_partkey % 4 = 1 end as fullscreen, case when p_partkey % 4 < 2 then p_name end as name from part")
def _(spark, sf_dir):
    line = F.concat_ws(":", "p_brand", F.lit("a.lisp"), F.lit("b.qml"), (F.col("p_partkey") % 4).cast("string"), F.lit("r.md"), "p_name")
    rows = read(spark, sf_dir, "part").select("p_partkey", catalog.colon_descriptor(line).alias("d"))
    return rows.select("p_partkey", "d.output", "d.fullscreen", "d.name")


@register("sandbox_paths", "doc_id:bigint inside:boolean", "select doc_id, doc_id % 3 = 0 as inside from documents")
def _(spark, sf_dir):
    n = F.col("doc_id") % 3
    path = F.concat(F.when(n == 0, "root/a/").when(n == 1, "root/../").otherwise("rooted/"), F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", catalog.under_root(path, "root").alias("inside"))


@register("event_properties", "event_id:bigint record:string", "select event_id, replace(props, ': ', ':') as record from events")
def _(spark, sf_dir):
    text = F.concat(F.lit('{"rows": ['), "props", F.lit("]}"))
    files = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), text.alias("text"))
    return catalog.json_records(files, ["rows"]).select(F.col("path").alias("event_id"), "record")


@register("membership_antijoin", "c_custkey:bigint", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def _(spark, sf_dir):
    paths = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    known = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("path"))
    return catalog.missing_paths(paths, known).select(F.col("path").alias("c_custkey"))


# --- chunks and lookups ---------------------------------------------------------


@register("adjacent_context", "document_id:bigint anchor_id:bigint passage:string neighbor_count:bigint", f"""with c as (select l_orderkey as d, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as o, 'part ' || l_partkey as t from {_LINES}),
 m as (select a.d, a.o as a, n.t, case when n.o = a.o then 0 when n.o < a.o then 4 + n.o - a.o else 3 + n.o - a.o end as turn from c a join c n on n.d = a.d and n.o between a.o - 3 and a.o + 3),
 u as (select *, sum(strlen(t) + case when turn = 0 then 0 else 1 end) over (partition by d, a order by turn) as used from m)
 select d as document_id, a as anchor_id, string_agg(t, '|' order by turn) as passage, count(*) - 1 as neighbor_count from u where used <= 30 or turn = 0 group by d, a""")
def _(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    chunks = order_lines(spark, sf_dir).select(F.col("l_orderkey").alias("document_id"), place.alias("ordinal"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"))
    anchors = chunks.select(F.struct("document_id", "ordinal").alias("anchor_id"), "document_id", "ordinal")
    made = fusion.with_context(anchors, chunks, 30, joiner="|")
    return made.select(F.col("anchor_id.document_id").alias("document_id"), F.col("anchor_id.ordinal").alias("anchor_id"), "passage", "neighbor_count")


def document_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("ordinal"), "text", F.col("lang").alias("repository"))


@register("hydrated_passages", "chunk_id:bigint digest:string", "select doc_id as chunk_id, sha256(text) as digest from documents where doc_id in (select doc_id from labels)")
def _(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir)
    wanted = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")).join(chunks, "chunk_id", "left_semi")
    return lookup.passages(chunks, wanted).select("chunk_id", F.sha2("text", 256).alias("digest"))


@register("embedding_inventory", "document_id:string chunk_id:bigint", "select source as document_id, doc_id as chunk_id from documents")
def _(spark, sf_dir):
    return lookup.embedding_ids(document_chunks(spark, sf_dir))


@register("document_listing", "chunk_id:bigint", "select doc_id as chunk_id from documents where source = 'src3'")
def _(spark, sf_dir):
    return lookup.document_chunks(document_chunks(spark, sf_dir), "src3")


@register("aliased_repositories", "chunk_id:bigint", "select doc_id as chunk_id from documents where lang = 'en' or (lang = 'de' and source in ('src1', 'src2', 'src5'))")
def _(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir).withColumn("revision", F.col("document_id"))
    aliases = spark.createDataFrame([("en", "k1"), ("de", "k1"), ("fr", "k2")], "repository string, contract string")
    reached = spark.createDataFrame([("t", "src1"), ("t", "src2"), ("t", "src5"), ("u", "src6")], "tip string, commit string")
    return lookup.aliased(chunks, aliases, "en", reached, "t").select("chunk_id")


@register("unit_vectors", "vec_id:bigint first:double length:double", "select vec_id, round(embedding[1]::DOUBLE / n, 5) as first, 1.0 as length from (select *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) as n from embeddings)")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", vectors.normalised(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return rows.select("vec_id", F.round(F.col("v")[0], 5).alias("first"), F.round(vectors.norm(F.col("v")), 6).alias("length"))


# --- history and versions -------------------------------------------------------

_REFS = """(select c_custkey as k, case when c_custkey % 5 = 0 then 'topic' || c_custkey when c_custkey % 3 = 0 then 'release_' || (c_custkey % 9) || '_' || (c_custkey % 4) || '_' || c_custkey
 else 'v' || (c_custkey % 7) || '.' || (c_custkey % 11) || '.' || c_custkey end as name, sha1(c_name) as commit_id from customer)"""


def refs(spark, sf_dir):
    k = F.col("c_custkey")
    part = lambda n: (k % n).cast("string")
    key = k.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("topic"), key)).when(k % 3 == 0, F.concat(F.lit("release_"), part(9), F.lit("_"), part(4), F.lit("_"), key))
    name = name.otherwise(F.concat(F.lit("v"), part(7), F.lit("."), part(11), F.lit("."), key))
    rows = read(spark, sf_dir, "customer").select(k.alias("k"), name.alias("name"), F.sha1("c_name").alias("commit"), (k == 17).alias("is_default"))
    return rows.select("*", F.concat(F.lit("refs/heads/"), "name").alias("full_name"))


@register("release_order", "name:string before:string", r"""select name, lag(name) over (order by k = 17 desc, numbers is null, numbers, name) as before from
 (select *, case when name not like 'topic%' then list_transform(regexp_extract_all(name, '\d+'), lambda n: n::BIGINT) end as numbers from """ + _REFS + ")")
def _(spark, sf_dir):
    order = history.version_order("is_default", "name", "full_name")
    return refs(spark, sf_dir).select("name", F.lag("name").over(Window.orderBy(*order)).alias("before"))  # a listing of names


@register("selector_resolution", "selector:string commit:string", f"""select * from (select name as selector, commit_id as "commit" from {_REFS} where k % 4 = 0 union all select 'refs/heads/' || name, commit_id from {_REFS} where k % 4 = 1
 union all select commit_id, case when k % 8 = 2 then commit_id end from {_REFS} where k % 4 = 2 union all select 'none' || k, null from {_REFS} where k % 4 = 3)""")
def _(spark, sf_dir):
    r = refs(spark, sf_dir)
    n = F.col("k") % 4
    selector = F.when(n == 0, F.col("name")).when(n == 1, F.col("full_name")).when(n == 2, F.col("commit")).otherwise(F.concat(F.lit("none"), F.col("k").cast("string")))
    return history.resolved(r.select(selector.alias("selector")), r, r.where("k % 8 = 2").select(F.lit("t").alias("tip"), "commit"))


@register("version_listing", "name:string prepared:boolean", f"select name, k % 4 = 0 as prepared from {_REFS} where k % 3 in (0, 1) and k % 2 = 0 and name like 'v1%'")
def _(spark, sf_dir):
    r = refs(spark, sf_dir).withColumn("repository", F.concat(F.lit("r"), (F.col("k") % 3).cast("string"))).withColumn("kind", F.when(F.col("k") % 2 == 0, "tag").otherwise("branch"))
    return store.listed_versions(r, r.where("k % 4 = 0").select("repository", "commit"), ["r0", "r1"], ["tag"], "v1")


@register("history_tips", "commit:string", f"""select distinct commit_id as "commit" from {_REFS}""")
def _(spark, sf_dir):
    r = refs(spark, sf_dir)
    return history.tips(r.unionByName(r))


# --- contracts and feedback -----------------------------------------------------


def nation_facets(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("facet_id"), F.col("n_regionkey").cast("string").alias("repository"), F.lit("s").alias("stage"), F.when(F.col("n_nationkey") % 2 == 0, "e").alias("era"))


_QUALIFIES = "(select c_custkey, c_nationkey from customer join nation on c_nationkey = n_nationkey where c_custkey % 7 <> 0 and c_custkey % 5 <> 0 and (n_nationkey % 2 = 1 or c_custkey % 3 = 0))"


def customer_evidence(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        k.alias("evidence_id"), F.col("c_nationkey").alias("facet_id"), F.when(k % 5 == 0, "none").otherwise(F.col("n_regionkey").cast("string")).alias("repository"),
        F.lit("s").alias("stage"), F.when(k % 3 == 0, "e").otherwise("other").alias("revision"), (k % 7 == 0).alias("adjacent"), F.col("c_acctbal"),
    )


@register("answer_validation", "facet_id:bigint", f"select n_nationkey as facet_id from nation where n_nationkey not in (select c_nationkey from {_QUALIFIES} where c_custkey in (select c_custkey from customer where c_acctbal > 9600))")
def _(spark, sf_dir):
    evidence = customer_evidence(spark, sf_dir)
    return investigate.uncited(nation_facets(spark, sf_dir), evidence, evidence.where("c_acctbal > 9600").select("evidence_id"))


@register("evidence_verdicts", "evidence_id:bigint verdict:string", """select c_custkey as evidence_id, case when c_custkey % 7 = 0 then 'adjacent' when c_custkey % 5 = 0 then 'wrong_repository'
 when n_nationkey % 2 = 0 and c_custkey % 3 <> 0 then 'wrong_era' else 'qualifying' end as verdict from customer join nation on c_nationkey = n_nationkey""")
def _(spark, sf_dir):
    return investigate.classified(customer_evidence(spark, sf_dir), nation_facets(spark, sf_dir))


@register("contract_extension", "facet_id:bigint change:string", """select facet_id, case when facet_id >= 100 then 'new' when facet_id % 4 = 0 then 'conflict' else 'kept' end as change from
 (select n_nationkey as facet_id from nation union all select n_nationkey + 100 from nation where n_nationkey % 3 = 0)""")
def _(spark, sf_dir):
    facets = nation_facets(spark, sf_dir)
    more = facets.where("facet_id % 2 = 0").withColumn("stage", F.when(F.col("facet_id") % 4 == 0, "t").otherwise("s"))
    return investigate.extended(facets, more.unionByName(facets.where("facet_id % 3 = 0").withColumn("facet_id", F.col("facet_id") + 100)))


@register("provenance_sound", "c_custkey:bigint", "select c_custkey from customer where c_custkey % 4 <> 0 and c_custkey % 3 <> 1")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    path = F.when(k % 4 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 4 == 2, 1).alias("lexical_rank"), F.when(k % 4 == 3, F.when(k % 3 == 1, 0).otherwise(2)).alias("semantic_rank"),
        path.alias("graph_path"), (F.size(path) + F.when(k % 3 == 1, 1).otherwise(0)).alias("hops"),
    )
    return investigate.sound_provenance(rows)


def records(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.cast("string").alias("record_id"), F.when(k % 3 == 0, (k - 1).cast("string")).alias("supersedes"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("covered"))


@register("feedback_active", "record_id:string", "select o_orderkey::VARCHAR as record_id from orders where o_orderkey % 5 <> 0 and o_orderkey not in (select o_orderkey - 1 from orders where o_orderkey % 3 = 0)")
def _(spark, sf_dir):
    return search.active(records(spark, sf_dir))


@register("feedback_insert", "record_id:string covered:boolean", "select o_orderkey::VARCHAR as record_id, case when o_orderkey % 5 = 0 then true when o_orderkey % 5 = 1 then false end as covered from orders union all select 'n' || o_orderkey, null from orders where o_orderkey % 10 = 7")
def _(spark, sf_dir):
    held = records(spark, sf_dir)
    again = held.where("record_id % 10 = 7").withColumn("covered", F.lit(True)).withColumn("supersedes", F.lit("x"))
    fresh = again.select(F.concat(F.lit("n"), "record_id").alias("record_id"), F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("boolean").alias("covered"))
    return search.inserted(held, again.unionByName(fresh), capacity=1 << 40)


@register("feedback_covered", "record_id:string covered:boolean", "select o_orderkey::VARCHAR as record_id, o_orderkey % 5 = 0 or o_orderkey = 7 as covered from orders")
def _(spark, sf_dir):
    return search.covered(records(spark, sf_dir), "7")


@register("correction_currency", "record_id:bigint current:boolean", "select o_custkey as record_id, bool_and(o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0) as current from orders group by o_custkey")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    claims = o.groupBy(F.col("o_custkey").alias("record_id")).agg(F.collect_list(F.struct(key.alias("uri"), F.sha2(key, 256).alias("digest"))).alias("evidence"))
    now = o.where("o_orderkey % 11 <> 0").select(key.alias("uri"), F.when(F.col("o_orderkey") % 13 == 0, "changed").otherwise(F.sha2(key, 256)).alias("digest"))
    return search.current(claims, now)


@register("correction_annotation", "rank:bigint corrections:string", """select o_orderkey as rank, array_to_string(list_sort(list_distinct(list_concat(case when o_custkey % 4 = 0 then ['k' || o_custkey] else [] end,
 case when o_orderkey % 8 = 0 and o_orderkey // 2 in (select c_custkey from customer) then ['k' || (o_orderkey // 2)] else [] end))), '|') as corrections from orders""")
def _(spark, sf_dir):
    label = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    results = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rank"), label("c", F.col("o_orderkey")).alias("chunk_id"), label("d", F.col("o_custkey")).alias("document_id"))
    k = F.col("c_custkey")
    fixes = read(spark, sf_dir, "customer").where(k % 4 == 0).select(label("k", k).alias("record_id"), F.array(label("d", k), label("c", 2 * k)).alias("affected"))
    return search.annotated(results, fixes, ["chunk_id", "document_id"]).withColumn("corrections", F.array_join("corrections", "|"))


@register("correction_replay", "id:bigint matched:boolean", "select c_custkey as id, c_custkey in (select o_custkey from orders where o_totalprice > 200000) or c_custkey in (select o_orderkey from orders where o_totalprice > 200000) as matched from customer")
def _(spark, sf_dir):
    found = read(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return search.replayed(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), found, ["o_custkey", "o_orderkey"])


@register("merged_notes", "rank:bigint id:bigint", "select rank, id from (select o_orderkey as id, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 7 union all select 7 + row_number() over (order by c_custkey), c_custkey from customer where c_custkey < 3")
def _(spark, sf_dir):
    place = F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    top = read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)  # a result page
    notes = read(spark, sf_dir, "customer").where("c_custkey < 3").select((F.col("c_custkey") + 1).alias("rank"), F.col("c_custkey").alias("id"))
    return search.merged(top.select(place.alias("rank"), F.col("o_orderkey").alias("id")), notes, 10)


# --- search over fields, windows, overlay ----------------------------------------

_FIELDS = {"title": "'doc ' || doc_id", "path": "lang || '/' || doc_id || '.txt'", "identifiers": "'id_' || doc_id", "body": "text", "tags": "lang"}


def field_index(spark, sf_dir):
    """The path of a written index of five fields of the documents, built when first asked for in a session."""

    def build(path):
        made = read(spark, sf_dir, "documents").select("doc_id", *[F.expr(x).alias(n) for n, x in _FIELDS.items()])
        lexical.write_index(made, "doc_id", list(_FIELDS), path)

    return kept_index(spark, sf_dir, "fields", build)


def fields_sql(query: str, limit: int, exact: str = "false") -> str:
    asked, more = lexical.boolean_terms(query)
    listed = ", ".join(f"{{'f': '{n}', 't': {_TOKENS.format(x)}}}" for n, x in _FIELDS.items())
    quoted = lambda terms: ", ".join(f"'{t}'" for t in terms)
    least = len(asked) if len(T.raw_terms_of(query)) <= 2 else 0
    return f"""with d as (select doc_id, unnest([{listed}]) as x from documents),
 l as (select x.f as f, count(*) as n, avg(len(x.t)) as mean from d group by 1),
 p as (select doc_id, x.f as f, len(x.t) as length, unnest(x.t) as term from d),
 c as (select doc_id, f, length, term, count(*) as tf from p where term in ({quoted([*asked, *more])}) group by all),
 g as (select f, term, count(*) as df from c group by all),
 s as (select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score,
  count(distinct term) filter (term in ({quoted(asked)})) as coverage from c join g using (f, term) join l using (f) group by doc_id)
 select doc_id, coalesce(coverage, 0) as coverage, coalesce(score, 0) as score from s full join (select doc_id, true as same from documents where {exact}) using (doc_id)
 where coverage >= {least} or same order by 3 desc, 1 limit {limit}"""


@register("field_search_all", "doc_id:bigint coverage:bigint score:double", fields_sql("with EN", 50))
def _(spark, sf_dir):
    return lexical.boolean_index(lexical.open_index(spark, field_index(spark, sf_dir)), "doc_id", "with EN", 50)


@register("field_search_any", "doc_id:bigint coverage:bigint score:double", fields_sql("persistence of this source", 100))
def _(spark, sf_dir):
    return lexical.boolean_index(lexical.open_index(spark, field_index(spark, sf_dir)), "doc_id", "persistence of this source", 100)


@register("field_search_exact", "doc_id:bigint coverage:bigint score:double", fields_sql("src3_en", 100, "source || '_' || lang = 'src3_en'"))
def _(spark, sf_dir):
    same = read(spark, sf_dir, "documents").where(F.concat_ws("_", "source", "lang") == "src3_en").select("doc_id")
    return lexical.boolean_index(lexical.open_index(spark, field_index(spark, sf_dir)), "doc_id", "src3_en", 100, exact=same)


@register("token_windows", "doc_id:bigint ordinal:int tokens:int digest:string", r"""with t as (select doc_id, regexp_extract_all(text, '[^ \t\n\r]+[ \t\n\r]*') as w, regexp_extract(text, '^[ \t\n\r]*') as lead from documents where text <> ''),
 k as (select *, unnest(range(0, greatest(1, (len(w) + 63) // 64))) as ordinal from t)
 select doc_id, ordinal, len(w[ordinal * 64 + 1 : ordinal * 64 + 64]) as tokens,
 sha256(case when ordinal = 0 then lead else '' end || array_to_string(w[ordinal * 64 + 1 : ordinal * 64 + 64], '')) as digest from k""")
def _(spark, sf_dir):
    return chunking.windowed(read(spark, sf_dir, "documents"), "doc_id", "text", 64).withColumn("digest", F.sha2("window", 256))


@register("feedback_overlay", "record_id:bigint kind:string score:double rank:int", f"""with s as {bm25_sql(TERMS, "doc_id % 5 <> 0 and doc_id not in (select doc_id - 1 from documents where doc_id % 3 = 0)")},
 c as ((select * from s order by score desc, doc_id limit 100) union (select * from s where coverage = 3 order by score desc, doc_id limit 100))
 select doc_id as record_id, case when doc_id % 2 = 0 then 'correction' else 'note' end as kind, score, row_number() over (order by coverage desc, score desc, doc_id) as rank
 from c where doc_id % 2 = 1 or (score >= 0.5 and doc_id % 4 = 0) order by rank limit 10""")
def _(spark, sf_dir):
    k = F.col("doc_id")
    proof = F.array(F.struct(k.cast("string").alias("uri"), F.sha2("text", 256).alias("digest")))
    kept = F.when(k % 3 == 0, k - 1).alias("supersedes")
    rows = read(spark, sf_dir, "documents").select(k.alias("record_id"), F.when(k % 2 == 0, "correction").otherwise("note").alias("kind"), "text", kept, (k % 5 == 0).alias("covered"), proof.alias("evidence"))
    now = read(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(k.cast("string").alias("uri"), F.sha2("text", 256).alias("digest"))
    return search.overlay(rows, " ".join(TERMS), 10, now)


_EMBEDDED = """case when source <> 'src1' then 'Title: ' || source || chr(10) else '' end || 'Headings: ' || lang || ' / ' || source || chr(10) || 'Identifiers: id_' || doc_id || chr(10)
 || case when doc_id % 2 = 0 then 'Tags: ' || lang || ', x' || chr(10) else '' end || 'Content: ' || text"""


@register("embedding_digests", "doc_id:bigint digest:string", f"select doc_id, sha256({_EMBEDDED}) as digest from documents")
def _(spark, sf_dir):
    k = F.col("doc_id")
    tags = F.when(k % 2 == 0, F.array("lang", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    title = F.when(F.col("source") != "src1", F.col("source"))
    made = T.embedding_text(title, F.array("lang", "source"), F.array(F.concat(F.lit("id_"), k.cast("string"))), tags, F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(made, 256).alias("digest"))


@register("typed_ids", "doc_id:bigint sound:boolean", "select doc_id, doc_id % 3 = 0 as sound from documents")
def _(spark, sf_dir):
    n, digest = F.col("doc_id") % 3, F.sha2("text", 256)
    value = F.when(n == 0, F.concat(F.lit("chunk-"), digest)).when(n == 1, F.concat(F.lit("chunk-"), F.upper(digest), F.lit("A"))).otherwise(F.concat(F.lit("doc-"), digest))
    return read(spark, sf_dir, "documents").select("doc_id", ids.is_typed_id(value, "chunk-").alias("sound"))


@register("symbol_anchors", "p_partkey:bigint anchor:int", "select p_partkey, case when p_partkey % 3 = 0 then null else 8 + length(p_name) end as anchor from part")
def _(spark, sf_dir):
    n, key = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    name = F.when(n == 0, "plain").when(n == 1, F.concat(F.lit("sym"), key)).otherwise(F.concat(F.lit("a_b"), key))
    text = F.concat(F.lit("xsym1z "), "p_name", F.lit(" "), name, F.lit(" rest"))
    asked = F.array(F.concat(F.lit("sym"), key))
    return read(spark, sf_dir, "part").select("p_partkey", (T.symbol_anchor(text, asked) - 1).alias("anchor"))


@register("reused_occurrences", "commit:bigint path:bigint blob:string", """select o_orderkey as "commit", o_custkey as path, o_orderstatus as blob from orders
 where (o_custkey, o_orderstatus) in (select (o_custkey, o_orderstatus) from orders where o_orderkey % 3 = 0)""")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    tree = o.select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("path"), F.col("o_orderstatus").alias("blob"))
    known = tree.where("commit % 3 = 0").select("path", "blob", F.sha2(F.concat_ws("/", "path", "blob"), 256).alias("content_key"))
    return history.reused_occurrences(tree, known)


@register("resumed_stage", "c_custkey:bigint c_name:string", "select c_custkey, c_name from customer where c_acctbal > 0")
def _(spark, sf_dir):
    kept = store.Store(spark, f"{store.scratch_dir(spark)}/corpusloom-stages")
    make = lambda: read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    contract = {"input": store.inventory(read(spark, sf_dir, "customer"), "c_custkey"), "filter": "c_acctbal > 0"}
    return kept.stage("customers", contract, make, "c_custkey")


@register("reranked_page", "query_id:bigint chunk_id:bigint place:int", """select * from (select c_nationkey as query_id, c_custkey as chunk_id,
 row_number() over (partition by c_nationkey order by length(c_name || c_mktsegment) desc, c_custkey) as place from customer) where place <= 5""")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("query_id"), F.lit("q").alias("query"), F.col("c_custkey").alias("chunk_id"), F.concat("c_name", "c_mktsegment").alias("text"), F.col("c_custkey").alias("rank"))
    return lookup.reranked(rows, lambda pairs: [float(len(text)) for _, text in pairs], 5)
