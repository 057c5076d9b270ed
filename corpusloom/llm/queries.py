"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, collocations, common, fingerprints, html_text, langid, media_jpeg, merkle, packing, simhash_dedup, suffix_dedup, token_counts, toxicity, warc


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    models = langid.fit(langid.labelled_sample(docs))
    return langid.identify(docs, models).withColumn("held_out", common.held_out(F.col("doc_id")))


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_jpeg.digests(media_jpeg.decoded(media_jpeg.store(common.table(spark, sf_dir, "documents"))))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edit_likeness(common.table(spark, sf_dir, "documents"))
    return fingerprints.with_neighbours(made, F.col("doc_id") % 50 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(toxicity.labelled_sample(docs, labels)))
    return scored.select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.to_json("spans").alias("spans")
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(common.table(spark, sf_dir, "pages")))
    sound = F.when(F.col("kind") == "record", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("quarantined gap in "), "archive")).cast("boolean"))
    return read.where(sound).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(common.table(spark, sf_dir, "pages"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip(common.table(spark, sf_dir, "documents"))


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(common.table(spark, sf_dir, "documents")).drop("spans")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(common.table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(common.table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_simhash_groups, op3_progressive_jpeg, op4_fingerprints, op5_toxicity,
        op6_packing, op7_token_counts, op8_warc, op9_main_text, op10_bpe_round_trip,
        op11_repeated_passages, op12_collocations, op13_merkle_manifest,
    )
}

#: Base-32 of a SHA-1: each five bits of its 160 are one character.
_BASE32 = """
list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_aggregate(list_transform(range(0, 5),
  lambda j: ((strpos('0123456789abcdef', substr(hex, 1 + (5 * i + j) // 4, 1)) - 1) >> (3 - (5 * i + j) % 4) & 1) << (4 - j)), 'sum')::BIGINT, 1)), 'string_agg', '')
"""

ORACLE_SQL = {
    "op8_warc": f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
r as (select hex, max(page_id) as response from p group by hex)
select page_id, strlen(html)::BIGINT as payload_bytes, {_BASE32} as payload_digest,
  case when response = page_id then 'response' else 'revisit' end as record_type,
  case when response = page_id then null else response end as refers_to
from p join r using (hex)
""",
    "op11_repeated_passages": """
with d as (select doc_id, row_number() over (order by doc_id nulls last) as place, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as x from documents),
starts as (select place, p, substr(x, 2 * p + 1, 200) as s from (select place, x, unnest(range(0, len(x) // 2 - 99)) as p from d)),
repeated as (select place, p from (select place, p, row_number() over (partition by md5_number(s) order by place, p) as nth from starts) where nth > 1),
marks as (select *, case when p <= lag(p) over (partition by place order by p) + 100 then 0 else 1 end as new from repeated),
spans as (select place, min(p) as a, max(p) + 100 as b from (select *, sum(new) over (partition by place order by p) as span from marks) group by place, span),
kept as (select place, substr(x, 2 * coalesce(lag(b) over w, 0) + 1, 2 * (a - coalesce(lag(b) over w, 0))) as piece, a as stand from spans join d using (place) window w as (partition by place order by a)
  union all select place, substr(x, 2 * coalesce(b, 0) + 1), 9223372036854775807 from d left join (select place, max(b) as b from spans group by place) using (place)),
whole as (select place, sha256(unhex(coalesce(string_agg(piece, '' order by stand), ''))) as kept_sha256 from kept group by place),
gone as (select place, sum(b - a)::BIGINT as n_removed, count(*) as n_spans from spans group by place)
select doc_id, strlen(text) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, kept_sha256 from d join whole using (place) left join gone using (place)
""",
    "op12_collocations": """
with pieces as (
  select lang, row_number() over () as piece, words from (
    select lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') as words from (
      select coalesce(lang, 'und') as lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p
      from documents)) where len(words) > 0),
places as (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from pieces, (select unnest([1, 2, 3, 4]) as k) where len(words) >= k),
f as (select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase, count(*) as f from places group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
candidates as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 30),
cuts as (select c.lang, c.phrase, c.k, c.a, c.w, c.cut, x.f as l, y.f as r, (2000000::HUGEINT * c.a) // (x.f + y.f) as score
  from (select *, unnest(range(1, k)) as cut from candidates) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.cut], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (select lang, array_to_string(w[i:i + size - 1], ' ') as phrase, max(a) as longer
  from (select *, unnest(range(1, k - size + 2)) as i from (select *, unnest(range(2, k)) as size from candidates where k > 2)) group by all),
kept as (select s.* from scored s left join longer using (lang, phrase) where longer is null or 100::HUGEINT * longer < 80::HUGEINT * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n::BIGINT as n, score::BIGINT as score from ranked join n using (lang) where rank <= 2000
""",
    "op13_merkle_manifest": """
with recursive
docs as (select doc_id, lang,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
  coalesce(strlen(text) || ':' || text, '-') as tail, n_chars,
  xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: list_concat([ord(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda x, y: case when y >= 0 then xor(x, y) when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end), 4294967295) as crc from documents),
leaves as (select *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) as leaf,
  sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || tail) as changed from docs),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, coalesce('=' || lang, '') as tree from leaves),
nodes as (
  select tree, 0 as level, idx, leaf as h from placed
  union all
  select tree, level + 1, idx // 2, sha256(string_agg(h, '' order by idx)) from (select *, count(*) over (partition by tree) as m from nodes) where m > 1 group by tree, level, idx // 2),
subroots as (select tree, h as subroot, row_number() over (order by tree) - 1 as idx from nodes n where level = (select max(level) from nodes x where x.tree = n.tree)),
tops as (
  select 0 as level, idx, subroot as h from subroots
  union all
  select level + 1, idx // 2, sha256(string_agg(h, '' order by idx)) from (select *, count(*) over () as m from tops) where m > 1 group by level, idx // 2),
levels as (select tree, max(level) as depth from nodes group by tree),
sides as (
  select p.doc_id, p.leaf, p.idx as leaf_idx, p.tree, n.level, n.h as beside, p.idx >> n.level & 1 as own from placed p join levels l using (tree)
    left join (select tree, level, idx, h from nodes) n on n.tree = p.tree and n.level < l.depth and n.idx = xor(p.idx >> n.level, 1)
  union all
  select p.doc_id, p.leaf, p.idx, p.tree, 1000 + t.level, t.h, s.idx >> t.level & 1 from placed p join subroots s using (tree) join tops t on t.idx = xor(s.idx >> t.level, 1)),
proofs as (select tree, leaf_idx as idx, sha256(coalesce(string_agg(beside, '' order by level), '')) as proof_sha256 from sides group by all),
steps as (
  select tree, idx, 0 as step, case when crc % 7 = 0 and doc_id is not null then changed else leaf end as h from placed
  union all
  select s.tree, s.idx, s.step + 1,
    case when x.beside is null then sha256(s.h) when x.own = 1 then sha256(x.beside || s.h) else sha256(s.h || x.beside) end
  from steps s join levels l using (tree) cross join (select max(level) as up from tops) u
    left join sides x on x.tree = s.tree and x.leaf_idx = s.idx and x.level = case when s.step < l.depth then s.step else 1000 + s.step - l.depth end
  where s.step < l.depth + u.up),
last as (select tree, idx, arg_max(h, step) as folded_root from steps group by all)
select p.doc_id, p.leaf, s.subroot, t.h as root, q.proof_sha256, f.folded_root, f.folded_root = t.h as verified
from placed p join subroots s using (tree) join proofs q on q.tree = p.tree and q.idx = p.idx join last f on f.tree = p.tree and f.idx = p.idx
  cross join (select h from tops order by level desc limit 1) t
""",
}
