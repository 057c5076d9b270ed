"""Document fingerprints: weighted SimHash of 128 bits, all in DataFrame functions.

Terms are pairs of neighbouring words (a text of one word: that word), weighted by their length; each
term's two XXH64 hashes vote for or against every bit with its weight. Votes for bits k and k + 32 are
summed in the two halves of one 64-bit number, so 64 sums hold the votes for 128 bits.

Block tables find fingerprints within a Hamming radius: the bits are cut into radius + 2 blocks; two
fingerprints within the radius agree on two blocks at least, so each two blocks, put first, make a table
in which all neighbours stand under equal keys.

Next documents are found within buckets of neighbouring doc_ids. Their bounds are approximate quantiles of
the ids, whatever these are; an id that takes more than one bucket (null, say) is split by its texts' hashes.

Cases: null and empty texts have one empty term. Equal texts have equal fingerprints. Texts of any length
are hashed whole, term by term. Rows with a null doc_id come before all others, rows with equal doc_id in
the order of their texts' hashes (equal rows, which may stand in any order, stay in one bucket). A single
row's next document is itself. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LANES = 0x0000000100000001
#: Rows of a bucket, on average, and the most buckets; their bounds are what the driver sees.
BUCKET_ROWS, BUCKETS = 2000, 1 << 15
RADIUS = 3


def words_of(text: Column) -> Column:
    return F.split(F.translate(text, "\n\r\t", "   "), " ")


def terms(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(1))
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), _pair)).otherwise(words)


def _pair(a: Column, b: Column) -> Column:
    return F.concat_ws(" ", a, b)


def votes(term: Column, weight: Column) -> list[Column]:
    """64 sums: the votes for bits k and k + 32 of either hash, in the halves of a number."""
    out = []
    for i, h in enumerate((F.xxhash64(term), F.xxhash64(term, F.lit(1)))):
        out += [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES)) * weight).alias(f"v{i}_{k}") for k in range(32)]
    return out


def bits(word: int, total: Column) -> Column:
    """The 64 bits with more votes for than against."""
    out = F.lit(0).cast("bigint")
    for k in range(32):
        v = F.col(f"v{word}_{k}")
        out = out.bitwiseOR(F.when(v.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > total, F.lit(1 << k)).otherwise(F.lit(0)))
        high = 1 << (k + 32)
        out = out.bitwiseOR(F.when(F.shiftrightunsigned(v, 32) * 2 > total, F.lit(high - (1 << 64) if k == 31 else high)).otherwise(F.lit(0)))
    return out


def fingerprinted(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys with f0 and f1, the two halves of the fingerprint of `text`; keys name each row.

    Where df is already dealt out by a part of the keys, nothing is shuffled.
    """
    each = df.select(*keys, words_of(F.col(text)).alias("words")).select(*keys, F.explode(terms(F.col("words"))).alias("term")).withColumn("weight", F.greatest(F.length("term"), F.lit(1)).cast("bigint"))
    summed = each.groupBy(*keys).agg(*votes(F.col("term"), F.col("weight")), F.sum("weight").alias("total"))
    return summed.select(*keys, bits(0, F.col("total")).alias("f0"), bits(1, F.col("total")).alias("f1"))


def hex_of(f0: str, f1: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint, f0, f1. Equal texts are worked on once."""
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = kept.withColumn("digest", F.sha2("text", 256))
    texts = hashed.groupBy("digest").agg(F.any_value("text").alias("text"))
    made = fingerprinted(texts, ["digest"], "text")
    return hashed.select("doc_id", "digest").join(made, "digest").select("doc_id", hex_of("f0", "f1").alias("fingerprint"), "f0", "f1")


def block_keys(f0: Column, f1: Column, radius: int) -> Column:
    """One key for each table: the two blocks that are put first, and which they are."""
    blocks = radius + 2
    cuts = [round(i * 128 / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    pairs = [masks[i] | masks[j] for i, j in combinations(range(blocks), 2)]
    part = lambda f, m: f.bitwiseAND(signed(m & (1 << 64) - 1))
    return F.array(*[F.xxhash64(F.lit(t), part(f0, m >> 64), part(f1, m)) for t, m in enumerate(pairs)])


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query_id, doc_id, distance): for each row of queries, all rows of prints within the radius; both have doc_id, f0, f1.

    Only different fingerprints meet in the tables; the copies join afterwards, so a large group of
    copies under one key costs its own size alone.
    """
    near = neighbours(prints, queries, radius)
    ids = queries.select(F.col("doc_id").alias("query_id"), F.col("f0").alias("q0"), F.col("f1").alias("q1"))
    return near.join(ids, ["q0", "q1"]).join(prints.select("doc_id", "f0", "f1"), ["f0", "f1"]).select("query_id", "doc_id", "distance")


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q0, q1, f0, f1, distance): each different fingerprint of queries and the different ones of prints within the radius.

    Hot keys of the tables are dealt out by salt.
    """
    left = queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct()
    right = prints.select("f0", "f1").distinct()
    q = left.select("q0", "q1", F.explode(block_keys(F.col("q0"), F.col("q1"), radius)).alias("key"))
    p = right.select("f0", "f1", F.explode(block_keys(F.col("f0"), F.col("f1"), radius)).alias("key"))
    far = distance(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1"))
    return common.skew_join(p, q, ["key"]).where(far <= radius).select("q0", "q1", "f0", "f1", far.alias("distance")).distinct()


def neighbour_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f0, f1, neighbours): how many rows of prints lie within the radius of each different fingerprint of queries, itself among them."""
    sizes = prints.groupBy("f0", "f1").agg(F.count("*").alias("rows"))
    near = neighbours(prints, queries, radius).join(sizes, ["f0", "f1"])
    counted = near.groupBy("q0", "q1").agg(F.sum("rows").alias("neighbours"))
    return counted.select(F.col("q0").alias("f0"), F.col("q1").alias("f1"), "neighbours")


def _constants(values, kind: str) -> Column:
    """An array of numbers as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def bucketed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) with place (of the id), bucket and tie, and each bucket's smallest place and tie: (bucket, place, tie).

    Buckets rise with (place, tie).
    """
    n, null = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    wanted = max(1, min(BUCKETS, n // BUCKET_ROWS))
    bounds = []
    if n > null:
        shares = _constants((i / wanted for i in range(wanted)), "double")
        bounds = docs.agg(F.percentile_approx("doc_id", shares, F.lit(10 * wanted + 100))).first()[0]
    starts = sorted(set(bounds))
    # an id that stands at several bounds has as many buckets of its own, by the hash of its texts; so have null ids
    parts = {v: k for v in starts if (k := bounds.count(v)) > 1} if len(starts) < len(bounds) else {}
    spread = max(1, round(wanted * null / max(1, n)))
    at = F.lit(0)
    table = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("place"), at.alias("at"))
    step = 1 << max(0, len(starts).bit_length() - 1)
    while step and starts:  # binary search: the number of starts that are not over the id
        further = F.col("at") + step
        over = (further <= len(starts)) & (F.get(_constants(starts, "bigint"), further - 1) <= F.col("place"))
        table = table.withColumn("at", F.when(over, further).otherwise(F.col("at")))
        step //= 2
    share = F.xxhash64("text") / F.lit(float(1 << 64)) + F.lit(0.5)
    many = F.when(F.col("place").isNull(), F.lit(spread))
    if parts:
        listed = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in parts.items())))
        many = many.otherwise(F.coalesce(F.try_element_at(listed, F.col("place").cast("string")).cast("int"), F.lit(1)))
    part = F.least(F.floor(share * many), many - 1) if parts or spread > 1 else F.lit(0)
    bucket = F.struct(F.when(F.col("place").isNull(), F.lit(-1)).otherwise(F.col("at")).alias("at"), F.coalesce(part, F.lit(0)).cast("int").alias("part"))
    tie = F.xxhash64("text") if parts or spread > 1 else F.lit(0).cast("bigint")
    rows = table.select("doc_id", "text", "place", bucket.alias("bucket"), tie.alias("tie"))
    heads = rows.groupBy("bucket").agg(F.min(F.struct("place", "tie")).alias("head")).select("bucket", "head.place", "head.tie")
    return rows, heads


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's text, in one shuffle of the texts.

    Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, f0, f1. Each bucket
    (see bucketed) also gets the first row of the next one as a guest, so that a window within the bucket sees every next document.
    """
    rows, heads = bucketed(docs)
    heads = common.written(heads, "heads")  # at most 2 * BUCKETS rows: each start's bucket, and the parts of ids with several
    around = Window.partitionBy(F.lit(0)).orderBy("bucket")
    everyone = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(everyone))  # the very first row visits the last bucket
    visits = heads.select(F.col("place").alias("head"), F.col("tie").alias("head_tie"), before.alias("visited"))
    rows = rows.join(F.broadcast(visits), F.col("place").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")), "left")
    own, guest = (F.struct(F.col(c).alias("bucket"), F.lit(g).alias("guest")) for c, g in (("bucket", False), ("visited", True)))
    rows = rows.withColumn("home", F.explode(F.when(F.col("visited").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    rows = rows.select("doc_id", "text", "place", "home.bucket", "home.guest", F.xxhash64("text").alias("tie"))
    order = Window.partitionBy("bucket").orderBy("guest", F.asc_nulls_first("place"), "tie")
    rows = rows.select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next"))
    n_chars = F.length("text")
    cut = F.floor(n_chars / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    rows = rows.select("bucket", "rn", "guest", "doc_id", n_chars.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))
    kept = ["bucket", "rn", "guest", "doc_id", "n_chars", "edited_sha256"]
    each = rows.select(*kept, F.explode(both).alias("x")).select(*kept, "x.which", "x.text")
    made = fingerprinted(each, [*kept, "which"], "text")
    own, other = F.col("which") == 0, F.col("which") == 1
    pair = made.groupBy(*kept).agg(
        *[F.max(F.when(w, F.col(f))).alias(a) for w, f, a in ((own, "f0", "f0"), (own, "f1", "f1"), (other, "f0", "e0"), (other, "f1", "e1"))]
    )
    after = Window.partitionBy("bucket").orderBy("rn")
    pair = pair.select("*", F.lead("f0").over(after).alias("n0"), F.lead("f1").over(after).alias("n1")).where(~F.col("guest"))
    likeness = lambda a, b: 1 - distance(F.col("f0"), F.col("f1"), F.col(a), F.col(b)) / F.lit(128.0)
    return pair.select(
        "doc_id", "n_chars", "edited_sha256", hex_of("f0", "f1").alias("fingerprint"), hex_of("e0", "e1").alias("edited_fingerprint"),
        likeness("e0", "e1").alias("near_edited"), likeness("n0", "n1").alias("near_next"), "f0", "f1",
    )


def with_neighbours(made: DataFrame, query: Column, radius: int = RADIUS) -> DataFrame:
    """edit_likeness's rows, without f0 and f1, with neighbours: for rows where `query` holds, how many rows have a fingerprint within the
    radius of theirs, by the block tables (null elsewhere)."""
    made = common.written(made, "fingerprints")
    found = neighbour_counts(made, made.where(query), radius)
    asked = common.skew_join(made.where(query), found, ["f0", "f1"])
    rest = made.where(~F.coalesce(query, F.lit(False))).withColumn("neighbours", F.lit(None).cast("bigint"))
    return asked.select(*made.columns, "neighbours").unionByName(rest).drop("f0", "f1")
