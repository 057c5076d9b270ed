"""Near-duplicate groups by SimHash with bit-sliced comparison.

A text's fingerprint comes from its word shingles (A-Z lower-cased, words are runs of other than ASCII
white space): a bit is set if more than half of the shingles' XXH64 hashes (seed 42) have it. Different
fingerprints within the radius are linked. Two fingerprints within radius r agree on whole blocks of
bits: of b blocks at least b - r are equal, so each choice of b - r blocks is a table whose equal keys
hold all links; keys get longer with the number of fingerprints, so that blocks stay small. Within a
key's block of rows the fingerprints stand as vertical bit planes (one long integer a bit); shifting the
planes against themselves compares every row with the one s places on, and carry-save counters add the
differing bits of all lanes at once until all lanes exceed the radius.

Blocks never leave as pairs of copies: the search by radius yields a spanning forest of each block's
links. Blocks over `tile` rows are cut into tiles and every two tiles meet in a task of their own, so no
block is whole in one task. Edges meet in connected components (hooking to the smallest neighbour and
pointer jumping, with tables written in between). Only different fingerprints take part; copies of one
text add nothing but their smallest doc_id. Joins deal out hot keys by salt.

The search by similarity (the pipeline's) compares 256-bit SimHashes of five-word shingles in the same
way; its candidates share a MinHash band, because windows of a SimHash lose too many pairs at 0.8. What
the SimHash leaves must also pass a bound by bitmaps of the sets, which no link fails, and each link is
verified on the whole sets of shingle hashes.

Cases: null and empty texts have fingerprint zero (by similarity: the empty shingle), linked like any other.
Texts of any length are hashed whole, shingle hashes in slices. A null doc_id is a row like any other but
never a component's id unless all its ids are null. Repeated rows come back as often as they came. An
empty table gives an empty result. Ties (equal ids) go to the smaller text digest. Other columns are not
read, and their names may be any; one_of_each returns them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

SEED = 42
#: 64-bit words of a wide fingerprint.
WIDE = 4
#: MinHash bands of the search by similarity, and values in each.
BANDS, ROWS = 20, 5
#: Sets of fewer shingles are compared whatever their fingerprints: a few votes are too coarse.
SMALL = 16
TILE = 2048
#: Bytes of a set's bitmap.
MAP = 256


def _hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the text (fewer words: of the whole sequence; none: nothing)."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, words: int = 4) -> int:
    hashes = _hashes(text, words)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text without words has that of the empty string."""
    found = _hashes(text, words)
    return np.unique(found) if len(found) else np.array([xxh64_intdigest(b"", SEED)], np.uint64)


_RNG = np.random.default_rng(SEED)
_WORDS = _RNG.integers(0, 1 << 64, (3, 1, WIDE), np.uint64)
_MIX = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of 64 * WIDE bits over distinct shingles, as 64-bit words: the share of equal bits is 1 - angle / pi."""
    ones = np.zeros(64 * WIDE, np.int64)
    for lo in range(0, len(hashes), 1 << 12):
        x = (hashes[lo : lo + (1 << 12), None] ^ _WORDS[0]) * (_WORDS[1] | np.uint64(1))
        x = (x ^ (x >> np.uint64(31))) * (_WORDS[2] | np.uint64(1))
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS keys of ROWS MinHash values each: two sets of similarity s share one with probability 1 - (1 - s ** ROWS) ** BANDS."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(hashes), 1 << 10):
        least = np.minimum(least, ((hashes[lo : lo + (1 << 10)] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))).min(1))
    raw, size = least.tobytes(), 8 * ROWS
    return [k - (1 << 64) if (k := xxh64_intdigest(raw[i * size : (i + 1) * size], i)) >> 63 else k for i in range(BANDS)]


def bitmap(hashes: np.ndarray) -> bytes:
    """Bit h mod 8 * MAP for each hash h. Sets whose bitmaps differ in d bits have at most (|A| + |B| - d) / 2 common members."""
    bits = np.zeros(8 * MAP, np.uint8)
    bits[hashes % np.uint64(8 * MAP)] = 1
    return np.packbits(bits).tobytes()


def wide_fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """Per row: doc_id, node (the text's digest), n distinct shingles, fp (64-bit words), map (bitmap), keys (of MinHash bands)."""

    def start():
        def work(columns):
            sets = [shingles(t, words) for t in columns[2]]
            made = [(len(h), wide_fingerprint(h).tolist(), bitmap(h), band_keys(h)) for h in sets]
            return [columns[0], columns[1], *map(list, zip(*made, strict=True))]

        return work

    ddl = "doc_id bigint, node binary, n bigint, fp array<bigint>, map binary, keys array<bigint>"
    rows = docs.select("doc_id", _node().alias("node"), "text")
    return common.map_text(rows, ["doc_id", "node", "text"], ddl, start)


def _node():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """Per row: doc_id and fp, the fingerprint as a signed 64-bit number."""

    def start():
        def work(columns):
            return [columns[0], [f - (1 << 64) if (f := fingerprint(t, words)) >> 63 else f for t in columns[1]]]

        return work

    return common.map_text(docs, ["doc_id", "text"], "doc_id bigint, fp bigint", start)


def block_tables(bits: int, radius: int, spare: int) -> list[int]:
    """Masks of whole blocks such that two numbers within the radius agree on all bits of at least one mask."""
    blocks = radius + spare
    cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), spare)]


def planes(values: np.ndarray) -> list[int]:
    """One integer for each bit: bit i of plane b is bit b of row i. values: rows of unsigned 64-bit words."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little")
    return [int.from_bytes(packed[:, b].tobytes(), "little") for b in range(packed.shape[1])]


def within(rows: list[int], shift: int, lanes: int, radius: int) -> int:
    """Lanes i (of the mask `lanes`) whose values i and i + shift differ in at most `radius` bits.

    Carry-save: counts[k] holds bit k of each lane's count of differing bits; `over` keeps what has passed
    the counters. The block is left as soon as all its lanes exceed the radius.
    """
    counts, over = [0] * radius.bit_length(), 0
    for b, plane in enumerate(rows):
        carry = (plane ^ (plane >> shift)) & lanes
        for k, held in enumerate(counts):
            if not carry:
                break
            counts[k] = held ^ carry
            carry &= held
        over |= carry
        if b % 8 == 7 and b >= radius and (over | _above(counts, radius)) & lanes == lanes:
            return 0
    return lanes & ~(over | _above(counts, radius))


def _above(counts: list[int], radius: int) -> int:
    """Lanes whose count is above the radius."""
    above, equal = 0, -1
    for k in range(len(counts) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counts[k]
        else:
            above |= equal & counts[k]
            equal &= ~counts[k]
    return above


def _places(lanes: int, n: int) -> np.ndarray:
    raw = np.frombuffer(lanes.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")[:n])


def forest(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (rows, from each component's first) of the links within each group; equal groups stand together."""
    n = len(values)
    parent = np.arange(n)
    if n < 2:
        return parent[:0], parent[:0]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(starts, n))
    left = np.repeat(starts + size, size) - np.arange(n)  # rows of the same group from here on
    long = int(size.max())
    held = planes(values)
    for shift in range(1, long):
        ok = left > shift
        lanes = int.from_bytes(np.packbits(ok, bitorder="little").tobytes(), "little")
        if not lanes:
            break
        hits = within(held, shift, lanes, radius)
        if hits:
            a = _places(hits, n)
            parent = _join(parent, a, a + shift)
    moved = np.flatnonzero(parent != np.arange(n))
    return parent[moved], moved


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of a[i] and b[i]: all hook to the smaller label until none differ."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def near_rows(values: np.ndarray, group: np.ndarray, radius: int, always: np.ndarray):
    """Arrays a, b, one pair of them a shift: all rows a < b of one group within the radius, or both `always`; equal groups stand together."""
    n = len(values)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(starts, n))
    left = np.repeat(starts + size, size) - np.arange(n)
    held = planes(values)
    small = int.from_bytes(np.packbits(always, bitorder="little").tobytes(), "little")
    for shift in range(1, int(size.max(initial=0))):
        lanes = int.from_bytes(np.packbits(left > shift, bitorder="little").tobytes(), "little")
        if hits := within(held, shift, lanes, radius) | (small & (small >> shift) & lanes):
            a = _places(hits, n)
            yield a, a + shift


def links(fps: DataFrame, radius: int = 4, spare: int | None = None, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of different 64-bit `fp` within the radius. fps: distinct fp (bigint).

    spare: blocks that a key takes; by default as many as give the keys of n fingerprints log2(n) - 6 bits, so that blocks hold a few dozen rows.
    """
    if spare is None:
        need = math.log2(max(2, fps.count())) - 6
        spare = next(s for s in range(2, 9) if s == 8 or 64 * s // (radius + s) >= need)
    masks = [m - (1 << 64) if m >> 63 else m for m in block_tables(64, radius, spare)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = common.skew_join(keyed, sizes, ["t", "key"])
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), tiles).cast("int")
    # a row of tile i goes to the meetings (i, j) of all j: each two tiles meet once
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    spread = met.select("fp", "t", "key", tiles.alias("tiles"), mine.alias("mine")).select("fp", "t", "key", "mine", other.alias("other"))
    placed = spread.select("fp", F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"))

    def joined(rows: pa.Table) -> tuple:
        fp = rows.column("fp").combine_chunks()
        values = fp.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
        a, b = forest(values, rows.column("block").to_numpy(), radius)
        return fp.take(pa.array(a)), fp.take(pa.array(b))

    # each fingerprint has an edge to the first one of every block that it is in; led through the smallest of them,
    # the rest become edges between firsts, which the members of a large group share
    forests = common.written(_in_blocks(placed, "a bigint, b bigint", joined, tile), "forests")
    lowest = forests.groupBy("b").agg(F.min("a").alias("m"))
    between = forests.join(lowest, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    return between.union(lowest.select(F.col("m").alias("a"), "b")).distinct()


def _in_blocks(rows: DataFrame, ddl: str, work, tile: int) -> DataFrame:
    """work(table of whole blocks) gives the columns of `ddl`, for rows that meet by `block`; a task holds about 16 tiles at a time."""
    schema = common.schema_of(ddl)
    common.bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.arrow_schema(schema)
        held: list[pa.RecordBatch] = []
        count = 0

        def made(whole: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(work(whole), out, strict=True)], schema=out)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 16 * tile:
                table = pa.Table.from_batches(held)
                block = table.column("block").to_numpy()
                apart = np.flatnonzero(block != block[-1])  # the last block may go on in the next batch
                if len(apart):
                    yield made(table.slice(0, int(apart[-1]) + 1))
                    table = table.slice(int(apart[-1]) + 1)
                held, count = table.to_batches(), table.num_rows
        if count:
            yield made(pa.Table.from_batches(held))

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    Each round every root hooks to the smallest root that an edge of its members leads to, then labels
    jump to their root's root; rounds grow as the logarithm of the longest chain. All in joins on written
    tables, each deleted when the next has been written.
    """
    spark = edges.sparkSession
    both = common.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges", keep=True)
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels", keep=True)

    def replaced(made: DataFrame) -> DataFrame:
        found = common.written(made, "labels", keep=True)
        for path in {f.rpartition("/")[0] for f in labels.inputFiles()}:
            common.delete_path(spark, path)
        return found

    while True:
        # pointer jumping to the end of what is known: only roots that have a smaller root take part
        tops = labels.join(labels.select(F.col("root").alias("node")).distinct(), "node", "left_semi").where("root <> node")
        tops = common.written(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "tops")
        if tops.limit(1).count():
            labels = replaced(common.skew_join(labels, tops, ["root"], "left").select("node", F.coalesce("top", "root").alias("root")))
            continue
        near = common.skew_join(both, labels.select(F.col("node").alias("b"), F.col("root").alias("low")), ["b"]).select("a", "low")
        hooks = (
            near.groupBy("a").agg(F.min("low").alias("low")).join(labels.withColumnRenamed("node", "a"), "a").where("low < root")
            .groupBy("root").agg(F.min("low").alias("low"))
        )
        hooks = common.written(hooks, "hooks")
        if not hooks.limit(1).count():
            return labels
        labels = replaced(common.skew_join(labels, hooks, ["root"], "left").select("node", F.coalesce("low", "root").alias("root")))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id of all texts that links reach."""
    prints = common.written(fingerprints(docs, words), "prints")
    firsts = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(links(firsts.select("fp"), radius)).withColumnRenamed("node", "fp")
    known = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    known = common.written(known, "known")
    lowest = common.skew_join(known, known.groupBy("root").agg(F.min("first").alias("component_id")), ["root"]).select("fp", "component_id")
    grouped = common.skew_join(prints, lowest, ["fp"])
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates_by_similarity(docs: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = TILE) -> DataFrame:
    """Per row: doc_id, node (the text's digest), component_id, kept, by links of texts whose sets of word shingles have a Jaccard
    similarity of `similarity` or more. kept: the row (and copies of it) that stays if one of each component does.

    Candidates share a MinHash band (at 0.8 all but four pairs in 10,000 do); each link is verified on the whole sets of
    shingle hashes. First each text meets the most central one of its blocks, so that a large group becomes one
    component in as many pairs as it has members. Then bit-sliced comparison of the wide fingerprints finds, in blocks
    that still have several components, the pairs of different components within screen() bits whose bitmaps allow a
    link: in one round each text's most promising partner, which leaves few components, in the last one all of them.
    Rows of a block's largest component meet only the other rows, so a few strangers in a large group cost their number
    times its size.
    """
    prints = common.written(wide_fingerprints(docs, words), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    firsts = prints.groupBy("node").agg(first.alias("first"), F.min(F.struct("n", "fp", "map", "keys")).alias("x"))
    firsts = common.written(firsts.select("node", "first", "x.*"), "firsts")
    keyed = firsts.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = common.written(common.skew_join(keyed, sizes, ["key"]), "met")

    central = met.groupBy("node").agg(F.sum("size").alias("weight"))
    tops = met.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top"))
    stars = common.skew_join(met, tops, ["key"]).where("node <> top.node").groupBy("node").agg(F.max("top").alias("top"))
    near = verified(stars.select(F.col("node").alias("a"), F.col("top.node").alias("b")), firsts, docs, words, similarity)

    roots = components(near)
    for all_pairs in (False, True):
        known = common.written(met.join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root")), "known")
        near = near.unionByName(verified(_screened(known, firsts, similarity, tile, all_pairs), firsts, docs, words, similarity))
        roots = components(near)
    placed = common.written(firsts.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "placed")
    lowest = placed.groupBy("root").agg(F.min(F.struct("first", "node")).alias("low"))
    lowest = common.skew_join(placed.select("node", "root"), lowest, ["root"]).select("node", "low")
    rows = common.skew_join(prints.select("doc_id", "node"), lowest, ["node"])
    kept = F.col("doc_id").eqNullSafe(F.col("low.first.id")) & (F.col("node") == F.col("low.node"))
    return rows.select("doc_id", "node", F.col("low.first.id").alias("component_id"), kept.alias("kept"))


def screen(similarity: float) -> int:
    """Differing bits of wide fingerprints that sets of this Jaccard similarity exceed with less than one chance in a million."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WIDE
    return math.ceil(bits * share + 5 * math.sqrt(bits * share * (1 - share)))


def _screened(known: DataFrame, firsts: DataFrame, similarity: float, tile: int, all_pairs: bool) -> DataFrame:
    """Pairs (a, b) of nodes of different roots within a key that may be similar; known: node, key, root.

    Not all_pairs: of each node outside its block's largest component, only the pair whose bitmaps differ least.
    """
    sides = known.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("big"), F.sum("n").alias("all"), F.count("*").alias("kinds"))
    blocks = sides.where("kinds > 1").select("key", F.col("big.root").alias("big"), F.col("big.n").alias("bigs"), (F.col("all") - F.col("big.n")).alias("others"))
    rows = common.skew_join(known, blocks, ["key"])
    own = F.col("root") == F.col("big")
    tiles_b, tiles_o = (F.ceil(F.col(c) / F.lit(tile)).cast("int") for c in ("bigs", "others"))
    i = F.pmod(F.xxhash64("node"), F.when(own, tiles_b).otherwise(tiles_o)).cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    meeting = lambda kind, a, b: F.xxhash64("key", F.lit(kind), a, b)
    among = F.transform(span(F.col("tiles_o")), lambda j: meeting(0, F.least("i", j), F.greatest("i", j)))
    across = F.transform(span(F.col("tiles_b")), lambda j: meeting(1, F.col("i"), j))
    reached = F.transform(span(F.col("tiles_o")), lambda j: meeting(1, j, F.col("i")))
    rows = rows.select("node", "root", "key", own.alias("own"), i.alias("i"), tiles_b.alias("tiles_b"), tiles_o.alias("tiles_o"))
    rows = rows.join(firsts.select("node", "n", "fp", "map"), "node")
    rows = rows.select("node", "root", "own", "n", "fp", "map", F.explode(F.when(F.col("own"), reached).otherwise(F.concat(among, across))).alias("block"))
    radius = screen(similarity)

    def pairs(table: pa.Table) -> tuple:
        node, root, n = table.column("node").combine_chunks(), table.column("root").to_pylist(), table.column("n").to_numpy()
        names = dict.fromkeys(root)
        root = np.fromiter(map({r: k for k, r in enumerate(names)}.__getitem__, root), np.int64, len(root))
        other = ~table.column("own").to_numpy().astype(bool)
        fp = table.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WIDE)
        maps = np.frombuffer(b"".join(table.column("map").to_pylist()), np.uint64).reshape(len(node), -1)
        least, partner = np.full(len(node), np.inf), np.zeros(len(node), np.int64)
        out = [np.zeros((2, 0), np.int64)]
        for a, b in near_rows(fp, table.column("block").to_numpy(), radius, n < SMALL):
            keep = (root[a] != root[b]) & (other[a] | other[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]))
            a, b = a[keep], b[keep]
            both = n[a] + n[b]
            apart = np.bitwise_count(maps[a] ^ maps[b]).sum(1, dtype=np.int64)
            most = (both - apart) // 2  # common members at most
            keep = most >= similarity * (both - most)
            a, b, share = a[keep], b[keep], (apart / both)[keep]
            if all_pairs:
                out.append(np.stack([a, b]))
                continue
            for x, y in ((a, b), (b, a)):  # within a shift each row stands once on either side
                nearer = share < least[x]
                least[x[nearer]], partner[x[nearer]] = share[nearer], y[nearer]
        if not all_pairs:
            a = np.flatnonzero(other & (least < np.inf))
            out, share = [np.stack([a, partner[a]])], least[a]
        a, b = np.concatenate(out, 1)
        return node.take(pa.array(a)), node.take(pa.array(b)), pa.array(share if not all_pairs else np.zeros(len(a)))

    found = _in_blocks(rows, "a binary, b binary, share double", pairs, tile)
    if not all_pairs:
        found = found.groupBy("a").agg(F.min(F.struct("share", "b")).alias("x")).select("a", "x.b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have at least this Jaccard similarity, written."""
    pairs = common.written(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # one row a text: rows of a text are told apart by their ids, so that copies do not meet in one task
    wanted = nodes.join(firsts, "node").select("node", F.coalesce("first.id", F.lit(-1 << 63)).alias("id"))
    rows = docs.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), _node().alias("node"), "text")

    def start():
        return lambda columns: [columns[0], [shingles(t, words).view(np.int64) for t in columns[1]]]

    one = rows.join(wanted, ["id", "node"], "left_semi").dropDuplicates(["node"])
    sets = common.written(common.map_text(one, ["node", "text"], "node binary, s array<bigint>", start), "sets")
    left = common.skew_join(pairs, sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), ["a"])
    # the center of a large group is the b of many pairs
    limit = max(common.KEY_ROWS, pairs.count() // common.SHARE)
    many = pairs.groupBy("b").agg(F.count("*").alias("k")).where(F.col("k") > limit).select("b", F.ceil(F.col("k") / F.lit(limit)).cast("int").alias("salts"))
    many = common.written(many, "centers")  # at most SHARE rows
    salt = F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"), F.lit(0))
    left = left.join(F.broadcast(many), "b", "left").withColumn("salt", salt).drop("salts")
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb")).join(F.broadcast(many), "b", "left")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    common_ones = F.size(F.array_intersect("sa", "sb"))
    both = left.join(right, ["b", "salt"])
    return common.written(both.where(common_ones / (F.size("sa") + F.size("sb") - common_ones) >= similarity).select("a", "b"), "near")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are their group's kept one; of repeated rows one stays.

    groups: doc_id, node, kept of near_duplicates_by_similarity. A row goes by its id and text, not by its id alone:
    of two rows with one doc_id, one that is nobody's duplicate stays.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = groups.where("kept").groupBy(F.col("doc_id").alias("_kept_id"), F.col("node").alias("_kept_node")).agg(F.count("*").alias("_copies"))
    kept = common.written(kept, "kept")
    named = docs.select("*", _node().alias("_loom_node"))
    found = named.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_loom_node") == F.col("_kept_node")), "left_semi")
    if kept.where("_copies > 1").limit(1).count():
        found = found.dropDuplicates(["doc_id", "_loom_node"])
    return found.select(*names)
