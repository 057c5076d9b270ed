"""Removal of repeated passages: each byte covered by a string of LENGTH bytes that also starts earlier in the corpus.

The order of suffixes is found as in distributed difference-cover suffix sorting. A symbol is SYMBOL bytes; positions
whose symbol number modulo 3 is 1 or 2 are the sample. Triples of symbols at sample positions are sorted over the
cluster and named by their order; triples of names are sorted and named again, until a name stands for LENGTH bytes or
more. A position outside the sample is then ordered against any other by one or two symbols and the name of a sample
position behind them: lists A (remainders 0 and 1), B (0 and 2) and C (1 and 2) hold all comparisons. Suffixes
with the same first LENGTH bytes stand together in each list they share, so that comparing neighbours finds every
repeated string; the earliest of each stays.

The sort only gets what it has to decide. A winnowing anchor of a window is the window's least hash of `width` bytes,
leftmost; equal windows have equal anchors at equal places. Hence, exactly:
* windows whose anchor's hash occurs once in the corpus repeat nothing (hashes are counted; the repeated ones go to the
  tasks as a bitmap of fixed size, whose false positives cost time only);
* consecutive windows with one anchor form a piece, and of equal pieces (all their bytes) all but the earliest are repeated.
  Only the earliest takes part further, and only if its anchor has different pieces.
This is done with longer anchors on what is left (WIDTHS), and on nothing else.

Sorted are distinct triples of blocks of about BLOCK bytes, so that a string that many documents share is sent once a block.
Sorts are by ranges of whole keys; lists also by position, so that no string, however frequent, is in one task.

Cases: a null text is empty; nulls in doc_id come last; texts of one doc_id stand in the order of a hash of them; of equal rows one
comes first and the others, of LENGTH bytes or more, go whole. Texts may have any length: they're worked on in stretches.
An empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

LENGTH, WIDTHS = 100, (50, 90, 97)
SYMBOL, BLOCK = 12, 1 << 18
#: Bits of the bitmap of repeated anchors, hashes that one task counts, and half the bytes that are hashed at a time.
ANCHOR_BITS, ANCHORS, SPAN = 1 << 26, 4_000_000, 1 << 19
#: Windows whose anchors are found at a time: their arrays stay in a core's cache.
TILE = 1 << 16

_LAST = (1 << 63) - 1


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The hash of each `width` bytes of data; equal bytes, equal hashes."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    sums = hashing.sums(data)
    h = sums[width:] - sums[:-width]
    h *= hashing.powers(len(data))[1][: len(h)]
    return hashing.mixed(h)


def anchors(data: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` bytes: where its anchor starts; and all hashes. A tile's anchors hang on its own bytes alone."""
    windows = len(data) - length + 1
    if windows > TILE:
        at, h = np.empty(windows, np.int64), np.empty(len(data) - width + 1, np.uint64)
        for s in range(0, windows, TILE):
            part, own = anchors(data[s : s + TILE + length - 1], length, width)
            np.add(part, s, out=at[s : s + len(part)])
            h[s : s + len(own)] = own
        return at, h
    h, many = window_hashes(data, width), length - width + 1
    if len(data) < length:
        return np.zeros(0, np.int64), h
    low = np.uint64((1 << 24) - 1)
    least = h & ~low
    least |= np.arange(len(h), dtype=np.uint64)  # among equal hashes the leftmost
    reach = 1
    while 2 * reach <= many:  # the least of `reach` neighbours, twice as many each time
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < many:
        least = np.minimum(least[: reach - many], least[many - reach :])
    return (least & low).astype(np.int64), h


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts one after the other, and where each begins and ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends


def pieces(data: np.ndarray, ends: np.ndarray, length: int, width: int, wanted: np.ndarray | None = None):
    """(owner, first window, windows, anchor, its hash) of the pieces: consecutive windows of one text with one anchor, all of them wanted."""
    at, h = anchors(data, length, width)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    ok = np.ones(len(at), bool)
    for e in ends.tolist():  # a window that starts less than `length` bytes before its text's end goes beyond it
        ok[max(0, e - length + 1) : e] = False
    if wanted is not None:
        ok &= wanted[: len(at)]
    out, new = ~ok, ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | out[:-1]
    starts, cuts = np.flatnonzero(new), np.flatnonzero(new | out)
    stops = np.append(cuts, len(at))[np.searchsorted(cuts, starts, "right")]
    return np.searchsorted(ends, starts, "right"), starts, stops - starts, at[starts], h[at[starts]]


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [lo, hi) as disjoint ones in order; those that touch become one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    first = np.r_[True, lo[1:] > reach[:-1]]
    return lo[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(lo) - 1]]


def keyed(docs: DataFrame) -> DataFrame:
    """(id, tie, text, doc_id): a key that orders documents, and whole texts."""
    text, doc = F.coalesce("text", F.lit("")), F.col("doc_id").cast("bigint")
    return docs.select(F.coalesce(doc, F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"), doc.alias("doc_id"))


def spans_of_text(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[int], list[int], list[bytes]]]:
    """(ids, ties, bases, bytes) of the texts of a batch in groups of about SPAN bytes; longer texts in spans that overlap by length - 1."""
    ids, ties, bases, held, size = [], [], [], [], 0
    for i, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        raw = text.encode()
        for base in range(0, max(1, len(raw) - length + 1), SPAN):
            span = raw[base : base + SPAN + length - 1]
            if size + len(span) > 2 * SPAN:
                yield ids, ties, bases, held
                ids, ties, bases, held, size = [], [], [], [], 0
            ids.append(i)
            ties.append(tie)
            bases.append(base)
            held.append(span)
            size += len(span)
    if held:
        yield ids, ties, bases, held


STRETCH = "id bigint, tie bigint, base bigint, data binary, wanted binary"


def stretch_rows(out: pa.Schema, ids, ties, bases, data: np.ndarray, begs: np.ndarray, owner: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int) -> pa.RecordBatch:
    """Stretches of the bytes that the wanted windows (n of them from lo on) cover, and which windows these are."""
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, lo, 1)
    np.add.at(change, lo + n, -1)
    wanted = (np.cumsum(change[:-1]) > 0).astype(np.uint8)
    a, b = merged(lo + owner, lo + owner + n + length - 1)  # moved apart, so that texts side by side stay two
    k = np.searchsorted(begs + np.arange(len(begs)), a, "right") - 1
    columns: list[list] = [[], [], [], [], []]
    for k, a, b in zip(k.tolist(), (a - k).tolist(), (b - k).tolist(), strict=True):
        for s in range(a, max(a + 1, b - length + 1), BLOCK):
            e = min(b, s + BLOCK + length - 1)
            flags = wanted[s:e].copy()
            flags[e - s - length + 1 :] = 0
            for column, value in zip(columns, (ids[k], ties[k], int(bases[k] + s - begs[k]), data[s:e].tobytes(), flags.tobytes()), strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def repeated_stretches(docs: DataFrame, length: int, width: int) -> DataFrame:
    """The stretches of the texts (as keyed) whose windows may repeat: their anchors' hashes occur twice or more."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    schema = common.schema_of(STRETCH)
    out = common.arrow_schema(schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in common.pieces(batches, "text"):
            for _, _, _, texts in spans_of_text(batch, length):
                data, _, ends = joined(texts)
                yield pieces(data, ends, length, width)[4]

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / ((length - width + 1) / 2) / ANCHORS) + 1)
    sent = spark.sparkContext.broadcast(hashing.frequent(docs, hashes, 2, parts, ANCHOR_BITS))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            for ids, ties, bases, texts in spans_of_text(batch, length):
                data, begs, ends = joined(texts)
                owner, lo, n, _, h = pieces(data, ends, length, width)
                keep = hashing.has(sent.value, h)
                yield stretch_rows(out, ids, ties, bases, data, begs, owner[keep], lo[keep], n[keep], length)

    return common.written(docs.mapInArrow(chosen, schema), "stretches")


PIECE = "anchor bigint, digest binary, id bigint, tie bigint, base bigint, lo bigint, n int, settled boolean"


def stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ties, bases, bytes, beginnings, ends, wanted) of each slice of stretches."""
    for batch in common.pieces(batches, "data", 2 * SPAN):
        ids, ties, bases, texts, flags = (batch.column(c).to_pylist() for c in ("id", "tie", "base", "data", "wanted"))
        data, begs, ends = joined(texts)
        yield ids, ties, bases, data, begs, ends, np.frombuffer(b"".join(flags), np.uint8) > 0


def firsts(code: np.ndarray, doc: np.ndarray, tie: np.ndarray, lo: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of digest and place: which are the first of their digest, and which others stand at the very place of that first."""
    first = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
    if also is not None:
        first[1:] |= also[1:] != also[:-1]
    of = np.maximum.accumulate(np.where(first, np.arange(len(code)), 0))
    return first, ~first & (doc == doc[of]) & (tie == tie[of]) & (lo == lo[of])


def narrowed(stretches: DataFrame, length: int, width: int) -> tuple[DataFrame, DataFrame]:
    """What the sort has still to decide, as stretches; and the windows found to be repeated, (id, tie, lo, n)."""
    schema, marks = common.schema_of(PIECE), common.schema_of("id bigint, tie bigint, base bigint, lo bigint, n int, settled boolean")
    out, out_marks, kept = common.arrow_schema(schema), common.arrow_schema(marks), common.schema_of(STRETCH)
    out_kept = common.arrow_schema(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ties, bases, data, begs, ends, wanted in stretch_batches(batches):
            owner, lo, n, at, h = pieces(data, ends, length, width, wanted)
            raw = data.tobytes()
            digests = [hashlib.blake2b(b"%d " % o + raw[a:b], digest_size=16).digest() for o, a, b in zip((at - lo).tolist(), lo.tolist(), (lo + n + length - 1).tolist(), strict=True)]
            digest = pa.array(digests, pa.binary())
            doc, tie, base = (np.array(x, np.int64)[owner] for x in (ids, ties, bases))
            start, code = base + lo - begs[owner], digest.dictionary_encode().indices.to_numpy()
            order = np.lexsort((start, tie, doc, code))
            first, same = firsts(code[order], doc[order], tie[order], start[order])
            keep = ~same
            order, settled = order[keep], ~first[keep]
            columns = [h.view(np.int64)[order], digest.take(pa.array(order)), doc[order], tie[order], base[order], start[order], n[order].astype(np.int32), settled]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=out)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch's first and last anchor may have pieces elsewhere: theirs stay open, as does the first of equal ones in a batch
        for batch in batches:
            if not len(batch):
                continue
            anchor, doc, tie, base, lo, n = (batch.column(c).to_numpy() for c in ("anchor", "id", "tie", "base", "lo", "n"))
            code = batch.column("digest").dictionary_encode().indices.to_numpy()
            first, same = firsts(code, doc, tie, lo, also=anchor)
            group = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]])
            several = np.bincount(group, first) > 1
            several[[0, -1]] = True
            keep = np.where(first, several[group], ~same)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (doc, tie, base, lo, n)] + [pa.array(~first[keep])], schema=out_marks)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "data", 2 * SPAN):
            ids, ties, bases, texts = (batch.column(c).to_pylist() for c in ("id", "tie", "base", "data"))
            data, begs, _ = joined(texts)
            chosen = batch.column("open")
            owner = np.repeat(np.arange(len(ids)), pc.list_value_length(chosen).to_numpy())
            lo, n = (chosen.flatten().field(k).to_numpy() for k in (0, 1))
            yield stretch_rows(out_kept, ids, ties, bases, data, begs, owner, lo - np.array(bases, np.int64)[owner] + begs[owner], n.astype(np.int64), length)

    with common.scratch(stretches.sparkSession):
        cuts = common.written(stretches.mapInArrow(cut, schema), "pieces")
        order = ["anchor", "digest"]
        ordered = cuts.where(~F.col("settled")).drop("settled").repartitionByRange(*order).sortWithinPartitions(*order, "id", "tie", "lo")
        found = common.written(ordered.mapInArrow(decided, marks), "decided")
        known = cuts.where("settled").select("id", "tie", "lo", "n").unionByName(found.where("settled").select("id", "tie", "lo", "n"))
        known = common.written(known, "known", keep=True)
        left = found.where(~F.col("settled")).groupBy("id", "tie", "base").agg(F.collect_list(F.struct("lo", "n")).alias("open"))
        return common.written(stretches.drop("wanted").join(left, ["id", "tie", "base"]).mapInArrow(again, kept), "stretches", keep=True), known


def blocks(stretches: DataFrame) -> DataFrame:
    """The stretches packed into rows of about BLOCK bytes: bytes, wanted windows, and beginning, document and place of each stretch."""
    schema = common.schema_of("data binary, wanted binary, begs binary, ids binary, ties binary, bases binary")
    out = common.arrow_schema(schema)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        ids, ties, bases, texts, flags = zip(*held, strict=True)
        _, begs, _ = joined(list(texts))
        values = [b"".join(texts), b"".join(flags), *(np.array(x, np.int64).tobytes() for x in (begs, ids, ties, bases))]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "tie", "base", "data", "wanted")), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= BLOCK:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return common.written(stretches.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "blocks")


class Block:
    """One block in a task: its sample positions and, after each round of naming, their names.

    A round names only the sample positions that a wanted window's order can hang on.
    """

    def __init__(self, row: dict, symbol: int, length: int):
        self.raw = row["data"]
        self.data = np.frombuffer(self.raw, np.uint8)
        self.wanted = np.frombuffer(row["wanted"], np.uint8) > 0
        self.begs, self.ids, self.ties, self.bases = (np.frombuffer(row[c], np.int64) for c in ("begs", "ids", "ties", "bases"))
        p = np.arange(len(self.data))
        self.owner = np.searchsorted(self.begs, p, "right") - 1
        self.end = np.r_[self.begs[1:], len(self.data)][self.owner]
        self.kind = (p - self.begs[self.owner]) // symbol % 3
        self.names, self.widths = np.zeros(len(self.data), np.int64), [3 * symbol]
        while self.widths[-1] < length:
            self.widths.append(3 * self.widths[-1])
        needed = self.marked(np.flatnonzero(self.wanted), (0, symbol, 2 * symbol)) & (self.kind > 0)
        self.samples = [np.flatnonzero(needed)]
        for w in reversed(self.widths[:-1]):
            self.samples.insert(0, np.flatnonzero(self.marked(self.samples[0], (0, w, 2 * w))))

    def marked(self, at: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
        found = np.zeros(len(self.data), bool)
        for by in offsets:
            found[(at + by)[at + by < self.end[at]]] = True
        return found

    def ahead(self, at: np.ndarray, by: int) -> np.ndarray:
        """Names `by` bytes behind the positions, 0 beyond the end of a stretch."""
        inside = at + by < self.end[at]
        return np.where(inside, self.names[np.where(inside, at + by, 0)], 0)

    def triples(self, k: int) -> tuple[list[bytes], np.ndarray]:
        """The distinct triples of round k, of symbols in the first and of names later, and which of them each sample position has."""
        at = self.samples[k]
        if k == 0:
            table: dict[bytes, int] = {}
            raw, w = self.raw, self.widths[0]
            which = [table.setdefault(raw[a : min(a + w, e)], len(table)) for a, e in zip(at.tolist(), self.end[at].tolist(), strict=True)]
            return list(table), np.array(which, np.int64)
        w = self.widths[k - 1]
        rows, which = np.unique(np.stack([self.names[at], self.ahead(at, w), self.ahead(at, 2 * w)], 1), axis=0, return_inverse=True)
        return [r.tobytes() for r in rows.astype(">i8")], which.ravel()

    def named(self, rounds: list[pa.Scalar]) -> Block:
        for k, found in enumerate(rounds):
            which = self.triples(k)[1]
            j, name = (found.values.field(f).to_numpy(zero_copy_only=False) for f in (0, 1))
            table = np.zeros(len(j), np.int64)
            table[j] = name
            self.names = np.zeros(len(self.data), np.int64)
            self.names[self.samples[k]] = table[which]
        return self


def each_block(batches: Iterator[pa.RecordBatch], symbol: int, length: int, rounds: list[str]) -> Iterator[tuple[int, Block]]:
    """(block, its content) with the names of the rounds in these columns."""
    for batch in batches:
        for k in range(len(batch)):
            row = {c: batch.column(c)[k].as_py() for c in ("block", "data", "wanted", "begs", "ids", "ties", "bases")}
            yield row["block"], Block(row, symbol, length).named([batch.column(c)[k] for c in rounds])


def names(triples: DataFrame) -> DataFrame:
    """(block, found): the place in the order of all distinct triples, for each triple j of a block. Names of equal triples are equal, and above 0."""
    schema = common.schema_of("block bigint, j int, name bigint")
    out = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = (TaskContext.get().partitionId() + 1) << 36, None
        for batch in batches:
            given = []
            for key in batch.column("triple").to_pylist():
                if key != last:
                    name, last = name + 1, key
                given.append(name)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("j"), pa.array(given, pa.int64())], schema=out)

    ordered = common.written(triples, "triples").repartitionByRange("triple").sortWithinPartitions("triple")
    return ordered.mapInArrow(run, schema).groupBy("block").agg(F.collect_list(F.struct("j", "name")).alias("found"))


def named_blocks(made: DataFrame, length: int, symbol: int) -> tuple[DataFrame, int]:
    """The blocks with the names of each round in columns r0, r1 and so on, the last of which stands for `length` bytes or more."""
    schema = common.schema_of("block bigint, j int, triple binary")
    out, done, width = common.arrow_schema(schema), 0, symbol
    while width < length:
        columns = [f"r{k}" for k in range(done)]

        def triples(batches: Iterator[pa.RecordBatch], columns=columns) -> Iterator[pa.RecordBatch]:
            for name, block in each_block(batches, symbol, length, columns):
                keys = block.triples(len(columns))[0]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.int64()), pa.array(range(len(keys)), pa.int32()), pa.array(keys, pa.binary())], schema=out)

        found = names(made.mapInArrow(triples, schema))
        made = common.written(made.join(found.withColumnRenamed("found", f"r{done}"), "block"), "named")
        done, width = done + 1, width * 3
    return made, done


LISTED = "list string, symbols binary, name bigint, digest binary, id bigint, tie bigint, lo bigint, repeated boolean"


def listed(made: DataFrame, rounds: int, length: int, symbol: int) -> DataFrame:
    """Each wanted window in the two lists of its remainder; of equal ones of a block's list the first, the others are known as repeated."""
    schema = common.schema_of(LISTED)
    out = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in each_block(batches, symbol, length, [f"r{k}" for k in range(rounds)]):
            at = np.flatnonzero(block.wanted)
            owner = block.owner[at]
            place = list(zip(block.ids[owner].tolist(), block.ties[owner].tolist(), (block.bases[owner] + at - block.begs[owner]).tolist(), strict=True))
            one, two, own = block.ahead(at, symbol).tolist(), block.ahead(at, 2 * symbol).tolist(), block.names[at].tolist()
            first, rows = {}, []
            for p, kind, where, a, b, c in zip(at.tolist(), block.kind[at].tolist(), place, one, two, own, strict=True):
                digest = hashlib.blake2b(block.raw[p : p + length], digest_size=16).digest()
                for name in ("AB", "AC", "BC")[kind]:
                    key = {"A": (block.raw[p : p + symbol], a), "B": (block.raw[p : p + 2 * symbol], b), "C": (b"", c)}[name]
                    new = (name, *key, digest, *where)
                    old = first.get((name, digest))
                    if old is None or new[4:] < old[4:]:
                        first[name, digest] = new
                    if old is not None and old[4:] != new[4:]:
                        rows.append((*max(old, new, key=lambda r: r[4:]), True))
            rows += [(*r, False) for r in first.values()]
            for s in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[s : s + 20_000], strict=True), out, strict=True)], schema=out)

    return common.written(made.mapInArrow(run, schema), "lists")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(id, tie, lo): the windows of the lists that start earlier elsewhere, by comparison with their neighbours in order."""
    schema = common.schema_of("list string, digest binary, id bigint, tie bigint, lo bigint, edge boolean")
    out = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, edge = None, None, True  # a range's first and last string may go on in another range
        for batch in batches:
            found = []
            for name, digest, i, tie, lo in zip(*(batch.column(c).to_pylist() for c in ("list", "digest", "id", "tie", "lo")), strict=True):
                row = (i, tie, lo)
                if (name, digest) != key:
                    if key and edge:
                        found.append((*key, *least, True))
                    edge = key is None
                    key, least = (name, digest), row
                elif row != least:
                    least, later = min(least, row), max(least, row)
                    found.append((*key, *later, False))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * 6, out, strict=True)], schema=out)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, *least, True), out, strict=True)], schema=out)

    order = ["list", "symbols", "name", "id", "tie", "lo"]
    ordered = rows.where(~F.col("repeated")).drop("repeated").repartitionByRange(*order).sortWithinPartitions(*order)
    found = common.written(ordered.mapInArrow(run, schema), "repeated")
    edges = found.where("edge").drop("edge")
    least = edges.groupBy("list", "digest").agg(F.min(F.struct("id", "tie", "lo")).alias("least"))
    later = edges.join(least, ["list", "digest"]).where(F.struct("id", "tie", "lo") != F.col("least"))
    parts = [rows.where("repeated"), found.where(~F.col("edge")), later]
    return parts[0].select("id", "tie", "lo").unionByName(parts[1].select("id", "tie", "lo")).unionByName(parts[2].select("id", "tie", "lo"))


def repeats(texts: DataFrame, length: int = LENGTH, widths: tuple[int, ...] = WIDTHS, symbol: int = SYMBOL) -> DataFrame:
    """(id, tie, lo, n): all windows of the texts (as keyed, no key twice) that start earlier elsewhere, n of them from lo on."""
    left, known = repeated_stretches(texts.select("id", "tie", "text"), length, widths[0]), None
    for width in widths:
        left, found = narrowed(left, length, width)
        known = found if known is None else known.unionByName(found)
        freed(texts.sparkSession)
    with common.scratch(texts.sparkSession):
        made, rounds = named_blocks(blocks(left), length, symbol)
        freed(texts.sparkSession)
        sorted_out = repeated_windows(listed(made, rounds, length, symbol)).select("id", "tie", "lo", F.lit(1).alias("n"))
        known = known.unionByName(common.written(sorted_out, "sorted-out", keep=True))
    freed(texts.sparkSession)
    return known


def freed(spark: SparkSession) -> None:
    """Lets the driver collect its garbage: only then does Spark delete the shuffle files of steps that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


REPORT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,length:bigint>>"


def deduplicated(docs: DataFrame, length: int = LENGTH, widths: tuple[int, ...] = WIDTHS, symbol: int = SYMBOL) -> DataFrame:
    """For each of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of what stays), and the removed spans, in bytes."""
    rows, size = keyed(docs), F.octet_length("text").cast("bigint")
    counts = rows.groupBy("id", "tie").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.max(size).alias("n_bytes"), F.max(F.when(size < length, F.sha2("text", 256))).alias("short"))
    copies = common.written(counts.where(F.col("n") > 1), "copies")
    texts = rows.dropDuplicates(["id", "tie"]) if copies.limit(1).count() else rows
    marks = repeats(texts, length, widths, symbol).groupBy("id", "tie").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))
    schema = common.schema_of(REPORT)
    out = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            columns: list[list] = [[] for _ in out]
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("marks"), strict=True):
                raw, gone = text.encode(), []
                if found.is_valid:
                    lo, n = (found.values.field(f).to_numpy(zero_copy_only=False) for f in (0, 1))
                    gone = [(int(a), int(b)) for a, b in zip(*merged(lo, lo + n + length - 1), strict=True)]
                kept, at = hashlib.sha256(), 0
                for a, b in [*gone, (len(raw), len(raw))]:
                    kept.update(raw[at:a])
                    at = b
                values = (doc, len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [{"start": a, "length": b - a} for a, b in gone])
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    first = texts.join(marks, ["id", "tie"], "left").select("doc_id", "text", "marks").mapInArrow(run, schema)
    whole = F.col("n_bytes") >= length
    gone = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("length")))
    later = copies.select("doc_id", "n_bytes", "short", F.explode(F.sequence(F.lit(2).cast("bigint"), "n"))).select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).cast("bigint").alias("n_removed"), whole.cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("short")).alias("kept_sha256"), F.when(whole, gone).otherwise(F.slice(gone, 1, 0)).alias("spans"),
    )
    return first.unionByName(later)
