"""Collocations: phrases of 2 to MAX_N words that occur together more than their parts would, mined by suffix-sigma.

Each position of a piece of text gives one suffix of at most MAX_N words. Suffixes are shuffled by language and first
word, sorted in reverse lexicographic order, and one stack counts all their prefixes in a single pass: a phrase's count
is complete when the sorted rows leave it. Afterwards each phrase is joined with the counts of its two parts.

What keeps the shuffle small, without losing an occurrence:
* equal suffixes of a batch of texts are one row with a count;
* a suffix ends before a word, and before a pair of neighbours, that occurs under MIN_COUNT times in its language, as no
  phrase with it can be frequent. Words are counted exactly; pairs are counted by 64-bit hash, so that a collision can only
  let a pair through. Both sets go to the tasks as bitmaps of fixed size (WORD_BITS, PAIR_BITS): false positives cost time, not
  rows;
* suffixes of a hot first word (more than one position in SHARE; at most SHARE of them) are dealt out by their next
  two words. Counts of their first one or two words are partial sums then, which the last aggregate adds up.

Cases: a null or empty text has no words; a null lang is `und`; repeated rows count each time; a text of any length is
one batch at most; words may hold any character but the separators. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, hashing

MAX_N, MIN_COUNT, SHARE = 4, 30, 1000
WORD_BITS, PAIR_BITS = 1 << 23, 1 << 25
#: Entries of a counter that a task holds before it passes them on, and words for each task of the pairs' count.
HELD, PAIRS = 1_000_000, 4_000_000

#: A-Z to lower case; what ends a piece to a full stop; tab to space.
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"." * 9 + b" ")


def words_of(texts: list[str | None]) -> bytes:
    """The words of the texts in order, joined by NUL, with `.` between pieces. NUL and SOH are escaped in words."""
    raw = b".".join(t.encode() for t in texts if t).translate(_TABLE)
    if b"\x00" in raw or b"\x01" in raw:
        raw = raw.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")
    return b"\x00".join(raw.replace(b".", b" . ").split())


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in common.pieces(batches, "text", 1 << 20):
        groups: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                groups.setdefault(lang, []).append(text)
        for lang, texts in groups.items():
            yield lang, words_of(texts)


class Words:
    """The places and hashes of the words in such bytes."""

    def __init__(self, lang: str, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        ends = np.append(np.flatnonzero(data == 0), len(data))
        self.starts, self.ends = np.append(0, ends[:-1] + 1), ends
        between = (ends - self.starts == 1) & (data[np.minimum(self.starts, max(0, len(data) - 1))] == 46) if len(data) else np.ones(1, bool)
        self.hashes = np.where(between, np.uint64(0), np.maximum(hashing.spans(data, self.starts, ends) ^ np.uint64(xxhash.xxh64_intdigest(lang)), np.uint64(1)))

    def frequent(self, bits: np.ndarray) -> np.ndarray:
        """The hashes, 0 for words that aren't in the bitmap and between pieces."""
        return np.where(hashing.has(bits, self.hashes), self.hashes, np.uint64(0))


def counted_words(docs: DataFrame) -> DataFrame:
    """(lang, word, f), and a row for each lang whose word is null and f the number of all its words."""
    schema = common.schema_of("lang string, word binary, f bigint")
    out = common.arrow_schema(schema)

    def flushed(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            words = list(counts)
            n = sum(counts.values())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) + 1)), pa.array([*words, None], pa.binary()), pa.array([*counts.values(), n], pa.int64())], schema=out)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for lang, raw in by_lang(batches):
            counts = held.setdefault(lang, Counter())
            counts.update(raw.split(b"\x00") if raw else [])
            counts.pop(b".", None)
            if sum(map(len, held.values())) > HELD:
                yield from flushed(held)
        yield from flushed(held)

    return docs.mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("f").alias("f"))


def word_bits(words: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of words (lang, word)."""
    schema = common.schema_of("h bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Words(lang, word).hashes[0] for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(made, np.uint64).view(np.int64))], schema=common.arrow_schema(schema))

    return hashing.bitmap(words.select("lang", "word").mapInArrow(run, schema), WORD_BITS)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Of each position but the last: a hash of the two words from there, 0 where one of them is none."""
    k = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + (h[:-1] >> np.uint64(29)))
    k *= np.uint64(0xD6E8FEB86659FD93)
    k ^= k >> np.uint64(32)
    return np.where((h[:-1] != 0) & (h[1:] != 0), np.maximum(k, np.uint64(1)), np.uint64(0))


def frequent_pairs(docs: DataFrame, words: np.ndarray, n_words: int, least: int) -> np.ndarray:
    """A bitmap of the hashes of pairs of neighbours that occur `least` times or more."""
    spark = docs.sparkSession
    sent, parts = spark.sparkContext.broadcast(words), max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // PAIRS)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for lang, raw in by_lang(batches):
            k = pair_hashes(Words(lang, raw).frequent(sent.value))
            yield k[k != 0]

    return hashing.frequent(docs, hashes, least, parts, PAIR_BITS)


def suffixes(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, hot: dict[tuple[str, bytes], int], max_n: int) -> DataFrame:
    """(lang, part, suffix, n): suffixes of two words or more, cut before what can't be frequent; part tells language, first word and salt."""
    schema = common.schema_of("lang string, part bigint, suffix binary, n bigint")
    out, sent = common.arrow_schema(schema), docs.sparkSession.sparkContext.broadcast((words, pairs, hot))

    def flushed(held: dict[str, Counter], salts: dict) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            parts, keys = [], list(counts)
            for s in keys:
                first, rest = s.split(b"\x00", 1)
                many = salts.get((lang, first), 1)
                salt = zlib.crc32(b"\x00".join(rest.split(b"\x00")[:2])) % many if many > 1 else 0
                parts.append(xxhash.xxh64_intdigest(first, xxhash.xxh64_intdigest(lang, salt)) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(parts, pa.int64()), pa.array(keys, pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=out)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, salts = sent.value
        held: dict[str, Counter] = {}
        for lang, raw in by_lang(batches):
            found = Words(lang, raw)
            k = pair_hashes(found.frequent(words))
            on = (k != 0) & hashing.has(pairs, k)
            size = on.astype(np.int64)  # neighbours that go on from here, at most max_n - 1
            for step in range(1, max_n - 1):
                size[:-step] += (size[:-step] == step) & on[step:]
            at = np.flatnonzero(on)
            counts = held.setdefault(lang, Counter())
            counts.update([raw[i:j] for i, j in zip(found.starts[at].tolist(), found.ends[at + size[at]].tolist(), strict=True)])
            if sum(map(len, held.values())) > HELD:
                yield from flushed(held, salts)
        yield from flushed(held, salts)

    return docs.mapInArrow(run, schema)


def stack_counts(rows: Iterator[tuple[str, bytes, int]], least: int, hot: set[tuple[str, bytes]]) -> Iterator[tuple[str, bytes, int, int]]:
    """(lang, phrase, words, count) for the prefixes of two words or more of sorted suffixes, each when the rows leave it.

    Prefixes under `least` are left out, but for pairs with a hot first word: these may have other suffixes elsewhere, and all partial sums go on.
    """
    lang, words, counts = None, [], []  # the stack: the words of the prefixes that are open, and what has been counted of each
    for new_lang, suffix, n in rows:
        parts = suffix.split(b"\x00")
        same = 0
        if new_lang == lang:
            for word in words[: len(parts)]:
                if word != parts[same]:
                    break
                same += 1
        depth = len(words)
        while depth > same:
            k = counts.pop()
            if depth > 1:
                counts[-1] += k
                if k >= least or depth == 2 and (lang, words[0]) in hot:
                    yield lang, b"\x00".join(words), depth, k
            words.pop()
            depth -= 1
        lang = new_lang
        words += parts[same:]
        counts += [0] * (len(parts) - same)
        counts[-1] += n
    for depth in range(len(words), 1, -1):
        k = counts.pop()
        counts[-1] += k
        if k >= least or depth == 2 and (lang, words[0]) in hot:
            yield lang, b"\x00".join(words[:depth]), depth, k


def phrases(suffix_rows: DataFrame, hot: dict[tuple[str, bytes], int], least: int) -> DataFrame:
    """(lang, phrase, k, f) of all phrases of two words or more with f >= least."""
    schema = common.schema_of("lang string, phrase binary, k int, f bigint")
    out, sent = common.arrow_schema(schema), suffix_rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lang", "suffix", "n")), strict=True))
        found = stack_counts(rows, least, set(sent.value))
        while some := [r for _, r in zip(range(20_000), found, strict=False)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), out, strict=True)], schema=out)

    ordered = suffix_rows.repartition("part").sortWithinPartitions("lang", F.desc("suffix"))
    return ordered.mapInArrow(run, schema).groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def mined(docs: DataFrame, top: int = 2000, max_n: int = MAX_N, least: int = MIN_COUNT, cover: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases.

    a, l, r: occurrences of the phrase and of the two parts at its lowest-scoring cut. Phrases inside longer ones with
    at least `cover` hundredths of their occurrences are left out.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    common.bounded_batches(docs.sparkSession)
    counted = common.written(counted_words(docs), "words")
    totals = counted.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    frequent = counted.where(F.col("word").isNotNull() & (F.col("f") >= least))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    limit = max(common.KEY_ROWS, n_words // SHARE)
    hot = {(r["lang"], bytes(r["word"])): r["f"] // limit + 1 for r in frequent.where(F.col("f") > limit).collect()}
    words = word_bits(frequent)
    pairs = frequent_pairs(docs, words, n_words, least)
    found = common.written(phrases(suffixes(docs, words, pairs, hot, max_n), hot, least), "phrases")

    parts = found.select("lang", "phrase", "f").unionByName(frequent.select("lang", F.col("word").alias("phrase"), "f"))
    split = F.transform(F.split(F.decode("phrase", "ISO-8859-1"), "\x00"), lambda w: F.encode(w, "ISO-8859-1"))

    def piece(first, size):
        return F.aggregate(F.slice("w", first + 1, size - 1), F.element_at("w", first), lambda x, w: F.concat(x, F.lit(b"\x00"), w))

    cuts = found.select("lang", F.col("phrase").alias("whole"), F.col("f").alias("a"), "k", split.alias("w"))
    cuts = cuts.select("lang", "whole", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "whole", "a", "cut", piece(F.lit(1), F.col("cut")).alias("left"), piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = common.skew_join(cuts, parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = common.skew_join(cuts, parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0))) div (l + r)")
    scored = cuts.groupBy("lang", "whole", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))

    inner = found.where(F.col("k") > 2).select("f", "lang", "k", split.alias("w"))
    inner = inner.select("f", "lang", "k", "w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("f", "lang", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("first"))
    longer = inner.groupBy("lang", piece(F.col("first"), F.col("size")).alias("whole")).agg(F.max("f").alias("longer"))
    left = scored.join(longer, ["lang", "whole"], "left").where(F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * cover, F.lit(True)))

    shown = F.translate(F.decode("whole", "UTF-8"), "\x00", " ")
    shown = F.replace(F.replace(shown, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))
    left = left.select("lang", shown.alias("phrase"), "a", "x.l", "x.r", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
