"""64-bit hashes of byte spans in whole arrays, counting them, and sets of them as bitmaps of fixed size."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashes that a task holds before it passes them on.
HELD = 2_000_000


def fixed(seed: int) -> np.ndarray:
    """256 odd numbers that follow from a seed."""
    raw = b"".join(hashlib.sha256(b"%d-%d" % (seed, i)).digest() for i in range(64))
    return np.frombuffer(raw, np.uint64) | np.uint64(1)


BYTES, _BASE = fixed(1), 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base, and of its inverse, modulo 2 ** 64: n of each or more."""
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, np.uint64(base))
            x[:1] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def sums(data: np.ndarray) -> np.ndarray:
    """Of each place the sum of what is before it: a polynomial in the bytes, whose differences don't depend on what stands around."""
    terms = BYTES[data]
    terms *= powers(len(data))[0][: len(data)]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of data[start:end] for each pair: equal bytes, equal hashes."""
    if not len(data):
        return np.zeros(len(starts), np.uint64)
    found = sums(data)
    h = found[ends] - found[starts]
    h *= powers(len(data) + 1)[1][starts]
    return mixed(h)


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = starts_of(keys)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts


def bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """The bits of the hashes in `h`, as 64-bit words: at most bits / 64 rows reach the driver."""
    at = F.pmod("h", F.lit(bits))
    words = rows.select(F.shiftright(at, 6).alias("i"), F.expr("shiftleft(1L, cast(pmod(h, 64) as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    made = np.zeros(bits >> 6, np.uint64)
    made[words.column("i").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return made


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def frequent(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int, parts: int, bits: int) -> np.ndarray:
    """A bitmap of the hashes that `hashes` makes `least` times or more of all rows.

    Equal hashes of a task's share are one with a count before the shuffle; what is shuffled are arrays, by ranges of hash values.
    """
    packed, found = common.schema_of("part int, keys binary, counts binary"), common.schema_of("h bigint")
    out, out_found = common.arrow_schema(packed), common.arrow_schema(found)

    def emitted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        keys, counts = summed(keys, np.ones(len(keys), np.int64))
        part = (keys >> np.uint64(33)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        keys, counts, part = keys[order], counts[order].astype(np.uint32), part[order]
        starts = starts_of(part)
        cuts = list(zip(starts, np.r_[starts[1:], len(part)].astype(np.int64), strict=False))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[starts].astype(np.int32)), pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary())], schema=out
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for some in hashes(batches):
            held.append(some)
            size += len(some)
            if size > HELD:
                yield emitted(held)
                held, size = [], 0
        if size:
            yield emitted(held)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, fresh = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                fresh.append((np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint32).astype(np.int64)))
            if sum(len(k) for k, _ in fresh) > HELD:
                keys, counts = summed(np.concatenate([keys, *[k for k, _ in fresh]]), np.concatenate([counts, *[c for _, c in fresh]]))
                fresh = []
        keys, counts = summed(np.concatenate([keys, *[k for k, _ in fresh]]), np.concatenate([counts, *[c for _, c in fresh]]))
        yield pa.RecordBatch.from_arrays([pa.array(keys[counts >= least].view(np.int64))], schema=out_found)

    return bitmap(df.mapInArrow(count, packed).repartition(parts, "part").mapInArrow(chosen, found), bits)
