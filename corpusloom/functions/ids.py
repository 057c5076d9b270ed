"""Digests and typed ids as column expressions: no UDF, so they fold into the surrounding stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The recipes hash a domain name first; give another to be compatible with ids made elsewhere.
DOMAIN = "corpusloom"


def content_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def length_prefixed(value: Column) -> Column:
    """Eight bytes of big-endian length, then the bytes: fields can't run into each other."""
    raw = value.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw)


def _typed(prefix: str, domain: str, parts: list[Column]) -> Column:
    joined = F.concat(F.lit(domain).cast("binary"), *[length_prefixed(p) for p in parts])
    return F.concat(F.lit(prefix), F.sha2(joined, 256))


def document_id(repository: Column, revision: Column, path: Column, digest: Column, domain: str = DOMAIN) -> Column:
    return _typed("doc-", f"{domain}/document/v1", [repository, revision, path, digest])


def chunk_id(document: Column, ordinal: Column, headings: Column, digest: Column, domain: str = DOMAIN) -> Column:
    return _typed("chunk-", f"{domain}/chunk/v1", [document, ordinal.cast("string"), F.array_join(headings, "/"), digest])


def content_key(repository: Column, path: Column, text: Column) -> Column:
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(repository.cast("binary"), zero, path.cast("binary"), zero, content_digest(text).cast("binary")), 256)


def node_id(repository: Column, revision: Column, path: Column, symbol: Column, kind: Column, span: list[Column], domain: str = DOMAIN) -> Column:
    """Graph node identity: little-endian length prefixes and four 32-bit little-endian span numbers."""

    def little(value: Column, width: int) -> Column:
        digits = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(width - 1, -1, -1)]))

    fields = [F.concat(little(F.octet_length(c), 8), c.cast("binary")) for c in (repository, revision, path, symbol, kind)]
    return F.sha2(F.concat(F.lit(f"{domain}-graph-node-v1").cast("binary"), F.unhex(F.lit("00")), *fields, *[little(s, 4) for s in span]), 256)


def is_typed_id(value: Column, prefix: str) -> Column:
    return value.rlike(rf"^{prefix}[0-9a-f]{{64}}$")


def feedback_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value.cast("binary"), 256), 1, 24))
