"""WARC archives: a writer with payload deduplication and a reader that salvages damaged files.

Each task writes its rows into one archive of gzip members, a record each, below a folder of the shared
store; the names that finished tasks report are the archive list, so what a lost executor left behind is
not read. The reader goes member by member (or, in plain archives, record by record). Where a check fails
(compression, version line, headers, length, payload digest), it searches for the next member or version
line that reads well, goes on there, and logs the bytes between as a quarantined gap.

Equal payloads: the row with the largest page_id is the response, others are revisits of it; payloads
under `least` bytes are all responses. Payloads that are frequent (at most 1000 of them can be) are
looked up in a literal map and their rows are dealt out by page_id, so no task gets a hot payload's rows.

Cases: a null html is an empty payload, a null url leaves out the target header; a null page_id is kept
and never a response's id. Pages of any length are one record each. An empty table gives no archive and no rows.
Other columns are not read, whatever their names. Repeated rows: of rows with one page_id and payload all that hold the largest page_id are responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VERSION = b"WARC/1.1"
PAGE = "urn:page:"
_MEMBER = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_READ, _FEED = 1 << 20, 1 << 13
RECORDS = "archive string, kind string, offset bigint, size bigint, reason string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    block = b"" if revisit else _HTTP + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{PAGE}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\r\n]+", " ", url)),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", f"<{PAGE}{refers_to}>" if revisit else None),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = b"".join(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in head if v is not None)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


class Damaged(ValueError):
    pass


def parse(data: bytes, at: int = 0, ended: bool = True) -> tuple[dict, int] | None:
    """The record at `at` and where the next one starts; None if more bytes are needed (and `ended` is false)."""
    line = data[at : at + 10]
    if len(line) < 10 and not ended:
        return None
    if not _VERSION_LINE.match(line):
        raise Damaged("version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        if ended or len(data) - at > _READ:
            raise Damaged("headers")
        return None
    head = {}
    for row in data[at + 10 : stop].split(b"\r\n"):
        key, colon, value = row.partition(b":")
        if not colon:
            raise Damaged("headers")
        head[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Damaged("headers")
    begin = stop + 4
    end = begin + int(length)
    if len(data) < end + 4:
        if ended:
            raise Damaged("length")
        return None
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length")
    block = data[begin:end]
    if (d := head.get("warc-block-digest")) and d != f"sha1:{digest32(block)}":
        raise Damaged("block digest")
    payload = block
    if head.get("warc-type") == "response":
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if cut >= 0 else block
        if (d := head.get("warc-payload-digest")) and d != f"sha1:{digest32(payload)}":
            raise Damaged("payload digest")
    return {"head": head, "payload": payload}, end + 4


class Salvage:
    """Reads an archive piece by piece: yields ("record", offset, size, record) and ("gap", offset, size, reason)."""

    def __init__(self, stream):
        self.stream, self.data, self.at, self.base, self.ended = stream, b"", 0, 0, False

    def more(self) -> bool:
        """Reads on, and forgets what has been dropped; at least as much as is held, so that long records stay cheap."""
        if self.ended:
            return False
        piece = self.stream.read(max(_READ, len(self.data) - self.at))
        self.ended = not piece
        self.data, self.base, self.at = self.data[self.at :] + piece, self.base + self.at, 0
        return not self.ended

    @property
    def offset(self) -> int:
        return self.base + self.at

    def __iter__(self) -> Iterator[tuple]:
        gap, reason = None, ""
        while self.at < len(self.data) or self.more():
            try:
                made, size = self.one()
            except Damaged as error:
                if gap is None:
                    gap, reason = self.offset, str(error)
                self.skip()
                continue
            if gap is not None:
                yield "gap", gap, self.offset - gap, reason
                gap = None
            yield "record", self.offset, size, made
            self.at += size
        if gap is not None:
            yield "gap", gap, self.offset - gap, reason

    def one(self) -> tuple[dict, int]:
        """The record that starts here, and the bytes that it takes."""
        while len(self.data) - self.at < 10 and self.more():
            pass
        if self.data.startswith(_MEMBER, self.at):
            return self.compressed()
        while (found := parse(self.data, self.at, self.ended)) is None:
            self.more()
        return found[0], found[1] - self.at

    def compressed(self) -> tuple[dict, int]:
        inflate, parts, fed = zlib.decompressobj(31), [], 0
        try:
            while not inflate.eof:
                if self.at + fed == len(self.data) and not self.more():
                    raise Damaged("compression")
                piece = self.data[self.at + fed : self.at + fed + _FEED]
                fed += len(piece)
                parts.append(inflate.decompress(piece))
        except zlib.error:
            raise Damaged("compression") from None
        plain = b"".join(parts)
        found, end = parse(plain)
        if end != len(plain):
            raise Damaged("length")
        return found, fed - len(inflate.unused_data)

    def skip(self) -> None:
        """To the next place, after this one, that may start a member or a record."""
        self.at += 1
        while True:
            places = [p for p in (self.data.find(_MEMBER, self.at), self.data.find(b"WARC/1.", self.at)) if p >= 0]
            if places:
                self.at = min(places)
                return
            self.at = max(self.at, len(self.data) - 6)
            if not self.more():
                self.at = len(self.data)
                return


def _open(archive: str, write: bool = False):
    system, path = pafs.FileSystem.from_uri(archive if "://" in archive or archive.startswith("file:") else f"file://{archive}")
    if write:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_stream(path, compression=None)


def _page_id(value: str | None) -> int | None:
    found = re.fullmatch(rf"<{PAGE}(-?\d+)>", value or "")
    return int(found[1]) if found else None


def read_archive(archive: str) -> Iterator[tuple]:
    """Rows of RECORDS for one archive."""
    with _open(archive) as stream:
        for kind, offset, size, what in Salvage(stream):
            if kind == "gap":
                yield archive, kind, offset, size, what, None, None, None, None, None
                continue
            head = what["head"]
            given = head.get("x-payload-length", "")
            n = int(given) if given.isdigit() and head.get("warc-type") == "revisit" else len(what["payload"])  # a revisit has no payload of its own
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or digest32(what["payload"])
            yield archive, kind, offset, size, "", _page_id(head.get("warc-record-id")), n, digest, head.get("warc-type"), _page_id(head.get("warc-refers-to"))


def classified(pages: DataFrame, least: int = 0, frequent: int = 1000) -> DataFrame:
    """page_id, url, html and response: the page_id that holds the payload's response record (its own: a response)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    counts = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    counts = common.written(counts, "payloads")
    total = pages.count()
    hot = counts.where(F.col("n") > max(2, total // frequent)).collect()  # at most `frequent` of them
    pairs = [x for r in hot for x in (F.lit(bytes(r["digest"])), F.lit(r["response"]).cast("bigint"))]
    known = F.element_at(F.create_map(*pairs), F.col("digest")) if hot else F.lit(None).cast("bigint")
    rows = rows.withColumn("known", known)
    spread = F.when(F.col("known").isNotNull(), F.concat(F.lit("~"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).otherwise(F.hex("digest"))
    cold = counts.select(F.hex("digest").alias("key"), F.col("response").alias("found"))
    joined = rows.withColumn("key", spread).join(cold, "key", "left")
    return joined.select("page_id", "url", "html", F.coalesce("known", "found", "page_id").alias("response"))


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives and returns their list (archive string), itself a written table."""
    folder = common.fresh_path(pages.sparkSession, "warc")
    common.bounded_batches(pages.sparkSession)
    schema = common.schema_of("archive string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = archive = None
        for batch in common.pieces(batches, "html"):
            if stream is None:
                archive = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                stream = _open(archive, write=True)
            for page_id, url, text, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                again = response is not None and response != page_id
                stream.write(member(record(page_id, url, text.encode("utf-8", "replace"), response, again)))
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.string())], schema=common.arrow_schema(schema))

    return common.written(classified(pages, least).mapInArrow(run, schema), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows of RECORDS: each archive's records and quarantined gaps."""
    schema = common.schema_of(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.arrow_schema(schema)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                held = []
                for row in read_archive(archive):
                    held.append(row)
                    if len(held) >= 5000:
                        yield _rows(held, out)
                        held = []
                if held:
                    yield _rows(held, out)

    # a number given by hand keeps adaptive execution from putting the short names, and so all archives, into one task
    tasks = max(1, min(archives.count(), 20_000))
    return archives.select("archive").repartition(tasks, "archive").mapInArrow(run, schema)


def _rows(rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
