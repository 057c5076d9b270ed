"""Documents to chunks: bounded pieces with spans, ids and neighbours; one Arrow pass, no shuffle for the pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, _parse_datatype_string
from pyspark.sql.window import Window

from corpusloom.functions import ids

SCHEMA = (
    "document_id string, ordinal int, text string, heading_path array<string>, start_line int, end_line int, start_byte bigint, end_byte bigint"
)


@dataclass(frozen=True)
class ChunkConfig:
    """overlap is accepted and checked, and has no effect on splitting."""

    target: int = 1200
    hard: int = 2400
    minimum: int = 120
    overlap: int = 0

    def __post_init__(self) -> None:
        if self.target <= 0 or self.hard < self.target or self.minimum > self.target or self.overlap > self.target:
            raise ValueError("need 0 < target <= hard, minimum <= target and overlap <= target")


#: Bytes of text that are cut at a time.
BYTES_AT_ONCE = 1_000_000


def text_slices(batches: Iterator[pa.RecordBatch], text: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` bytes of the column at place `text`, or one row: a task holds the pieces of one slice at a time."""
    limit = most or BYTES_AT_ONCE
    for batch in batches:
        reach, start = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(reach, (reach[start - 1] if start else 0) + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def split_bounded(text: str, target: int, minimum: int) -> list[tuple[int, int]]:
    """Character ranges of at most `target`: cut after the last white space that leaves `minimum` characters, else at the limit; blank pieces are left out."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + target)
        if end < n:
            spaces = next((i for i in range(end - 1, at - 1, -1) if text[i].isspace()), None)
            if spaces is not None and spaces + 1 - at >= minimum:
                end = spaces + 1
        if text[at:end].strip():
            out.append((at, end))
        at = end
    return out


_FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
_BULLET = re.compile(r"([-+*]|[0-9]{1,9}[.)])(?=[ ]|$)")
_RULE = re.compile(r"([-_*])[ ]*(?:\1[ ]*){2,}$")
_HEADING, _UNDERLINE = re.compile(r"#{1,6}(?:[ ]|$)"), re.compile(r"(?:=+|-+)[ ]*$")
#: HTML blocks: how one starts, and what ends it (None: a blank line). The last kind can't interrupt a paragraph.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[ >]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(
        r"</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html"
        r"|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:[ ]|/?>|$)", re.I), None),
    (re.compile(r"<(?:[A-Za-z][A-Za-z0-9-]*(?:[ ]+[A-Za-z_:][\w.:-]*(?:[ ]*=[ ]*(?:[^ \"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*[ ]*/?|/[A-Za-z][A-Za-z0-9-]*[ ]*)>[ ]*$"), None),
]


@dataclass
class _Open:
    """What is open behind a line: containers (0: a quote, else the columns that a list item's content is indented by) and the block within them."""

    containers: list[int]
    leaf: str = ""  # paragraph, fence, indented, html or none
    mark: object = None  # the fence, or what ends the HTML


def _indent(row: str, at: int) -> int:
    return len(row) - at - len(row[at:].lstrip(" "))


def _matched(row: str, containers: list[int]) -> tuple[int, int]:
    """How many of the open containers a line goes on with, and where its content begins."""
    at = 0
    for k, width in enumerate(containers):
        space = _indent(row, at)
        if width:
            if at + space < len(row) and space < width:
                return k, at
            at = min(len(row), at + width)
        else:
            if space > 3 or row[at + space : at + space + 1] != ">":
                return k, at
            at += space + 1
            at += row[at : at + 1] == " "
    return len(containers), at


def code_lines(rows: list[str]) -> list[bool]:
    """Lines of fenced and indented code blocks, within quotes and list items too.

    Lines are read as Markdown reads them: first the open containers that a line goes on with, then new ones that it opens,
    then the block. A line without its containers' marks only goes on with a paragraph. HTML blocks hold no code.
    """
    out: list[bool] = []
    state, blanks = _Open([]), []  # blanks: lines that are code if the indented block goes on
    for number, row in enumerate(rows):
        row = row.rstrip("\r\n").expandtabs(4)
        known, at = _matched(row, state.containers)
        whole = known == len(state.containers)
        if whole and state.leaf == "fence":
            out.append(True)
            bare = row[at:].strip()
            if _indent(row, at) <= 3 and bare and set(bare) == {state.mark[0]} and len(bare) >= len(state.mark):
                state.leaf = ""
            continue
        if whole and state.leaf == "html":
            out.append(False)
            if state.mark is None and not row[at:].strip() or state.mark is not None and state.mark.search(row, at):
                state.leaf = ""
            continue
        paragraph = state.leaf == "paragraph"
        opened, leaf, mark = [], "", None
        while True:
            space = _indent(row, at)
            rest = row[at + space :]
            if not rest:
                break
            lazy = paragraph and not opened
            if space > 3:
                leaf = "paragraph" if lazy else "indented"
                break
            html = next((end for start, end in _HTML[: 6 if lazy else 7] if start.match(rest)), False)
            if rest.startswith(">"):
                opened.append(0)
                at += space + 1
                at += row[at : at + 1] == " "
                continue
            if found := _FENCE.match(rest):
                leaf, mark = "fence", found[1] or found[2]
            elif html is not False:
                leaf, mark = "" if html is not None and html.search(rest) else "html", html
            elif _HEADING.match(rest) or whole and lazy and _UNDERLINE.match(rest) or _RULE.match(rest):
                leaf = ""
            elif (found := _BULLET.match(rest)) and not (lazy and whole and (found.end() == len(rest.rstrip()) or found[0][:-1].isdigit() and int(found[0][:-1]) != 1)):
                gap = _indent(rest, found.end())
                width = space + found.end() + (gap if 1 <= gap <= 4 and found.end() + gap < len(rest) else 1)
                opened.append(width)
                at = min(len(row), at + width)
                continue
            else:
                leaf = "paragraph"
            break
        blank = not row[at:].strip()
        if paragraph and leaf == "paragraph" and not opened and not whole:
            out.append(False)  # a lazy line: the containers stay open
            continue
        code = leaf in ("fence", "indented")
        if code and leaf == state.leaf == "indented" and whole and not opened:
            for b in blanks:
                out[b] = True
        if blank and not opened and whole and state.leaf == "indented":
            blanks.append(number)
            out.append(False)
            continue
        blanks = []
        out.append(code)
        # a blank line ends a paragraph, and quotes that it has no mark for; list items stay open
        state = _Open(state.containers[:known] + opened, leaf, mark)
    return out


def markdown_blocks(text: str) -> list[tuple[int, int, bool, list[str]]]:
    """(start, end, code, headings): blocks between blank lines; a heading starts one and keeps the paragraph after it."""
    rows = re.findall(r"[^\n]*\n|[^\n]+", text)
    code = code_lines(rows)
    blocks: list[tuple[int, int, bool, list[str]]] = []
    stack: list[tuple[int, str]] = []
    start, held_code, fresh, at = None, False, False, 0

    def push(end: int) -> None:
        if start is not None and start < end:
            blocks.append((start, end, held_code, [t for _, t in stack]))

    for row, in_code in zip(rows, code, strict=True):
        bare = row.strip()
        if not in_code and bare.startswith("#"):
            push(at)
            level = len(bare) - len(bare.lstrip("#"))
            stack = _popped(stack, level)
            stack.append((level, bare[level:].strip()))
            start, fresh = at, True
        elif not bare and not in_code:
            if fresh:
                fresh = False
            else:
                push(at)
                start = None
        elif start is None:
            start = at
        elif bare:
            fresh = False
        held_code = in_code
        at += len(row)
    push(len(text))
    if not blocks and text.strip():
        blocks.append((0, len(text), False, []))
    return blocks


def _popped(stack: list[tuple[int, str]], level: int) -> list[tuple[int, str]]:
    kept = list(stack)
    while kept and kept[-1][0] >= level:
        kept.pop()
    return kept


def chunk_text(text: str, media_type: str, path: str, config: ChunkConfig) -> list[tuple]:
    """(text, headings, start_line, end_line, start_byte, end_byte) of each chunk of one document."""
    if not text.strip():
        return []
    anchor = [path.split("#", 1)[1]] if "#" in path else []
    if media_type == "text/markdown":
        spans = [
            (s + a, s + b, headings)
            for s, e, code, headings in markdown_blocks(text)
            if text[s:e].strip()
            for a, b in ([(0, e - s)] if code or e - s <= config.target else split_bounded(text[s:e], config.target, config.minimum))
        ]
    elif len(text) <= config.hard:
        spans = [(0, len(text), anchor)]
    else:
        spans = [(a, b, anchor) for a, b in split_bounded(text, config.target, config.minimum)]
    out, line, byte, at = [], 1, 0, 0
    for a, b, headings in spans:
        gap = text[at:a]
        line += gap.count("\n")
        byte += len(gap.encode())
        piece = text[a:b]
        first, start = line, byte
        line += piece.count("\n")
        byte += len(piece.encode())
        out.append((piece, headings, first, line, start, byte))
        at = b
    return out


def chunk_documents(docs: DataFrame, config: ChunkConfig | None = None, carry: tuple[str, ...] = (), neighbours: bool = False) -> DataFrame:
    """Chunks of docs (document_id, path, media_type, content): the pieces, their digests, ids and sizes.

    carry: further columns of docs that each chunk keeps. neighbours: also previous_chunk and next_chunk, which are known
    while a document is cut. One Arrow pass, without a join or a shuffle.
    """
    settings = config or ChunkConfig()
    beside = "struct<heading_path:array<string>,content_digest:string>"
    ddl = f"{SCHEMA}, content_digest string" + (f", _before {beside}, _after {beside}" if neighbours else "")
    made_schema = StructType([*_parse_datatype_string(ddl).fields, *[docs.schema[c] for c in carry]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(made_schema)
        for batch in text_slices(batches, 3):
            rows, owners = [], []
            for n, (document, path, kind, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                found = chunk_text(text or "", kind or "", path or "", settings)
                digests = ["sha256:" + sha256(c[0].encode()).hexdigest() for c in found]
                ends = [{"heading_path": c[1], "content_digest": d} for c, d in zip(found, digests, strict=True)]
                for i, (chunk, digest) in enumerate(zip(found, digests, strict=True)):
                    near = (ends[i - 1] if i else None, ends[i + 1] if i + 1 < len(ends) else None) if neighbours else ()
                    rows.append((document, i, *chunk, digest, *near))
                owners += [n] * len(found)
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=False)]
                place = pa.array(owners, pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(place) for c in carry)], schema=out)

    inputs = docs.select("document_id", "path", "media_type", "content", *[c for c in carry if c not in ("document_id", "path", "media_type", "content")])
    made = inputs.mapInArrow(run, made_schema)

    def named(place: Column, heading: Column, digest: Column) -> Column:
        return ids.chunk_id(F.col("document_id"), place, heading, digest)

    made = made.select(
        "*",
        named(F.col("ordinal"), F.col("heading_path"), F.col("content_digest")).alias("chunk_id"),
        F.length("text").alias("char_count"),
        F.octet_length("text").alias("byte_count"),
    )
    if not neighbours:
        return made
    near = lambda c, step: F.when(F.col(c).isNotNull(), named(F.col("ordinal") + step, F.col(f"{c}.heading_path"), F.col(f"{c}.content_digest")))
    return made.select("*", near("_before", -1).alias("previous_chunk"), near("_after", 1).alias("next_chunk")).drop("_before", "_after")


def linked(chunks: DataFrame) -> DataFrame:
    """previous_chunk and next_chunk within each document, for chunks that were cut without them."""
    order = Window.partitionBy("document_id").orderBy("ordinal")
    return chunks.select("*", F.lag("chunk_id").over(order).alias("previous_chunk"), F.lead("chunk_id").over(order).alias("next_chunk"))


def reassembled(chunks: DataFrame) -> DataFrame:
    """Each document's chunks in order, joined as they are."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("content"), F.count("*").alias("chunks"))


def token_windows(text: str, offsets: list[tuple[int, int]], limit: int, fits) -> list[str]:
    """Windows of at most `limit` tokens that join to the whole text; a window that does not fit is halved."""
    out: list[str] = []

    def add(piece: str) -> None:
        if len(piece) > 1 and not fits(piece):
            half = len(piece) // 2
            add(piece[:half])
            add(piece[half:])
        elif piece:
            out.append(piece)

    starts = [offsets[i][0] for i in range(limit, len(offsets), limit)]
    for a, b in zip([0, *starts], [*starts, len(text)], strict=True):
        add(text[a:b])
    return out


def word_offsets(text: str) -> list[tuple[int, int]]:
    """The stand-in for a model's tokenizer: runs of other than blanks and line ends."""
    return [m.span() for m in re.finditer(r"[^ \t\n\r]+", text)]


def windowed(docs: DataFrame, key: str, text: str, limit: int, offsets=word_offsets) -> DataFrame:
    """Token windows of each row: key, ordinal, window, tokens. Windows of a text join to the whole of it; an empty or null one has none.

    offsets(text) gives the tokens' character spans. A window is tokenised again, since its tokens may be others than within
    the text, and halved until it fits.
    """
    if limit < 1:
        raise ValueError("a window has a token at least")
    kind = docs.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("ordinal", IntegerType()), StructField("window", StringType()), StructField("tokens", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            place, pieces, sizes, at = [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                found = token_windows(value, offsets(value), limit, lambda w: len(offsets(w)) <= limit) if value else []
                place += [i] * len(found)
                at += range(len(found))
                pieces += found
                sizes += [len(offsets(w)) for w in found]
            if place:
                keys = batch.column(0).take(pa.array(place))
                yield pa.RecordBatch.from_arrays([keys, pa.array(at, pa.int32()), pa.array(pieces, pa.string()), pa.array(sizes, pa.int32())], [key, "ordinal", "window", "tokens"])

    return docs.select(key, text).mapInArrow(run, schema)
