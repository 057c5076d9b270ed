"""Catalog and file sources: JSON and YAML records, command documents, interface and inventory lists, binary packages, descriptors, profiles."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import normalised_list


def json_array(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The records of a JSON file's array."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("x")).select("x.*")


def priority_entries(rows: DataFrame) -> DataFrame:
    """Rows (id, category, summary, catalog_ref) as catalog entries; keywords are the id's parts and the summary's words without outer punctuation."""
    words = F.transform(F.split(F.col("summary"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    keywords = F.array_sort(F.array_distinct(F.filter(F.concat(F.split("id", "-"), words), lambda w: w != "")))
    return rows.select(
        F.concat(F.lit("priority."), F.col("id")).alias("id"), F.replace("id", F.lit("-"), F.lit("_")).alias("name"), "category", "summary",
        F.struct(F.lit("catalog").alias("repo"), F.col("catalog_ref").alias("path"), F.lit(1).alias("line")).alias("source"), keywords.alias("keywords"),
    )


def markdown_summary(text: Column, fallback: Column) -> Column:
    """Title and first paragraph: of the lines, headings, tables, rules and bold labels are passed over; a blank line after text ends it."""
    lines = F.transform(F.split(text, "\n"), lambda r: F.trim(r))
    title = F.try_element_at(F.filter(lines, lambda r: r.startswith("# ")), F.lit(1))
    bare = F.trim(F.regexp_replace(title, "^#+", ""))
    start = F.struct(F.lit("").alias("p"), F.lit(False).alias("done"))

    def step(acc: Column, row: Column) -> Column:
        passed = row.startswith("#") | row.startswith("|") | row.startswith("---") | (row.startswith("**") & F.contains(row, F.lit(":")))
        return (
            F.when(acc["done"] | ((row == "") & (acc["p"] == "")), acc)
            .when(row == "", F.struct(acc["p"].alias("p"), F.lit(True).alias("done")))
            .when(passed, acc)
            .otherwise(F.struct(F.concat_ws(" ", F.nullif(acc["p"], F.lit("")), row).alias("p"), F.lit(False).alias("done")))
        )

    paragraph = F.aggregate(lines, start, step)["p"]
    body = F.coalesce(F.nullif(paragraph, F.lit("")), fallback)
    return F.when(bare.isNull(), body).when(body == "", bare).otherwise(F.concat(bare, F.lit(". "), body))


def symbol_entries(groups: DataFrame, wanted: list[str], header: DataFrame | None = None) -> DataFrame:
    """One row for each symbol of the wanted groups (id, symbols), in their order; a missing group is an error; header (text, any number of rows): symbols that no row has are too."""
    order = F.array(*map(F.lit, wanted))
    rows = groups.where(F.col("id").isin(wanted)).select(F.array_position(order, F.col("id")).alias("place"), F.col("id").alias("group"), F.explode("symbols").alias("symbol"))
    found = {r[0] for r in groups.where(F.col("id").isin(wanted)).select("id").collect()}  # at most as many as are wanted
    if missing := [w for w in wanted if w not in found]:
        raise ValueError(f"groups are missing: {', '.join(missing)}")
    if header is not None:
        words = header.select(F.explode(F.split("text", r"\W+")).alias("symbol")).distinct()
        if rows.join(words, "symbol", "left_anti").limit(1).count():
            raise ValueError("the header lacks a symbol")
    return rows


def requirement_entries(rows: DataFrame) -> DataFrame:
    """Requirements (name, kind, caller) with the last part of their dotted name."""
    return rows.select("*", F.element_at(F.split("name", r"\."), -1).alias("symbol"))


def catalog_union(parts: list[DataFrame], ranks: dict[str, int]) -> DataFrame:
    """Entries of all sources in canonical order: by the category's rank, then by id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return out.orderBy(F.element_at(table, F.col("category")), "id")


def yaml_records(files: DataFrame) -> DataFrame:
    """(path, key, position, record JSON, line, anchor, identifiers): each element of a top-level list, else one record `root`; files: path, text.

    anchor is key[position], or root; identifiers are the anchor and the record's id, name and command where these are
    texts; line is where the key is first found in the text.
    """
    schema = "path string, key string, position int, record string, line int, anchor string, identifiers array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import yaml

        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                data = yaml.safe_load(text)
                lists = [(k, v) for k, v in data.items() if isinstance(k, str) and isinstance(v, list)] if isinstance(data, dict) else []
                found = [(k, i, f"{k}[{i}]", v) for k, values in lists for i, v in enumerate(values)] or [("root", 0, "root", data)]
                for key, i, anchor, value in found:
                    names = [value[n] for n in ("id", "name", "command") if isinstance(value.get(n), str)] if isinstance(value, dict) else []
                    line = text.count("\n", 0, max(0, text.find(key))) + 1
                    rows.append((path, key, i, json.dumps(value, sort_keys=True, default=str), line, anchor, sorted({anchor, *names})))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "key", "position", "record", "line", "anchor", "identifiers"])

    return files.select("path", "text").mapInArrow(run, schema)


def referenced_paths(records: DataFrame) -> DataFrame:
    """Relative paths under any `path` key of the records' JSON, at any depth; sorted, each once."""
    found = records.select(F.explode(F.regexp_extract_all("record", F.lit(r'"path": ?"([^"]+)"'), F.lit(1))).alias("path"))
    sound = F.contains("path", F.lit("/")) & ~F.col("path").rlike("^(/|catalog/|http)")
    return found.where(sound).distinct().orderBy("path")


def path_references(records: DataFrame) -> DataFrame:
    """(repository, path, file) of referenced_paths with the repository that their file names; records: repository, path (the file), record. A file without a repository is an error."""
    held = records.withColumn("repository", F.coalesce("repository", F.raise_error(F.concat(F.lit("no repository is named in "), F.col("path"))).cast("string")))
    found = held.select("repository", F.col("path").alias("file"), F.explode(F.regexp_extract_all("record", F.lit(r'"path": ?"([^"]+)"'), F.lit(1))).alias("path"))
    sound = F.contains("path", F.lit("/")) & ~F.col("path").rlike("^(/|catalog/|http)")
    return found.where(sound).select("repository", "path", "file").distinct().orderBy("repository", "path", "file")


def repeated_ids(entries: DataFrame) -> DataFrame:
    """(id, first, other): ids (id, path) that a later file has again; the first file in order of paths is the one that keeps it."""
    files = entries.where(F.col("id").isNotNull()).select("id", "path").distinct()
    first = files.groupBy("id").agg(F.min("path").alias("first"), F.count("*").alias("_n")).where("_n > 1")
    return files.join(first, "id").where(F.col("path") != F.col("first")).select("id", "first", F.col("path").alias("other")).orderBy("id", "other")


def missing_paths(referenced: DataFrame, existing: DataFrame) -> DataFrame:
    return referenced.join(existing.select("path"), "path", "left_anti")


def scanned_files(specs: DataFrame, files: DataFrame) -> DataFrame:
    """specs (path, max_bytes, required) against files (path, data): accepted rows with their text, or the reason why not; a required one that fails fails the query."""
    rows = specs.join(files, "path", "left")
    text = F.try_validate_utf8(F.col("data").cast("string"))
    code = (
        F.when(F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), ".."), "outside").when(F.col("data").isNull(), "missing")
        .when(F.octet_length("data") > F.col("max_bytes"), "oversized").when(text.isNull(), "encoding")
    )
    out = rows.select("path", "required", code.alias("rejection"), F.when(code.isNull(), F.regexp_replace(text, "\r\n?", "\n")).alias("content"))
    return out.where(F.assert_true(~F.col("required") | F.col("rejection").isNull(), F.lit("a required source was rejected")).isNull())


def package_fields(data: bytes, magic: str) -> list[tuple[str, bytes]]:
    """Fields of a package: big-endian length, zlib stream of magic, then key, 0, length, bytes again and again."""
    if len(data) < 4:
        raise ValueError("shorter than its length prefix")
    raw = zlib.decompress(data[4:])
    if len(raw) != struct.unpack(">I", data[:4])[0]:
        raise ValueError("another length than declared")
    name, at = _string(raw, 0)
    if name != magic:
        raise ValueError("another magic")
    out = []
    while at < len(raw):
        key, at = _string(raw, at)
        (size,) = struct.unpack_from(">i", raw, at)
        at += 4
        if size < 0 or at + size > len(raw):
            raise ValueError(f"field {key} has a wrong length")
        out.append((key, raw[at : at + size]))
        at += size
    return out


def _string(raw: bytes, at: int) -> tuple[str, int]:
    end = raw.index(b"\0", at)
    return raw[at:end].decode(), end + 1


def imports(data: bytes) -> tuple[str, list[tuple[str, int, int, bytes]]]:
    """Code and imports (tag, offset, size, payload) of an import table: a zero, code, a count, then entries whose offsets start after the zero."""
    (header,) = struct.unpack_from(">h", data, 0)
    if header:
        raise ValueError("another header")
    code, at = _string(data, 2)
    (count,) = struct.unpack_from(">h", data, at)
    at += 2
    if count < 0:
        raise ValueError("a negative count")
    out = []
    for _ in range(count):
        tag, at = _string(data, at)
        offset, size = struct.unpack_from(">ii", data, at)
        at += 8
        if offset < 0 or size < 0 or 2 + offset + size > len(data):
            raise ValueError(f"import {tag} is out of range")
        out.append((tag, offset, size, data[2 + offset : 2 + offset + size]))
    return code, out


def packages(files: DataFrame, magic: str) -> DataFrame:
    """files (path, content) as (path, key, value, error): one row a field, or one with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(path, k, v, None) for k, v in package_fields(data, magic)]
                except (ValueError, struct.error, zlib.error) as error:
                    rows.append((path, None, None, str(error)))
            if rows:
                kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "key", "value", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, key string, value binary, error string")


def descriptor_properties(lines: DataFrame) -> DataFrame:
    """(path, name, kind, value, duplicate) of lines (path, line_no, line): `property string|bool name: value`."""
    pattern = r'^\s*property (string|bool) ([^:]+):\s*(?:"(.*)"|(true|false))\s*;*\s*$'
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = lines.where(F.col("line").rlike(pattern) & ~F.ltrim("line").startswith("//"))
    sound = (part(1) == "bool") == (part(4) != "")
    rows = rows.where(sound).select("path", "line_no", F.trim(part(2)).alias("name"), part(1).alias("kind"), F.when(part(1) == "bool", part(4)).otherwise(part(3)).alias("value"))
    first = rows.groupBy("path", "name").agg(F.min_by(F.struct("kind", "value"), "line_no").alias("x"), (F.count("*") > 1).alias("duplicate"))
    return first.select("path", "name", "x.kind", "x.value", "duplicate")


def colon_descriptor(line: Column) -> Column:
    """output:lisp:qml:fullscreen:readme:name as a struct; null if there aren't six fields or the flag is not 0 or 1."""
    f = F.split(F.trim(line), ":")
    names = ("output", "lisp", "qml", "fullscreen", "readme", "name")
    return F.when((F.size(f) == 6) & f[3].isin("0", "1"), F.struct(*[(f[i] == "1" if n == "fullscreen" else f[i]).alias(n) for i, n in enumerate(names)]))


def package_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All descriptors below a folder but for those in hidden and build folders, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return files.where(~F.col("path").rlike(r"/(\.[^/]+|target|node_modules)/")).orderBy("path")


def flame_frames(text: DataFrame) -> DataFrame:
    """(function, samples, percent) of titles `name (1,234 samples, 5.6%)` in lines."""
    pattern = r"<title>(.*) \(([\d,]+) samples, ([\d.]+)%\)</title>"
    rows = text.where(F.col("line").rlike(pattern))
    return rows.select(
        F.regexp_extract("line", pattern, 1).alias("function"), F.replace(F.regexp_extract("line", pattern, 2), F.lit(","), F.lit("")).cast("bigint").alias("samples"),
        F.regexp_extract("line", pattern, 3).cast("double").alias("percent"),
    )


def feedback_records(rows: DataFrame) -> DataFrame:
    return rows.select("*", normalised_list(F.col("tags")).alias("sorted_tags"))


def json_records(files: DataFrame, keys: list[str]) -> DataFrame:
    """(path, key, position, record): elements of the named top-level lists of JSON texts, without a schema, natively."""
    parts = [F.struct(F.lit(k).alias("key"), F.from_json(F.get_json_object("text", f"$.{k}"), "array<string>", {"allowUnquotedFieldNames": "true"}).alias("items")) for k in keys]
    each = files.select("path", F.explode(F.array(*parts)).alias("x")).where("x.items is not null")
    return each.select("path", "x.key", F.posexplode("x.items").alias("position", "record"))


def perf_stacks(lines: DataFrame) -> DataFrame:
    """Stacks of a perf script (file, line_no, line): frames `address name (object)` of each sample, leaf first; a line that isn't indented starts a sample."""
    from pyspark.sql.window import Window

    head = ~F.col("line").rlike(r"^\s") & (F.trim("line") != "")
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("sample", F.sum(head.cast("int")).over(order)).where(F.col("line").rlike(r"^\s+[0-9a-f]+ "))
    name = F.regexp_replace(F.regexp_extract("line", r"^\s+[0-9a-f]+ (.*?)(?: \([^()]*\))?$", 1), r"\+0x[0-9a-f]+$", "")
    frames = F.array_sort(F.collect_list(F.struct("line_no", name.alias("name"))))
    return rows.groupBy("file", "sample").agg(F.transform(frames, lambda f: f["name"]).alias("frames"))


def missing_assets(descriptors: DataFrame, files: DataFrame, required: list[str]) -> DataFrame:
    """(path, name, value) of descriptor properties that name a file which isn't there; an empty optional one is none."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    rows = descriptors.where(F.col("name").isin(required) & (F.col("value") != "")).withColumn("_f", F.concat(folder, F.col("value")))
    return rows.join(files.select(F.col("path").alias("_f")), "_f", "left_anti").select("path", "name", "value")


def under_root(path: Column, root: str) -> Column:
    """Whether a normalised path stays below a root."""
    return path.startswith(root.rstrip("/") + "/") & ~F.array_contains(F.split(path, "/"), "..")
