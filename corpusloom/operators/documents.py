"""Documents from tables: normalisation, identity, media types, path policy, budgets, rejections."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import ids, text

#: Media types by file extension.
MEDIA_TYPES = {
    "text/x-c": ["c", "h", "i", "inc"],
    "text/x-c++": [
        "c++", "cc", "cp", "cpp", "cppm", "cxx", "h++", "hh", "hp", "hpp", "hxx", "icc", "ii", "inl", "ipp", "ixx", "mpp", "tcc", "tpp", "txx",
    ],
    "application/json": ["json"],
    "text/markdown": ["md"],
    "text/x-qml": ["qml"],
    "text/x-rust": ["rs"],
    "application/toml": ["toml"],
    "application/yaml": ["yaml", "yml"],
}
CODE = [e for kind in ("text/x-c", "text/x-c++") for e in MEDIA_TYPES[kind]]


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.nullif(F.regexp_extract(name, r"^.+\.([^.]*)$", 1), F.lit("")))


def media_type(path: Column) -> Column:
    out = F.lit("text/plain")
    for kind, extensions in MEDIA_TYPES.items():
        out = F.when(extension(path).isin(extensions), F.lit(kind)).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """* and ? stay within a path segment, ** crosses them; brackets, backslashes and ** next to other characters are refused."""
    if not pattern or pattern.startswith("/") or re.search(r"[\[\]\\]|(?:^|/)\.\.?(?:/|$)|[^/*]\*\*|\*\*[^/*]", pattern):
        raise ValueError(f"a relative pattern of *, ** and ? is needed: {pattern!r}")
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    hit = path.rlike(glob_regex(pattern))
    return hit if "/" in pattern else hit | F.element_at(F.split(path, "/"), -1).rlike(glob_regex(pattern))


@dataclass(frozen=True)
class PathPolicy:
    include_prefixes: tuple[str, ...] = ()
    exclude_prefixes: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ("md", "json", "yaml", "yml", "toml", "qml", "rs", "txt")
    filenames: tuple[str, ...] = ()


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def selected(path: Column, policy: PathPolicy) -> Column:
    """Source code always; else what is not excluded and is included, or has a default extension or name where nothing is included."""
    under = lambda p: (path == p.strip("/")) | path.startswith(p.strip("/") + "/")
    excluded = _any([under(p) for p in policy.exclude_prefixes] + [matches_glob(path, p) for p in policy.exclude_patterns])
    named = _any([under(p) for p in policy.include_prefixes] + [matches_glob(path, p) for p in policy.include_patterns])
    usual = F.element_at(F.split(path, "/"), -1).isin(*policy.filenames or ("",)) | F.coalesce(extension(path).isin(*policy.extensions or ("",)), F.lit(False))
    chosen = named if policy.include_prefixes or policy.include_patterns else usual
    return F.coalesce(extension(path).isin(CODE), F.lit(False)) | (~excluded & chosen)


def document(df: DataFrame, title: Column, repository: Column, revision: Column, path: Column, content: Column, kind: str = "repository") -> DataFrame:
    """Normalised documents with digests, ids and spans beside df's own columns; invalid rows fail the query."""
    digest = ids.content_digest(content)
    sound = (F.trim(title) != "") & (F.trim(path) != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
    rows = df.select(
        "*", title.alias("title"), repository.alias("repository"), revision.alias("revision"), path.alias("path"), content.alias("content"),
        media_type(path).alias("media_type"), digest.alias("content_digest"), F.lit(kind).alias("source_kind"),
    )
    rows = rows.where(F.assert_true(F.coalesce(sound, F.lit(False)), F.lit("a document needs a title and a relative path")).isNull())
    return rows.select(
        "*",
        ids.document_id(F.col("repository"), F.col("revision"), F.col("path"), F.col("content_digest")).alias("document_id"),
        F.lit(1).alias("start_line"),
        F.greatest(F.regexp_count("content", F.lit("\n")) + (~F.endswith("content", F.lit("\n"))).cast("int"), F.lit(1)).alias("end_line"),
    )


def commit_messages(commits: DataFrame, most: int) -> DataFrame:
    """Documents of commits (commit_id, message): title from the first line that is not blank, text trimmed plus a newline; empty and oversized ones are left out."""
    body = F.regexp_replace(F.col("message"), r"^\s+|\s+$", "")
    title = F.trim(F.regexp_extract("message", r"(?m)^\s*(\S.*)$", 1))
    return commits.where((body != "") & (F.octet_length(body) + 1 <= most)).select(
        "commit_id", title.alias("title"), F.concat(F.lit("commits/"), F.col("commit_id")).alias("path"), F.concat(body, F.lit("\n")).alias("content")
    )


def loaded_blobs(blobs: DataFrame, most: int) -> DataFrame:
    """rejection (oversized, binary, encoding or null) and the text with LF line ends of blobs (…, data binary)."""
    data = F.col("data")
    whole = F.try_validate_utf8(F.try_to_binary(F.hex(data), F.lit("hex")).cast("string"))
    code = (
        F.when(F.octet_length(data) > most, "oversized")
        .when(F.instr(F.hex(data), "00") % 2 == 1, "binary")
        .when(F.hex(data).rlike("^(?:..)*?00"), "binary")
        .when(whole.isNull(), "encoding")
    )
    return blobs.select("*", code.alias("rejection"), F.when(code.isNull(), F.replace(whole, F.lit("\r\n"), F.lit("\n"))).alias("content"))


def rejection_report(rejected: DataFrame, by: list[str], order: list[str], sample: int = 64) -> DataFrame:
    """Exact counts with the first `sample` rows of each group: counts are an aggregate, and no task keeps more than `sample` rows of a group to sort."""
    ranked = rejected.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= sample)
    totals = rejected.groupBy(*by).agg(F.count("*").alias("total"))
    return ranked.join(totals, by)


def catalog_documents(entries: DataFrame, revision: str = "embedded-catalog-v1") -> DataFrame:
    """Catalog rows (id, name, category, summary, source, keywords) as one-line documents with their tags and identifiers."""
    return document(
        entries.select("*", F.array_sort(F.array_distinct("keywords")).alias("tags"), F.array_sort(F.array("name", "id")).alias("identifiers")),
        F.col("name"), F.col("source.repo"), F.lit(revision), F.col("source.path"), F.col("summary"), "catalog",
    )


def with_identifiers(df: DataFrame) -> DataFrame:
    return df.withColumn("identifiers", text.identifiers(F.col("path"), F.col("content")))
