"""Scalar text functions as column expressions, and their driver-side twins for single queries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}]+"
RAW_SPLIT = r"[^\p{L}\p{N}_-]+"

#: Words that widen a query. More, or other ones, are a parameter of every function that expands.
ALIASES = {
    "persist": ["nvm", "read_nvm", "write_nvm"],
    "persistence": ["nvm", "read_nvm", "write_nvm"],
    "persistent": ["nvm", "read_nvm", "write_nvm"],
    "application": ["app_data", "send_app_data"],
    "custom": ["app_data", "send_app_data", "comm", "command", "transport"],
    "lifecycle": ["pkgdesc", "build", "load", "native"],
    "extension": ["native", "lbm"],
    "values": ["encode", "decode"],
    "gating": ["foc", "feature", "audio"],
    "enablement": ["foc", "feature", "audio"],
    "dialect": ["schema", "pkgdesc", "descriptor"],
    "description": ["schema", "pkgdesc", "descriptor"],
    "transport": ["send_app_data", "command"],
    "source": ["provenance", "repository", "trust"],
    "paths": ["sandbox", "artifact", "pkgdesc", "build"],
    "path": ["sandbox", "artifact", "pkgdesc", "build"],
}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, repeats kept."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def raw_terms(query: Column) -> Column:
    """Query terms: runs of letters, digits, _ and - with a letter or digit in them, in lower case, repeats kept."""
    return F.transform(F.filter(F.split(query, RAW_SPLIT), lambda t: t.rlike(r"[\p{L}\p{N}]")), F.lower)


def symbol_terms(query: Column) -> Column:
    """Those terms that look like symbols: with _, a digit or an upper-case letter."""
    looks = F.filter(F.split(query, RAW_SPLIT), lambda t: t.rlike(r"[\p{L}\p{N}]") & t.rlike(r"[_0-9\p{Lu}]"))
    return F.transform(looks, F.lower)


def raw_terms_of(query: str) -> list[str]:
    return [t.lower() for t in re.split(r"[^\w-]+", query) if any(c.isalnum() for c in t)]


def symbol_terms_of(query: str) -> list[str]:
    found = [t for t in re.split(r"[^\w-]+", query) if any(c.isalnum() for c in t)]
    return [t.lower() for t in found if "_" in t or any(c.isdigit() and c.isascii() or c.isupper() for c in t)]


def expanded_terms_of(query: str, aliases: dict[str, list[str]] | None = None) -> list[str]:
    """Each raw term, its parts at _ and -, then its aliases; the first of equal ones stays."""
    known = ALIASES if aliases is None else aliases
    out: dict[str, None] = {}
    for term in raw_terms_of(query):
        out[term] = None
        out |= dict.fromkeys(p for p in re.split("[_-]", term) if p)
        out |= dict.fromkeys(known.get(term, []))
    return list(out)


def expanded_terms(query: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    known = ALIASES if aliases is None else aliases
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if known else None
    none = F.array().cast("array<string>")

    def widen(term: Column) -> Column:
        parts = F.filter(F.split(term, "[_-]"), lambda p: p != "")
        return F.concat(F.array(term), parts, F.coalesce(F.element_at(table, term), none) if known else none)

    return F.array_distinct(F.flatten(F.transform(raw_terms(query), widen)))


def valid_identifier(token: Column) -> Column:
    return token.rlike(r"^[A-Za-z][A-Za-z0-9_]{2,127}$")


def symbol_like(token: Column) -> Column:
    return token.rlike(r"[_0-9A-Z]")


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def identifiers(path: Column, content: Column, most: int = 32) -> Column:
    """The path, the file's stem, then symbol-like and after them all valid tokens; the first `most` different ones, sorted."""
    valid = F.regexp_extract_all(content, F.lit("(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_]{2,127}+(?![A-Za-z0-9_])"), F.lit(0))
    # within transform the tokens are found once for both of their uses, and each different one is looked at once
    ordered = F.transform(F.array(F.array_distinct(valid)), lambda found: F.concat(F.array(path, file_stem(path)), F.filter(found, symbol_like), found))
    return F.array_sort(F.slice(F.array_distinct(F.element_at(ordered, 1)), 1, most))


def morphology(text: Column) -> Column:
    """Stems (four letters at least) of ASCII words that end in -ence."""
    words = F.filter(F.split(text, "[^A-Za-z]+"), lambda w: w.rlike("^.{4,}ence$"))
    return F.transform(words, lambda w: F.left(w, F.length(w) - 4))


def normalised_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated_utf8(text: Column, limit: int) -> Column:
    """At most `limit` bytes, cut before the character that would cross it: whole native, by dropping a torn tail."""
    raw = F.substring(text.cast("binary"), 1, limit)
    kept = [F.substring(raw, F.lit(1), F.greatest(F.octet_length(raw) - k, F.lit(0))) for k in range(4)]
    whole = F.coalesce(*[F.try_validate_utf8(k.cast("string")) for k in kept])
    return F.when(F.octet_length(text) <= limit, text).otherwise(whole)


def excerpt(text: Column, anchor: Column, limit: int = 384) -> Column:
    """A window around the anchor (a character position from 1; null: the start) with marks where it is cut, in at most `limit` bytes."""
    start = F.coalesce(F.greatest(anchor - F.lit(limit // 2), F.lit(1)), F.lit(1))
    body = F.substring(text, start, F.lit(limit))
    before = F.when(start > 1, F.lit("…")).otherwise(F.lit(""))
    after = F.when(start + limit <= F.length(text), F.lit("…")).otherwise(F.lit(""))
    return truncated_utf8(F.concat(before, body, after), limit)


def symbol_anchor(text: Column, symbols: Column) -> Column:
    """Where the first of the symbols stands alone in the text, else the first snake_case token; null if none does."""
    at = F.filter(
        F.transform(symbols, lambda s: F.regexp_instr(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])"), s, F.lit(r"(?![A-Za-z0-9_])")))), lambda p: p > 0
    )
    snake = F.regexp_instr(text, F.lit(r"(?<![A-Za-z0-9_])(?=[0-9_]*[A-Za-z])[A-Za-z0-9]*_[A-Za-z0-9_]*"))
    return F.coalesce(F.try_element_at(at, F.lit(1)), F.when(snake > 0, snake))


def release_numbers(name: Column) -> Column:
    """The numbers of `release_…`, `v…` or plain versions, null where none stands first; arrays compare number by number."""
    bare = F.regexp_replace(name, "^(release_|v)", "")
    numbers = F.transform(F.regexp_extract_all(bare, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("bigint"))
    return F.when(bare.rlike(r"^\d"), numbers)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "-")


def percent_encoded(path: Column) -> Column:
    """RFC 3986 per path segment."""
    coded = F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(coded, F.lit("%2F"), F.lit("/"))


def percent_decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def warning_code(warning: Column) -> Column:
    return F.trim(F.substring_index(warning, ":", 1))


def normalised_list(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(values, lambda v: F.trim(v))))


def remote_identity(url: Column) -> Column:
    """A remote's address without credentials, query and trailing .git."""
    return F.regexp_replace(F.regexp_replace(url, r"^([a-z+]+://)[^/@]*@", "$1"), r"(\.git)?/?([?#].*)?$", "")


def attribution(repository: Column, path: Column, line: Column) -> Column:
    return F.concat_ws(":", repository, path, line.cast("string"))


def function_category(name: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first rule of which a part is contained in the lower-case name."""
    out = F.lit("other")
    for label, parts in reversed(rules):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(F.lower(name), F.lit(p))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def resource_uri(uri: Column, scheme: str = "corpus") -> Column:
    """struct(kind, snapshot, id): scheme://knowledge/{chunk|document|feedback}/id, with a 64-digit snapshot or without; kind null if malformed."""
    pattern = rf"^{scheme}://knowledge/(?:snapshots/([0-9a-f]{{64}})/)?(chunk|document|feedback)/([^/?#]+)$"
    part = lambda i: F.nullif(F.regexp_extract(uri, pattern, i), F.lit(""))
    return F.struct(part(2).alias("kind"), part(1).alias("snapshot"), percent_decoded(part(3)).alias("id"))


def qualified_uri(uri: Column, snapshot: Column, scheme: str = "corpus") -> Column:
    return F.regexp_replace(uri, F.lit(rf"^{scheme}://knowledge/(chunk|document)/"), F.concat(F.lit(f"{scheme}://knowledge/snapshots/"), snapshot, F.lit("/$1/")))


def embedding_text(title: Column, headings: Column, names: Column, tags: Column, text: Column, concepts: dict[str, str] | None = None) -> Column:
    """What an embedder sees of a chunk: labelled lines for the parts that are not empty, at most 32 identifiers (of more, those that the text has or that have a concept)."""
    known = concepts or {}
    local = F.split(text, "[^A-Za-z0-9_]")
    chosen = F.when(F.size(names) > 32, F.slice(F.filter(names, lambda n: F.array_contains(local, n) | n.isin(*known) if known else F.array_contains(local, n)), 1, 32))
    shown = F.coalesce(chosen, names)
    line = lambda label, body: F.when(body != "", F.concat(F.lit(f"{label}: "), body, F.lit("\n"))).otherwise(F.lit(""))
    parts = [line("Title", F.coalesce(title, F.lit(""))), line("Headings", F.array_join(headings, " / ")), line("Identifiers", F.array_join(shown, ", "))]
    if known:
        table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        parts.append(line("Concepts", F.array_join(F.filter(F.transform(shown, lambda n: F.element_at(table, n)), lambda c: c.isNotNull()), "; ")))
    return F.concat(*parts, line("Tags", F.array_join(tags, ", ")), F.lit("Content: "), text)


def semantic_query(query: Column, rules: list[tuple[list[str], str]]) -> Column:
    """Appends the concept aliases whose trigger the query contains."""
    found = F.filter(F.array(*[F.when(_any_in(F.lower(query), triggers), F.lit(alias)) for triggers, alias in rules]), lambda a: a.isNotNull())
    return F.when(F.size(found) > 0, F.concat(query, F.lit("\nConcept aliases: "), F.array_join(found, "; "))).otherwise(query)


def _any_in(text: Column, parts: list[str]) -> Column:
    hit = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]
