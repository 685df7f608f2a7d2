"""Text functions as columns: cleaners, titles, hashes, token estimates, redaction.

Lengths count code points. All of it stays inside generated code.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of documentation noise and of secrets.
HEADING_NOISE = (
    (r"\[\]\([^)]*\)", ""),
    (r"\[¶\]\([^)]*\)", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\s*\{#[^}]+\}", ""),
    (r"(?i)\s*Direct link to\s+.+$", ""),
    (r"(?i)\s*Permalink(?:\s+to\s+.+)?$", ""),
    (r"¶+", ""),
    (r"^#{1,6}\s+", ""),
    (r"\s+", " "),
)
BODY_NOISE = (
    (r"(?s)<!--.*?-->", ""),
    (r"\[\]\([^)]*\)", ""),
    (r"\[¶\]\([^)]*\)", ""),
    (r"¶+", ""),
    (r"\[([^\]]+)\]\(([^)]+)\)", "$1"),
    (r"(?i)</?(?:span|div|br|hr)[^>]*>", "\n"),
    (r"(?m)[ \t]+$", ""),
    (r"\n{3,}", "\n\n"),
    (r"[^\S\n]{2,}", " "),
)
BRAND = r"\s*[|–—]\s*[^|–—]{1,40}$"
DOCS_SUFFIX = r"(?i)\s+[—–-]\s*(Docs?|Documentation|Manual|Guide)$"
SECRETS = (
    (r"(?i)(Authorization:\s*Bearer\s+)(\S+)", "$1***"),
    (r"(Bearer\s+)([A-Za-z0-9._\-+/=]{8,})", "$1***"),
    (r"""(?i)\b(api[_-]?key|token|secret|password)\b([=:]\s*)(["']?)([^\s"'\\]{6,})\3""", "$1$2$3***$3"),
    (r"\b(sk-[A-Za-z0-9]{10,}|sk-proj-[A-Za-z0-9_-]{10,}|co_[A-Za-z0-9]{10,})\b", "***"),
)
EDGE = r"^[\p{P}\p{S}\p{Z}]+|[\p{P}\p{S}\p{Z}]+$"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def replaced(x: Column, rules) -> Column:
    for pattern, new in rules:
        x = F.regexp_replace(x, F.lit(pattern), F.lit(new))
    return x


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def clean_heading(x: Column) -> Column:
    return blank_to_null(strip(replaced(x, HEADING_NOISE)))


def clean_body(x: Column) -> Column:
    return strip(replaced(x, BODY_NOISE))


def clean_markdown(x: Column) -> Column:
    """clean_body, then clean_heading on every heading line."""

    def line(y: Column) -> Column:
        head = F.regexp_extract(y, r"^(#{1,6})\s+(.+)$", 1)
        title = clean_heading(F.regexp_extract(y, r"^(#{1,6})\s+(.+)$", 2))
        return F.when((head != "") & title.isNotNull(), F.concat(head, F.lit(" "), title)).otherwise(y)

    lines = F.array_join(F.transform(F.split(clean_body(x), "\n"), line), "\n")
    return strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def normalize_title(x: Column) -> Column:
    """A heading without one brand suffix and without a documentation suffix; Untitled if nothing is left."""
    s = F.coalesce(clean_heading(x), F.lit(""))
    s = strip(F.regexp_replace(s, BRAND, ""))
    s = strip(F.regexp_replace(s, DOCS_SUFFIX, ""))
    return F.coalesce(blank_to_null(s), F.lit("Untitled"))


def redact(x: Column) -> Column:
    return replaced(x, SECRETS)


def short_id(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def estimate_tokens(x: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for an empty text."""
    return F.ceil(F.length(x) / 4).cast("int")


def strip_edge_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, EDGE, "")


def for_dedup(x: Column) -> Column:
    return F.lower(strip(F.regexp_replace(x, r"\s+", " ")))


def near_duplicate(kept: Column, candidate: Column) -> Column:
    """functions.plain.near_duplicate of each pair; null counts as blank. For pairs that a join has proposed."""
    from tidepool.functions import plain

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([plain.near_duplicate(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=bool)

    return same(kept, candidate)


#: A heading, a fence, an indented line or a row of a table.
STRUCTURE = r"(?m)^#{1,6}\s+\S|^(?: {4}|\t)\S|^\|.+\|$|```[\s\S]*?```"
#: Characters of a page with content of its own, words that count as one, and links for each of those.
ENOUGH, WORDS_OF_ONE, CROWDED = 80, 4, 0.6


def is_boilerplate(markdown: Column) -> Column:
    """Whether a page has no content of its own: no structure, and little or link-heavy text. Null counts as blank."""
    page = F.coalesce(markdown, F.lit(""))
    flat = strip(F.regexp_replace(page, r"\s+", " "))
    words = F.greatest(F.size(F.split(flat, " ")) / WORDS_OF_ONE, F.lit(1.0))
    links = F.regexp_count(page, F.lit(r"\[[^\]]+\]"))
    return ~page.rlike(STRUCTURE) & ((F.length(flat) < ENOUGH) | (links > CROWDED * words))


def _joined(parts: list[Column], sep: str) -> Column:
    return F.concat_ws(sep, *[blank_to_null(strip(p)) for p in parts])


def embed_text(title: Column, section: Column, body: Column) -> Column:
    """What an embedder reads of a chunk: title and section, a blank line, the body."""
    head = F.concat_ws("\n", clean_heading(title), clean_heading(section))
    return F.regexp_replace(F.concat(head, F.lit("\n\n"), clean_body(body)), "^\n\n", "")


def rerank_text(title: Column, heading: Column, text: Column) -> Column:
    return _joined([title, heading, text], "\n")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_uri(path: Column) -> Column:
    """file:// URI of an absolute path, with unsafe characters escaped."""
    escaped = F.regexp_replace(F.regexp_replace(F.url_encode(path), "%2F", "/"), r"\+", "%20")
    return F.concat(F.lit("file://"), escaped)


def uri_path(uri: Column) -> Column:
    """The path of a file URI; null for other URIs."""
    return F.when(uri.startswith("file://"), F.try_url_decode(F.regexp_replace(F.substring(uri, 8, 1 << 30), r"\+", "%2B")))


def display_uri(uri: Column) -> Column:
    return F.coalesce(uri_path(uri), uri)
