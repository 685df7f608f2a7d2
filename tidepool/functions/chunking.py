"""Markdown and code to chunks: prose, tables and code, with headings, offsets and overlap.

A document's chunks depend on each other through the overlap, so a document is
one unit of work; documents are independent and stream through one Pandas map.
Sizes and offsets count code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.config import Chunking
from tidepool.functions import plain
from tidepool.session import bounded_batches

# File extensions and their languages.
CODE = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".kt": "kotlin", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".h": "c", ".cs": "c_sharp", ".swift": "swift", ".scala": "scala",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".sql": "sql", ".r": "r", ".lua": "lua",
}
TEXT = (".md", ".mdx", ".txt", ".rst", ".html", ".htm", ".markdown")


def extension(path: Column) -> Column:
    """From the last dot on, in lower case; empty without a dot."""
    return F.regexp_extract(F.lower(path), r"(\.[^.]*)$", 1)


def language(path: Column) -> Column:
    """The language of a code file; null for others."""
    table = F.create_map(*[F.lit(x) for pair in CODE.items() for x in pair])
    return table[extension(path)]


def is_code(path: Column) -> Column:
    return extension(path).isin(list(CODE))


def is_text_document(path: Column) -> Column:
    """Text, code, or no extension at all."""
    return (extension(path) == "") | extension(path).isin(list(TEXT)) | is_code(path)


def language_of(path: str) -> str | None:
    dot = path.lower().rfind(".")
    return CODE.get(path.lower()[dot:]) if dot >= 0 else None


@dataclass(frozen=True)
class Chunk:
    text: str
    kind: str
    heading: str | None = None
    section_path: str | None = None
    start: int | None = None
    end: int | None = None
    language: str | None = None


FENCE = re.compile(r"^(```|~~~)[ \t]*([\w+#.-]*)[^\n]*\n(.*?)(?:^\1[ \t]*$|\Z)", re.M | re.S)
TABLE = re.compile(r"^\|.+\|[ \t]*\n\|[ \t:|-]+\|[ \t]*(?:\n\|.*\|[ \t]*)*", re.M)


def parts(markdown: str) -> Iterator[tuple[str, int, int, str | None]]:
    """(kind, start, end, language): fences first, then tables in what lies between them, then prose."""

    def between(a: int, b: int):
        at = a
        for m in TABLE.finditer(markdown, a, b):
            yield "prose", at, m.start(), None
            yield "table", m.start(), m.end(), None
            at = m.end()
        yield "prose", at, b, None

    at = 0
    for m in FENCE.finditer(markdown):
        yield from between(at, m.start())
        yield "code", m.start(), m.end(), m[2] or None
        at = m.end()
    yield from between(at, len(markdown))


def headings(markdown: str) -> list[tuple[int, int, str]]:
    return [(m.start(), len(m[1]), plain.clean_heading(m[2]) or m[2].strip()) for m in plain.ATX.finditer(markdown)]


def breadcrumb(found: list[tuple[int, int, str]], at: int) -> tuple[str | None, str | None]:
    """The nearest heading before a place and the path of headings above it."""
    path: list[tuple[int, str]] = []
    for start, level, title in found:
        if start > at:
            break
        path = [p for p in path if p[0] < level] + [(level, title)]
    return (path[-1][1], " > ".join(t for _, t in path)) if path else (None, None)


#: Where prose may be cut, from the best place to the worst.
CUTS = (re.compile(r"\n\n+"), re.compile(r"\n"), re.compile(r"(?<=[.!?。！？…])\s+"), re.compile(r"\s+"))


def spans(text: str, size: int, least: int, level: int = 0, at: int = 0) -> list[tuple[int, int]]:
    """Neighbouring pieces of at most `size`, cut at the best places that do; pieces under `least` join their neighbour if both fit."""
    if len(text) <= size:
        return [(at, at + len(text))]
    if level == len(CUTS):
        return [(at + i, at + min(i + size, len(text))) for i in range(0, len(text), size)]
    ends = [m.end() for m in CUTS[level].finditer(text)]
    out: list[tuple[int, int]] = []
    start = 0
    for end in [*ends, len(text)]:
        if end == start:
            continue
        if out and at + end - out[-1][0] <= size:
            out[-1] = (out[-1][0], at + end)
        elif end - start <= size:
            out.append((at + start, at + end))
        else:
            out += spans(text[start:end], size, least, level + 1, at + start)
        start = end
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and (b - a < least or merged[-1][1] - merged[-1][0] < least) and b - merged[-1][0] <= size:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def _prose(markdown: str, a: int, b: int, s: Chunking, found) -> Iterator[Chunk]:
    for x, y in spans(markdown[a:b], s.size, s.min_chars):
        text = markdown[a + x : a + y]
        if text.strip():
            x += len(text) - len(text.lstrip())
            heading, path = breadcrumb(found, a + x)
            yield Chunk(text.strip(), "prose", heading, path, a + x, a + x + len(text.strip()))


def _table(markdown: str, a: int, b: int, s: Chunking, found) -> Iterator[Chunk]:
    lines = markdown[a:b].strip().split("\n")
    heading, path = breadcrumb(found, a)
    rows = lines[2:]
    for k in range(0, max(1, len(rows)), s.table_rows):
        yield Chunk("\n".join([*lines[:2], *rows[k : k + s.table_rows]]), "table", heading, path)


def _code(text: str, path: str, s: Chunking) -> Iterator[Chunk]:
    """Whole lines up to the size; a longer line is cut."""
    most, start = max(2 * s.size, 1024), 0
    pieces = []
    for m in re.finditer(r"[^\n]*\n|[^\n]+$", text):
        while m.end() - start > most:
            end = m.start() if m.start() > start else start + most
            pieces.append((start, end))
            start = end
    pieces.append((start, len(text)))
    for a, b in pieces:
        if text[a:b].strip():
            yield Chunk(text[a:b].strip("\n"), "code", plain.code_heading(text[a:b], path), plain.file_stem(path), a, b, language_of(path))


def chunk(markdown: str, uri: str = "", s: Chunking = Chunking()) -> list[Chunk]:
    """The chunks of a document in order, with overlap."""
    if language_of(uri) and (out := list(_code(markdown, uri, s))):
        return overlapped(out, s.overlap)
    found = headings(markdown)
    out = []
    for kind, a, b, lang in parts(markdown):
        if not markdown[a:b].strip():
            continue
        if kind == "code":
            heading, path = breadcrumb(found, a)
            out.append(Chunk(markdown[a:b].strip(), "code", heading or plain.code_heading(markdown[a:b], uri), path, a, b, lang))
        else:
            out += (_prose if kind == "prose" else _table)(markdown, a, b, s, found)
    return overlapped(out, s.overlap)


def overlapped(chunks: list[Chunk], overlap: int) -> list[Chunk]:
    """Each chunk begins with the end of the one before it, as that has become, if both are of a kind."""
    out: list[Chunk] = []
    for c in chunks:
        if out and overlap > 0 and out[-1].kind == c.kind and (tail := out[-1].text[-overlap:].strip()):
            c = replace(c, text=f"{tail}\n{c.text}")
        out.append(c)
    return out


#: Documents whose chunks leave a worker at once.
AT_ONCE = 100
KINDS = "chunk_index int, text string, heading string, section_path string, start_offset int, end_offset int, content_hash string, kind string, language string"


def chunked(docs: DataFrame, key: str = "id", markdown: str = "markdown", uri: str = "uri", settings: Chunking = Chunking(), keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per chunk: key and `keep` columns, and KINDS. Null and blank documents have none."""
    bounded_batches(docs.sparkSession)
    columns = list(dict.fromkeys([key, *keep]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a batch of documents leaves in parts, as its chunks are more than its texts
        for frame in (frame.iloc[k : k + AT_ONCE].reset_index(drop=True) for frame in frames for k in range(0, len(frame), AT_ONCE)):
            rows = []
            for i, (text, path) in enumerate(zip(frame["__markdown"], frame["__uri"], strict=True)):
                for n, c in enumerate(chunk(text or "", path or "", settings)):
                    rows.append((i, n, c.text, c.heading, c.section_path, c.start, c.end, hashlib.sha256(c.text.encode("utf-8", "replace")).hexdigest(), c.kind, c.language))
            out = pd.DataFrame(rows, columns=["__i", *(k.split()[0] for k in KINDS.split(", "))])
            for name in ("start_offset", "end_offset"):
                out[name] = out[name].astype("Int32")
            kept = frame[columns].iloc[out.pop("__i").to_numpy(int)].reset_index(drop=True)
            yield pd.concat([kept, out], axis=1)

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), KINDS])
    return docs.select(*columns, F.col(markdown).alias("__markdown"), F.col(uri).alias("__uri")).mapInPandas(run, kinds)
