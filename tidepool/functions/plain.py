"""Text helpers for code that folds over ordered rows or walks a page: the same rules as functions.text, on strings."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit

from tidepool.functions import text as rules


def _compiled(pairs):
    return [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", new)) for p, new in pairs]


_HEADING, _BODY = _compiled(rules.HEADING_NOISE), _compiled(rules.BODY_NOISE)
_BRAND, _SUFFIX = re.compile(rules.BRAND), re.compile(rules.DOCS_SUFFIX)
ATX = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def _apply(s: str, compiled) -> str:
    for pattern, new in compiled:
        s = pattern.sub(new, s)
    return s.strip()


def clean_heading(s: str | None) -> str | None:
    return _apply(s or "", _HEADING) or None


def clean_body(s: str) -> str:
    return _apply(s, _BODY)


def clean_markdown(s: str) -> str:
    def head(m: re.Match) -> str:
        title = clean_heading(m[2])
        return f"{m[1]} {title}" if title else m[0]

    return re.sub(r"\n{3,}", "\n\n", ATX.sub(head, clean_body(s))).strip()


def normalize_title(s: str | None) -> str:
    t = clean_heading(s) or ""
    return _SUFFIX.sub("", _BRAND.sub("", t).strip()).strip() or "Untitled"


def estimate_tokens(s: str) -> int:
    return -(-len(s) // 4)


def for_dedup(s: str) -> str:
    return " ".join(s.split()).lower()


#: Texts shorter than this aren't compared; the share of the longer text that the shorter one must have if
#: it lies within it, or if both begin with the same characters, so many at most.
COMPARABLE, INSIDE, ALIKE, HEAD = 48, 0.82, 0.75, 240


def near_duplicate(kept: str, candidate: str) -> bool:
    """Whether candidate adds little to kept; a blank side counts as a duplicate."""
    short, long = sorted((for_dedup(kept), for_dedup(candidate)), key=len)
    if short in ("", long):
        return True
    needed = [share for share, holds in ((INSIDE, short in long), (ALIKE, long.startswith(short[:HEAD]))) if holds]
    return len(short) >= COMPARABLE and any(len(short) >= share * len(long) for share in needed)


#: Where a text may be cut, the best places first: before a blank line, after a sentence, before a space.
CUT_POINTS = tuple(map(re.compile, (r"(?=\n\n)", r"[.!?。！？…]\s", r"(?= )")))
#: Fixed value: the share of the allowed characters that must be left in front of a cut.
LATE = 0.4


def truncate(s: str, most: int) -> str:
    """At most so many characters and an ellipsis, cut at the last of the best places that comes late enough."""
    if len(s) <= most or most <= 0:
        return s[: max(most, 0)]
    ends = (max((m.end() for m in cut.finditer(s, 0, most)), default=0) for cut in CUT_POINTS)
    at = next((end for end in ends if end >= max(1, int(most * LATE))), most)
    return f"{s[:at].rstrip()}\n…"


#: What makes a heading left-over code: nothing at all, an open end, a keyword or a test's call at its start.
LEFT_OVER = re.compile(r"(?s)|.*[{;]|(?:import|export|from|const|let|var|require)\b.*|(?:describe|context|suite|test|it|specify)\s*\(.*")


def is_weak_heading(s: str | None) -> bool:
    return LEFT_OVER.fullmatch((s or "").strip()) is not None


def file_stem(path: str) -> str | None:
    name = unquote(urlsplit(path).path) if "://" in path else path
    return name.rsplit("/", 1)[-1] or name or None


def section_label(heading: str | None, title: str | None, path: str | None, uri: str) -> str:
    """The heading, the title, or the section path, whichever comes first with something to say; else the file's name. A title may look like code."""
    named = [clean_heading(x) for x in (heading, title, path)]
    named[::2] = [None if is_weak_heading(x) else x for x in named[::2]]
    return next(filter(None, [*named, file_stem(uri)]), "Excerpt")


#: A heading line at a text's beginning, with the blank lines before it.
LEAD = re.compile(r"(?:[^\S\n]*\n)*[^\S\n]*#{1,6}\s+(?P<title>\S.*)(?:\n|$)")


def strip_lead(s: str, label: str | None) -> str:
    """Without a first heading line that repeats the label, unless nothing else would stay."""
    lead = LEAD.match(s) if label else None
    rest = s[lead.end() :].lstrip("\n") if lead else ""
    if not rest.strip():
        return s
    said, name = for_dedup(clean_heading(lead["title"]) or lead["title"]), for_dedup(label)
    repeats = said and (f"{said} ".startswith(f"{name} ") or name.startswith(said))
    return rest if repeats else s


#: What a line of code may declare: a test with its title, something with a name, or at least a thing of some kind.
DECLARATION = re.compile(
    r"""
    (?:describe|context|suite|test|it|specify) \s* \( \s* (?P<quote>['"`]) (?P<test>[^'"`]+) ['"`]
    | (?: (?:export|default|async|pub) \s+ )*
      (?: (?: function|class|def|fn|const|let|var|type|interface|enum | func (?:\s+\([^)]+\))? ) \s+ (?P<name>\w+)
        | (?P<thing> (?:function|class|interface|type|enum|fn|struct|impl|trait|mod) \b ) )
    """,
    re.X,
)
#: Lines that only comment or import.
ASIDE = re.compile(r"//|#|/?\*|<!--|(?:import|from|use|package)\s|require\(")
#: Lines that are looked at, and characters of a heading.
LOOKED_AT, LONGEST = 16, 120


def code_heading(code: str, path: str = "") -> str | None:
    """A name for a piece of code: what its first lines declare, else its file's name."""
    lines = (line.strip() for line in code.split("\n")[:LOOKED_AT])
    for line in lines:
        said = None if ASIDE.match(line) else DECLARATION.match(line)
        if said:
            return (said["test"] or said["name"] or re.sub(r"\s*[{=]\s*$", "", line))[:LONGEST]
    return file_stem(path) if path else None
