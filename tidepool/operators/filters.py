"""Filters of a search: kinds, sources, keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds and their other names.
KINDS = {"prose": "prose", "table": "table", "code": "code", "text": "prose", "markdown": "prose", "md": "prose"}


def split_list(value: str | None) -> list[str]:
    return [x.strip() for x in (value or "").split(",") if x.strip()]


def parse_kinds(values: list[str]) -> list[str]:
    """Known kinds in order, once each; an unknown one is an error."""
    out: dict[str, None] = {}
    for v in values:
        name = KINDS.get(v.strip().lower())
        if name is None:
            raise ValueError(f"unknown kind {v!r}; known are {', '.join(sorted(set(KINDS.values())))}")
        out[name] = None
    return list(out)


def has_filters(kinds=(), sources=(), keywords=()) -> bool:
    return bool(kinds or sources or keywords)


def condition(kinds=(), sources=(), keywords=(), null_kind: bool = False, with_keywords: bool = True) -> Column | None:
    """All filters as one condition, None without any. null_kind: whether rows of unknown kind pass a filter of kinds."""
    parts: list[Column] = []
    if sources:
        parts.append(F.col("source_id").isin(list(sources)))
    if kinds:
        some = F.col("kind").isin(list(kinds))
        parts.append(F.col("kind").isNull() | some if null_kind else F.coalesce(some, F.lit(False)))
    if with_keywords:
        parts += [F.contains(F.lower("text"), F.lit(k.lower())) for k in keywords]
    return reduce(lambda a, b: a & b, parts) if parts else None


def resolve_source(sources, ref: str) -> str:
    """The id of the source with this id or root URI."""
    row = sources.where((F.col("id") == ref) | (F.col("root_uri") == ref)).select("id").first()
    if row is None:
        raise ValueError(f"no source {ref!r}")
    return row["id"]
