"""Settings with their defaults, and the loader that also takes older layouts."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Retrieval:
    rrf_k: int = 60
    fts_limit: int = 40
    vector_limit: int = 40
    top_k: int = 12
    token_budget: int = 2400
    max_per_document: int = 2


@dataclass(frozen=True)
class Chunking:
    size: int = 512
    min_chars: int = 24
    table_rows: int = 3
    overlap: int = 64


@dataclass(frozen=True)
class Crawl:
    max_pages: int = 500
    concurrency: int = 4
    timeout_ms: int = 30_000


@dataclass(frozen=True)
class Embedding:
    provider: str = "hashed"
    model_id: str = "hashed-64"
    dims: int = 64
    batch_size: int = 20
    parallel: int = 4
    base_url: str = ""
    api_key: str = ""


@dataclass(frozen=True)
class Rerank:
    provider: str = "none"
    model: str = ""
    base_url: str = ""
    api_key: str = ""


@dataclass(frozen=True)
class Settings:
    retrieval: Retrieval = field(default_factory=Retrieval)
    chunking: Chunking = field(default_factory=Chunking)
    crawl: Crawl = field(default_factory=Crawl)
    embeddings: Embedding = field(default_factory=Embedding)
    rerank: Rerank = field(default_factory=Rerank)


def lifted(raw: dict) -> dict:
    """A copy in today's layout: provider settings that older files nest one level deeper move up, never over a newer value."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in raw.items()}
    for section, nest in (("embeddings", "openai"), ("rerank", "cohere")):
        inner = out.get(section, {}).pop(nest, None) if isinstance(out.get(section), dict) else None
        for k, v in (inner or {}).items():
            out[section].setdefault(k, v)
    if isinstance(out.get("proxy"), str):
        out["proxy"] = {"url": out["proxy"]}
    return out


def load(raw: dict | None = None, cls=Settings):
    """Settings from nested dicts; unknown keys are ignored, known ones checked for type."""
    raw = lifted(raw or {}) if cls is Settings else raw or {}
    values = {}
    for f in fields(cls):
        if f.name not in raw:
            continue
        default = f.default_factory() if callable(f.default_factory) else f.default
        value = raw[f.name]
        if is_dataclass(default):
            values[f.name] = load(value, type(default))
        elif isinstance(value, type(default)):
            values[f.name] = value
        else:
            raise ValueError(f"{f.name}: {type(default).__name__} expected, not {value!r}")
    return cls(**values)


def secret(value: str, environment: dict[str, str] | None = None) -> str:
    """A key as given, or from the environment if written as $NAME."""
    return (environment or os.environ).get(value[1:], "") if value.startswith("$") else value


def api_base(url: str) -> str:
    """A base URL without trailing slash; a bare host gets /v1."""
    url = url.strip().rstrip("/")
    head, sep, rest = url.partition("://")
    return f"{url}/v1" if sep and "/" not in rest and head else url


def bypasses_proxy(host: str, port: int | None, rules: str) -> bool:
    """Whether a list of rules (as in no_proxy) exempts a host: *, a host, host:port, or a domain as .domain or *.domain."""
    name = host.lower().rstrip(".")
    for rule in (r.strip().lower() for r in rules.split(",")):
        plain, _, at = rule.rpartition(":") if re.search(r":\d+$", rule) else (rule, "", "")
        suffix = plain.removeprefix("*")
        if rule == "*" or (plain and (not at or at == str(port)) and (name == plain or (suffix.startswith(".") and name.endswith(suffix)))):
            return True
    return False
