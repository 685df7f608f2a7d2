"""OpenAPI and Swagger descriptions to one markdown document each."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def parse(text: str):
    """JSON if it starts like it, else YAML; a blank text is an error."""
    s = text.strip()
    if not s:
        raise ValueError("empty OpenAPI document")
    if s[0] in "{[":
        return json.loads(s)
    import yaml

    return yaml.safe_load(s)


def is_description(spec) -> bool:
    return isinstance(spec, dict) and (isinstance(spec.get("openapi"), str) or str(spec.get("swagger")) == "2.0" or (isinstance(spec.get("paths"), dict) and isinstance(spec.get("info"), dict)))


def _resolved(spec: dict, node, depth: int = 0):
    """What a local reference points to."""
    while isinstance(node, dict) and isinstance(node.get("$ref"), str) and node["$ref"].startswith("#/") and depth < 20:
        target = spec
        for k in node["$ref"][2:].split("/"):
            target = target.get(k.replace("~1", "/").replace("~0", "~"), {}) if isinstance(target, dict) else {}
        node, depth = target, depth + 1
    return node if isinstance(node, dict) else {}


def _type(schema) -> str:
    if not isinstance(schema, dict):
        return "any"
    if isinstance(schema.get("$ref"), str):
        return schema["$ref"].rsplit("/", 1)[-1]
    for k, sep in (("oneOf", " | "), ("anyOf", " | "), ("allOf", " & ")):
        if isinstance(schema.get(k), list):
            return sep.join(_type(x) for x in schema[k])
    kind = schema.get("type", "object" if "properties" in schema else "any")
    kind = " | ".join(map(str, kind)) if isinstance(kind, list) else str(kind)
    if kind == "array":
        return f"{_type(schema.get('items'))}[]"
    return f"{kind} ({schema['format']})" if schema.get("format") else kind


def _cell(x) -> str:
    return re.sub(r"\s+", " ", str(x or "")).strip().replace("|", "\\|")


def _rows(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(map(_cell, r)) + " |" for r in rows), ""]


def _content(content) -> list[str]:
    return [f"- `{media}`: {_type((body or {}).get('schema'))}" for media, body in sorted((content or {}).items())]


def markdown(spec: dict) -> str:
    """Title, servers, tags, then every path and method in order, then the schemas."""
    info = spec.get("info") or {}
    out = [f"# {info.get('title') or 'API'}", ""]
    out += [f"Version: {info['version']}", ""] if info.get("version") else []
    out += [str(info["description"]).strip(), ""] if info.get("description") else []
    servers = [s.get("url", "") for s in spec.get("servers") or [] if isinstance(s, dict)]
    if not servers and spec.get("host"):
        servers = [f"{(spec.get('schemes') or ['https'])[0]}://{spec['host']}{spec.get('basePath', '')}"]
    out += ["## Servers", "", *(f"- {s}" for s in servers), ""] if servers else []
    tags = [t for t in spec.get("tags") or [] if isinstance(t, dict)]
    out += ["## Tags", "", *(f"- **{t.get('name')}**" + (f": {_cell(t['description'])}" if t.get("description") else "") for t in tags), ""] if tags else []
    for path, item in sorted((spec.get("paths") or {}).items()):
        item = _resolved(spec, item)
        for method in METHODS:
            if method not in item:
                continue
            op = _resolved(spec, item[method])
            out += [f"## {method.upper()} {path}", ""]
            out += [f"**{_cell(op['summary'])}**", ""] if op.get("summary") else []
            out += ["Deprecated.", ""] if op.get("deprecated") else []
            out += [str(op["description"]).strip(), ""] if op.get("description") else []
            out += [f"Operation: `{op['operationId']}`", ""] if op.get("operationId") else []
            given = [_resolved(spec, p) for p in [*(item.get("parameters") or []), *(op.get("parameters") or [])]]
            plain = [p for p in given if p.get("in") != "body"]
            if plain:
                out += ["### Parameters", "", *_rows(["Name", "In", "Type", "Required", "Description"], [[p.get("name"), p.get("in"), _type(p.get("schema") or p), "yes" if p.get("required") else "no", p.get("description")] for p in plain])]
            body = _resolved(spec, op.get("requestBody"))
            lines = _content(body.get("content")) + [f"- {_type(p.get('schema'))}" for p in given if p.get("in") == "body"]
            out += ["### Request body", "", *([_cell(body["description"]), ""] if body.get("description") else []), *lines, ""] if lines else []
            answers = sorted((op.get("responses") or {}).items(), key=lambda x: str(x[0]))
            out += ["### Responses", ""] if answers else []
            for code, answer in answers:
                answer = _resolved(spec, answer)
                out.append(f"- **{code}** {_cell(answer.get('description'))}".rstrip())
                out += ["  " + x for x in _content(answer.get("content")) + ([f"- {_type(answer['schema'])}"] if answer.get("schema") else [])]
            out += [""] if answers else []
    schemas = (spec.get("components") or {}).get("schemas") or spec.get("definitions") or {}
    out += ["## Schemas", ""] if schemas else []
    for name, schema in sorted(schemas.items()):
        schema = schema if isinstance(schema, dict) else {}
        out += [f"### {name}", ""]
        out += [str(schema["description"]).strip(), ""] if schema.get("description") else []
        fields = schema.get("properties") or {}
        if fields:
            out += _rows(["Field", "Type", "Required", "Description"], [[k, _type(v), "yes" if k in (schema.get("required") or []) else "no", (v or {}).get("description")] for k, v in sorted(fields.items())])
        else:
            out += [f"Type: {_type(schema)}", *([f"Values: {', '.join(map(str, schema['enum']))}"] if schema.get("enum") else []), ""]
    return "\n".join(out).strip() + "\n"


def document(text: str) -> dict:
    spec = parse(text)
    if not is_description(spec):
        raise ValueError("not an OpenAPI description")
    info = spec.get("info") or {}
    return {"title": str(info.get("title") or "API"), "markdown": markdown(spec), "version": str(info["version"]) if info.get("version") is not None else None, "error": None}


def converted(text: Column) -> Column:
    """A struct of title, markdown, version and error (null if the text is a description)."""

    @F.pandas_udf("title string, markdown string, version string, error string")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for t in column:
            try:
                rows.append(document(t or ""))
            except Exception as e:  # a bad description is a row's result, not the job's end
                rows.append({"title": None, "markdown": None, "version": None, "error": f"{type(e).__name__}: {e}"[:300]})
        return pd.DataFrame(rows, columns=["title", "markdown", "version", "error"])

    return run(text)
