"""Folders and repositories as DataFrames of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import chunking

# What a folder scan leaves out (folders, files, endings).
IGNORED = (
    "node_modules/", ".git/", "dist/", "build/", ".next/", "target/", "vendor/", "package-lock.json", "yarn.lock", "bun.lock", "bun.lockb", "pnpm-lock.yaml", "*.min.js", "*.map",
)
# Where repositories keep documentation.
DOC_FOLDERS = ("docs", "doc", "documentation", "guide", "guides", "website")
MOST_CHARS, MOST_BYTES, MOST_FILES = 2_000_000, 1_000_000, 500


def wanted(path: Column) -> Column:
    """Whether a folder scan takes a path (relative to its root)."""
    folders, ends, names = ([x.strip("/*") for x in IGNORED if mark(x)] for mark in (lambda x: x.endswith("/"), lambda x: x.startswith("*"), lambda x: x[0] != "*" and x[-1] != "/"))
    some = lambda parts: "(" + "|".join(map(re.escape, parts)) + ")"
    ignored = path.rlike(rf"(^|/){some(folders)}/|(^|/)\.|(^|/){some(names)}$") | F.lower(path).rlike(f"{some(ends)}$")
    globbed = chunking.extension(path).isin([*chunking.TEXT, *(x for x in chunking.CODE if x != ".zsh")])
    return ~ignored & globbed


def folder(spark: SparkSession, root: str) -> DataFrame:
    """path, uri and content of every wanted file below root, read by the executors; too long ones are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    base = F.lit(re.sub(r"^(file:)?/*", "/", root).rstrip("/") + "/")
    full = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    rows = rows.select(full.alias("path"), F.substring(full, F.length(base) + 1, F.lit(1 << 20)).alias("__rel"), "length", "content")
    rows = rows.where(wanted(F.col("__rel")) & (F.col("length") <= 4 * MOST_CHARS))
    text = F.decode("content", "UTF-8")
    return rows.select("path", F.concat(F.lit("file://"), "path").alias("uri"), text.alias("content")).where(F.length("content") <= MOST_CHARS)


def docs_like(path: Column) -> Column:
    """A readme anywhere, or a document in a documentation folder."""
    low = F.lower(path)
    return low.rlike(r"(^|/)readme(\.|$)") | (low.rlike("(^|/)(" + "|".join(DOC_FOLDERS) + ")/") & low.rlike(r"\.(md|mdx|txt|rst|html?)$"))


def prefer_docs(files: DataFrame, path: str = "path") -> DataFrame:
    """The documentation files of a checkout; all its files if there are none."""
    some = files.where(docs_like(F.col(path)))
    return files if some.isEmpty() else some


def tree_listing(tree: DataFrame, column: str = "json", most: int = MOST_FILES) -> DataFrame:
    """path and size of the documentation blobs in a repository's tree listing, the first ones by position (of several listings, then by path)."""
    kind = "tree array<struct<path: string, type: string, size: bigint>>"
    rows = tree.select(F.posexplode(F.from_json(column, kind)["tree"]).alias("pos", "item")).select("pos", "item.*")
    rows = rows.where((F.col("type") == "blob") & (F.coalesce("size", F.lit(0)) < MOST_BYTES) & docs_like(F.col("path")))
    return rows.orderBy("pos", "path").limit(most).select("path", "size")


_WEB = re.compile(r"(?:https?://)?(?:www\.)?github\.com/([^/]+)/([^/#?]+)(?:/(?:tree|blob)/([^/]+))?", re.I)
_SHORT = re.compile(r"github:([^/]+)/([^@]+)(?:@(.+))?$", re.I)


def repository(address: str) -> tuple[str, str, str | None] | None:
    """(owner, name, ref) of a repository's address, None for other texts."""
    m = _WEB.match(address.removesuffix(".git")) or _SHORT.match(address.removesuffix(".git"))
    return (m[1], m[2].removesuffix(".git"), m[3]) if m else None


def raw_urls(files: DataFrame, owner: str, name: str, ref: str) -> DataFrame:
    """Where each listed file's content can be had."""
    return files.withColumn("url", F.concat(F.lit(f"https://raw.githubusercontent.com/{owner}/{name}/{ref}/"), F.col("path")))


def route(target: str, openapi: bool = False) -> str:
    """Which reader a target needs: repository, openapi, web or folder."""
    if repository(target):
        return "repository"
    web = re.match(r"https?://", target, re.I)
    path = re.sub(r"[?#].*", "", target).lower().rstrip("/")
    described = re.search(r"(^|/)(openapi|swagger)(\.(json|ya?ml))?$|/(api-docs|v3/api-docs)(\.json)?$|/(v\d+/)?(openapi|swagger)(/|$)", path) or (re.search(r"\.(json|ya?ml)$", path) and re.search("openapi|swagger", path))
    if openapi or (web and described):
        return "openapi"
    if web:
        return "web"
    if re.match(r"[a-z][a-z0-9+.-]*://", target, re.I) and not target.startswith(("file://", "hdfs://", "s3a://", "viewfs://")):
        raise ValueError(f"no reader for {target!r}")
    return "folder"
