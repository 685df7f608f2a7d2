"""URL functions as columns: normal form, scope, version and locale segments, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Locale tags that documentation sites use as path segments, those of English, and segments that only look like one.
LOCALES = (
    "en", "en-us", "en-gb", "en-au", "en-ca", "en-nz", "en-ie", "zh", "zh-cn", "zh-tw", "zh-hk", "zh-hans",
    "zh-hant", "ja", "jp", "ko", "kr", "fr", "de", "es", "pt", "pt-br", "pt-pt", "ru", "it", "nl", "pl", "tr", "ar",
    "he", "hi", "th", "vi", "id", "ms", "sv", "da", "fi", "no", "nb", "nn", "cs", "sk", "uk", "ro", "hu", "el",
    "bg", "hr", "sr", "sl", "lt", "lv", "et", "fa", "bn", "ta", "te", "ca", "eu", "gl", "af", "sw", "fil", "tl",
)
ENGLISH = (
    "en", "en-us", "en-gb", "en-au", "en-ca", "en-nz", "en-ie",
)
NOT_LOCALES = (
    "go", "io", "js", "ts", "md", "rs", "py",
)
# Versions as path segments, and parameters that only track.
VERSION = r"(?i)^(v?\d+\.\d+(?:\.\d+)?(?:-[a-z0-9.]+)?|latest|stable|master|main)$"
TRACKING = r"(?i)^(utm_|fbclid|gclid|mc_)"
SPLIT = r"^(?i:(https?)://)([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, SPLIT, k)


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(SPLIT) & (_part(url, 2) != ""), F.lit(False))


def _authority(url: Column) -> Column:
    host = F.lower(F.regexp_replace(_part(url, 2), r"^[^@]*@", ""))
    secure = F.lower(_part(url, 1)) == "https"
    return F.when(secure, F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case, without a default port; null for anything else."""
    return F.when(is_url(url), F.concat(F.lower(_part(url, 1)), F.lit("://"), _authority(url)))


def normal_path(url: Column) -> Column:
    path = F.regexp_replace(_part(url, 3), r"(?i)/index\.html?$", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(path == "", "/").otherwise(path)


def _query(url: Column) -> Column:
    kept = F.filter(F.split(F.substring(_part(url, 4), 2, 1 << 30), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].rlike(TRACKING))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")


def normalize(url: Column) -> Column:
    """No fragment, host in lower case, no index page, no trailing slash, no tracking parameters; null if invalid."""
    return F.when(is_url(url), F.concat(origin(url), normal_path(url), _query(url)))


def same_origin(url: Column, root: Column) -> Column:
    return F.coalesce(origin(url) == origin(root), F.lit(False))


def under_root(url: Column, root: Column) -> Column:
    """Same origin, and the root's path or a path below it."""
    base = F.when(normal_path(root) == "/", "").otherwise(normal_path(root))
    path = normal_path(url)
    return same_origin(url, root) & ((base == "") | (path == base) | path.startswith(F.concat(base, F.lit("/"))))


def in_scope(url: Column, root: Column, mode: str) -> Column:
    return {"under-root": under_root, "same-origin": same_origin}[mode](url, root)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _without_first(path: Column, hit) -> tuple[Column, Column]:
    """The path without the first segment that hit accepts, and that segment (null if none)."""
    parts = _segments(path)
    found = F.get(F.filter(parts, hit), F.lit(0))
    at = F.coalesce(F.array_position(parts, found), F.lit(1)).cast("int")
    rest = F.concat(F.slice(parts, F.lit(1), at - 1), F.slice(parts, at + 1, F.greatest(F.size(parts), F.lit(0))))
    return F.when(found.isNull(), path).otherwise(F.concat(F.lit("/"), F.array_join(rest, "/"))), found


def tag(segment: Column) -> Column:
    return F.lower(F.regexp_replace(segment, "_", "-"))


def is_locale(segment: Column) -> Column:
    return tag(segment).isin(*LOCALES) & ~F.split(tag(segment), "-")[0].isin(*NOT_LOCALES)


def strip_version(path: Column) -> tuple[Column, Column]:
    return _without_first(path, lambda s: s.rlike(VERSION))


def strip_locale(path: Column) -> tuple[Column, Column]:
    return _without_first(path, is_locale)


def version_of(url: Column) -> Column:
    return F.when(is_url(url), strip_version(normal_path(url))[1])


def locale_preference(url: Column) -> Column:
    """0 without a locale, 1 for English, 2 for others and invalid URLs."""
    found = strip_locale(normal_path(url))[1]
    return F.when(~is_url(url), 2).when(found.isNull(), 0).when(tag(found).isin(*ENGLISH), 1).otherwise(2)


def _best(urls: DataFrame, key: Column, preference: Column) -> DataFrame:
    """The best URL of each key, in the order in which keys first appear. urls: pos, url."""
    rows = urls.where(is_url(F.col("url"))).select("pos", normalize(F.col("url")).alias("url"), key.alias("key"), preference.alias("pref"))
    rows = rows.groupBy("url").agg(F.min("pos").alias("pos"), F.first("key").alias("key"), F.first("pref").alias("pref"))
    picked = rows.groupBy("key").agg(F.min_by("url", F.struct("pref", F.length(normal_path(F.col("url"))), "pos")).alias("url"), F.min("pos").alias("pos"))
    return picked.select("pos", "url")


def dedupe_exact(urls: DataFrame) -> DataFrame:
    return urls.groupBy("url").agg(F.min("pos").alias("pos")).select("pos", "url")


def dedupe_locales(urls: DataFrame) -> DataFrame:
    """One URL for each page in several languages: without a locale, else English, else the shortest path."""
    url = F.col("url")
    return _best(urls, F.concat(origin(url), strip_locale(normal_path(url))[0], _query(url)), locale_preference(url))


def dedupe_versions(urls: DataFrame) -> DataFrame:
    """One URL for each page in several versions: without a version, else latest or stable, else the first."""
    url = F.col("url")
    plain, found = strip_version(normal_path(url))
    rows = urls.where(is_url(url)).select("pos", normalize(url).alias("url"), F.concat(origin(url), plain, _query(url)).alias("key"), F.when(found.isNull(), 0).when(F.lower(found).isin("latest", "stable"), 1).otherwise(2).alias("pref"))
    picked = rows.groupBy("key").agg(F.min_by("url", F.struct("pref", "pos")).alias("url"), F.min("pos").alias("pos"))
    return picked.select("pos", "url")


def _media(content_type: Column) -> Column:
    return F.trim(F.split(F.lower(F.coalesce(content_type, F.lit(""))), ";")[0])


def skippable_content(content_type: Column) -> Column:
    """Types that hold no page; an unknown type is kept."""
    t = _media(content_type)
    return (
        t.contains("json")
        | (t.contains("xml") & ~t.contains("xhtml"))
        | t.rlike("^(image|audio|video)/")
        | t.isin("application/pdf", "application/octet-stream")
        | t.contains("javascript")
        | t.contains("wasm")
    )


def html_content(content_type: Column) -> Column:
    t = _media(content_type)
    return (t == "") | t.contains("html") | t.startswith("text/plain") | t.startswith("text/markdown")


def companion_file(url: Column) -> Column:
    """Agent index files beside a full dump."""
    return F.regexp_replace(url, r"[?#].*$", "").rlike(r"(?i)/(llms|llm|agent|agents)\.txt$")


def openapi_url(url: Column) -> Column:
    """Whether a URL's path looks like an OpenAPI or Swagger description."""
    path = F.regexp_replace(F.lower(F.regexp_replace(url, r"[?#].*$", "")), "/+$", "")
    described = path.rlike(r"\.(json|ya?ml)$") & path.rlike("(openapi|swagger)")
    return path.rlike(r"(^|/)(openapi|swagger)(\.(json|ya?ml))?$") | described | path.rlike(r"/(v\d+/)?(openapi|swagger)(/|$)") | path.rlike(r"/(api-docs|v3/api-docs)(\.json)?$")
