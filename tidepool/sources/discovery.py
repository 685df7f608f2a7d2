"""Which pages of a site to index: llms.txt, sitemaps, and a bounded crawl of navigation links.

Fetching is the caller's: all functions take what was fetched as a DataFrame
(url, body), so they run on stored pages as well as on fresh ones.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import html, urls
from tidepool.session import written


def optional_body(ok: Column, body: Column) -> Column:
    return F.when(ok & (F.trim(body) != ""), body)


def resolve(base: Column, href: Column) -> Column:
    """A link as an absolute normalized http(s) URL, null for others."""

    @F.pandas_udf("string")
    def joined(b: pd.Series, h: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return urljoin(x, y)
            except ValueError:
                return None

        return pd.Series([one(x or "", y or "") for x, y in zip(b, h, strict=True)], dtype=object)

    return urls.normalize(joined(base, href))


def llms_txt(files: DataFrame, base: str = "url", body: str = "body") -> DataFrame:
    """base, pos and url for every link line of an llms.txt: a markdown link, else a bare URL, else a path of the site."""
    lines = files.select(F.col(base).alias("base"), F.posexplode(F.split(body, "\n")).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    lines = lines.where((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#")))
    blank = lambda c: F.when(c != "", c)
    linked = blank(F.regexp_extract("line", r"\((https?://[^)]+)\)", 1))
    bare = blank(F.regexp_replace(F.regexp_extract("line", r"https?://\S+", 0), r"[.,;]+$", ""))
    local = F.when(F.startswith(F.col("line"), F.lit("/")), urls.normalize(F.concat(urls.origin(F.col("base")), F.col("line"))))
    found = lines.select("base", "pos", F.coalesce(linked, bare, local).alias("url")).where("url is not null")
    return found.groupBy("base", "url").agg(F.min("pos").alias("pos")).select("base", "pos", "url")


#: Where a site keeps all its documentation as one file, in the order of trial.
FULL_DUMPS = ("/llms-full.txt", "/docs/llms-full.txt")


def llms_full(files: DataFrame, root: str) -> DataFrame:
    """pos and url of the first full dump that could be fetched (url, ok, body); no row without one."""
    base = urls.origin(F.lit(root))
    places = F.array(*(F.concat(base, F.lit(p)) for p in FULL_DUMPS))
    found = files.select(urls.normalize(F.col("url")).alias("url"), optional_body(F.col("ok"), F.col("body")).alias("body")).where("body is not null")
    found = found.withColumn("n", F.array_position(places, F.col("url"))).where("n > 0")
    return found.orderBy("n").limit(1).select(F.lit(0).alias("pos"), "url")


def follow(asked: DataFrame, responses: DataFrame, root: str, mode: str = "same-origin", hops: int = 10) -> DataFrame:
    """url, ok, final, body, content_type and error for each asked url, from stored responses (url, status, location, body, content_type).

    Redirects are followed for so many hops; each must stay in scope. What goes wrong
    is a row with an error, never an exception. Of several responses at one address the
    least counts, redirects first.

    Hops read a table of redirects alone, and only as many as there are; bodies are
    joined once, to the last addresses.
    """
    moved = F.coalesce(F.col("status").between(300, 399) & F.col("location").isNotNull(), F.lit(False))
    inside = F.coalesce(urls.in_scope(F.col("at"), F.lit(root), mode), F.lit(False))
    stored = responses.withColumn("at", urls.normalize(F.col("url"))).where("at is not null")
    moves = stored.where(moved & inside).groupBy("at").agg(F.min(F.struct("status", "location")).alias("r"))
    moves = written(moves.select("at", resolve(F.col("at"), F.col("r.location")).alias("to"), F.lit(True).alias("onward")), "redirects")
    going, last = asked.select("url", urls.normalize(F.col("url")).alias("at")), None
    for hop in range(hops + 1):
        met = written(going.join(moves, "at", "left") if hop < hops else going.withColumns({"to": F.lit(None).cast("string"), "onward": F.lit(None).cast("boolean")}), "hop")
        stays = met.where("onward is null").select("url", "at")
        last = stays if last is None else last.unionByName(stays)
        going = met.where("onward").select("url", F.col("to").alias("at"))
        if hop == hops or going.isEmpty():
            break
    one = stored.groupBy("at").agg(F.min(F.struct((~moved).alias("other"), "status", "location", "body", "content_type")).alias("r")).select("at", "r.*")
    met = last.join(one, "at", "left")
    error = F.when(F.col("at").isNull(), "invalid address").when(~inside, "out of scope").when(F.col("status").isNull(), "no response").when(moved, "too many redirects")
    error = error.when(~F.col("status").between(200, 299), F.concat(F.lit("status "), F.col("status").cast("string")))
    return met.select("url", error.isNull().alias("ok"), F.col("at").alias("final"), F.when(error.isNull(), F.col("body")).alias("body"), "content_type", error.alias("error"))


def sitemap_locations(files: DataFrame, body: str = "body") -> DataFrame:
    """source, pos, url and whether it is another sitemap, for every location of a sitemap."""
    spots = F.posexplode(F.transform(F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))))
    rows = files.select(F.col("url").alias("source"), spots.alias("pos", "url"))
    return rows.withColumn("nested", F.lower("url").rlike(r"\.xml($|\?)") | F.lower("url").contains("sitemap"))


def sitemap(spark: SparkSession, root: str, fetch: Callable[[DataFrame], DataFrame], most: int = 500, depth: int = 3) -> DataFrame:
    """pos and url of a site's pages: nested sitemaps of the same origin down to a depth."""
    frontier = spark.createDataFrame([(root,)], "url string")
    pages, seen = None, frontier
    for _ in range(depth + 1):
        spots = sitemap_locations(fetch(frontier))
        here = spots.where(~F.col("nested")).select("pos", "url")
        pages = here if pages is None else pages.unionByName(here)
        frontier = spots.where(F.col("nested") & urls.same_origin(F.col("url"), F.lit(root))).select("url").distinct().join(seen, "url", "left_anti")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return urls.dedupe_exact(pages).orderBy("pos", "url").limit(most)


def links(pages: DataFrame, body: str = "body") -> DataFrame:
    """source, pos and url of every page's navigation links."""

    @F.pandas_udf("array<string>")
    def found(bases: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([html.nav_links(h or "", b) for b, h in zip(bases, bodies, strict=True)], dtype=object)

    rows = pages.select(F.col("url").alias("source"), F.posexplode(found("url", body)).alias("pos", "url"))
    return rows.withColumn("url", urls.normalize(F.col("url"))).where("url is not null")


def crawl(root: str, edges: DataFrame, most: int = 500) -> DataFrame:
    """url, depth and pos of the pages within reach of root, nearest first: below the root, not in another language.

    edges: source, pos, url. Each step joins the frontier with the links and drops
    what was seen; the frontier is cut to what can still be indexed.
    """
    spark, kind = edges.sparkSession, "url string, depth int, pos int"
    low = F.col("url")
    usable = written(edges.where(urls.under_root(low, F.lit(root)) & (urls.locale_preference(low) < 2)).select("source", "pos", "url"), "edges")
    first = spark.createDataFrame([(root,)], "url string").select(urls.normalize(F.col("url"))).first()[0]
    seen = frontier = [(first, 0, 0)]  # at most 2 x most rows
    depth = 0
    while len(seen) < most:
        depth += 1
        at = spark.createDataFrame(frontier, kind).select(F.col("url").alias("source"), F.col("pos").alias("before"))
        step = usable.join(F.broadcast(at), "source").groupBy("url").agg(F.min(F.struct("before", "pos")).alias("at"))
        step = step.join(F.broadcast(spark.createDataFrame(seen, kind)), "url", "left_anti")
        rows = step.orderBy("at", "url").limit(2 * most - len(seen)).collect()
        if not rows:
            break
        frontier = [(r["url"], depth, i) for i, r in enumerate(rows)]
        seen = [*seen, *frontier]
    return spark.createDataFrame(seen, kind).orderBy("depth", "pos", "url").limit(most)


def robots_filter(pages: DataFrame, robots: str | None, agent: str) -> DataFrame:
    """The URLs that a robots.txt allows; all without one."""
    if not robots:
        return pages

    @F.pandas_udf("boolean")
    def allowed(column: pd.Series) -> pd.Series:
        rules = RobotFileParser()
        rules.parse(robots.splitlines())
        return column.map(lambda u: rules.can_fetch(agent, u)).astype(bool)

    return pages.where(allowed("url"))


def selected(found: DataFrame, root: str, robots: str | None = None, agent: str = "*", full_dump: bool = False, most: int = 500) -> DataFrame:
    """What of a strategy's URLs (pos, url) is indexed: allowed, below the root, one of each version and language."""
    kept = robots_filter(found, robots, agent).where(urls.under_root(F.col("url"), F.lit(root)))
    if full_dump:
        kept = kept.where(~urls.companion_file(F.col("url")))
    return urls.dedupe_locales(urls.dedupe_versions(kept)).orderBy("pos").limit(most)


def discover(root: str, strategies: list[tuple[str, DataFrame]], robots: str | None = None, agent: str = "*", most: int = 500) -> tuple[str, DataFrame]:
    """The first strategy whose URLs survive selection; the root alone if none does."""
    for name, found in strategies:
        kept = selected(found, root, robots, agent, name == "llms-full.txt", most)
        if not kept.isEmpty():
            return name, kept
    spark = strategies[0][1].sparkSession if strategies else SparkSession.getActiveSession()
    return "root", spark.createDataFrame([(0, root)], "pos int, url string")
