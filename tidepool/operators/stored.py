"""Search over the stored tables: what ingest() returns, from an index of its chunks to hits and packs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.config import Retrieval
from tidepool.operators import batch, filters, fts, hybrid, pack, segments

#: The columns of a hit but its score.
HIT = ("chunk_id", "document_id", "source_id", "text", "heading", "section_path", "uri", "title", "kind")


def index(tables: dict[str, DataFrame]) -> fts.Index:
    """The index of all chunks as a plan, whatever their documents' status."""
    return fts.index(tables["chunks"].withColumnRenamed("id", "chunk_id"))


def keep_index(tables: dict[str, DataFrame], at: str) -> segments.SegmentIndex:
    """The same, written down; what ingest() adds, changes and drops later goes into it by add(), change() and delete()."""
    return segments.SegmentIndex.create(tables["chunks"].withColumnRenamed("id", "chunk_id"), at)


def well(tables: dict[str, DataFrame]) -> DataFrame:
    """document_id, uri and title of the documents that may be found."""
    return tables["documents"].where(F.col("status") == "ok").select(F.col("id").alias("document_id"), "uri", "title")


def searchable(tables: dict[str, DataFrame]) -> DataFrame:
    """Chunks as hits, with their documents' addresses and titles; only documents that are well count."""
    chunks = tables["chunks"].select(F.col("id").alias("chunk_id"), "document_id", "source_id", "text", "heading", "section_path", "kind")
    return chunks.join(well(tables), "document_id").select(*HIT)


def ask(tables: dict[str, DataFrame], made: fts.Index | segments.SegmentIndex, query: str, embedder=None, settings: Retrieval = Retrieval(), kinds: Iterable[str] = (), sources: Iterable[str] = (), keywords: tuple[str, ...] = (), scorer=None, stopwords: frozenset[str] | None = None, loose: bool = True) -> DataFrame:
    """The hits of a query, best first. sources: ids or addresses; an unknown one, or an unknown kind, is an error. loose: whether some words do where no chunk has all. With a kept index the texts of hits alone are read."""
    known = [filters.resolve_source(tables["sources"], s) for s in sources]
    where = filters.condition(filters.parse_kinds(list(kinds)), known, keywords)
    named = None
    if isinstance(made, segments.SegmentIndex):
        named = lambda keys: F.broadcast(made.named(keys).drop("title")).join(well(tables), "document_id").select(*HIT)  # noqa: E731  a few rows
    found = hybrid.hybrid(made, searchable(tables), tables.get("embeddings"), query, embedder, settings, where, keywords, scorer, partial=True, stopwords=stopwords, named=named, loose=loose)
    return found.select(*HIT, "score")


def containing(tables: dict[str, DataFrame], made: segments.SegmentIndex, words: tuple[str, ...], limit: int = 40, kinds: Iterable[str] = (), sources: Iterable[str] = (), keywords: tuple[str, ...] = ()) -> DataFrame:
    """The hits whose texts contain all words as they are, those with the first word earliest first; score 1 / rank. Only documents that are well count."""
    known = [filters.resolve_source(tables["sources"], s) for s in sources]
    where = filters.condition(filters.parse_kinds(list(kinds)), known, keywords)
    found = made.substring(words, limit, where, searchable(tables).select("chunk_id"))
    return F.broadcast(found.drop("title")).join(well(tables), "document_id").select(*HIT, "score")  # at most `limit` rows


def ask_all(tables: dict[str, DataFrame], made: segments.SegmentIndex, queries: DataFrame, settings: Retrieval = Retrieval(), kinds: Iterable[str] = (), sources: Iterable[str] = (), keywords: tuple[str, ...] = (), stopwords: frozenset[str] | None = None) -> DataFrame:
    """The hits of many queries by their words alone, in one plan: query_id, position and the columns of a hit. queries: query_id and query. What ask() gives without an embedder."""
    known = [filters.resolve_source(tables["sources"], s) for s in sources]
    where = filters.condition(filters.parse_kinds(list(kinds)), known, keywords)
    allowed = searchable(tables).select("chunk_id")
    asked = queries.withColumn("keywords", F.array(*map(F.lit, keywords)).cast("array<string>"))
    found = batch.hits(made, asked, settings.fts_limit, where, allowed, stopwords).drop("title").join(well(tables), "document_id")
    cap = max(3 * settings.top_k, settings.vector_limit)
    found = found.withColumn("score", 1.0 / (F.lit(settings.rrf_k) + F.col("position"))).where(F.col("position") <= cap)  # fused: one list
    if settings.max_per_document > 0:
        nth = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("position"))
        found = found.withColumn("nth", nth).where(F.col("nth") <= settings.max_per_document)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    return found.withColumn("position", place).where(F.col("position") <= settings.top_k).select("query_id", "position", *HIT, "score")


def context(tables: dict[str, DataFrame], made: fts.Index | segments.SegmentIndex, queries: list[str], embedder=None, settings: Retrieval = Retrieval(), **filters_) -> DataFrame:
    """The packs of queries: one row per section, as pack.pack has it, by the query's text. Over a kept index and without an embedder all are answered in one plan."""
    spark = tables["chunks"].sparkSession
    if embedder is None and isinstance(made, segments.SegmentIndex) and not filters_.get("scorer"):
        asked = spark.createDataFrame([(q, q) for q in dict.fromkeys(queries)], "query_id string, query string")
        found = ask_all(tables, made, asked, settings, **{k: v for k, v in filters_.items() if k != "scorer"})
        return pack.pack(found.withColumnRenamed("query_id", "query"), settings.token_budget, "query")
    out = None
    for q in queries:
        hits = ask(tables, made, q, embedder, settings, **filters_).withColumn("query", F.lit(q))
        out = hits if out is None else out.unionByName(hits)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id"))
    return pack.pack(out.withColumn("position", place), settings.token_budget, "query")
