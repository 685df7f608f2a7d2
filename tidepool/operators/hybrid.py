"""Hybrid retrieval: rank fusion of full-text and vector hits, reranking, diversity."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.config import Retrieval
from tidepool.operators import fts, vector
from tidepool.operators.segments import SegmentIndex


def ranked(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """hits with rank from 0 by score, ties by key. For lists that a limit has made short."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def rrf(lists: list[DataFrame], k: int = 60, key: str = "chunk_id") -> DataFrame:
    """key, score (sum of 1 / (k + rank + 1)), and where it first came: list number and rank. lists: key and rank."""
    parts = None
    for i, one in enumerate(lists):
        part = one.select(key, F.col("rank"), F.lit(i).alias("list"))
        parts = part if parts is None else parts.unionByName(part)
    summed = parts.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)).alias("score"), F.min(F.struct("list", "rank")).alias("__first"))
    return summed.select(key, "score", F.col("__first.list").alias("list"), F.col("__first.rank").alias("rank"))


def diversify(hits: DataFrame, per_document: int, order: list[Column], document: str = "document_id") -> DataFrame:
    """The first hits of each document; all if per_document isn't positive."""
    if per_document <= 0:
        return hits
    n = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    return hits.withColumn("__n", n).where(F.col("__n") <= per_document).drop("__n")


def rerank(hits: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]] | None, text: Column, key: str = "chunk_id") -> DataFrame:
    """hits with the scores of a scorer of (query, texts); unchanged without one."""
    if scorer is None:
        return hits

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, texts.fillna("").tolist()), dtype=float)

    return hits.withColumn("score", scored(text)).drop("rank", "list").withColumn("list", F.lit(0)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def rerank_response(body: dict, n: int) -> list[tuple[int, float]]:
    """(index, score) pairs of a rerank service's answer, whichever of the usual names it uses; indices out of range are dropped."""
    rows = body.get("results", body.get("data")) or []
    out = []
    for r in rows:
        index = next((r[x] for x in ("index", "document_index") if x in r), None)
        score = next((r[x] for x in ("relevance_score", "score", "relevanceScore") if x in r), None)
        if index is not None and score is not None and 0 <= index < n:
            out.append((int(index), float(score)))
    return sorted(out, key=lambda x: -x[1])


#: The names that services give to their answers and to what is in them.
_ANSWER = "array<struct<index:int, document_index:int, relevance_score:double, score:double, relevanceScore:double>>"


def reranked(hits: DataFrame, answers: DataFrame, query: str = "query_id") -> DataFrame:
    """hits (query, position from 1) with the scores of a service's answers (query, body as JSON), whichever of the usual names it uses. Hits that an answer lacks are dropped, and what points nowhere."""
    told = answers.select(query, F.from_json("body", f"results {_ANSWER}, data {_ANSWER}").alias("b"))
    rows = told.select(query, F.inline(F.coalesce("b.results", "b.data")))
    scores = rows.select(query, (F.coalesce("index", "document_index") + 1).alias("position"), F.coalesce("relevance_score", "score", "relevanceScore").alias("score"))
    scores = scores.where("score is not null").groupBy(query, "position").agg(F.max("score").alias("score"))
    return hits.drop("score").join(scores, [query, "position"])


def fuse(
    text_hits: DataFrame, vector_hits: DataFrame | None, chunks: DataFrame, settings: Retrieval = Retrieval(), query: str = "", scorer=None, key: str = "chunk_id", named: Callable[[list], DataFrame] | None = None
) -> DataFrame:
    """The final hits of two lists of (key, score): fused, capped, reranked, at most so many of a document, best first.

    named: gives the chunks of a few keys, so that the others aren't read; without it chunks are joined.
    """
    lists = [ranked(x.select(key, "score"), key) for x in (text_hits, vector_hits) if x is not None]
    fused = rrf(lists, settings.rrf_k, key)
    order = [F.desc("score"), "list", "rank", key]
    cap = max(3 * settings.top_k, settings.vector_limit)
    best = fused.orderBy(*order).limit(cap)  # at most `cap` rows
    if named is not None:
        rows = best.collect()
        best, chunks = chunks.sparkSession.createDataFrame(rows, best.schema), named([r[key] for r in rows])
    best = F.broadcast(best).join(chunks, key)
    best = rerank(best, query, scorer, F.col("text"), key)
    best = diversify(best, settings.max_per_document, order)
    return best.orderBy(*order).limit(settings.top_k)


def hybrid(
    index: fts.Index | SegmentIndex,
    chunks: DataFrame,
    embeddings: DataFrame | None,
    query: str,
    embedder=None,
    settings: Retrieval = Retrieval(),
    where: Column | None = None,
    keywords: tuple[str, ...] = (),
    scorer=None,
    partial: bool = False,
    stopwords: frozenset[str] | None = None,
    named: Callable[[list], DataFrame] | None = None,
    loose: bool = True,
) -> DataFrame:
    """Full-text ladder and vector neighbours of a query, fused. Without an embedder only the text counts. partial: see fts.search; named: see fuse; loose: see fts.ladder."""
    key = index.key
    text_hits = fts.ladder(index, chunks, fts.parse(query, keywords, stopwords), settings.fts_limit, where, filtered=where is not None, partial=partial, loose=loose)
    near = None
    if embedder is not None and embeddings is not None:
        rows = embeddings
        if partial or where is not None:
            rows = rows.join((chunks if where is None else chunks.where(where)).select(key), key, "left_semi")
        near = vector.top_k(rows, embedder.embed_one(query), settings.vector_limit, key, model_id=embedder.model_id)
    return fuse(text_hits, near, chunks, settings, query, scorer, key, named)
