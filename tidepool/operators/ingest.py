"""Pages to documents and chunks: extraction, hash skip, upsert, replacement, report, re-embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.config import Chunking
from tidepool.functions import chunking, html, openapi, text, urls
from tidepool.operators import store, vector
from tidepool.schema import EXTRACTOR_VERSION
from tidepool.session import written


def document_id(source_id: Column, uri: Column) -> Column:
    return text.short_id(F.concat_ws(":", source_id, uri))


def chunk_id(document: Column, index: Column, content_hash: Column) -> Column:
    return text.short_id(F.concat_ws(":", document, index.cast("string"), content_hash))


def one_per_address(pages: DataFrame) -> DataFrame:
    """uri, url, html, ok and error: of pages whose normalized addresses are equal one that is well, else the first by its address. An invalid address stays as it is and is an error."""
    ok = F.col("ok") if "ok" in pages.columns else F.lit(True)
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    uri = urls.normalize(F.col("url"))
    rows = pages.select(F.coalesce(uri, F.col("url")).alias("uri"), "url", "html", (ok & uri.isNotNull()).alias("ok"), F.coalesce(error, F.when(uri.isNull(), "invalid address")).alias("error"))
    best = F.min_by(F.struct("url", "html", "ok", "error"), F.struct((~F.col("ok")).alias("bad"), "url", "html"))
    return rows.where("uri is not null").groupBy("uri").agg(best.alias("p")).select("uri", "p.*")


def from_pages(pages: DataFrame, source_id: str) -> DataFrame:
    """Documents with their markdown from fetched pages (url, html, and ok and error if there are any), one for each normalized address."""
    rows = one_per_address(pages).select("uri", html.extracted(F.col("html"), F.col("url")).alias("p"), "ok", "error")
    thin = text.is_boilerplate(F.col("p.markdown"))
    status = F.when(F.col("ok") & ~thin, "ok").otherwise("error")
    markdown = F.when(status == "ok", F.col("p.markdown"))
    meta = F.to_json(F.struct(F.lit(EXTRACTOR_VERSION).alias("extractor_version"), F.col("p.adapter").alias("adapter"), F.col("p.canonical").alias("canonical"), F.col("p.lang").alias("lang"), urls.version_of(F.col("uri")).alias("version")))
    return rows.select(
        document_id(F.lit(source_id), F.col("uri")).alias("id"),
        F.lit(source_id).alias("source_id"),
        "uri",
        text.normalize_title(F.col("p.title")).alias("title"),
        F.sha2(markdown, 256).alias("content_hash"),
        status.alias("status"),
        F.when(status == "error", F.coalesce("error", F.lit("no content"))).alias("error"),
        meta.alias("meta_json"),
        markdown.alias("markdown"),
    )


def from_openapi(specs: DataFrame, source_id: str) -> DataFrame:
    """One document for each fetched OpenAPI description (url, body); what isn't one is an error."""
    rows = specs.select(F.coalesce(urls.normalize(F.col("url")), F.col("url")).alias("uri"), openapi.converted(F.col("body")).alias("o")).where("uri is not null")
    ok = F.col("o.error").isNull() & (F.trim(F.coalesce("o.markdown", F.lit(""))) != "")
    markdown = F.when(ok, text.clean_markdown(F.col("o.markdown")))
    meta = F.to_json(F.struct(F.lit(EXTRACTOR_VERSION).alias("extractor_version"), F.lit("openapi").alias("adapter"), F.col("o.version").alias("api_version")))
    return rows.select(
        document_id(F.lit(source_id), F.col("uri")).alias("id"),
        F.lit(source_id).alias("source_id"),
        "uri",
        F.when(ok, text.normalize_title(F.col("o.title"))).alias("title"),
        F.sha2(markdown, 256).alias("content_hash"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(~ok, F.coalesce("o.error", F.lit("no content"))).alias("error"),
        meta.alias("meta_json"),
        markdown.alias("markdown"),
    )


def from_files(files: DataFrame, source_id: str) -> DataFrame:
    """Documents from files (uri, content); code stays as it is, text is cleaned."""
    clean = F.when(chunking.is_code(F.col("uri")), F.col("content")).otherwise(text.clean_markdown(F.col("content")))
    rows = files.withColumn("markdown", clean)
    ok = F.trim(F.coalesce("markdown", F.lit(""))) != ""
    return rows.select(
        document_id(F.lit(source_id), F.col("uri")).alias("id"),
        F.lit(source_id).alias("source_id"),
        "uri",
        text.basename(F.col("uri")).alias("title"),
        F.sha2("markdown", 256).alias("content_hash"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(~ok, "no content").alias("error"),
        F.to_json(F.struct(F.lit(EXTRACTOR_VERSION).alias("extractor_version"))).alias("meta_json"),
        F.when(ok, F.col("markdown")).alias("markdown"),
    )


def unchanged(new: DataFrame, old: DataFrame) -> DataFrame:
    """new with a column `skip`: the stored document has this hash, is searchable, and this extractor made it."""
    o = old.select("source_id", "uri", F.col("content_hash").alias("__hash"), F.col("status").alias("__status"), F.get_json_object("meta_json", "$.extractor_version").cast("int").alias("__version"))
    same = (F.col("__hash") == F.col("content_hash")) & (F.col("__status") == "ok") & (F.col("__version") == EXTRACTOR_VERSION)
    return new.join(o, ["source_id", "uri"], "left").withColumn("skip", F.coalesce(same, F.lit(False))).drop("__hash", "__status", "__version")


def chunk_rows(documents: DataFrame, settings: Chunking = Chunking()) -> DataFrame:
    """The chunks table's rows of documents with markdown."""
    rows = chunking.chunked(documents.where(F.col("status") == "ok"), "id", "markdown", "uri", settings, ("source_id", "title"))
    rows = rows.withColumnRenamed("id", "document_id")
    return rows.select(chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("content_hash")).alias("id"), "document_id", "source_id", "chunk_index", "text", "heading", "section_path", "title", "start_offset", "end_offset", "content_hash", "kind", "language")


def ingest(new: DataFrame, tables: dict[str, DataFrame], recreate: bool = False, settings: Chunking = Chunking(), embedder=None) -> dict[str, DataFrame]:
    """The tables after new documents (of from_pages or from_files) have come in, and `report`.

    Unchanged documents are skipped; the chunks and embeddings of the others are
    replaced; an error removes a document's chunks and stays as its status. The new
    documents and their chunks are written to the shared folder once, and all that is
    returned follows from those.
    """
    marked = unchanged(new, tables["documents"])
    marked = written(marked.withColumn("skip", F.lit(False)) if recreate else marked, "documents")
    work = marked.where(~F.col("skip"))
    now = F.current_timestamp()
    rows = work.withColumn("extracted_path", F.lit(None).cast("string")).withColumn("created_at", now).withColumn("updated_at", now)
    documents = store.upsert_documents(tables["documents"], rows.select(*tables["documents"].columns))
    chunks, embeddings = store.delete_chunks(tables["chunks"], tables["embeddings"], work)
    fresh = written(chunk_rows(work, settings), "chunks")
    if embedder is not None:
        body = text.embed_text(F.col("title"), F.coalesce("section_path", "heading"), F.col("text"))
        embeddings = embeddings.unionByName(vector.embed_chunks(fresh.withColumnRenamed("id", "chunk_id"), embedder, body))
    return tables | {"documents": documents, "chunks": chunks.unionByName(fresh), "embeddings": embeddings, "report": report(marked)}


def report(marked: DataFrame, errors: int = 5) -> DataFrame:
    """pages_ok, pages_failed, pages_skipped and the first few errors, in one row."""
    failed = (F.col("status") == "error") & ~F.col("skip")
    first = F.slice(F.array_sort(F.collect_list(F.col("e"))), 1, errors)
    sums = marked.agg(F.count_if((F.col("status") == "ok") & ~F.col("skip")).alias("pages_ok"), F.count_if(failed).alias("pages_failed"), F.count_if(F.col("skip")).alias("pages_skipped"))
    some = marked.where(failed).orderBy("uri").limit(errors).select(F.struct("uri", "error").alias("e")).agg(first.alias("errors"))
    return sums.crossJoin(F.broadcast(some))  # one row each


def reembed(chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, embedder, source_id: str | None = None) -> DataFrame:
    """The embeddings anew, of all chunks or one source's. A single source needs the stored dimensions to stay."""
    own = chunks if source_id is None else chunks.where(F.col("source_id") == source_id)
    other = embeddings.where(F.size("embedding") != embedder.dims)
    if source_id is not None and not other.isEmpty():
        raise ValueError(f"stored vectors don't have {embedder.dims} dimensions: all sources must be embedded anew")
    titled = own.join(documents.select(F.col("id").alias("document_id"), F.col("title").alias("__title")), "document_id")
    title = F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("__title"))
    body = text.embed_text(title, F.coalesce("section_path", "heading"), F.col("text"))
    fresh = vector.embed_chunks(titled.withColumnRenamed("id", "chunk_id"), embedder, body)
    return fresh if source_id is None else store.delete(embeddings, own, "chunk_id", "id").unionByName(fresh)


def export(documents: DataFrame) -> DataFrame:
    """uri and a markdown file's text with its front matter."""
    q = lambda c: F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("v")))
    quoted = lambda c: F.regexp_replace(q(c), r'^\{"v":|\}$', "")
    front = F.concat(F.lit("---\ntitle: "), quoted("title"), F.lit("\nurl: "), quoted("uri"), F.lit("\n---\n\n"))
    return documents.where(F.col("status") == "ok").select("uri", F.concat(front, "markdown", F.lit("\n")).alias("value"))
