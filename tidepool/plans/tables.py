"""Queries over the stored tables' upkeep, text and path helpers, scopes and responses, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions import chunking, text, urls
from tidepool.operators import fts, hybrid, ingest, store, vector
from tidepool.operators.snapshots import Snapshots
from tidepool.schema import CHUNKS, DOCUMENTS, EMBEDDINGS
from tidepool.session import work_dir
from tidepool.sources import discovery, files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    return d.select(i.alias("id"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 3).cast("string")).alias("document_id"), F.col("source").alias("source_id"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("heading"), F.lit(None).cast("string").alias("section_path"), F.when(F.col("doc_id") % 4 == 0, F.lit("")).alias("title"))


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("n")).distinct()
    return d.select(F.concat(F.lit("d"), F.col("n").cast("string")).alias("id"), F.concat(F.lit("doc://"), F.col("n").cast("string")).alias("uri"), F.concat(F.lit("Title "), F.col("n").cast("string")).alias("title"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("old").alias("model_id"), F.size("embedding").alias("dims"), "embedding")


def upsert_sources(spark, sf_dir):
    """Sources that come again without title or status, and new ones without a status."""
    d = table(spark, sf_dir, "documents").select("source").distinct()
    old = d.select(F.col("source").alias("id"), F.concat(F.lit("x://"), "source").alias("root_uri"), F.upper("source").alias("title"), F.lit("ready").alias("status"), F.lit("{}").alias("meta_json"))
    none = F.lit(None).cast("string")
    again = d.select(F.concat(F.lit("n"), "source").alias("id"), F.concat(F.lit("x://"), "source").alias("root_uri"), none.alias("title"), none.alias("status"), F.lit('{"a":1}').alias("meta_json"))
    new = d.select(F.concat(F.lit("n"), "source").alias("id"), F.concat(F.lit("y://"), "source").alias("root_uri"), F.lit("new").alias("title"), none.alias("status"), F.lit("{}").alias("meta_json"))
    return store.upsert_sources(old, again.union(new))


def upsert_embeddings(spark, sf_dir):
    """All vectors come again from another model, every third one for the same chunk, the others for new ones."""
    old = _vectors(spark, sf_dir)
    of = F.when(F.col("chunk_id").cast("long") % 3 == 0, F.col("chunk_id")).otherwise(F.concat(F.lit("n"), "chunk_id"))
    new = old.withColumns({"chunk_id": of, "model_id": F.lit("new")})
    return store.upsert_embeddings(old, new).select("chunk_id", "model_id", "dims")


def delete_documents(spark, sf_dir):
    """Chunks and embeddings after some documents have gone."""
    gone = _documents(spark, sf_dir).where(F.col("id").endswith("0"))
    chunks, vectors = store.delete_chunks(_chunks(spark, sf_dir), _vectors(spark, sf_dir), gone)
    return chunks.select(F.lit("chunk").alias("kind"), "id").union(vectors.select(F.lit("embedding"), "chunk_id"))


def remove_all(spark, sf_dir):
    tables = {"sources": table(spark, sf_dir, "documents").select("source").distinct(), "documents": _documents(spark, sf_dir), "chunks": _chunks(spark, sf_dir), "embeddings": _vectors(spark, sf_dir)}
    after, n = store.remove_all(tables)
    return store.counts(after).withColumn("removed", F.lit(n).cast("bigint"))


def rebuilt_vectors(spark, sf_dir):
    """Vectors of other dimensions go when the embedder's are settled; the meta table keeps them."""
    meta = spark.createDataFrame([("vector_dims", "32"), ("other", "x")], "key string, value string")
    vectors = _vectors(spark, sf_dir)
    mixed = vectors.withColumn("embedding", F.when(F.col("chunk_id").cast("long") % 4 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))).withColumn("dims", F.size("embedding"))
    kept, told = store.ensure_dims(mixed, meta, 64)
    return kept.select("chunk_id").withColumn("told", F.lit(store.get_meta(told, "vector_dims")))


def meta_put(spark, sf_dir):
    meta = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("lang").alias("value")).groupBy("key").agg(F.min("value").alias("value"))
    return store.put_meta(store.put_meta(meta, "src1", "changed"), "new", "1")


def migrations(spark, sf_dir):
    """Two steps, the first of which is registered; the second fills titles in."""
    meta = spark.createDataFrame([("migration:one", "done")], "key string, value string")
    tables = {"chunks": _chunks(spark, sf_dir), "documents": _documents(spark, sf_dir), "meta": meta}

    def fail(_):
        raise AssertionError("a registered step runs again")

    after, _ = store.migrate(tables, [("one", fail), ("two", lambda t: t | {"chunks": store.fill_titles(t["chunks"], t["documents"])})])
    return after["chunks"].select("id", "title").join(F.broadcast(after["meta"].agg(F.count(F.lit(1)).alias("steps"))))  # one row


def reembedded(spark, sf_dir):
    """All chunks anew: what the embedder reads of each, by its vector's dimensions and length."""
    out = ingest.reembed(_chunks(spark, sf_dir), _documents(spark, sf_dir), _vectors(spark, sf_dir), vector.HashedEmbedder(32))
    return out.select("chunk_id", "model_id", F.size("embedding").alias("dims"), F.round(vector.dot(F.col("embedding"), F.col("embedding")), 4).alias("length"))


def existing_chunks(spark, sf_dir):
    """What a re-embedding reads: title (the chunk's, else its document's), section and text."""
    c = store.fill_titles(_chunks(spark, sf_dir).withColumn("title", F.nullif("title", F.lit(""))), _documents(spark, sf_dir))
    return c.select("id", text.rerank_text(F.col("title"), F.col("heading"), F.col("text")).alias("read"))


def recent_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.max("doc_id").alias("updated_at"))
    return store.recent_sources(d)


def address_like_paths(spark, sf_dir):
    """Of the first chunks with a section path (by id) those where it is an address."""
    c = _chunks(spark, sf_dir).withColumn("section_path", F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://x/"), "id")).when(F.col("id") % 3 == 1, F.concat(F.lit("Guide > "), "id")))
    return store.uri_like_paths(c).select("id", "section_path")


def path_helpers(spark, sf_dir):
    """File addresses and names of made-up paths, and what kind of file they are."""
    ends = F.element_at(F.array(*map(F.lit, (".md", ".PY", "", ".bin", ".tsx", ".rst"))), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/data set/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ends)
    d = table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).withColumn("uri", text.file_uri(F.col("path")))
    p = F.col("path")
    return d.select("doc_id", "uri", text.uri_path(F.col("uri")).alias("back"), text.display_uri(F.lit("https://a/b c")).alias("shown"), text.basename(p).alias("name"), chunking.is_code(p).alias("code"), chunking.is_text_document(p).alias("readable"), chunking.language(p).alias("language"))


def word_helpers(spark, sf_dir):
    """The first word of each text without punctuation at its edges, whether it is a function word, and the text's headings cleaned."""
    first = F.split("text", r"[ \n]")[0]
    bare = text.strip_edge_punctuation(first)
    head = F.concat(F.lit("# [A](b) {#c}\n\n"), F.col("source"), F.lit(" <br> x   y\n\n\n\n## Direct link to z"))
    return table(spark, sf_dir, "documents").select("doc_id", bare.alias("word"), F.lower(bare).isin(*sorted(fts.STOPWORDS)).alias("function_word"), text.clean_markdown(head).alias("clean"))


def fetch_scopes(spark, sf_dir):
    """Which addresses lie in scope, which are an OpenAPI description or a companion of a full dump, and why a page needs a browser."""
    from tidepool.functions import html

    ends = F.element_at(F.array(*map(F.lit, ("/docs/a", "/docs", "/docsx/a", "/docs/openapi.json", "/docs/llms.txt", "/v1/swagger/"))), (F.col("page_id") % 6 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://ex.com"), ends).alias("url"), "html")
    url, root = F.col("url"), F.lit("https://ex.com/docs")
    reason = html.fallback_reason("auto", F.col("page_id") % 5 != 0, F.when(F.col("page_id") % 5 == 1, F.lit(" ")).when(F.col("page_id") % 5 == 2, F.lit("Just a moment...")).otherwise(F.lit("<p>")), F.when(F.col("page_id") % 5 == 3, F.lit("thin")).otherwise(F.lit("# Head\n\nbody")))
    return p.select("page_id", urls.in_scope(url, root, "under-root").alias("under"), urls.in_scope(url, root, "same-origin").alias("same"), urls.openapi_url(url).alias("openapi"), urls.companion_file(url).alias("companion"), reason.alias("reason"))


def resolved_links(spark, sf_dir):
    """Links relative to each page's address."""
    hrefs = F.element_at(F.array(*map(F.lit, ("/top", "sub/x", "?q=1", "#here", "mailto:a@b", "https://Other.org/z/"))), (F.col("page_id") % 6 + 1).cast("int"))
    base = F.concat(F.lit("https://ex.com/a/"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", discovery.resolve(base, hrefs).alias("link"))


def followed(spark, sf_dir):
    """Every page asked for from stored responses: some redirect once, some for ever, some out of scope, some fail."""
    n = F.col("page_id") % 6
    at = F.concat(F.lit("https://ex.com/p/"), F.col("page_id").cast("string"))
    p = table(spark, sf_dir, "pages").select("page_id", n.alias("n"), at.alias("url"))
    location = F.when(F.col("n") == 1, F.concat("url", F.lit("/moved"))).when(F.col("n") == 2, F.col("url")).when(F.col("n") == 3, F.lit("https://other.org/"))
    status = F.when(F.col("n").isin(1, 2, 3), 302).when(F.col("n") == 4, 404).otherwise(200)
    first = p.where("n <> 5").select("url", status.alias("status"), location.alias("location"), F.concat(F.lit("body "), F.col("page_id").cast("string")).alias("body"), F.lit("text/html").alias("content_type"))
    moved = p.where("n = 1").select(F.concat("url", F.lit("/moved")), F.lit(200), F.lit(None).cast("string"), F.concat(F.lit("moved "), F.col("page_id").cast("string")), F.lit("text/html"))
    return discovery.follow(p.select("url"), first.union(moved), "https://ex.com").select("url", "ok", "final", "body", "error")


def full_dump(spark, sf_dir):
    """The first full dump that could be fetched, of pages and two dumps."""
    p = table(spark, sf_dir, "pages").select("url", F.lit(True).alias("ok"), F.col("html").alias("body"))
    dumps = spark.createDataFrame([("https://ex.com/llms-full.txt", True, "  "), ("https://ex.com/docs/llms-full.txt", True, "all"), ("https://other.org/llms-full.txt", True, "all")], p.schema)
    return discovery.llms_full(p.union(dumps), "https://ex.com/docs")


def selected_urls(spark, sf_dir):
    """What of many addresses is indexed: allowed by robots, below the root, no companion files, one of each version and language, the first 50."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("int").alias("pos"))
    i = F.col("pos")
    ends = F.when(i % 5 == 0, F.lit("private/")).when(i % 5 == 1, F.lit("fr/")).when(i % 5 == 2, F.lit("v1.2/")).otherwise(F.lit(""))
    found = p.select("pos", F.concat(F.lit("https://ex.com/docs/"), ends, F.lit("p"), F.floor(i / 5).cast("string")).alias("url"))
    extra = spark.createDataFrame([(-1, "https://ex.com/docs/llms.txt"), (-2, "https://ex.com/blog/p0")], found.schema)
    return discovery.selected(found.union(extra), "https://ex.com/docs", "User-agent: *\nDisallow: /docs/private/\n", full_dump=True, most=50)


def tree_files(spark, sf_dir):
    """The first documentation files of made-up listings, three files for each document, and where they can be had."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    folder = F.when(i % 3 == 0, F.lit("docs/")).otherwise(F.lit("src/"))
    item = lambda path: F.struct(path.alias("path"), F.when(i % 5 == 0, F.lit("tree")).otherwise(F.lit("blob")).alias("type"), F.when(i % 7 == 0, F.lit(2_000_000)).otherwise(F.lit(10)).alias("size"))
    both = F.array(item(F.concat(folder, F.lit("f"), i.cast("string"), F.lit(".md"))), item(F.concat(F.lit("guide/g"), i.cast("string"), F.lit(".md"))), item(F.concat(F.lit("docs/h"), i.cast("string"), F.lit(".txt"))))
    tree = d.select(F.to_json(F.struct(both.alias("tree"))).alias("json"))
    return files.raw_urls(files.tree_listing(tree), "o", "r", "main").select("path", "url")


def openapi_documents(spark, sf_dir):
    """A description for each source, some that are none, as documents."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    body = F.when(F.col("source").endswith("0"), F.lit("{}")).otherwise(F.concat(F.lit('{"openapi":"3.0.0","info":{"title":"'), "source", F.lit('","version":"'), F.col("n").cast("string"), F.lit('"},"paths":{"/b":{"get":{"summary":"Two"}},"/a":{"get":{"summary":"One"}}}}')))
    specs = d.select(F.concat(F.lit("https://ex.com/"), "source", F.lit("/openapi.json")).alias("url"), body.alias("body"))
    out = ingest.from_openapi(specs, "s")
    first, second = F.instr("markdown", "/a"), F.instr("markdown", "/b")
    return out.select("uri", "title", "status", F.get_json_object("meta_json", "$.api_version").alias("version"), F.coalesce((first > 0) & (first < second), F.lit(False)).alias("in_order"))


def rerank_positions(spark, sf_dir):
    """A rerank service's answers, one for each source over its ten longest documents; what points nowhere is dropped."""
    d = table(spark, sf_dir, "documents")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last(F.length("text")), "doc_id"))
    hits = d.select(F.col("source").alias("query_id"), "doc_id", place.alias("position")).where("position <= 10")
    scored = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct((F.lit(9) - i).alias("document_index"), (i / 10).alias("relevanceScore")))
    answers = d.select(F.col("source").alias("query_id")).distinct().select("query_id", F.to_json(F.struct(scored.alias("data"))).alias("body"))
    return hybrid.reranked(hits, answers).select("query_id", "doc_id", "score")


def snapshot_changes(spark, sf_dir):
    """A store of all documents: one source's get a new state and no title, new ones come, another source goes; then what it holds."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("uri"), F.col("lang").alias("title"), F.sha2("text", 256).alias("content_hash"), F.lit("ok").alias("status"))
    of = Snapshots.create(spark, f"{work_dir(spark)}/store-{uuid.uuid4().hex}", {"documents": (d, ["source_id", "uri"])})
    changed = d.where("source_id = 'src1'").withColumns({"title": F.lit(None).cast("string"), "status": F.lit("error")})
    new = d.where("source_id = 'src2'").withColumns({"id": F.concat(F.lit("n"), "id"), "uri": F.concat("uri", F.lit("/new"))})
    of = of.edit().upsert("documents", changed.union(new), ["source_id", "uri"], store.KEEP_DOCUMENT).commit()
    return of.edit().delete("documents", of.table("documents").where("source_id = 'src3'")).commit().table("documents")


def ingest_errors(spark, sf_dir):
    """Documents that were well and fail now keep their row as an error and lose their chunks."""
    d = table(spark, sf_dir, "documents")
    empty = {"documents": spark.createDataFrame([], DOCUMENTS), "chunks": spark.createDataFrame([], CHUNKS), "embeddings": spark.createDataFrame([], EMBEDDINGS)}
    of = lambda content: d.select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("uri"), content.alias("content"))
    first = ingest.ingest(ingest.from_files(of(F.concat(F.lit("x "), F.col("text"))), "s"), empty)
    failing = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("x "), F.col("text")))
    after = ingest.ingest(ingest.from_files(of(failing), "s"), first)
    held = after["chunks"].select(F.col("document_id").alias("id")).distinct().withColumn("chunks", F.lit(True))
    return after["documents"].join(held, "id", "left").select("uri", "status", F.coalesce("chunks", F.lit(False)).alias("chunks"))


QUERIES = {f.__name__: f for f in (
    upsert_sources, upsert_embeddings, delete_documents, remove_all, rebuilt_vectors, meta_put, migrations, reembedded, existing_chunks, recent_sources, address_like_paths, path_helpers, word_helpers,
    fetch_scopes, resolved_links, followed, full_dump, selected_urls, tree_files, openapi_documents, rerank_positions, snapshot_changes, ingest_errors,
)}

C_SQL = "c as (select doc_id::varchar id, doc_id, 'd' || (doc_id // 3) document_id, text, case when doc_id % 2 = 0 then lang end heading, case when doc_id % 4 = 0 then '' end title from documents)"
ORACLE_SQL = {
    "snapshot_changes": """with d as (select doc_id::varchar id, source source_id, 'doc://' || doc_id uri, lang title, sha256(text) content_hash, case when source = 'src1' then 'error' else 'ok' end status from documents where source is distinct from 'src3')
select * from d union all select 'n' || id, source_id, uri || '/new', title, content_hash, status from d where source_id = 'src2'""",
    "upsert_sources": """with d as (select distinct source s from documents) select s id, 'x://' || s root_uri, upper(s) title, 'ready' status, '{"a":1}' meta_json from d union all select 'n' || s, 'y://' || s, 'new', 'pending', '{}' from d""",
    "upsert_embeddings": "select vec_id::varchar chunk_id, case when vec_id % 3 = 0 then 'new' else 'old' end model_id, len(embedding)::integer dims from embeddings union all select 'n' || vec_id, 'new', len(embedding)::integer from embeddings where vec_id % 3 <> 0",
    "delete_documents": f"with {C_SQL} select 'chunk' kind, id from c where document_id not like '%0' union all select 'embedding', vec_id::varchar from embeddings where vec_id::varchar not in (select id from c where document_id like '%0')",
    "remove_all": "select unnest(['sources', 'documents', 'chunks', 'embeddings']) name, 0::bigint n, (select count(distinct source) from documents) removed",
    "rebuilt_vectors": "select vec_id::varchar chunk_id, '64' told from embeddings where vec_id % 4 <> 0",
    "meta_put": "select source \"key\", case when source = 'src1' then 'changed' else min(lang) end \"value\" from documents group by 1 union all select 'new', '1'",
    "migrations": f"with {C_SQL} select id, coalesce(title, 'Title ' || (doc_id // 3)) title, 2::bigint steps from c",
    "reembedded": "select doc_id::varchar chunk_id, 'hashed-32' model_id, 32::integer dims, 1.0::double length from documents",
    "existing_chunks": f"with {C_SQL} select id, concat_ws(chr(10), 'Title ' || (doc_id // 3), heading, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '')) \"read\" from c",
    "recent_sources": "select source id, max(doc_id) updated_at from documents group by 1",
    "address_like_paths": "with f as (select doc_id from documents where doc_id % 3 <> 2 order by doc_id::varchar limit 5) select doc_id::varchar id, 'https://x/' || doc_id section_path from f where doc_id % 3 = 0",
    "path_helpers": """with e as (select doc_id, source, ['.md', '.PY', '', '.bin', '.tsx', '.rst'][doc_id % 6 + 1] x from documents)
select doc_id, 'file:///data%20set/' || source || '/' || doc_id || x uri, '/data set/' || source || '/' || doc_id || x back, 'https://a/b c' shown, doc_id || x "name", x in ('.PY', '.tsx') code, x <> '.bin' readable, case x when '.PY' then 'python' when '.tsx' then 'typescript' end "language" from e""",
    "word_helpers": r"""with w as (select doc_id, source, regexp_replace(regexp_extract(text, '^[^ \n]*'), '^[\p{P}\p{S}\p{Z}]+|[\p{P}\p{S}\p{Z}]+$', '', 'g') word from documents)
select doc_id, word, lower(word) in (""" + ", ".join(f"'{w}'" for w in sorted(fts.STOPWORDS)) + r""") function_word, '# A' || chr(10) || chr(10) || source || chr(10) || ' x y' || chr(10) || chr(10) || '## Direct link to z' clean from w""",
    "fetch_scopes": """select page_id, page_id % 6 in (0, 1, 3, 4) under, true same, page_id % 6 in (3, 5) openapi, page_id % 6 = 4 companion,
case page_id % 5 when 0 then 'http_failed' when 1 then 'empty_body' when 2 then 'cloudflare_challenge' when 3 then 'boilerplate_only' end reason from pages""",
    "resolved_links": "select page_id, case page_id % 6 when 0 then 'https://ex.com/top' when 1 then 'https://ex.com/a/sub/x' when 2 then 'https://ex.com/a/' || page_id || '?q=1' when 3 then 'https://ex.com/a/' || page_id when 5 then 'https://other.org/z' end link from pages",
    "followed": """with p as (select page_id, page_id % 6 n, 'https://ex.com/p/' || page_id url from pages)
select url, n in (0, 1) ok, case n when 1 then url || '/moved' when 3 then 'https://other.org/' else url end final, case n when 0 then 'body ' || page_id when 1 then 'moved ' || page_id end body,
case n when 2 then 'too many redirects' when 3 then 'out of scope' when 4 then 'status 404' when 5 then 'no response' end error from p""",
    "full_dump": "select 0 pos, 'https://ex.com/docs/llms-full.txt' url",
    "selected_urls": """with p as (select page_id::integer i, page_id // 5 g, page_id % 5 r from pages where page_id % 5 <> 0)
select min(i) pos, arg_min('https://ex.com/docs/' || case r when 1 then 'fr/' when 2 then 'v1.2/' else '' end || 'p' || g, case r when 1 then 1000 when 2 then 2000 else 0 end + r) url from p group by g order by pos limit 50""",
    "tree_files": """with l as (select doc_id, 0 pos, case when doc_id % 3 = 0 then 'docs/' else 'src/' end || 'f' || doc_id || '.md' path from documents
union all select doc_id, 1, 'guide/g' || doc_id || '.md' from documents union all select doc_id, 2, 'docs/h' || doc_id || '.txt' from documents),
t as (select path from l where regexp_matches(path, '^(docs|guide)/') and doc_id % 5 <> 0 and doc_id % 7 <> 0 order by pos, path limit 500)
select path, 'https://raw.githubusercontent.com/o/r/main/' || path url from t""",
    "openapi_documents": """select 'https://ex.com/' || source || '/openapi.json' uri, case when source not like '%0' then source end title, case when source like '%0' then 'error' else 'ok' end status, case when source not like '%0' then count(*)::varchar end version, source not like '%0' in_order
from documents group by source""",
    "rerank_positions": "with d as (select source, doc_id, row_number() over (partition by source order by length(text) desc nulls last, doc_id) - 1 i from documents) select source query_id, doc_id, (9 - i) / 10.0::double score from d where i < 10",
    "ingest_errors": "select '/d/' || doc_id || '.md' uri, case when doc_id % 3 = 0 then 'error' else 'ok' end status, doc_id % 3 <> 0 chunks from documents",
}
