"""Snapshots of the engine's tables: upserts, deletes, prunes, counts, as joins of whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns whose old value stays when the new one is null; all others are overwritten.
KEEP_SOURCE = ("title", "strategy", "status")
KEEP_DOCUMENT = ("title", "content_hash", "extracted_path")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = (), fixed: tuple[str, ...] = ("id", "created_at"), defaults: dict | None = None) -> DataFrame:
    """old with new's rows put in by key. keep: columns where null doesn't overwrite; fixed: columns that an existing row never changes."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    is_new, is_old = F.col(f"n.{key[0]}").isNotNull(), F.col(f"o.{key[0]}").isNotNull()
    out = []
    for c in old.columns:
        was = F.col(f"o.{c}")
        if c not in new.columns:
            value = was
        else:
            now = F.col(f"n.{c}")
            both = F.coalesce(was, now) if c in fixed or c in key else F.coalesce(now, was) if c in keep else now
            value = F.when(is_new & is_old, both).when(is_new, now).otherwise(was)
        if defaults and c in defaults:
            value = F.when(is_new & ~is_old, F.coalesce(value, F.lit(defaults[c]))).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["root_uri"], KEEP_SOURCE, defaults={"status": "pending"})


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["source_id", "uri"], KEEP_DOCUMENT)


def replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old's rows of other keys, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    return rows.join(gone.select(F.col(gone_key or key).alias(key)).distinct(), key, "left_anti")


def delete_chunks(chunks: DataFrame, embeddings: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks and embeddings without those of the documents (their ids in `id`)."""
    ids = documents.select(F.col("id").alias("document_id")).distinct()
    gone = chunks.join(ids, "document_id", "left_semi")
    return chunks.join(ids, "document_id", "left_anti"), delete(embeddings, gone, "chunk_id", "id")


def vanished(documents: DataFrame, source_id: str, keep: DataFrame) -> DataFrame:
    """A source's documents whose uri isn't kept; none if nothing is kept."""
    gone = documents.where(F.col("source_id") == source_id).join(keep.select("uri").distinct(), "uri", "left_anti")
    some = keep.limit(1).select(F.lit(True).alias("__some"))
    return gone.crossJoin(F.broadcast(some)).drop("__some")  # one row or none


def prune(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, source_id: str, keep: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = vanished(documents, source_id, keep).select("id")
    left_chunks, left_embeddings = delete_chunks(chunks, embeddings, gone)
    return documents.join(gone, "id", "left_anti"), left_chunks, left_embeddings


def remove_source(tables: dict[str, DataFrame], source_id: str) -> tuple[dict[str, DataFrame], bool]:
    """All tables without a source and what hangs on it, and whether it was there."""
    sources, documents, chunks, embeddings = (tables[k] for k in ("sources", "documents", "chunks", "embeddings"))
    there = not sources.where(F.col("id") == source_id).isEmpty()
    own = F.col("source_id") == source_id
    gone = chunks.where(own)
    out = {"sources": sources.where(F.col("id") != source_id), "documents": documents.where(~own), "chunks": chunks.where(~own), "embeddings": delete(embeddings, gone, "chunk_id", "id")}
    return tables | out, there


def remove_all(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], int]:
    n = tables["sources"].count()
    return {k: t.limit(0) for k, t in tables.items()}, n


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n of each table, in one plan."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def stale_documents(documents: DataFrame, version: int) -> DataFrame:
    """How many searchable documents an older extractor has made."""
    made_by = F.get_json_object("meta_json", "$.extractor_version").cast("int")
    return documents.agg(F.count_if((F.col("status") == "ok") & (made_by.isNull() | (made_by < version))).alias("stale"))


def uri_like_paths(chunks: DataFrame, sample: int = 5) -> DataFrame:
    """Of the first chunks (by id) with a section path, those where it is an address."""
    return chunks.where(F.col("section_path").isNotNull()).orderBy("id").limit(sample).where(F.col("section_path").rlike("://"))


def listing(documents: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.select(F.col("id").alias("source_id"), "root_uri")
    return documents.join(s, "source_id").select("root_uri", "uri", "title", "status").orderBy("root_uri", "uri")


def recent_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.desc("updated_at"), "id")


def fill_titles(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks with their document's title where they have none."""
    d = documents.select(F.col("id").alias("document_id"), F.col("title").alias("__title"))
    return chunks.join(d, "document_id", "left").withColumn("title", F.coalesce("title", "__title")).drop("__title")


def keep_dims(embeddings: DataFrame, dims: int) -> DataFrame:
    return embeddings.where((F.col("dims") == dims) & (F.size("embedding") == dims))


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new's rows in place of those of their chunks."""
    return replace(old, new.select(*old.columns), "chunk_id")


def ensure_dims(embeddings: DataFrame, meta: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """The embeddings that have the embedder's dimensions, and the meta table that says so; nothing changes if it says so already."""
    if get_meta(meta, "vector_dims") == str(dims):
        return embeddings, meta
    return keep_dims(embeddings, dims), put_meta(meta, "vector_dims", str(dims))


def get_meta(meta: DataFrame, key: str) -> str | None:
    row = meta.where(F.col("key") == key).select("value").first()
    return row["value"] if row else None


@dataclass(frozen=True)
class Step:
    """A migration. definition: a text that says what it does; its checksum is kept, so a step that was changed afterwards is noticed."""

    name: str
    definition: str
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]

    @property
    def checksum(self) -> str:
        return hashlib.sha256(self.definition.encode()).hexdigest()


class ChangedStep(RuntimeError):
    """A step that the ledger has with another definition."""


def migrate(tables: dict[str, DataFrame], steps: list[Step | tuple[str, Callable]], baseline: int = 0) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables after all steps that the ledger in their meta table lacks, in order, and those steps' names.

    A step that the ledger has with another checksum is refused before anything runs.
    baseline: how many first steps a store has had that holds rows but no ledger; they
    are entered, not run. (name, function) stands for a step that its name defines.
    """
    known = [s if isinstance(s, Step) else Step(s[0], s[0], s[1]) for s in steps]
    ledger = {r["key"].removeprefix("migration:"): r["value"] for r in tables["meta"].where(F.col("key").startswith("migration:")).collect()}  # a row for each step
    for step in known:
        if ledger.get(step.name, step.checksum) not in (step.checksum, "done"):
            raise ChangedStep(f"migration {step.name} was applied with another definition")
    entered: list[Step] = []
    if not ledger and any(not t.isEmpty() for name, t in tables.items() if name != "meta"):
        entered = known[:baseline]
    new = [step for step in known[len(entered) :] if step.name not in ledger]
    for step in [*entered, *new]:
        tables = tables if step in entered else step.run(tables)
        tables = tables | {"meta": put_meta(tables["meta"], f"migration:{step.name}", step.checksum)}
    return tables, [step.name for step in new]


def put_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    return replace(meta, meta.sparkSession.createDataFrame([(key, value)], "key string, value string"), "key")


def save(df: DataFrame, path: str, partition: list[str] | None = None) -> DataFrame:
    """Writes a snapshot beside the one it may read from, and returns the new one. The caller switches to its path."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
