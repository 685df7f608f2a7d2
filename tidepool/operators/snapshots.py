"""Stored tables in buckets, of which a change rewrites those that it touches.

All tables of a store have one manifest (operators.manifest): for each bucket of each table the
folder that holds it. A change reads the buckets that its keys fall into, merges, writes those
anew beside the old ones, and then makes the next version of the manifest: so several
tables change together or not at all, readers keep the version that they have loaded, a
crash leaves the old one, and of two writers at once the second is told (manifest.Conflict).

A table is dealt into buckets by the columns that its changes name: documents by source and
address, chunks by their document, embeddings by their chunk. What is written is in
proportion to the buckets touched, not to the table; `written` tells it in bytes.

Defined results: rows of new data that repeat a key are one of them, by the greatest of the other
columns in text; null keys are keys like others; a change without rows makes no new version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepool.operators import manifest, store

BUCKETS = 64
BUCKET = "__bucket"


def bucket_of(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


class Snapshots:
    """One version of a store."""

    def __init__(self, spark: SparkSession, at: str, version: int, told: dict, written: int = 0):
        self.spark, self.at, self.version, self.tables, self.written = spark, at, version, told, written

    @classmethod
    def create(cls, spark: SparkSession, at: str, tables: dict[str, tuple[DataFrame, list[str]]], buckets: int = BUCKETS) -> Snapshots:
        """A store of these tables, each with the columns that deal it into buckets."""
        empty = {name: {"schema": rows.schema.jsonValue(), "by": by, "buckets": buckets, "at": {}} for name, (rows, by) in tables.items()}
        edit = Edit(cls(spark, at, 0, empty))
        for name, (rows, _) in tables.items():
            edit.change(name, rows, lambda old, new: new)
        return edit.commit(always=True)

    @classmethod
    def load(cls, spark: SparkSession, at: str, version: int | None = None) -> Snapshots:
        number, told = manifest.read(spark, at, version)
        if not number:
            raise ValueError(f"no store in {at}")
        return cls(spark, at, number, told)

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        of = self.tables[name]
        schema = StructType.fromJson(of["schema"])
        paths = sorted({p for b, p in of["at"].items() if buckets is None or int(b) in buckets})
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def edit(self) -> Edit:
        return Edit(self)


class Edit:
    """Changes of a store's tables that become its next version together."""

    def __init__(self, of: Snapshots):
        self.of, self.tables, self.written = of, dict(of.tables), 0

    def change(self, name: str, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Edit:
        """merge: what becomes of the old rows in the buckets that the new rows' keys fall into. It may not make rows of other keys."""
        told = self.tables[name]
        by, n = told["by"], told["buckets"]
        to = f"{self.of.at}/data/{name}-{uuid.uuid4().hex}"
        new.write.option("compression", "zstd").parquet(f"{to}/new")  # read twice
        new = self.of.spark.read.schema(new.schema).parquet(f"{to}/new")
        touched = sorted(r[0] for r in new.select(bucket_of(by, n)).distinct().collect())  # `buckets` rows at most
        if touched:
            old = Snapshots(self.of.spark, self.of.at, self.of.version, self.tables).table(name, touched)
            rows = merge(old, new).select(*old.columns)
            rows.withColumn(BUCKET, bucket_of(by, n)).repartition(BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{to}/rows")
            fs, path = manifest.file_system(self.of.spark, f"{to}/rows")
            made = {f.getPath().getName().partition("=")[2]: f.getPath().toString() for f in fs.listStatus(path) if "=" in f.getPath().getName()}
            self.written += fs.getContentSummary(path).getLength()
            left = {b: p for b, p in told["at"].items() if int(b) not in touched}
            self.tables[name] = told | {"at": left | made}
        manifest.remove(self.of.spark, f"{to}/new")
        return self

    def upsert(self, name: str, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), defaults: dict | None = None) -> Edit:
        """store.upsert() by keys that hold those which deal the table."""
        return self.change(name, _one_of_each(new, keys), lambda old, rows: store.upsert(old, rows, keys, keep, defaults=defaults or {}))

    def replace(self, name: str, new: DataFrame) -> Edit:
        """All rows with a key of the new ones go, and these come."""
        by = self.tables[name]["by"]
        return self.change(name, new, lambda old, rows: _without(old, rows, by).unionByName(rows.select(*old.columns)))

    def delete(self, name: str, gone: DataFrame) -> Edit:
        """Without the rows of these keys (the columns that deal the table)."""
        by = self.tables[name]["by"]
        return self.change(name, gone.select(*by).distinct(), lambda old, rows: _without(old, rows, by))

    def commit(self, always: bool = False) -> Snapshots:
        if self.tables == self.of.tables and not always:
            return self.of
        version = manifest.commit(self.of.spark, self.of.at, self.of.version, self.tables)
        return Snapshots(self.of.spark, self.of.at, version, self.tables, self.written)


def _without(old: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    keys = gone.select(*(F.col(c).alias(f"__{c}") for c in by)).distinct()
    return old.join(keys, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]), "left_anti")


def _one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.to_json(F.struct(*others))) if others else F.lit(None)
    return rows.groupBy(*keys).agg(best.alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in others))


def vanished(of: Snapshots, source_id: str, keep: DataFrame, name: str = "documents") -> DataFrame:
    """id, source_id and uri of a source's documents that aren't kept, none if nothing is."""
    return store.vanished(of.table(name), source_id, keep).select("id", "source_id", "uri")


def pruned(of: Snapshots, source_id: str, keep: DataFrame) -> Snapshots:
    """A store of documents, chunks and embeddings without a source's vanished documents and what hangs on them."""
    gone = vanished(of, source_id, keep)
    documents = gone.select(F.col("id").alias("document_id"))
    chunks = of.table("chunks").join(documents, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return of.edit().delete("documents", gone).delete("chunks", documents).delete("embeddings", chunks).commit()
