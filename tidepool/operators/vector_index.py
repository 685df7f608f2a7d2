"""A vector index on disk: coarse cells, codes of one byte a component, exact rescoring.

Vectors are dealt to the nearest of a bounded number of centres (by angle), which are found on
a bounded sample: at most SAMPLE vectors, a documented bound of the fit alone; every vector is
indexed. A cell's folder holds codes (the unit vector in steps of 1 / 127 of its greatest component)
with the attributes that searches filter by, and apart from them the vectors themselves.

A search scores the codes of the cells nearest to the query (as many as the sample shows to be
enough for 95 % of the 40 nearest), filters first, takes the best
SPARE times as many as asked for, reads the vectors of those and ranks by the exact
cosine. If too few rows pass in the cells looked at, more cells are; `probes` of all cells, or
exact=True, leaves nothing out. search_all() does it for a table of queries, a bounded group at a
time: a group is sent to the tasks, each reads its codes once and keeps the best for each query.

Defined results: vectors that are null, empty, of another length or of length zero, or hold null or
non-finite components, aren't indexed; keys are unique; ties of the exact score go by key; an
empty index finds nothing. A cell into which very many equal vectors fall is dealt over files by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators import manifest
from tidepool.operators.vector import cosine
from tidepool.session import written

#: Vectors that centres are fitted on, the most centres, rounds of the fit, rows of a cell that lie in one file at most (about).
SAMPLE, CELLS, ROUNDS, FILE_ROWS = 1 << 16, 1024, 12, 1 << 18
#: How many times as many rows as asked for are scored exactly, and queries sent to the tasks at once.
SPARE, GROUP = 4, 1024
#: As many cells are looked at as hold this share of the NEAR nearest vectors of TRIED sampled ones.
ENOUGH, NEAR, TRIED = 0.95, 40, 128


def units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def centres(sample: np.ndarray, n: int) -> np.ndarray:
    """Directions of n groups (spherical k-means from spread-out rows)."""
    rng = np.random.default_rng(7)
    found = sample[rng.permutation(len(sample))[:n]].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        empty = np.bincount(nearest, minlength=len(found)) == 0
        sums[empty] = sample[rng.integers(0, len(sample), int(empty.sum()))]
        found = units(sums)
    return found


def enough_cells(sample: np.ndarray, found: np.ndarray) -> int:
    """Cells that searches look at: measured on the sample, by the places that its nearest vectors' cells have among a query's."""
    near = min(NEAR, len(sample) - 1)
    if near < 1:
        return len(found)
    cell, ranks = np.argmax(sample @ found.T, axis=1), []
    for q in range(min(TRIED, len(sample))):
        alike = sample @ sample[q]
        alike[q] = -2.0
        place = np.empty(len(found), int)
        place[np.argsort(-(found @ sample[q]), kind="stable")] = np.arange(len(found))
        ranks.append(place[cell[np.argpartition(-alike, near - 1)[:near]]])
    return min(len(found), 1 + int(np.quantile(np.concatenate(ranks), ENOUGH, method="higher")))


def usable(column: str, dims: int | None) -> Column:
    x = F.col(column)
    ok = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(ok if dims is None else ok & (F.size(x) == dims), F.lit(False))


class VectorIndex:
    def __init__(self, spark: SparkSession, at: str, told: dict):
        self.spark, self.at, self.told = spark, at, told
        self.key, self.dims, self.attributes = told["key"], told["dims"], told["attributes"]
        self.centres = np.array(told["centres"], float).reshape(-1, self.dims or 1)

    @classmethod
    def create(cls, vectors: DataFrame, at: str, key: str = "chunk_id", column: str = "embedding", dims: int | None = None, attributes: tuple[str, ...] = ()) -> VectorIndex:
        """An index of the vectors of one length: `dims`, or that which most have. attributes: columns that searches may filter by."""
        spark = vectors.sparkSession
        good = vectors.where(usable(column, dims)).select(F.col(key).alias("key"), F.col(column).cast("array<float>").alias("vector"), *attributes)
        if dims is None:
            most = good.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
            dims = most["n"] if most else 0
            good = good.where(F.size("vector") == dims)
        total = good.count()
        chance = F.lit(4.0 * SAMPLE * (1 << 30) / max(1, total))
        some = good.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < chance).orderBy(F.xxhash64("key"), "key").select("vector").limit(SAMPLE).collect()
        sample = units(np.array([r["vector"] for r in some], float).reshape(len(some), dims))
        found = centres(sample, max(1, min(CELLS, int(np.sqrt(total)), len(sample)))) if total else np.zeros((0, dims))
        sent = spark.sparkContext.broadcast(found)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = units(np.array(batch.column("vector").to_pylist(), float).reshape(batch.num_rows, dims))
                scale = np.abs(rows).max(axis=1, keepdims=True, initial=1e-30) / 127
                codes = np.round(rows / scale).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.argmax(rows @ sent.value.T, axis=1).astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((scale[:, 0] / np.maximum(1e-30, np.linalg.norm(codes * scale, axis=1))))],
                    [*batch.schema.names, "cell", "code", "scale"],
                )

        parts = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // FILE_ROWS))))
        rows = good.mapInArrow(coded, f"{kinds}, cell int, code binary, scale double") if total else good.selectExpr("*", "0 as cell", "cast(null as binary) as code", "0D as scale")
        rows = written(rows.repartition("cell", parts).sortWithinPartitions("cell", "key"), "coded")
        rows.select("key", *attributes, "code", "scale", "cell").write.option("compression", "zstd").partitionBy("cell").parquet(f"{at}/codes")
        rows.select("key", "vector", "cell").write.option("compression", "zstd").partitionBy("cell").parquet(f"{at}/vectors")
        sizes = dict(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each cell
        told = {"key": key, "dims": dims, "n": total, "sizes": [sizes.get(c, 0) for c in range(len(found))], "attributes": list(attributes), "centres": found.tolist(), "probes": enough_cells(sample, found), "schema": kinds}
        manifest.commit(spark, at, 0, told)
        return cls(spark, at, told)

    @classmethod
    def load(cls, spark: SparkSession, at: str) -> VectorIndex:
        number, told = manifest.read(spark, at)
        if not number:
            raise ValueError(f"no index in {at}")
        return cls(spark, at, told)

    def _table(self, name: str) -> DataFrame:
        kinds = dict(k.strip().split(" ", 1) for k in _columns(self.told["schema"]))
        schema = ", ".join([f"key {kinds['`key`']}", *(f"`{a}` {kinds[f'`{a}`']}" for a in self.attributes), "code binary, scale double", "cell int"] if name == "codes" else [f"key {kinds['`key`']}", "vector array<float>", "cell int"])
        return self.spark.read.schema(schema).parquet(f"{self.at}/{name}")

    def nearest_cells(self, vector: list[float]) -> list[int]:
        """All cells, nearest first."""
        return np.argsort(-(self.centres @ units(np.array([vector], float))[0]), kind="stable").tolist()

    def search(self, vector: list[float], limit: int, where: Column | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """key and score (cosine) of the nearest rows that pass, best first. exact: by all vectors, whatever the cells."""
        if len(vector) != self.dims or limit < 1 or not self.told["n"] or not np.any(vector):
            return self._table("vectors").limit(0).select(F.col("key").alias(self.key), F.lit(0.0).alias("score"))
        order, probes = self.nearest_cells(vector), len(self.centres) if exact else probes or self.told["probes"]
        while True:
            cells = order[:probes]
            rows = self._table("codes").where(F.col("cell").isin(cells))
            rows = rows if where is None else rows.where(where)
            if exact:
                few = rows.select("cell", "key")
                picked = self._table("vectors") if where is None else self._table("vectors").join(few, ["cell", "key"], "left_semi")
                break
            best = rows.select("cell", "key", self._alike(vector)(F.col("code"), F.col("scale")).alias("alike")).orderBy(F.desc("alike"), "key").limit(SPARE * limit).collect()
            if len(best) >= limit or probes >= len(order):
                keys = [r["key"] for r in best]
                picked = self._table("vectors").where(F.col("cell").isin(sorted({r["cell"] for r in best})) & F.col("key").isin(keys))
                break
            probes *= 2
        target = F.array(*map(F.lit, map(float, vector)))
        return picked.select(F.col("key").alias(self.key), cosine(F.col("vector"), target).alias("score")).orderBy(F.desc("score"), self.key).limit(limit)

    def _alike(self, vector: list[float]):
        target, dims = units(np.array([vector], float))[0], self.dims

        @F.pandas_udf("double")
        def alike(code: pd.Series, scale: pd.Series) -> pd.Series:
            codes = np.frombuffer(b"".join(code), np.int8).reshape(-1, dims)
            return pd.Series((codes @ target) * scale.to_numpy())

        return alike

    def search_all(self, queries: DataFrame, limit: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """query_id, key, score and rank (from 1) of each query's nearest rows. queries: query_id and vector; those of another length find nothing. A condition that few rows meet may leave a query with fewer than there are: then more probes are needed."""
        good = written(queries.where(usable("vector", self.dims)).select("query_id", F.col("vector").cast("array<float>").alias("vector")), "queries")
        kind, probes = good.schema["query_id"].dataType.simpleString(), probes or self.told["probes"]
        key_kind = self._table("vectors").schema["key"].dataType.simpleString()
        parts = max(1, -(-good.count() // GROUP))
        found = None
        for part in range(parts):  # a group of about GROUP queries at a time
            rows = good.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()
            if not rows or not self.told["n"]:
                continue
            ids, targets = [r["query_id"] for r in rows], units(np.array([r["vector"] for r in rows], float))
            order = np.argsort(-(targets @ self.centres.T), axis=1, kind="stable")
            held = np.cumsum(np.array(self.told["sizes"])[order], axis=1)
            enough = np.maximum(probes, 1 + (held < SPARE * limit).sum(axis=1))  # cells that hold as many rows as are scored exactly
            wants = np.zeros((len(self.centres), len(ids)), bool)
            for q, cells in enumerate(order):
                wants[cells[: enough[q]], q] = True
            sent = self.spark.sparkContext.broadcast((ids, targets, wants))

            def scored(batches: Iterator[pa.RecordBatch], sent=sent, keep=SPARE * limit) -> Iterator[pa.RecordBatch]:
                ids, targets, wants = sent.value
                best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
                for batch in batches:
                    cells, scale = batch.column("cell").to_numpy(), batch.column("scale").to_numpy()
                    keys = np.array(batch.column("key").to_pylist(), object)
                    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(len(keys), -1)
                    for cell in np.unique(cells):
                        mine, asked = np.flatnonzero(cells == cell), np.flatnonzero(wants[cell])
                        alike = (codes[mine] @ targets[asked].T) * scale[mine, None]
                        for j, q in enumerate(asked.tolist()):
                            old = best.get(q)
                            score, name = alike[:, j], keys[mine]
                            at = np.full(len(mine), cell)
                            if old is not None:
                                score, name, at = np.concatenate((old[0], score)), np.concatenate((old[1], name)), np.concatenate((old[2], at))
                            top = np.argsort(-score, kind="stable")[:keep]
                            best[q] = score[top], name[top], at[top]
                for q, (score, name, at) in best.items():
                    yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(score), batch_kind(ids)), pa.array(at.astype(np.int32)), pa.array(name.tolist()), pa.array(score)], ["query_id", "cell", "key", "alike"])

            codes = self._table("codes").where(F.col("cell").isin(np.flatnonzero(wants.any(axis=1)).tolist()))
            codes = codes if where is None else codes.where(where)
            one = codes.select("cell", "key", "code", "scale").mapInArrow(scored, f"query_id {kind}, cell int, key {key_kind}, alike double")
            one = written(one, "scored")
            found = one if found is None else found.unionByName(one)
        if found is None:
            return good.limit(0).select("query_id", F.lit(None).cast(key_kind).alias(self.key), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        spare = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("alike"), "key"))
        few = found.withColumn("n", spare).where(F.col("n") <= SPARE * limit)
        exact = few.join(self._table("vectors"), ["cell", "key"]).join(good.withColumnRenamed("vector", "target"), "query_id")
        exact = exact.select("query_id", "key", cosine(F.col("vector"), F.col("target")).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
        return exact.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", F.col("key").alias(self.key), "score", "rank")


def batch_kind(ids: list) -> pa.DataType:
    return pa.array(ids).type


def _columns(schema: str) -> list[str]:
    """The parts of a schema's text at its top level."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
