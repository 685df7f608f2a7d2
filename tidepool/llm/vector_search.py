"""Exact top-k by inner product over a pivot-distance index.

Index: every vector is keyed by its nearest pivot and its distance to it. Pivots are
the centres of a bounded sample's clusters; a pivot's distances are cut into annuli at
quantiles of the sample. Pivot and annulus are a cell. There are as many as the number
of vectors calls for, CELLS at most; of each the driver holds the least and greatest
distance, the greatest norm and the number of vectors. Vectors lie in order of their
cells, in blocks of bounded size; however many equal ones there are, they are spread.

Search: with q a query, v a vector and p its pivot, the triangle inequality bounds
<q, v> in a cell in two ways, from |d(q, p) - d(v, p)| <= d(q, v) and, as <q, v> =
<q, p> + <q, v - p>, from d(v, p). A query first expands its best-bounded cells until
they hold enough vectors; the k-th best score so far is its threshold. Then it
expands the others in which the bound reaches the threshold and stops there: no
other cell can hold one of its k best. Cells whose bound equals the threshold are
expanded, so ties are settled by id.

Queries are taken in groups of bounded size, which are broadcast to the blocks; each
task keeps a query's k best only. `log` is told how many pairs of query and vector
were expanded out of all.

Vectors of each length are searched on their own: a query meets candidates of its length.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows with a null id; a query id that is repeated with
vectors of one length asks once, with the least of them, one with vectors of several
lengths once for each; rows of the query's id are no candidates; repeated rows are
candidates as often as they come; with fewer candidates than k all are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.shared import bounded_batches, scratch, scratch_folder, tidied

#: Vectors that a cell should hold, cells and pivots at most, annuli of a pivot, and vectors of the sample.
CELL, CELLS, PIVOTS, ANNULI, SAMPLE, ROUNDS = 64, 16_384, 1024, 2, 4096, 8
#: Vectors of a block, queries of a group, numbers in a group's vectors and results, and vectors that give the first threshold.
BLOCK, QUERIES, NUMBERS, ENOUGH = 2048, 4096, 1 << 21, 64
LOWEST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of each component, for vectors that take part."""
    x = F.transform(vectors[vector], lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(vectors[key].cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("v"), sound.alias("ok"))
    return rows.where("ok and id is not null and size(v) > 0").select("id", "v")


def packed(v: np.ndarray) -> np.ndarray:
    """The integers in the narrowest type that holds them."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    width = next(w for w in (2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return v.astype(f"<i{width}")


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    """Vectors of one length, each in a type of its own."""
    sizes = {len(r) for r in rows}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(rows), f"<i{sizes.pop() // dims}").reshape(len(rows), dims)
    return np.array([np.frombuffer(r, f"<i{len(r) // dims}") for r in rows], np.int64)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where all sums are exact in it."""
    largest = np.sqrt((q.astype(float) ** 2).sum(axis=1).max() * (v.astype(float) ** 2).sum(axis=1).max())
    if largest < 2**52:
        return (q.astype(float) @ v.T.astype(float)).astype(np.int64)
    return q.astype(np.int64) @ v.T.astype(np.int64)


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (v.astype(float) ** 2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * v.astype(float) @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def centres(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres of the sample's clusters, or as many as it has different vectors."""
    _, first = np.unique(sample, axis=0, return_index=True)
    points = sample[np.sort(first)[:n]].astype(float)
    for _ in range(ROUNDS):
        near = distances(sample, points).argmin(axis=1)
        n_of = np.bincount(near, minlength=len(points))
        sums = np.zeros_like(points)
        np.add.at(sums, near, sample.astype(float))
        points = np.where(n_of[:, None] > 0, sums / np.maximum(n_of, 1)[:, None], points)
    return points


class Cells:
    """Pivots and the edges of their annuli; with `held`, the bounds for queries against all cells."""

    def __init__(self, sample: np.ndarray, total: int):
        cells = min(CELLS, max(1, total // CELL))
        self.pivots = centres(sample, min(PIVOTS, max(1, cells // ANNULI)))
        self.annuli = max(1, min(cells // len(self.pivots), CELLS // len(self.pivots)))
        d = distances(sample, self.pivots)
        near = d.argmin(axis=1)
        self.edges = np.full((len(self.pivots), self.annuli - 1), np.inf)
        for p in range(len(self.pivots)):
            own = d[near == p, p]
            if len(own) and self.annuli > 1:
                self.edges[p] = np.quantile(own, np.arange(1, self.annuli) / self.annuli)

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot of each vector."""
        d = distances(v, self.pivots)
        near = d.argmin(axis=1)
        d = d[np.arange(len(v)), near]
        return near * self.annuli + (self.edges[near] < d[:, None]).sum(axis=1), d

    def hold(self, table: pd.DataFrame) -> None:
        self.cell = table["cell"].to_numpy(np.int64)
        self.low, self.high, self.norm, self.n = (table[c].to_numpy(float) for c in ("low", "high", "norm", "n"))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Greatest possible score of each query in each cell, with room for rounding."""
        pivot = self.cell // self.annuli
        d = distances(q, self.pivots)[:, pivot]
        apart = np.maximum(0, np.maximum(d - self.high, self.low - d) - 1e-3)
        own = (q.astype(float) ** 2).sum(axis=1)[:, None]
        direct = (q.astype(float) @ self.pivots.T)[:, pivot] + np.sqrt(own) * (self.high + 1e-3)
        reach = np.minimum(np.minimum((own + self.norm - apart**2) / 2, np.sqrt(own * self.norm)), direct)
        return reach + np.abs(reach) * 1e-12 + 1

    def first(self, bound: np.ndarray, enough: int) -> np.ndarray:
        """Cells to expand at first: the best-bounded that hold enough vectors."""
        order = np.argsort(-bound, axis=1, kind="stable")
        held = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, held < enough, axis=1)
        return out


class Best:
    """The k best of each query of a group, among what one task has met."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.vectors, self.least, self.k = ids, vectors, least.copy(), k
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def meet(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """rows: the queries that expand this block, whose ids and vectors are given."""
        scores = products(self.vectors[rows], v)
        hits = scores >= self.least[rows][:, None]
        for i in np.flatnonzero(hits.any(axis=1)):
            r = int(rows[i])
            some = np.flatnonzero(hits[i] & (ids != self.ids[r]))
            s, n = scores[i, some], ids[some]
            if r in self.found:
                s, n = np.concatenate((self.found[r][0], s)), np.concatenate((self.found[r][1], n))
            top = best(s, n, self.k)
            self.found[r] = s[top], n[top]
            if len(top) == self.k:
                self.least[r] = max(self.least[r], s[top[-1]])

    def batch(self) -> pa.RecordBatch:
        parts = [(np.full(len(s), self.ids[r]), n, s) for r, (s, n) in self.found.items()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(p[c] for p in parts)])) for c in range(3)], ["query_id", "vec_id", "score"])


FOUND = "query_id bigint, vec_id bigint, score bigint"


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, log: Callable[[dict], None] | None = None) -> DataFrame:
    """query_id, rank, vec_id and score. queries: rows of the same columns as vectors, any number of them."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    all_rows, asked = quantised(vectors, key, vector, scale), quantised(queries, key, vector, scale)
    sizes = {r["d"]: r["n"] for r in all_rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    wanted = {r["d"] for r in asked.select(F.size("v").alias("d")).distinct().collect()}
    at = scratch_folder(spark, "found")
    spark.createDataFrame([], f"{FOUND}, rank int").write.parquet(at)
    for d in sorted(wanted & sizes.keys()):
        search_length(all_rows.where(F.size("v") == d), asked.where(F.size("v") == d), d, sizes[d], k, at, log)
    return spark.read.schema(f"{FOUND}, rank int").parquet(at).select("query_id", "rank", "vec_id", "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def index(all_rows: DataFrame, dims: int, total: int) -> tuple[Cells, DataFrame]:
    """The cells of `total` quantised vectors of one length, and their blocks: cell, ids and vectors."""
    most = min(SAMPLE, max(256, NUMBERS // dims))
    sample = all_rows.orderBy(F.xxhash64("id"), "id", "v").limit(most).collect()  # `most` rows
    cells = Cells(np.array([r["v"] for r in sample], np.int64), total)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy().reshape(-1, dims)
                cell, d = cells.place(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(d), pa.array((v.astype(float) ** 2).sum(axis=1)), pa.array([x.tobytes() for x in packed(v)], pa.binary())],
                    ["id", "cell", "distance", "norm", "v"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring rows of a cell as one row."""
        ids: list[int] = []
        rows: list[bytes] = []
        now = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([packed(unpacked(rows, dims)).tobytes()], pa.binary())], ["cell", "ids", "vs"])

        for batch in batches:
            for cell, i, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if rows and (cell != now or len(rows) == BLOCK):
                    yield made()
                    ids, rows = [], []
                now = cell
                ids.append(i)
                rows.append(v)
        if rows:
            yield made()

    placed = scratch(all_rows.mapInArrow(tidied(keyed), "id bigint, cell int, distance double, norm double, v binary"), "vectors")
    table = placed.groupBy("cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n"))
    cells.hold(table.orderBy("cell").toPandas())  # at most CELLS rows
    dealt = placed.select("cell", "id", "v").repartitionByRange("cell", "id", "v").sortWithinPartitions("cell", "id")
    return cells, scratch(dealt.mapInArrow(tidied(blocks), "cell int, ids binary, vs binary"), "blocks")


def search_length(all_rows: DataFrame, asked: DataFrame, dims: int, total: int, k: int, at: str, log: Callable[[dict], None] | None = None) -> None:
    """Adds what queries of one length find among the `total` vectors of it to the table at `at`, group by group."""
    spark = all_rows.sparkSession
    cells, blocks = index(all_rows, dims, total)
    asked = scratch(asked.groupBy("id").agg(F.min("v").alias("v")), "queries")
    n = asked.count()
    groups = -(-n // max(1, min(QUERIES, NUMBERS // max(dims, k))))
    number = F.pmod(F.xxhash64("id"), F.lit(max(1, groups)))
    for g in range(groups):
        rows = asked.where(number == g).collect()  # about QUERIES rows or fewer
        if not rows:
            continue
        ids, q = np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64)
        least = np.full(len(q), LOWEST)
        near = chosen(cells, q, least, None, k)
        found = ranked(expanded(blocks, cells, ids, q, least, near, k, dims), k).collect()  # k rows for each query of the group
        place = {int(x): i for i, x in enumerate(ids)}
        for r in found:
            if r["rank"] == k:
                least[place[r["query_id"]]] = r["score"]
        more = chosen(cells, q, least, near, k)
        out = spark.createDataFrame([(r["query_id"], r["vec_id"], r["score"]) for r in found], FOUND)
        if more.any():
            out = out.union(expanded(blocks, cells, ids, q, least, more, k, dims))
        ranked(out, k).select("query_id", "vec_id", "score", "rank").write.mode("append").parquet(at)
        if log is not None:
            held = np.unpackbits(near | more, axis=0, count=len(q)).sum(axis=0) @ cells.n
            log({"length": dims, "queries": len(q), "vectors": total, "expanded": int(held), "pairs": len(q) * total})


def chosen(cells: Cells, q: np.ndarray, least: np.ndarray, before: np.ndarray | None, k: int) -> np.ndarray:
    """Which query expands which cell, as bits (queries by eights, cells): at first the best-bounded, then the others whose bound reaches the threshold."""
    out = []
    for a in range(0, len(q), 256):
        bound = cells.bounds(q[a : a + 256])
        if before is None:
            need = cells.first(bound, max(ENOUGH, k + 1))
        else:
            need = (bound >= least[a : a + 256][:, None]) & ~np.unpackbits(before[a // 8 : a // 8 + 32], axis=0, count=len(bound)).astype(bool)
        out.append(np.packbits(need, axis=0))
    return np.concatenate(out)


def expanded(blocks: DataFrame, cells: Cells, ids: np.ndarray, q: np.ndarray, least: np.ndarray, need: np.ndarray, k: int, dims: int) -> DataFrame:
    """The k best of each query in each task's blocks."""
    column = {int(c): i for i, c in enumerate(cells.cell)}
    sent = blocks.sparkSession.sparkContext.broadcast((ids, q, least, need, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_, q_, least_, need_, column_ = sent.value
        top = Best(ids_, q_, least_, k)
        for batch in batches:
            for cell, raw, vs in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows = np.flatnonzero(np.unpackbits(need_[:, column_[cell]], count=len(q_)))
                if len(rows):
                    own = np.frombuffer(raw, "<i8")
                    top.meet(rows, own, np.frombuffer(vs, f"<i{len(vs) // (len(own) * dims)}").reshape(len(own), dims))
        yield top.batch()

    wanted = [int(c) for c in cells.cell[need.any(axis=0)]]
    return blocks.where(F.col("cell").isin(wanted)).mapInArrow(tidied(run), FOUND)
