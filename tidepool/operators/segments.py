"""A full-text index on disk that grows, changes and shrinks, and of which a query reads little.

The index is a list of immutable segments. A segment holds chunks in ranges of an order of
their own (by length, so that neighbours are alike), the postings of their terms, and a
table from keys to places in that order.

Postings lie in blocks: a row for each term and each RANGE neighbouring chunks, with their
places, lengths, weighted frequencies and positions as arrays (which Parquet keeps as
differences), and in front of them the greatest frequency and least length of the block.
A task writes its blocks in sections, each ordered by term and range, so a query reads its own
terms' pages; nothing is shuffled or sorted by Spark for that.

A search for the best k first reads the blocks' heads. They give the document frequencies,
and for each range the most that a chunk of it can score. The ranges that promise most are scored; their
k-th best score is reached by k chunks in any case, so ranges that can't reach it are never
read. That holds with filters too, as only chunks that pass count. Then the hits'
chunks are read from the files whose ranges they lie in, which a small table tells.

Substrings: with_substrings() adds, for every three neighbouring characters of a lower-cased
text, a bit for each chunk of a range that has them, in sections like those of blocks. The
chunks that have all threes of the words asked for are candidates; only those are read, and
looked through.

Maintenance: chunks that are added make a new segment; deleting writes down the places that
are gone, with their terms' counts, and touches no block; a change is both. Statistics are sums
over segments less what is gone, so scores are those of a fresh index. As many segments of
like size as MERGE become one. Each change is one new version of the manifest (operators.manifest):
readers keep the version that they loaded.

Defined results: null texts count as empty; chunks without words are held and never
found; an empty index finds nothing; keys are unique; ties go by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from tidepool.operators import fts, manifest
from tidepool.session import bounded_batches, written

#: Chunks of a range, as a power of two; chunks of a file.
RANGE_BITS, PART_ROWS = 6, 1 << 16
#: Characters of a file, and steps in which sizes are told apart for each power of two.
PART_CHARS, LEVELS = 1 << 26, 8
#: Chunks that are worth a task of their own.
FEW_ROWS = 1 << 10
#: Occurrences of words, or rows of threes of characters, that a task puts in order at once; rows of a page of theirs, bytes of a group of pages (which has dictionaries of its own).
SECTION, PAGE_ROWS, GROUP_BYTES = 1 << 20, 4096, 8 << 20
#: Ranges that are scored to begin with, ranges named one by one in a scan, and segments of like size that become one.
SEEDS, NAMED, MERGE = 8, 4096, 4
#: A position in an array of positions: the field's number above this bit.
FIELD_BIT = 28
PLACE, LENGTH, SCORE = "__ord", "__len", "score"
#: Characters of a gram, bits of a character in its number, and characters of which grams are taken at once.
GRAM, CHAR_BITS, WINDOW = 3, 21, 1 << 17
GRAMS = "gram bigint, range bigint, bits bigint"
BLOCKS = "term string, range bigint, n int, tf bigint, most int, least int, ords array<bigint>, lens array<int>, fs array<int>, spots array<array<int>>"


@dataclass
class Reads:
    """What a search has read: posting blocks, of all; files with chunks, of all. Of a search for substrings the chunks that were looked through."""

    blocks: int = 0
    blocks_in_index: int = 0
    files: int = 0
    files_in_index: int = 0
    candidates: int | None = None


def occurrences(chunks: DataFrame, by: str = PLACE) -> DataFrame:
    """`by`, length, term and position of every occurrence; the corpus is tokenized here and nowhere else."""
    t = fts.tokenized(chunks, by)
    length = reduce(lambda a, b: a + b, [F.size(f"t_{f}") for f in fts.FIELDS])

    def spots(n: int, f: str) -> Column:
        return F.transform(f"t_{f}", lambda w, i: F.struct(w.alias("term"), (i.cast("int") + F.lit(n << FIELD_BIT)).alias("spot")))

    return t.select(by, length.alias(LENGTH), F.inline(F.concat(*(spots(n, f) for n, f in enumerate(fts.FIELDS)))).alias("term", "spot"))


def weighted(spots: Column) -> Column:
    """The weighted frequency of a term in a chunk."""
    weights = F.array(*(F.lit(int(w)) for w in fts.FIELDS.values()))
    return F.aggregate(spots, F.lit(0), lambda s, x: s + F.get(weights, F.shiftright(x, FIELD_BIT)))


def whole_ranges(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, so that neighbouring rows of a range come together. Places are the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held and batch.num_rows else batch
        if not batch.num_rows:
            continue
        ranges = batch.column(0).to_numpy() >> bits
        cut = np.flatnonzero(ranges != ranges[-1])
        cut = cut[-1] + 1 if len(cut) else 0
        if cut:
            yield batch.slice(0, cut)
        held = [batch.slice(cut)]
    yield from held


def sections(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of places and token arrays, put together until they hold that many tokens."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += sum(len(c.flatten()) for c in batch.columns[1:])
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, 4 * PAGE_ROWS):
        yield batch.slice(i, 4 * PAGE_ROWS)


def blocked(batch: pa.RecordBatch, bits: int, weights: list[int]) -> pa.RecordBatch | None:
    """The posting blocks of places and the token arrays of each field, by term and range; the rows of a range stand side by side."""
    places = batch.column(0).to_numpy()
    sizes = [c.value_lengths().to_numpy().astype(np.int64) for c in batch.columns[1:]]
    lens = sum(sizes).astype(np.int32)
    words = pa.concat_arrays([c.flatten() for c in batch.columns[1:]]).dictionary_encode()
    if not len(words):
        return None
    code, row = words.indices.to_numpy().astype(np.int64), np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    spot = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (k << FIELD_BIT) for k, n in enumerate(sizes)]).astype(np.int32)
    weight = np.repeat(np.array(weights, np.int32), [n.sum() for n in sizes])
    ranges = places >> bits
    nth = np.concatenate([[0], np.cumsum(ranges[1:] != ranges[:-1])])
    rank = np.empty(len(words.dictionary), np.int64)
    rank[pc.array_sort_indices(words.dictionary).to_numpy()] = np.arange(len(rank))
    posting = (rank[code] * (nth[-1] + 1) + nth[row] << bits) + (places[row] & (1 << bits) - 1)
    order = np.argsort(posting, kind="stable")  # fields come one after the other, so a posting's spots are in order
    posting, spot = posting[order], spot[order]
    starts = np.flatnonzero(np.concatenate([[True], posting[1:] != posting[:-1]]))
    of, row = posting[starts] >> bits, row[order][starts]
    heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    tf, fs, ls = np.diff(np.append(starts, len(spot))), np.add.reduceat(weight[order], starts).astype(np.int32), lens[row]
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(np.append(at, len(values)), pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [
            words.dictionary.take(pa.array(code[order][starts][heads])), pa.array(places[row[heads]] >> bits), pa.array(np.diff(np.append(heads, len(starts))).astype(np.int32)), pa.array(np.add.reduceat(tf, heads)),
            pa.array(np.maximum.reduceat(fs, heads)), pa.array(np.minimum.reduceat(ls, heads)), lists(heads, pa.array(places[row])), lists(heads, pa.array(ls)), lists(heads, pa.array(fs)), lists(heads, lists(starts, pa.array(spot))),
        ],
        [c.split()[0] for c in BLOCKS.split(", ")],
    )


def blocks_of(chunks: DataFrame) -> DataFrame:
    """The posting blocks of stored chunks, by the task that reads them: nothing is shuffled. A range that two tasks share has two blocks of a term, of different chunks."""
    bounded_batches(chunks.sparkSession)
    bits, most, weights = RANGE_BITS, SECTION, [int(w) for w in fts.FIELDS.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for section in sections(whole_ranges(batches, bits), most):
            made = blocked(section, bits, weights)
            if made is not None:
                yield from sliced(made)

    return fts.tokenized(chunks, PLACE).mapInArrow(run, BLOCKS)


def grams(low: str) -> set[int]:
    """Every three neighbouring characters, as the number that their code points make."""
    return {reduce(lambda n, c: n << CHAR_BITS | ord(c), low[i : i + GRAM], 0) for i in range(len(low) - GRAM + 1)}


def merged(grams: np.ndarray, ranges: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By gram and range, the bits of equal ones together."""
    order = np.lexsort((ranges, grams))
    grams, ranges = grams[order], ranges[order]
    heads = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (ranges[1:] != ranges[:-1])]))
    return grams[heads], ranges[heads], np.bitwise_or.reduceat(bits[order], heads)


def windows(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The grams of places and texts, as merged() has them, of WINDOW characters at once."""
    texts = batch.column(1).to_pylist()
    places, of = batch.column(0).to_numpy(), np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    for i in range(0, len(chars) - GRAM + 1, WINDOW):
        c, row = chars[i : i + WINDOW + GRAM - 1].astype(np.int64), of[i : i + WINDOW + GRAM - 1]
        n = len(c) - GRAM + 1
        whole = row[:n] == row[GRAM - 1 :]  # not across two texts
        at = places[row[:n][whole]]
        gram = reduce(lambda g, k: g << CHAR_BITS | c[k : k + n], range(1, GRAM), c[:n])[whole]
        if len(at):
            yield merged(gram, at >> bits, np.uint64(1) << (at & (1 << bits) - 1).astype(np.uint64))


def grams_of(stored: DataFrame) -> DataFrame:
    """The threes of characters of stored chunks: for each and each range the bits of the chunks that have it, by the task that reads them: nothing is shuffled. Where a section or a task ends within a range, a gram has two rows of different bits."""
    bounded_batches(stored.sparkSession)
    bits, most, names = RANGE_BITS, SECTION, [c.split()[0] for c in GRAMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def made() -> Iterator[pa.RecordBatch]:
            whole = merged(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            yield from sliced(pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in whole], names))

        for batch in batches:
            for some in windows(batch, bits):
                held.append(some)
                if sum(len(g) for g, _, _ in held) >= most:
                    yield from made()
        if held:
            yield from made()

    return stored.select(PLACE, F.lower("text").alias("low")).where("low is not null").mapInArrow(run, GRAMS)


def write_sections(rows: DataFrame, to: str) -> None:
    """Rows as they come, in pages so small that those of one key are few."""
    pages = {"parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.block.size": str(GROUP_BYTES)}
    rows.write.options(**pages).option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(to)


def dealt(chunks: DataFrame, size: Column, key: str, part_rows: int) -> tuple[int, Callable[[Column], Column]]:
    """How many parts chunks are stored in, and the part of a chunk of this size: of like sizes, and bounded in chunks and in characters."""
    level = lambda c: F.floor(F.log2(c + F.lit(1.0)) * LEVELS).cast("int")
    told = chunks.groupBy(level(size).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).orderBy("level").collect()  # 31 * LEVELS rows at most
    n = sum(r["n"] for r in told)
    tasks = max(1, min(chunks.sparkSession.sparkContext.defaultParallelism, n // FEW_ROWS))  # files are also what tasks are made of
    most = max(1, min(part_rows, -(-n // tasks)))
    first: dict[int, int] = {}
    many: dict[int, int] = {}
    parts = rows = chars = 0
    for r in told:
        k = max(1, -(-r["n"] // most), -(-r["size"] // PART_CHARS))
        if k > 1 or not parts or rows + r["n"] > most or chars + r["size"] > PART_CHARS:
            parts, rows, chars = parts + k, (0 if k == 1 else most), 0
        rows, chars = rows + r["n"], chars + r["size"]
        first[r["level"]], many[r["level"]] = parts - k, k

    def part(length: Column) -> Column:
        of = lambda told: F.create_map(*(F.lit(x) for pair in told.items() for x in pair))[level(length)] if told else F.lit(None).cast("int")
        return F.coalesce(of(first), F.lit(0)) + F.pmod(F.hash(key), F.coalesce(of(many), F.lit(1)))

    return max(1, parts), part


def write_segment(chunks: DataFrame, key: str, at: str, part_rows: int, substrings: bool = False) -> dict:
    """A segment of these chunks; what the manifest says of it."""
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    to = f"{at}/segments/{name}"
    size = reduce(lambda a, b: a + b, [F.coalesce(F.length(f), F.lit(0)) for f in fts.FIELDS if f in chunks.columns])
    # neighbours of like length: a block's greatest score is then near what its chunks reach
    parts, part = dealt(chunks, size, key, part_rows)
    ordered = chunks.withColumn(LENGTH, size).repartitionById(parts, part(F.col(LENGTH))).sortWithinPartitions(LENGTH, key).drop(LENGTH)
    ordered.withColumn(PLACE, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{to}/chunks")
    stored = spark.read.parquet(f"{to}/chunks")
    of = F.col("_metadata.file_path")
    stored.select(of.alias("file"), PLACE).groupBy("file").agg(F.min(PLACE).alias("first"), F.max(PLACE).alias("last"), F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{to}/files")
    stored.select(F.col(key).alias("key"), PLACE).repartitionByRange(parts, "key").sortWithinPartitions("key").write.option("compression", "zstd").parquet(f"{to}/keys")
    write_sections(blocks_of(stored), f"{to}/blocks")
    if substrings:
        write_sections(grams_of(stored), f"{to}/grams")
    n, files = spark.read.parquet(f"{to}/files").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, blocks = spark.read.schema(BLOCKS).parquet(f"{to}/blocks").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.count(F.lit(1))).first() if n else (0, 0)
    return {"name": name, "n": n, "tokens": tokens, "blocks": blocks, "files": files, "gone": []}


class SegmentIndex:
    """One version of an index; add(), change() and delete() make the next one and return it."""

    def __init__(self, spark: SparkSession, at: str, version: int, told: dict):
        self.spark, self.at, self.version, self.told = spark, at, version, told
        self.key: str = told["key"]
        self.columns: list[str] = told["columns"]
        self.segments: list[dict] = told["segments"]
        self.part_rows: int = told["part_rows"]
        self.substrings: bool = told.get("substrings", False)
        self.reads = Reads()

    # ---- versions

    @classmethod
    def create(cls, chunks: DataFrame, at: str, key: str = "chunk_id", part_rows: int = PART_ROWS) -> SegmentIndex:
        """A new index of all chunks; every column of theirs is kept and comes with the hits."""
        told = {"key": key, "columns": chunks.columns, "schema": chunks.schema.jsonValue(), "part_rows": part_rows, "segments": [write_segment(chunks, key, at, part_rows)]}
        return cls(chunks.sparkSession, at, manifest.commit(chunks.sparkSession, at, 0, told), told)

    @classmethod
    def load(cls, spark: SparkSession, at: str, version: int | None = None) -> SegmentIndex:
        number, told = manifest.read(spark, at, version)
        if not number:
            raise ValueError(f"no index in {at}")
        return cls(spark, at, number, told)

    def _segment(self, chunks: DataFrame) -> dict:
        return write_segment(chunks.select(*self.columns), self.key, self.at, self.part_rows, self.substrings)

    def _next(self, segments: list[dict], **more) -> SegmentIndex:
        told = self.told | {"segments": segments} | more
        return SegmentIndex(self.spark, self.at, manifest.commit(self.spark, self.at, self.version, told), told)

    def add(self, chunks: DataFrame) -> SegmentIndex:
        """With new chunks, whose keys the index doesn't have."""
        return self._next(self._merged([*self.segments, self._segment(chunks)]))

    def delete(self, keys: DataFrame) -> SegmentIndex:
        """Without the chunks of these keys; keys that it doesn't have don't matter."""
        return self._next(self._without(keys))

    def change(self, chunks: DataFrame) -> SegmentIndex:
        """With these chunks in place of those with their keys, new ones included."""
        return self._next(self._merged([*self._without(chunks.select(self.key)), self._segment(chunks)]))

    def with_substrings(self) -> SegmentIndex:
        """With what substring() needs; later changes keep it up."""
        if self.substrings:
            return self
        for s in self.segments:
            write_sections(grams_of(self._chunks(s)), f"{self.at}/segments/{s['name']}/grams")
        return self._next(self.segments, substrings=True)

    def _without(self, keys: DataFrame) -> list[dict]:
        wanted = keys.select(F.col(self.key).alias("key")).distinct()
        out = []
        for s in self.segments:
            to = f"{self.at}/segments/{s['name']}/gone/{uuid.uuid4().hex}"
            if not s["n"]:
                out.append(s)
                continue
            found = self._alive(self.spark.read.parquet(f"{self.at}/segments/{s['name']}/keys").join(wanted, "key"), s).select(PLACE)
            found.write.parquet(f"{to}/places")
            places = self.spark.read.schema(f"{PLACE} bigint").parquet(f"{to}/places")
            n = places.count()
            if not n:
                out.append(s)
                continue
            lost = occurrences(self._chunks(s).join(places, PLACE, "left_semi"))
            lost.groupBy("term", PLACE).agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf")).write.parquet(f"{to}/terms")
            tokens = self.spark.read.schema("term string, n bigint, tf bigint").parquet(f"{to}/terms").agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
            out.append(s | {"gone": [*s["gone"], {"at": to, "n": n, "tokens": tokens}]})
        return out

    def _merged(self, segments: list[dict]) -> list[dict]:
        """The segments, those of a tier made one if there are as many as MERGE; tiers are powers of MERGE."""
        tiers: dict[int, list[dict]] = {}
        for s in segments:
            alive, tier = s["n"] - sum(g["n"] for g in s["gone"]), 0
            while alive >= MERGE ** (tier + 1) * self.part_rows // 16:
                tier += 1
            tiers.setdefault(tier, []).append(s)
        out = []
        for full in tiers.values():
            if len(full) < MERGE:
                out += full
                continue
            rows = reduce(DataFrame.unionByName, [self._alive(self._chunks(s), s).select(*self.columns) for s in full])
            out.append(self._segment(rows))
        return out

    # ---- tables

    def _chunks(self, segment: dict) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(f"{self.at}/segments/{segment['name']}/chunks")

    def _schema(self) -> StructType:
        return StructType.fromJson(self.told["schema"]).add(PLACE, LongType())

    def _gone(self, segment: dict, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{g['at']}/{name}" for g in segment["gone"]))

    def _alive(self, rows: DataFrame, segment: dict) -> DataFrame:
        return rows.join(self._gone(segment, "places", f"{PLACE} bigint"), PLACE, "left_anti") if segment["gone"] else rows

    def _union(self, make) -> DataFrame | None:
        parts = [make(s).withColumn("segment", F.lit(k)) for k, s in enumerate(self.segments) if s["n"]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def chunks(self) -> DataFrame:
        """All chunks that are there, as they were given."""
        return reduce(DataFrame.unionByName, [self._alive(self._chunks(s), s).select(*self.columns) for s in self.segments])

    def keys(self) -> DataFrame:
        """segment, place and key of all chunks that are there."""
        return self._union(lambda s: self._alive(self.spark.read.parquet(f"{self.at}/segments/{s['name']}/keys"), s))

    def blocks(self, terms: list[str] | None = None, heads: bool = False) -> DataFrame | None:
        """segment and the blocks, of these terms if given; heads: without their arrays."""

        def of(s: dict) -> DataFrame:
            rows = self.spark.read.schema(BLOCKS).parquet(f"{self.at}/segments/{s['name']}/blocks")
            rows = rows if terms is None else rows.where(F.col("term").isin(terms))
            return rows.select("term", "range", "n", "tf", "most", "least") if heads else rows

        return self._union(of)

    @property
    def n(self) -> int:
        return sum(s["n"] - sum(g["n"] for g in s["gone"]) for s in self.segments)

    @property
    def tokens(self) -> int:
        return sum(s["tokens"] - sum(g["tokens"] for g in s["gone"]) for s in self.segments)

    def term_stats(self, terms: list[str] | None = None) -> DataFrame:
        """term, df (chunks that have it) and cf (how often it comes), less what is gone."""
        rows = self.blocks(terms, heads=True)
        if rows is None:
            return self.spark.createDataFrame([], "term string, df bigint, cf bigint")
        rows = rows.select("term", F.col("n").cast("bigint").alias("n"), "tf")
        for s in self.segments:
            if s["gone"]:
                lost = self._gone(s, "terms", "term string, n bigint, tf bigint")
                rows = rows.unionByName((lost if terms is None else lost.where(F.col("term").isin(terms))).select("term", (-F.col("n")).alias("n"), (-F.col("tf")).alias("tf")))
        return rows.groupBy("term").agg(F.sum("n").alias("df"), F.sum("tf").alias("cf")).where("df > 0")

    def postings(self, blocks: DataFrame | None = None) -> DataFrame:
        """segment, place, length, term, f and spots of every posting in the blocks that isn't gone."""
        rows = self.blocks() if blocks is None else blocks
        rows = rows.select("segment", "term", F.inline(F.arrays_zip("ords", "lens", "fs", "spots")).alias(PLACE, LENGTH, "f", "spots"))
        for k, s in enumerate(self.segments):
            if s["gone"]:
                gone = self._gone(s, "places", f"{PLACE} bigint").withColumn("segment", F.lit(k))
                rows = rows.join(gone, ["segment", PLACE], "left_anti")
        return rows

    def keyed_postings(self) -> DataFrame:
        """key, length, term, f and spots of every posting of the chunks that are there. Keys come to the blocks, those of a range at once, so that blocks are shuffled and postings aren't."""
        last = (1 << RANGE_BITS) - 1
        keys = self.keys().groupBy("segment", F.shiftright(PLACE, RANGE_BITS).alias("range")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(PLACE).bitwiseAND(F.lit(last)).cast("int").alias("i"), "key"))).alias("held"))
        keys = keys.select("segment", "range", F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.try_element_at("held", i)).alias("held"))
        named = F.transform("ords", lambda o: F.get("held", o.bitwiseAND(F.lit(last)).cast("int")))
        rows = self.blocks().join(keys, ["segment", "range"]).withColumn("named", named)
        return rows.select("term", F.inline(F.arrays_zip("named", "lens", "fs", "spots")).alias("key", LENGTH, "f", "spots")).where("key is not null")

    # ---- search

    def idf(self, df: Column) -> Column:
        idf = F.ln((F.lit(float(self.n)) - df + 0.5) / (df + 0.5))
        return F.when(idf > 0, idf).otherwise(fts.LEAST_IDF)

    def impact(self, f: Column, length: Column) -> Column:
        average = self.tokens / self.n if self.n and self.tokens else 1.0
        return f * (fts.K1 + 1) / (f + F.lit(fts.K1 * (1 - fts.B)) + length * F.lit(fts.K1 * fts.B / average))

    def scored(self, blocks: DataFrame, node, df: dict[str, int]) -> DataFrame:
        """segment, place and score of the matching chunks in these blocks. df: of single terms; phrases are counted in the blocks."""
        found = fts.leaves(node)
        rows = self.postings(blocks)
        whole = rows.groupBy("segment", PLACE, LENGTH)
        if _plain(node):
            terms = sorted({p.terms[0] for p in found})
            table = whole.agg(*(F.sum(F.when(F.col("term") == t, F.col("f"))).alias(f"f{i}") for i, t in enumerate(terms)))
            of = [F.coalesce(F.col(f"f{terms.index(p.terms[0])}"), F.lit(0)) for p in found]
            match, counts, has = _tree(node, iter(of)), of, None
        else:
            terms = sorted({t for p in found for t in p.terms})
            table = whole.agg(*(F.first(F.when(F.col("term") == t, F.col("spots")), ignorenulls=True).alias(f"s{i}") for i, t in enumerate(terms)))

            def spots(t: str, n: int) -> Column:
                mine = F.coalesce(F.col(f"s{terms.index(t)}"), F.array().cast("array<int>"))
                return F.transform(F.filter(mine, lambda x: F.shiftright(x, FIELD_BIT) == n), lambda x: x.bitwiseAND(F.lit((1 << FIELD_BIT) - 1)))

            table = table.select("segment", PLACE, LENGTH, *(fts.starts(p, lambda t, n=n: spots(t, n)).alias(f"o{k}_{f}") for k, p in enumerate(found) for n, f in enumerate(fts.FIELDS)))
            match, counts = fts._evaluate(node, [0])
            has = [reduce(lambda a, b: a | b, [F.size(f"o{k}_{f}") > 0 for f in fts.FIELDS]) for k in range(len(found))]
        many = [k for k, p in enumerate(found) if len(p.terms) != 1]
        held = table.agg(F.struct(*(F.count_if(has[k]).alias(f"d{k}") for k in many)).alias("d")).scalar() if many else F.lit(None)
        table = table.select("segment", PLACE, LENGTH, match.alias("__match"), held.alias("__d"), *(c.cast("double").alias(f"__f{k}") for k, c in enumerate(counts)))
        score = F.lit(0.0)
        for k, p in enumerate(found):
            frequency = F.col(f"__d.d{k}").cast("double") if k in many else F.lit(float(df.get(p.terms[0], 0)))
            score = score + self.idf(frequency) * self.impact(F.col(f"__f{k}"), F.col(LENGTH))
        return table.where("__match").select("segment", PLACE, score.alias(SCORE))

    def _ranges(self, heads: DataFrame, node, df: dict[str, int]) -> DataFrame:
        """segment, range, blocks and bound of the ranges that may hold a match, or what a phrase's count needs. bound: the most that a chunk can score."""
        terms = sorted(df)
        impact = self.idf(F.col("df")) * self.impact(F.col("most").cast("double"), F.col("least").cast("double"))
        of = F.create_map(*(F.lit(x) for t in terms for x in (t, float(df[t]))))[F.col("term")]
        told = heads.withColumn("df", of).select("segment", "range", "term", impact.alias("bound"))
        has = [F.max(F.when(F.col("term") == t, True)).alias(f"h{i}") for i, t in enumerate(terms)]
        bounds = [F.max(F.when(F.col("term") == t, F.col("bound"))).alias(f"b{i}") for i, t in enumerate(terms)]
        table = told.groupBy("segment", "range").agg(F.count(F.lit(1)).alias("blocks"), *has, *bounds)
        own = lambda t, c: F.coalesce(F.col(f"{c}{terms.index(t)}"), F.lit(False if c == "h" else 0.0)) if t in df else F.lit(False if c == "h" else 0.0)
        found = fts.leaves(node)
        complete = [reduce(lambda a, b: a & b, [own(t, "h") for t in p.terms]) if p.terms else F.lit(False) for p in found]
        may = _tree(node, iter(complete))
        for p, c in zip(found, complete, strict=True):
            may = may | c if len(p.terms) > 1 else may
        bound = reduce(lambda a, b: a + b, [reduce(F.least, [own(t, "b") for t in p.terms]) if len(p.terms) > 1 else own(p.terms[0], "b") if p.terms else F.lit(0.0) for p in found])
        return table.where(may).select("segment", "range", "blocks", bound.alias("bound"))

    def _picked(self, ranges: list[tuple[int, int]], blocks: DataFrame) -> DataFrame:
        """The blocks of a few ranges, named in the scan."""
        by: dict[int, list[int]] = {}
        for segment, n in ranges:
            by.setdefault(segment, []).append(n)
        return blocks.where(reduce(lambda a, b: a | b, [(F.col("segment") == s) & F.col("range").isin(own) for s, own in by.items()], F.lit(False)))

    def top(self, node, limit: int, where: Column | None = None, allowed: DataFrame | None = None) -> list[tuple[int, int, float]]:
        """(segment, place, score) of the best `limit` chunks and of those that tie with the last. where: a condition on the chunks' columns; allowed: the keys that may be found."""
        self.reads = Reads(blocks_in_index=sum(s["blocks"] for s in self.segments), files_in_index=sum(s["files"] for s in self.segments))
        terms = sorted({t for p in fts.leaves(node) for t in p.terms})
        blocks = self.blocks(terms) if terms and limit > 0 else None
        if blocks is None:
            return []
        df = {r["term"]: r["df"] for r in self.term_stats(terms).collect()}  # a row for each term
        if not df:
            return []
        ranges = self._ranges(self.blocks(sorted(df), heads=True), node, df)
        promising = ranges.orderBy(F.desc("bound"), "segment", "range").limit(NAMED + 1).collect()
        chosen = promising
        # phrases are counted over all their chunks; of single terms the best ranges tell which others can matter
        if all(len(p.terms) == 1 for p in fts.leaves(node)) and len(promising) > SEEDS:
            first = [(r["segment"], r["range"]) for r in promising[: max(SEEDS, -(-limit // (1 << RANGE_BITS - 3)))]]
            seen = self.passing(self.scored(self._picked(first, blocks), node, df), where, allowed).orderBy(F.desc(SCORE)).limit(limit).agg(F.count(F.lit(1)).alias("n"), F.min(SCORE).alias("least")).first()
            if seen["n"] == limit:
                least = seen["least"] * (1 - 1e-9)
                chosen = [r for r in promising if r["bound"] >= least]
                ranges = ranges.where(F.col("bound") >= F.lit(least))
        if len(chosen) > NAMED:
            picked = blocks.join(ranges.select("segment", "range"), ["segment", "range"], "left_semi")
            self.reads.blocks = ranges.agg(F.sum("blocks")).first()[0]
        else:
            picked = self._picked([(r["segment"], r["range"]) for r in chosen], blocks)
            self.reads.blocks = sum(r["blocks"] for r in chosen)
        hits = self.passing(self.scored(picked, node, df), where, allowed)
        best = hits.orderBy(F.desc(SCORE)).limit(2 * limit).collect()
        if len(best) > limit and best[-1][SCORE] == best[limit - 1][SCORE] and len(best) == 2 * limit:  # more ties than that: by key
            best = hits.where(F.col(SCORE) >= F.lit(best[-1][SCORE])).join(self.keys(), ["segment", PLACE]).orderBy(F.desc(SCORE), "key").limit(limit).collect()
        return [(r["segment"], r[PLACE], r[SCORE]) for r in best if r[SCORE] >= best[min(limit, len(best)) - 1][SCORE]]

    def passing(self, hits: DataFrame, where: Column | None, allowed: DataFrame | None) -> DataFrame:
        """The hits whose chunks meet a condition on their columns, and whose keys may be found."""
        if where is None and allowed is None:
            return hits
        told = self._union(self._chunks)
        told = told if where is None else told.where(where)
        out = hits.join(told.select("segment", PLACE, F.col(self.key).alias("__key")), ["segment", PLACE])
        out = out if allowed is None else out.join(allowed.select(F.col(self.key).alias("__key")), "__key", "left_semi")
        return out.select(*hits.columns)

    def fetch(self, rows: list[tuple[int, int, float | None]]) -> DataFrame:
        """The chunks at these places, with their scores: of each segment only the files whose ranges hold one are read, and of those the pages."""
        out = self.spark.createDataFrame([], StructType.fromJson(self.told["schema"]).add(SCORE, DoubleType()))
        for k, s in enumerate(self.segments):
            own = {place: score for segment, place, score in rows if segment == k}
            if not own:
                continue
            some = reduce(lambda a, b: a | b, [(F.col("first") <= p) & (F.col("last") >= p) for p in own])
            files = [r["file"] for r in self.spark.read.parquet(f"{self.at}/segments/{s['name']}/files").where(some).select("file").collect()]  # as many as hits at most
            self.reads.files += len(files)
            found = self.spark.read.schema(self._schema()).parquet(*files).where(F.col(PLACE).isin(list(own)))
            score = F.create_map(*(F.lit(x) for pair in own.items() for x in pair))[F.col(PLACE)]
            out = out.unionByName(found.select(*self.columns, score.cast("double").alias(SCORE)))
        return out

    def joined(self, found: DataFrame) -> DataFrame:
        """A table with segment and place, with the columns of those chunks: of all files those are read in whose ranges one lies."""
        out = None
        for k, s in enumerate(self.segments):
            own = found.where(F.col("segment") == k)
            # a file holds what one task has written, so its places have the task's number above bit 33
            files = self.spark.read.parquet(f"{self.at}/segments/{s['name']}/files").withColumn("part", F.shiftright("first", 33))
            files = [r["file"] for r in files.join(own.select(F.shiftright(PLACE, 33).alias("part")).distinct(), "part").select("file").collect()]
            if files:
                part = own.join(self.spark.read.schema(self._schema()).parquet(*files), PLACE)
                out = part if out is None else out.unionByName(part)
        if out is None:
            kinds = {f.name: f.dataType for f in self._schema()}
            out = found.limit(0).select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in self.columns))
        return out.drop("segment", PLACE)

    def named(self, keys: list) -> DataFrame:
        """The chunks with a few keys; their places come from the table that is in the order of keys."""
        rows = self.keys().where(F.col("key").isin(keys)).collect() if keys and self.n else []
        return self.fetch([(r["segment"], r[PLACE], None) for r in rows]).drop(SCORE)

    def search(self, node, limit: int, where: Column | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """The best chunks by BM25, all their columns and the score, best first."""
        return self.fetch(self.top(node, limit, where, allowed)).orderBy(F.desc(SCORE), self.key).limit(limit)


    def candidates(self, words: tuple[str, ...]) -> DataFrame | None:
        """segment, range and bits of the chunks that have all threes of the words; None if no word has three characters."""
        asked = sorted(set().union(*(grams(w.lower()) for w in words)) if words else ())
        if not asked or not self.substrings:
            return None
        rows = self._union(lambda s: self.spark.read.schema(GRAMS).parquet(f"{self.at}/segments/{s['name']}/grams").where(F.col("gram").isin(asked)))
        if rows is None:
            return None
        rows = rows.repartition("segment", "range").groupBy("segment", "range", "gram").agg(F.bit_or("bits").alias("bits"))
        return rows.groupBy("segment", "range").agg(F.count(F.lit(1)).alias("n"), F.bit_and("bits").alias("bits")).where((F.col("n") == len(asked)) & (F.col("bits") != 0)).drop("n")

    def substring(self, words: tuple[str, ...], limit: int, where: Column | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """What fts.like() gives of the index's chunks, but that only candidates are looked through. Words under three characters alone, or an index without with_substrings(), mean all chunks."""
        self.reads = Reads(blocks_in_index=sum(s["blocks"] for s in self.segments), files_in_index=sum(s["files"] for s in self.segments))
        found = self.candidates(words)
        if found is None:
            rows = self.chunks()
        else:
            found = written(found, "candidates")
            self.reads.candidates = found.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).first()[0]
            one = F.filter(F.sequence(F.lit(0), F.lit((1 << RANGE_BITS) - 1)), lambda i: F.getbit("bits", i) == 1)
            places = found.select("segment", F.explode(one).alias("i"), "range").select("segment", (F.shiftleft("range", RANGE_BITS) + F.col("i")).alias(PLACE))
            for k, s in enumerate(self.segments):
                if s["gone"]:
                    places = places.join(self._gone(s, "places", f"{PLACE} bigint").withColumn("segment", F.lit(k)), ["segment", PLACE], "left_anti")
            rows = self.joined(places)
        if allowed is not None:
            rows = rows.join(allowed.select(self.key), self.key, "left_semi")
        return fts.like(rows, words, limit, where, self.key)


def _plain(node) -> bool:
    """Whether only frequencies matter: single terms joined by AND and OR."""
    if isinstance(node, fts.Phrase):
        return len(node.terms) == 1
    return not isinstance(node, fts.Near) and all(_plain(p) for p in node.parts)


def _tree(node, has) -> Column:
    """Whether a row matches, from what each phrase has (a number or a truth), in order."""
    if isinstance(node, fts.Phrase):
        return next(has).cast("boolean")
    every = not isinstance(node, fts.Some)
    parts = [_tree(p, has) for p in (node.phrases if isinstance(node, fts.Near) else node.parts)]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), parts)
