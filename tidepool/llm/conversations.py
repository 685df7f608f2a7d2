"""Conversation structure repair by error-correcting Earley parsing.

A conversation may be: at most one system turn, then user and assistant turns in pairs, or
nothing. A row that isn't in place is deleted or gets another role, a missing turn is
inserted; the cheapest edits are looked for, and of equally cheap ones those whose initials
(audit) are least. Rows that are blank, or repeat an earlier row's role and text, must go.

The grammar is weighted, with productions for errors (Aho and Peterson 1972): wherever a
role is expected, a row may be kept (if its role's initial is the one expected), rerole'd or
deleted, and a role inserted. A chart column holds the Earley items after so many rows, each with
the least (cost, audit) that leads to it. The grammar is left-linear, so every item that
waits for a role began in the first column and a row's column follows from the one before.
Two equally cheap ways over the same rows never begin one with the other (what is longer has
more insertions, and costs more), so the least audit of a whole is made of least audits of its parts.

Rows are put in order by one range sort over conversations and turns, and each conversation
is cut into chunks of CHUNK rows by their places in that order. A chunk is parsed by itself, from
every item that may wait at its start; the chunks of one conversation, however long, are parsed
in parallel, and one step puts their (item, item) charts together, with a few numbers for each
chunk. Only roles' initials and faults reach the parser; texts are joined to the
edits afterwards, by place. Rows that are equal in everything are one row with a number.

Faults, the first that holds: blank (no visible character; ASCII white space is what doesn't
count), duplicate (role and text seen earlier in the conversation), truncated (the last
visible character isn't one of .!?).

Defined results: nulls in role or text are one space; rows go by turn, null first, then by
role and text; a null conversation is one of its own; a role without characters is none that
the grammar knows; columns other than these four don't matter; an empty table gives no rows.
Repeated texts are told by two 64-bit hashes: of n rows of one conversation two are taken for equal by
chance with probability n^2 / 2^129.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.shared import bounded_batches, prefilter, scratch, spread_join, tidied

#: What a conversation may be; terminals are role initials, END stands for its end.
END = "$"
RULES = (("Chat", ("Turns", END)), ("Chat", (END,)), ("Turns", ("Turns", "u", "a")), ("Turns", ("Head", "u", "a")), ("Head", ("s",)), ("Head", ()))
TERMINALS, ROLES = frozenset("sua" + END), {"u": "user", "a": "assistant"}
#: Costs of edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a chunk, as a power of two.
CHUNK_BITS = 10
#: ASCII white space, and what may follow a role's initial.
WHITE, FOLLOWS = " \t\n\x0b\x0c\r", ("su", "ua", "au")
SEPARATOR = "\n"

Item = tuple[int, int]  # rule and place of the dot
Best = tuple[int, str]  # cost and audit
Kind = tuple[str, bool, bool]  # role initial, whether the row must go, whether it is truncated


def awaited(item: Item) -> str:
    """The symbol behind the dot, "" at the end of the rule."""
    rule, dot = item
    body = RULES[rule][1]
    return body[dot] if dot < len(body) else ""


def completed(column: dict[Item, Best]) -> dict[Item, Best]:
    """A column with what completion and insertion reach in it, cheapest first."""
    heap = [(best, item) for item, best in column.items()]
    heapq.heapify(heap)
    out: dict[Item, Best] = {}
    while heap:
        best, item = heapq.heappop(heap)
        if item in out:
            continue
        out[item] = best
        symbol, (rule, dot) = awaited(item), item
        if symbol in ROLES:
            heapq.heappush(heap, ((best[0] + INSERT, best[1] + "I"), (rule, dot + 1)))
        elif not symbol:  # advances what waited for it in the first column
            for k, (_, body) in enumerate(RULES):
                if body[:1] == (RULES[rule][0],):
                    heapq.heappush(heap, (best, (k, 1)))
    return {item: best for item, best in out.items() if awaited(item) in TERMINALS}


#: The first column: all rules are predicted. Items that wait for a role or the end are all that later columns need.
FIRST = completed({(k, 0): (0, "") for k in range(len(RULES))})
FRONT = tuple((k, i) for k, (_, body) in enumerate(RULES) for i, symbol in enumerate(body) if symbol in TERMINALS)


@functools.cache
def moves(kind: Kind) -> dict[Item, list[tuple[Item, int, str]]]:
    """Where a row of this kind leads each waiting item, with all that may be inserted behind it: item, cost, letters."""
    initial, gone, truncated = kind
    out = {}
    for item in FRONT:
        to: dict[Item, Best] = {item: (DELETE, "D")}
        symbol, on = awaited(item), (item[0], item[1] + 1)
        if not gone and symbol != END:
            if symbol == initial:
                to[on] = (TRUNCATED * truncated, "K")
            elif symbol in ROLES:
                to[on] = (REROLE + TRUNCATED * truncated, "R")
        out[item] = [(i, cost, letters) for i, (cost, letters) in completed(to).items()]
    return out


def read(column: dict[Item, Best], kind: Kind, times: int = 1) -> dict[Item, Best]:
    """The column after a row that comes so many times in turn; all but the first of them are duplicates."""
    out: dict[Item, Best] = {}
    of = moves(kind)
    for item, (cost, audit) in column.items():
        for to, more, letters in of[item]:
            new = (cost + more, audit + letters)
            if to not in out or new < out[to]:
                out[to] = new
    if times > 1:
        out = completed({item: (cost + DELETE * (times - 1), audit + "D" * (times - 1)) for item, (cost, audit) in out.items()})
    return out


def parsed(column: dict[Item, Best], rows: list[tuple[Kind, int]]) -> dict[Item, Best]:
    for kind, times in rows:
        column = read(column, kind, times)
    return column


def accepted(column: dict[Item, Best]) -> tuple[Best, Item]:
    """The cheapest end."""
    return min((best, item) for item, best in column.items() if awaited(item) == END)


def applied(audit: str, rows: list[tuple[Kind, int]], expects: str) -> list[str]:
    """What each row becomes: k (kept), U or A (rerole'd), and u, a for turns inserted before or (the last row's) behind it."""
    out, edits = [], iter(audit)
    letter = next(edits, None)

    def inserted() -> str:
        nonlocal letter, expects
        made = ""
        while letter == "I":
            made += expects
            expects = "a" if expects == "u" else "u"
            letter = next(edits, None)
        return made

    for (initial, _, _), times in rows:
        own = inserted()
        if letter == "K":
            own, expects = own + "k", "a" if initial == "u" else "u"
        elif letter == "R":
            own, expects = own + expects.upper(), "a" if expects == "u" else "u"
        for _ in range(times):
            letter = next(edits, None)
        out.append(own)
    if out:
        out[-1] += inserted()
    return out


def start_of(item: Item | None) -> str:
    """The role that an item waits for next; of the first column a user's."""
    return "a" if item is not None and awaited(item) == "a" else "u"


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text and times of the different rows, with their places in the order of conversations and their faults, in the shared folder."""
    plain = rows.select(rows[conv].alias("conv"), rows[turn].alias("turn"), F.coalesce(rows[role], F.lit(" ")).alias("role"), F.coalesce(rows[text], F.lit(" ")).alias("text"))
    different = plain.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    sort = different.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    visible = F.rtrim(F.col("text"), F.lit(WHITE))
    last = F.substring(visible, -1, 1)
    told = sort.select("*", F.monotonically_increasing_id().alias("place"), (visible == "").alias("blank"), (~last.isin(*".!?")).alias("open"), F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit("twice"), "text", "role").alias("d2"))
    return scratch(told.select("*", F.struct("conv", "d1", "d2").alias("same")).drop("d1", "d2"), "ordered")


def repeated(rows: DataFrame) -> DataFrame:
    """The places of rows whose role and text an earlier turn of their conversation has."""
    firsts = rows.where("not blank").groupBy("same").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = scratch(firsts, "repeated")
    some = prefilter(rows.select("same", "turn", "place"), "same", firsts)
    return spread_join(some, firsts, "same", "n", rows.count()).where(F.struct("turn") > F.col("first")).select("place")


def chunked(rows: DataFrame) -> DataFrame:
    """conv, chunk, n and the rows of each chunk in order: place, initial, gone, open, times. No texts."""
    again = repeated(rows).withColumn("again", F.lit(True))
    few = rows.select("conv", "place", initial(F.col("role")).alias("initial"), "blank", "open", "times").join(again, "place", "left")
    few = few.withColumn("again", F.coalesce("again", F.lit(False)) & ~F.col("blank"))
    one = F.struct("place", "initial", "blank", "again", "open", "times")
    return few.groupBy("conv", F.shiftright("place", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list(one)).alias("rows"))


def kinds(rows: list[dict]) -> list[tuple[Kind, int]]:
    return [((r["initial"], r["blank"] or r["again"], r["open"]), r["times"]) for r in rows]


def faults(parts: DataFrame) -> DataFrame:
    """conv, blank, duplicate, truncated and illegal of each conversation."""
    follows = F.array(*map(F.lit, FOLLOWS))
    r = F.col("rows")

    def total(of) -> Column:
        return F.aggregate(r, F.lit(0).cast("bigint"), lambda s, x: s + of(x))

    pairs = F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda x, y: F.when(F.array_contains(follows, F.concat(x["initial"], y["initial"])), 0).otherwise(1))
    told = parts.select(
        "conv",
        "chunk",
        total(lambda x: F.when(x["blank"], x["times"]).otherwise(0)).alias("blank"),
        total(lambda x: F.when(x["blank"], 0).otherwise(x["times"] - F.when(x["again"], 0).otherwise(1))).alias("duplicate"),
        total(lambda x: F.when(~x["blank"] & ~x["again"] & x["open"], 1).otherwise(0)).alias("truncated"),
        (total(lambda x: x["times"] - 1) + F.when(F.size(r) > 1, F.aggregate(pairs, F.lit(0), lambda s, x: s + x)).otherwise(0)).alias("illegal"),
        r[0]["initial"].alias("first"),
        F.element_at(r, -1)["initial"].alias("last"),
    )
    before = F.lag("last").over(Window.partitionBy("conv").orderBy("chunk"))  # a row for each chunk
    told = told.withColumn("before", before)
    across = F.when(F.col("before").isNotNull() & ~F.array_contains(follows, F.concat("before", "first")), 1).otherwise(0)
    return told.groupBy("conv").agg(F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"), F.sum(F.col("illegal") + across).alias("illegal"))


def gaps(rows: DataFrame) -> DataFrame:
    """conv and the turns that are missing between its first and last."""
    turns = rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv")
    return turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))


def charts(parts: DataFrame) -> DataFrame:
    """conv, chunk, and from, to, cost and audit of every way through the chunk."""

    @F.pandas_udf("array<struct<from:int, to:int, cost:bigint, audit:string>>")
    def ways(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: [(i, FRONT.index(to), cost, audit) for i, item in enumerate(FRONT) for to, (cost, audit) in parsed({item: (0, "")}, kinds(x)).items()])

    return parts.select("conv", "chunk", F.explode(ways("rows")).alias("w")).select("conv", "chunk", "w.from", "w.to", "w.cost", "w.audit")


def through(ways: DataFrame, kind: str) -> DataFrame:
    """conv, chunk, from, to and lead (what is inserted before the first chunk): the cheapest way through all chunks of each conversation.

    Rows come by conversation and chunk. Of the ways so far only what follows their common
    beginning is held, and for each chunk which item led to which.
    """

    def way(rows: Iterator[tuple]) -> Iterator[tuple]:
        best = {FRONT.index(item): x for item, x in FIRST.items()}
        lead = {k: audit for k, (_, audit) in best.items()}
        back: list[tuple[int, dict[int, int]]] = []
        for chunk, told in itertools.groupby(rows, key=lambda r: r[0]):
            new: dict[int, tuple[int, str]] = {}
            by: dict[int, int] = {}
            for _, a, b, cost, audit in told:
                if a in best:
                    x = (best[a][0] + cost, best[a][1] + audit)
                    if b not in new or x < new[b]:
                        new[b], by[b] = x, a
            shared = len(os.path.commonprefix([audit for _, audit in new.values()]))
            best = {k: (cost, audit[shared:]) for k, (cost, audit) in new.items()}
            back.append((chunk, by))
        _, item = accepted({FRONT[k]: x for k, x in best.items()})
        to = FRONT.index(item)
        for n in range(len(back) - 1, -1, -1):
            chunk, by = back[n]
            yield chunk, by[to], to, lead[by[to]] if n == 0 else None
            to = by[to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch.column(0)[i], r) for batch in batches for i, r in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True)))
        for conv, own in itertools.groupby(rows, key=lambda x: x[0]):
            found = list(way(r for _, r in own))
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()] * len(found), conv.type), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], ["conv", "chunk", "from", "to", "lead"])

    return ways.select("conv", "chunk", "from", "to", "cost", "audit").repartition("conv").sortWithinPartitions("conv", "chunk", "from", "to").mapInArrow(run, f"conv {kind}, chunk bigint, from int, to int, lead string")


def edits(parts: DataFrame, kind: str) -> DataFrame:
    """conv, chunk, cost, audit, and `becomes`: place and what its row becomes, of every chunk."""
    numbers = parts.groupBy("conv").agg(F.count(F.lit(1)).alias("chunks"))
    of = parts.join(numbers.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    of = scratch(of, "chunks")

    @F.pandas_udf("cost bigint, audit string, becomes array<struct<place:bigint, what:string>>")
    def alone(rows: pd.Series) -> pd.DataFrame:
        out = []
        for x in rows:
            (cost, audit), _ = accepted(parsed(FIRST, kinds(x)))
            out.append((cost, audit, list(zip([r["place"] for r in x], applied(audit, kinds(x), "u"), strict=True))))
        return pd.DataFrame(out, columns=["cost", "audit", "becomes"])

    @F.pandas_udf("array<struct<place:bigint, what:string>>")
    def along(rows: pd.Series, audit: pd.Series, item: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([list(zip([r["place"] for r in x], applied(a, kinds(x), "u" if f else start_of(FRONT[i])), strict=True)) for x, a, i, f in zip(rows, audit, item, first, strict=True)])

    single = of.where("chunks = 1").select("conv", "chunk", alone("rows").alias("e")).select("conv", "chunk", "e.cost", "e.audit", "e.becomes")
    several = of.where("chunks > 1")
    if several.isEmpty():
        return single
    ways = scratch(charts(several), "ways")
    taken = scratch(through(ways, kind), "taken")
    at = [F.col(f"w.{c}").eqNullSafe(F.col(f"t.{c}")) if c == "conv" else F.col(f"w.{c}") == F.col(f"t.{c}") for c in ("conv", "chunk", "from", "to")]
    lead = F.coalesce("t.lead", F.lit(""))
    chosen = ways.alias("w").join(taken.alias("t"), at).select(F.col("t.conv").alias("c"), F.col("t.chunk").alias("k"), (F.col("w.cost") + INSERT * F.length(lead)).alias("cost"), F.concat(lead, F.col("w.audit")).alias("audit"), F.col("t.from").alias("item"), F.col("t.lead").isNotNull().alias("first"))
    met = several.join(chosen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    return single.unionByName(met.select("conv", "chunk", "cost", "audit", along("rows", "audit", "item", "first").alias("becomes")))


class Repair:
    """The repair of a table of conversations; its tables lie in the shared folder.

    conversations: conv, gaps, blank, duplicate, truncated, illegal, cost and audit; turns():
    the repaired rows; transcripts(): a digest of each repaired conversation.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        bounded_batches(rows.sparkSession)
        self.kind = rows.schema[conv].dataType.simpleString()
        self.rows = ordered(rows, conv, turn, role, text)
        parts = scratch(chunked(self.rows), "parts")
        self.edits = scratch(edits(parts, self.kind), "edits")
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
        costs = self.edits.groupBy("conv").agg(F.sum("cost").alias("cost"), audit.alias("audit"))
        out = costs
        for other in (faults(parts), gaps(self.rows)):
            out = out.join(other.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
        self.conversations = out.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def turns(self) -> DataFrame:
        """conv, place, nth, role and text of the repaired rows, in the order of place and nth."""
        become = self.edits.select(F.explode("becomes").alias("b")).select("b.place", "b.what").where("what <> ''")
        each = self.rows.join(become, "place").select("conv", "place", "role", "text", F.posexplode(F.split("what", "")).alias("nth", "made")).where("made <> ''")
        role = F.when(F.col("made") == "k", F.col("role")).when(F.lower("made") == "u", ROLES["u"]).otherwise(ROLES["a"])
        return each.select("conv", "place", "nth", role.alias("role"), F.when(F.col("made").isin("k", "U", "A"), F.col("text")).otherwise("").alias("text"))

    def transcripts(self) -> DataFrame:
        """conv and the SHA-256 of its repaired rows as role:text, joined by line ends. A row streams through its conversation's one task: a digest goes from front to end."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, digest, kind = None, None, None
            started = False
            for batch in batches:
                kind = batch.schema.field(0).type
                keys, ids, done = batch.column(0).to_pylist(), [], []
                for key, role, text in zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if not started or key != at:
                        if started:
                            ids.append(at)
                            done.append(digest.hexdigest())
                        at, digest, started = key, hashlib.sha256(), True
                    else:
                        digest.update(SEPARATOR.encode())
                    digest.update(f"{role}:{text}".encode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(done, pa.string())], ["conv", "sha256"])
            if started:
                yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([digest.hexdigest()], pa.string())], ["conv", "sha256"])

        return self.turns().repartition("conv").sortWithinPartitions("conv", "place", "nth").select("conv", "role", "text").mapInArrow(tidied(run), f"conv {self.kind}, sha256 string")
