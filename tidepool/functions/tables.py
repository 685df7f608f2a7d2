"""Table functions for SQL text: the best rows of each part of any table, and where a query's words stand in a text.

    register(spark)
    select * from best_rows(table(hits) partition by query_id order by (score desc, chunk_id), 12)
    select d.id, m.term, m.pos from documents d, lateral word_matches(d.text, 'rotate keys') m

best_rows takes any table and gives its columns and `rank`; the caller's partition by and order by say
what is best, so Spark brings each part to one place in that order and the function stops after k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import SkipRestOfInputTableException, udtf
from pyspark.sql.types import IntegerType, NullType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidepool.operators import fts


@udtf
class BestRows:
    """The first k rows of each part, numbered from 1."""

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("best_rows takes a table and a number")
        if not isinstance(k.value, int) or k.value < 0:
            raise ValueError("the number of rows must be a constant, zero or more")
        if "rank" in {c.lower() for c in table.dataType.fieldNames()}:
            raise ValueError("the table has a column called rank")
        return AnalyzeResult(StructType([*table.dataType.fields, StructField("rank", IntegerType())]))

    def __init__(self):
        self.n = 0

    def eval(self, row: Row, k: int) -> Iterator[tuple]:
        if self.n >= k:
            raise SkipRestOfInputTableException("the rest of the part isn't wanted")
        self.n += 1
        yield (*row, self.n)


@udtf
class WordMatches:
    """term, pos (from 0, in tokens) for every token of a text that is one of the query's, in their order."""

    @staticmethod
    def analyze(text: AnalyzeArgument, query: AnalyzeArgument) -> AnalyzeResult:
        for x in (text, query):
            if not isinstance(x.dataType, (StringType, NullType)):
                raise ValueError("word_matches takes two texts")
        return AnalyzeResult(StructType([StructField("term", StringType()), StructField("pos", IntegerType())]))

    def eval(self, text: str | None, query: str | None) -> Iterator[tuple]:
        wanted = set(fts.tokens_py(query or ""))
        for pos, term in enumerate(fts.tokens_py(text or "") if wanted else ()):
            if term in wanted:
                yield term, pos


def register(spark: SparkSession) -> None:
    spark.udtf.register("best_rows", BestRows)
    spark.udtf.register("word_matches", WordMatches)
