"""SQL text with table functions against the same as DataFrames."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.functions import tables
from tidepool.operators import fts


@pytest.fixture
def hits(spark):
    tables.register(spark)
    rows = [(q, i, (i * 7 + q) % 5 / 10, None if i % 3 else f"Ä{i} alpha-beta naïve Alpha") for q in range(4) for i in range(9)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, score double, text string")
    df.createOrReplaceTempView("hits")
    return df


def test_best_rows(spark, hits):
    for k in (0, 2, 50):
        got = spark.sql(f"select * from best_rows(table(hits) partition by query_id order by (score desc, chunk_id), {k})")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
        want = hits.withColumn("rank", place).where(F.col("rank") <= k)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    one = spark.sql("select chunk_id from best_rows(table(select * from hits where query_id = 1) with single partition order by (chunk_id desc), 1)")
    assert [r.chunk_id for r in one.collect()] == [8]
    assert spark.sql("select * from best_rows(table(select * from hits where false) partition by (query_id), 3)").collect() == []
    with pytest.raises(AnalysisException, match="zero or more"):
        spark.sql("select * from best_rows(table(hits) partition by (query_id), -1)")


def test_word_matches(spark, hits):
    got = spark.sql("select query_id, chunk_id, m.term, m.pos from hits h, lateral word_matches(h.text, 'ALPHA naive?') m")
    spots = hits.select("query_id", "chunk_id", F.posexplode(fts.tokens(F.col("text"))).alias("pos", "term")).where(F.col("term").isin("alpha", "naive"))
    assert sorted(map(tuple, got.collect())) == sorted((r.query_id, r.chunk_id, r.term, r.pos) for r in spots.collect()) and got.count() == 4 * 3 * 3
    assert spark.sql("select m.* from hits h, lateral word_matches(h.text, null) m").collect() == []
    with pytest.raises(AnalysisException, match="two texts"):
        spark.sql("select * from word_matches(1, 'a')")
