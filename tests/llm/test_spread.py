"""Joins in parts, filters, and settings give what plain ones do."""

import pytest
from pyspark.sql import functions as F

from tidepool.llm import components, line_dedup, minhash, shared


def hot(spark):
    return spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 7 else id % 500 end as k")


def test_joins_in_parts(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_KEYS", 16)
    rows = hot(spark)
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k < 400")
    want = sorted(map(tuple, rows.join(keyed, "k").select("k", "id", "n", "top").collect()))
    assert sorted(map(tuple, shared.spread_join(rows, keyed, "k", "n", 3000).select("k", "id", "n", "top").collect())) == want
    assert sorted(map(tuple, shared.salted_join(rows, keyed, "k", "id").select("k", "id", "n", "top").collect())) == want
    assert shared.salted_join(rows.limit(0), keyed, "k", "id").count() == 0


def test_operators_with_joins_in_parts(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_KEYS", 4)
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{line}\n{line.replace('w3 ', f'x{i} ')}\nown {i} line {i}") for i in range(60)] + [(100 + i, line) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.line_dedup.text for r in line_dedup.dedup_lines(d).collect()}
    # each variant is one edit from the line that comes first
    assert got == {0: f"{line}\nown 0 line 0"} | {i: f"own {i} line {i}" for i in range(1, 60)} | {100 + i: "" for i in range(40)}
    groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(d).collect()}
    assert all(groups[100 + i] == 100 for i in range(40))
    edges = spark.createDataFrame([(0, i) for i in range(1, 50)] + [(200, 201), (49, 300)], "x bigint, y bigint")
    assert {r.node: r.root for r in components.components(edges).collect()} == {i: 0 for i in [*range(1, 50), 300]} | {201: 200}


def test_filter_misses_no_key(spark):
    rows, wanted = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    told = {r.k: r.hit for r in shared.marked(rows, "k", wanted, "hit").collect()}
    assert len(told) == 5000 and all(told[k] for k in range(0, 5000, 7)) and sum(told.values()) < 760
    assert not any(r.hit for r in shared.marked(rows, "k", wanted.limit(0), "hit").collect())
    assert shared.prefilter(rows, "k", wanted).columns == ["k"]


@pytest.mark.parametrize(("value", "size"), [("10000", 10000), ("-1", -1), ("64m", 64 << 20), ("1GB", 1 << 30), (" 8kb ", 8192)])
def test_sizes(value, size):
    assert shared.size_of(value) == size


def test_batches_are_bounded_and_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, then in (("-1", str(shared.BATCH_ROWS)), ("0", str(shared.BATCH_ROWS)), ("17", "17")):
            spark.conf.set(key, given)
            with shared.restored_batches(spark):
                shared.bounded_batches(spark)
                assert spark.conf.get(key) == then
            assert spark.conf.get(key) == given
    finally:
        spark.conf.set(key, before)


def test_scratch_is_released(spark):
    import os

    shared.release_scratch(spark)
    a, b = (shared.scratch(spark.range(n), "x") for n in (3, 4))
    old, new = shared.scratch_tables(spark)
    shared.release_scratch(spark, newest=1)
    assert shared.scratch_tables(spark) == [new] and b.count() == 4 and a is not None
    assert not os.path.exists(old.removeprefix("file:")) and os.path.exists(new.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())
