"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidepool.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(v[i], 9) if isinstance(v[i], float) else v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLE_SQL:
        assert got
        return
    r = db.execute(registry.ORACLE_SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, r.fetchall())


def test_stream(spark, tmp_path):
    from tidepool.schema import CHUNKS, DOCUMENTS, EMBEDDINGS
    from tidepool.streaming.ingest import follow_pages

    spark.read.parquet(f"{DIR}/pages.parquet").limit(5).write.parquet(str(tmp_path / "in"))
    tables = {"documents": spark.createDataFrame([], DOCUMENTS), "chunks": spark.createDataFrame([], CHUNKS), "embeddings": spark.createDataFrame([], EMBEDDINGS)}
    seen = []

    def save(out, number):
        seen.append((number, out["documents"].count(), out["report"].first()["pages_ok"]))

    follow_pages(spark, str(tmp_path / "in"), "page_id bigint, url string, html string", "s", lambda: tables, save, str(tmp_path / "ck")).awaitTermination(120)
    assert seen and seen[0][1] == 5
