"""Stored tables in buckets against the plans over whole tables; what a change writes; crashes and writers at once."""

import os

import pytest
from pyspark.sql import functions as F

from tidepool.operators import manifest, store
from tidepool.operators.snapshots import Snapshots, pruned

DOCS = "id string, source_id string, uri string, title string, content_hash string, status string"


def documents(spark, ids, **more):
    df = spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("n"))
    n = F.col("n").cast("string")
    cols = {"id": F.concat(F.lit("d"), n), "source_id": F.concat(F.lit("s"), (F.col("n") % 3).cast("string")), "uri": F.concat(F.lit("u"), n), "title": F.concat(F.lit("T"), n), "content_hash": n, "status": F.lit("ok")}
    return df.select(*((more.get(c, v)).cast("string").alias(c) for c, v in cols.items()))


def chunks_of(docs):
    each = docs.select("id", "title", F.explode(F.array(*map(F.lit, "012"))).alias("n"))
    return each.select(F.concat_ws(":", "id", "n").alias("id"), F.col("id").alias("document_id"), F.col("title").alias("text"))


@pytest.fixture
def made(spark, tmp_path):
    docs = documents(spark, list(range(200)))
    chunks = chunks_of(docs)
    vectors = chunks.select(F.col("id").alias("chunk_id"), F.lit("m").alias("model_id"))
    return Snapshots.create(spark, str(tmp_path), {"documents": (docs, ["source_id", "uri"]), "chunks": (chunks, ["document_id"]), "embeddings": (vectors, ["chunk_id"])}, buckets=16), docs, chunks


def same(a, b):
    return sorted(repr(tuple(r)) for r in a.select(*sorted(a.columns)).collect()) == sorted(repr(tuple(r)) for r in b.select(*sorted(b.columns)).collect())


def test_upsert_rewrites_what_it_touches(spark, made):
    of, docs, _ = made
    assert same(of.table("documents"), docs)
    new = documents(spark, [5, 900], title=F.lit(None), content_hash=F.lit("x"))
    after = of.edit().upsert("documents", new.union(new), ["source_id", "uri"], store.KEEP_DOCUMENT).commit()
    assert same(after.table("documents"), store.upsert_documents(docs, new)) and after.table("documents").where("id = 'd5'").first().title == "T5"
    old, now = of.tables["documents"]["at"], after.tables["documents"]["at"]
    assert sum(now[b] != old.get(b) for b in now) <= 2 and after.tables["chunks"] == of.tables["chunks"]
    assert 0 < after.written < 0.3 * of.written
    assert same(of.table("documents"), docs)  # who has the old version goes on reading it
    assert same(Snapshots.load(spark, of.at).table("documents"), after.table("documents"))
    assert of.edit().upsert("documents", new.limit(0), ["source_id", "uri"]).commit() is of
    with pytest.raises(manifest.Conflict):
        of.edit().upsert("documents", new, ["source_id", "uri"]).commit()


def test_tables_change_together(spark, made):
    of, docs, chunks = made
    keep = docs.where("source_id = 's1' and uri <> 'u4' and uri <> 'u7'")
    want = store.prune(docs, chunks, of.table("embeddings"), "s1", keep)
    after = pruned(of, "s1", keep)
    assert after.version == of.version + 1
    for name, rows in zip(("documents", "chunks", "embeddings"), want, strict=True):
        assert same(after.table(name), rows), name
    assert pruned(after, "s1", keep.limit(0)) is after
    changed = documents(spark, [8], title=F.lit("new"))
    again = after.edit().upsert("documents", changed, ["source_id", "uri"], store.KEEP_DOCUMENT).replace("chunks", chunks_of(changed)).commit()
    assert [r.text for r in again.table("chunks").where("document_id = 'd8'").collect()] == ["new"] * 3 and again.table("chunks").count() == 3 * 198


def test_a_crash_before_the_switch(spark, made, monkeypatch):
    of, docs, _ = made

    def dies(*_):
        raise OSError("gone")

    edit = of.edit().delete("documents", docs.where("id = 'd9'")).delete("chunks", spark.createDataFrame([("d9",)], "document_id string"))
    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", dies)
        with pytest.raises(OSError, match="gone"):
            edit.commit()
    assert Snapshots.load(spark, of.at).table("documents").count() == 200 and os.path.isdir(f"{of.at}/data")
    assert edit.commit().table("documents").count() == 199 and Snapshots.load(spark, of.at).table("chunks").count() == 597


def test_empty_store_and_null_keys(spark, tmp_path):
    of = Snapshots.create(spark, str(tmp_path), {"t": (spark.createDataFrame([], "k string, v int"), ["k"])}, buckets=4)
    assert of.table("t").count() == 0
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3)], "k string, v int")
    after = of.edit().replace("t", rows).commit()
    assert same(after.table("t"), rows)
    assert same(after.edit().delete("t", rows.where("k is null")).commit().table("t"), rows.where("k = 'a'"))
