"""The kept index against the plan over the same chunks, as it grows, changes and shrinks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import fts, manifest, segments
from tidepool.operators.segments import SegmentIndex

WORDS = [f"w{i}" for i in range(40)] + ["naïve", "the", "the"]


def rows(r, ids):
    return [(i, " ".join(r.choice(WORDS[: 1 + int(len(WORDS) * r.random() ** 2)]) for _ in range(r.randint(0, 60))) or None, r.choice(WORDS), f"s{i % 3}") for i in ids]


def frame(spark, some):
    return spark.createDataFrame(some, "chunk_id long, text string, title string, source_id string")


NODES = [
    fts.phrase("w3"),
    fts.Some((fts.phrase("w1"), fts.phrase("w30"), fts.phrase("naive"))),
    fts.Every((fts.phrase("w1"), fts.phrase("w2"))),
    fts.phrase("w1 w2"),
    fts.Near((fts.phrase("w1"), fts.phrase("w2 w1")), 5),
    fts.Every((fts.Some((fts.phrase("w1"), fts.phrase("w9 w1"))), fts.phrase("the"))),
    fts.Some((fts.phrase("unknown"), fts.phrase("©"))),
    fts.Phrase(()),
]


def hits(df):
    return [(r.chunk_id, round(r.score, 9), r.text, r.title) for r in df.collect()]


def compared(index, chunks, limit, **more):
    plan = fts.index(chunks)
    for node in NODES:
        assert hits(index.search(node, limit, **more)) == hits(fts.search(plan, chunks, node, limit, **more)), node


@pytest.mark.parametrize("limit", [7, 1000])
def test_searches(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(segments, "RANGE_BITS", 3)
    monkeypatch.setattr(segments, "SEEDS", 2)
    chunks = frame(spark, rows(random.Random(limit), range(300))).repartition(3)
    index = SegmentIndex.create(chunks, str(tmp_path), part_rows=40)
    compared(index, chunks, limit)
    monkeypatch.setitem(globals(), "NODES", NODES[1:5])
    compared(index, chunks, limit, where=(F.col("source_id") == "s1") & F.col("text").contains("w"))
    if limit == 7:
        monkeypatch.setattr(segments, "NAMED", 3)
        compared(index, chunks, limit)


def test_growth_change_and_loss(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "RANGE_BITS", 3)
    monkeypatch.setattr(segments, "MERGE", 3)
    r = random.Random(5)
    held = {x[0]: x for x in rows(r, range(100))}
    index = SegmentIndex.create(frame(spark, list(held.values())), str(tmp_path), part_rows=64)
    for batch in range(3):
        new = rows(r, range(100 + 20 * batch, 120 + 20 * batch))
        changed = rows(r, r.sample(sorted(held), 5)) + rows(r, [1000 + batch])
        gone = r.sample(sorted(held), 8)
        before = index
        index = index.add(frame(spark, new)).change(frame(spark, changed)).delete(frame(spark, [(i, None, None, None) for i in [*gone, 77777]]))
        held |= {x[0]: x for x in [*new, *changed]}
        held = {i: x for i, x in held.items() if i not in gone}
        assert index.n == len(held) and len(index.segments) <= 3 * segments.MERGE
    now = frame(spark, list(held.values()))
    assert sorted(index.chunks().collect()) == sorted(now.collect())
    compared(SegmentIndex.load(spark, str(tmp_path)), now, 10)
    fresh = SegmentIndex.create(now, str(tmp_path / "fresh"))
    assert index.tokens == fresh.tokens and sorted(index.term_stats().collect()) == sorted(fresh.term_stats().collect())
    # who has loaded a version goes on reading it; who writes after another is told
    assert hits(before.search(NODES[0], 5)) == hits(SegmentIndex.load(spark, str(tmp_path), before.version).search(NODES[0], 5))
    with pytest.raises(manifest.Conflict):
        before.add(frame(spark, rows(r, [5000])))


def files_below(at):
    return {os.path.join(d, f) for d, _, names in os.walk(at) for f in names}


def test_only_touched_segments_are_written_to(spark, tmp_path):
    r = random.Random(6)
    index = SegmentIndex.create(frame(spark, rows(r, range(50))), str(tmp_path)).add(frame(spark, rows(r, range(50, 60))))
    first = index.segments[0]["name"]
    before = files_below(tmp_path / "segments" / first)
    index = index.delete(frame(spark, [(55, None, None, None)]))
    assert [len(s["gone"]) for s in index.segments] == [0, 1]
    assert {f for f in files_below(tmp_path / "segments" / first) if "/gone/" not in f} == before


def test_a_crash_before_the_switch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    index = SegmentIndex.create(frame(spark, rows(random.Random(7), range(30))), str(tmp_path))

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", dies)
        with pytest.raises(OSError, match="gone"):
            index.delete(frame(spark, [(1, None, None, None)]))
    assert SegmentIndex.load(spark, str(tmp_path)).n == 30
    assert index.delete(frame(spark, [(1, None, None, None)])).n == 29


def test_few_blocks_and_files_are_read(spark, tmp_path):
    r = random.Random(8)
    some = [(i, " ".join(r.choice(WORDS[:20]) for _ in range(20 + i % 60)) + (" rare" * (1 + i % 7) if i % 25 == 0 else ""), "t", "s") for i in range(4000)]
    index = SegmentIndex.create(frame(spark, some), str(tmp_path), part_rows=250)
    assert len(hits(index.search(fts.phrase("rare"), 10))) == 10
    reads = index.reads
    assert reads.blocks < 0.2 * reads.blocks_in_index and reads.blocks < 0.7 * index.blocks(["rare"]).count()
    assert reads.files <= 10 < reads.files_in_index
    assert sorted(x.chunk_id for x in index.named([3, 400, 99999]).collect()) == [3, 400]


def test_empty_index(spark, tmp_path):
    none = frame(spark, [])
    index = SegmentIndex.create(none, str(tmp_path))
    assert index.search(NODES[0], 5).collect() == []
    index = index.delete(none).add(frame(spark, [(1, "w1", None, None), (2, None, None, None)]))
    assert [x.chunk_id for x in index.search(fts.phrase("w1"), 5).collect()] == [1] and index.search(fts.phrase("w1"), 0).collect() == []


def test_substrings(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    some = [(i, "".join(r.choice("abÉ ß.\n") for _ in range(r.randint(0, 40))) or None, "t", f"s{i % 3}") for i in range(400)]
    chunks = frame(spark, some)
    index = SegmentIndex.create(chunks.where("chunk_id < 300"), str(tmp_path), part_rows=100).with_substrings()
    index = index.add(chunks.where("chunk_id >= 300")).delete(frame(spark, [(5, None, None, None), (350, None, None, None)]))
    now = chunks.where("chunk_id not in (5, 350)")
    for words, where in ((("abÉ",), None), (("Aba", "é"), F.col("source_id") == "s1"), (("ab", "b"), None), (("abababababa",), None), ((), F.col("source_id") == "s2")):
        assert hits(index.substring(words, 12, where)) == hits(fts.like(now, words, 12, where)), words
    index.substring(("abé.",), 12)
    assert 0 < index.reads.candidates < 40
    few = index.substring(("abÉ",), 12, allowed=now.where("chunk_id < 100").select("chunk_id"))
    assert hits(few) == hits(fts.like(now.where("chunk_id < 100"), ("abÉ",), 12))
    assert hits(fts.ladder(index, now, fts.parse("§§ ??"), 5, F.col("source_id") == "s1", filtered=True)) == hits(fts.like(now, (), 5, F.col("source_id") == "s1"))
