"""Pages fetched again and again: late ones, repeated ones, vanished ones, and a failure in between."""

import datetime as dt

import pytest

from tidepool.streaming import watch

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k) for k in watch.STATE_STORE}
    for k, v in watch.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def minutes(n):
    return START + dt.timedelta(minutes=n)


def test_pages_over_time(rocks, tmp_path):
    kinds = "url string, html string, seen timestamp"
    batches = [
        [("https://e.com/a", "one", 0), ("https://e.com/b", "x", 0), ("https://E.com/a#top", "one", 1), ("no address", "y", 0), (None, "z", 1)],
        [("https://e.com/a", "two", 10), ("https://e.com/b", "x", 10), ("https://e.com/a", "two", 10), ("https://e.com/b", "old", 5)],
        [("https://e.com/a", "one", 9), ("https://e.com/c", "late", 11)],  # an older fetch arrives after a newer one
        [("https://e.com/a", "two", 200)],  # b and c haven't been seen for an hour
        [("https://e.com/b", "again", 210)],
        [("https://e.com/a", "two", 215)],
    ]
    told: dict[int, list] = {}
    failing = {3}

    def save(rows, number):
        found = sorted((r.url.rpartition("/")[2], r.what, r.html) for r in rows.collect())
        if number in failing:
            failing.discard(number)
            raise OSError("the store was away")
        told[number] = found

    def run():
        pages = rocks.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        watch.follow(pages, 3600, save, str(tmp_path / "ck"), late="5 minutes").awaitTermination(300)

    for k, rows in enumerate(batches):
        rocks.createDataFrame([(u, h, minutes(m)) for u, h, m in rows], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        try:
            run()
        except Exception as e:
            assert "the store was away" in str(e) and k < len(batches) - 1
            run()
    seen = [x for n in sorted(told) for x in told[n]]
    assert seen.count(("a", "new", "one")) == 1 and seen.count(("a", "changed", "two")) == 1 and ("a", "changed", "one") not in seen
    assert ("b", "new", "x") in seen and ("b", "changed", "old") not in seen and ("c", "new", "late") in seen
    assert seen.count(("b", "vanished", None)) == 1 and seen.count(("c", "vanished", None)) == 1 and not any(x[:2] == ("a", "vanished") for x in seen)
    assert seen.index(("b", "vanished", None)) < seen.index(("b", "new", "again")) and not failing
