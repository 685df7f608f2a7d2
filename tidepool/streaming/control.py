"""Cancelling a piece of work, and being told how a stream gets on. An addition to the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], None]]:
    """Runs what is inside under a tag; calling what it yields, from any thread, stops its jobs."""
    spark.addTag(tag)
    try:
        yield lambda: spark.interruptTag(tag)
    finally:
        spark.removeTag(tag)


class Progress(StreamingQueryListener):
    """Hands each batch's number and rows to `tell`, and None at the end."""

    def __init__(self, tell: Callable[[tuple[int, int] | None], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.tell((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell(None)
