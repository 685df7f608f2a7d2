"""What becomes of pages that are fetched again and again, as a stream with a state for each address.

The state of an address is the hash of its newest content and when that was seen. A page that is new or
has another content than the state's is told ("new", "changed"); one that is the same, comes again, or
was fetched before what the state knows only keeps the address alive. An address that hasn't been
seen for `vanish` of event time is told as "vanished" by a timer, and forgotten.

State and timers lie in the checkpoint, so a batch that is run again after a failure tells the same.
They need Spark's RocksDB state store (STATE_STORE).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepool.functions import urls

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
TOLD = "url string, what string, seen timestamp, html string"


class Watch(StatefulProcessor):
    """Rows of one address: seen (milliseconds), hash, html."""

    def __init__(self, vanish_ms: int):
        self.vanish_ms = vanish_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "hash string, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # of equally new ones the least hash counts, whatever the order in which they come
        newest = min(((-s, h, t) for frame in rows for s, h, t in zip(frame["ms"].tolist(), frame["hash"], frame["html"], strict=True)), default=None)
        old = self.page.get() if self.page.exists() else None
        if newest is None:
            return
        seen, told, html = -newest[0], newest[1], newest[2]
        if old is not None and (seen, told) != (old[1], old[0]) and (seen < old[1] or (seen == old[1] and told > old[0])):
            return  # fetched before what is known
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.page.update((told, seen))
        self.handle.registerTimer(seen + self.vanish_ms)
        if old is None or old[0] != told:
            yield pd.DataFrame({"url": [key[0]], "what": ["new" if old is None else "changed"], "seen": [pd.Timestamp(seen, unit="ms")], "html": [html]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, seen = self.page.get()
        self.page.clear()
        yield pd.DataFrame({"url": [key[0]], "what": ["vanished"], "seen": [pd.Timestamp(seen, unit="ms")], "html": [None]})

    def close(self) -> None:
        pass


def watched(pages: DataFrame, vanish: int, late: str = "1 hour") -> DataFrame:
    """TOLD of a stream of pages (url, html, seen). vanish: seconds without a sight after which an address has gone. Addresses are normalized; pages without one, or without html, are left out."""
    rows = pages.select(urls.normalize(F.col("url")).alias("url"), "html", "seen").where("url is not null and html is not null and seen is not null")
    rows = rows.withWatermark("seen", late).withColumn("hash", F.sha2("html", 256)).withColumn("ms", F.unix_millis("seen"))
    return rows.groupBy("url").transformWithStateInPandas(Watch(1000 * vanish), TOLD, "append", "EventTime")


def follow(pages: DataFrame, vanish: int, save: Callable[[DataFrame, int], None], checkpoint: str, late: str = "1 hour", trigger: dict | None = None):
    """A query that hands what a stream of pages tells to save, batch by batch. save gets a number with each batch; one that is handed over again comes under the same number."""
    return watched(pages, vanish, late).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
