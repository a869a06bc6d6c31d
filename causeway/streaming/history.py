"""Released history on a stream: the batch features, incrementally.

Endpoint rows are keyed by layer and node.  A row waits until the watermark has passed its
time, so that all rows of that time are there and see the same state; labels are released
strictly after their delay.  Rows that come after the watermark has passed their time are late
and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "layer string, node string, row_ord long, side string, t long, n long, f long"


class ReleasedHistory(StatefulProcessor):
    """State of a node: rows that wait, labels not yet out, and the counts that are."""

    def __init__(self, delay: int) -> None:
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, row_ord long, side string, label int")
        self.held = handle.getListState("held", "t long, label int")
        self.counts = handle.getValueState("counts", "n long, f long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for r in frame.itertuples(index=False):
                at = int(r.t) * 1000
                if at >= mark:
                    self.waiting.appendValue((int(r.t), int(r.row_ord), r.side, None if pd.isna(r.label) else int(r.label)))
                    self.handle.registerTimer(at + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = (expiredTimerInfo.getExpiryTimeInMs() - 1) // 1000
        waiting = [tuple(x) for x in self.waiting.get()]
        ready, later = sorted(x for x in waiting if x[0] <= now), [x for x in waiting if x[0] > now]
        held = [tuple(x) for x in self.held.get()]
        n, f = tuple(self.counts.get()) if self.counts.exists() else (0, 0)
        out = []
        for t in sorted({x[0] for x in ready}):
            block = [x for x in ready if x[0] == t]
            free = [x for x in held if x[0] + self.delay < t]
            n, f = n + len(free), f + sum(x[1] for x in free)
            held = [x for x in held if x[0] + self.delay >= t]
            out += [(key[0], key[1], x[1], x[2], t, n, f) for x in block]
            held += [(t, x[3]) for x in block if x[3] is not None]
        self.waiting.put(later) if later else self.waiting.clear()
        self.held.put(held) if held else self.held.clear()
        self.counts.update((n, f))
        yield pd.DataFrame(out, columns=["layer", "node", "row_ord", "side", "t", "n", "f"])

    def close(self) -> None:
        pass


def stream_history(ends: DataFrame, delay: int, watermark: str = "0 seconds") -> DataFrame:
    """Streaming endpoint rows ``(layer, node, row_ord, side, t, label)`` with ``n`` and ``f`` as in batch; times in seconds.

    The session needs a RocksDB state store.
    """
    rows = ends.select("layer", "node", "row_ord", "side", "t", "label", F.timestamp_seconds("t").alias("event_time")).withWatermark("event_time", watermark)
    return rows.groupBy("layer", "node").transformWithStateInPandas(statefulProcessor=ReleasedHistory(delay), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")
