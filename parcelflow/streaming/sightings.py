"""Keyed state of listings: the last sighting, and a timer that reports a listing unseen.

Functions reach Python workers by value, so executors need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What the processor reads and writes; instants are microseconds.
STATE = "id string, seen bigint, price_usd double, gone boolean"
LINKED = "listing_key string, kind string, id string, seen bigint, price_usd double, prev_seen bigint, prev_price double, prev_gone boolean"
_DAY_MS = 86_400_000


class LastSighting(StatefulProcessor):
    """Rows of one listing, each with the sighting before it.

    ``kind`` is ``seen``, ``late`` for a row older than the listing's last known sighting (it changes nothing), or ``unseen``,
    once, when the newest sighting of the whole stream is more than ``days`` past the listing's last.  A task holds
    one listing's rows of one micro-batch, which the trigger's file cap bounds.
    """

    def __init__(self, days: int, lateness_ms: int):
        self.days, self.lateness_ms = days, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def _unseen_at(self, seen: int) -> int:
        # the watermark trails the newest sighting by the lateness; a timer fires when the watermark reaches it
        return seen // 1000 + self.days * _DAY_MS - self.lateness_ms + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get()
        prev = known
        for r in sorted(rows, key=lambda r: (r["seen"], r["id"] or "")):
            if known is not None and r["seen"] < known[1]:
                yield Row(listing_key=key[0], kind="late", id=r["id"], seen=r["seen"], price_usd=r["price_usd"], prev_seen=None, prev_price=None, prev_gone=None)
                continue
            before = (None, None, None) if prev is None else (prev[1], prev[2], prev[3])
            yield Row(listing_key=key[0], kind="seen", id=r["id"], seen=r["seen"], price_usd=r["price_usd"],
                      prev_seen=before[0], prev_price=before[1], prev_gone=before[2])
            prev = (r["id"], r["seen"], r["price_usd"], False)
        if prev is known:
            return
        if known is not None and not known[3]:
            self.handle.deleteTimer(self._unseen_at(known[1]))
        self.handle.registerTimer(self._unseen_at(prev[1]))
        self.last.update(prev)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        id_, seen, price, _ = self.last.get()
        newest = (timerValues.getCurrentWatermarkInMs() + self.lateness_ms) * 1000
        yield Row(listing_key=key[0], kind="unseen", id=id_, seen=newest, price_usd=price, prev_seen=seen, prev_price=price, prev_gone=False)
        self.last.update((id_, seen, price, True))

    def close(self) -> None:
        pass
