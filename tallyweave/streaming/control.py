"""Adaptive shipping threshold, and rates.

The controller watches the backlog of shipments: with little of it and no
growth, workers ship sooner (threshold down); with much of it that is not
shrinking, later (up).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQueryListener

from ..config import NIC


@dataclass
class ThresholdController:
    threshold: int = NIC["first"]
    least: int = NIC["least"]
    most: int = NIC["most"]
    low: int = NIC["low"]
    high: int = NIC["high"]
    gap: int = NIC["gap"]
    every: int = NIC["every"]
    backlog: int = 0
    seen: int = field(default=0, repr=False)

    def observe(self, backlog: int) -> int:
        """Take the backlog now; returns the threshold from here on."""
        growth, self.backlog = backlog - self.backlog, backlog
        if backlog + growth < self.low and growth < self.gap:
            self.threshold -= 1
        elif backlog + growth > self.high and growth > -self.gap:
            self.threshold += 1
        self.threshold = min(self.most, max(self.least, self.threshold))
        return self.threshold

    def shipped(self, n: int, backlog: int) -> int:
        """Count ``n`` shipments; the backlog is looked at after every ``every`` of them."""
        self.seen += n
        if self.seen >= self.every:
            self.seen %= self.every
            self.observe(backlog)
        return self.threshold

    def progress(self, last: dict) -> int:
        """Take a streaming query's ``lastProgress``: rows that arrive in excess of those processed are the backlog."""
        waiting = float(last.get("inputRowsPerSecond") or 0) - float(last.get("processedRowsPerSecond") or 0)
        return self.observe(max(0, int(waiting)))


class Rates(StreamingQueryListener):
    """Items per second of each micro-batch."""

    def __init__(self):
        self.rates: list[tuple[int, int, float]] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.rates.append((p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
