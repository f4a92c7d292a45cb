"""Summary parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SummaryConfig:
    """rows x length counters, top-``k``; change mode ships at ``threshold``,
    periodic mode every ``interval`` items of a worker; ``alpha``: share of
    all items that makes a key heavy."""

    rows: int = 3
    length: int = 65536
    levels: int = 1
    k: int = 1023
    workers: int = 16
    threshold: int = 127
    interval: int = 20_000
    alpha: float = 0.0002
    flush_residual: bool = False

    def but(self, **changes) -> SummaryConfig:
        return replace(self, **changes)


CM = SummaryConfig()
COUNT = SummaryConfig()
KEYED = SummaryConfig(rows=2, threshold=31, interval=100_000)
LEVELS = SummaryConfig(levels=6, interval=40_000)
REGISTERS = SummaryConfig(rows=1, threshold=0, interval=10_000, alpha=0.0)
DD = SummaryConfig(rows=1, threshold=15, interval=10_000, alpha=0.0)
SPREAD = SummaryConfig(k=255, threshold=1, interval=60_000, alpha=0.00001)


@dataclass(frozen=True)
class HeavyConfig(SummaryConfig):
    """Heavy buckets of ``slots`` slots beside a light array of ``light`` cells."""

    buckets: int = 767
    slots: int = 4
    light: int = 196_608
    threshold: int = 31


HEAVY = HeavyConfig()

#: Live bindings: the same operators with other thresholds.  ``strict``: a cell ships above its threshold, not at it.
NIC = {"first": 8, "least": 7, "most": 63, "every": 64, "low": 96, "high": 160, "gap": 32}
KERNEL = {"first": 64, "least": 63, "most": 126, "every": 64, "low": 96, "high": 160, "gap": 32, "strict": True}
