"""Suffix sorting by induction, with common prefixes, in bounded memory.

Suffixes are classed L (greater than their successor) or S; the leftmost S
suffixes of each run are sorted first: their substrings get names, and the
reduced string of names is ranked.  From them all L suffixes are induced in
ascending order and from those all S suffixes in descending order.  A queue
for each first character carries (position, common prefix) tuples from the
suffix that induces to the suffix induced; its order is the priority order, so
it is first-in first-out, and it keeps its tail on disk beyond a budget.  The
common prefix of neighbours is carried along: one more than the least one
between the two suffixes that induced them.

Whole queue heads are induced at once as arrays.  Prefixes are compared up to
``cap`` characters; suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples that a queue keeps in memory before it writes to disk.
IN_MEMORY = 1 << 22


class DiskQueue:
    """First-in first-out tuples (position, common prefix).  The file is the
    task's own scratch and goes with it; a lost task starts anew."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.in_memory, self.held, self.size, self.file, self.runs = in_memory, [], 0, None, []

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        self.held.append((at, lcp))
        self.size += len(at)
        if self.size > self.in_memory:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
            for a, p in self.held:
                self.file.write(a.astype(np.int64).tobytes())
                self.file.write(p.astype(np.uint8).tobytes())
                self.runs.append(len(a))
            self.held, self.size = [], 0

    def pop(self):
        """All tuples so far, in order, or None."""
        parts = []
        if self.runs:
            self.file.seek(0)
            for n in self.runs:
                parts.append((np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)))
            self.file.seek(0)
            self.file.truncate()
            self.runs = []
        parts += self.held
        self.held, self.size = [], 0
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else None


def _range_min(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(x[first..last]) for each pair, by a table of power-of-two ranges."""
    out = np.empty(len(first), x.dtype)
    width = np.frexp((last - first + 1).astype(float))[1] - 1
    row = x
    for k in range(int(width.max(initial=-1)) + 1):
        of = width == k
        out[of] = np.minimum(row[first[of]], row[last[of] - (1 << k) + 1])
        row = np.minimum(row[: -(1 << k)], row[1 << k :]) if len(row) > 1 << k else row
    return out


class _Inducer:
    """Pushes predecessors to the queues of their characters and carries common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, cap: int, in_memory: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queues = [DiskQueue(in_memory) for _ in range(257)]
        self.since = np.full(257, 255, np.uint8)  # least prefix since the last push of each character
        self.fresh = np.ones(257, bool)

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """``at``: suffixes in order; ``lcp``: with the one before."""
        before = at - 1
        take = np.flatnonzero(before >= 0)
        take = take[self.wanted[before[take]]]
        chars = self.text[before[take]]
        order = np.argsort(chars, kind="stable")
        take, chars = take[order], chars[order]
        if len(take):
            head = np.append(True, chars[1:] != chars[:-1])
            value = np.empty(len(take), np.uint8)
            value[~head] = _range_min(lcp, take[:-1][~head[1:]] + 1, take[1:][~head[1:]])
            value[head] = np.minimum(self.since[chars[head]], np.minimum.accumulate(lcp)[take[head]])
            value = np.minimum(value.astype(np.int64) + 1, self.cap).astype(np.uint8)
            value[head] = np.where(self.fresh[chars[head]], 0, value[head])
        self.since = np.minimum(self.since, lcp.min())
        if len(take):
            tail = np.append(head[1:], True)
            rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
            self.since[chars[tail]] = rest[take[tail] + 1]
            self.fresh[chars[tail]] = False
            starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                self.queues[chars[s]].push(before[take[s:e]], value[s:e])


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S, and the length of its run of equal characters."""
    n = len(text)
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))  # last position of each run
    end = change[np.searchsorted(change, np.arange(n))]
    following = np.append(text[1:], 0)[end]
    return np.where(end == n - 1, False, following > text), end - np.arange(n) + 1


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    out, n = np.zeros(len(a), np.uint8), len(text)
    live = np.arange(len(a))
    for k in range(cap):
        live = live[(a[live] + k < n) & (b[live] + k < n)]
        live = live[text[a[live] + k] == text[b[live] + k]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _rank_seeds(text: np.ndarray, seeds: np.ndarray, cap: int) -> np.ndarray:
    """Ranks of the seed suffixes by their first ``cap`` characters at least."""
    n, ends = len(text), np.append(seeds[1:], len(text) - 1)
    # Names of the substrings from seed to seed, seven characters at a time.
    names = np.zeros(len(seeds), np.int64)
    wide = text.astype(np.uint64) + np.uint64(1)
    # A substring that ends in a seed stands after longer ones that begin like it: there an L suffix follows.
    beyond = np.full(len(seeds), 511, np.uint64)
    beyond[-1:] = 0
    for k in range(0, min(cap, int((ends - seeds).max(initial=0)) + 1), 7):
        key = np.zeros(len(seeds), np.uint64)
        for j in range(k, k + 7):
            inside = seeds + j <= ends
            key = key << np.uint64(9) | np.where(inside, wide[np.minimum(seeds + j, n - 1)], beyond)
        order = np.lexsort((key, names))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (names[order][1:] != names[order][:-1]))
        names[order] = np.cumsum(new) - 1
    # The reduced string of names, ranked by twice as many names each time.
    step = 1
    while step * 2 <= 2 * cap and len(names) and names.max() < len(names) - 1:
        second = np.append(names[step:] + 1, np.zeros(min(step, len(names)), np.int64))
        order = np.lexsort((second, names))
        new = np.append(True, (second[order][1:] != second[order][:-1]) | (names[order][1:] != names[order][:-1]))
        names[order] = np.cumsum(new) - 1
        step *= 2
    return names


def suffix_order(text: np.ndarray, cap: int, in_memory: int = IN_MEMORY):
    """(suffixes in order, common prefix of each with the one before, at most
    ``cap``) of ``text``, values 0 to 256, in pieces for each first character."""
    n = len(text)
    if not n:
        return
    text = text.astype(np.int64)
    is_s, run = _types(text)
    run = np.minimum(run, cap).astype(np.uint8)
    seeds = np.flatnonzero(is_s & ~np.append(True, is_s[:-1]))
    seeds = seeds[np.argsort(_rank_seeds(text, seeds, cap), kind="stable")]
    seed_lcp = np.append(np.zeros(min(1, len(seeds)), np.uint8), _common(text, seeds[:-1], seeds[1:], cap)) if len(seeds) else np.empty(0, np.uint8)
    cuts = np.searchsorted(text[seeds], np.arange(258))

    up = _Inducer(text, ~is_s, cap, in_memory)
    up.feed(np.array([n]), np.zeros(1, np.uint8))
    large: list = []
    for c in range(257):
        got = []
        while (batch := up.queues[c].pop()) is not None:
            got.append(batch)
            up.feed(*batch)
        large.append(tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else None)
        a, b = cuts[c], cuts[c + 1]
        if a < b:
            lcp = seed_lcp[a:b].copy()
            lcp[0] = min(run[seeds[a]], run[large[c][0][-1]]) if got else 0
            up.feed(seeds[a:b], lcp)

    down = _Inducer(text, is_s, cap, in_memory)
    pieces = []
    for c in range(256, -1, -1):
        small = []
        while (batch := down.queues[c].pop()) is not None:
            small.append(batch)
            down.feed(*batch)
        at, lcp = [], []
        if large[c] is not None:
            la, ll = large[c]
            seam = min(run[la[-1]], run[small[-1][0][-1]]) if small else 0
            down.feed(la[::-1], np.append(np.uint8(seam), ll[:0:-1]))
            at.append(la)
            lcp.append(ll)
        if small:
            sa, sl = (np.concatenate(x) for x in zip(*small, strict=True))
            # Descending, each prefix is with the suffix above; ascending it belongs to that one.
            first = min(run[large[c][0][-1]], run[sa[-1]]) if large[c] is not None else 0
            at.append(sa[::-1])
            lcp.append(np.append(np.uint8(first), sl[:0:-1]))
        if at:
            pieces.append((np.concatenate(at), np.concatenate(lcp)))
    yield from reversed(pieces)
