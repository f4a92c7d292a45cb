import random

import numpy as np
import pytest

from tallyweave.llm.induced import DiskQueue, suffix_order


def brute(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


@pytest.mark.parametrize("in_memory", [1, 1 << 20])
def test_order_and_prefixes_equal_brute_force(in_memory):
    rng = random.Random(3)
    for trial in range(150):
        alphabet = rng.choice([[0], [0, 1], [0, 1, 2], list(range(257))])
        text = [rng.choice(alphabet) for _ in range(rng.randint(0, 120))]
        if trial % 3 == 0 and text:
            text = (text[: rng.randint(1, 12)] * 40)[: rng.randint(1, 160)]
        cap = rng.choice([5, 50])
        got = list(suffix_order(np.array(text, np.int64), cap, in_memory))
        at = np.concatenate([a for a, _ in got]).tolist() if got else []
        lcp = np.concatenate([p for _, p in got]).tolist() if got else []
        order, common = brute(text, cap)
        assert [text[i : i + cap] for i in at] == [text[i : i + cap] for i in order]
        assert sorted(at) == list(range(len(text)))
        if text:
            assert lcp == common


def test_queue_spills_and_keeps_order():
    q = DiskQueue(in_memory=3)
    for i in range(10):
        q.push(np.array([i, i + 100]), np.array([i, 1], np.uint8))
    at, lcp = q.pop()
    assert at.tolist() == [x for i in range(10) for x in (i, i + 100)]
    assert lcp.tolist() == [x for i in range(10) for x in (i, 1)]
    assert q.pop() is None
