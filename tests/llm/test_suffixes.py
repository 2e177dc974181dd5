import random

import numpy as np
import pytest

from veldspar.llm import suffixes as sx


def check(text, cap, **how):
    text = np.array([*text, 0], np.uint16)
    got = list(sx.suffixes(text, cap, **how))
    order = np.concatenate([p for p, _ in got])[::-1].tolist()
    lcp = np.concatenate([v for _, v in got]).tolist()  # with the next larger one
    assert sorted(order) == list(range(len(text)))
    key = lambda i: text[i : i + cap].tolist()
    assert [key(i) for i in order] == sorted(key(i) for i in range(len(text)))
    falling = order[::-1]
    for k in range(1, len(falling)):
        a, b = key(falling[k - 1]), key(falling[k])
        want = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == want, (k, falling[k - 1 : k + 1])


@pytest.mark.parametrize("seed", range(12))
def test_order_and_prefixes_match_brute_force(seed):
    rng = random.Random(seed)
    alphabet = rng.choice([1, 2, 3, 20, 250])
    text = [rng.randint(1, alphabet) for _ in range(rng.randint(1, 400))]
    if seed % 3 == 0:
        text = text * 3 + [0] + text[: len(text) // 2]
    check(text, rng.choice([1, 5, 50]))


def test_small_memory_spills_and_recursion_gives_the_same():
    rng = random.Random(9)
    text = [rng.randint(1, 3) for _ in range(600)] * 2
    check(text, 50, memory=64, in_memory=8)
    check([1] * 300 + [2] * 300 + [1, 2] * 200, 50, memory=64, in_memory=4)


def test_queue_spills_and_keeps_order():
    queue = sx.Queue(memory=40)
    for i in range(20):
        queue.push(i % 3, np.array([i, 100 + i], np.int32), np.array([1, 2], np.uint8))
    assert queue.spilled
    positions, values = queue.pop(1)
    assert positions.tolist() == [x for i in range(1, 20, 3) for x in (i, 100 + i)] and values.tolist() == [1, 2] * 7
    assert queue.pop(1) is None
    queue.close()


def test_empty():
    assert list(sx.suffixes(np.zeros(0, np.uint16), 50)) == []
