import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from filelode.llm.suffix_array import permuted_common_prefixes, suffix_array


def check(data):
    a = np.array(data, np.int64)
    order = suffix_array(a, 260)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    got = permuted_common_prefixes(a, order)
    for r, i in enumerate(order):
        want = 0
        if r:
            j = order[r - 1]
            while i + want < len(data) and j + want < len(data) and data[i + want] == data[j + want]:
                want += 1
        assert got[i] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_small_alphabets(data):
    check(data)


def test_repetitive_and_long():
    rng = random.Random(1)
    check([1] * 50)
    check([1, 2] * 40)
    check([3])
    words = [[rng.randrange(1, 259) for _ in range(rng.randint(2, 40))] for _ in range(12)]
    check([c for _ in range(60) for c in rng.choice(words)])
    check([c for _ in range(30) for c in words[0] + words[1]])


def test_empty():
    assert suffix_array(np.zeros(0, np.int64), 5).tolist() == []
