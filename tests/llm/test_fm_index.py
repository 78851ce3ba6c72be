import numpy as np
from hypothesis import given, settings, strategies as st

from hedgewise.llm.fm_index import FmIndex, suffix_array


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 3))
def test_suffix_order(symbols, times):
    text = np.array(symbols * times + [-1]) + 1
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix_array(text).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=120), st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=6), min_size=1, max_size=8))
def test_all_occurrences_are_found(symbols, patterns):
    x, index = np.array(symbols), FmIndex(np.array(symbols), 5)
    lengths = np.array([len(p) for p in patterns])
    padded = np.zeros((len(patterns), 6), np.int64)
    for row, p in zip(padded, patterns):
        row[: len(p)] = p
    low, high = index.search(padded, lengths)
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(x) - len(p) + 1) if x[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
