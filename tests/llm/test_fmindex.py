import numpy as np
import pytest

from beatloom.llm.fmindex import FMIndex, suffix_order


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(1, 4 + 5 * (seed % 2), 2000).astype(np.uint8)
    t[500:900] = t[100:500]
    t[[0, 1000, 1001, 1997, 1998, 1999]] = 0
    raw = t.tobytes()
    order = suffix_order(t, 22)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: raw[i:])
    index = FMIndex(t, 22)
    assert (index.locate(np.arange(len(t))) == order).all()
    patterns = np.concatenate([t[100:400], rng.integers(1, 4, 100).astype(np.uint8)])
    ends = np.arange(30, len(patterns), 3)
    which, length, lo, hi = index.longest(patterns, ends, 8, 24, 2)
    seen = set()
    for w, n, a, b in zip(which, length, lo, hi):
        piece = patterns[ends[w] - n : ends[w]].tobytes()
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(raw)) if raw.startswith(piece, i)]
        seen.add(int(w))
    for w, e in enumerate(ends):
        piece = patterns[e - 8 : e].tobytes()
        assert (w in seen) == (piece in raw)
