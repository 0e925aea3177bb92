"""Pages that share their shard with many copies of the same passage."""

import numpy as np
import pytest
from test_leakage import FILLER, PASSAGE, found, page

from beatloom.llm.fmindex import FMIndex


@pytest.mark.parametrize("seed", range(3))
def test_no_occurrence_is_left_behind(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(1, 5, 3000).astype(np.uint8)
    for at in range(300, 3000, 300):  # copies that go apart to the left after 10 to 22 symbols
        t[at + 60 : at + 100] = t[60:100]
        t[at + 60 + 3 * (at // 300 % 5)] ^= 5
    t[[0, 1500, 2999]] = 0
    index, ends = FMIndex(t, 22), np.arange(70, 100)
    which, length, lo, hi = index.longest(t, ends, 8, 24, 2, dropped=True)
    for w, e in enumerate(ends):
        got = sorted(p + n - 8 for n, a, b in zip(length[which == w], lo[which == w], hi[which == w]) for p in index.locate(np.arange(a, b)))
        piece = t[e - 8 : e].tobytes()
        assert got == [i for i in range(len(t)) if t.tobytes().startswith(piece, i)]


def test_damaged_page_among_copies(spark):
    clean = page(FILLER + PASSAGE.split() + FILLER)
    w = PASSAGE.split()
    for n in range(5, len(w), 7):
        w[n] = "q" + w[n][1:]
    damaged = page(FILLER[::-1] + w + FILLER)
    alone = found(spark, [(1, damaged, None)])
    assert set(alone) == {(1, 7)}
    among = found(spark, [(1, damaged, None), *[(n, clean, None) for n in range(2, 42)]])
    assert among[(1, 7)] == alone[(1, 7)] and len(among) == 41
