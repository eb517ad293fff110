"""Near-duplicate tiles of many long sets: the intersections' memory is bounded, and the sizes are right."""

import tracemalloc

import numpy as np

from lithoframe.llm import ngram_join


def test_intersections_of_long_sets_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 1 << 64, 40_000, dtype=np.uint64))
    sets = [pool[np.sort(rng.choice(len(pool), 20_000, replace=False))] for _ in range(160)]
    sets += [sets[0], pool[:1], pool[-1:], np.asarray([0, (1 << 64) - 1], dtype=np.uint64)]
    rows, cols = np.arange(100), np.arange(50, len(sets))
    tracemalloc.start()
    got = ngram_join._intersections(sets, rows, cols)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    for i, j in [(0, 50), (3, 5), (99, 110), (0, 110), (7, 111), (7, 112), (60, 10), (2, 113)]:
        assert got[i, j] == len(np.intersect1d(sets[rows[i]], sets[cols[j]]))
    monkeypatch.setattr(ngram_join, "AT_ONCE", 1)
    few = [np.asarray(s, dtype=np.uint64) for s in ([1, 2, 5], [2, 5, 9], [7])]
    assert ngram_join._intersections(few, np.arange(3), np.arange(3)).tolist() == [[2, 2, 0], [2, 2, 0], [0, 0, 0]]
