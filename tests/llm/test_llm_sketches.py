"""Sketches of near-dedup, without Spark: no similar pair is ruled out, whatever the widths and the sides."""

import numpy as np
import pytest

from citelake.llm import near_dedup


@pytest.mark.parametrize("widest", [64, 1 << 13])
@pytest.mark.parametrize("sided", [False, True])
def test_likely_loses_no_pair(monkeypatch, widest, sided):
    monkeypatch.setattr(near_dedup, "WIDEST", widest)
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(-(1 << 63), (1 << 63) - 1, n, np.int64)
    sets = []
    for n in (1, 2, 5, 57, 64, 120, 129, 500, 1020):
        base = draw(n)
        for changed in (0, n // 20, n // 9, n // 5, n // 2):
            sets.append(np.unique(np.concatenate([base[changed:], draw(changed + (n // 8) * (changed % 2))])))
    nodes, roots, sides = np.arange(len(sets)), np.arange(len(sets)), rng.random(len(sets)) < 0.5
    roots[1] = roots[0]
    sketches = [np.frombuffer(near_dedup.sketch(s), np.uint64) for s in sets]
    found = near_dedup.likely(nodes, roots, sketches, 0.8, sides if sided else None)
    tree = list(range(len(sets)))
    for a, b in found:
        assert tree[a] != tree[b] and roots[a] != roots[b] and (not sided or sides[a] != sides[b])
        tree = [tree[a] if t == tree[b] else t for t in tree]
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and roots[i] != roots[j] and (not sided or sides[i] != sides[j]):
                assert tree[i] == tree[j]
