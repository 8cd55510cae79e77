"""What a task remembers of shared keys, and the number of pivots."""

from __future__ import annotations

import numpy as np
import pytest

from engram.llm.common import Earliest
from engram.llm.embed_dup import MOST, PIVOTS, ROWS, forest, pivot_count


@pytest.mark.parametrize("most", [1, 4, 1 << 16])
def test_earliest_is_an_id_met_and_never_larger_than_in_the_slice(most):
    draw, met, seen = np.random.default_rng(1), Earliest(most), {}
    with np.errstate(over="ignore"):
        for _ in range(30):
            one, two, ids = draw.integers(-3, 4, 50), draw.integers(0, 2, 50), draw.integers(0, 1000, 50)
            got = met.of(one, two, ids)
            for a, b, i in zip(one, two, ids, strict=True):
                seen.setdefault((a, b), set()).add(i)
            for a, b, g in zip(one, two, got, strict=True):
                here = ids[(one == a) & (two == b)]
                assert g in seen[a, b] and g <= here.min()
            assert len(met.mixed) <= most
        assert len(met.of(one[:0], two[:0], ids[:0])) == 0


def test_pivots_grow_with_the_table():
    counts = [pivot_count(n) for n in (0, ROWS, 16 * ROWS, 10**13)]
    assert counts == [PIVOTS, PIVOTS, 2 * PIVOTS, MOST]


def test_forest_joins_what_links_join():
    a, b = np.nonzero(np.triu(np.ones((40, 40), bool), 1))
    keep = a % 3 == b % 3
    u, v = forest(a[keep], b[keep], 40)
    assert len(u) == 37 and ((u % 3) == (v % 3)).all() and len({*zip(u.tolist(), v.tolist(), strict=True)}) == 37
