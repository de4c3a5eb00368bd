"""Near copies at the threshold are candidates whatever the size of their sets."""

import numpy as np
import pytest

from peakfield.llm import simhash


@pytest.mark.parametrize(("shared", "more"), [(4, 1), (12, 3), (20, 5), (40, 10)])
def test_pairs_at_the_threshold_are_candidates(shared, more):
    """Sets of which one holds the other, at similarity 0.8; the first is that of texts of 8 and 9 words."""
    rnd = np.random.default_rng(1)
    prints = lambda h: np.array([[simhash.majority(h), simhash.majority(simhash._mixed(h))]], np.int64).view(np.uint64)
    sizes, found = (np.array([shared]), np.array([shared + more])), 0
    for _ in range(5000):
        h = rnd.integers(0, 2**64, shared + more, np.uint64)
        found += bool(simhash.near(prints(h[:shared]), prints(h), simhash.reach(*sizes, 40))[0, 0])
    assert found == 5000
