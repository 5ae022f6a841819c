"""Node sums of a forest over a block: the same as plain ones, for numbers and for columns of zeros and ones."""

import numpy as np

from quotelens.plans import trees as T


def test_node_sums_over_joined_batches_equal_plain_ones():
    generator = np.random.default_rng(5)
    x = np.column_stack([generator.random((9000, 2)), generator.random((9000, 2)) < 0.3, np.ones(9000), np.zeros(9000)]).astype(float)
    y, slot = generator.integers(-(2**40), 2**40, 9000), generator.integers(-1, 2, 9000)
    cuts = np.array([[0.5, 2.0, 0.4, 1.0, 1.0, 0.0], [np.nan, -1.0, -0.5, 0.0, 0.5, 0.2]])
    sums = T.Sums(2, 6)
    sums.add(T.Block(x, y), slot, cuts)
    for node in (0, 1):
        own, left = x[slot == node], x[slot == node] <= cuts[node]
        assert sums.n_left[node].tolist() == left.sum(axis=0).tolist()
        assert sums.s_left[node].tolist() == (left * y[slot == node][:, None]).sum(axis=0).tolist()
        assert sums.low[node].tolist() == own.min(axis=0).tolist() and sums.high[node].tolist() == own.max(axis=0).tolist()
