"""Rows of a forest go down node by node: the same ends, swaps and merged sums as row by row."""

import numpy as np
import pyarrow as pa
import pytest

from quotelens.plans import trees as T


@pytest.fixture(scope="module")
def grown():
    """Two trees of depth five with random splits; some nodes above end early."""
    generator = np.random.default_rng(3)
    feature, threshold, left, right = [-1, -1], [0.0, 0.0], [-1, -1], [-1, -1]
    level = [0, 1]
    for _ in range(5):
        below = []
        for node in level:
            if node > 1 and generator.random() < 0.15:
                continue
            feature[node], threshold[node] = int(generator.integers(0, 6)), generator.random()
            left[node], right[node] = len(feature), len(feature) + 1
            below += [left[node], right[node]]
            for column, value in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1)):
                column += [value, value]
        level = below
    value = generator.random(len(feature))
    return T.Trees(2, *(np.array(v, t) for v, t in ((feature, np.int32), (threshold, float), (left, np.int32), (right, np.int32), (value, float))))


def _numbers(seed):
    generator = np.random.default_rng(seed)
    x = np.column_stack([generator.random((700, 4)), generator.random((700, 2)) < 0.5]).astype(float)
    x[::13, 1] = np.nan
    return x


def _end(trees, row, root):
    while trees.feature[root] >= 0:
        root = (trees.left if row[trees.feature[root]] <= trees.threshold[root] else trees.right)[root]
    return root


def test_leaves_and_asked_nodes_hold_the_rows_that_reach_them(grown, monkeypatch):
    """rows are looked at only on the way to the batch's nodes."""
    x = _numbers(1)
    ends = np.array([[_end(grown, row, root) for row in x] for root in (0, 1)])
    for root in (0, 1):
        assert grown.leaves(x, root).tolist() == ends[root].tolist()
    slots = np.full(len(grown.feature), -1)
    chosen = np.unique(ends[0])[:2]
    slots[chosen] = [1, 0]
    wanted, block, looked = T._on_the_way(grown, slots), T.Block(x, np.arange(len(x))), []
    column = block.column
    monkeypatch.setattr(block, "column", lambda f: looked.append(f) or column(f))
    found = dict(T._asked(grown, block, 0, slots, wanted))
    assert found.keys() == {0, 1}
    for node in chosen:
        assert sorted(found[slots[node]].tolist()) == np.flatnonzero(ends[0] == node).tolist()
    assert len(looked) <= (wanted & (grown.feature >= 0)).sum() < (grown.feature >= 0).sum() / 2
    assert T._asked(grown, block, 1, slots, wanted) == []


@pytest.mark.parametrize("groups", [[[0], [1], [2], [3], [4, 5]], [[0, 1, 2], [3, 4, 5]]])
def test_swaps_follow_the_changed_rows_only(grown, monkeypatch, groups):
    """no tree is gone through once per group of columns."""
    x, other = _numbers(1), _numbers(2)
    expected = np.empty((len(x), len(groups)))
    for g, columns in enumerate(groups):
        mixed = x.copy()
        mixed[:, columns] = other[:, columns]
        expected[:, g] = [sum(grown.value[_end(grown, row, root)] for root in (0, 1)) / 2 for row in mixed]
    monkeypatch.setattr(T.Trees, "leaves", None)
    assert grown.swapped(x, other, groups) == pytest.approx(expected, abs=1e-12)


def test_merged_sums_equal_sums_of_all_rows():
    generator = np.random.default_rng(4)
    x, y, slot = _numbers(1), generator.integers(-(2**39), 2**39, 700), generator.integers(-1, 5, 700)
    cuts = generator.random((5, 6))
    whole, merged, parts = T.Sums(5, 6), T.Sums(5, 6), []
    whole.add(T.Block(x, y), slot, cuts)
    for start in range(0, 700, 233):
        part = T.Sums(5, 6)
        part.add(T.Block(x[start : start + 233], y[start : start + 233]), slot[start : start + 233], cuts)
        parts += part.rows()
    merged.merge(pa.concat_batches(parts))
    merged.merge(parts[0].slice(0, 0))
    for name, value in vars(whole).items():
        assert np.array_equal(getattr(merged, name), value), name
