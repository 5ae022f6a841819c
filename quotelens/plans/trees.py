"""Extremely random trees, grown for all trees of a forest at once.

A node draws one random threshold for each feature, uniform between the feature's smallest and largest value
there, and takes the best of them. So one pass over the rows tells all that a batch of open nodes needs: for
each node and feature the rows and target sums on either side of the threshold, and the range of the feature,
from which the children's thresholds are drawn. A range is known one level late: thresholds are drawn from the
parent's range, cut at the split. One outside the node's own range leaves a side empty and is no candidate;
those inside are uniform over the node's own range, as they should be.

Tasks add up their rows per node before the shuffle, one task per node picks its split, and the driver gets one row
per open node. A batch has at most ``CELLS`` pairs of node and feature, whatever the number of rows, and nodes are
taken from a stack, so at most ``max_depth`` batches wait. A forest has at most ``trees * 2 ** max_depth`` leaves,
or rows / ``min_leaf`` of them per tree.

Targets are counted in whole multiples of a small unit, so sums don't depend on the order of the rows: a repeated
fit, or one that lost an executor, grows the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.session import materialise

#: Pairs of node and feature in one pass: 32 bytes each in a task, 16 on the driver.
CELLS = 1_000_000
#: Numbers of the feature matrix that a task looks at together.
BLOCK = 8_000_000
#: Rows of one node that are added up at once; targets are below 2 ** 40 units, so such sums are whole doubles.
EXACT_ROWS = 4096
#: Multiplications in one product of matrices: few enough that it stays on the task's own core.
PRODUCT = 200_000
#: Rows that are joined to one where smallest and largest numbers are looked for.
FOLD = 16
PACKED = "y bigint, x binary"
NODES = "node int, feature int, threshold double, left int, right int, value double"
PARTIAL = "slot int, n bigint, s bigint, y_low bigint, y_high bigint, n_left binary, s_left binary, low binary, high binary"
SPLIT = "slot int, n bigint, s bigint, feature int, n_left bigint, s_left bigint, low binary, high binary"


class Trees(NamedTuple):
    """Nodes of all trees side by side; the first ones are the roots. A leaf has feature -1."""

    roots: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """The feature each node looks at, and where rows go above and below its threshold; leaves lead to themselves."""
        inner = self.feature >= 0
        ways = np.where(inner, np.stack([self.right, self.left]), np.arange(len(inner)))
        return np.maximum(self.feature, 0).astype(np.int64), ways.T.astype(np.int64).ravel()

    def leaves(self, x: np.ndarray, root: int, steps: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The node in which each row of ``x`` ends, from one root."""
        at = np.full(len(x), root)
        if self.feature[root] < 0:
            return at
        (feature, ways), numbers, first = steps or self.steps(), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        while True:
            below = numbers.take(first + feature.take(at)) <= self.threshold.take(at)
            after = ways.take(2 * at + below)
            if np.array_equal(after, at):
                return at
            at = after

    def mean(self, x: np.ndarray) -> np.ndarray:
        total, steps = np.zeros(len(x)), self.steps()
        for root in range(self.roots):
            total += self.value[self.leaves(x, root, steps)]
        return total / self.roots

    def swapped(self, x: np.ndarray, other: np.ndarray, groups: list[list[int]]) -> np.ndarray:
        """The mean with one group of columns taken from ``other``, for each group.

        Rows go down a tree node by node. A row that a swap sends to the other side goes on there as well, with
        its group; what no swap changes is not looked up again.
        """
        total = np.zeros((len(x), len(groups)))
        number = np.full(x.shape[1], -1)
        for g, columns in enumerate(groups):
            number[columns] = g
        own, swap = np.ascontiguousarray(x.T), np.ascontiguousarray(other.T)
        nobody = np.arange(0)
        for root in range(self.roots):
            plain, left_before = np.empty(len(x)), np.zeros(total.size, bool)
            ended, open_nodes = [], [(root, np.arange(len(x)), nobody, nobody, frozenset())]
            while open_nodes:
                node, rows, moved, by, above = open_nodes.pop()
                if self.feature[node] < 0:
                    plain[rows] = self.value[node]
                    ended.append((moved, by, np.full(len(moved), self.value[node])))
                    continue
                feature, cut = self.feature[node], self.threshold[node]
                group = int(number[feature])
                below = own[feature].take(rows) <= cut
                moved_below = np.where(by == group, swap[feature].take(moved), own[feature].take(moved)) <= cut
                sides = {True: ([moved.compress(moved_below)], [by.compress(moved_below)]), False: ([moved.compress(~moved_below)], [by.compress(~moved_below)])}
                if group >= 0:
                    swap_below = swap[feature].take(rows) <= cut
                    for side, (to, to_by) in sides.items():
                        leave = rows.compress(swap_below & ~below if side else below & ~swap_below)
                        if group in above:
                            # A swap parts from a row's way once.
                            leave = leave.compress(~left_before.take(leave * len(groups) + group))
                        left_before[leave * len(groups) + group] = True
                        to.append(leave)
                        to_by.append(np.full(len(leave), group))
                for child, side, part in ((self.right[node], False, rows.compress(~below)), (self.left[node], True, rows.compress(below))):
                    to, to_by = map(np.concatenate, sides[side])
                    if len(part) or len(to):
                        open_nodes.append((child, part, to, to_by, above | {group}))
            total += plain[:, None]
            moved, by, value = map(np.concatenate, zip(*ended))
            total[moved, by] += value - plain[moved]
        return total / self.roots


class Pass(NamedTuple):
    """What a task needs for one batch: the trees so far, the batch's slot of each node (else -1), and thresholds by slot and feature.

    ``wanted`` tells which nodes lie on the way to one of the batch.
    """

    trees: Trees
    slots: np.ndarray
    roots: np.ndarray
    thresholds: np.ndarray
    drawn: np.ndarray
    min_leaf: int
    wanted: np.ndarray


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of a row as one value, which later passes read without a step per number."""
    for batch in batches:
        x = batch.column("x")
        rows = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        ends = np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(rows.shape[1] * 8 if len(rows) else 0)
        joined = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(rows)])
        yield pa.RecordBatch.from_arrays([batch.column("y"), joined], names=_names(PACKED))


def joined_batches(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """Rows of several batches together, at most ``step`` of them, so that a node has many of them."""
    held, rows = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            if rows + part.num_rows > step:
                yield pa.concat_batches(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield pa.concat_batches(held)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in joined_batches(batches, max(1, BLOCK // width)):
        packed = batch.column("x")
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :]
        x = np.frombuffer(packed.buffers()[2], np.float64, len(packed) * width, int(ends[0])).reshape(-1, width)
        yield Block(x, batch.column("y").to_numpy())


class Block:
    """Rows of a task: numbers by row to add up and by column to part rows; columns of only zeros and ones as bytes."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.y = y
        flags = ((x == 0) | (x == 1)).all(axis=0)
        self.flags, self.others = np.flatnonzero(flags), np.flatnonzero(~flags)
        self.numbers = np.ascontiguousarray(x[:, self.others])
        self.ones = np.ascontiguousarray(x[:, self.flags], np.uint8)
        self.place = np.empty(x.shape[1], np.int64)
        self.place[self.others], self.place[self.flags] = np.arange(len(self.others)), np.arange(len(self.flags))
        self.is_flag = flags
        self.held: dict[int, np.ndarray] = {}

    def column(self, feature: int) -> np.ndarray:
        if feature not in self.held:
            self.held[feature] = np.ascontiguousarray((self.ones if self.is_flag[feature] else self.numbers)[:, self.place[feature]])
        return self.held[feature]


def _extreme(least: np.ufunc, part: np.ndarray) -> np.ndarray:
    """The smallest or largest of each column; rows are joined to long ones first, which fill the processor's registers."""
    whole = len(part) // FOLD * FOLD
    if not whole:
        return least.reduce(part, axis=0)
    out = least.reduce(least.reduce(part[:whole].reshape(-1, FOLD * part.shape[1]), axis=0).reshape(FOLD, -1), axis=0)
    return out if whole == len(part) else least(out, least.reduce(part[whole:], axis=0))


class Sums:
    """Additive figures of a batch's nodes."""

    def __init__(self, nodes: int, width: int):
        self.n, self.s = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.y_low, self.y_high = np.full(nodes, np.iinfo(np.int64).max), np.full(nodes, np.iinfo(np.int64).min)
        self.n_left, self.s_left = np.zeros((nodes, width), np.int64), np.zeros((nodes, width), np.int64)
        self.low, self.high = np.full((nodes, width), np.inf), np.full((nodes, width), -np.inf)

    def add(self, block: Block, slot: np.ndarray, thresholds: np.ndarray) -> None:
        """Rows by the slot of their node; -1 is none."""
        found = [(int(k), np.flatnonzero(slot == k)) for k in np.unique(slot[slot >= 0])]
        self.add_nodes(block, found, thresholds)

    def add_nodes(self, block: Block, nodes: Sequence[tuple[int, np.ndarray]], thresholds: np.ndarray) -> None:
        """Slots and the places of their rows; each slot comes once and has rows."""
        if not nodes:
            return
        at = np.array([slot for slot, _ in nodes])
        n = np.array([len(rows) for _, rows in nodes])
        rows = np.concatenate([rows for _, rows in nodes])
        y = block.y.take(rows)
        ends = n.cumsum()
        starts = ends - n
        s = np.add.reduceat(y, starts)
        self.n[at] += n
        self.s[at] += s
        self.y_low[at] = np.minimum(self.y_low[at], np.minimum.reduceat(y, starts))
        self.y_high[at] = np.maximum(self.y_high[at], np.maximum.reduceat(y, starts))
        numbers, flags = np.ix_(at, block.others), np.ix_(at, block.flags)
        cuts, split = thresholds[numbers], len(block.others)
        left = np.zeros((2, len(at), split + len(block.flags)), np.int64)
        low, high = self.low[numbers], self.high[numbers]
        factors, sides = np.stack([np.ones(len(y)), y.astype(np.float64)]), np.empty((min(EXACT_ROWS, max(1, PRODUCT // (2 * left.shape[2]))), left.shape[2]))
        # Node by node, so that its rows fit the processor's cache; both sums of all columns are one product of matrices.
        for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
            for begin in range(start, end, len(sides)):
                until = min(begin + len(sides), end)
                part, side = block.numbers.take(rows[begin:until], axis=0), sides[: until - begin]
                if split:
                    side[:, :split] = part <= cuts[k]
                    low[k], high[k] = np.fmin(low[k], _extreme(np.fmin, part)), np.fmax(high[k], _extreme(np.fmax, part))
                side[:, split:] = block.ones.take(rows[begin:until], axis=0)
                left[:, k] += (factors[:, begin:until] @ side).astype(np.int64)
        self.low[numbers], self.high[numbers] = low, high
        self.n_left[numbers] += left[0, :, :split]
        self.s_left[numbers] += left[1, :, :split]
        # Below a threshold from 0 on are the rows without a one.
        (ones, ones_y), cut, n, s = left[:, :, split:], thresholds[flags], n[:, None], s[:, None]
        self.n_left[flags] += np.where(cut >= 1, n, np.where(cut >= 0, n - ones, 0))
        self.s_left[flags] += np.where(cut >= 1, s, np.where(cut >= 0, s - ones_y, 0))
        self.low[flags] = np.fmin(self.low[flags], ones == n)
        self.high[flags] = np.fmax(self.high[flags], ones > 0)

    def merge(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        slot = batch.column("slot").to_numpy()
        order = np.argsort(slot, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(slot[order]) > 0])
        at = slot[order][starts]

        def merged(add: np.ufunc, name: str, kind=None) -> np.ndarray:
            column = batch.column(name)
            rows = column.to_numpy() if kind is None else np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(slot), -1)
            return add.reduceat(rows[order], starts, axis=0)

        for name in ("n", "s"):
            getattr(self, name)[at] += merged(np.add, name)
        self.y_low[at] = np.minimum(self.y_low[at], merged(np.minimum, "y_low"))
        self.y_high[at] = np.maximum(self.y_high[at], merged(np.maximum, "y_high"))
        for name in ("n_left", "s_left"):
            getattr(self, name)[at] += merged(np.add, name, np.int64)
        self.low[at] = np.minimum(self.low[at], merged(np.minimum, "low", np.float64))
        self.high[at] = np.maximum(self.high[at], merged(np.maximum, "high", np.float64))

    def rows(self) -> Iterator[pa.RecordBatch]:
        found = np.flatnonzero(self.n)
        step = max(1, BLOCK // (4 * self.low.shape[1]))
        for start in range(0, len(found), step):
            at = found[start : start + step]
            columns = [at.astype(np.int32), self.n[at], self.s[at], self.y_low[at], self.y_high[at]]
            packed = [pa.array([m[i].tobytes() for i in at], pa.binary()) for m in (self.n_left, self.s_left, self.low, self.high)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *packed], names=_names(PARTIAL))

    def best(self, drawn: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots seen, their best feature or -1): smallest squared error, among the drawn features if any of them splits."""
        at = np.flatnonzero(self.n)
        n, s, n_left, s_left = self.n[at, None], self.s[at, None], self.n_left[at], self.s_left[at].astype(float)
        n_right, s_right = n - n_left, s - s_left
        fits = (n_left >= max(min_leaf, 1)) & (n_right >= max(min_leaf, 1)) & (self.y_low < self.y_high)[at, None]
        gain = np.where(fits, s_left**2 / np.maximum(n_left, 1) + s_right**2 / np.maximum(n_right, 1), -np.inf)
        chosen = fits & drawn[at]
        gain = np.where(chosen | ~chosen.any(axis=1, keepdims=True), gain, -np.inf)
        return at, np.where(fits.any(axis=1), gain.argmax(axis=1), -1)


def _on_the_way(trees: Trees, slots: np.ndarray) -> np.ndarray:
    """Nodes of the batch and all above them."""
    parent = np.full(len(slots), -1)
    inner = np.flatnonzero(trees.feature >= 0)
    parent[trees.left[inner]] = parent[trees.right[inner]] = inner
    wanted, level = np.zeros(len(slots), bool), np.flatnonzero(slots >= 0)
    while len(level):
        wanted[level] = True
        level = np.unique(parent[level])
        level = level[level >= 0]
        level = level[~wanted[level]]
    return wanted


def _asked(trees: Trees, block: Block, root: int, slots: np.ndarray, wanted: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The batch's nodes below a root, as slots, with the rows that reach them: rows are parted node by node, and only on the way there."""
    found, open_nodes = [], [(root, np.arange(len(block.y)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        if not len(rows) or not wanted[node]:
            continue
        if slots[node] >= 0:
            found.append((int(slots[node]), rows))
        else:
            below = block.column(int(trees.feature[node])).take(rows) <= trees.threshold[node]
            open_nodes += [(trees.right[node], rows.compress(~below)), (trees.left[node], rows.compress(below))]
    return found


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _one_pass(matrix: DataFrame, work: Pass) -> pd.DataFrame:
    """One row per node of the batch: its rows, target sum, chosen feature, left side, and ranges where it splits."""
    spark = matrix.sparkSession
    shared = spark.sparkContext.broadcast(work)
    nodes, width = work.thresholds.shape

    def partial(batches):
        job, sums = shared.value, Sums(nodes, width)
        for block in _blocks(batches, width):
            for root in job.roots.tolist():
                sums.add_nodes(block, _asked(job.trees, block, root, job.slots, job.wanted), job.thresholds)
        yield from sums.rows()

    def choose(batches):
        job, sums = shared.value, Sums(nodes, width)
        for batch in batches:
            sums.merge(batch)
        at, feature = sums.best(job.drawn, job.min_leaf)
        picked = np.maximum(feature, 0)
        splits = feature >= 0 if job.drawn.any() else np.full(len(at), True)
        ranges = [pa.array([m[i].tobytes() if keep else None for i, keep in zip(at, splits)], pa.binary()) for m in (sums.low, sums.high)]
        columns = [at.astype(np.int32), sums.n[at], sums.s[at], feature.astype(np.int32), sums.n_left[at, picked], sums.s_left[at, picked]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *ranges], names=_names(SPLIT))

    try:
        # Adaptive execution joins small partitions, so few nodes don't start many tasks.
        # A partial sum per core is enough, however many partitions the rows have.
        rows = matrix.coalesce(max(1, spark.sparkContext.defaultParallelism))
        return rows.mapInArrow(partial, PARTIAL).repartition("slot").mapInArrow(choose, SPLIT).toPandas().sort_values("slot")
    finally:
        shared.unpersist()


def grow(rows: DataFrame, *, features: str, label: str, trees: int, min_leaf: int, share: float, max_depth: int, seed: int) -> Trees:
    """A forest over a vector column; rows without a target are left out, and without any row it is an error.

    ``share`` of the features is drawn at each node. Missing numbers (NaN) go right.
    """
    about = rows.agg(F.count(label).alias("n"), F.min(label).alias("low"), F.max(label).alias("high")).head()
    if not about["n"]:
        raise ValueError("a forest needs at least one row with a target")
    centre, reach = (about["high"] + about["low"]) / 2.0, (about["high"] - about["low"]) / 2.0
    # A sum over all rows fits a long.
    unit = reach / 2.0 ** min(40, 62 - math.ceil(math.log2(about["n"] + 1))) or 1.0
    whole = F.rint((F.col(label).cast("double") - centre) / unit).cast("bigint")
    numbers = rows.where(F.col(label).isNotNull()).select(whole.alias("y"), vector_to_array(features).alias("x"))
    matrix = materialise(numbers.mapInArrow(_packed, PACKED))
    width = len(matrix.select("x").head()["x"]) // 8

    feature, threshold, left, right = [-1] * trees, [0.0] * trees, [-1] * trees, [-1] * trees
    value = [0.0] * trees

    def so_far() -> Trees:
        return Trees(trees, *(np.array(v, dtype=t) for v, t in ((feature, np.int32), (threshold, float), (left, np.int32), (right, np.int32), (value, float))))

    nothing = np.full((1, width), np.nan)
    start = _one_pass(matrix, Pass(so_far(), np.where(np.arange(trees) == 0, 0, -1), np.array([0]), nothing, np.zeros((1, width), bool), min_leaf, np.arange(trees) == 0)).iloc[0]
    low, high = np.frombuffer(start["low"]), np.frombuffer(start["high"])
    value = [centre + unit * start["s"] / start["n"]] * trees
    stack = [(node, node, 0, low, high) for node in range(trees)] if max_depth > 0 and start["n"] >= 2 * min_leaf else []
    generator = np.random.default_rng(seed)
    while stack:
        batch = [stack.pop() for _ in range(min(len(stack), max(1, CELLS // width)))]
        low, high = np.array([b[3] for b in batch]), np.array([b[4] for b in batch])
        cuts = low + generator.random(low.shape) * (high - low)
        cuts = np.where(cuts >= high, low, cuts)
        order = generator.random(low.shape).argsort(axis=1).argsort(axis=1)
        slots = np.full(len(feature), -1)
        slots[[b[0] for b in batch]] = np.arange(len(batch))
        roots = np.unique([b[1] for b in batch])
        grown = so_far()
        done = _one_pass(matrix, Pass(grown, slots, roots, cuts, order < math.ceil(share * width), min_leaf, _on_the_way(grown, slots)))
        for slot, n, s, chosen, n_left, s_left, low_bytes, high_bytes in done.itertuples(index=False):
            if chosen < 0:
                continue
            node, root, depth, _, _ = batch[slot]
            feature[node], threshold[node] = chosen, cuts[slot, chosen]
            left[node], right[node] = len(feature), len(feature) + 1
            for size, total, side in ((n_left, s_left, 0), (n - n_left, s - s_left, 1)):
                child = len(feature)
                feature.append(-1), threshold.append(0.0), left.append(-1), right.append(-1), value.append(centre + unit * total / size)
                if size >= 2 * min_leaf and depth + 1 < max_depth:
                    ends = [np.frombuffer(low_bytes).copy(), np.frombuffer(high_bytes).copy()]
                    ends[1 - side][chosen] = cuts[slot, chosen]
                    stack.append((child, root, depth + 1, *ends))
    return so_far()


class TreesModel(Model, MLWritable, MLReadable):
    """Adds the mean over the trees to rows with a feature vector; null where there is no vector."""

    def __init__(self, trees: Trees | None = None, features: str = "features", prediction: str = "prediction"):
        super().__init__()
        self.trees, self.features, self.prediction = trees, features, prediction

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("double")
        def score(vectors: pd.Series) -> pd.Series:
            known = vectors.notna()
            out = pd.Series(np.nan, index=vectors.index, dtype="Float64").where(known)
            if known.any():
                out[known] = shared.value.mean(np.stack(vectors[known].to_numpy()))
            return out.astype("object").where(known, None)

        return dataset.withColumn(self.prediction, score(vector_to_array(self.features)))

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader()


class _TreesWriter(MLWriter):
    def __init__(self, model: TreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, spark = self.model, self.sparkSession
        names = {"roots": model.trees.roots, "features": model.features, "prediction": model.prediction}
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata=names)
        nodes = pd.DataFrame(dict(zip(_names(NODES)[1:], model.trees[1:])))
        nodes.insert(0, "node", np.arange(len(nodes)))
        spark.createDataFrame(nodes, NODES).write.parquet(f"{path}/nodes")


class _TreesReader(MLReader):
    def load(self, path: str) -> TreesModel:
        names = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nodes = self.sparkSession.read.schema(NODES).parquet(f"{path}/nodes").toPandas().sort_values("node")
        trees = Trees(names["roots"], *(nodes[c].to_numpy() for c in _names(NODES)[1:]))
        return TreesModel(trees, names["features"], names["prediction"])


class RandomTrees(Estimator):
    """Extremely random trees as a pipeline stage."""

    def __init__(
        self, *, featuresCol: str, labelCol: str, predictionCol: str, seed: int,
        numTrees: int = 200, minInstancesPerNode: int = 8, featureShare: float = 0.8, maxDepth: int = 10,
    ):
        super().__init__()
        self.columns = (featuresCol, labelCol, predictionCol)
        self.options = {"trees": numTrees, "min_leaf": minInstancesPerNode, "share": featureShare, "max_depth": maxDepth, "seed": seed}

    def _fit(self, dataset: DataFrame) -> TreesModel:
        features, label, prediction = self.columns
        return TreesModel(grow(dataset, features=features, label=label, **self.options), features, prediction)
