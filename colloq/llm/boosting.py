"""Small gradient-boosted trees for binary labels: histograms of integer features, logistic loss.

Equal examples are one row with a count. A tree grows by levels, each from the sums of gradients in the cells (node,
feature, value), which are whole numbers: so they are the same however the rows are dealt. Up to ``LOCAL_ROWS`` different
rows come to the driver; of more, tasks add up the cells and only those (8,704 at most) come back, with the same trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TREES, DEPTH, RATE, LEAST = 40, 3, 0.3, 10
BINS = 32
#: Different rows that are learned from in the driver (some 3 MB).
LOCAL_ROWS = 100_000
#: Gradients are counted in units of 1 / SCALE.
SCALE = float(1 << 24)

_Tree = list[tuple[int, int, float]]


def clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, BINS - 1).astype(np.uint8)


class Boosted:
    """Trees over features with values 0 to BINS - 1 (larger ones count as BINS - 1)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, count: np.ndarray | None = None):
        x, count = clipped(x), np.ones(len(y), np.int64) if count is None else count
        self._fit(x.shape[1], int(count.sum()), int(count[y > 0].sum()), lambda tree: self.cells(x, y, count, tree))

    @classmethod
    def of(cls, rows: DataFrame, width: int, total: int, positive: int) -> Boosted:
        """From the rows (x: a byte for each feature, y, n) of a table; the driver sees sums alone."""
        model, context = cls.__new__(cls), rows.sparkSession.sparkContext

        def sums(tree: _Tree) -> np.ndarray:
            shared = context.broadcast((model, tree))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                (grown, tree), out = shared.value, 0
                for batch in batches:
                    out = out + grown.cells(unpacked(batch.column(0), width), *(batch.column(k).to_numpy() for k in (1, 2)), tree)
                if not isinstance(out, int):
                    flat = out.reshape(-1, 3)
                    k = np.flatnonzero(flat[:, 2])
                    yield pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(flat[k, c]) for c in range(3))], ["k", "g", "h", "c"])

            found = rows.select("x", "y", "n").mapInArrow(run, "k long, g long, h long, c long").groupBy("k").sum("g", "h", "c").toArrow()
            shared.unpersist()
            out = np.zeros((2**DEPTH * width * BINS, 3), np.int64)
            out[found.column(0).to_numpy()] = np.stack([found.column(c).to_numpy() for c in (1, 2, 3)], 1)
            return out.reshape(2**DEPTH, width, BINS, 3)

        model._fit(width, total, positive, sums)
        return model

    def _fit(self, width: int, total: int, positive: int, sums: Callable[[_Tree], np.ndarray]) -> None:
        share = np.clip(positive / total, 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        self.trees: list[_Tree] = []
        for _ in range(TREES):
            self.trees.append(self._grow(sums))

    def cells(self, x: np.ndarray, y: np.ndarray, count: np.ndarray, tree: _Tree) -> np.ndarray:
        """int64[node of the tree's last level, feature, value, (gradient, curvature, count)], of rows that reach that level."""
        p = 1 / (1 + np.exp(-self._margin(x)))
        node, level = self._nodes(tree, x), len(tree) // 2
        at = node >= level
        g, h = (np.rint(v * SCALE).astype(np.int64) * count for v in (y - p, p * (1 - p)))
        out = np.zeros((2**DEPTH, x.shape[1], BINS, 3), np.int64)
        for feature in range(x.shape[1]):
            cell = (node[at] - level) * BINS + x[at, feature]
            for c, v in enumerate((g, h, count)):
                sums = np.zeros(2**DEPTH * BINS, np.int64)
                np.add.at(sums, cell, v[at])
                out[:, feature, :, c] = sums.reshape(2**DEPTH, BINS)
        return out

    def _grow(self, sums: Callable[[_Tree], np.ndarray]) -> _Tree:
        """A full binary tree by level order: (feature, greatest value that goes left, leaf value)."""
        tree: _Tree = [(-1, 0, 0.0)]
        value = lambda g, h: RATE * float(g / SCALE / (h / SCALE + 1))
        for level in range(DEPTH):
            first, found = 2**level - 1, sums(tree)
            tree += [(-1, 0, 0.0)] * 2 ** (level + 1)
            for node in range(first, 2 * first + 1):
                own = found[node - first]
                total_g, total_h, n = own[0].sum(0).tolist()
                if not n:
                    continue
                if not level:
                    tree[node] = (-1, 0, value(total_g, total_h))
                if n < 2 * LEAST:
                    continue
                left = own.cumsum(1)[:, :-1]
                left_g, left_h, count = left[..., 0] / SCALE, left[..., 1] / SCALE, left[..., 2]
                all_g, all_h = total_g / SCALE, total_h / SCALE
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                gain[(count < LEAST) | (n - count < LEAST)] = -1
                # Of equal gains the last feature's, as the first place within it.
                best = max([(1e-6, -1, 0), *((float(v.max()), f, int(v.argmax())) for f, v in enumerate(gain))])
                if best[1] >= 0:
                    g, h, _ = left[best[1], best[2]].tolist()
                    tree[node] = (best[1], best[2], 0.0)
                    tree[2 * node + 1] = (-1, 0, value(g, h))
                    tree[2 * node + 2] = (-1, 0, value(total_g - g, total_h - h))
        return tree

    @staticmethod
    def _nodes(tree: _Tree, x: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        feature = np.array([t[0] for t in tree])
        cut = np.array([t[1] for t in tree])
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            inner = feature[node] >= 0
            right = x[np.arange(len(x)), np.maximum(feature[node], 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node

    def _margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for tree in self.trees:
            f += np.array([t[2] for t in tree])[self._nodes(tree, x)]
        return f

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._margin(clipped(x))))


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of bytes as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def fit(rows: DataFrame, width: int, local_rows: int | None = None) -> Boosted | None:
    """Trees from all rows (x, y, n); none unless both labels are there. The rows are read often: a written table."""
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    one = rows.selectExpr("count(*) as rows", "coalesce(sum(n), 0) as n", "coalesce(sum(n * y), 0) as y").first()
    if not 0 < one.y < one.n:
        return None
    if one.rows > local_rows:
        return Boosted.of(rows, width, one.n, one.y)
    found = rows.select("x", "y", "n").toArrow()
    return Boosted(unpacked(found.column(0), width), found.column(1).to_numpy(), found.column(2).to_numpy())
