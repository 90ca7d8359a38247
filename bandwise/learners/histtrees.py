"""Regression trees grown from histograms, many at once, and ensembles of them as flat arrays.

``Binner`` turns features into bin numbers once per fit: numeric columns by sketch quantiles with a bin of its
own for missing values, nominal columns by category number, whatever their number of levels. A tree
is grown from sums per (node, column, bin) that one pass over the blocks yields for all
open nodes of all trees that are being fitted (``Growing``). A numeric split sends the missing bin to the better
side; a nominal split orders the categories of the node by their mean gradient and cuts that order,
which is the best subset for a one-dimensional target (Fisher, 1958). Among the nodes those with the
greatest gains are opened, at most ``max_leaf_nodes`` leaves.

Of two sibling nodes only the one with fewer rows is counted, the other is its parent less that one.

``Ensemble`` holds all trees in arrays (column, children, value, and for each inner node the bins that go
left) and scores a matrix of bins in a few NumPy steps a tree, the same in training and prediction: for each
column that a tree uses, a table gives the leaves that a bin leaves open as bits, and their conjunction is the row's leaf;
``ensemble_columns`` applies several of them to a table in one Arrow call, so a plan does not grow
with the number of trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.learners.common import arrow_columns


@dataclass(frozen=True)
class Binner:
    """Upper edges of the bins of each numeric column; number of categories of each nominal one."""

    edges: tuple
    levels: tuple  # 0 for a numeric column

    @property
    def widths(self) -> np.ndarray:
        """Bins of each column: numeric ones and one for missing; categories and one for none of them."""
        return np.array([(n or len(e) + 1) + 1 for e, n in zip(self.edges, self.levels)], np.int64)

    @property
    def kind(self) -> str:
        return "u1" if self.widths.max(initial=1) <= 256 else "<u2" if self.widths.max() <= 65536 else "<u4"

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, self.kind)
        for j, (e, n) in enumerate(zip(self.edges, self.levels)):
            gone = np.isnan(x[:, j])
            if n:
                v = np.where(gone, n, x[:, j])
                out[:, j] = np.where((v >= 0) & (v < n), v, n)
            else:
                out[:, j] = np.where(gone, len(e) + 1, np.searchsorted(e, x[:, j]))
        return out


def fit_bins(df: DataFrame, features: Sequence[str], nominal: Mapping[str, int] | None = None, bins: int = 64,
             accuracy: int = 10_000, where: Mapping[int, Column] | None = None) -> dict[int, Binner]:
    """A ``Binner`` for each subset of rows in ``where`` (default: one of all rows, under 0), in one aggregate."""
    nominal = dict(nominal or {})
    where = where or {0: F.lit(True)}
    probs = [i / bins for i in range(1, bins)]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    aggs = [F.percentile_approx(F.when(cond, value(c)), probs, accuracy).alias(f"{k}_{j}")
            for k, cond in where.items() for j, c in enumerate(features) if c not in nominal]
    row = df.agg(*aggs).first() if aggs else {}
    return {k: Binner(tuple(np.zeros(0) if c in nominal else np.unique(row[f"{k}_{j}"] or []).astype(float) for j, c in enumerate(features)),
                      tuple(nominal.get(c, 0) for c in features)) for k in where}


class Columns:
    """Bins by column as index numbers, made once for all trees that look at the rows."""

    def __init__(self, bins: np.ndarray):
        self.x = bins.T.astype(np.intp, order="C")

    def __len__(self) -> int:
        return self.x.shape[1]

    @staticmethod
    def of(bins: "np.ndarray | Columns") -> "Columns":
        return bins if isinstance(bins, Columns) else Columns(bins)


@dataclass
class Tree:
    """Nodes in order of creation: column (-1 for a leaf), children, value, bins that go left."""

    column: list = field(default_factory=lambda: [-1])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    goes: list = field(default_factory=lambda: [None])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, goes: np.ndarray) -> tuple[int, int]:
        a = len(self.column)
        self.column[node], self.goes[node], self.left[node], self.right[node] = column, goes, a, a + 1
        for _ in range(2):
            self.column.append(-1), self.left.append(-1), self.right.append(-1), self.goes.append(None), self.value.append(0.0)
        return a, a + 1

    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.column) if c < 0]


#: 2^i times this number has i's place in its 6 highest bits
_DEBRUIJN = np.uint64(0x03F79D71B4CB0A89)
#: The tables of leaves as bits hold for so many leaves, and columns of so many bins.
MASK_LEAVES, MASK_BINS = 64, 4096


class Ensemble:
    """Trees in flat arrays; ``start`` is the prediction before the first of them."""

    def __init__(self, trees: Sequence[Tree], binner: Binner, start: float = 0.0):
        self.binner, self.start = binner, start
        self.roots = np.cumsum([0] + [len(t.column) for t in trees])[:-1].astype(np.int32)
        cat = lambda name, kind: np.array([v for t in trees for v in getattr(t, name)], kind)
        self.column, self.value = cat("column", np.int32), cat("value", float)
        shift = np.repeat(self.roots, [len(t.column) for t in trees]).astype(np.int32)
        self.left, self.right = cat("left", np.int32) + shift, cat("right", np.int32) + shift
        sets = [g for t in trees for g in t.goes]
        size = np.array([0 if g is None else len(g) for g in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        self.size = size
        self.goes = np.concatenate([g for g in sets if g is not None]) if size.any() else np.zeros(1, bool)
        self.depth = [_depth(t) for t in trees]
        self._masks: dict[int, tuple | None] = {}

    def masks(self, tree: int) -> tuple | None:
        """(columns with, for each of their bins, the leaves it leaves open as bits; node number at each leaf's place)."""
        if tree not in self._masks:
            start = int(self.roots[tree])
            end = int(self.roots[tree + 1]) if tree + 1 < len(self.roots) else len(self.column)
            leaves = [i for i in range(start, end) if self.column[i] < 0]
            if len(leaves) > MASK_LEAVES or self.size[start:end].max() > MASK_BINS:
                self._masks[tree] = None
                return None
            under = {v: 1 << i for i, v in enumerate(leaves)}
            tables: dict[int, np.ndarray] = {}
            for i in range(end - 1, start - 1, -1):  # children come after their parent
                c = int(self.column[i])
                if c < 0:
                    continue
                left, right = under[int(self.left[i])], under[int(self.right[i])]
                under[i] = left | right
                goes = self.goes[self.at[i]: self.at[i] + self.size[i]]
                shut = np.where(goes, np.uint64(right), np.uint64(left))
                tables[c] = tables.get(c, np.full(len(goes), np.iinfo(np.uint64).max, np.uint64)) & ~shut
            node = np.zeros(64, np.int32)
            node[(np.uint64(1) << np.arange(len(leaves), dtype=np.uint64)) * _DEBRUIJN >> np.uint64(58)] = leaves
            if tables:  # bits above the last leaf's are open nowhere
                first = next(iter(tables))
                tables[first] = tables[first] & np.uint64((1 << len(leaves)) - 1)
            self._masks[tree] = (tuple(tables.items()), node)
        return self._masks[tree]

    def _place(self, x: np.ndarray, tables: tuple) -> np.ndarray:
        """Place of every row's leaf in a table of 64."""
        bits = None
        for c, table in tables:
            open_ = table.take(x[c])
            bits = open_ if bits is None else np.bitwise_and(bits, open_, out=bits)
        bits *= _DEBRUIJN
        bits >>= np.uint64(58)
        return bits.view(np.int64)

    def leaf(self, bins: np.ndarray | Columns, tree: int) -> np.ndarray:
        """Number of the leaf of every row, among all nodes."""
        if self.depth[tree] == 0:
            return np.full(len(bins), self.roots[tree], np.int32)
        cols, masks = Columns.of(bins), self.masks(tree)
        if masks is not None:
            return masks[1].take(self._place(cols.x, masks[0]))
        node = np.full(len(cols), self.roots[tree], np.int32)
        rows = np.arange(len(cols))
        for _ in range(self.depth[tree]):
            c = self.column[node]
            inner = c >= 0
            b = cols.x[np.maximum(c, 0), rows]
            left = self.goes[np.where(inner, self.at[node] + b, 0)]
            node = np.where(inner, np.where(left, self.left[node], self.right[node]), node)
        return node

    def predict(self, bins: np.ndarray | Columns) -> np.ndarray:
        out = np.full(len(bins), self.start)
        cols = Columns.of(bins) if len(self.roots) else None
        for t in range(len(self.roots)):
            masks = self.masks(t) if self.depth[t] else None
            out += self.value[masks[1]].take(self._place(cols.x, masks[0])) if masks else self.value[self.leaf(cols, t)]
        return out


def _depth(t: Tree) -> int:
    depth = [0] * len(t.column)
    for i, c in enumerate(t.column):  # children come after their parent
        if c >= 0:
            depth[t.left[i]] = depth[t.right[i]] = depth[i] + 1
    return max(depth)


class Growing:
    """One tree in growth: which nodes need sums next, and what the sums decide.

    ``counted`` are the nodes whose sums the next pass yields: of two siblings the smaller one, whether open or not.
    ``sums`` for a node are n and the gradient sum G of every (column, bin); a split gains
    ``GL^2/(nL+l2) + GR^2/(nR+l2) - G^2/(n+l2)``. ``rng`` and ``tried`` restrict a node to a random choice of columns.
    """

    def __init__(self, binner: Binner, max_depth: int, max_leaves: int, min_rows: float, l2: float, rng: np.random.Generator | None = None, tried: int | None = None):
        self.binner, self.max_depth, self.max_leaves, self.min_rows, self.l2 = binner, max_depth, max_leaves, min_rows, l2
        self.rng, self.tried = rng, tried
        self.widths = binner.widths
        self.at = np.concatenate([[0], np.cumsum(self.widths)])
        self.tree = Tree()
        self.open = [0]       # nodes that may be split next
        self.counted = [0]
        self.held: dict[int, np.ndarray] = {}  # split nodes' sums, for the children that are not counted
        self.rest: dict[int, tuple] = {}       # open node that is not counted -> (parent, sibling)
        self.depth = {0: 0}
        self.key = {0: np.inf}   # least gain on the way to a node: best-first growth opens nodes in this order
        self.found: dict[int, tuple] = {}  # node -> (gain, column, bins to the left)
        self.size = len(self.counted) * int(self.at[-1]) * 2

    def flat(self) -> Ensemble:
        return Ensemble([self.tree], self.binner)

    def slots(self) -> np.ndarray:
        """Place of each node's sums in the vector; -1 for nodes that are not counted."""
        out = np.full(len(self.tree.column), -1, np.int64)
        out[self.counted] = np.arange(len(self.counted))
        return out

    def histogram(self, bins: np.ndarray, slot: np.ndarray, kinds: Sequence[np.ndarray]) -> np.ndarray:
        """Sums of each of ``kinds`` (weights of the rows) by (counted node, column, bin)."""
        rows = np.flatnonzero(slot >= 0)
        slot, width, nodes = slot[rows], int(self.at[-1]), len(self.counted)
        out = np.zeros((len(kinds), nodes, width))
        for j, w in enumerate(self.widths):
            idx = slot * w + bins[rows, j]
            for k, v in enumerate(kinds):
                out[k, :, self.at[j]: self.at[j + 1]] = np.bincount(idx, v[rows], nodes * w).reshape(nodes, w)
        return out.ravel()

    def grow(self, sums: np.ndarray, gradient: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> bool:
        """Take (n, G) sums of the counted nodes; True while further nodes are open.

        With ``gradient`` the second sums are others, of which (with n) it makes G.
        """
        sums = sums.reshape(2, len(self.counted), -1)
        of = {node: sums[:, i] for i, node in enumerate(self.counted)}
        for node, (parent, sibling) in self.rest.items():
            of[node] = self.held[parent] - of[sibling]
        for node in self.open:
            n, g = of[node]
            best = self._best(n, gradient(n, g) if gradient else g)
            if best:
                self.found[node] = best
                self.key[node] = min(self.key[node], best[0])
        todo = [v for v in self.open if v in self.found]
        # with L leaves there are L - 1 splits, those of the greatest keys: others are never opened
        order = sorted(self.found, key=lambda v: -self.key[v])[: self.max_leaves - 1]
        nodes, self.counted, self.held, self.rest = [], [], {}, {}
        for v in todo:
            if v not in order:
                continue
            gain, column, goes, big = self.found[v]
            pair = self.tree.split(v, column, goes)
            for child, enough in zip(pair, big):
                self.depth[child], self.key[child] = self.depth[v] + 1, self.key[v]
                if self.depth[child] < self.max_depth and enough:
                    nodes.append(child)
            if pair[0] in nodes or pair[1] in nodes:
                rows = of[v][0, self.at[column]: self.at[column + 1]]
                few, many = pair if 2 * rows[goes].sum() <= rows.sum() else pair[::-1]
                self.counted.append(few)
                if many in nodes:
                    self.held[v], self.rest[many] = of[v], (v, few)
        self.open = nodes
        self.size = len(self.counted) * int(self.at[-1]) * 2
        return bool(nodes)

    def _best(self, n: np.ndarray, g: np.ndarray):
        total, grad = n[: self.widths[0]].sum(), g[: self.widths[0]].sum()
        if total < 2 * self.min_rows:
            return None
        base, best = grad * grad / (total + self.l2), None
        columns = range(len(self.widths))
        if self.tried and self.rng is not None and self.tried < len(self.widths):
            columns = sorted(self.rng.permutation(len(self.widths))[: self.tried].tolist())
        for j in columns:
            a, b = self.at[j], self.at[j + 1]
            nj, gj = n[a:b], g[a:b]
            if self.binner.levels[j]:
                has = np.flatnonzero(nj > 0)
                order = has[np.argsort(gj[has] / nj[has], kind="stable")]
                options = [(np.cumsum(nj[order])[:-1], np.cumsum(gj[order])[:-1], order, None)]
            else:
                left = (np.cumsum(nj[:-1]), np.cumsum(gj[:-1]))
                options = [(*left, None, False)]
                if nj[-1] > 0:
                    options.append((left[0] + nj[-1], left[1] + gj[-1], None, True))
            for nl, gl, order, gone in options:
                if not len(nl):
                    continue
                nr, gr = total - nl, grad - gl
                ok = (nl >= self.min_rows) & (nr >= self.min_rows)
                gain = np.where(ok, gl * gl / np.maximum(nl + self.l2, 1e-300) + gr * gr / np.maximum(nr + self.l2, 1e-300) - base, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > 1e-9 * max(1.0, abs(base)) and (best is None or gain[k] > best[0]):
                    goes = np.zeros(b - a, bool)
                    if order is not None:
                        goes[order[: k + 1]] = True
                    else:
                        goes[: k + 1], goes[-1] = True, bool(gone)
                    best = (float(gain[k]), j, goes, (nl[k] >= 2 * self.min_rows, nr[k] >= 2 * self.min_rows))
        return best

    def finish(self) -> Tree:
        """The tree cut to its best splits: the node that gains most is opened first, up to ``max_leaf_nodes`` leaves."""
        grown, out = self.tree, Tree()
        heap = [(-self.found[0][0], 0, 0)] if 0 in self.found and grown.column[0] >= 0 else []
        splits = 0
        while heap and splits < self.max_leaves - 1:
            _, old, new = heapq.heappop(heap)
            splits += 1
            for was, now in zip((grown.left[old], grown.right[old]), out.split(new, grown.column[old], grown.goes[old])):
                if grown.column[was] >= 0:
                    heapq.heappush(heap, (-self.found[was][0], was, now))
        return out


def side_counts(cols: Columns, slot: np.ndarray, up: np.ndarray, widths: np.ndarray, nodes: int) -> np.ndarray:
    """All rows and those with ``up``, by (counted node, column, bin): whole numbers, one count a column."""
    x = cols.x
    if slot.min(initial=0) < 0:
        rows = np.flatnonzero(slot >= 0)
        slot, up, x = slot[rows], up[rows], [c.take(rows) for c in x]
    side = slot * 2 + up
    out = np.empty((nodes, 2, int(widths.sum())))
    a = 0
    for c, w in zip(x, widths.tolist()):
        out[:, :, a: a + w] = np.bincount(side * w + c, minlength=nodes * 2 * w).reshape(nodes, 2, w)
        a += w
    return np.concatenate([(out[:, 0] + out[:, 1]).ravel(), out[:, 1].ravel()])


def ensemble_columns(df: DataFrame, features: Sequence[str], models: Mapping[str, Ensemble]) -> DataFrame:
    """``df`` with one column for each model's prediction, all from one Arrow call."""
    sent = df.sparkSession.sparkContext.broadcast(list(models.values()))

    def scores(x: np.ndarray) -> np.ndarray:
        bins: dict[int, Columns] = {}
        out = []
        for m in sent.value:
            key = id(m.binner)  # boosters of one fit share their bins
            if key not in bins:
                bins[key] = Columns(m.binner.bins(x))
            out.append(m.predict(bins[key]))
        return np.column_stack(out)

    return arrow_columns(df, features, list(models), scores)
