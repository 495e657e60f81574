"""Regression trees on binned columns: boosted (squared or logistic loss) and bagged.

A grid search is hundreds of models, each on all training rows: Spark deals (grid point, fold) pairs to tasks
(``search.py``), and a task trains its model here, a level of a tree at a time: the gradient sums of the open nodes,
columns and bins are filled by one ``bincount`` a column and searched by their running sums, some nodes at a
time if they are many. A model of n trees is the first n trees of a longer one, and a bagged tree of a small depth the top of
a deeper one (``Forest.predict(x, n, depth)``), so that the grid's tree counts and bagged depths share one training.

NULL and NaN inputs count as larger than any value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32
#: (Node, column, bin) cells whose sums a level of a tree holds at a time.
CELLS = 1 << 18
#: Rows whose cells are counted at a time where the nodes are few: they stay in the processor's cache.
PART = 1 << 15
#: Rows that walk down the trees at a time: their places stay in the processor's cache.
BLOCK = 512


@dataclass
class Forest:
    """Nodes of all trees in arrays: feature (-1: leaf), bound, left child (the right one follows), value, gain; roots.

    ``mean``: predictions are the trees' mean (bagging), else ``base`` and their sum (boosting).
    """

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    roots: np.ndarray
    base: float = 0.0
    mean: bool = False

    def walker(self) -> "Walker":
        """What scoring needs, in small types; made once."""
        if "_walker" not in self.__dict__:
            self._walker = Walker.of(self)
        return self._walker

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def leaves(self, x: np.ndarray, trees: int, depth: int | None = None) -> np.ndarray:
        """The node of each row (first axis) in each tree, at most ``depth`` levels down."""
        return self.walker().leaves(x, trees, depth)

    def predict(self, x: np.ndarray, trees: int | None = None, depth: int | None = None) -> np.ndarray:
        return self.walker().predict(x, trees, depth)

    def importance(self, width: int) -> np.ndarray:
        """Each column's share of the gain of all splits."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], self.gain[inner], width)
        return total / total.sum() if total.sum() > 0 else total

    def part(self, start: int, end: int) -> "Forest":
        """The trees from ``start`` up to ``end``."""
        ends = np.append(self.roots, len(self.feature))
        here = slice(ends[start], ends[end])
        return Forest(self.feature[here], self.bound[here], self.left[here] - ends[start], self.value[here], self.gain[here], self.roots[start:end] - ends[start], self.base, self.mean)

    def first(self, trees: int) -> "Forest":
        return self.part(0, min(trees, len(self.roots)))


@dataclass
class Walker:
    """A forest's nodes for scoring, some 14 bytes each: a bound is its number among its column's bounds, and a leaf leads to itself."""

    bounds: list
    feature: np.ndarray
    code: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    mean: bool

    @classmethod
    def of(cls, f: Forest) -> "Walker":
        inner = np.flatnonzero(f.feature >= 0)
        columns, cuts_of = f.feature[inner], f.bound[inner]
        bounds = [np.unique(cuts_of[columns == c]) for c in range(int(columns.max(initial=-1)) + 1)]
        most = max([0, *map(len, bounds)])  # the code of a leaf: no value has a larger one
        code = np.full(len(f.feature), most, np.uint8 if most < 256 else np.int64)
        for c, b in enumerate(bounds):
            code[inner[columns == c]] = np.searchsorted(b, cuts_of[columns == c])
        left = np.arange(len(f.feature), dtype=np.int32 if len(f.feature) < 1 << 31 else np.int64)
        left[inner] = f.left[inner]
        feature = np.zeros(len(f.feature), np.uint8 if len(bounds) < 256 else np.int64)
        feature[inner] = columns
        return cls(bounds, feature, code, left, f.value, f.roots, f.base, f.mean)

    def leaves(self, x: np.ndarray, trees: int, depth: int | None = None) -> np.ndarray:
        at, width = np.repeat(self.roots[None, :trees], len(x), 0), len(self.bounds)
        if not at.size or not width:
            return at
        codes = np.stack([np.searchsorted(b, x[:, c], side="left") for c, b in enumerate(self.bounds)], 1).ravel()  # a value beyond a bound has a larger code
        first = (np.arange(len(x)) * width)[:, None]
        while depth is None or depth > 0:
            depth = None if depth is None else depth - 1
            below = self.left.take(at) + (codes.take(self.feature.take(at) + first) > self.code.take(at))
            if np.array_equal(below, at):
                break
            at = below
        return at

    def predict(self, x: np.ndarray, trees: int | None = None, depth: int | None = None) -> np.ndarray:
        trees = len(self.roots) if trees is None else trees
        out = np.zeros(len(x))
        for k in range(0, len(x), BLOCK):
            v = self.value[self.leaves(x[k:k + BLOCK], trees, depth)]
            out[k:k + BLOCK] = v.mean(1) if self.mean else self.base + v.sum(1)
        return out


def filled(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), np.inf, x)


def cuts(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Values between the bins of each column, at most ``bins`` - 1 of them."""
    out = []
    for column in x.T:
        values = np.unique(column)
        out.append(values[:-1] if len(values) <= bins else np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower")))
    return out


def _cells(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """Columns x rows: bin k of a column holds the values up to its k-th bound."""
    out = np.zeros((len(bounds), len(x)), np.uint8 if all(len(b) < 256 for b in bounds) else np.int32)
    for c, b in enumerate(bounds):
        out[c] = np.searchsorted(b, x[:, c], side="left")
    return out


def _best_splits(cells: np.ndarray, g: np.ndarray, h: np.ndarray | None, rows: np.ndarray, node: np.ndarray, k: int, l2: float, least: float, bins: int):
    """(column, bin, gain, gradient and weight up to the bin, those of the node) for each of ``k`` nodes; ``h`` None: rows weigh 1."""
    width, whole = len(cells), len(rows) == cells.shape[1] and k * bins < PART  # whole: rows are all, in their order
    gs, hs = np.zeros((k, width, bins)), np.zeros((k, width, bins))
    step = PART if k * bins < PART else max(1, len(rows))
    for i in range(0, len(rows), step):
        part = slice(i, i + step)
        start, gp, hp = node[part] * bins, g[part], None if h is None else h[part]
        for c in range(width):
            cell = start + (cells[c, part] if whole else cells[c].take(rows[part]))
            gs[:, c] += np.bincount(cell, gp, k * bins).reshape(k, bins)
            hs[:, c] += np.bincount(cell, hp, k * bins).reshape(k, bins)
    np.cumsum(gs, 2, out=gs)
    np.cumsum(hs, 2, out=hs)
    gt, ht = gs[:, :1, -1:].copy(), hs[:, :1, -1:].copy()
    rest = ht - hs
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gs * gs / (hs + l2) + (gt - gs) ** 2 / (rest + l2) - gt * gt / (ht + l2)
    gain[(hs < least) | (rest < least) | ~np.isfinite(gain)] = 0
    pick, at = gain.reshape(k, -1).argmax(1), np.arange(k)
    return pick // bins, pick % bins, *(v.reshape(k, -1)[at, pick] for v in (gain, gs, hs)), gt[:, 0, 0], ht[:, 0, 0]


def _grow(cells: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int | None, l2: float, least: float, bins: int):
    """One tree on gradients and weights: (feature, bin, left, value, gain) by node, and each row's node.

    The sums of at most ``CELLS`` (node, column, bin) cells are held at a time, whatever the rows and open nodes.
    """
    width, n = cells.shape
    total = h.sum() + l2
    nodes = [[np.array([-1]), np.array([0]), np.array([-1]), np.array([g.sum() / total if total > 0 else 0.0]), np.array([0.0])]]
    rows = np.flatnonzero(h > 0)
    unit = bool((h[rows] == 1).all())
    node, where, size, ids, level = np.zeros(len(rows), np.int64), np.zeros(n, np.int64), 1, np.zeros(1, np.int64), 0
    some = max(1, CELLS // max(1, width * bins))
    while len(ids) and len(rows) and width and (depth is None or level < depth):
        k, level = len(ids), level + 1
        if k > some:  # rows of a node in their order, nodes one after another
            order = np.argsort(node, kind="stable")
            rows, node = rows[order], node[order]
        found = []
        for j in range(0, k, some):
            here = slice(*np.searchsorted(node, (j, j + some))) if k > some else slice(None)
            r = rows[here]
            found.append(_best_splits(cells, g[r], None if unit else h[r], r, node[here] - j, min(some, k - j), l2, least, bins))
        f, b, best, gl, hl, gt, ht = (np.concatenate(v) for v in zip(*found))
        good = best > 1e-9 * (1 + np.abs(gt))
        split = np.flatnonzero(good)
        first, left = np.full(k, -1), np.full(k, -1)  # first child of a split node among the new nodes, and in the tree
        first[split] = np.arange(len(split)) * 2
        left[split] = size + first[split]
        last, own = nodes[-1], ids - (size - len(nodes[-1][0]))
        for part, v in zip((0, 1, 2, 4), (f, b, left, best)):
            last[part][own[split]] = v[split]
        gl, hl, gt, ht = gl[split], hl[split], gt[split], ht[split]
        new, weight = 2 * len(split), np.stack([hl, ht - hl], 1).ravel()
        nodes.append([np.full(new, -1), np.zeros(new, np.int64), np.full(new, -1), np.stack([gl / (hl + l2), (gt - gl) / (ht - hl + l2)], 1).ravel(), np.zeros(new)])
        opened = weight >= 2 * least  # what is too light for two leaves stays one
        at = np.where(opened, np.cumsum(opened) - 1, -1)
        go = good[node]
        rows, node = rows[go], node[go]
        side = cells.ravel().take(f[node] * n + rows) > b[node]
        where[rows] = left[node] + side
        node = at[first[node] + side] if len(rows) else node
        rows, node = rows[node >= 0], node[node >= 0]
        ids, size = size + np.flatnonzero(opened), size + new
    return (*(np.concatenate(v) for v in zip(*nodes)), where)


def _pack(trees: list, bounds: list[np.ndarray], base: float, mean: bool) -> Forest:
    sizes = [len(t[0]) for t in trees]
    roots = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64) if trees else np.zeros(0, np.int64)
    flat = [np.concatenate([np.asarray(t[k]) for t in trees]) if trees else np.zeros(0) for k in range(5)]
    feature, left = flat[0].astype(np.int32), flat[2].astype(np.int64) + np.repeat(roots, sizes)
    # the last bin has no bound above it: a split there cannot be chosen, since nothing lies beyond
    table, inner, bound = np.zeros((len(bounds), max([1, *map(len, bounds)]))), feature >= 0, np.zeros(len(feature))
    for c, v in enumerate(bounds):
        table[c, :len(v)] = v
    bound[inner] = table[feature[inner], flat[1][inner].astype(int)]
    return Forest(feature, bound, left, flat[3].astype(float), flat[4].astype(float), roots, base, mean)


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 100, depth: int = 3, rate: float = 0.1, l2: float = 1.0, least: float = 1.0,
          subsample: float = 1.0, logistic: bool = False, seed: int = 42, bins: int = BINS) -> Forest:
    """Gradient boosting; ``least`` is the smallest weight (hessian) of a leaf. Logistic: margins (log odds) from 0/1 labels."""
    w = np.ones(len(y)) if weight is None else weight.astype(float)
    if not len(y):
        return _pack([], [], 0.0, False)
    mean = float(np.average(y, weights=w)) if w.sum() > 0 else 0.0
    base = float(np.log((mean + 1e-9) / (1 - mean + 1e-9))) if logistic else mean
    bounds = cuts(x, bins)
    cells, now, out = _cells(x, bounds), np.full(len(y), base), []
    rng = np.random.default_rng(seed)
    for _ in range(trees):
        if logistic:
            p = 1 / (1 + np.exp(-now))
            g, h = w * (y - p), w * p * (1 - p)
        else:
            g, h = w * (y - now), w
        if subsample < 1:
            keep = rng.random(len(y)) < subsample
            g, h = g * keep, h * keep
        feature, at_bin, left, value, gain, where = _grow(cells, g, h, depth, l2, least, bins)
        value = value * rate
        tree = (feature, at_bin, left, value, gain)
        if subsample < 1:  # rows left out of the growing find their leaf by walking
            now = now + _pack([tree], bounds, 0.0, False).predict(x)
        else:
            now = now + value[where]
        out.append(tree)
    return _pack(out, bounds, base, False)


def bag(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int | None = None, least: float = 5.0, seed: int = 42, bins: int = BINS, skip: int = 0) -> Forest:
    """Bagged trees on bootstrap draws, all columns at every split; without a depth they grow until ``least`` stops them.

    ``skip``: the first trees' draws are made, but the trees are not grown."""
    if not len(y):
        return _pack([], [], 0.0, True)
    bounds = cuts(x, bins)
    cells, rng, out = _cells(x, bounds), np.random.default_rng(seed), []
    for k in range(trees):
        drawn = rng.integers(0, len(y), len(y))
        if k < skip:
            continue
        h = np.bincount(drawn, minlength=len(y)).astype(float)
        out.append(_grow(cells, h * y, h, depth, 0.0, least, bins)[:5])
    return _pack(out, bounds, 0.0, True)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, steps: int = 50) -> np.ndarray:
    """Coefficients and, last, intercept of a logistic regression: weighted loss times ``c`` plus half the squared coefficients."""
    a = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], 1.0 / c), 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -500, 500)))
        grad = a.T @ (weight * (p - y)) + ridge * beta
        hess = (a.T * (weight * np.maximum(p * (1 - p), 1e-9))) @ a + np.diag(ridge + 1e-12)
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def shapley(forest: Forest, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Exact interventional Shapley values of a boosted forest's sum: rows x columns.

    A value is the mean, over background rows, of the column's part in the difference between the row's and the background row's
    prediction. For one leaf, only columns on its path matter: those whose bounds the row alone meets (a of
    them) and those the background row alone meets (b) share the leaf's value by (a - 1)! b! / (a + b)! and
    -a! (b - 1)! / (a + b)!; a column that neither meets keeps every mixture of the two out of the leaf.
    """
    n, m, width = len(x), len(background), x.shape[1]
    phi = np.zeros((n, width))
    size = width + 2
    fact = np.cumprod([1.0, *range(1, 2 * size)])
    a, b = np.indices((size, size))
    plus = np.where(a > 0, fact[np.maximum(a - 1, 0)] * fact[b] / fact[a + b], 0.0)
    minus = np.where(b > 0, fact[a] * fact[np.maximum(b - 1, 0)] / fact[a + b], 0.0)
    for root in forest.roots.tolist():
        open_nodes = [(root, {})]
        while open_nodes:
            node, path = open_nodes.pop()
            f = int(forest.feature[node])
            if f >= 0:
                low, high = path.get(f, (-np.inf, np.inf))
                cut, child = float(forest.bound[node]), int(forest.left[node])
                open_nodes.append((child, path | {f: (low, min(high, cut))}))
                open_nodes.append((child + 1, path | {f: (max(low, cut), high)}))
                continue
            if not path:
                continue
            cols = list(path)
            low, high = np.array([path[c][0] for c in cols]), np.array([path[c][1] for c in cols])
            # the smallest bin has no bound below it, the largest none above
            mine = ((x[:, cols] > low) | np.isneginf(low)) & (x[:, cols] <= high)
            theirs = ((background[:, cols] > low) | np.isneginf(low)) & (background[:, cols] <= high)
            mine, theirs = mine.astype(float), theirs.astype(float)
            n_a, n_b = (mine @ (1 - theirs).T).astype(int), ((1 - mine) @ theirs.T).astype(int)
            alive = ((1 - mine) @ (1 - theirs).T) == 0
            share = forest.value[node] / m
            phi[:, cols] += share * (mine * ((plus[n_a, n_b] * alive) @ (1 - theirs)) - (1 - mine) * ((minus[n_a, n_b] * alive) @ theirs))
    return phi


def paths(forest: Forest) -> list[tuple[float, list[int], np.ndarray, np.ndarray]]:
    """(value, columns, lower bounds, upper bounds) of every leaf: a row in it lies beyond the lower and up to the upper ones."""
    out = []
    for root in forest.roots.tolist():
        open_nodes = [(root, {})]
        while open_nodes:
            node, path = open_nodes.pop()
            f = int(forest.feature[node])
            if f >= 0:
                low, high = path.get(f, (-np.inf, np.inf))
                cut, child = float(forest.bound[node]), int(forest.left[node])
                open_nodes.append((child, path | {f: (low, min(high, cut))}))
                open_nodes.append((child + 1, path | {f: (max(low, cut), high)}))
            else:
                out.append((float(forest.value[node]), list(path), np.array([v[0] for v in path.values()]), np.array([v[1] for v in path.values()])))
    return out


def met(path: tuple, columns: list[np.ndarray]) -> np.ndarray:
    """Which of a leaf's conditions each row meets, a bit for each of its columns."""
    out = np.zeros(len(columns[0]) if columns else 0, np.int64)
    for k, (c, low, high) in enumerate(zip(*path[1:])):
        x = columns[c]
        out |= ((x <= high) if np.isneginf(low) else (x > low) & (x <= high)).astype(np.int64) << k
    return out


def pattern_counts(leaves: list[tuple], x: np.ndarray) -> np.ndarray:
    """How many rows meet which conditions of each leaf: 2 ** columns numbers a leaf, one leaf after another."""
    columns = [np.ascontiguousarray(c) for c in x.T]
    return np.concatenate([np.bincount(met(p, columns), minlength=1 << len(p[1])) for p in leaves]) if leaves else np.zeros(0, np.int64)


def _shares(d: int) -> np.ndarray:
    """[row's conditions, background row's conditions, column]: the column's share of a leaf's value, as in ``shapley``."""
    bits = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(bool)
    mine, theirs = bits[:, None, :], bits[None, :, :]
    a, b = (mine & ~theirs).sum(2), (theirs & ~mine).sum(2)
    fact = np.cumprod([1.0, *range(1, 2 * d + 2)])
    plus = np.where(a > 0, fact[np.maximum(a - 1, 0)] * fact[b] / fact[a + b], 0.0)
    minus = np.where(b > 0, fact[a] * fact[np.maximum(b - 1, 0)] / fact[a + b], 0.0)
    alive = (mine | theirs).all(2)[:, :, None]
    return alive * (plus[:, :, None] * (mine & ~theirs) - minus[:, :, None] * (theirs & ~mine))


def shapley_tables(leaves: list[tuple], counts: np.ndarray) -> list[np.ndarray]:
    """Per leaf, the parts of its columns for each set of conditions that a row may meet, over the background that ``counts`` holds.

    The background enters ``shapley`` only by which of a leaf's conditions its rows meet, so that counts of these
    stand for any number of rows.
    """
    shares, out, at = {}, [], 0
    for value, cols, _, _ in leaves:
        n = counts[at:at + (1 << len(cols))]
        at += 1 << len(cols)
        if len(cols) not in shares:
            shares[len(cols)] = _shares(len(cols))
        out.append(value / n.sum() * np.tensordot(n.astype(float), shares[len(cols)], (0, 1)))
    return out


def shapley_of_tables(leaves: list[tuple], tables: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """``shapley`` of rows over a counted background: rows x columns."""
    columns, phi = [np.ascontiguousarray(c) for c in x.T], np.zeros(x.shape[::-1])
    for path, table in zip(leaves, tables):
        seen = met(path, columns)
        for k, c in enumerate(path[1]):
            phi[c] += table[:, k].take(seen)
    return phi.T
