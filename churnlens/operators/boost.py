"""Boosted trees for many parameter sets in shared passes over the training rows (ML6–ML8).

A search fits dozens of models on the same rows.  Here they advance together: a pass over the rows serves every
model at once, each at its own round and level, so the passes of a search are those of its longest fit and not
the sum of all.  Rows are packed once into blocks of binned features.  As in PLANET (Panda et al., 2009), a pass does
two things: for large tree nodes it adds up gradient histograms per partition and reduces them to the driver (without a
shuffle, where those of all partitions are few), which finds the split; the rows of nodes with at most ``SMALL`` rows are
brought together, and a task finds all splits below at once.  What reaches the driver is bounded by models, leaves, features and bins, never by rows.

Of a table of at most ``WHOLE`` rows (``MANY`` times as many, where there are fits for half the cores) every fit gets a copy
of the binned rows by one shuffle and grows all its trees in a task of its own, by the same steps and to the same trees: a pass
per level costs more there than its sums.  A task's rows lie by the leaves of its first tree, since those of later nodes are
then mostly near each other; gradient, hessian and count of a row are added up as one complex number.

The objective is weighted log loss with Newton steps.  All nine parameters of the search space have their
meaning: trees, depth (-1: none), learning rate, leaves (the best splits of a level first), rows per leaf, shares of rows
and features per tree, and the L1 and L2 penalties of a leaf.  Gradients are summed as whole numbers, rows are drawn
by a hash of their key and features by the fit's own seed: a fit gives the same trees on any partitioning and in
any company.  Margins are part of the blocks; trees that are done are worked into them every few passes, and
every ``KEEP``-th time the new blocks are checkpointed, which cuts the lineage.

A tree is the nested tuples of ``operators.ensemble``.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .resample import md5_number

BINS = 32                                    # of a feature
ROWS = 200_000                               # of a block, a twentieth of it at least if there are cores to spare
FULL = 1 << 20                               # rows of a block, at most about
JOINT = BINS * BINS                          # cells of several features together
PART = 1 << 15                               # rows that are added up at a time, which fit a core's cache
PIECE = 1 << 13                              # rows whose numbers fit it several times
SMALL = 1 << 15                              # rows of a node that is finished in one task
FEW = 64                                     # nodes of a tree that are looked at one after the other
DIRECT = 1 << 25                             # bytes of all blocks' histograms that are added up without a shuffle
KEEP = 8                                     # renewals of the blocks until they are checkpointed
CACHED = 1 << 18                             # rows whose order matters little to a task
WHOLE = 1 << 20                              # rows of a table whose fits are a task each, of some 150 bytes a row
MANY = 8                                     # times as many where there are fits for half the cores or more
_UNIT = float(1 << 24)                       # gradients are whole multiples of 1 / _UNIT
_MIN_HESSIAN = 1e-3
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tree:
    """A tree that grows: per node the split (-1: none yet), children and value."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def arrays(self):
        return tuple(np.array(x) for x in (self.feature, self.cut, self.left, self.right, self.value)), max(self.depth)


def leaf_of(arrays, depth: int, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The node at which every row (or those numbered ``at``) of binned features ends."""
    feature, cut, left, right, _ = arrays
    if len(feature) <= FEW:
        node = np.zeros(len(x), np.uint8)
        for m in np.flatnonzero(feature >= 0).tolist():                 # parents come before their children
            here, down = node == m, x[:, feature[m]] <= int(cut[m])
            node += (here & down).view(np.uint8) * np.uint8(left[m] - m)
            node += (here & ~down).view(np.uint8) * np.uint8(right[m] - m)
        return (node if at is None else node.take(at)).astype(np.int64)
    at = np.arange(len(x)) if at is None else at
    node = np.zeros(len(at), np.int64)
    for _ in range(depth):
        f = feature[node]
        split = f >= 0
        down = np.where(x[at, np.maximum(f, 0)] <= cut[node], left[node], right[node])
        node = np.where(split, down, node)
    return node


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(rows: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Which rows a tree is grown on, by a hash of each row's mixed number and the tree's seed."""
    out = np.ones(len(rows), bool)
    for i in range(0, len(rows) if share < 1 else 0, PIECE):
        out[i:i + PIECE] = _mix(rows[i:i + PIECE] ^ np.uint64(seed)) < np.uint64(int(share * float(1 << 53)) << 11)
    return out


def _worked_in(block: dict, done: list, snaps: list) -> dict:
    """The block with finished trees added to its models' margins, and margins kept where a size is reached."""
    margins, kept = block["margins"].copy(), dict(block["kept"])
    for step, model, what in sorted([*((i, m, t) for i, m, t in done), *((i, m, s) for i, m, s in snaps)], key=lambda x: x[0]):
        if isinstance(what, int):
            kept[model, what] = margins[model][block["trained"]:].copy()
        else:
            margins[model] += what[0][4][leaf_of(*what, block["x"])]
    return {**block, "margins": margins, "kept": kept}


@dataclass
class Split:
    """The best split of a node: both sides' sums of gradient, hessian and rows, and what is known below them
    (None: not looked at; False: no split)."""
    gain: float
    feature: int
    cut: int
    sums: tuple[tuple[float, float, int], tuple[float, float, int]]
    below: list = field(default_factory=lambda: [None, None])


def _sums(x: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int) -> np.ndarray:
    """Sums of gradient, hessian and rows by node, feature and bin; ``x`` has a row for each feature.

    Many rows are added up by the bins of two features at once, whose sums are the bins' of either.
    """
    out, first, pairs = np.empty((3, nodes, len(x), BINS), np.int64), at * BINS, at * BINS * BINS
    paired = len(x) - len(x) % 2 if len(at) > 2 * nodes * BINS * BINS else 0
    for j in range(0, paired, 2):
        both = x[j].astype(np.uint16)
        both *= BINS
        both += x[j + 1]
        cell = both.astype(np.int64)
        cell += pairs
        for i, weights in enumerate((g, h, None)):
            both = np.bincount(cell, weights, nodes * BINS * BINS).reshape(nodes, BINS, BINS)
            out[i, :, j], out[i, :, j + 1] = both.sum(axis=2), both.sum(axis=1)
    for j in range(paired, len(x)):
        cell = first + x[j]
        for i, weights in enumerate((g, h, None)):
            out[i, :, j] = np.bincount(cell, weights, nodes * BINS).reshape(nodes, BINS)
    return out


def best_splits(sums: np.ndarray, features: np.ndarray, params: dict) -> tuple[list, np.ndarray]:
    """The best split of each node (False: none), the first of equal ones, and the nodes' own sums."""
    def gain_of(g, h):
        cut = np.maximum(np.abs(g) - params.get("reg_alpha", 0), 0)
        return cut * cut / (h + params.get("reg_lambda", 0) + 1e-15)

    g, h, n = sums[0] / _UNIT, sums[1] / _UNIT, sums[2]
    gl, hl, nl = (np.cumsum(a, axis=2)[:, :, :-1] for a in (g, h, n))
    own = np.stack([a[:, 0, :].sum(axis=1) for a in (g, h, n)], axis=1)
    g0, h0, n0 = (own[:, i, None, None] for i in range(3))
    gr, hr, nr = g0 - gl, h0 - hl, n0 - nl
    least = params.get("min_child_samples", 20)
    gain = gain_of(gl, hl) + gain_of(gr, hr) - gain_of(g0, h0)
    gain[(nl < least) | (nr < least) | (hl < _MIN_HESSIAN) | (hr < _MIN_HESSIAN)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    out = []
    for i, at in enumerate(flat.argmax(axis=1).tolist()):
        f, cut = divmod(at, BINS - 1)
        sides = tuple((float(a[i, f, cut]), float(b[i, f, cut]), int(c[i, f, cut])) for a, b, c in ((gl, hl, nl), (gr, hr, nr)))
        out.append(Split(float(flat[i, at]), int(features[f]), cut, sides) if flat[i, at] > 1e-12 else False)
    return out, own


def finished(x: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray, params: dict, depth: int):
    """All splits of one node and below, level by level: ``(split or False, own sums)``; ``depth`` is the node's."""
    least, limit = params.get("min_child_samples", 20), params.get("max_depth", -1)
    place = {f: i for i, f in enumerate(features.tolist())}
    top, root, at = [None], None, np.zeros(len(g), np.int64)
    parents: list[tuple[list, int]] = [(top, 0)]
    while parents:
        live = np.flatnonzero(at >= 0)
        x, g, h, at = x[:, live], g[live], h[live], at[live]
        found, own = best_splits(_sums(x, at, g, h, len(parents)), features, params)
        root = own[0] if root is None else root
        coming, number = [], np.full((len(parents), 2), -1)
        depth += 1
        for i, (split, (holder, side)) in enumerate(zip(found, parents)):
            holder[side] = split
            for s in (0, 1) if split else ():
                if (limit < 0 or depth < limit) and split.sums[s][2] >= 2 * least:
                    number[i, s] = len(coming)
                    coming.append((split.below, s))
                else:
                    split.below[s] = False
        column = np.array([place[s.feature] if s else 0 for s in found])
        cut = np.array([s.cut if s else 0 for s in found])
        at = number[at, (x[column[at], np.arange(len(at))] > cut[at]).astype(int)]
        parents = coming
    return top[0], tuple(root)


def _derivatives(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians in whole units, ``PIECE`` rows at a time."""
    g, h = np.empty(len(y)), np.empty(len(y))
    for i in range(0, len(y), PIECE):
        part = slice(i, i + PIECE)
        p = 1 / (1 + np.exp(-margin[part]))
        np.rint(w[part] * (p - y[part]) * _UNIT, out=g[part])
        np.rint(w[part] * p * (1 - p) * _UNIT, out=h[part])
    return g, h


def _answers(block: dict, orders: list):
    """For large nodes ``((model, -1), histograms)``, for each small one ``((model, node), its rows)``."""
    x = block["x"][:block["trained"]]
    for model, pending, tree, nodes, features, seed, params, small in orders:
        place = np.full(len(tree[0][0]), -1)
        place[nodes] = np.arange(len(nodes))
        use = np.flatnonzero(drawn(block["rows"][:len(x)], seed, params.get("subsample", 1.0)))
        at = place.take(leaf_of(*tree, x, use))
        rows = [use[at == i] for i in range(len(nodes))]
        use = np.concatenate(rows)
        margin = block["margins"][model][use]
        for arrays in pending:
            margin += arrays[0][4].take(leaf_of(*arrays, x, use))
        g, h = np.zeros((2, len(x)))
        g[use], h[use] = _derivatives(block["y"][use], block["w"][use], margin)
        large = np.flatnonzero(~small).tolist()
        if large:
            yield (model, -1), _node_sums(x, _joined(x, features), [rows[i] for i in large], features, g, h)
        for i in np.flatnonzero(small).tolist():
            at = rows[i]
            if len(at):
                yield (model, int(nodes[i])), [(np.stack([x[:, f].take(at) for f in features]), g[at], h[at])]


def _solved(item, orders: dict):
    """Histograms as they are; a small node's rows as all its splits."""
    (model, node), what = item
    if node < 0:
        return item
    features, params, depths = orders[model]
    x, g, h = (np.concatenate([part[i] for part in what], axis=-1) for i in range(3))
    return (model, node), finished(x, g, h, features, params, depths[node])


class Fit:
    """One model's growth: takes what is known of its nodes, splits, and says what it needs next."""

    def __init__(self, params: dict, width: int, seed: int):
        self.p, self.width, self.seed = params, width, seed
        self.trees: list[Tree] = []
        self.rounds = int(params.get("n_estimators", 100))
        self.start()

    def start(self):
        self.tree, self.frontier = Tree(), [0]
        self.known: dict[int, Split | bool | None] = {0: None}          # of the frontier's nodes
        self.rows: dict[int, int] = {}                                  # of nodes, once known
        own = random.Random(f"{self.seed}-{json.dumps(shape(self.p), sort_keys=True)}-{len(self.trees)}")
        k = max(1, int(self.p.get("colsample_bytree", 1.0) * self.width))
        self.features = np.array(sorted(own.sample(range(self.width), k)))
        self.rows_seed = own.getrandbits(63)

    @property
    def done(self) -> bool:
        return len(self.trees) >= self.rounds

    def _output(self, g: float, h: float) -> float:
        cut = max(abs(g) - self.p.get("reg_alpha", 0), 0)
        return -math.copysign(cut, g) / (h + self.p.get("reg_lambda", 0) + 1e-15) * self.p.get("learning_rate", 0.1)

    def wanted(self) -> list[int]:
        """The nodes whose splits are not known."""
        return [n for n in self.frontier if self.known[n] is None]

    def told(self, node: int, split, own) -> None:
        self.known[node] = split
        if node == 0:
            self.tree.value[0] = self._output(float(own[0]), float(own[1]))

    def grow(self) -> bool:
        """Splits level after level while all nodes of one are known, the best splits first up to the
        number of leaves; True when the tree is complete."""
        tree, limit, cap = self.tree, self.p.get("max_depth", -1), self.p.get("num_leaves", 31)
        while self.frontier and not self.wanted():
            leaves = sum(f < 0 for f in tree.feature)
            coming = []
            for node in sorted((n for n in self.frontier if self.known[n]), key=lambda n: (-self.known[n].gain, n)):
                if leaves >= cap:
                    break
                split = self.known[node]
                tree.feature[node], tree.cut[node] = split.feature, split.cut
                for side, (sums, below) in enumerate(zip(split.sums, split.below)):
                    child = len(tree.value)
                    (tree.left if side == 0 else tree.right)[node] = child
                    for column, v in ((tree.feature, -1), (tree.cut, 0), (tree.left, 0), (tree.right, 0), (tree.value, self._output(*sums[:2])),
                                      (tree.depth, tree.depth[node] + 1)):
                        column.append(v)
                    if (limit < 0 or tree.depth[child] < limit) and sums[2] >= 2 * self.p.get("min_child_samples", 20) and below is not False:
                        self.known[child], self.rows[child] = below, sums[2]
                        coming.append(child)
                leaves += 1
            self.frontier = coming if leaves < cap else []
        return not self.frontier

    def close(self) -> Tree:
        """The finished tree; the next one starts."""
        tree = self.tree
        self.trees.append(tree)
        if not self.done:
            self.start()
        return tree


def shape(params: dict) -> dict:
    """What a fit depends on but its number of rounds: rounds nest, so models equal here share one fit."""
    return {k: v for k, v in params.items() if k != "n_estimators"}


def nested(tree: Tree, cuts: list[list[float]], features: list[str]):
    """A tree as nested tuples with real thresholds."""
    def walk(i):
        if tree.feature[i] < 0:
            return float(tree.value[i])
        return (features[tree.feature[i]], float(cuts[tree.feature[i]][tree.cut[i]]), walk(tree.left[i]), walk(tree.right[i]))
    return walk(0)


def _groups(x: np.ndarray, features: np.ndarray | None = None) -> list[tuple[list[int], list[int]]]:
    """Features (or those numbered) in groups whose bins together make at most ``JOINT`` cells: which, and their bins.

    Two features of ``BINS`` bins are a group, or many of few bins; a row is then added up once for all of them.
    """
    bins = [int(column.max()) + 1 if len(x) else 1 for column in x.T]
    groups: list[list[int]] = []
    for f in sorted(range(len(bins)) if features is None else features.tolist(), key=lambda f: (-bins[f], f)):
        group = next((c for c in groups if math.prod(bins[i] for i in c) * bins[f] <= JOINT), None)
        groups.append([f]) if group is None else group.append(f)
    return [(group, [bins[f] for f in group]) for group in groups]


def _cell(x: np.ndarray, group: list[int], bins: list[int]) -> np.ndarray:
    cell = np.zeros(len(x), np.uint16)
    for f, b in zip(group, bins):
        cell *= b
        cell += x[:, f].astype(np.uint16)
    return cell


def _joined(x: np.ndarray, features: np.ndarray | None = None) -> list[tuple[list[int], list[int], np.ndarray]]:
    """The groups of features, and each row's cell in them."""
    return [(group, bins, _cell(x, group, bins)) for group, bins in _groups(x, features)]


def _added(columns: list, use: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """Sums of gradient, hessian and rows by column and cell, ``PART`` rows at a time; ``at`` is where a row's cells begin.

    Where whole numbers leave room for it, the rows of a part are counted in its hessians' sum, as a unit larger than all of them.
    """
    out, step = np.zeros((len(columns), 3, size)), max(PART, 2 * size)
    for i in range(0, len(use), step):
        rows, first = use[i:i + step], at[i:i + step]
        gs, hs = g.take(rows), h.take(rows)
        unit = 2.0 ** math.frexp(float(hs.sum()))[1]
        counted = unit * (len(rows) + 1) < 2.0 ** 53
        if counted:
            hs += unit
        for column, sums in zip(columns, out):
            cell = column.take(rows).astype(np.int64)
            cell += first
            sums[0] += np.bincount(cell, gs, size)
            of_h = np.bincount(cell, hs, size)
            n = np.floor(of_h * (1 / unit)) if counted else np.bincount(cell, minlength=size)
            sums[1] += of_h - n * unit if counted else of_h
            sums[2] += n
    return out


def _node_sums(x: np.ndarray, groups: list, rows: list[np.ndarray], features: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of gradient, hessian and rows by node, feature and bin, from the numbers of each node's rows."""
    nodes, use, place = len(rows), np.concatenate(rows), {f: i for i, f in enumerate(features.tolist())}
    joint = len(use) > 4 * nodes * JOINT
    at = np.repeat(np.arange(nodes) * (JOINT if joint else BINS), [len(r) for r in rows])
    if not joint:
        found = _added([x[:, f] for f in place], use, at, g, h, nodes * BINS)
        return found.reshape(len(place), 3, nodes, BINS).transpose(1, 2, 0, 3).astype(np.int64)
    out, groups = np.zeros((3, nodes, len(place), BINS), np.int64), [c for c in groups if any(f in place for f in c[0])]
    for (group, bins, _), sums in zip(groups, _added([c[2] for c in groups], use, at, g, h, nodes * JOINT)):
        sums = sums.reshape(3, nodes, JOINT)[:, :, :math.prod(bins)]
        for i, f in enumerate(group):
            if f in place:
                by = sums.reshape(3, nodes, math.prod(bins[:i]), bins[i], -1)
                out[:, :, place[f], :bins[i]] = by.sum(axis=4).sum(axis=2)
    return out


def _cells(x: np.ndarray, groups: list) -> np.ndarray:
    """Each row's cells in all groups, row by row: those of a node are then read in one go."""
    out = np.empty((len(x), len(groups)), np.uint16)
    for i in range(0, len(x), PART):
        for j, (group, bins) in enumerate(groups):
            out[i:i + PART, j] = _cell(x[i:i + PART], group, bins)
    return out


def _scattered(use: np.ndarray, cells_of, columns: int, size: int, gh: np.ndarray, unit: float, step: int) -> np.ndarray:
    """Sums of gradient, hessian and rows by column and cell; ``cells_of`` gives the columns' cells of a slice of ``use``.

    Gradient and hessian are the parts of one number, and a row counts as a ``unit`` in the second, larger than the hessians
    of ``step`` rows: one addition does for all three.
    """
    out = np.zeros((3, columns, size))
    for i in range(0, len(use), step):
        both = np.zeros((columns, size), complex)
        for k in range(i, min(i + step, len(use)), PIECE):
            part = slice(k, min(k + PIECE, i + step))
            weights = gh.take(use[part])
            for sums, cell in zip(both, cells_of(part)):
                np.add.at(sums, cell, weights)
        n = both.imag * (1 / unit)
        np.floor(n, out=n)
        out[0] += both.real
        out[2] += n
        n *= -unit
        n += both.imag
        out[1] += n
    return out.astype(np.int64)


def _level_sums(x: np.ndarray, cells: np.ndarray, groups: list, rows: list[np.ndarray], features: np.ndarray, gh: np.ndarray, unit: float,
                step: int) -> np.ndarray:
    """As :func:`_node_sums`, from one pass over each node's rows; nodes of few rows are added up feature by feature, together."""
    place = {f: i for i, f in enumerate(features.tolist())}
    out, few = np.zeros((3, len(rows), len(place), BINS), np.int64), [len(r) <= 4 * JOINT for r in rows]
    used = [(j, group, bins) for j, (group, bins) in enumerate(groups) if any(f in place for f in group)]
    large = [i for i, small in enumerate(few) if not small]
    for at in (large[i:i + 8] for i in range(0, len(large), 8)):
        def cells_of(part, m):
            some = np.ascontiguousarray(cells.take(rows[m][part], axis=0).T)
            return (some[j].astype(np.int64) for j, _, _ in used)
        found = np.stack([_scattered(rows[m], partial(cells_of, m=m), len(used), JOINT, gh, unit, step) for m in at], axis=1)
        for k, (_, group, bins) in enumerate(used):
            sums = found[:, :, k, :math.prod(bins)]
            for i, f in enumerate(group):
                if f in place:
                    by = sums.reshape(3, len(at), math.prod(bins[:i]), bins[i], -1)
                    out[:, at, place[f], :bins[i]] = by.sum(axis=4).sum(axis=2)
    if any(few):
        at = np.flatnonzero(few)
        use = np.concatenate([rows[m] for m in at])
        first = np.repeat(np.arange(len(at)) * BINS, [len(rows[m]) for m in at])
        found = _scattered(use, lambda part: (x[:, f].take(use[part]) + first[part] for f in place), len(place), len(at) * BINS, gh, unit, step)
        out[:, at] = found.reshape(3, len(place), len(at), BINS).swapaxes(1, 2)
    return out


class _Weights:
    """Gradients and hessians of a fit's rows as :func:`_scattered` adds them up; the arrays are filled anew for each tree."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, groups: list):
        self.x, self.y, self.w, self.groups, self.cells = x, y, w, groups, _cells(x, groups)
        bits = math.frexp(float(w.max(initial=0)) * _UNIT / 4 + 1)[1]  # a row's hessian is below 2^bits
        self.step = 1 << min(14, max(0, 53 - bits) // 2)
        self.unit = 2.0 ** bits * self.step
        self.counted = self.step >= 1 << 8                              # else weights are too large to count rows beside them
        self.gh = np.empty(len(y), complex)

    def renew(self, margin: np.ndarray) -> None:
        for i in range(0, len(self.y), PIECE):
            part = slice(i, i + PIECE)
            self.gh.real[part], h = _derivatives(self.y[part], self.w[part], margin[part])
            self.gh.imag[part] = h + self.unit if self.counted else h

    def reorder(self, order: np.ndarray) -> None:
        """The features and labels are reordered already."""
        self.w, self.cells = self.w.take(order), self.cells.take(order, axis=0)

    def sums(self, rows: list[np.ndarray], features: np.ndarray) -> np.ndarray:
        """As :func:`_node_sums`, from the numbers of each node's rows."""
        if self.counted:
            return _level_sums(self.x, self.cells, self.groups, rows, features, self.gh, self.unit, self.step)
        return _node_sums(self.x, _joined(self.x, features), rows, features, self.gh.real.copy(), self.gh.imag.copy())


def _parted(column: np.ndarray, cut: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows numbered ``at`` up to a cut and beyond it, two parts of one array."""
    down, out = np.empty(len(at), bool), np.empty_like(at)
    for i in range(0, len(at), PIECE):
        np.less_equal(column.take(at[i:i + PIECE]), cut, out=down[i:i + PIECE])
    n = np.count_nonzero(down)
    ends = [0, n]
    for i in range(0, len(at), PIECE):
        some, here = at[i:i + PIECE], down[i:i + PIECE]
        for side, which in enumerate((here, ~here)):
            which = np.flatnonzero(which)
            out[ends[side]:ends[side] + len(which)] = some.take(which)
            ends[side] += len(which)
    return out[:n], out[n:]


def _numbers(flags: np.ndarray) -> np.ndarray:
    """Which rows are flagged, as 32-bit numbers."""
    out, n = np.empty(np.count_nonzero(flags), np.int32), 0
    for i in range(0, len(flags), PIECE):
        here = np.flatnonzero(flags[i:i + PIECE])
        out[n:n + len(here)] = here
        out[n:n + len(here)] += i
        n += len(here)
    return out


def _grow_tree(fit: Fit, weights: _Weights, x: np.ndarray, rows: list[np.ndarray], ends: np.ndarray) -> None:
    """Grows the tree that ``fit`` is at, from the first of two parts of the ``rows``, and notes in which leaf each row of both ends.

    Of two children the smaller is added up, the other is what is left of their parent.
    """
    tree, rows, known, kin, complete = fit.tree, {0: rows}, {}, {}, False
    while not complete:
        wanted = fit.wanted()
        counted = sorted({min(m, kin[m][1], key=lambda c: (len(rows[c][0]), c)) if m in kin else m for m in wanted})
        found = weights.sums([rows[m][0] for m in counted], fit.features)
        sums = {m: found[:, i] for i, m in enumerate(counted)}
        for m in wanted:
            if m not in sums:
                parent, other = kin[m]
                sums[m] = known[parent] - sums[other]
        for i in range(0, len(wanted), 8):                              # arrays of a size that a core's cache holds
            some = wanted[i:i + 8]
            for m, split, own in zip(some, *best_splits(np.stack([sums[m] for m in some], axis=1), fit.features, fit.p)):
                fit.told(m, split, own)
        complete, known, kin = fit.grow(), sums, {}
        for m in wanted:
            if tree.feature[m] < 0:
                continue
            column, cut, left, right = x[:, tree.feature[m]], tree.cut[m], tree.left[m], tree.right[m]
            if complete:                                                # both children are leaves
                for at in rows.pop(m):
                    for i in range(0, len(at), PIECE):
                        some = at[i:i + PIECE]
                        ends[some] = np.where(column.take(some) <= cut, left, right)
            else:
                rows[left], rows[right] = zip(*(_parted(column, cut, at) for at in rows.pop(m)))
                kin[left], kin[right] = (m, right), (m, left)
    for leaf, parts in rows.items():
        for at in parts:
            ends[at] = leaf


def _grow_fits(copies, jobs: list, width: int, start: float):
    """The fits whose copies of the rows are in a partition: one, or none where there are more partitions."""
    parts: dict[int, list] = {}
    for i, part in copies:
        parts.setdefault(i, []).append(part)
    for i in sorted(parts):
        yield _grow_fit(_block(parts.pop(i), 1, width, start), *jobs[i], width)


def _grow_fit(block: dict, model: int, params: dict, seed: int, sizes: set[int], width: int) -> dict:
    """All trees of one fit from a table's rows, and the other rows' margins at the sizes asked."""
    fit = Fit(params, width, seed)
    x, y, n, margin, kept = block["x"], block["y"], block["trained"], block["margins"][0], {}
    weights = _Weights(x[:n], y[:n], block["w"][:n], _groups(x[:n]))
    ends, beside = np.empty(len(y), np.uint16 if fit.p.get("num_leaves", 31) < 1 << 15 else np.uint32), np.arange(n, len(y), dtype=np.int32)
    while not fit.done:
        weights.renew(margin[:n])
        taken = drawn(block["rows"][:n], fit.rows_seed, params.get("subsample", 1.0))
        _grow_tree(fit, weights, x, [_numbers(taken), np.concatenate([_numbers(~taken), beside])], ends)
        values = np.array(fit.close().value)
        for i in range(0, len(y), PIECE):
            margin[i:i + PIECE] += values.take(ends[i:i + PIECE])
        if len(fit.trees) in sizes:
            kept[model, len(fit.trees)] = margin[n:].copy()
        if len(fit.trees) == 1 and n > CACHED and not fit.done:
            # rows of a leaf side by side: most of those of a later tree's nodes then are, too
            order = np.argsort(ends[:n], kind="stable")
            for column in (*x[:n].T, y[:n], block["rows"][:n], margin[:n]):
                column[:] = column.take(order)
            weights.reorder(order)
    return {"model": model, "trees": fit.trees, "y": y[n:], "trained": 0, "kept": kept}


def _packed(batches, cuts: list[np.ndarray], width: int):
    for b in batches:
        if b.num_rows:
            values = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = np.stack([np.searchsorted(c, values[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.uint8)
            cols = [x, b.column(1).to_numpy().astype(np.float64), b.column(2).to_numpy().astype(np.float64),
                    b.column(3).to_numpy().astype(np.uint64), b.column(4).to_numpy(zero_copy_only=False).astype(bool)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["x", "y", "w", "rows", "train"])


def _block(parts: list, models: int, width: int, start: float) -> dict:
    """Packed rows as arrays, the ``trained`` ones first; the features lie column by column.  The parts are used up."""
    x, y, w, rows, train = ([r[i] for r in parts] for i in range(5))
    parts.clear()

    def joined(packed: list, kind, shape=(-1,)):
        out = np.concatenate([np.frombuffer(p, kind).reshape(shape) for p in packed], axis=-1)
        packed.clear()
        return out

    train = joined(train, bool)
    order = np.argsort(~train, kind="stable")
    y, w, rows = joined(y, float).take(order), joined(w, float).take(order), _mix(joined(rows, np.uint64).take(order))
    return {"x": joined(x, np.uint8, (width, -1)).take(order, axis=1).T, "y": y, "w": w, "rows": rows, "trained": int(train.sum()),
            "margins": np.full((models, len(y)), start), "kept": {}}


def _blocks(packed, models: int, width: int, start: float):
    """The block of a partition's packed rows."""
    parts = [tuple(r) for r in packed]
    if parts:
        yield _block(parts, models, width, start)


class Session:
    """Fits of several parameter sets over the same rows; see :func:`fit_all`."""

    def __init__(self, train: DataFrame, valid: DataFrame | None, sets: list[dict], label: str, key: str, features: list[str],
                 seed: int, every: int):
        from ..session import ensure_checkpoint_dir, ship_package
        self.spark, self.features, self.every = train.sparkSession, features, every
        ensure_checkpoint_dir(self.spark)
        ship_package(self.spark)
        self.sizes: dict[str, set[int]] = {}
        shapes: dict[str, dict] = {}
        for p in sets:
            name = json.dumps(shape(p), sort_keys=True)
            self.sizes.setdefault(name, set()).add(int(p.get("n_estimators", 100)))
            shapes[name] = p
        self.names = list(shapes)
        self.fits = [Fit({**shapes[n], "n_estimators": max(self.sizes[n])}, len(features), seed) for n in self.names]
        probs = [i / BINS for i in range(1, BINS)]
        found = train.approxQuantile(features, probs, 0.0005)                    # a few numbers per feature
        self.cuts = [np.unique(np.array(c)) for c in found]
        odds = train.agg(F.sum(F.col("weight") * F.col(label)), F.sum(F.col("weight") * (1 - F.col(label)))).first()
        self.start = math.log(float(odds[0]) / float(odds[1]))
        columns = [F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(label).cast("double").alias("y")]
        number = md5_number(F.col(key), seed).alias("rows")
        rows = train.select(*columns, F.col("weight").cast("double").alias("w"), number, F.lit(True).alias("train"))
        if valid is not None:
            rows = rows.unionByName(valid.select(*columns, F.lit(0.0).alias("w"), number, F.lit(False).alias("train")))
        self.n = rows.count()
        self.parallel = self.spark.sparkContext.defaultParallelism
        # a block for each core, several only of large tables: a task costs more than the sums of some ten thousand rows
        parts = -(-self.n // FULL)
        parts = -(-parts // self.parallel) * self.parallel if parts > self.parallel else min(self.parallel, -(-20 * self.n // ROWS))
        packed = rows.repartition(max(1, parts)).mapInArrow(partial(_packed, cuts=self.cuts, width=len(features)),
                                                    "x binary, y binary, w binary, rows binary, train binary")
        models, width, start = len(self.fits), len(features), self.start
        self.whole = self.n <= WHOLE * (MANY if 2 * models >= self.parallel else 1)
        if self.whole:
            # a copy of the rows for each fit, those with the most trees and levels first
            levels = lambda p: min(math.log2(p.get("num_leaves", 31)), p.get("max_depth", -1) % 32)
            size = lambda f: f.rounds * (3 + levels(f.p))
            jobs = [(m, f.p, seed, self.sizes[self.names[m]]) for m, f in sorted(enumerate(self.fits), key=lambda x: -size(x[1]))]
            copies = packed.rdd.flatMap(lambda r: [(i, tuple(r)) for i in range(models)]).partitionBy(models, lambda i: i)
            grow = partial(_grow_fits, jobs=jobs, width=width, start=start)
            self.blocks = copies.mapPartitions(grow).persist(StorageLevel.MEMORY_AND_DISK)
        else:
            self.blocks = packed.rdd.mapPartitions(partial(_blocks, models=models, width=width, start=start)).persist(StorageLevel.MEMORY_AND_DISK)
            self.blocks.count()
        self.pending: list[list] = [[] for _ in self.fits]               # trees that the blocks' margins lack
        self.snaps: list[tuple[int, int, int]] = []
        self.order: list[tuple[int, int, tuple]] = []
        self.sums: list[dict[int, np.ndarray]] = [{} for _ in self.fits]   # histograms of the last pass, by node
        self.steps = 0
        self.passes = 0
        self.renewed = 0
        self.checkpointed = None

    def _asked(self, m: int) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
        """A model's nodes whose rows are asked for, which of them are small, and the others, each as parent and sibling.

        Of two large children the smaller is added up, the other is what is left of their parent.  A node whose children can't
        be split has no use for its rows in one place.
        """
        f, tree, left = self.fits[m], self.fits[m].tree, {}
        limit, wanted = f.p.get("max_depth", -1), set(f.wanted())
        small = {n: f.rows.get(n, self.n) <= SMALL and (limit < 0 or tree.depth[n] + 1 < limit) for n in wanted}
        for parent in self.sums[m]:
            pair = sorted((tree.left[parent], tree.right[parent]), key=lambda n: (f.rows.get(n, 0), n))
            if wanted.issuperset(pair) and not any(small[n] for n in pair):
                left[pair[1]] = parent, pair[0]
        nodes = sorted(wanted - set(left))
        return np.array(nodes), np.array([small[n] for n in nodes]), left

    def one_pass(self) -> list[tuple[int, int]]:
        """Every model goes on by a level at least; returns the (model, size) that are reached."""
        orders, lefts = [], {}
        for m, f in enumerate(self.fits):
            if not f.done:
                nodes, small, lefts[m] = self._asked(m)
                orders.append((m, self.pending[m], f.tree.arrays(), nodes, f.features, f.rows_seed, f.p, small))
        answers = self.blocks.flatMap(lambda b: _answers(b, orders))
        size = sum(int((~o[7]).sum()) * len(o[4]) * BINS * 24 for o in orders)
        if size * self.blocks.getNumPartitions() <= DIRECT and not any(o[7].any() for o in orders):
            got: dict[tuple[int, int], np.ndarray] = {}
            for key, sums in answers.collect():                          # histograms, as large as the models, of each block
                got[key] = got[key] + sums if key in got else sums
        else:
            about = {o[0]: (o[4], o[6], self.fits[o[0]].tree.depth) for o in orders}
            keys = sum(int(o[7].sum()) + 1 for o in orders)
            got = dict(answers.reduceByKey(lambda a, b: a + b, numPartitions=max(1, min(self.parallel, -(-keys // 8))))
                       .map(lambda x: _solved(x, about)).collect())      # histograms and splits: as large as the models
        self.passes += 1
        reached = []
        for m, _, _, nodes, features, _, params, small in orders:
            fit = self.fits[m]
            if (m, -1) in got:
                sums = {n: got[m, -1][:, i] for i, n in enumerate(nodes[~small].tolist())}
                sums.update({n: self.sums[m][parent] - sums[other] for n, (parent, other) in lefts[m].items()})
                for node, split, own in zip(sums, *best_splits(np.stack(list(sums.values()), axis=1), features, params)):
                    fit.told(node, split, own)
                self.sums[m] = sums
            else:
                self.sums[m] = {}
            for node in nodes[small].tolist():
                fit.told(node, *got.get((m, node), (False, (0.0, 0.0, 0))))
            if fit.grow():
                self.sums[m] = {}
                arrays = fit.close().arrays()
                self.pending[m].append(arrays)
                self.steps += 1
                self.order.append((self.steps, m, arrays))
                if len(fit.trees) in self.sizes[self.names[m]]:
                    self.steps += 1
                    self.snaps.append((self.steps, m, len(fit.trees)))
                    reached.append((m, len(fit.trees)))
        return reached

    def grow_whole(self) -> list[tuple[int, int]]:
        """All trees of all fits, each in a task; returns the (model, size) that are reached."""
        for m, trees in self.blocks.map(lambda b: (b["model"], b["trees"])).collect():          # as large as the models
            self.fits[m].trees = trees
        self.passes += 1
        return [(m, n) for m, name in enumerate(self.names) for n in sorted(self.sizes[name])]

    def work_in(self) -> None:
        """New blocks with all finished trees in their margins, from time to time kept apart from what they were made of."""
        done, snaps, old = self.order, self.snaps, self.blocks
        fresh = old.map(lambda b: _worked_in(b, done, snaps)).persist(StorageLevel.MEMORY_AND_DISK)
        self.renewed += 1
        if self.renewed % KEEP == 0:
            fresh.checkpoint()
        fresh.count()
        self.blocks, self.order, self.snaps = fresh, [], []
        self.pending = [[] for _ in self.fits]
        old.unpersist()
        if self.renewed % KEEP == 0:
            self._drop_checkpoint(self.checkpointed)
            self.checkpointed = fresh

    def _drop_checkpoint(self, rdd) -> None:
        path = rdd.getCheckpointFile() if rdd is not None else None
        if path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def scores(self, reached: list[tuple[int, int]], label: str, score: str) -> DataFrame:
        """``fit, n_trees, label, score`` of the validation rows at the given sizes, from the present blocks."""
        wanted, schema = set(reached), f"model int, n_trees int, {label} int, {score} double"

        def packed(b):
            y = b["y"][b["trained"]:].astype(np.int32)
            for (m, n), margin in b["kept"].items():
                if (m, n) in wanted:
                    for i in range(0, len(y), PART):
                        yield m, n, y[i:i + PART].tobytes(), (1 / (1 + np.exp(-margin[i:i + PART]))).tobytes()

        def opened(batches):
            for batch in batches:
                for m, n, y, s in zip(*(c.to_pylist() for c in batch.columns)):
                    columns = [np.frombuffer(y, np.int32), np.frombuffer(s)]
                    columns = [np.full(len(columns[0]), v, np.int32) for v in (m, n)] + columns
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["model", "n_trees", label, score])

        rows = self.spark.createDataFrame(self.blocks.flatMap(packed), "model int, n_trees int, y binary, s binary", verifySchema=False)
        return rows.mapInArrow(opened, schema)

    def close(self) -> None:
        self.blocks.unpersist()
        self._drop_checkpoint(self.checkpointed)

    def trees(self, params: dict) -> list:
        """The trees of one parameter set; the first is the constant log-odds of the training rows."""
        fit = self.fits[self.names.index(json.dumps(shape(params), sort_keys=True))]
        return [self.start, *(nested(t, self.cuts, self.features) for t in fit.trees[:int(params.get("n_estimators", 100))])]


def fit_all(train: DataFrame, valid: DataFrame | None, sets: list[dict], on_scores=None, label: str = "churn", key: str = "loyalty_number",
            features: list[str] = S.FEATURES, seed: int = S.SPLIT_SEED, every: int = 8, score: str = "churn_probability") -> Session:
    """Fits every parameter set; ``train`` has a ``weight`` column, both tables have guarded features.

    ``on_scores(session, frame)`` is called with the validation scores of the sizes that were reached since the last call,
    at times in between and at the end.  ``every``: passes after which finished trees are worked into the blocks.
    """
    session = Session(train, valid, sets, label, key, features, seed, every)
    reached: list[tuple[int, int]] = []
    if session.whole:
        reached = session.grow_whole()
        if on_scores:
            on_scores(session, session.scores(reached, label, score))
    while any(not f.done for f in session.fits):
        reached += session.one_pass()
        last = all(f.done for f in session.fits)
        if session.passes % every == 0 or last:
            session.work_in()
            # scoring is a job of its own: not for a few sizes at a time
            if reached and on_scores and (last or len(reached) >= 8):
                on_scores(session, session.scores(reached, label, score))
                reached = []
    return session


def fit(train: DataFrame, params: dict, **kw) -> list:
    """The trees of one parameter set (nested tuples, the first a constant)."""
    session = fit_all(train, None, [params], **{"every": 32, **kw})          # no scores to wait for
    session.close()
    return session.trees(params)
