"""Boosted trees and forests of many models at once, grown level by level from histograms.

A model is a variant (a set of columns) and the fold it leaves out. Columns are binned once. A level of
all trees under way is one Spark job over the rows: each task adds its rows into histograms over (tree,
node, column, bin), one exchange brings the parts of a tree together, and the best cut of every node comes
back. What crosses tasks and what reaches the driver follow trees, columns and bins, never rows. Where at most
``FEW_TASKS`` tasks hold the rows, the parts of boosted trees are added on the driver instead, which saves an exchange in each of some
hundred short jobs.

Binned rows of equal bins, label and fold are alike to every tree. They are written next to each other, in as many parts as the cluster has
cores. Boosting learns from one row of each kind and its number; a forest adds up the draws of neighbours before it looks at its trees,
and scores are formed once for neighbours. Where all rows differ this saves nothing, and the result is the same.

Boosting needs all its models' last trees before the next, so a round of depth 3 is three jobs for all of them. Each row's
margins are a table in the shared folder, renewed every ``ROUNDS_PER_TABLE`` rounds; the trees since travel with the job. Trees of a
forest don't wait for each other: ``TREES_AT_ONCE`` of every model grow together.

Both kinds split where sum(l)^2 / n(l) + sum(r)^2 / n(r) is largest: least squared error of residuals, and for classes
the Gini impurity of weighted labels. A forest draws its rows with replacement (a Poisson count that is a hash of row and tree) and
looks at a hashed choice of sqrt(columns) in each node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakaudit.sources.tables import scratch_table

BINS = 32
ROUNDS_PER_TABLE = 10
TREES_AT_ONCE = 40
FEW_TASKS, ROWS_PER_TASK = 16, 4096
LEARNING_RATE = 0.1
_CELLS_AT_ONCE, _ROWS_AT_ONCE, _KINDS_AT_ONCE = 1 << 21, 2048, 1 << 14
_SHALLOW, _MANY = 6, 1024  # trees walked question by question, for so many rows
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters near ones."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Growth:
    """What a task needs of the trees under way: one row per tree in every array, nodes as in a heap (children of i at 2i + 1 and
    2i + 2), column -1 where a node isn't split."""

    columns: tuple[np.ndarray, ...]  # by variant
    variant: np.ndarray
    fold: np.ndarray
    number: np.ndarray  # of the tree within its model
    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray | None
    level: int = 0
    considered: int | None = None  # columns looked at per node; None: all
    weights: np.ndarray | None = None  # (fold, class) of a forest
    prior: np.ndarray | None = None  # margin of a boosted model before its first tree
    earlier: tuple = ()  # rounds not yet in the margins' table: (column, cut, value)
    seed: int = 0

    @property
    def width(self) -> int:
        return self.considered or max(len(c) for c in self.columns)

    def choice(self, t: int) -> np.ndarray:
        """(node of this level, columns looked at)."""
        own = self.columns[self.variant[t]]
        nodes = 1 << self.level
        if self.considered is None:
            return np.broadcast_to(own, (nodes, len(own)))
        node = np.arange(nodes, 2 * nodes, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        drawn = _mix(own.astype(np.uint64)[None, :] + _mix(node + np.uint64(self.number[t] * 64 + self.fold[t] + self.seed)))
        return own[np.argsort(drawn, axis=1, kind="stable")[:, : self.considered]]


def walk(x: np.ndarray, column: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """(row, tree): the node that each row reaches within ``depth`` steps."""
    if depth <= _SHALLOW and len(x) >= _MANY:
        cells, out = np.ascontiguousarray(x.T), np.empty((len(column), len(x)), np.int64)
        for t in range(len(column)):
            out[t] = _reached(cells, column[t], cut[t], depth)
        return out.T
    cells, row = np.ascontiguousarray(x).ravel(), np.arange(len(x))[:, None] * x.shape[1]
    columns, cuts, tree = column.ravel(), cut.ravel(), np.arange(len(column)) * column.shape[1]
    node = np.zeros((len(x), len(column)), np.int64)
    for _ in range(depth):
        at = node + tree
        asked = columns.take(at)
        beyond = cells.take(row + np.maximum(asked, 0)) > cuts.take(at)
        node = np.where(asked >= 0, 2 * node + 1 + beyond, node)
    return node


def _reached(cells: np.ndarray, column: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row reaches in one tree, of (column, row): every question is put to all rows, a byte each, and the answers are
    folded from below into the path. A node that isn't split stands at the far left of what would be below it."""
    if not depth:
        return np.zeros(cells.shape[1], np.int64)

    def path(node: int, left: int):
        if not left or column[node] < 0:
            return np.uint8(0)
        beyond = (cells[column[node]] > cut[node]).view(np.uint8)
        if left == 1:
            return beyond
        less, more = path(2 * node + 1, left - 1), path(2 * node + 2, left - 1) | np.uint8(1 << (left - 1))
        return less ^ ((less ^ more) & (np.uint8(0) - beyond))

    every, node = np.arange(1 << depth), np.zeros(1 << depth, np.int64)
    for left in range(depth - 1, -1, -1):
        node = np.where(column[node] >= 0, 2 * node + 1 + (every >> left & 1), node)
    return node[np.broadcast_to(path(0, depth), cells.shape[1])]


def _depth(column: np.ndarray) -> int:
    return int(column.shape[1] + 1).bit_length() - 1


def _margins(x: np.ndarray, kept: np.ndarray | None, growth: Growth) -> np.ndarray:
    """(row, model): the margin after all earlier rounds."""
    out = np.tile(growth.prior, (len(x), 1)) if kept is None else kept.copy()
    for column, cut, value in growth.earlier:
        out += LEARNING_RATE * value[np.arange(len(column)), walk(x, column, cut, _depth(column))]
    return out


def _matrix(cells: pa.Array, kind) -> np.ndarray:
    """A row per cell of packed numbers."""
    return np.frombuffer(b"".join(cells.to_pylist()), kind).reshape(len(cells), -1)


def _runs(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Where each run of neighbours of equal bins, label and fold begins."""
    if not len(x):
        return np.zeros(0, np.int64)
    other = (x[1:] != x[:-1]).any(1) | (y[1:] != y[:-1]) | (fold[1:] != fold[:-1])
    return np.concatenate([[0], np.flatnonzero(other) + 1])


def _draws(h: np.ndarray, number: int, seed: int) -> np.ndarray:
    """How often a tree of that number draws each row."""
    u = (_mix(h ^ _mix(np.array([number], np.uint64) + np.uint64(seed << 20))) >> np.uint64(11)) / float(1 << 53)
    found = np.zeros(len(u), np.uint8)
    for bound in _POISSON[:4]:
        found += u >= bound
    many = np.flatnonzero(found == 4)
    found[many] = np.searchsorted(_POISSON, u[many], "right")
    return found


def _kinds(growth: Growth, numbers: Sequence[int], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(bins, label, fold, draws by number) of runs, a bounded number at once."""
    held, size = [], 0
    for x, y, fold, h, _, _ in _pieces(batches, 1):
        first = _runs(x, y, fold)
        if not len(first):
            continue
        draws = np.stack([np.add.reduceat(_draws(h, n, growth.seed), first, dtype=np.float64) for n in numbers])
        held.append((x[first], y[first], fold[first], draws))
        size += len(first)
        if size >= _KINDS_AT_ONCE:
            yield tuple(np.concatenate(part, axis=-1 if i == 3 else 0) for i, part in enumerate(zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(part, axis=-1 if i == 3 else 0) for i, part in enumerate(zip(*held)))


def _pieces(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bins, label, fold, hash or None, margins or None, number of equal rows) of a bounded number of rows."""
    most = max(1, _CELLS_AT_ONCE // max(trees, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            x = _matrix(part.column("x"), np.uint8)
            names = part.schema.names
            y, fold = (part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            h = part.column("h").to_numpy(zero_copy_only=False).view(np.uint64) if "h" in names else None
            kept = _matrix(part.column("margins"), np.float64) if "margins" in names else None
            n = part.column("n").to_numpy(zero_copy_only=False).astype(float) if "n" in names else np.ones(len(x))
            yield x, y.astype(np.int64), fold, h, kept, n


def _forest_sums(growth: Growth, asked: np.ndarray, bins: int, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """(stat, tree and cell): weighted positives and weights. Draws are whole numbers and a class has one weight in a tree, so both
    follow from the draws of either class in a cell. Trees go one by one over the rows they drew; those of equal fold and number share them."""
    trees, nodes, width = asked.shape
    size = nodes * width * bins
    counts = np.zeros((trees, size * 2))
    first = np.arange(nodes * width).reshape(nodes, width) * (bins * 2)
    sharing: dict[tuple[int, int], list[int]] = {}
    for t, key in enumerate(zip(growth.fold.tolist(), growth.number.tolist())):
        sharing.setdefault(key, []).append(t)
    numbers = list(dict.fromkeys(growth.number.tolist()))
    for x, y, fold, draws in _kinds(growth, numbers, batches):
        cells = x.astype(np.uint16) * 2 + y[:, None].astype(np.uint16)
        for (f, n), own in sharing.items():
            drawn = draws[numbers.index(n)]
            used = np.flatnonzero((fold != f) & (drawn > 0))
            turned, there, drawn = np.ascontiguousarray(x[used].T), cells[used], drawn[used]
            row = np.arange(len(used))[:, None] * x.shape[1]
            every = np.repeat(drawn, width)
            for t in own:
                node = _reached(turned, growth.column[t], growth.cut[t], growth.level) - (nodes - 1)
                some = np.flatnonzero(node >= 0)
                whole = len(some) == len(node)
                node, at = (node, row) if whole else (node[some], row[some])
                at = there.ravel().take(at + asked[t].take(node, axis=0)) + first.take(node, axis=0)
                counts[t] += np.bincount(at.ravel(), every if whole else np.repeat(drawn[some], width), size * 2)
    weight = growth.weights[growth.fold.astype(int)]  # (tree, class)
    negative, positive = (counts[:, k::2] * weight[:, k : k + 1] for k in (0, 1))
    return np.stack([positive.ravel(), (positive + negative).ravel()])


def _boosted_sums(growth: Growth, bins: int, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """(stat, tree and cell): residuals, rows and curvatures. Columns are shared by all models, so their sums are one product: (column and
    bin x rows) times (rows x stat, model and node), of the bins that a column has."""
    trees, nodes, width = len(growth.variant), 1 << growth.level, growth.width
    total = None
    for x, y, fold, _, kept, many in _pieces(batches, _CELLS_AT_ONCE // _ROWS_AT_ONCE):
        n, columns = x.shape
        if not n:
            continue
        node = walk(x, growth.column, growth.cut, growth.level) - (nodes - 1)
        used = (node[:, :, None] == np.arange(nodes)) & (fold[:, None] != growth.fold[None, :])[:, :, None]
        p = 1.0 / (1.0 + np.exp(-_margins(x, kept, growth)))
        stats = np.empty((n, 3, trees, nodes))
        for i, stat in enumerate((y[:, None] - p, np.ones_like(p), p * (1 - p))):
            np.multiply((stat * many[:, None])[:, :, None], used, out=stats[:, i])
        held = x.max(0).astype(np.int64) + 1
        first = np.cumsum(held) - held
        hot = np.zeros((held.sum(), n))
        hot[first + x, np.arange(n)[:, None]] = 1.0
        if total is None:
            total = np.zeros((columns * bins, stats[0].size))
        total[np.arange(held.sum()) + np.repeat(np.arange(columns) * bins - first, held)] += hot @ stats.reshape(n, -1)
    sums = np.zeros((3, trees, nodes, width, bins))
    if total is not None:
        by_cell = total.reshape(-1, bins, 3, trees, nodes)
        for t in range(trees):
            own = growth.columns[growth.variant[t]]
            sums[:, t, :, : len(own)] = by_cell[own, :, :, t].transpose(2, 3, 0, 1)
    return sums.reshape(3, -1)


def _histograms(growth: Growth, bins: int, buckets: int):
    """Task: (bucket, task, tree, cells, sums), the histograms of its rows without the empty cells."""
    trees, nodes, width = len(growth.variant), 1 << growth.level, growth.width
    size = nodes * width * bins

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros((trees, nodes, width), np.int64)  # a variant of fewer columns fills up with cells that nobody reads
        for t in range(trees):
            own = growth.choice(t)
            asked[t, :, : own.shape[1]] = own
        sums = _forest_sums(growth, asked, bins, batches) if growth.prior is None else _boosted_sums(growth, bins, batches)
        found = np.flatnonzero(sums[1])
        ends = np.searchsorted(found, np.arange(trees + 1) * size)
        some = np.flatnonzero(np.diff(ends))
        task = TaskContext.get().partitionId()
        cells = [(found[ends[t] : ends[t + 1]] - t * size).astype(np.int32).tobytes() for t in some]
        packed = [np.ascontiguousarray(sums[:, found[ends[t] : ends[t + 1]]]).tobytes() for t in some]
        columns = [pa.array(some % buckets, pa.int32()), pa.array([task] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(cells, pa.binary()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "task", "tree", "cells", "sums"])

    return work


_CUTS = "tree int, node int, column int, cut int, s double, w double, t double, sl double, wl double, tl double"


def _best_cuts(growth: Growth, bins: int):
    """Group of a tree's histograms: its nodes' sums and best cuts, column -1 where no cut gains."""
    nodes = 1 << growth.level

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        t = table.column("tree")[0].as_py()
        cells = np.concatenate([np.frombuffer(c, np.int32) for c in table.column("cells").to_pylist()])
        kinds_ = 2 if growth.prior is None else 3
        stats = np.concatenate([np.frombuffer(s, np.float64).reshape(kinds_, -1) for s in table.column("sums").to_pylist()], axis=1)
        s, w, more = (np.bincount(cells, part, nodes * growth.width * bins).reshape(nodes, growth.width, bins) for part in stats[[0, 1, kinds_ - 1]])
        choice = growth.choice(t)
        whole = [a[:, 0].sum(1) for a in (s, w, more)]
        left = [a[:, : choice.shape[1]].cumsum(2)[:, :, :-1] for a in (s, w, more)]
        sl, wl = left[0], left[1]
        sr, wr = whole[0][:, None, None] - sl, whole[1][:, None, None] - wl
        least = 1e-9 * whole[1][:, None, None]
        fits = (wl > least) & (wr > least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, sl**2 / wl + sr**2 / wr, -np.inf).reshape(nodes, -1)
            none = whole[0] ** 2 / whole[1]
        best = gain.argmax(1)
        at = np.arange(nodes)
        here = np.flatnonzero(whole[1] > 0)
        better = gain[at, best] > none + 1e-10 * np.maximum(1.0, np.abs(none))
        place, cut = best // (bins - 1), best % (bins - 1)
        column = np.where(better, choice[at, place], -1)
        columns = [np.full(len(here), t), here, column[here], cut[here], *[a[here] for a in whole], *[a[at, place, cut][here] for a in left]]
        kinds = [pa.int32()] * 4 + [pa.float64()] * 6
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=[c.split()[0] for c in _CUTS.split(", ")])

    return work


def _cut_here(parts: pa.Table, growth: Growth, bins: int) -> pa.Table:
    """The best cuts of all trees whose histograms are at hand."""
    parts = parts.sort_by("tree")
    trees, counts = np.unique(parts.column("tree").to_numpy(), return_counts=True)
    ends, best = np.cumsum(counts), _best_cuts(growth, bins)
    return pa.concat_tables([best(parts.slice(int(e - n), int(n))) for e, n in zip(ends, counts)]) if len(trees) else pa.table({"tree": []})


def _cut_there(growth: Growth, bins: int):
    return lambda parts: _cut_here(parts, growth, bins)


def grow(rows: DataFrame, growth: Growth, depth: int, bins: int, leaf, gather: bool = False) -> Growth:
    """The trees, grown to ``depth``; ``leaf`` makes values of (sum, weight, third sum)."""
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for level in range(depth):
        now = replace(growth, level=level, value=None)
        parts = rows.mapInArrow(_histograms(now, bins, buckets), "bucket int, task int, tree int, cells binary, sums binary")
        found = _cut_here(parts.toArrow(), now, bins) if gather else parts.groupBy("bucket").applyInArrow(_cut_there(now, bins), _CUTS).toArrow()
        if not found.num_rows:
            break
        t, node, column, cut = (found.column(c).to_numpy() for c in ("tree", "node", "column", "cut"))
        s, w, more, sl, wl, tl = (found.column(c).to_numpy() for c in ("s", "w", "t", "sl", "wl", "tl"))
        heap = node + (1 << level) - 1
        if level == 0:
            growth.value[t, 0] = leaf(s, w, more)
        split = column >= 0
        if not split.any():
            break
        t, heap, column, cut = t[split], heap[split], column[split], cut[split]
        growth.column[t, heap], growth.cut[t, heap] = column, cut
        growth.value[t, 2 * heap + 1] = leaf(sl[split], wl[split], tl[split])
        growth.value[t, 2 * heap + 2] = leaf((s - sl)[split], (w - wl)[split], (more - tl)[split])
    return growth


def _empty(columns, variant, fold, number, depth: int, **more) -> Growth:
    trees, inner = len(variant), (1 << depth) - 1
    return Growth(columns, variant, fold, number, np.full((trees, inner), -1, np.int16), np.zeros((trees, inner), np.uint8), np.zeros((trees, 2 * inner + 1)), **more)


def binned(table: DataFrame, columns: Sequence[str], keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """(keys..., y, fold, h, x) as a table: x has a byte per column, the number of cut points below the value. Cut points are
    approximate quantiles over all rows; h is a hash of the keys. Rows that are alike stand next to each other."""
    return _binned(table, columns, keys, bins)[0]


def _binned(table: DataFrame, columns: Sequence[str], keys: Sequence[str], bins: int) -> tuple[DataFrame, int]:
    """The table of ``binned`` and the most bins that a column has."""
    probs = ", ".join(f"{i / bins!r}D" for i in range(1, bins))
    found = [F.expr(f"percentile_approx(`{c}`, array({probs}), 10000) AS `{c}`") for c in columns]
    row = table.agg(*found, F.count(F.lit(1)).alias("__rows")).first()
    edges = [np.unique(row[c] or []) for c in columns]
    kept = table.select(*keys, F.col("y").cast("int").alias("y"), "fold", F.xxhash64(*keys).alias("h"), *columns)
    schema = kept.select(*keys, "y", "fold", "h").schema
    names = schema.fieldNames()
    schema = schema.add("x", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.empty((batch.num_rows, len(columns)), np.uint8)
            for j, (c, e) in enumerate(zip(columns, edges)):
                x[:, j] = np.searchsorted(e, batch.column(c).to_numpy(zero_copy_only=False), "left")
            cells = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], cells], names=[*names, "x"])

    # The hash comes last, so that one kind of rows can be dealt over many parts.
    order = ["x", "y", "fold", "h"]
    parts = kept.mapInArrow(work, schema).repartitionByRange(_parts(table, row["__rows"]), *order).sortWithinPartitions(*order)
    return scratch_table(parts, "binned"), max(2, *[len(e) + 1 for e in edges])


def _parts(table: DataFrame, rows: int) -> int:
    """As many tasks as there are cores, if each gets enough rows: more would only send more histograms."""
    return max(1, min(table.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def boosted(
    table: DataFrame, columns: Sequence[str], variants: Mapping[str, Sequence[str]], keys: Sequence[str], rounds: int, depth: int, bins: int = BINS, seed: int = 0
) -> DataFrame:
    """(variant, keys..., y, score): gradient boosting of the logistic loss, every row scored by the models that left its fold out."""
    rows, bins = _binned(table, columns, keys, bins)
    names = list(variants)
    sets = tuple(np.array([columns.index(c) for c in variants[v]]) for v in names)
    kinds = rows.groupBy("x", "y", "fold").agg(F.count(F.lit(1)).alias("n"))
    kinds = scratch_table(kinds.repartition(rows.rdd.getNumPartitions(), "x", "y", "fold"), "kinds")
    found = kinds.groupBy("fold", "y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    counts = {(r["fold"], r["y"]): r["n"] for r in found}
    folds = sorted({f for f, _ in counts})
    models = [(v, f) for v in range(len(names)) for f in folds]
    variant, fold = np.array([m[0] for m in models]), np.array([m[1] for m in models])
    share = np.array([sum(n for (g, y), n in counts.items() if g != f and y == 1) / max(1, sum(n for (g, _), n in counts.items() if g != f)) for f in fold])
    share = np.clip(share, 1e-9, 1 - 1e-9)
    prior = np.log(share / (1 - share))
    growth = _empty(sets, variant, fold, np.zeros(len(models), int), depth, prior=prior, seed=seed)
    leaf = lambda s, w, t: np.divide(s, t, out=np.zeros_like(s), where=np.abs(t) > 1e-150)
    # hundreds of short jobs: fewer tasks are faster
    state = kinds = kinds.coalesce(_parts(table, sum(r["kinds"] for r in found)))
    gather = kinds.rdd.getNumPartitions() <= FEW_TASKS
    made = []
    for done in range(rounds):
        fresh = _empty(sets, variant, fold, growth.number, depth, prior=prior, earlier=growth.earlier, seed=seed)
        grown = grow(state, fresh, depth, bins, leaf, gather)
        made.append((grown.column, grown.cut, grown.value))
        growth = replace(growth, earlier=(*growth.earlier, made[-1]))
        if len(growth.earlier) == ROUNDS_PER_TABLE and done + 1 < rounds:
            state = _with_margins(state, kinds, growth)
            growth = replace(growth, earlier=())
    per_fold = {}
    for f in folds:
        own = np.flatnonzero(fold == f)
        stacked = (np.stack([m[i][own] for m in made], axis=1) for i in range(3))
        per_fold[f] = (*(a.reshape(-1, a.shape[2]) for a in stacked), prior[own])
    finish = lambda reached, prior: 1.0 / (1.0 + np.exp(-(prior + LEARNING_RATE * reached.sum(2))))
    return _scores(rows, keys, names, per_fold, rounds, depth, finish)


def _scores(rows: DataFrame, keys: Sequence[str], names: list[str], per_fold: Mapping[int, tuple], trees: int, depth: int, finish) -> DataFrame:
    """(variant, keys..., y, score) of binned rows: ``per_fold`` has (column, cut, value, more) of a fold's trees, those of a variant together;
    ``finish`` makes scores of what a row reaches in (row, variant, tree) and ``more``."""
    # as many numbers as the settings make nodes, whatever the rows
    shared = rows.sparkSession.sparkContext.broadcast(per_fold)
    kept, every = list(keys), trees * len(names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, (x, y, fold, *_) in zip(_sliced(batch, every), _pieces([batch], every)):
                first = _runs(x, y, fold)
                some, own = x[first], fold[first]
                out = np.zeros((len(some), len(names)))
                for f in np.unique(own).tolist():
                    column, cut, value, more = shared.value[f]
                    mine = np.flatnonzero(own == f)
                    reached = value[np.arange(len(column)), walk(some[mine], column, cut, depth)]
                    out[mine] = finish(reached.reshape(len(mine), len(names), trees), more)
                yield from _scored(part, kept, y, np.repeat(out, np.diff(first, append=len(x)), axis=0), names)

    return rows.mapInArrow(score, _score_schema(rows, kept))


def _sliced(batch: pa.RecordBatch, trees: int) -> list[pa.RecordBatch]:
    most = max(1, _CELLS_AT_ONCE // max(trees, 1))
    return [batch.slice(at, most) for at in range(0, batch.num_rows, most)]


def _scored(part: pa.RecordBatch, keys: list[str], y: np.ndarray, score: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for v, name in enumerate(names):
        cells = [pa.array([name] * part.num_rows, pa.string()), *[part.column(k) for k in keys], pa.array(y, pa.int32()), pa.array(np.ascontiguousarray(score[:, v]))]
        yield pa.RecordBatch.from_arrays(cells, names=["variant", *keys, "y", "score"])


def _score_schema(rows: DataFrame, keys: list[str]):
    own = {f.name: f.dataType for f in rows.schema.fields}
    return T.StructType([T.StructField("variant", T.StringType()), *[T.StructField(k, own[k]) for k in keys], T.StructField("y", T.IntegerType()), T.StructField("score", T.DoubleType())])


def _with_margins(state: DataFrame, rows: DataFrame, growth: Growth) -> DataFrame:
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("margins", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_margins(x, kept, growth) for x, _, _, _, kept, _ in _pieces([batch], len(growth.variant))]
            cells = pa.array([r.tobytes() for m in found for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], cells], names=[*names, "margins"])

    return scratch_table(state.mapInArrow(work, schema), "margins")


def forests(
    table: DataFrame, columns: Sequence[str], variants: Mapping[str, Sequence[str]], keys: Sequence[str], trees: int, depth: int,
    weights: Mapping[tuple[int, int], float], bins: int = BINS, seed: int = 0,
) -> DataFrame:
    """(variant, keys..., y, score): forests of class-weighted trees, every row scored by the mean of the trees that left its fold out.

    ``weights`` holds the weight of a class in the rows outside a fold.
    """
    rows, bins = _binned(table, columns, keys, bins)
    names = list(variants)
    sets = tuple(np.array([columns.index(c) for c in variants[v]]) for v in names)
    folds = sorted({f for f, _ in weights})
    balance = np.ones((max(folds, default=0) + 1, 2))
    for (f, y), w in weights.items():
        balance[f, int(y)] = w
    models = [(v, f) for v in range(len(names)) for f in folds]
    considered = max(1, int(math.sqrt(max(len(c) for c in sets))))
    made = []
    for first in range(0, trees, TREES_AT_ONCE):
        numbers = range(first, min(trees, first + TREES_AT_ONCE))
        every = np.array([(v, f, n) for v, f in models for n in numbers]).reshape(-1, 3)
        growth = _empty(sets, every[:, 0], every[:, 1], every[:, 2], depth, considered=considered, weights=balance, seed=seed)
        made.append(grow(rows, growth, depth, bins, lambda s, w, t: s / w))
    per_fold = {}
    for f in folds:  # (column, cut, value) of a fold's trees, those of a variant together
        own = [(g.fold == f) & (g.variant == v) for v in range(len(names)) for g in made]
        pick = lambda name: np.concatenate([getattr(g, name)[m] for g, m in zip(made * len(names), own)])  # noqa: B023, E731
        per_fold[f] = (*(pick(name) for name in ("column", "cut", "value")), None)
    return _scores(rows, keys, names, per_fold, trees, depth, lambda reached, _: np.clip(reached.mean(2), 0.0, 1.0))
