"""Logistic models of many cells at once, by shared Newton steps.

A cell is a part of the rows (an offset, say), a variant (a set of columns) and the fold it leaves out. One pass over the rows adds,
for every cell, the loss, the gradient and the weighted cross products of its columns; tasks add what they hold, an exchange
brings a cell's sums together, and the driver solves one small system per cell. A step that raised a cell's loss is halved. All
cells are done after about ten passes, however many there are.

The loss is the summed, class-weighted log loss plus half the squared coefficients; the intercept, the last coefficient, is free.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PENALTY = 1.0
# The largest gradient that counts as none, for each row a model learns from. Sums of that many terms carry rounding errors
# far below it.
GRADIENT = 1e-9


@dataclass(frozen=True)
class Cells:
    """Which rows and columns each cell has, and the weight of either class in it."""

    columns: tuple[str, ...]
    part: tuple
    variant: tuple[str, ...]
    chosen: tuple[np.ndarray, ...]
    fold: np.ndarray
    rows: np.ndarray
    weight: np.ndarray  # (cell, class)


def cells_of(table: DataFrame, variants: Mapping[str, Sequence[str]], part: str | None) -> Cells:
    """Every part, variant and fold of the table, with balanced class weights over the rows outside the fold."""
    columns = tuple(dict.fromkeys(c for own in variants.values() for c in own))
    of = F.lit(None).cast("int") if part is None else F.col(part)
    counted = table.groupBy(of.alias("part"), "fold", F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {(r["part"], r["fold"], r["y"]): r["n"] for r in counted}
    found = sorted({(p, f) for p, f, _ in counts}, key=repr)
    cells = [(p, v, f) for p, f in found for v in variants]
    outside = lambda p, f, y: sum(n for (q, g, z), n in counts.items() if q == p and g != f and z == y)
    both = np.array([[outside(p, f, 0), outside(p, f, 1)] for p, _, f in cells], float).reshape(-1, 2)
    rows = both.sum(1)
    weight = np.where(both > 0, rows[:, None] / (2 * np.maximum(both, 1)), 1.0)
    chosen = tuple(np.array([columns.index(c) for c in variants[v]]) for _, v, _ in cells)
    return Cells(columns, tuple(c[0] for c in cells), tuple(c[1] for c in cells), chosen, np.array([c[2] for c in cells]), rows, weight)


def _rows(table: DataFrame, cells: Cells, part: str | None, *keep: str) -> DataFrame:
    of = F.lit(None).cast("int") if part is None else F.col(part)
    return table.select(*keep, of.alias("__part"), F.col("fold").alias("__fold"), F.col("y").cast("int").alias("__y"), *cells.columns)


def _arrays(batch: pa.RecordBatch, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.column_stack([*[batch.column(c).to_numpy(zero_copy_only=False) for c in cells.columns], np.ones(batch.num_rows)])
    part = np.array(batch.column("__part").to_pylist(), object)
    return x, batch.column("__y").to_numpy(), batch.column("__fold").to_numpy(), part


def sums(table: DataFrame, cells: Cells, coefficients: Sequence[np.ndarray], part: str | None, second: bool = True) -> DataFrame:
    """(cell, sums): loss, gradient and, with ``second``, cross products of the data's part of the loss, one row per cell."""
    sizes = [len(c) + 1 for c in cells.chosen]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 + k + (k * k if second else 0)) for k in sizes]
        for batch in batches:
            x, y, fold, part_ = _arrays(batch, cells)
            for i, k in enumerate(sizes):
                used = np.flatnonzero((fold != cells.fold[i]) & (part_ == cells.part[i]))
                own = x[used][:, [*cells.chosen[i], x.shape[1] - 1]]
                z = own @ coefficients[i]
                w, p = cells.weight[i][y[used]], 0.5 * (1 + np.tanh(z / 2))
                total[i][0] += (w * (np.logaddexp(0, z) - y[used] * z)).sum()
                total[i][1 : 1 + k] += own.T @ (w * (p - y[used]))
                if second:
                    total[i][1 + k :] += ((own * (w * p * (1 - p))[:, None]).T @ own).ravel()
        task = TaskContext.get().partitionId()
        cells_ = [pa.array(range(len(sizes)), pa.int32()), pa.array([task] * len(sizes), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())]
        yield pa.RecordBatch.from_arrays(cells_, names=["cell", "task", "sums"])

    def join(found: pa.Table) -> pa.Table:
        parts = found.sort_by("task").column("sums").to_pylist()
        return pa.table({"cell": found.column("cell").slice(0, 1), "sums": pa.array([np.sum([np.frombuffer(p) for p in parts], axis=0).tobytes()], pa.binary())})

    rows = _rows(table, cells, part)
    return rows.mapInArrow(add, "cell int, task int, sums binary").groupBy("cell").applyInArrow(join, "cell int, sums binary")


def gradient(found: np.ndarray, beta: np.ndarray) -> np.ndarray:
    own = found[1 : 1 + len(beta)].copy()
    own[:-1] += PENALTY * beta[:-1]
    return own


def fit(table: DataFrame, cells: Cells, part: str | None = None, max_iter: int = 2000) -> list[np.ndarray]:
    """The coefficients of every cell, intercept last. Raises if one has not converged after ``max_iter`` steps."""
    n = len(cells.fold)
    at = [np.zeros(len(c) + 1) for c in cells.chosen]
    step = [np.zeros_like(b) for b in at]
    before = np.full(n, np.inf)
    for done in range(max_iter + 1):
        found = {r["cell"]: np.frombuffer(r["sums"]) for r in sums(table, cells, at, part).collect()}
        open_ = False
        for i in range(n):
            k = len(at[i])
            loss = found[i][0] + PENALTY / 2 * (at[i][:-1] ** 2).sum()
            own = gradient(found[i], at[i])
            if np.abs(own).max() <= GRADIENT * max(cells.rows[i], 1):
                continue
            open_ = True
            if loss > before[i] * (1 + 1e-12):
                step[i] = step[i] / 2
                at[i] = at[i] - step[i]
                continue
            curved = found[i][1 + k :].reshape(k, k) + np.diag([PENALTY] * (k - 1) + [1e-12])
            before[i], step[i] = loss, -np.linalg.solve(curved, own)
            at[i] = at[i] + step[i]
        if not open_:
            return at
        if done + 1 >= max_iter:
            break
    raise RuntimeError(f"no convergence in {max_iter} iterations")


def score(table: DataFrame, cells: Cells, coefficients: Sequence[np.ndarray], keys: Sequence[str], part: str | None = None) -> DataFrame:
    """(variant, keys..., y, score, part if given): every row scored by the models that left its fold out."""
    keep = [*keys, *([part] if part and part not in keys else [])]
    rows = _rows(table, cells, part, *keep)
    names = list(dict.fromkeys(cells.variant))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, fold, part_ = _arrays(batch, cells)
            out = {v: np.zeros(len(y)) for v in names}
            for i, beta in enumerate(coefficients):
                used = np.flatnonzero((fold == cells.fold[i]) & (part_ == cells.part[i]))
                z = x[used][:, [*cells.chosen[i], x.shape[1] - 1]] @ beta
                out[cells.variant[i]][used] = 0.5 * (1 + np.tanh(z / 2))
            for v in names:
                columns = [pa.array([v] * len(y), pa.string()), *[batch.column(k) for k in keep], batch.column("__y"), pa.array(out[v])]
                yield pa.RecordBatch.from_arrays(columns, names=["variant", *keep, "y", "score"])

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("variant", T.StringType()), *[T.StructField(k, kinds[k]) for k in keep], T.StructField("y", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(work, schema)


def certificate(table: DataFrame, cells: Cells, coefficients: Sequence[np.ndarray], part: str | None = None) -> DataFrame:
    """(part, variant, fold, n_train, largest, converged): the largest gradient of each cell's loss at its coefficients,
    formed anew from the rows, and whether it counts as none."""
    own = [(i, cells.part[i], cells.variant[i], int(cells.fold[i]), int(cells.rows[i])) for i in range(len(coefficients))]
    kind = T.IntegerType() if part is None else table.schema[part].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*own[c][1:], float(np.abs(gradient(np.frombuffer(s), coefficients[c])).max())) for c, s in zip(*[batch.column(k).to_pylist() for k in ("cell", "sums")])]
            kinds = [to_arrow_type(kind), pa.string(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], k) for j, k in enumerate(kinds)], names=["part", "variant", "fold", "n_train", "largest"])

    made = sums(table, cells, coefficients, part, second=False).mapInArrow(work, f"part {kind.simpleString()}, variant string, fold int, n_train long, largest double")
    return made.withColumn("converged", F.col("largest") <= GRADIENT * F.col("n_train"))
