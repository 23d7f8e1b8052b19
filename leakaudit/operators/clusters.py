"""k-means of many variants and starts at once: every step is one pass over the rows for all models still moving.

A model is a variant (a set of columns) and a start. Each task adds its rows into (model, cluster) counts, sums and costs, which are
added on the map side again; what reaches the driver follows models, clusters and columns, never rows. Steps read a table of the
distinct rows and their numbers, dealt over the cores; where all rows differ that saves nothing, and the result is the same.

Starts are seeded in parallel: in each of ``SEED_ROUNDS`` passes a model takes the ``2 * clusters`` rows that come first in a race whose odds are
their squared distances to what it has, so that the number of candidates is fixed. One more pass weighs each candidate by the rows nearest
to it, and a weighted k-means++ on the candidates alone makes the first centres. The race's draws are hashes of row and model: a
result does not depend on partitioning, up to the order of floating-point sums.

NULLs count as 0. Of equally near centres the first takes the row. A cluster that loses all rows keeps its centre. Fewer distinct rows than
clusters leave clusters empty. A table without rows has no models and raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakaudit.operators.resample import SEED
from leakaudit.sources.tables import scratch_table

SEED_ROUNDS = 5
TOLERANCE = 1e-4
_ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Clustering:
    """A variant's best start: its centres, the summed squared distances to them and the steps it took."""

    variant: str
    columns: tuple[str, ...]
    start: int
    centres: np.ndarray
    cost: float
    steps: int


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(row, centre), with what is only rounding set to 0."""
    own, theirs = (x**2).sum(1)[:, None], (centres**2).sum(1)[None, :]
    found = own - 2.0 * x @ centres.T + theirs
    return np.where(found <= 1e-12 * (own + theirs), 0.0, found)


def matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """(row, column) of a batch; NULLs count as 0."""
    cells = [batch.column(c).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]
    return np.column_stack(cells) if cells else np.zeros((batch.num_rows, 0))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield batch.slice(at, _ROWS_AT_ONCE)


def _ranked(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each distinct centre, factors): (x, 1) times the factors is the squared distance but for what all centres share."""
    first = np.sort(np.unique(centres, axis=0, return_index=True)[1]) if centres.shape[1] else np.zeros(1, np.int64)
    own = centres[first]
    return first, np.vstack([-2.0 * own.T, (own**2).sum(1)])


def _least_distances(x: np.ndarray, ranked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The squared distance to the nearest centre, with what is only rounding set to 0."""
    factors, own = ranked[1], (x**2).sum(1)
    apart = x @ factors[:-1] + factors[-1]
    nearest = apart.argmin(1)
    found = own + apart[np.arange(len(x)), nearest]
    return np.where(found <= 1e-12 * (own + factors[-1][nearest]), 0.0, found)


def _neighbours(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each run of equal neighbours, and the run of every row."""
    other = np.ones(len(x), bool)
    other[1:] = (x[1:] != x[:-1]).any(1)
    return x[other], np.cumsum(other) - 1


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


def _sums(rows: DataFrame, columns: Sequence[tuple[str, ...]], centres: Mapping[int, np.ndarray], cost: bool = True) -> Mapping[int, tuple[np.ndarray, np.ndarray, float]]:
    """By model: (rows, sums) of each cluster and, if asked for, the cost. ``columns`` are by model too; a sum is padded to the widest. A column
    ``__n`` tells how many rows a row stands for."""
    shared = rows.sparkSession.sparkContext.broadcast(dict(centres))
    width = max(len(columns[m]) for m in centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {m: np.zeros((len(c), width + 2)) for m, c in shared.value.items()}
        ranked = {m: _ranked(c) for m, c in shared.value.items()}
        for batch in _slices(batches):
            many = batch.column("__n").to_numpy().astype(float) if "__n" in batch.schema.names else np.ones(batch.num_rows)
            sets = {own: np.column_stack([matrix(batch, own), np.ones(batch.num_rows)]) for own in {columns[m] for m in shared.value}}
            for m, c in shared.value.items():
                x, (first, scores) = sets[columns[m]], ranked[m]
                nearest = first[(x @ scores).argmin(1)]
                chosen = np.zeros((len(x), len(c)))
                chosen[np.arange(len(x)), nearest] = many
                found = chosen.T @ x
                totals[m][:, 0] += found[:, -1]
                totals[m][:, 2 : 1 + x.shape[1]] += found[:, :-1]
                if cost:
                    totals[m][:, 1] += np.bincount(nearest, many * ((x[:, :-1] - c[nearest]) ** 2).sum(1), len(c))
        for m, total in totals.items():
            some = np.flatnonzero(total[:, 0])
            cells = [pa.array(np.full(len(some), m), pa.int32()), pa.array(some, pa.int32()), _lists(total[some])]
            yield pa.RecordBatch.from_arrays(cells, names=["model", "cluster", "totals"])

    parts = rows.mapInArrow(work, "model int, cluster int, totals array<double>")
    added = parts.groupBy("model", "cluster").agg(vector_to_array(Summarizer.sum(array_to_vector("totals"))).alias("totals"))
    out = {m: (np.zeros(len(c)), np.zeros((len(c), len(columns[m]))), 0.0) for m, c in centres.items()}
    for r in added.orderBy("model", "cluster").toArrow().to_pylist():
        n, sums, cost = out[r["model"]]
        n[r["cluster"]], sums[r["cluster"]] = r["totals"][0], r["totals"][2 : 2 + sums.shape[1]]
        out[r["model"]] = (n, sums, cost + r["totals"][1])
    shared.unpersist()
    return out


def _raced(rows: DataFrame, keys: Sequence[str], columns: Sequence[tuple[str, ...]], chosen: Mapping[int, np.ndarray], most: int, draw: int) -> Mapping[int, np.ndarray]:
    """By model: up to ``most`` rows drawn without replacement, odds by squared distance to the rows chosen (even without any)."""
    shared = rows.sparkSession.sparkContext.broadcast(dict(chosen))
    width = max(len(c) for c in columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {m: (np.zeros(0), np.zeros((0, width)), np.zeros(0, np.int64)) for m in shared.value}
        ranked = {m: _ranked(c) for m, c in shared.value.items() if len(c)}
        for batch in _slices(batches):
            h = batch.column("__h").to_numpy().view(np.uint64)
            sets = {own: _neighbours(matrix(batch, own)) for own in {columns[m] for m in shared.value}}
            for m, c in shared.value.items():
                x, run = sets[columns[m]]
                odds = (_least_distances(x, ranked[m]) if len(c) else np.ones(len(x)))[run]
                some = np.flatnonzero(odds > 0)
                u = (_scatter(h[some], m, draw) >> np.uint64(11)).astype(np.float64) + 0.5
                place = -np.log(u / float(1 << 53)) / odds[some]
                time, found, own = held[m]
                if len(time) == most:
                    ahead = place <= time[-1]
                    some, place = some[ahead], place[ahead]
                if not len(some):
                    continue
                time, own = np.concatenate([time, place]), np.concatenate([own, h[some].view(np.int64)])
                first = np.lexsort((own, time))[:most]
                wide = np.zeros((len(first), width))
                fresh = first >= len(found)
                wide[~fresh] = found[first[~fresh]]
                wide[fresh, : x.shape[1]] = x[run[some[first[fresh] - len(found)]]]
                held[m] = (time[first], wide, own[first])
        for m, (time, found, own) in held.items():
            cells = [pa.array(np.full(len(time), m), pa.int32()), pa.array(time), pa.array(own), _lists(found)]
            yield pa.RecordBatch.from_arrays(cells, names=["model", "time", "h", "x"])

    parts = rows.withColumn("__h", F.xxhash64(*keys)).mapInArrow(work, "model int, time double, h long, x array<double>")
    place = F.row_number().over(Window.partitionBy("model").orderBy("time", "h"))
    first = parts.withColumn("place", place).filter(F.col("place") <= most).orderBy("model", "place").toArrow()
    model = first.column("model").to_numpy()
    x = np.array(first.column("x").to_pylist()).reshape(len(model), width)
    shared.unpersist()
    return {m: x[model == m][:, : len(columns[m])] for m in chosen}


def _scatter(h: np.ndarray, model: int, draw: int) -> np.ndarray:
    x = h ^ np.uint64((model * 0x9E3779B97F4A7C15 + draw * 0xC2B2AE3D27D4EB4F) % (1 << 64))
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def weighted_plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, steps: int = 30) -> np.ndarray:
    """k centres of a bounded set of weighted points: each next one drawn by weight times squared distance, then moved to their means."""
    weights = np.maximum(weights, 1e-300)
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    near = squared_distances(points, points[chosen]).min(1)
    while len(chosen) < k:
        odds = weights * near
        total = odds.sum()
        chosen.append(int(rng.choice(len(points), p=odds / total)) if total > 0 else chosen[0])
        near = np.minimum(near, squared_distances(points, points[chosen[-1:]])[:, 0])
    centres = points[chosen].copy()
    for _ in range(steps):
        nearest = squared_distances(points, centres).argmin(1)
        n = np.bincount(nearest, weights, k)
        sums = np.stack([np.bincount(nearest, weights * p, k) for p in points.T], axis=1) if points.shape[1] else centres * n[:, None]
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def every_start(
    table: DataFrame, variants: Mapping[str, Sequence[str]], keys: Sequence[str], clusters: int, starts: int = 10, rounds: int = 300, seed: int = SEED
) -> list[Clustering]:
    """A model for every variant and start. One that still moves after ``rounds`` steps fails.

    ``table`` should be a stage table; ``keys`` tell its rows apart and are what draws are hashed from.
    """
    names = list(variants)
    models = [(v, s) for v in names for s in range(starts)]
    columns = [tuple(variants[v]) for v, _ in models]
    needed = list(dict.fromkeys(c for own in columns for c in own))
    cores, hashed = table.sparkSession.sparkContext.defaultParallelism, [f"__k{i}" for i in range(len(keys))]
    # A pass costs models x centres a row, whatever it reads: rows are written once, evenly, and not joined or read from few files in every pass.
    points = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in needed]
    # Equal rows stand next to each other, and distances are formed once for them.
    keyed = table.select(*[F.col(k).alias(h) for k, h in zip(keys, hashed)], *points)
    keyed = scratch_table(keyed.repartition(cores, *hashed).sortWithinPartitions(*needed), "points")
    rows = scratch_table(keyed.groupBy(*needed).agg(F.count(F.lit(1)).alias("__n")).repartition(cores, *needed), "kinds")
    rows = rows.coalesce(max(1, min(cores, -(-rows.count() // _ROWS_AT_ONCE))))

    chosen = {m: np.zeros((0, len(columns[m]))) for m in range(len(models))}
    for draw in range(SEED_ROUNDS + 1):
        more = _raced(keyed, hashed, columns, chosen, 2 * clusters if draw else 1, seed * (SEED_ROUNDS + 1) + draw)
        chosen = {m: np.concatenate([chosen[m], more[m]]) for m in chosen}
    if not all(len(c) for c in chosen.values()):
        raise ValueError("no rows to cluster")
    weighed = _sums(rows, columns, chosen, cost=False)
    centres = {m: weighted_plus_plus(chosen[m], weighed[m][0], clusters, np.random.default_rng([seed, m])) for m in chosen}

    moving, taken = dict(centres), {}
    for step in range(1, rounds + 1):
        found = _sums(rows, columns, moving, cost=False)
        for m, (n, sums, _) in found.items():
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], moving[m])
            far = np.sqrt(((moved - moving[m]) ** 2).sum(1).max())
            centres[m] = moved
            if far <= TOLERANCE:
                taken[m] = step
        moving = {m: centres[m] for m in moving if m not in taken}
        if not moving:
            break
    if moving:
        stuck = ", ".join(f"{models[m][0]} start {models[m][1]}" for m in moving)
        raise RuntimeError(f"k-means: no convergence in {rounds} iterations: {stuck}")
    ends = _sums(rows, columns, centres)
    return [Clustering(v, columns[m], s, centres[m], ends[m][2], taken[m]) for m, (v, s) in enumerate(models)]


def least_cost(found: Sequence[Clustering]) -> list[Clustering]:
    """Each variant's model of least cost, the earlier start on a tie."""
    best: dict[str, Clustering] = {}
    for c in found:
        if c.variant not in best or c.cost < best[c.variant].cost:
            best[c.variant] = c
    return list(best.values())


def assigned(table: DataFrame, chosen: Sequence[Clustering], kept: Sequence[str]) -> DataFrame:
    """(variant, kept..., cluster, distance): every row placed by every model, with its squared distance."""
    needed = list(dict.fromkeys(c for model in chosen for c in model.columns))
    tagged = table.select(*[F.col(c).alias(f"__kept_{c}") for c in kept], *needed)
    fields = ", ".join(f"`{c}` {dict(table.dtypes)[c]}" for c in kept)
    shared = table.sparkSession.sparkContext.broadcast(list(chosen))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for model in shared.value:
                apart = squared_distances(matrix(batch, model.columns), model.centres)
                nearest = apart.argmin(1)
                cells = [pa.array([model.variant] * batch.num_rows, pa.string()), *[batch.column(f"__kept_{c}") for c in kept],
                         pa.array(nearest.astype(np.int32)), pa.array(apart[np.arange(len(nearest)), nearest])]
                yield pa.RecordBatch.from_arrays(cells, names=["variant", *kept, "cluster", "distance"])

    return tagged.mapInArrow(work, f"variant string, {fields + ', ' if fields else ''}cluster int, distance double")


# --- boosting over cells ------------------------------------------------------------------


def boosted_values(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, asked: np.ndarray, rounds: int, depth: int = 3, rate: float = 0.1) -> np.ndarray:
    """Values at ``asked`` of boosted regression trees on weighted cells, squared loss, cut midway between neighbouring values.

    Rows of one cell share their columns, so their mean and number are all that least squares sees.
    """
    base = float((weight * mean).sum() / weight.sum())
    fitted, out = np.full(len(x), base), np.full(len(asked), base)

    def grow(inside: np.ndarray, there: np.ndarray, left: int, residual: np.ndarray) -> None:
        w, r = weight[inside], residual[inside]
        value, best, gain = (w * r).sum() / w.sum(), None, (w * r).sum() ** 2 / w.sum()
        floor = gain + 1e-12 * max(1.0, (w * r**2).sum())
        for j in range(x.shape[1]) if left else ():
            order = np.argsort(x[inside, j], kind="stable")
            own, cw, cs = x[inside, j][order], np.cumsum(w[order]), np.cumsum((w * r)[order])
            for i in np.flatnonzero(own[1:] > own[:-1]):
                score = cs[i] ** 2 / cw[i] + (cs[-1] - cs[i]) ** 2 / (cw[-1] - cw[i])
                if score > floor and score > gain:
                    gain, best = score, (j, (own[i] + own[i + 1]) / 2)
        if best is None:
            fitted[inside] += rate * value
            out[there] += rate * value
            return
        j, cut = best
        grow(inside[x[inside, j] <= cut], there[asked[there, j] <= cut], left - 1, residual)
        grow(inside[x[inside, j] > cut], there[asked[there, j] > cut], left - 1, residual)

    for _ in range(rounds):
        grow(np.arange(len(x)), np.arange(len(asked)), depth, mean - fitted)
    return out
