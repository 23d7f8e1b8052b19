"""Approximate nearest neighbours by cosine: a hierarchical k-means tree.

The tree is fitted on at most ``FIT_ROWS`` vectors of the smallest hash and sent to every task, but every row is
assigned to a leaf. A query walks the tree best-bin-first: of the nodes seen, the one with the nearest centre is opened next, which gives its
leaves in order. How many leaves are visited is calibrated per class of queries, a class being how many ids the query's own leaf holds
and how far from its centre the query lies: ``CALIBRATION`` queries of each class are
searched by brute force, in blocks against all rows, and the class's visits widen until the tree finds ``RECALL`` of those neighbours; as many
rows of the whole table give the least for all classes. A query
goes on beyond them until its leaves hold k other ids.

Leaves are dealt into at most ``REGIONS`` regions of about as many rows, a crowded leaf into several, and queries into chunks that a
task can hold. A region and a chunk meet in a partition: the task holds the chunk and streams the region's packed rows past it, leaf by
leaf, so no task holds more as the table grows. A query goes to a region once, with a bit for each leaf it visits there. Scores of
blocks are matrix products in single precision; what may be among a query's k best, given the error of those, is scored from the
original components in double precision, row by row, so equal vectors have equal scores. The k-th best id of the fitted sample
within the visited leaves bounds the k best from the start.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do null ids; vectors of each length are searched among themselves, with a tree each; rows that share an id count once, with the best score, and are never
their own neighbour; ties go to the smaller id; with fewer candidates all are returned; an empty
table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakaudit.llm.common import materialise, mix64

FIT_ROWS = 20_000
BRANCHES = 8
LEAF_ROWS = 64
ROUNDS = 8
CALIBRATION = 128
RECALL = 0.97
REGIONS = 32
REGION_ROWS = 4096
CHUNK_BYTES = 32 << 20  # of single-precision vectors; the rest of a query takes about twice as much
QUERY_BLOCK = 1024
ROW_BLOCK = 2048
PAIR_BYTES = 8 << 20


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, v in double precision."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    """centres[i] and children[i] of node i; a leaf has no children."""

    def __init__(self, sample: np.ndarray):
        self.centres, self.children = [np.zeros(sample.shape[1])], [[]]
        self._split(0, sample)
        self.centre_matrix = np.array(self.centres)
        self.leaves, self.paths = self._paths()
        self.place = np.full(len(self.centres), -1)
        self.place[self.leaves] = np.arange(len(self.leaves))

    def _split(self, node: int, x: np.ndarray) -> None:
        if len(x) <= LEAF_ROWS:
            return
        centres = x[np.linspace(0, len(x) - 1, BRANCHES).astype(int)]
        for _ in range(ROUNDS):
            own = np.argmax(x @ centres.T, axis=1)
            sums = np.array([x[own == b].sum(0) if (own == b).any() else centres[b] for b in range(BRANCHES)])
            length = np.sqrt((sums * sums).sum(1, keepdims=True))
            centres = sums / np.where(length > 0, length, 1)
        own = np.argmax(x @ centres.T, axis=1)
        groups = [b for b in range(BRANCHES) if (own == b).any()]
        if len(groups) < 2:
            return
        for b in groups:
            self.children[node].append(len(self.centres))
            self.centres.append(centres[b])
            self.children.append([])
        for child, b in zip(list(self.children[node]), groups):
            self._split(child, x[own == b])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each unit vector descends to."""
        node = np.zeros(len(x), np.int64)
        for n in range(len(self.centres)):  # parents come before their children
            if kids := self.children[n]:
                at = np.flatnonzero(node == n)
                if len(at):
                    node[at] = np.array(kids)[np.argmax(np.round(x[at] @ self.centre_matrix[kids].T, 9), axis=1)]  # a tie goes one way in every batch
        return node

    def _paths(self) -> tuple[np.ndarray, np.ndarray]:
        """The leaves, those of a branch side by side, and the nodes below the root on the way to each; -1 fills up."""
        found, stack = [], [(0, ())]
        while stack:
            node, path = stack.pop()
            if not self.children[node]:
                found.append((node, path))
            stack.extend((child, (*path, child)) for child in reversed(self.children[node]))
        paths = np.full((len(found), max(1, max(len(path) for _, path in found))), -1)
        for row, (_, path) in zip(paths, found):
            row[: len(path)] = path
        return np.array([node for node, _ in found]), paths

    def order(self, q: np.ndarray) -> np.ndarray:
        """Places of the leaves in best-bin-first order, for each query. Of two leaves the one comes first whose way, from the
        branch they share, has the nearer worst node: the worst nodes from each depth on, compared one after another."""
        near = np.concatenate([q @ self.centre_matrix.T, np.full((len(q), 1), np.inf)], axis=1)
        worst = np.minimum.accumulate(near[:, self.paths[:, ::-1]], axis=2)  # the last is that of the whole way
        return np.lexsort(np.moveaxis(-worst, 2, 0), axis=-1)

    def tile(self) -> int:
        """How many queries to order at once."""
        return max(1, min(QUERY_BLOCK, (1 << 21) // self.paths.size))

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        yield from self.leaves[self.order(q[None])[0]].tolist()


def cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, so that equal rows have equal results."""
    return (rows * q).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum()))


def distinct(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Where the rows are, without those whose vector k + 1 smaller ids have too: they are in no query's k best."""
    bits = np.ascontiguousarray(x).view(f"u{x.itemsize}").astype(np.uint64)
    key = (bits * mix64(np.arange(1, x.shape[1] + 1, dtype=np.uint64))).sum(1)
    at = np.lexsort((ids, key))
    first = np.concatenate([[True], (key[at[1:]] != key[at[:-1]]) | (bits[at[1:]] != bits[at[:-1]]).any(1)])
    keep = first | np.concatenate([[True], ids[at[1:]] != ids[at[:-1]]])
    at, begins = at[keep], np.flatnonzero(first[keep])
    nth = np.arange(len(at)) - np.repeat(begins, np.diff([*begins, len(at)]))
    return np.sort(at[nth <= k])


def slack(size: int) -> float:
    """More than twice the error of a product of two unit vectors in single precision."""
    return (size + 8) * 2.0**-22


class Sample:
    """One vector for each id of the fitted sample, with the place of its leaf."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, tree: Tree):
        self.ids, at = np.unique(ids, return_index=True)
        self.unit, self.place = unit[at].astype(np.float32), tree.place[tree.leaf_of(unit[at])]

    def bars(self, ids: np.ndarray, unit: np.ndarray, k: int, visited: np.ndarray | None = None) -> np.ndarray:
        """A lower bound of each query's k-th best score, within the leaves it visits."""
        out = np.full(len(ids), -np.inf)
        if len(self.ids) < k:
            return out
        step = max(1, (1 << 21) // len(self.ids))
        for j in range(0, len(ids), step):
            near = unit[j : j + step].astype(np.float32) @ self.unit.T
            at = np.minimum(np.searchsorted(self.ids, ids[j : j + step]), len(self.ids) - 1)
            own = np.flatnonzero(self.ids[at] == ids[j : j + step])
            near[own, at[own]] = -np.inf
            if visited is not None:
                near[~visited[j : j + step][:, self.place]] = -np.inf
            out[j : j + step] = np.partition(near, len(self.ids) - k, axis=1)[:, len(self.ids) - k]
        return out - slack(unit.shape[1])


class Best:
    """The k best ids that each query has met so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, bars: np.ndarray):
        self.ids, self.x, self.k, self.bars = ids, x, k, bars.copy()
        self.unit = _unit(x.astype(np.float64)).astype(np.float32)
        self.score = np.full((len(ids), k), -np.inf)
        self.vec, self.leaf = np.zeros((2, len(ids), k), np.int64)

    def meet(self, at: np.ndarray, ids: np.ndarray, x: np.ndarray, leaf: np.ndarray) -> None:
        """The queries at ``at`` meet rows."""
        unit = _unit(x).astype(np.float32)
        one = np.unique(ids, return_index=True)[1]
        error, pairs = slack(x.shape[1]), max(1, PAIR_BYTES // (8 * x.shape[1]))
        for j in range(0, len(at), QUERY_BLOCK):
            here = at[j : j + QUERY_BLOCK]
            near = self.unit[here] @ unit.T
            if len(one) > self.k + 1 and len(open_ := np.flatnonzero(self.bars[here] == -np.inf)):  # one of k + 1 ids can be the query's own
                self.bars[here[open_]] = np.partition(near[open_][:, one], len(one) - self.k - 1, axis=1)[:, len(one) - self.k - 1] - error
            q, row = np.nonzero(~(near < (self.bars[here] - error)[:, None]))
            for i in range(0, len(q), pairs):
                self._add(here[q[i : i + pairs]], row[i : i + pairs], ids, x, leaf)

    def _add(self, at: np.ndarray, row: np.ndarray, ids: np.ndarray, x: np.ndarray, leaf: np.ndarray) -> None:
        other = self.ids[at] != ids[row]
        at, row = at[other], row[other]
        a, b = x[row], self.x[at].astype(np.float64)
        score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))  # as cosines
        asked, q = np.unique(at, return_inverse=True)
        old_q, old = np.nonzero(self.score[asked] != -np.inf)
        q, vec = np.concatenate([old_q, q]), np.concatenate([self.vec[asked][old_q, old], ids[row]])
        score, of = np.concatenate([self.score[asked][old_q, old], score]), np.concatenate([self.leaf[asked][old_q, old], leaf[row]])
        by = np.lexsort((-score, vec, q))
        by = by[np.concatenate([[True], (q[by[1:]] != q[by[:-1]]) | (vec[by[1:]] != vec[by[:-1]])])] if len(by) else by  # an id counts once
        by = by[np.lexsort((vec[by], -score[by], q[by]))]
        nth = np.arange(len(by)) - np.searchsorted(q[by], q[by])
        by, nth = by[nth < self.k], nth[nth < self.k]
        to = asked[q[by]], nth
        self.score[to], self.vec[to], self.leaf[to] = score[by], vec[by], of[by]
        self.bars[asked] = np.fmax(self.bars[asked], self.score[asked, self.k - 1])

    def found(self) -> pa.RecordBatch:
        q, n = np.nonzero(self.score != -np.inf)
        return _found(self.ids[q], self.vec[q, n], self.score[q, n], self.leaf[q, n])


def _top(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score, ...): the k best of what tasks have found."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("leaf").alias("leaf"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "leaf")


FOUND = "query_id long, vec_id long, score double, leaf long"


def _found(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score", "leaf"])


def smallest(rows: DataFrame, n: int, *salt: int) -> DataFrame:
    """The n rows of smallest hash, in its order. A count by the hash's first bits tells which rows can be among them, so that
    tasks don't send n rows each; rows of one id, which share their hash, send n from four tasks at most."""
    hash_ = F.xxhash64("id", *[F.lit(x) for x in salt])
    return _below(rows, n, hash_).repartition(4).orderBy(hash_, "id", "v").limit(n)


def _below(rows: DataFrame, n: int, hash_: Column) -> DataFrame:
    digit = F.shiftright(hash_, 52)
    seen, last = 0, 0
    for r in rows.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).orderBy("digit").collect():  # 4096 at most
        seen, last = seen + r.n, r.digit
        if seen >= n:
            break
    return rows.where(digit <= last)


def brute_force(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int, tree: Tree, sample: Sample) -> DataFrame:
    """The true neighbours of a stated, bounded list of queries, in blocks against all rows."""
    ids, x = np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries])
    sent = rows.sparkSession.sparkContext.broadcast((ids, x, sample.bars(ids, _unit(x), k), tree))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, bars, tree = sent.value
        best, every = Best(ids, x, k, bars), np.arange(len(ids))
        for batch in batches:
            for j in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(j, ROW_BLOCK)
                vec, v = part.column("id").to_numpy(), _matrix(part.column("v"))
                best.meet(every, vec, v, tree.leaf_of(_unit(v)))
        yield best.found()

    return _top(rows.mapInArrow(work, FOUND), k)


def _packed(x: np.ndarray) -> bytes:
    """In single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def _unpacked(ids: bytes, x: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids) // 8
    return np.frombuffer(ids, np.int64), np.frombuffer(x, np.float32 if len(x) < 8 * n * size else np.float64).reshape(n, size)


def _joined(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The blocks of a leaf, joined to ``ROW_BLOCK`` rows or a few more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for block in blocks:
        held.append(block)
        n += len(block[0])
        if n >= ROW_BLOCK:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def leaf_ids(packed: DataFrame) -> dict[int, int]:
    """How many ids each leaf holds; an id of several leaves counts in one, so sums over leaves never exceed the ids there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(a.as_py() + b.as_py(), np.int64) for a, b in zip(batch.column("ids"), batch.column("more"))]
            leaf = np.repeat(batch.column("leaf").to_numpy(), [len(i) for i in ids])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*ids, np.zeros(0, np.int64)])), pa.array(leaf)], names=["id", "leaf"])

    one = packed.select("leaf", "ids", "more").mapInArrow(work, "id long, leaf long").groupBy("id").agg(F.min("leaf").alias("leaf"))
    return {r.leaf: r.n for r in one.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per leaf


def classes(tree: Tree, held: dict[int, int], unit: np.ndarray, k: int) -> np.ndarray:
    """The class of each unit vector: by the ids in its leaf (none to spare, up to about 2 k, 4 k, more) and the angle to its centre in eighths of a half turn."""
    leaf = tree.leaf_of(unit)
    crowd = np.array([min((held.get(n, 0) // (k + 1)).bit_length(), 3) for n in leaf.tolist()], np.int64)
    angle = np.arccos(np.clip((unit * tree.centre_matrix[leaf]).sum(1), -1, 1))
    return crowd * 8 + np.minimum((angle * 8 / np.pi).astype(np.int64), 7)


def calibrate(asking: DataFrame, rows: DataFrame, tree: Tree, held: dict[int, int], k: int, recall: float, sample: Sample) -> dict[int, int]:
    """The number of leaves to visit by class of query. ``asking`` holds the queries among ``rows``."""
    schema = "id long, v array<double>, class long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            kind = classes(tree, held, _unit(x), k) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(kind)], names=["id", "v", "class"])

    order = F.row_number().over(Window.partitionBy("class").orderBy(F.xxhash64("id", F.lit(3)), "id"))
    few = asking.mapInArrow(work, schema).withColumn("n", order).where(F.col("n") <= CALIBRATION).collect()  # bounded per class
    chosen = [(r.id, np.array(r.v), r["class"]) for r in few]
    chosen += [(r.id, np.array(r.v), None) for r in smallest(rows, CALIBRATION, 3).collect()]  # of the whole table: the least for all
    chosen = list({(q, kind): (q, v, kind) for q, v, kind in chosen}.values())
    true = brute_force(rows, list({q: (q, v) for q, v, _ in chosen}.values()), k, tree, sample).select("query_id", "leaf").collect()  # k rows per chosen vector
    by: dict[int, list[int]] = {}
    for r in true:
        by.setdefault(r.query_id, []).append(r.leaf)
    most = sum(not c for c in tree.children)
    needed: dict[int | None, list[int]] = {}
    for j in range(0, len(chosen), tree.tile()):
        some = chosen[j : j + tree.tile()]
        rank = np.argsort(tree.order(_unit(np.array([v for _, v, _ in some]))), axis=1)
        for at, (q, _, kind) in zip(rank, some):
            needed.setdefault(kind, []).extend(at[tree.place[by.get(q, [])]] + 1)
    out = {}
    for kind, ranks in needed.items():
        visits = 1
        while ranks and visits < most and (np.array(ranks) <= visits).mean() < recall:
            visits = visits + max(1, visits // 4)
        out[kind] = min(visits, most)
    least = out.pop(None, 1)
    return {kind: max(least, visits) for kind, visits in out.items()}


def visit(tree: Tree, held: dict[int, int], unit: np.ndarray, visits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the leaves in order, whether the query visits them): ``visits`` of them, and more until they hold k ids besides its own."""
    order = tree.order(unit)
    ids = np.array([held.get(n, 0) for n in tree.leaves.tolist()])[order]
    return order, (np.arange(len(tree.leaves)) < visits[:, None]) | (np.cumsum(ids, axis=1) - ids <= k)


def walk(tree: Tree, held: dict[int, int], unit: np.ndarray, visits: int, k: int) -> Iterator[int]:
    """The leaves one query visits, in order."""
    order, goes = visit(tree, held, unit[None], np.array([visits]), k)
    yield from tree.leaves[order[goes]].tolist()


def spans(counts: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last of ``parts`` about equal parts, side by side, that each count falls into; only what is more than a part falls into several."""
    quota = max(1, -(-int(counts.sum()) // parts))
    start = np.cumsum(counts) - counts
    first = np.minimum(start // quota, parts - 1)
    return first, np.where(counts > quota, (start + counts - 1) // quota, first)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): neighbours of the rows whose id is divisible by ``every``."""
    rows = materialise(usable(vectors, key, vector), "vectors")
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("asking"))
    found = [_nearest_of_length(rows.where(F.size("v") == r.size), every, k, recall) for r in sizes.where("n > 1 and asking > 0").orderBy("size").collect()]
    if not found:
        return rows.limit(0).selectExpr("id query_id", "cast(0 as int) rank", "id vec_id", "cast(0 as double) score")
    every_length = found[0] if len(found) == 1 else _top(functools.reduce(DataFrame.unionByName, found), k)  # an id can have several lengths
    return every_length.select("query_id", "rank", "vec_id", "score")


def _nearest_of_length(rows: DataFrame, every: int, k: int, recall: float) -> DataFrame:
    """(query_id, rank, vec_id, score, leaf) among vectors of one length."""
    fitted = smallest(rows, FIT_ROWS).select("id", "v").toArrow().combine_chunks()  # bounded
    unit = _unit(_matrix(fitted.column("v").combine_chunks()))
    tree = Tree(unit)
    sample = Sample(fitted.column("id").to_numpy(), unit, tree)
    sent = rows.sparkSession.sparkContext.broadcast((tree, sample))  # FIT_ROWS vectors and FIT_ROWS / LEAF_ROWS x BRANCHES centres at most
    size = unit.shape[1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("v"))
            leaf = sent.value[0].leaf_of(_unit(x))
            once = np.zeros(len(ids), bool)
            once[distinct(ids, x, k)] = True  # equal vectors have one leaf
            cells = []
            for n in np.unique(leaf):
                at = np.flatnonzero(leaf == n)
                kept, more, asked = at[once[at]], at[~once[at]], int((ids[at] % every == 0).sum())
                for j in range(0, len(kept), ROW_BLOCK):
                    block = kept[j : j + ROW_BLOCK]
                    cells.append((int(n), ids[block].tobytes(), _packed(x[block]), ids[more].tobytes() if not j else b"", asked if not j else 0))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*cells), kinds)], names=["leaf", "ids", "x", "more", "asked"])

    packed = materialise(rows.mapInArrow(pack, "leaf long, ids binary, x binary, more binary, asked long"), "leaves")
    held = leaf_ids(packed)
    asking = rows.where(F.col("id") % every == 0)
    visits = calibrate(asking, rows, tree, held, k, recall, sample)
    widest = max(visits.values(), default=1)

    sums = packed.groupBy("leaf").agg(F.sum(F.octet_length("ids")).alias("bytes"), F.sum("asked").alias("asked")).collect()  # a row per leaf
    counts = np.zeros((2, len(tree.leaves)), np.int64)
    for r in sums:
        counts[:, tree.place[r.leaf]] = r.bytes // 8, r.asked
    regions = max(1, min(REGIONS, -(-int(counts[0].sum()) // REGION_ROWS)))
    chunks = max(1, -(-int(counts[1].sum()) * 4 * size // CHUNK_BYTES))
    region, chunk = spans(counts[0], regions), spans(counts[1], chunks)
    inside = [np.flatnonzero((region[0] <= r) & (r <= region[1])) for r in range(regions)]  # leaves side by side

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, fitted = sent.value
        for batch in batches:
            for j in range(0, batch.num_rows, t.tile()):
                cells: list[tuple] = []
                part = batch.slice(j, t.tile())
                ids, x = part.column("id").to_numpy(), _matrix(part.column("v"))
                unit = _unit(x)
                order, goes = visit(t, held, unit, np.array([visits.get(kind, widest) for kind in classes(t, held, unit, k).tolist()]), k)
                visited = np.zeros(goes.shape, bool)
                np.put_along_axis(visited, order, goes, axis=1)
                bars = fitted.bars(ids, unit, k, visited)
                first, last = (c[t.place[t.leaf_of(unit)]] for c in chunk)
                mine = first + (mix64(ids.astype(np.uint64)) % (last - first + 1).astype(np.uint64)).astype(np.int64)
                for r, leaves in enumerate(inside):
                    goes_there = visited[:, leaves].any(1)
                    for c in np.unique(mine[goes_there]).tolist():
                        at = np.flatnonzero(goes_there & (mine == c))
                        cells.append((r * chunks + c, 0, 0, ids[at].tobytes(), _packed(x[at]), bars[at].tobytes(), np.packbits(visited[at][:, leaves], axis=1).tobytes()))
                kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*cells), kinds)], names=["part", "kind", "leaf", "ids", "x", "bars", "bits"])

    asks = materialise(asking.mapInArrow(ask, "part int, kind int, leaf long, ids binary, x binary, bars binary, bits binary"), "asks")
    asked = {r.part for r in asks.select("part").distinct().collect()}  # regions x chunks at most
    to = [[[r * chunks + c for c in range(chunks) if r * chunks + c in asked] for r in range(a, b + 1)] for a, b in zip(*region)]
    ways = rows.sparkSession.createDataFrame(pa.table({"at": tree.leaves, "to": pa.array(to, pa.list_(pa.list_(pa.int32())))}))  # a row per leaf
    way = F.explode(F.get("to", F.pmod(F.xxhash64("ids"), F.size("to")).cast("int")))
    dealt = packed.join(F.broadcast(ways), F.col("leaf") == F.col("at")).select(way.alias("part"), F.lit(1).alias("kind"), "leaf", "ids", "x", F.lit(b"").alias("bars"), F.lit(b"").alias("bits"))
    meet = asks.unionByName(dealt).repartitionById(regions * chunks, F.col("part")).sortWithinPartitions("part", "kind", "leaf", F.xxhash64("ids"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        for part, group in itertools.groupby(cells, key=lambda c: c[0]):
            leaves, best, asking = inside[part // chunks], None, []
            for (kind, leaf), blocks in itertools.groupby(group, key=lambda c: c[1:3]):
                if not kind:
                    asking = [(*_unpacked(ids, x, size), np.frombuffer(bars), np.frombuffer(bits, np.uint8)) for *_, ids, x, bars, bits in blocks]
                    continue
                if best is None:
                    ids, x, bars, bits = (np.concatenate(c) for c in zip(*asking))
                    best, asking = Best(ids, x, k, bars), []
                    visited = np.unpackbits(bits.reshape(len(ids), -1), axis=1, count=len(leaves)).view(bool)
                at = np.flatnonzero(visited[:, np.searchsorted(leaves, sent.value[0].place[leaf])])
                for ids, x in _joined(_unpacked(ids, x, size) for *_, ids, x, _, _ in blocks):
                    kept = distinct(ids, x, k)
                    best.meet(at, ids[kept], x[kept].astype(np.float64), np.full(len(kept), leaf))
            if best is not None:
                yield best.found()

    return _top(meet.mapInArrow(search, FOUND), k)
