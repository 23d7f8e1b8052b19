"""Folds, permutations, placebo columns and cluster bootstrap weights, all hash-based."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakaudit.functions.hashing import digest, digest_prefix, pick, uniform

_PREFIX_DIGITS = 3
_BLOCK, _BLOCKS = 4096, 2048  # places counted together: at least so many, and at most so many blocks
_DRAWS_AT_ONCE = 1 << 20
SEED = 42


def group_folds(df: DataFrame, k: int = 5, group: str = "stay_id", seed: int = SEED) -> DataFrame:
    """Add ``fold``. It depends on the group alone, so no group is ever in two folds."""
    return df.withColumn("fold", (digest_prefix(digest(seed, "fold", group), 8) % k).cast("int"))


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    purpose: str,
    seed: int = SEED,
    name: str = "idx",
    within: Sequence[str] = (),
    prefix_digits: int = _PREFIX_DIGITS,
) -> DataFrame:
    """Number unique rows 0..n-1 in hash order without one global sort, in each cell of ``within`` anew.

    The hash prefix cuts the rows into 16**prefix_digits even buckets; rows are numbered
    inside their bucket and shifted by the sizes of the buckets before it. The running
    sum of sizes sees one row per bucket, 4096 by default; cells are few.
    """
    hashed = df.withColumn("__h", digest(seed, purpose, *keys)).withColumn(
        "__b", F.coalesce(digest_prefix(F.col("__h"), prefix_digits), F.lit(0))  # never NULL, or the join below would ask so of each row that the caller counts
    )
    inside = Window.partitionBy(*within, "__b").orderBy("__h", *keys)
    earlier = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*within, "__b")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*within, "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    numbered = hashed.withColumn("__place", F.row_number().over(inside)).join(
        offsets if within else F.broadcast(offsets), [*within, "__b"]
    )
    index = (F.col("__before") + F.col("__place") - 1).cast("bigint")
    return numbered.withColumn(name, index).drop("__h", "__b", "__place", "__before")


def permute_label(
    df: DataFrame, label: str, keys: Sequence[str], seed: int = SEED, out: str = "y_shuffled"
) -> DataFrame:
    """Add ``out``: the labels of all rows in a random order, class counts unchanged."""
    giving = dense_index(df.select(*keys, label), keys, "permute_from", seed, "__r").select(
        "__r", F.col(label).alias(out)
    )
    taking = dense_index(df, keys, "permute_to", seed, "__r")
    return taking.join(giving, "__r").drop("__r")


def permute_within(
    df: DataFrame,
    label: str,
    group: str = "stay_id",
    order: str = "bin",
    seed: int = SEED,
    out: str = "y_permuted",
) -> DataFrame:
    """Add ``out``: the labels of each group in a random order. A group has at most one
    row per decision bin."""
    by_order = F.row_number().over(Window.partitionBy(group).orderBy(order))
    by_hash = F.row_number().over(
        Window.partitionBy(group).orderBy(digest(seed, "permute_within", group, order), order)
    )
    giving = df.select(group, F.col(label).alias(out), by_hash.alias("__r"))
    return df.withColumn("__r", by_order).join(giving, [group, "__r"]).drop("__r")


def placebo_column(
    df: DataFrame, label: str, keys: Sequence[str], seed: int = SEED, out: str = "placebo"
) -> DataFrame:
    """Add a coin with the label's prevalence, independent of everything else."""
    prevalence = df.select(F.avg(F.col(label).cast("double"))).scalar()
    return df.withColumn(out, (uniform(seed, "placebo", *keys) < prevalence).cast("double"))


def bootstrap_weights(
    groups: DataFrame, n_boot: int, group: str = "stay_id", seed: int = SEED, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., group, rep, weight): how often each group is drawn in each replicate.

    ``groups`` has one row per cell and group; a replicate makes as many draws in each cell as the
    cell has groups. Every group row carries its own draw of each replicate, so the draws
    are spread like the groups.
    """
    by = list(by)
    indexed = dense_index(groups.select(*by, group), [group], "bootstrap_group", seed, "idx", by)
    if by:
        sized = indexed.join(groups.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), by)
        size = F.col("__n")
    else:
        sized, size = indexed, groups.agg(F.count(F.lit(1))).scalar()
    # a fixed number: a small table of groups still means n_boot draws for each
    spread = sized.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "idx")
    draws = (
        spread.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        .select(*by, "rep", pick(seed, "bootstrap_draw", size, "rep", "idx").alias("idx"))
        .groupBy(*by, "idx", "rep")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return draws.hint("merge").join(indexed, [*by, "idx"]).select(*by, group, "rep", "weight")


def bootstrap_vectors(
    groups: DataFrame, n_boot: int, group: str = "stay_id", seed: int = SEED, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., group, drawn): the weights of ``bootstrap_weights`` as one vector per group, packed as ``drawn_matrix`` reads it. A group
    that no replicate draws has no row.

    A draw depends on the replicate, the drawing place and the number of groups, so cells of equal size share their draws. A task packs its draws by
    the block of places they hit, four bytes each; a block's draws are counted together. Plans can't foresee that a group has ``n_boot`` draws, so what
    is made of them is never offered for a broadcast.
    """
    by = list(by)
    indexed = dense_index(groups.select(*by, group), [group], "bootstrap_group", seed, "idx", by)
    if by:
        indexed = indexed.join(groups.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), by)
    else:
        indexed = indexed.withColumn("__n", groups.agg(F.count(F.lit(1))).scalar())
    places = indexed.select("__n", "idx").distinct() if by else indexed.select("__n", "idx")
    # a fixed number: a small table of groups still means n_boot draws for each
    spread = places.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__n", "idx")

    def width(n: int) -> int:
        return max(_BLOCK, -(-n // _BLOCKS))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def told() -> pa.RecordBatch:
            n, rep, hit = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            sizes, of = np.unique(n, return_inverse=True)
            wide = np.array([width(int(m)) for m in sizes], np.int64)[of]
            block, code = hit // wide, (hit % wide * n_boot + rep).astype(np.uint32)
            order = np.lexsort((block, of))
            n, block, code = n[order], block[order], code[order]
            starts = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (block[1:] != block[:-1])]))
            cells = [code[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(code)])]
            return pa.RecordBatch.from_arrays([pa.array(n[starts]), pa.array(block[starts]), pa.array(cells, pa.binary())], names=["__n", "block", "codes"])

        every = max(1, _DRAWS_AT_ONCE // n_boot)
        for batch in batches:
            for at in range(0, batch.num_rows, every):
                size, place = (np.repeat(batch.column(c).slice(at, every).to_numpy(), n_boot) for c in ("__n", "idx"))
                rep = np.tile(np.arange(n_boot), len(size) // n_boot)
                held.append((size, rep, _hits(seed, n_boot, place[::n_boot], size)))
                many += len(size)
                if many >= _DRAWS_AT_ONCE:
                    yield told()
                    many = 0
        if many:
            yield told()

    def counted(part: pa.Table) -> pa.Table:
        n, block = part.column("__n")[0].as_py(), part.column("block")[0].as_py()
        wide = width(n)
        codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint32)
        weights = np.bincount(codes, minlength=wide * n_boot).reshape(wide, n_boot)
        some = np.flatnonzero(weights.any(1))
        cells = [w.astype(np.uint8 if w.max() < 256 else np.uint32).tobytes() for w in weights[some]]
        return pa.table({"__n": pa.array([n] * len(some), pa.int64()), "idx": pa.array(block * wide + some, pa.int64()), "drawn": pa.array(cells, pa.binary())})

    blocks = spread.mapInArrow(packed, "__n long, block long, codes binary").groupBy("__n", "block")
    vectors = blocks.applyInArrow(counted, "__n long, idx long, drawn binary")
    return indexed.join(vectors.hint("merge"), ["__n", "idx"]).select(*by, group, "drawn")


def _hits(seed: int, n_boot: int, places: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``pick(seed, "bootstrap_draw", size, rep, place)`` of all replicates of each place, one place after another."""
    begun = [f"{seed}|bootstrap_draw|{rep}|".encode() for rep in range(n_boot)]
    ends = [str(place).encode() for place in places.tolist()]
    told = b"".join([md5(a + b).digest() for b in ends for a in begun])
    first = np.frombuffer(told, ">u8").reshape(-1, 2)[:, 0] >> np.uint64(12)  # 13 of 16 hex digits
    return np.floor(first.astype(np.float64) / 2.0**52 * size).astype(np.int64)


def drawn_matrix(cells: pa.Array, n_boot: int) -> np.ndarray:
    """(row, replicate) of packed vectors: a byte per number, or four where one needs more."""
    if len(cells) and not cells.null_count and pa.types.is_binary(cells.type):
        ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
        if (np.diff(ends) == n_boot).all():
            return np.frombuffer(cells.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, n_boot)
    rows = cells.to_pylist()
    if all(len(r) == n_boot for r in rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, n_boot)
    return np.stack([np.frombuffer(r, np.uint8 if len(r) == n_boot else np.uint32) for r in rows])
