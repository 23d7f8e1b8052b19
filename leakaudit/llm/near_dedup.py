"""MinHash near-duplicates: an inverted join on signature coordinates.

1. Each text becomes a set of word shingles (64-bit hashes of whole texts), a fingerprint
   of the set and a signature of ``COORDINATES`` minima. Texts with equal sets form one
   class; the rest works on one row per class.
2. The first ``POSTED`` coordinates are posted as (coordinate, value). Two sets that agree
   in at least ``POSTED - PREFIX + 1`` of them share a pair among the ``PREFIX`` rarest pairs of
   each, so only these are posted; pairs held once are skipped. At similarity 0.8 the
   number of agreements is binomial, and falls below that bound with probability 4e-6.
3. In each posting list every class meets a few pivots of the list, so a list of m
   classes gives a multiple of m pairs. The first pivot is the class whose pairs are held most: the middle
   of a family of copies. Collisions are counted over the whole signature
   (``AGREE`` of ``COORDINATES`` four-bit values, missed at 0.8 with probability 1e-6), and what is
   above is confirmed on the full shingle sets.
4. Links are closed to components. Whatever meets in a posting list but still lies in
   different components is then compared as well, outside a list's largest component, so that
   no link depends on the choice of pivots: first with further pivots of that component, then with
   every class left, each pair in the rarest list that it shares. Lists skip what can't reach the threshold: a shingle
   that no other open class holds is in no intersection, so its class shares at most the rest with any other. A class
   whose rest is too small beside the least set of a list leaves that list, and a pair is only formed if the rest of both
   suffices. The bound is exact. What is formed counts on a finer signature of ``FINE`` coordinates
   (``FINE_AGREE`` are missed at 0.8 with probability 1e-6), which the near misses of a family rarely reach.

Texts are shuffled once to find those of the classes in question.

Defined results: null, empty and blank texts have an empty set, no links, and stay; a text
shorter than a shingle is one shingle; a null id is never the smallest of a group unless all
are null; rows that share an id and a text share one decision, and one of them is kept; an empty table gives an empty
result; other columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakaudit.llm.common import materialise, mix64, slices, word_hashes
from leakaudit.llm.components import components

COORDINATES = 128
POSTED = 32
PREFIX = 19
AGREE = 82
FINE = 512
FINE_AGREE = 372
HASHED_PIVOTS = 2
ROUNDS, ROUND_PIVOTS = 2, 6
SKIPS = 2

_MULTIPLIERS = (mix64(np.arange(1, FINE + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (mix64(np.arange(1001, 1001 + FINE, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_PLACES = [np.uint64(x) for x in mix64(np.arange(501, 533, dtype=np.uint64)) | np.uint64(1)]


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ordered within each text; number per text)."""
    ends = np.cumsum(counts)
    starts = ends - counts
    many = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), many)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + starts[owner]
    value = np.zeros(len(owner), np.uint64)
    last = ends[owner]
    for i in range(n):
        at = first + i
        inside = at < last
        value += np.where(inside, words[np.minimum(at, max(len(words) - 1, 0))], np.uint64(0)) * _PLACES[i]
    value = mix64(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(counts))


def _minima(values: np.ndarray, many: np.ndarray, k: int) -> np.ndarray:
    """The k smallest-hash coordinates of each text's shingles."""
    full = np.flatnonzero(many)
    starts = (np.cumsum(many) - many)[full]
    signature = np.zeros((len(many), k), np.uint32)
    if len(full):
        narrow = (values >> np.uint64(32)).astype(np.uint32)
        for i in range(k):
            signature[full, i] = np.minimum.reduceat(narrow * _MULTIPLIERS[i] + _SHIFTS[i], starts)
    return signature


def _four_bits(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen to a number."""
    short = ((signature * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint64).reshape(len(signature), -1, 16)
    return np.bitwise_or.reduce(short << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """(id, mark, n_shingles, print, posted, s0..): mark tells texts of one id apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, counts = word_hashes(batch.column("text"))
            values, many = shingle_hashes(words, counts, n)
            full = np.flatnonzero(many)
            starts = (np.cumsum(many) - many)[full]
            rows = len(many)
            prints = np.zeros((rows, 2), np.uint64)
            if len(full):
                prints[full, 0] = np.add.reduceat(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
                prints[full, 1] = np.bitwise_xor.reduceat(mix64(values * _PLACES[0]), starts) + many[full].astype(np.uint64)
            signature = _minima(values, many, COORDINATES)
            packed = _four_bits(signature)
            posted = (np.arange(POSTED, dtype=np.int64) << 32) | signature[:, :POSTED].astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * POSTED), pa.array(posted.ravel()))
            print_ = pa.array([p.tobytes() for p in prints], pa.binary())
            cells = [pa.array(np.ascontiguousarray(packed[:, j])) for j in range(packed.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(many.astype(np.int64)), print_, lists, *cells], names=names)

    rows = docs.select("id", "text", F.xxhash64("text").alias("mark"))
    schema = rows.select("id", "mark").schema.add("n_shingles", "long").add("print", "binary")
    schema = schema.add("posted", _longs())
    for j in range(COORDINATES // 16):
        schema = schema.add(f"s{j}", "long")
    names = schema.names
    return rows.mapInArrow(work, schema)


def _longs():
    from pyspark.sql import types as T

    return T.ArrayType(T.LongType())


_CELLS = [f"s{j}" for j in range(COORDINATES // 16)]
_FINE_CELLS = [f"s{j}" for j in range(FINE // 16)]


def _agreements(a: str, b: str, cells: list[str]) -> F.Column:
    """Equal four-bit values of two packed signatures."""
    total = []
    for c in cells:
        differ = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        half = differ.bitwiseOR(F.shiftrightunsigned(differ, 1))
        some = half.bitwiseOR(F.shiftrightunsigned(half, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total.append(F.bit_count(some))
    return F.lit(16 * len(cells)) - reduce(lambda x, y: x + y, total)


def _similar_size(a: str, b: str, percent: int) -> F.Column:
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _fine(texts: DataFrame, n: int) -> DataFrame:
    """(print, s0 .. ) of the classes' texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, many = shingle_hashes(*word_hashes(batch.column("text")), n)
            packed = _four_bits(_minima(values, many, FINE))
            yield pa.RecordBatch.from_arrays([batch.column("print"), pa.array(many.astype(np.int64)), *[pa.array(np.ascontiguousarray(packed[:, j])) for j in range(packed.shape[1])]], names=schema.names)

    schema = texts.select("print").schema.add("n_shingles", "long")
    for c in _FINE_CELLS:
        schema = schema.add(c, "long")
    return texts.select("print", "text").mapInArrow(work, schema)


def _own_shingles(texts: DataFrame, n: int) -> DataFrame:
    """(print, own): how many shingles of a class no other of these classes holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, many = shingle_hashes(*word_hashes(batch.column("text")), n)
            owner = np.repeat(np.arange(batch.num_rows, dtype=np.int32), many)
            yield pa.RecordBatch.from_arrays([batch.column("print").take(pa.array(owner)), pa.array(values.view(np.int64))], names=["print", "shingle"])

    held = texts.select("print", "text").mapInArrow(work, texts.select("print").schema.add("shingle", "long"))
    single = held.groupBy("shingle").agg(F.count("*").alias("held"), F.min("print").alias("print")).where("held = 1")
    return single.groupBy("print").agg(F.count("*").alias("own"))


def _reaches(shared: F.Column, total: F.Column, percent: int) -> F.Column:
    """Whether two sets of ``total`` shingles together that share at most ``shared`` can be similar enough."""
    return (100 + percent) * shared >= percent * total


def _confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a"):
            sets = []
            for name in ("text_a", "text_b"):
                words, counts = word_hashes(batch.column(name))
                values, many = shingle_hashes(words, counts, n)
                sets.append((values, np.concatenate([[0], np.cumsum(many)])))
            (x, xe), (y, ye) = sets
            keep = []
            for i in range(batch.num_rows):
                p, q = x[xe[i] : xe[i + 1]], y[ye[i] : ye[i + 1]]
                both = np.concatenate([p, q])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("print").alias("pa"), F.col("text").alias("text_a"))
    right = texts.select(F.col("print").alias("pb"), F.col("text").alias("text_b"))
    rows = pairs.join(right, F.col("b") == F.col("pb")).join(left, F.col("a") == F.col("pa")).select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(work, pairs.select("a", "b").schema)


def _ordered(a: str, b: str) -> list[F.Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, mark, n_shingles, component_id."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    signed = materialise(_signatures(rows, n), "signatures")
    first = F.min_by(F.struct("id", "mark", "n_shingles", "posted", *_CELLS), F.struct(F.col("id").isNull(), "id")).alias("r")
    classes = materialise(signed.where("n_shingles > 0").groupBy("print").agg(first).select("print", "r.*"), "classes")
    signatures = classes.select("print", "n_shingles", *_CELLS)

    posted = classes.select("print", F.explode("posted").alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    shared = materialise(posted.join(often, "token"), "shared")
    of_class = Window.partitionBy("print")
    rank = F.row_number().over(of_class.orderBy("held", "token")) + POSTED - F.count("*").over(of_class)
    centre = F.sum(F.round(F.log2("held") * 1024).cast("long")).over(of_class)
    postings = shared.select("print", "token", "held", rank.alias("rank"), centre.alias("centre")).where(F.col("rank") <= PREFIX).select("print", "token", "held", "centre")
    alone = postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    postings = materialise(postings.join(alone, "token"), "postings")

    hashed = [F.min(F.struct(F.xxhash64("print", F.lit(i)).alias("h"), "print"))["print"] for i in range(HASHED_PIVOTS)]
    pivots = postings.groupBy("token").agg(F.array_distinct(F.array(F.max(F.struct("centre", "print"))["print"], *hashed)).alias("pivots"))
    met = postings.join(pivots, "token").select("print", F.explode("pivots").alias("pivot"))
    candidates = met.where("print <> pivot").select(*_ordered("print", "pivot")).distinct()

    def above(pairs: DataFrame) -> DataFrame:
        x, y = signatures.alias("x"), signatures.alias("y")
        joined = pairs.join(x, F.col("a") == F.col("x.print")).join(y, F.col("b") == F.col("y.print"))
        agree = _agreements("x", "y", _CELLS).alias("agree")
        return joined.where(_similar_size("x", "y", percent)).select("a", "b", agree).where(F.col("agree") >= AGREE)

    pairs = materialise(above(candidates), "pairs")

    # texts of the classes that may have a link: all that are posted beside another
    wanted = postings.select("print").distinct().join(classes.select("print", "id", "mark"), "print")
    found = rows.withColumn("mark", F.xxhash64("text")).alias("d").join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.mark") == F.col("w.mark")))
    texts = materialise(found.select("w.print", "d.text").dropDuplicates(["print"]), "texts")

    # the best pair of each class first; what they join needs no further look
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")).select("a", "b")
    labels = components(materialise(_confirm(best, texts, n, percent), "links"))

    def apart(candidates: DataFrame, labels: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            label = labels.select(F.col("node").alias(f"n{end}"), F.col("component").alias(f"c{end}"))
            candidates = candidates.join(label, F.col(end) == F.col(f"n{end}"), "left")
        return candidates.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    tested = pairs.select("a", "b")
    rest = apart(tested.join(best, ["a", "b"], "left_anti"), labels)
    labels = components(materialise(_confirm(rest, texts, n, percent), "links"), labels)

    def still_open(lists: DataFrame, labels: DataFrame) -> DataFrame:
        """Lists that hold several components, with each class's own and the list's main one."""
        placed = lists.join(labels, F.col("print") == F.col("node"), "left").select("token", "held", "print", F.coalesce("component", "print").alias("c"))
        by = placed.groupBy("token", "c").agg(F.count("*").alias("n"))
        main = by.groupBy("token").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("several")).where("several > 1").select("token", "main")
        return materialise(placed.join(main, "token"), "open")

    def able(lists: DataFrame, sizes: DataFrame) -> DataFrame:
        """The lists without the classes whose shared shingles can't suffice beside their least set."""
        sized = lists.join(sizes, "print")
        least = sized.groupBy("token").agg(F.min("n_shingles").alias("least"))
        total = F.col("n_shingles") + F.greatest("least", F.ceil(F.col("n_shingles") * percent / 100))
        return sized.join(least, "token").where(_reaches(F.col("shared"), total, percent)).select("token", "held", "print")

    open_lists = still_open(postings, labels)
    for _ in range(SKIPS):  # who leaves takes shingles along, so others may follow
        open_texts = texts.join(open_lists.select("print").distinct(), "print")
        sizes = open_texts.select("print").join(classes.select("print", "n_shingles"), "print").join(_own_shingles(open_texts, n), "print", "left")
        sizes = materialise(sizes.select("print", "n_shingles", (F.col("n_shingles") - F.coalesce("own", F.lit(0))).alias("shared")), "sizes")
        open_lists = still_open(able(open_lists, sizes), labels)
    fine = _fine(texts.join(open_lists.select("print").distinct(), "print"), n)
    fine = materialise(fine.join(sizes.select("print", "shared"), "print"), "fine")
    both_reach = _reaches(F.least("x.shared", "y.shared"), F.col("x.n_shingles") + F.col("y.n_shingles"), percent)
    for i in range(ROUNDS):  # further members of the main component as pivots for the others
        drawn = [F.min(F.struct(F.xxhash64("print", F.lit(100 + ROUND_PIVOTS * i + j)).alias("h"), "print"))["print"] for j in range(ROUND_PIVOTS)]
        members = open_lists.where("c = main").groupBy("token").agg(F.array_distinct(F.array(*drawn)).alias("pivots"))
        met = open_lists.where("c <> main").join(members, "token").select("print", F.explode("pivots").alias("pivot"))
        new = met.select(*_ordered("print", "pivot")).distinct().join(tested, ["a", "b"], "left_anti")
        near = new.join(fine.alias("x"), F.col("a") == F.col("x.print")).join(fine.alias("y"), F.col("b") == F.col("y.print"))
        near = near.where(_similar_size("x", "y", percent) & both_reach & (_agreements("x", "y", _FINE_CELLS) >= FINE_AGREE)).select("a", "b")
        near = materialise(near, "near")
        labels = components(materialise(_confirm(near, texts, n, percent), "links"), labels)
        tested = tested.unionByName(near)
        open_lists = still_open(open_lists.select("token", "held", "print"), labels)

    # all that is left, each pair once: in the rarest list that both are in
    own_tokens = postings.groupBy("print").agg(F.transform(F.sort_array(F.collect_list(F.struct("held", "token"))), lambda t: t["token"]).alias("tokens"))
    sides = open_lists.join(fine, "print").join(own_tokens, "print")
    x, y = sides.where("c <> main").alias("x"), sides.alias("y")
    different = (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.main")) | (F.col("x.print") < F.col("y.print")))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & different & _similar_size("x", "y", percent) & both_reach & (_agreements("x", "y", _FINE_CELLS) >= FINE_AGREE) & (F.get(F.array_intersect("x.tokens", "y.tokens"), F.lit(0)) == F.col("x.token")))
    met = met.select(*_ordered("x.print", "y.print")).distinct().join(tested, ["a", "b"], "left_anti")
    labels = components(materialise(_confirm(met, texts, n, percent), "links"), labels)

    reps = classes.select("print", F.col("id").alias("rep")).join(labels, F.col("print") == F.col("node")).select("print", "component", "rep")
    smallest = reps.groupBy("component").agg(F.min("rep").alias("smallest"))
    grouped = reps.join(smallest, "component").select("print", "smallest")
    own = classes.select("print", F.col("id").alias("rep")).join(grouped, "print", "left").select(F.col("print").alias("of"), F.coalesce("smallest", "rep").alias("smallest"))
    out = signed.select("id", "mark", "n_shingles", "print").join(own, (F.col("n_shingles") > 0) & (F.col("print") == F.col("of")), "left")
    return out.select("id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that have a smaller near-duplicate, columns unchanged. Of
    rows equal in id and text one stays, unless the text has no words."""
    groups = materialise(near_groups(docs, n, percent, key, text), "groups")
    gone = groups.where(~F.col("component_id").eqNullSafe(F.col("id"))).select("id", "mark").distinct().alias("g")
    same = F.col(f"d.{key}").eqNullSafe(F.col("g.id")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("g.mark"))
    kept = docs.alias("d").join(gone, same, "left_anti")
    again = groups.where("n_shingles > 0").groupBy("id", "mark").count().where("count > 1").alias("g")
    if again.isEmpty():
        return kept
    repeated = kept.alias("d").join(again, same, "left_semi").dropDuplicates([key, text])
    return kept.alias("d").join(again, same, "left_anti").unionByName(repeated)
