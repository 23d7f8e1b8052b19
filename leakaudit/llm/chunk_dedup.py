"""Exact duplicates by recipes of content-defined chunks.

1. A text, A-Z lowered, is cut where a rolling hash of its last 32 bytes is a multiple of a power of two, so equal
   texts are cut alike and an edit moves only the cuts near it. Its recipe is the ordered list of its chunks' identifiers.
2. Chunks are grouped by their bytes: one copy of a chunk leaves a task, however many of its documents hold it, and this is
   the only time that text moves. An identifier is the chunk's 63-bit hash once no other chunk has that hash;
   chunks that share one get identifiers of their own, below zero. Equal identifiers are thus equal bytes.
3. Recipes, a few bytes for a kilobyte of text, are grouped as lists: equal recipes are equal texts.

A group may hold any share of the rows: it is counted on the map side, and its rows find their group through as many
salts as its share of the partitions. Which groups need that is broadcast as one number each; a group
counts as large from a 1024th of the rows, so there are at most 1024.

Defined results: a null text is empty, all empty texts are one group; a null id is kept only where all ids of
the group are null; rows equal in id and text are separate members that share the decision; an empty table gives an
empty result; other columns take no part, in ``keep_last`` they pass through under any name; memory per task follows the longest text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakaudit.llm.common import _LOWERED, SLICE_BYTES, fresh, materialise, mix64, parts, slices, text_bytes

LEAST, MOST = 512, 16384  # bytes of a chunk; the last one of a text may be shorter
CUT_BITS = 11
ROLL = 32
HASH_BITS = 63
LARGE = 1024

_GEAR = (mix64(np.arange(2001, 2257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_LOWER = _LOWERED.astype(np.uint8)


def cut_places(raw: np.ndarray) -> list[int]:
    """Where a chunk may end: the rolling hash there is zero in its upper bits."""
    found = []
    for a in range(0, len(raw), SLICE_BYTES):  # in stretches, so memory doesn't follow a long text
        start = max(0, a - ROLL + 1)
        rolled = _GEAR[raw[start : a + SLICE_BYTES]]
        width = 1
        while width < ROLL:  # a window's hash from those of its halves
            rolled[width:] += rolled[:-width] << np.uint32(width)
            width *= 2
        ends = np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + start + 1
        found.append(ends[ends > a])
    return np.concatenate(found).tolist() if found else []


def chunk_ends(raw: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """The ends of each text's chunks. The first LEAST bytes of a chunk are never cut, so no
    window that matters reaches into the text before."""
    places = cut_places(raw)
    out = []
    for at, stop in zip(ends[:-1].tolist(), ends[1:].tolist()):
        own = []
        while at < stop:
            i = bisect_left(places, at + LEAST)
            at = min(places[i] if i < len(places) else stop, at + MOST, stop)
            own.append(at)
        out.append(own)
    return out


def chunk_hash(chunk: bytes, bits: int = HASH_BITS) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "big") >> (64 - bits)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[bytes]]]]:
    """(batch, lowered texts, chunks of each text)."""
    for batch in slices(batches, "text"):
        raw, ends = text_bytes(batch.column("text"))
        raw = _LOWER[raw]
        data, cuts = raw.tobytes(), chunk_ends(raw, ends)
        edges = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
        yield batch, [data[a:b] for a, b in edges], [[data[i:j] for i, j in zip([a, *c], c)] for (a, _), c in zip(edges, cuts)]


def chunks(docs: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """(hash, chunk) of the column ``text``, each distinct chunk once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, lists in _chunked(batches):
            own = list({c: None for cs in lists for c in cs})
            yield pa.RecordBatch.from_arrays([pa.array([chunk_hash(c, bits) for c in own], pa.int64()), pa.array(own, pa.binary())], names=["hash", "chunk"])

    return docs.select("text").mapInArrow(work, "hash long, chunk binary").distinct()


def shared_hashes(docs: DataFrame, bits: int = HASH_BITS) -> DataFrame | None:
    """(hash, chunk, own): chunks whose hash another chunk has too, with identifiers of their own;
    None if there are none."""
    found = chunks(docs, bits)
    several = materialise(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "several")
    if several.isEmpty():
        return None
    return materialise(found.join(several, "hash", "left_semi").withColumn("own", -1 - F.monotonically_increasing_id()), "own")


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = HASH_BITS) -> DataFrame:
    """(id, place, digest, recipe) per row, as a table: SHA-256 of the lowered text and its chunks' verified identifiers;
    place is the row's number in its stretch of the input."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, lists in _chunked(batches):
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            hashes = pa.array([[chunk_hash(c, bits) for c in cs] for cs in lists], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(range(len(texts)), pa.int32()), digests, hashes], names=["id", "place", "digest", "recipe"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, lists in _chunked(batches):
            flat = [(hashlib.sha256(t).digest(), i, chunk_hash(c, bits), c) for t, cs in zip(texts, lists) for i, c in enumerate(cs)]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], kind) for j, kind in enumerate((pa.binary(), pa.int32(), pa.int64(), pa.binary()))], names=["digest", "at", "hash", "chunk"])

    made = rows.mapInArrow(work, rows.select("id").schema.add("place", "integer").add("digest", "binary").add("recipe", T.ArrayType(T.LongType())))
    shared = shared_hashes(rows, bits)
    if shared is not None:
        told = rows.mapInArrow(pieces, "digest binary, at int, hash long, chunk binary").join(shared, ["hash", "chunk"])
        own = told.groupBy("digest").agg(F.map_from_entries(F.collect_set(F.struct("at", "own"))).alias("own"))
        verified = F.transform("recipe", lambda h, i: F.coalesce(F.try_element_at("own", i), h)).alias("recipe")
        made = made.join(own, "digest", "left").select("id", "place", "digest", verified)
    return materialise(made, "recipes")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = HASH_BITS) -> DataFrame:
    """Per row: id, keep_id (the largest id of its group), group_size, kept, digest, n_chunks."""
    listed = recipes(docs, key, text, bits).withColumn("mark", F.xxhash64("recipe"))
    groups = materialise(listed.groupBy("mark", "recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    total = groups.agg(F.sum("group_size")).scalar()
    salts = F.ceil(F.max("group_size") * parts(docs.sparkSession) / F.any_value("total")).cast("int")
    large = groups.withColumn("total", total).where(F.col("group_size") * LARGE >= F.col("total")).groupBy("mark").agg(salts.alias("salts"))

    def salted(df: DataFrame, salt) -> DataFrame:
        return df.join(F.broadcast(large), "mark", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", salt)

    rows = salted(listed, F.pmod(F.xxhash64("id", "place"), F.col("salts")).cast("int"))
    found = salted(groups, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    joined = rows.alias("r").join(found.alias("g"), ["mark", "salt", "recipe"])
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return joined.select("id", "keep_id", "group_size", kept.alias("kept"), "digest", F.size("recipe").alias("n_chunks"))


def keep_last(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those whose text one of a larger id has, columns unchanged. Which go is told by
    id and digest, so no text is moved."""
    gone = materialise(exact_groups(docs, key, text).where("not kept").select("id", "digest").distinct(), "gone")
    name = fresh(docs.columns, "digest")
    marked = docs.withColumn(name, F.unhex(F.sha2(F.coalesce(lowered(text), F.lit("")), 256)))
    same = F.col(f"d.{key}").eqNullSafe(F.col("g.id")) & (F.col(f"d.{name}") == F.col("g.digest"))
    return marked.alias("d").join(gone.alias("g"), same, "left_anti").drop(name)


def lowered(text: str) -> F.Column:
    """The text with A-Z lowered and nothing else."""
    return F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rebuild(listed: DataFrame, store: DataFrame) -> DataFrame:
    """(id, text) from recipes (id, place, digest, recipe) and a store of chunks (chunk_id, chunk)."""
    need = listed.select("id", "digest", F.posexplode_outer("recipe").alias("at", "chunk_id")).join(store, "chunk_id", "left")
    whole = need.groupBy("id", "digest").agg(F.sort_array(F.collect_set(F.struct(F.coalesce("at", F.lit(0)).alias("at"), "chunk"))).alias("cs"))
    joined = F.aggregate("cs", F.lit(b""), lambda a, c: F.concat(a, F.coalesce(c["chunk"], F.lit(b""))))
    return whole.select("id", F.decode(joined, "UTF-8").alias("text"))


def chunk_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_id, chunk): each distinct chunk once under its verified identifier."""
    rows = docs.select(F.col(text).alias("text"))
    shared = shared_hashes(rows)
    found = chunks(rows)
    if shared is None:
        return found.select(F.col("hash").alias("chunk_id"), "chunk")
    return found.join(shared, ["hash", "chunk"], "left").select(F.coalesce("own", "hash").alias("chunk_id"), "chunk")
