"""Repeated byte strings, by a distributed merge sort of suffixes that knows common prefixes.

A byte goes when a string of ``n`` bytes around it also starts elsewhere. Sorting every suffix
of a corpus would move many times its size, so suffixes are taken where a repeat has to
show: in each window of n bytes the ``GRAM``-byte string of smallest hash is an anchor, and equal windows
have equal anchors. Only anchors whose hash occurs twice are followed, which no repeat can escape.

1. Anchors per distinct text; rows with equal texts are one unit.
2. Hashes meet in buckets; what a task already holds twice is known there, and it sends one copy of it on.
3. Each task cuts the suffixes at repeated anchors (n bytes, and the bytes before in reverse), sorts
   them into runs and front-codes them: common prefix with the one before, and the rest. Equal ones are sent
   once with the list of their places.
4. Runs meet by the hash of their first bytes, under which whatever shares a prefix
   of that length stays together. A loser tree merges them; each head knows its common prefix with the last output, heads with
   different ones are ordered by that number alone, and equal ones are compared beyond it only. The
   order and common prefixes of the bytes before an anchor are found the same way, by sorting.
5. A string starts l bytes before an anchor, l = 0 .. n - GRAM. Two anchors agree on it when their right prefix
   reaches n - l and their left one l; both are classes of neighbours in the two orders. The first and last l
   that an anchor shares with another give the run it covers.

Only texts that hold a repeated anchor are looked at again.

Defined results: a null text is empty; texts under n bytes are left alone, equal texts of n bytes or more go whole; a run
may end inside a character, the parts of which are dropped from kept text (the digest is of the exact bytes); repeated
rows share a result; an empty table gives an empty result; other columns pass through under any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakaudit.llm.common import _BYTE_VALUES, SLICE_BYTES, materialise, mix64, parts, powers, slices, text_bytes

LENGTH = 200
GRAM = 32
FLUSH_BYTES = 1 << 24
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(raw: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of anchors in the joined texts, ordered; hash of the string there)."""
    window = n - GRAM + 1
    starts = np.repeat(ends[:-1], np.maximum(np.diff(ends) - n + 1, 0))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lengths = np.maximum(np.diff(ends) - n + 1, 0)
    starts = starts + np.arange(len(starts)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    size = len(raw)
    m = size - GRAM + 1
    own = np.empty(m, np.uint64)
    up, down = powers(min(size, SLICE_BYTES + GRAM))
    for a in range(0, m, SLICE_BYTES):  # in stretches, so memory doesn't follow a long text
        piece = raw[a : a + SLICE_BYTES + GRAM - 1]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[piece] * up[: len(piece)], out=total[1:])
        k = len(piece) - GRAM + 1
        own[a : a + k] = mix64((total[GRAM:] - total[:k]) * down[:k])
    ranked = (own & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    rows = -(-m // window)
    padded = np.full(rows * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:m] = ranked
    padded = padded.reshape(rows, window)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[starts], before[starts + window - 1]) & np.uint64(0xFFFFFFFF)
    chosen = np.zeros(m, bool)
    chosen[least.astype(np.int64)] = True
    places = np.flatnonzero(chosen)
    return places, own[places]


def _anchored(docs: DataFrame, n: int) -> DataFrame:
    """(unit, id, digest, n_bytes, places, hashes): a row per document, as a table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, ends = text_bytes(batch.column("text"))
            places, hashes = anchors(raw, ends, n)
            cut = np.searchsorted(places, ends)
            local = (places - np.repeat(ends[:-1], np.diff(cut))).astype(np.uint32)
            cells = [[a[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])] for a in (local, hashes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), pa.array(np.diff(ends)), *[pa.array(c, pa.binary()) for c in cells]], names=["id", "digest", "n_bytes", "places", "hashes"]
            )

    schema = docs.select("id", "digest").schema.add("n_bytes", "long").add("places", "binary").add("hashes", "binary")
    return materialise(docs.mapInArrow(work, schema).withColumn("unit", F.monotonically_increasing_id()), "anchors")


def _by_unit(owner: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """(unit, places): the places of each unit as one list."""
    order = np.argsort(owner, kind="stable")
    owner, places = owner[order], places[order]
    own, first = np.unique(owner, return_index=True)
    edges = pa.array(np.append(first, len(owner)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(edges, pa.array(places.astype(np.int32)))], names=["unit", "places"])


def _repeated(units: DataFrame, buckets: int) -> DataFrame:
    """(unit, places): anchors whose hash occurs twice."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64)
            places = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.uint32)
            many = np.array([len(x) // 4 for x in batch.column("places").to_pylist()], np.int64)
            owner = np.repeat(batch.column("unit").to_numpy(), many)
            order = np.argsort(hashes, kind="stable")
            hashes, places, owner = hashes[order], places[order], owner[order]
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            group = np.cumsum(new) - 1
            twice = np.bincount(group)[group] > 1 if len(group) else new
            known = np.flatnonzero(twice)
            rows: list[tuple] = [(-1, b"", owner[known].tobytes(), places[known].tobytes())] if len(known) else []
            sent = np.flatnonzero(new)
            owner = np.where(twice, -1, owner)  # known already, only to tell others
            bucket = (hashes[sent] >> np.uint64(40)) % np.uint64(buckets)
            for b in range(buckets):
                at = sent[bucket == b]
                if len(at):
                    rows.append((b, hashes[at].tobytes(), owner[at].tobytes(), places[at].tobytes()))
            if rows:
                cells = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cells[1:]]], names=["bucket", "hashes", "units", "places"])

    def meet(table):
        joined = [b"".join(x.as_py() for x in table.column(c)) for c in ("hashes", "units", "places")]
        hashes, owner, places = np.frombuffer(joined[0], np.uint64), np.frombuffer(joined[1], np.int64), np.frombuffer(joined[2], np.uint32)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        told = owner[order] == -1
        group = np.cumsum(np.concatenate([[True], ~same])) - 1
        twice |= (np.bincount(group, told) > 0)[group]
        at = order[twice & ~told]
        return pa.Table.from_batches([_by_unit(owner[at], places[at])])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _by_unit(np.frombuffer(batch.column("units")[i].as_py(), np.int64), np.frombuffer(batch.column("places")[i].as_py(), np.uint32))

    packed = materialise(units.mapInArrow(pack, "bucket int, hashes binary, units binary, places binary"), "hashes")
    kinds = "unit long, places array<int>"
    # side by side: one after the other in a task, the two would hold a Python worker each
    met = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(meet, kinds)
    found = met.unionByName(packed.where("bucket < 0").select("units", "places").mapInArrow(lists, kinds))
    return found.groupBy("unit").agg(F.flatten(F.collect_list("places")).alias("places"))


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings that agree up to ``start``."""
    end = min(len(a), len(b))
    x, y = a[start:end], b[start:end]
    if x == y:
        return end
    return start + ((end - start) * 8 - (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length()) // 8


class LoserTree:
    """Merges sorted runs of byte strings whose common prefixes with their forerunners are
    known. ``known[k]`` is the common prefix of run k's head with the last output."""

    def __init__(self, runs: list[list[bytes]], prefixes: list[list[int]]):
        self.runs, self.prefixes = runs, prefixes
        self.at = [0] * len(runs)
        self.known = [0] * len(runs)
        self.losers = [0] * max(1, len(runs))
        self.winner = self._build(1) if runs else -1

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        first = self._play(a, b)
        self.losers[node] = b if first == a else a
        return first

    def _play(self, a: int, b: int) -> int:
        if self.at[a] >= len(self.runs[a]):
            return b
        if self.at[b] >= len(self.runs[b]):
            return a
        x, y = self.known[a], self.known[b]
        if x != y:
            return a if x > y else b
        p, q = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        same = common(p, q, x)
        if p[same : same + 1] <= q[same : same + 1]:
            self.known[b] = same
            return a
        self.known[a] = same
        return b

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, number in the run, common prefix with the output before)."""
        k = len(self.runs)
        while k and self.at[w := self.winner] < len(self.runs[w]):
            yield w, self.at[w], self.known[w]
            self.at[w] += 1
            if self.at[w] < len(self.runs[w]):
                self.known[w] = self.prefixes[w][self.at[w]]
            node = (w + k) // 2
            while node:
                first = self._play(w, self.losers[node])
                if first != w:
                    self.losers[node], w = w, first
                node //= 2
            self.winner = w


def _front_code(keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(common prefixes, lengths, what follows) of sorted strings."""
    shared, last = [], b""
    for k in keys:
        shared.append(common(last, k, 0))
        last = k
    return np.array(shared, np.uint16).tobytes(), np.array([len(k) for k in keys], np.uint16).tobytes(), b"".join(k[s:] for k, s in zip(keys, shared))


def _unpack(shared: np.ndarray, lengths: np.ndarray, tail: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for s, n in zip(shared.tolist(), lengths.tolist()):
        last = last[:s] + tail[at : at + n - s]
        at += n - s
        out.append(last)
    return out


RUN = "bucket int, shared binary, lengths binary, tails binary, left_lengths binary, lefts binary, held binary, units binary, places binary"


def _runs(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """Sorted, front-coded runs of the suffixes at the given places, by bucket."""
    names = [x.split()[0] for x in RUN.split(", ")]

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for bucket, entries in held.items():
            keys = sorted(entries)
            refs = [entries[k] for k in keys]
            coded = _front_code([k[0] for k in keys])
            flat = [r for x in refs for r in x]
            row = [
                *coded,
                np.array([len(k[1]) for k in keys], np.uint16).tobytes(),
                b"".join(k[1] for k in keys),
                np.array([len(x) for x in refs], np.uint32).tobytes(),
                np.array([u for u, _ in flat], np.int64).tobytes(),
                np.array([p for _, p in flat], np.uint32).tobytes(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([c], pa.binary()) for c in row]], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        size = 0
        for batch in slices(batches, "text"):
            for unit, text, places in zip(*[batch.column(c).to_pylist() for c in ("unit", "text", "places")]):
                data = text.encode()
                for p in places:
                    right, left = data[p : p + n], data[max(0, p - n + GRAM) : p][::-1]
                    held[zlib.crc32(right[:GRAM]) % buckets][right, left].append((unit, p))
                    size += len(right) + len(left)
            if size > FLUSH_BYTES:
                yield from flush(held)
                held.clear()
                size = 0
        yield from flush(held)

    return texts.select("unit", "text", "places").mapInArrow(work, RUN)


def _covered(rights: list[int], reach: list[int], lefts: list[bytes], many: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest) l at which an entry's string is held by another; -1 if none.
    rights: lengths in sorted order; reach: common prefixes with the entry before."""
    m = len(rights)
    right_size, right_same = np.array(rights), np.array(reach)
    order = sorted(range(m), key=lefts.__getitem__)
    left_same = np.zeros(m, np.int64)
    for i in range(1, m):
        left_same[i] = common(lefts[order[i - 1]], lefts[order[i]], 0)
    order = np.array(order, np.int64)
    left_size = np.array([len(x) for x in lefts])
    low, high = np.full(m, -1), np.full(m, -1)
    for l in range(n - GRAM + 1):
        valid = (left_size >= l) & (right_size >= n - l)
        if not valid.any():
            continue
        right_class = np.cumsum(right_same < n - l)
        left_class = np.empty(m, np.int64)
        left_class[order] = np.cumsum(left_same < l)
        at = np.flatnonzero(valid)
        key = right_class[at] * (m + 1) + left_class[at]
        ranked = np.argsort(key, kind="stable")
        same = key[ranked][1:] == key[ranked][:-1]
        twice = np.zeros(len(at), bool)
        twice[ranked[1:]] |= same
        twice[ranked[:-1]] |= same
        hit = at[twice | (many[at] > 1)]
        high[hit] = l
        low[hit] = np.where(low[hit] < 0, l, low[hit])
    return low, high


def _merge(n: int):
    def work(table):
        rows = table.to_pylist()
        number = lambda c, kind: [np.frombuffer(r[c], kind) for r in rows]
        shared, lengths = number("shared", np.uint16), number("lengths", np.uint16)
        keys = [_unpack(s, k, r["tails"]) for s, k, r in zip(shared, lengths, rows)]
        held, units, places = number("held", np.uint32), number("units", np.int64), number("places", np.uint32)
        left_edges = [np.concatenate([[0], np.cumsum(x.astype(np.int64))]) for x in number("left_lengths", np.uint16)]
        ref_edges = [np.concatenate([[0], np.cumsum(x.astype(np.int64))]) for x in held]
        rights, reach, lefts, many, refs = [], [], [], [], []
        for run, i, same in LoserTree(keys, [s.tolist() for s in shared]):
            left = rows[run]["lefts"][left_edges[run][i] : left_edges[run][i + 1]]
            rights.append(len(keys[run][i]))
            reach.append(same)
            lefts.append(left)
            many.append(int(held[run][i]))
            refs.append((run, i))
        low, high = _covered(rights, reach, lefts, np.array(many, np.int64), n) if rights else (np.zeros(0), np.zeros(0))
        out: list[list[np.ndarray]] = [[], [], []]
        for k in np.flatnonzero(high >= 0):
            run, i = refs[k]
            a, b = ref_edges[run][i], ref_edges[run][i + 1]
            p = places[run][a:b].astype(np.int64)
            for to, x in zip(out, (units[run][a:b], p - high[k], p - low[k] + n)):
                to.append(x)
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(("unit", "begin", "end"), joined)))

    return work


def _joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[list[int]] = []
    for s in sorted(spans, key=lambda s: s["begin"]):
        if out and s["begin"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["begin"], s["end"]])
    return [(a, b) for a, b in out]


def _remove(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for r in runs for x in r], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


class Found:
    """What the search leaves: tables of rows, units and spans."""

    def __init__(self, docs: DataFrame, n: int, key: str, text: str):
        spark = docs.sparkSession
        body = F.coalesce(F.col(text), F.lit(""))
        self.rows = docs.select(F.col(key).alias("id"), body.alias("text"), F.sha2(body.cast("binary"), 256).alias("digest"))
        self.table = _anchored(self.rows, n)
        small = self.table.select("unit", "id", "digest", "n_bytes")
        self.copies = materialise(small.groupBy("digest").agg(F.count("*").alias("n_rows"), F.min("unit").alias("unit")).where("n_rows > 1"), "copies")
        first = self.copies.select("digest", F.col("unit").alias("first"))
        others = small.join(first, "digest").where("unit <> first").select("unit")
        units = self.table.where(F.length("hashes") > 0).join(others, "unit", "left_anti")
        buckets = parts(spark)
        repeated = _repeated(units, buckets)
        places = repeated.join(small, "unit").select("unit", F.col("id").alias("own"), F.col("digest").alias("of"), "places")
        same = (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("own"))
        texts = self.rows.join(places, same).select("unit", "digest", "text", "places")
        twins = small.groupBy("digest", "id").count().where("count > 1")
        if not twins.isEmpty():  # rows equal in id and text found the unit several times
            texts = texts.dropDuplicates(["unit"])
        self.texts = materialise(texts, "texts")
        runs = _runs(self.texts, n, buckets)
        spans = runs.groupBy("bucket").applyInArrow(_merge(n), "unit long, begin long, end long")
        self.spans = materialise(spans.groupBy("unit").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")


def repeated_report(docs: DataFrame, n: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = Found(docs, n, key, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for digest, text_, spans in zip(*[batch.column(c).to_pylist() for c in ("digest", "text", "spans")]):
                data, runs = text_.encode(), _joined(spans)
                kept = _remove(data, runs)
                out.append((digest, len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["of", "removed", "runs", "kept"])

    cut = found.texts.select("unit", "digest", "text").join(found.spans, "unit").select("digest", "text", "spans").mapInArrow(work, "of string, removed long, runs long, kept string")
    copies = found.copies.select(F.col("digest").alias("copied"))
    rows = found.table.select("id", "digest", "n_bytes").join(cut, F.col("digest") == F.col("of"), "left").join(copies, F.col("digest") == F.col("copied"), "left")
    whole = F.col("copied").isNotNull() & (F.col("n_bytes") >= n)
    return rows.select(
        "id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, EMPTY).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, n: int = LENGTH, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """The documents without repeated bytes, columns unchanged but for the text and, if
    named, its length."""
    found = Found(docs, n, key, text)
    small = found.table.select("unit", "digest").join(found.spans, "unit").select("digest", "spans")
    gone = found.copies.select("digest", F.lit(True).alias("whole"))
    marks = small.join(gone, "digest", "full").select(F.col("digest").alias("of"), "spans", F.coalesce("whole", F.lit(False)).alias("whole"))
    columns = docs.columns
    body = F.sha2(F.coalesce(F.col(f"d.{text}"), F.lit("")).cast("binary"), 256)
    joined = docs.alias("d").join(marks.alias("m"), body == F.col("m.of"), "left")
    rows = joined.select(F.struct(*[F.col(f"d.`{c}`") for c in columns]).alias("row"), F.col(f"d.`{text}`").alias("text"), "m.spans", "m.whole")
    plain = rows.where("spans is null and not coalesce(whole, false)").select("row.*")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for t, spans, whole in zip(*[batch.column(c).to_pylist() for c in ("text", "spans", "whole")]):
                data = (t or "").encode()
                runs = [(0, len(data))] if whole and len(data) >= n else _joined(spans or [])
                out.append(_remove(data, runs).decode("utf-8", "ignore") if runs else t)
            fields = batch.column("row").flatten()
            fields[columns.index(text)] = pa.array(out, pa.string())
            if length:
                at = columns.index(length)
                fields[at] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(fields[at].type)
            yield pa.RecordBatch.from_arrays(fields, names=columns)

    cut = rows.where("spans is not null or coalesce(whole, false)").mapInArrow(work, docs.schema)
    return plain.unionByName(cut)
