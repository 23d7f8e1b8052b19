"""Byte-level BPE encoding and decoding.

A text is cut at the strings of added tokens, the rest by the vocabulary's pattern into
pieces. A piece is encoded by a segment tree over the ranks of adjacent pairs: each leaf
holds (rank, position) of the pair that begins there, each inner node the smaller of its
two, so the root is the leftmost pair of lowest rank. A merge changes three leaves,
each in logarithmic time, until the root holds no pair. Pieces are encoded once per worker and remembered
in a bounded store.

The work is one pass over the documents without a shuffle. Memory is bounded by the
longest text and the store.

Defined results: a null text is an empty one (no tokens, digests of nothing); repeated rows
and ties repeat their result; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import array
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakaudit.llm.common import slices

# Fixed value: how the pattern of this family of vocabularies cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = 1 << 62
STORE_PIECES = 250_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such vocabularies: itself where
    it is printable in Latin-1, else the next of the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _file(name: str) -> str:
    """A path as it is, or the name of a file among the public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class SegmentTree:
    """Minimum over leaves with point updates."""

    def __init__(self, leaves: list[int]):
        size = 1
        while size < len(leaves):
            size *= 2
        self.size = size
        self.tree = tree = [NO_PAIR] * size + leaves + [NO_PAIR] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b

    def put(self, at: int, value: int) -> None:
        tree, i = self.tree, at + self.size
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            smaller = a if a <= b else b
            if tree[i] == smaller:
                return
            tree[i] = smaller


class Codec:
    def __init__(self, path: str):
        import regex

        with open(_file(path), encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: content.encode() for content, i in self.added.items()}
        self.cut = regex.compile(PATTERN)
        self.apart = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        top = max(self.bytes_of) + 1
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(top)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.letters = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        ids = [self.first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        shift = n.bit_length()
        low = (1 << shift) - 1
        get = self.pairs.get

        def leaf(i: int, j: int) -> int:
            found = get((ids[i], ids[j])) if j < n else None
            return NO_PAIR if found is None else found[0] << shift | i

        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        tree = SegmentTree([leaf(i, i + 1) for i in range(n - 1)])
        while (best := tree.tree[1]) != NO_PAIR:
            i = best & low
            j = after[i]
            ids[i] = get((ids[i], ids[j]))[1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            if j < n - 1:
                tree.put(j, NO_PAIR)
            if i < n - 1:
                tree.put(i, leaf(i, k))
            if (h := before[i]) >= 0:
                tree.put(h, leaf(h, i))
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = array.array("I", self.merge(piece.encode())).tobytes()
        if len(piece) < 64:
            if len(self.young) >= STORE_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as native 32-bit numbers, one after another."""
        out: list[bytes] = []
        young, make = self.young.get, self._piece
        for part in self.apart.split(text) if self.apart else [text]:
            if part in self.added:
                out.append(array.array("I", [self.added[part]]).tobytes())
                continue
            young = self.young.get
            for piece in self.cut.findall(part):
                found = young(piece)
                if found is None:
                    found = make(piece)
                    young = self.young.get
                out.append(found)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        many = self.lengths[ids]
        ends = np.cumsum(many)
        if not len(ids):
            return ""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - many), many)
        return self.letters[at].tobytes().decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _id_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(x) // 4 for x in packed]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.uint32).astype(np.int32)))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with their token ids (array of int)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in slices(batches, text):
            found = [c.encode(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _id_lists(found)], names=[*batch.schema.names, ids])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256, after encoding and decoding; ``with_ids`` adds ids, the tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in slices(batches, "text"):
            out: list[tuple[int, str, str]] = []
            tokens: list[bytes] = []
            for t in batch.column("text").to_pylist():
                packed = c.encode(t or "")
                ids = np.frombuffer(packed, np.uint32)
                decoded = c.decode(ids).encode()
                tokens.append(packed)
                out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            n, a, b = zip(*out, strict=True)
            found = [batch.column("id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays([*found, _id_lists(tokens)] if with_ids else found, names=schema.names)

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = rows.select("id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(work, schema)
