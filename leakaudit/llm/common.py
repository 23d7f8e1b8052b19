"""What several operators need: working tables and a vectorised word splitter."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakaudit.session import shared_dir

# White space, and a word as what lies between.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (9, 10, 11, 12, 13, 32)

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that every executor can reach."""
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The rows as a table in the shared folder: plans start anew from it, and a lost
    executor costs a re-read."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not among the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# ---------------------------------------------------------------- inside tasks


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about so many bytes of text; a longer text stands alone."""
    most = most or SLICE_BYTES
    for batch in batches:
        at = batch.schema.get_field_index(text)
        ends = np.cumsum([0, *np.diff(_offsets(batch.column(at)))])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
        pa.default_memory_pool().release_unused()


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[1], kind)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and ends); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    ends = _offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which near ones fall far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers up to n, and their inverses, modulo 2**64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, SLICE_BYTES + (1 << 12))
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[0] = tuple(both)
    return _POWERS[0]


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_LOWERED = np.arange(256)
_LOWERED[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWERED]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def span_hashes(raw: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, A-Z lowered. Spans are in order and apart, and are
    taken in stretches of bounded length, so memory doesn't follow the text."""
    value = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(stop, first[i] + SLICE_BYTES, "right")))
        a, b = int(first[i]), int(stop[j - 1])
        up, down = powers(b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_LOWER_VALUES[raw[a:b]] * up[: b - a], out=total[1:])
        value[i:j] = (total[stop[i:j] - a] - total[first[i:j] - a]) * down[first[i:j] - a]
        i = j
    return mix64(value + (stop - first).astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word with A-Z lowered, words per text), texts one after another."""
    raw, ends = text_bytes(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~_IS_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    first, stop = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return span_hashes(raw, first, stop), np.diff(np.searchsorted(first, ends))
