"""Language-model scores: a Katz back-off model of word pairs.

P(w | h) = d(r) r / c(h) for a pair seen r times, else a(h) P(w). d are Good-Turing discounts of counts up to
``TOP``; larger counts give up ``RESERVE`` of themselves, so every context keeps something for new words. a(h) is
what the seen pairs leave, divided by what their words leave in the word model, so
P(. | h) sums to 1 over the known words and one unknown. P(w) is discounted likewise, and the unknown word has what is left.

A score is a sum, so each part is formed where its counts are, and no count is looked up
twice:

1. ``words`` (table): counts per word hash, summed on the map side. Words that are a
   large part of all tokens are few, and known from here.
2. Pairs of a slice of documents are counted in their task and sent, with the documents that hold
   them, to the bucket of their second word (frequent words are split by the first one). There r is complete, and c(w) too. Seen
   pairs (``COUNTS`` rows of the table ``pairs``, which is partitioned by kind) add log r and the number of small counts; unseen pairs add log P(w); each word subtracts log c(w)
   as the context of the next.
3. Sums per context go to the bucket of the context, together with the unseen pairs' contexts; ``contexts`` there get a(h).
   An unseen pair adds log a(h) and takes back log c(h).
4. Sums per document are added up.

All texts and counts take part; only hashes (64 bits of a word, 48 of a context) stand for words.

Defined results: null and empty texts are one end token; a null id is held out; without training rows every
score is 0; repeated rows count and score each; an empty table gives an empty
result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakaudit.llm.common import materialise, mix64, slices, word_hashes

TOP = 5
RESERVE = 1e-3
SLICE = 12 << 20
BUCKET_TOKENS = 4_000_000
END, BEGIN = np.uint64(0xE3D0000000000001), np.uint64(0xBE61000000000002)
_LOW48 = np.uint64((1 << 48) - 1)


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """d[r] for r = 0 .. TOP + 1; the last one for all larger counts. Where counts of counts
    don't allow Good-Turing, half a count is taken off."""
    n = lambda r: counts_of_counts.get(r, 0)
    d = np.ones(TOP + 2)
    d[0], d[-1] = 0.0, 1 - RESERVE
    far = (TOP + 1) * n(TOP + 1) / n(1) if n(1) else 1.0
    for r in range(1, TOP + 1):
        turing = ((r + 1) * n(r + 1) / n(r) / r - far) / (1 - far) if n(r) and far != 1 else 0.0
        d[r] = turing if 0 < turing < 1 else 1 - 0.5 / r
    return d


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before, tokens per text): each text's words and its end."""
    words, many = word_hashes(texts)
    out = np.empty(len(words) + len(many), np.uint64)
    ends = np.cumsum(many + 1) - 1
    last = np.zeros(len(out), bool)
    last[ends] = True
    out[~last] = words
    out[ends] = END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])[: len(many)]] = BEGIN
    return out, before, many + 1


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _open(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * k, 8)
    out, at = [], 8 + 16 * k
    for char, n in head.reshape(k, 2).tolist():
        kind = np.dtype(chr(char))
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def _split48(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint16)


def _join48(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


class WordModel:
    """Numbers of the training words, and what each count is worth."""

    def __init__(self, total: int, distinct: int, ends: int, few: dict[int, int]):
        self.total, self.distinct, self.ends = total, distinct, ends
        self.d = discounts(few)
        kept = sum(self.d[r] * r * few.get(r, 0) for r in range(1, TOP + 1))
        large = total - sum(r * few.get(r, 0) for r in range(1, TOP + 1))
        self.unknown = 1 - (kept + self.d[-1] * large) / total if total else 1.0

    def probability(self, c: np.ndarray) -> np.ndarray:
        known = self.d[np.minimum(c, TOP + 1)] * c / max(self.total, 1)
        return np.where(c > 0, known, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def _count_words(rows: DataFrame, buckets: int) -> DataFrame:
    """(word, n) of the training rows, as a table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words, many = word_hashes(batch.filter(pa.compute.invert(batch.column("held_out"))).column("text"))
            found, n = np.unique(words, return_counts=True)
            if len(many):
                found, n = np.append(found, END), np.append(n, len(many))
            bucket = (found >> np.uint64(40)) % np.uint64(buckets)
            cells = [(b, _pack(found[bucket == b], n[bucket == b].astype(np.uint32))) for b in range(buckets) if (bucket == b).any()]
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in cells], pa.int32()), pa.array([x for _, x in cells], pa.binary())], names=["bucket", "data"])

    def add(table):
        both = [_open(x.as_py()) for x in table.column("data")]
        word, back = np.unique(np.concatenate([w for w, _ in both]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n in both]).astype(float)).astype(np.int64)
        return pa.table({"word": word.view(np.int64), "n": n})

    return materialise(rows.mapInArrow(work, "bucket int, data binary").groupBy("bucket").applyInArrow(add, "word long, n long"), "words")


def _word_model(words: DataFrame, buckets: int) -> tuple[WordModel, dict[int, int]]:
    one = words.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.max(F.when(F.col("word") == int(END.view(np.int64)), F.col("n"))).alias("ends")).first()
    few = {r.n: r["count"] for r in words.where(F.col("n") <= TOP + 1).groupBy("n").count().collect()}
    model = WordModel(one.total or 0, one.distinct, one.ends or 0, few)
    # at most 4 x buckets words can have so large a part
    often = words.where(F.col("n") > max(TOP, model.total / (4 * buckets))).collect()
    return model, {r.word & 0xFFFFFFFFFFFFFFFF: r.n for r in often}


PARTS = "bucket int, kind int, at long, data binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
DOCS, PAIRS, SUMS, CONTEXTS, UNSEEN, FEW, COUNTS = range(7)


def _rows(cells: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), _KINDS)], names=["bucket", "kind", "at", "data"])


def _send_pairs(rows: DataFrame, buckets: int, often: dict[int, int]) -> DataFrame:
    """Slices of documents and their pairs, by bucket. Rows of a slice are numbered on from ``at``."""
    frequent = np.array(sorted(often), np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            word, before, many = tokens(batch.column("text"))
            at = batch.column("row")[0].as_py()
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            ids = [b"-" if x is None else b"+" + str(x).encode() for x in batch.column("id").to_pylist()]
            info = _pack(many.astype(np.int64), held.astype(np.uint8), np.frombuffer(b"\x00".join(ids), np.uint8))
            yield _rows([(at % buckets, DOCS, at, info)])
            doc = np.repeat(np.arange(len(many), dtype=np.uint32), many)
            before = mix64(before) & _LOW48
            order = np.lexsort((before, word))
            word, before, doc = word[order], before[order], doc[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (before[1:] != before[:-1])
            first = np.flatnonzero(new)
            trained = np.add.reduceat((~held)[doc].astype(np.int64), first)
            size = np.diff(np.append(first, len(word)))
            w, h = word[first], before[first]
            bucket = (w >> np.uint64(40)) % np.uint64(buckets)
            if len(frequent):
                spread = np.isin(w, frequent)
                bucket[spread] = (mix64(w[spread] ^ h[spread]) >> np.uint64(8)) % np.uint64(buckets)
            by_bucket = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1, dtype=np.uint64))
            narrow = np.uint16 if len(many) < 1 << 16 else np.uint32
            for b in range(buckets):
                mine = by_bucket[edges[b] : edges[b + 1]]
                if not len(mine):
                    continue
                own, runs = np.unique(w[mine], return_counts=True)
                held_by = size[mine]
                ends = np.cumsum(held_by)
                occ = np.arange(ends[-1]) + np.repeat(first[mine] - (ends - held_by), held_by)
                yield _rows([(b, PAIRS, at, _pack(own, runs.astype(np.uint32), *_split48(h[mine]), trained[mine].astype(np.uint32), held_by.astype(np.uint32), doc[occ].astype(narrow), np.array([len(many)], np.int64)))])

    return rows.mapInArrow(work, PARTS)


def _count_pairs(model: WordModel, often: dict[int, int], buckets: int):
    def work(table):
        out: list[tuple] = []
        parts = []
        for kind, at, data in zip(*[table.column(c).to_pylist() for c in ("kind", "at", "data")]):
            if kind == DOCS:
                out.append((at % buckets, DOCS, at, data))
            else:
                parts.append((at, _open(data)))
        if parts:
            word = np.concatenate([np.repeat(p[0], p[1]) for _, p in parts])
            before = np.concatenate([_join48(p[2], p[3]) for _, p in parts])
            trained = np.concatenate([p[4] for _, p in parts]).astype(np.int64)
            order = np.lexsort((before, word))
            w, h = word[order], before[order]
            new_word = np.ones(len(w), bool)
            new_word[1:] = w[1:] != w[:-1]
            new = new_word.copy()
            new[1:] |= h[1:] != h[:-1]
            group = np.empty(len(w), np.int64)
            group[order] = np.cumsum(new) - 1
            r = np.bincount(group, trained).astype(np.int64)
            w, h, owner = w[new], h[new], np.cumsum(new_word[new]) - 1
            c = np.bincount(owner, r).astype(np.int64)
            for k in np.flatnonzero(np.isin(w[new_word[new]], np.array(list(often), np.uint64))) if often else ():
                c[k] = often[int(w[new_word[new]][k])]
            c = c[owner]
            is_end = w == END
            del word, order, trained

            seen = r > 0
            gain = np.where(seen, np.log10(np.maximum(r, 1) * np.where(r > TOP, 1 - RESERVE, 1.0)), np.log10(model.probability(c)))
            gain -= np.where(is_end | (c == 0), 0.0, np.log10(np.maximum(c, 1)))
            base = model.base(c)
            known = (c > 0).astype(np.int64)
            small = np.where(seen & (r <= TOP), r, 0)

            at_pair = 0
            lost: list[tuple[np.ndarray, np.ndarray]] = []
            for at, p in parts:
                n = len(p[2])
                g = np.repeat(group[at_pair : at_pair + n], p[5])
                doc, docs = p[6].astype(np.int64), int(p[7][0])
                few = np.bincount(doc * (TOP + 1) + small[g], minlength=docs * (TOP + 1)).reshape(docs, TOP + 1)[:, 1:]
                sums = [np.bincount(doc, x[g], docs) for x in (gain, base)]
                out.append((0, SUMS, at, _pack(*sums, np.bincount(doc, known[g], docs).astype(np.uint32), *[few[:, i].astype(np.uint32) for i in range(TOP)])))
                new_pair = ~seen[g]
                if new_pair.any():
                    lost.append((h[g[new_pair]], doc[new_pair] + at))
                at_pair += n

            # contexts of seen pairs: how often with which count, and what their words have
            order = np.argsort(h[seen], kind="stable")
            hs, rs, ps = h[seen][order], r[seen][order], model.probability(c[seen])[order]
            if len(hs):
                first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
                few = [np.add.reduceat((rs == i).astype(np.uint32), first).astype(np.uint32) for i in range(1, TOP + 1)]
                cells = [hs[first], np.add.reduceat(ps, first), np.add.reduceat(np.where(rs > TOP, rs, 0), first), *few]
                out += _by_context(CONTEXTS, cells, buckets)
            if lost:
                keys, at = np.concatenate([x for x, _ in lost]), np.concatenate([x for _, x in lost])
                order = np.lexsort((at, keys))
                keys, at = keys[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])]))
                out += _by_context(UNSEEN, [keys[first], at[first], np.diff(np.append(first, len(keys)))], buckets)
            if seen.any():
                out.append((0, COUNTS, 0, _pack(*_runs(w[seen]), *_split48(h[seen]), r[seen].astype(np.uint32))))
            few = np.bincount(np.minimum(r[seen], TOP + 2), minlength=TOP + 3)
            out.append((0, FEW, 0, _pack(few.astype(np.int64))))
        return pa.Table.from_batches([_rows(out)]) if out else pa.Table.from_batches([], schema=pa.schema(list(zip(["bucket", "kind", "at", "data"], _KINDS))))

    return work


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, how often each comes) of ordered numbers."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered))).astype(np.uint32)


def _found_pairs(numbered: DataFrame, model: WordModel, often: dict[int, int], buckets: int) -> DataFrame:
    sent = _send_pairs(numbered, buckets, often)
    return materialise(sent.groupBy("bucket").applyInArrow(_count_pairs(model, often, buckets), PARTS), "pairs", "kind")


def _by_context(kind: int, cells: list[np.ndarray], buckets: int) -> list[tuple]:
    bucket = cells[0] % np.uint64(buckets)
    out = []
    for b in range(buckets):
        at = np.flatnonzero(bucket == b)
        if len(at):
            out.append((b, kind, 0, _pack(*_split48(cells[0][at]), *[x[at] for x in cells[1:]])))
    return out


def _weigh(d: np.ndarray):
    """Back-off weights of a bucket's contexts, and what unseen pairs add to their rows."""

    def work(table):
        seen, lost = [], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            (seen if kind == CONTEXTS else lost).append(_open(data))
        key = np.zeros(0, np.uint64)
        if seen:
            h = np.concatenate([_join48(p[0], p[1]) for p in seen])
            key, back = np.unique(h, return_inverse=True)
            words = np.bincount(back, np.concatenate([p[2] for p in seen]))
            high = np.bincount(back, np.concatenate([p[3] for p in seen]).astype(float))
            few = [np.bincount(back, np.concatenate([p[4 + i] for p in seen]).astype(float)) for i in range(TOP)]
            c = high + sum((i + 1) * few[i] for i in range(TOP))
            kept = (high * d[-1] + sum(d[i + 1] * (i + 1) * few[i] for i in range(TOP))) / c
            weight = (1 - kept) / np.maximum(1 - words, 1e-300)
        out = {"kind": [], "key": [], "a": [], "b": []}
        if len(key):
            out = {"kind": [np.full(len(key), CONTEXTS)], "key": [key.view(np.int64)], "a": [c], "b": [weight]}
        for p in lost:
            h, row, n = _join48(p[0], p[1]), p[2], p[3]
            at = np.searchsorted(key, h)
            found = at < len(key)
            found[found] = key[at[found]] == h[found]
            row, n, at = row[found], n[found], at[found]
            if len(row):
                rows, back = np.unique(row, return_inverse=True)
                add = np.bincount(back, n * (np.log10(c[at]) + np.log10(weight[at])))
                for name, x in zip(out, (np.full(len(rows), UNSEEN), rows, add, np.zeros(len(rows)))):
                    out[name].append(x)
        kinds = {"kind": np.int64, "key": np.int64, "a": np.float64, "b": np.float64}
        return pa.table({k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in out.items()})

    return work


def _sum_rows(d: np.ndarray, ends: int):
    first = -np.log10(ends) if ends else 0.0

    def work(table):
        info, total = None, None
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            p = _open(data)
            if kind == DOCS:
                info = p
            else:
                total = [x + y for x, y in zip(total, p)] if total else [x.astype(float) for x in p]
        many, held, ids = info
        names = [None if x == b"-" else x[1:].decode() for x in ids.tobytes().split(b"\x00")]
        gain, base, known, *few = total
        score = gain + first + sum(f * np.log10(d[i + 1]) for i, f in enumerate(few))
        row = table.column("at")[0].as_py() + np.arange(len(many))
        return pa.table({"row": row, "name": pa.array(names, pa.string()), "held_out": held.astype(bool), "n_tokens": many, "n_known": known.astype(np.int64), "base_score": base, "score": score})

    return work


def pair_counts(found: DataFrame) -> DataFrame:
    """(word, before, n) from the ``pairs`` table: every pair of hashes that training rows hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                w, runs, low, high, n = _open(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(w, runs).view(np.int64)), pa.array(_join48(low, high).view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "before", "n"])

    return found.where(F.col("kind") == COUNTS).select("data").mapInArrow(work, "word long, before long, n long")


def score_texts(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``held_out``
    is a boolean column; the other rows are learned from."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    words = _count_words(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(1, -(-int(words.agg(F.sum("n")).first()[0] or 0) // BUCKET_TOKENS))
    model, often = _word_model(words, buckets)

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    found = _found_pairs(numbered, model, often, buckets)
    few = [_open(r.data)[0] for r in found.where(F.col("kind") == FEW).select("data").collect()]  # a few numbers per bucket
    few = sum(few) if few else np.zeros(TOP + 3)
    d = discounts({r: int(few[r]) for r in range(1, TOP + 2)})

    contexts = found.where(F.col("kind").isin(CONTEXTS, UNSEEN)).groupBy("bucket").applyInArrow(_weigh(d), "kind long, key long, a double, b double")
    contexts = materialise(contexts, "contexts", "kind")
    more = contexts.where(F.col("kind") == UNSEEN).groupBy(F.col("key").alias("of")).agg(F.sum("a").alias("more"))
    sums = found.where(F.col("kind").isin(DOCS, SUMS)).groupBy("at").applyInArrow(
        _sum_rows(d, model.ends), "row long, name string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    joined = sums.join(more, F.col("row") == F.col("of"), "left")
    return joined.select(
        F.col("name").cast(docs.schema[key].dataType).alias("id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
