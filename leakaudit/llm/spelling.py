"""Groups of spelling variants: words that differ by one inserted, deleted or replaced letter.

1. Runs of letters are counted per stretch of text, then per word; what is rare goes.
2. A pair at one edit agrees before the edit and after it. With m the shorter length, the edit lies in the first or in the
   second half of m, so every word is posted under its second half for the one case and under its first half for the other, once
   for m = its length and once for m = its length - 1. A pair belongs to the half that holds the end of its common prefix, so none is
   met twice. A list of more than ``CROWD`` words is posted anew with each of its halves halved, down to a single
   letter, where the alphabet bounds it: no list outgrows a task, and no pair is lost.
3. The lists lie sorted one behind the other in each partition, words of the first-half case reversed, and are scanned once.
   The rows of the edit matrix, a band of three cells for every word of length m in the list, are kept by depth: the next word
   goes on from the row at its common prefix with the one before. A row holds only words still within one edit; where it is
   empty, all that shares the prefix is skipped.
4. Each word's nearest are merged by word; forms are followed to the last by doubling the links.

Words with many near ones are summed on the map side; a form follows at most a logarithm of the largest count, as each
has five times the occurrences of the one before.

Defined results: a null text has no words, a null id is an empty one in the checksum; repeated rows count again; ties between near words go to the first in
code-point order; words without a near one have ``n_near`` 0; an empty table gives an empty result; other columns take no part;
memory per task follows the longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakaudit.llm.common import _LOWERED, materialise, slices, text_bytes

LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
DAMAGED = 199  # a run whose checksum this divides loses a letter
CROWD = 4096

_LOWER = _LOWERED.astype(np.uint8)


def _crc_table() -> np.ndarray:
    """The steps of CRC-32 for each byte, from its reversed polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


_CRC = _crc_table()


def letter_runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of the maximal runs of letters in UTF-8: A-Z, a-z, and two bytes from C3 on."""
    small = raw | 0x20
    letter = (small >= 97) & (small <= 122)
    lead = raw == 0xC3
    letter |= lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    begins, finishes = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    finishes[:-1] &= ~letter[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def checksums(data: np.ndarray, first: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of the bytes, going on from the checksums of what stands before."""
    order = np.argsort(-size, kind="stable")
    at, state = first[order], ~seed[order]
    still = np.searchsorted(-size[order], -np.arange(1, (size.max() if len(size) else 0) + 1), "right")
    for k, n in enumerate(still.tolist()):  # the k-th bytes of all spans that have one
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): letters of at least LEAST_LETTERS, with a letter lost where the checksum says so, and how often they occur."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, ends = text_bytes(batch.column("text"))
            first, stop = letter_runs(raw, ends)
            begins_letter = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            letters = begins_letter[stop] - begins_letter[first]
            owner = np.searchsorted(ends, first, "right") - 1
            long = letters >= LEAST_LETTERS
            first, stop, letters, owner = first[long], stop[long], letters[long], owner[long]
            data = _LOWER[raw]
            seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column("id").to_pylist()], np.uint32)
            sums = checksums(data, first, stop - first, seeds[owner])
            hit = sums % DAMAGED == 0
            lost = []
            for i in np.flatnonzero(hit & (letters > LEAST_LETTERS)).tolist():
                run = data[first[i] : stop[i]].tobytes().decode()
                gone = int(sums[i]) % len(run)
                lost.append(run[:gone] + run[gone + 1 :])
            first, size = first[~hit], (stop - first)[~hit]
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            inside = np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])
            whole = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside])))
            counted = pa.concat_arrays([whole, pa.array(lost, pa.string())]).value_counts()
            yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], names=["word", "n"])

    return rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- posting


def _list_name(word, m, lo, hi) -> F.Column:
    """A list: what its words share outside [lo, hi) of m letters."""
    after = F.substring(word, F.char_length(word) - m + hi + 1, m - hi)
    return F.concat_ws("|", m.cast("string"), lo.cast("string"), hi.cast("string"), F.concat(F.substring(word, F.lit(1), lo), after))


def _posted(vocabulary: DataFrame) -> DataFrame:
    """(list, m, lo, hi, word, n)."""
    size = F.char_length("word")
    shorter = F.explode(F.filter(F.array(size, size - 1), lambda m: m >= LEAST_LETTERS)).alias("m")
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.inline(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("m").alias("hi"))))
    rows = vocabulary.select("word", "n", shorter).select("word", "n", "m", sides)
    return rows.withColumn("list", _list_name(F.col("word"), F.col("m"), F.col("lo"), F.col("hi")))


def _halved(posts: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    sides = F.inline(F.array(F.struct(F.col("lo").alias("from"), middle.alias("to")), F.struct(middle.alias("from"), F.col("hi").alias("to"))))
    rows = posts.select("word", "n", "m", sides).withColumnsRenamed({"from": "lo", "to": "hi"})
    return rows.withColumn("list", _list_name(F.col("word"), F.col("m"), F.col("lo"), F.col("hi")))


def posted(vocabulary: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(list, m, lo, hi, word, n): every word under what it shares with those one edit away, crowded lists split."""
    posts = _posted(vocabulary)
    while True:
        sizes = posts.where("hi - lo > 1").groupBy("list").agg(F.count("*").alias("held"))
        crowded = materialise(sizes.where(F.col("held") > crowd).select("list"), "crowded")
        if crowded.isEmpty():
            return posts
        split = _halved(posts.join(crowded, "list", "left_semi"))
        columns = ["list", "m", "lo", "hi", "word", "n"]
        posts = materialise(posts.join(crowded, "list", "left_anti").select(*columns).unionByName(split.select(*columns)), "posts")


# ---------------------------------------------------------------- scanning


def _band_steps() -> np.ndarray:
    """The next three cells of the band, coded in base 3 (2: more than one edit), from those of the row
    before and from which of the three letters are equal."""
    steps = np.zeros((27, 8), np.uint8)
    for code in range(27):
        left, middle, right = code // 9, code // 3 % 3, code % 3
        for equal in range(8):
            a = min(left + (not equal & 1), middle + 1, 2)
            b = min(middle + (not equal & 2), right + 1, a + 1, 2)
            c = min(right + (not equal & 4), b + 1, 2)
            steps[code, equal] = 9 * a + 3 * b + c
    return steps


_STEPS = _band_steps().ravel()
_FAR = 26
_START = 2 * 9 + 0 * 3 + 1


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return k


def scan(words: list[str], m: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sorted words one edit apart, the i-th of m letters and the j-th of m or m + 1."""
    asked = [i for i, w in enumerate(words) if len(w) == m]
    if not asked or len(words) < 2:
        return
    letters = np.zeros((m + 5, len(asked)), np.uint32)  # rows 2 .. m + 1 hold the letters, the rest equals none
    flat = np.frombuffer("".join(words[i] for i in asked).encode("utf-32-le"), np.uint32)
    letters[2 : m + 2] = flat.reshape(len(asked), m).T
    rows: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(len(asked)), np.full(len(asked), _START, np.uint8))]
    before, shared, dead = "", 0, m + 2
    for j, word in enumerate(words):
        shared = min(shared, common(before, word))
        before = word
        if shared >= dead:
            continue
        del rows[shared + 1 :]
        dead = m + 2
        for d in range(len(rows) - 1, len(word)):
            who, code = rows[d]
            letter = ord(word[d])
            equal = (letters[d + 1][who] == letter) + 2 * (letters[d + 2][who] == letter).view(np.uint8) + 4 * (letters[d + 3][who] == letter).view(np.uint8)
            code = _STEPS[code * np.uint8(8) + equal]
            alive = code != _FAR
            if not alive.all():
                who, code = who[alive], code[alive]
            rows.append((who, code))
            if not len(who):
                dead = d + 1
                break
        else:
            who, code = rows[len(word)]
            edits = code // 3 % 3 if len(word) == m else code // 9
            for i in who[edits == 1].tolist():
                yield asked[i], j
        shared = len(word)


def _near(posts: DataFrame) -> DataFrame:
    """(word, n_near, best): per list, how many words are near and the most frequent of them."""

    def merge(found: dict, word: str, n: int, other: str) -> None:
        count, best = found.get(word, (0, None))
        found[word] = (count + 1, min(best or (-n, other), (-n, other)))

    def of_list(name: str, words: list[str], counts: list[int], found: dict) -> None:
        m, lo, hi = (int(x) for x in name.split("|", 3)[:3])
        turned = lo == 0
        for i, j in scan(words, m):
            a, b = (words[i][::-1], words[j][::-1]) if turned else (words[i], words[j])
            at = common(a, b)
            if lo <= at and (at < hi or hi == m):
                merge(found, a, counts[j], b)
                if len(b) > m:
                    merge(found, b, counts[i], a)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, words, counts, found = None, [], [], {}

        def told() -> pa.RecordBatch:
            cells = [list(found), [v[0] for v in found.values()], [-v[1][0] for v in found.values()], [v[1][1] for v in found.values()]]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cells, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])

        for batch in batches:
            for own, word, n in zip(*[batch.column(c).to_pylist() for c in ("list", "side", "n")]):
                if own != name:
                    if len(words) > 1:
                        of_list(name, words, counts, found)
                    name, words, counts = own, [], []
                words.append(word)
                counts.append(n)
            if len(found) > 10_000:
                yield told()
        if len(words) > 1:
            of_list(name, words, counts, found)
        yield told()

    side = F.when(F.col("lo") == 0, F.reverse("word")).otherwise(F.col("word")).alias("side")
    lists = posts.select("list", side, "n").repartition("list").sortWithinPartitions("list", "side")
    found = lists.mapInArrow(work, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word."""
    return variants_of(word_counts(docs, key, text).where(F.col("n") >= LEAST_COUNT), crowd)


def variants_of(counted: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The same from (word, n)."""
    vocabulary = materialise(counted.select("word", "n"), "vocabulary")
    near = _near(posted(vocabulary, crowd))
    often = -F.col("best.order") >= TIMES * F.col("n")
    joined = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.order")).alias("form_n")
    )
    table = materialise(joined, "near")
    roots = _roots(table.where("form is not null").select("word", F.col("form").alias("root")))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's links, which only ever lead to more frequent words."""
    links = materialise(links, "links")
    while True:
        up = links.select(F.col("word").alias("via"), F.col("root").alias("top"))
        jumped = links.join(up, F.col("root") == F.col("via"), "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        jumped = materialise(jumped, "links")
        links = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return links
