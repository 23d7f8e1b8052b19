import hashlib
import random

import numpy as np
from brute import SF, UPPER, sha, table

from leakaudit.llm import chunk_dedup


def low(text):
    return (text or "").translate(UPPER)


def brute(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in docs:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, sha(low(t).encode())))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in df.collect()), key=str)


def odd():
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh é😀\n") for _ in range(300_000))
    docs = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "a  b"), (6, long), (7, long.upper().replace("É", "é")), (8, long[:-1] + "!"), (9, "!" + long[1:]), (10, "É"), (11, "é")]
    docs += [(None, "a b"), (None, "nobody"), (12, "twice"), (12, "twice"), (13, "x" * 50_000), (14, "X" * 50_000), (15, "x" * 50_001), (-4, "nobody else"), (-3, "Nobody else")]
    return docs + [(100 + i, "Copy of one") for i in range(400)]


def test_cuts_depend_on_content_alone():
    rng = np.random.default_rng(3)
    own = rng.integers(97, 105, 200_000).astype(np.uint8)
    ends = lambda raw: chunk_dedup.chunk_ends(raw, np.array([0, len(raw)]))[0]
    alone = ends(own)
    before = rng.integers(97, 105, 777).astype(np.uint8)
    both = chunk_dedup.chunk_ends(np.concatenate([before, own]), np.array([0, 777, 777 + len(own)]))
    assert [x - 777 for x in both[1]] == alone
    sizes = np.diff([0, *alone])
    assert sizes.max() <= chunk_dedup.MOST and sizes[:-1].min() >= chunk_dedup.LEAST
    moved = {x - 50 for x in ends(np.concatenate([own[:1000], before[:50], own[1000:]]))}
    assert len(moved & set(alone)) > 0.9 * len(alone)  # an insertion leaves the cuts behind it


def test_rolling_hash_in_stretches():
    rng = np.random.default_rng(4)
    raw = rng.integers(0, 256, 3 << 20).astype(np.uint8)
    places = chunk_dedup.cut_places(raw)
    gear = [int(x) for x in chunk_dedup._GEAR]
    plain = lambda end: sum(gear[b] << k for k, b in enumerate(raw[end - 32 : end][::-1].tolist())) % (1 << 32)
    near = [x for x in places if abs(x % (1 << 20) - 0) < 3000 and x > 3000] + places[50:80]
    assert near and all(plain(x) >> (32 - chunk_dedup.CUT_BITS) == 0 for x in near)
    assert all((plain(x) >> (32 - chunk_dedup.CUT_BITS) == 0) == (x in set(places)) for x in range((1 << 20) - 3000, (1 << 20) + 3000))


def test_query(spark):
    import __spark_entry__ as entry

    want = brute([(r["doc_id"], r["text"]) for r in table("documents")])
    got = sorted((tuple(r)[:5] for r in entry.queries()["op11_exact_dedup"](spark, SF).collect()), key=str)
    assert got == want and any(not r[3] for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in odd()], "doc_id long, text string, recipe int, mark string").repartition(5)
    assert rows(chunk_dedup.exact_groups(docs)) == brute(odd())
    assert chunk_dedup.exact_groups(docs.limit(0)).count() == 0
    kept = chunk_dedup.keep_last(docs)
    assert kept.columns == docs.columns
    stays = sorted((r[0], r[4]) for r in brute(odd()) if r[3] and r[0] is not None)
    assert sorted((r.doc_id, hashlib.sha256(low(r.text).encode()).hexdigest()) for r in kept.collect() if r.doc_id is not None) == stays


def test_shared_hashes_are_told_apart(spark):
    docs = spark.createDataFrame(odd(), "doc_id long, text string").repartition(3)
    assert chunk_dedup.shared_hashes(docs.select("text"), 4) is not None
    assert rows(chunk_dedup.exact_groups(docs, bits=4)) == brute(odd())
    listed = chunk_dedup.recipes(docs, bits=4)
    assert listed.where("exists(recipe, x -> x < 0)").count() > 0


def test_texts_come_back(spark):
    docs = spark.createDataFrame(odd(), "doc_id long, text string").repartition(3)
    listed, store = chunk_dedup.recipes(docs), chunk_dedup.chunk_store(docs)
    assert store.count() == store.select("chunk_id").distinct().count() < listed.selectExpr("sum(size(recipe))").first()[0]
    got = {(r.id, r.text) for r in chunk_dedup.rebuild(listed, store).collect()}
    assert got == {(i, low(t)) for i, t in odd()}
