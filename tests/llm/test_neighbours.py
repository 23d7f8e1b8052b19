import heapq
import math

import numpy as np
from pyspark.sql import functions as F

from brute import SF, table
from leakaudit.llm import neighbours


def brute(rows, every, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    best = {}
    for q, a in good:
        if q % every:
            continue
        a = np.array(a)
        scores = {}
        for i, b in good:
            if i != q:
                s = float(neighbours.cosines(np.array([b]), a)[0])
                scores[i] = max(scores.get(i, -2), s)
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            best[q, rank] = (i, s)
    return best


def test_query_recall(spark):
    import __spark_entry__ as entry

    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings")]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in entry.queries()["op7_neighbours"](spark, SF).collect()}
    want = brute(rows, 50, 5)
    assert set(got) == set(want)
    hits = sum((q, got[q, r][0]) in {(q2, v[0]) for (q2, _), v in want.items()} for q, r in got)
    assert hits / len(want) >= 0.9
    by = dict(rows)
    for (q, _), (i, s) in got.items():
        assert s == float(neighbours.cosines(np.array([by[i]], float), np.array(by[q], float))[0])


def test_recall_on_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 12))
    rows = [(i, (centres[i % 30] + rng.normal(size=12) * 0.4).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.nearest(frame, every=50, k=5).collect()
    want = {(q, v[0]) for (q, _), v in brute(rows, 50, 5).items()}
    assert len(got) == len(want)
    assert sum((r.query_id, r.vec_id) in want for r in got) / len(want) >= 0.9


def test_odd_rows(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(0, same), (0, same), (7, same), (3, same), (3, same), (50, [0.0, 1.0, 1.0]), (9, [-1.0, -2.0, 0.0]), (None, same), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (8, [1.0, float("nan"), 0.0]), (10, [float("inf"), 0.0, 0.0]), (11, [1.0, 2.0]), (12, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(frame).collect()}
    assert got == brute([r for r in rows if r[0] not in (11, 12)], 50, 5) and len(got) == 8
    assert neighbours.nearest(frame.limit(0)).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 0")).count() == 0


def test_walk_gives_every_leaf_once():
    rng = np.random.default_rng(1)
    x = neighbours._unit(rng.normal(size=(800, 8)))
    tree = neighbours.Tree(x)
    leaves = list(tree.best_bins(x[0]))
    assert len(leaves) == len(set(leaves)) == sum(not c for c in tree.children) and set(tree.leaf_of(x)) <= set(leaves)


def test_copies_and_isolated_vectors(spark):
    rng = np.random.default_rng(4)
    heads, lone = rng.normal(size=(20, 16)), rng.normal(size=(40, 16))
    rows = [(i, (lone[i // 50] if i % 50 == 0 else heads[i % 20]).tolist()) for i in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = {}
    for every in (50, 25):  # isolated queries alone, and beside copies
        got = neighbours.nearest(frame, every=every).collect()
        want = brute(rows, every, 5)
        assert {(r.query_id, r.rank) for r in got} == set(want)
        lonely = [(r.query_id, r.vec_id) for r in got if r.query_id % 50 == 0]
        true = {(q, v[0]) for (q, _), v in want.items()}
        assert sum(p in true for p in lonely) / len(lonely) >= 0.9


def test_rows_that_share_an_id_do_not_crowd_out_others(spark):
    rows = [(7, [1.0, 0.0, 0.0])] * 30 + [(i, [1.0, 0.1 * i, 0.0]) for i in (0, 1, 2, 3, 4, 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(frame).collect()}
    assert got == brute(rows, 50, 5) and len(got) == 5


def test_a_walk_goes_on_until_it_holds_enough():
    rng = np.random.default_rng(5)
    tree = neighbours.Tree(neighbours._unit(rng.normal(size=(800, 8))))
    q = neighbours._unit(rng.normal(size=(1, 8)))[0]
    order = list(tree.best_bins(q))
    assert list(neighbours.walk(tree, {n: 1 for n in order}, q, 2, 5)) == order[:6]
    assert list(neighbours.walk(tree, {n: 9 for n in order}, q, 2, 5)) == order[:2]
    assert list(neighbours.walk(tree, {order[0]: 3}, q, 2, 5)) == order


def test_a_vector_of_another_length_loses_only_itself(spark):
    long = [(i, [1.0, 0.1 * i, 0.2]) for i in (0, 1, 2, 3, 50)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lambda rows: {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(frame(rows)).collect()}
    assert got([(-1, [1.0, 2.0]), *long]) == brute(long, 50, 5) and len(brute(long, 50, 5)) == 8
    short = [(100, [1.0, 2.0]), (101, [2.0, 1.0])]
    assert got(long + short) == brute(long, 50, 5) | brute(short, 50, 5)
    both = got([*long, (0, [1.0, 2.0]), (1, [1.0, 2.0]), (9, [2.0, 1.0])])
    assert [both[0, r][0] for r in range(1, 6)] == [1, 2, 3, 9, 50] and abs(both[0, 1][1] - 1) < 1e-9


def test_few_rows_leave_a_task_for_the_sample(spark):
    rows = spark.range(0, 20000, 1, 8).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    hash_ = F.xxhash64("id")
    assert neighbours._below(rows, 100, hash_).count() < 130  # of 8 x 100 that tasks would send
    got = [r.id for r in neighbours.smallest(rows, 100).collect()]
    assert got == [r.id for r in rows.orderBy(hash_, "id").limit(100).collect()]
    assert neighbours.smallest(rows.limit(0), 100).count() == 0 and neighbours.smallest(rows.limit(7), 100).count() == 7


def test_order_is_that_of_a_queue():
    def queue_order(tree, q):
        queue, out = [(0.0, 0)], []
        while queue:
            _, node = heapq.heappop(queue)
            out += [node] if not tree.children[node] else []
            for child in tree.children[node]:
                heapq.heappush(queue, (-float(tree.centre_matrix[child] @ q), child))
        return out

    rng = np.random.default_rng(8)
    x = neighbours._unit(rng.normal(size=(3000, 6)) + 3 * (rng.random((3000, 1)) < 0.5))
    tree = neighbours.Tree(x)
    assert tree.paths.shape[1] > 2
    for q in x[:40]:
        assert list(tree.best_bins(q)) == queue_order(tree, q)


def test_regions_and_chunks_change_nothing(spark, monkeypatch):
    """What a task holds is bounded: a crowded leaf lies in several regions, and queries come in chunks."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 16)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * 0.2 + (1 if i % 3 else i % 7)).tolist()) for i in range(1500)]
    rows += [(5000 + i, [1.0] * 8) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = sorted(map(tuple, neighbours.nearest(frame, every=10).collect()))
    monkeypatch.setattr(neighbours, "REGION_ROWS", 100)
    monkeypatch.setattr(neighbours, "CHUNK_BYTES", 4 * 8 * 20)
    assert sorted(map(tuple, neighbours.nearest(frame, every=10).collect())) == whole
    want = {(q, r, *v) for (q, r), v in brute(rows, 10, 5).items()}
    assert len(whole) == len(want) and len(want & set(whole)) / len(want) >= 0.9


def test_parts_are_about_equal():
    first, last = neighbours.spans(np.array([10, 1000, 0, 10, 500, 3]), 8)
    assert (first <= last).all() and last.max() < 8 and (first[1:] >= last[:-1]).all()
    assert last[1] - first[1] >= 4 and first[0] == last[0] and first[3] == last[3]


def test_copies_that_cannot_be_among_the_best_are_left_out():
    ids, x = np.array([5, 9, 1, 1, 7, 3, 8]), np.array([[1.0, 2.0]] * 6 + [[2.0, 1.0]])
    assert set(ids[neighbours.distinct(ids, x, 2)].tolist()) == {1, 3, 5, 8}
    assert len(neighbours.distinct(ids, x, 2)) == 4


def test_bars_never_exceed_the_true_score():
    rng = np.random.default_rng(3)
    x = neighbours._unit(rng.normal(size=(500, 16)))
    tree, ids = neighbours.Tree(x), np.arange(500) // 2
    sample = neighbours.Sample(ids, x, tree)
    bars = sample.bars(ids[:20], x[:20], 5)
    for q in range(20):
        best = {}
        for i, s in zip(ids, x @ x[q]):
            if i != ids[q]:
                best[i] = max(best.get(i, -2), s)
        assert -1 < bars[q] <= sorted(best.values())[-5]
