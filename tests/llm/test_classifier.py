import zlib

import numpy as np
import pyarrow as pa

from brute import SF, table
from leakaudit.llm import classifier


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    p = labels == 1
    return (ranks[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in entry.queries()["op6_quality_classifier"](spark, sf).collect()}
    assert len(got) == len(table("documents", sf))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[x["doc_id"]], x["quality"]) for x in table("labels", sf) if got[x["doc_id"]].held_out]
    assert auc(np.array([r.score for r, _ in held]), np.array([y for _, y in held])) > 0.95
    assert np.mean([r.predicted == y for r, y in held]) > 0.93


def test_features_have_unit_families():
    t, at, x = classifier.features(pa.array(["One two two!! THREE", None, "", "  ", "a", "é€ x"]))
    assert set(t.tolist()) == {0, 4, 5} and at.max() < 1 << classifier.BITS
    assert np.isclose((x[t == 0] ** 2).sum(), 3) and np.isclose((x[t == 4] ** 2).sum(), 2)
    alone = classifier.features(pa.array(["é€ x"]))
    assert np.array_equal(alone[1], at[t == 5]) and np.allclose(alone[2], x[t == 5])


def test_leader_learns_a_line():
    rng = np.random.default_rng(1)
    leader = classifier.Leader(4)
    for _ in range(3000):
        x = np.append(rng.normal(size=3), 1.0)
        leader.learn(np.arange(4), x, int(x[0] - x[1] > 0))
    w = leader.weights()
    assert w[0] > 1 and w[1] < -1 and abs(w[2]) < 0.5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "a b " * 50000, 0.5), (3, "good words", 0.5), (None, "x", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, None), (2, 1), (2, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    w = classifier.fit(docs, labels)
    assert classifier.score(docs, w).count() == 5
    none = classifier.fit(docs, labels.limit(0))
    assert {r.score for r in classifier.score(docs, none).collect()} == {0.5}
    assert classifier.score(docs.limit(0), w).count() == 0 and len(classifier.fit(docs.limit(0), labels)) == len(w)
    again = classifier.fit(docs, labels)
    assert np.array_equal(w, again) and SF


def test_hashes_do_not_depend_on_stretches(monkeypatch):
    from leakaudit.llm import common, suffix_dedup

    texts = pa.array(["Some words here " * 30, None, "x" * 500 + " y", "éa" * 200])
    raw, ends = common.text_bytes(texts)
    before = common.word_hashes(texts)[0], suffix_dedup.anchors(raw, ends, 60)
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 64)
    after = common.word_hashes(texts)[0], suffix_dedup.anchors(raw, ends, 60)
    assert np.array_equal(before[0], after[0]) and all(np.array_equal(a, b) for a, b in zip(before[1], after[1]))
