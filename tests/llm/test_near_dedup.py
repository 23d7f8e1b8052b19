import random

import numpy as np
import pyarrow as pa

from brute import SF, components, shingles, table
from leakaudit.llm import near_dedup
from leakaudit.llm.common import word_hashes
from leakaudit.llm.components import components as connected


def make(seed, groups=12, copies=6):
    """Families of edited copies around the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(6, 150))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_of_edges(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(300, 300), (7, 3)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {300: 300}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
    first = connected(spark.createDataFrame([(1, 2), (5, 6), (8, 9)], "a long, b long"))
    more = connected(spark.createDataFrame([(6, 2), (9, 8), (20, 21), (21, 5)], "a long, b long"), first)
    assert {r.node: r.component for r in more.collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 20: 1, 21: 1, 8: 8, 9: 8}
    assert connected(spark.createDataFrame([(1, 2)], "a long, b long"), first).count() == 6


def test_shingles_count_as_plain_sets():
    texts = [t for _, t in make(3)] + [None, "", "  ", "A", "a b c", "a a a a a a a a", "x\x0by Z", "A\xa0b c d e"]
    words, counts = word_hashes(pa.array(texts))
    for n in (4, 5):
        values, many = near_dedup.shingle_hashes(words, counts, n)
        assert many.tolist() == [len(shingles(t, n)) for t in texts]
    a, b = word_hashes(pa.array(["One two", "oNE  tWo\n"]))
    assert a[:2].tolist() == a[2:].tolist() and b.tolist() == [2, 2]


def test_families_as_by_brute_force(spark):
    for seed, n in ((1, 4), (2, 5)):
        docs = make(seed)
        frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string")
        got = {r.id: r.component_id for r in near_dedup.near_groups(frame, n).collect()}
        assert got == components(docs, n)
        kept = near_dedup.keep_one(frame, n)
        assert kept.columns == frame.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in components(docs, n).values()})


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (8, long), (7, long + " end"), (9, "x y z w v"), (9, "x y z w v"), (None, "x y z w v"), (None, "q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id or 0), r.n_shingles, r.component_id or 0) for r in near_dedup.near_groups(docs, 4).collect())
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 39998, 7), (8, 39997, 7), (9, 2, 9), (9, 2, 9), (0, 2, 9), (0, 2, 0)])
    kept = near_dedup.keep_one(docs, 4).collect()
    assert sorted(((r.doc_id or 0), (r.text or "")[:5]) for r in kept) == sorted([(1, ""), (2, ""), (3, " \n"), (4, "a b"), (6, "a b c"), (7, "w0 w1"), (9, "x y z"), (0, "q r s")])
    assert near_dedup.near_groups(docs.limit(0)).count() == 0 and near_dedup.keep_one(docs.limit(0)).count() == 0


def test_query(spark):
    import __spark_entry__ as entry

    docs = [(r["doc_id"], r["text"]) for r in table("documents")]
    want = components(docs, 4)
    got = entry.queries()["op2_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(shingles(t, 4)), want[i], want[i] == i) for i, t in docs}
