from collections import defaultdict

import pytest

from brute import SF, table, targets, words
from leakaudit.llm import mixing


def ranked(sources):
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = targets(sizes, ranked(sizes), 3)
    largest = defaultdict(int)
    taken = defaultdict(int)
    by_id = {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    for r in got:
        s = by_id[r.id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size and r.taken == r.times * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_query(spark):
    import __spark_entry__ as entry

    rows = [(r["doc_id"], r["text"], r["source"]) for r in table("documents")]
    out = entry.queries()["op1_mixing"](spark, SF)
    got = out.withColumnRenamed("doc_id", "id").collect()
    check(rows, got)
    again = entry.queries()["op1_mixing"](spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_odd_rows(spark):
    rows = [(i, "a b c " * (i % 7), ["z", "a", None, "", "é"][i % 5]) for i in range(60)]
    rows += [(100, None, "a"), (101, "", None), (102, "w " * 30000, "z"), (103, None, "empty")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, source string, size int, target string")
    check(rows, mixing.mix_plan(docs).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = {r.id: r.times for r in mixing.mix_plan(docs).collect()}
    assert mixed.count() == sum(times.values())
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_repeated_rows_share_one_decision(spark):
    docs = spark.createDataFrame([(1, "a b", "s")] * 5 + [(None, "a", "t")] * 3, "doc_id long, text string, source string")
    got = mixing.mix_plan(docs).collect()
    assert len(got) == 8 and len({r.times for r in got if r.id == 1}) == 1


def test_ranges_of_a_large_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rows = [(i, "w " * (1 + i * 7 % 13), "big" if i % 3 else "small") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(rows, mixing.mix_plan(docs).collect())
