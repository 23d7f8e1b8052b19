import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import SF, repeated_bytes, sha, table
from leakaudit.llm import suffix_dedup as s


def expected(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), data, runs in zip(rows, texts, repeated_bytes(texts, n)):
        kept = s._remove(data, runs)
        out.append((i, len(data), len(data) - len(kept), len(runs), sha(kept)))
    return sorted(out, key=str)


def report(spark, rows, n):
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, unit string")
    return sorted(map(tuple, s.repeated_report(docs, n).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        pieces = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            pieces += [text(rng.randint(0, 30)), p[a : a + rng.randint(20, 200)]]
        rows.append((i, "".join(pieces)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_as_by_brute_force(spark, seed):
    rows = corpus(seed)
    assert report(spark, rows, 60) == expected(rows, 60)


def test_odd_rows(spark):
    long = "".join(random.Random(4).choice("abcdefgh ") for _ in range(60000))
    rows = [(1, None), (2, ""), (3, "x" * 59), (4, "x" * 60), (5, "y" * 500), (6, "ab" * 400), (7, long), (8, "q" + long[300:900] + "é"), (9, "same " * 3), (10, "same " * 3)]
    rows += [(11, "copy" + long[100:200]), (12, "copy" + long[100:200]), (13, "copy" + long[100:200] + "!"), (14, "twin " + long[5000:5200])] + [(14, "twin " + long[5000:5200])] * 2 + [(None, long[7000:7100]), (15, "é" * 100)]
    assert report(spark, rows, 60) == expected(rows, 60)
    docs = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, n int, digest string")
    kept = s.remove_repeats(docs, 60, length="n")
    assert kept.columns == docs.columns
    want = sorted((str(i), s._remove((t or "").encode(), r).decode("utf-8", "ignore")) for (i, t), r in zip(rows, repeated_bytes([(t or "").encode() for _, t in rows], 60)))
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == want
    assert s.repeated_report(docs.limit(0)).count() == 0 and s.remove_repeats(docs.limit(0)).count() == 0


def test_query(spark):
    import __spark_entry__ as entry

    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    got = sorted(map(tuple, entry.queries()["op4_suffix_dedup"](spark, SF).collect()), key=str)
    assert got == expected(rows, 200)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x & 1 for x in b)), max_size=8), max_size=6))
def test_loser_tree_orders_and_knows_prefixes(runs):
    runs = [sorted(r) for r in runs]
    prefixes = [[s.common(a, b, 0) for a, b in zip([b"", *r], r)] for r in runs]
    out, last = [], b""
    for run, i, same in s.LoserTree(runs, prefixes):
        key = runs[run][i]
        assert same == s.common(last, key, 0)
        out.append(key)
        last = key
    assert out == sorted(x for r in runs for x in r)


def test_front_coding():
    keys = sorted([b"", b"a", b"ab", b"ab", b"abc" * 50, b"b\x00", b"b\x00"])
    shared, lengths, tail = s._front_code(keys)
    import numpy as np

    assert s._unpack(np.frombuffer(shared, np.uint16), np.frombuffer(lengths, np.uint16), tail) == keys


def test_a_task_runs_one_python_step(spark):
    """Python steps of one task hold a worker each: between two of them lies an exchange."""
    units = spark.createDataFrame([(0, b"\0" * 16, b"\0" * 8)], "unit long, hashes binary, places binary")
    plan = s._repeated(units, 4)._jdf.queryExecution().sparkPlan().toString()
    seen, above = 0, []  # (depth, whether a Python step) of the node's ancestors in its task
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        name = line[depth:]
        python = name.startswith(("MapInArrow", "FlatMapGroupsInArrow"))
        while above and above[-1][0] >= depth:
            above.pop()
        assert not (python and any(p for _, p in above)), plan
        seen += python
        above.append((depth, python))
    assert seen == 2
