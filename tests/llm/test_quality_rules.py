import math
from collections import defaultdict

import numpy as np
import pytest

from brute import SF, dup_lines, repeat_words, table, words
from leakaudit.llm import quality_rules as q


def counts(text):
    w = words(text)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup_lines(text), repeat_words(w))


def lines(text):
    return sum(1 for x in (text or "").split("\n") if words(x))


def brute(rows):
    """(id, counts, base_failed, kept) with the estimates made by numpy."""
    groups, vectors, base = defaultdict(list), {}, {}
    for k, (_, text, lang, source) in enumerate(rows):
        n, chars, symbols, dup, rep = c = counts(text)
        base[k] = (c, n < 20 or 100 * rep > 30 * n)
        x = [math.log((chars + 250) / (n + 50)), math.sqrt(symbols / (n + 50)), dup / (lines(text) + 10), rep / (n + 50)]
        vectors[k] = np.floor(np.array(x) * q.SCALE + 0.5)
        if not base[k][1]:
            groups[lang, source].append(k)
            groups[q.ALL].append(k)
    floor = np.diag(np.square(q.RESOLUTION))
    est = {}
    for g, ks in groups.items():
        b = np.sort(np.floor(np.array([vectors[k] for k in ks]) / 64), axis=0)
        est[g] = ((b[(len(ks) + 1) // 2 - 1] * 64 + 32) / q.SCALE, floor)

    def distance(k, g):
        d = vectors[k] / q.SCALE - est[g][0]
        return d @ np.linalg.solve(est[g][1], d)

    for _ in range(q.STEPS):
        own = {}
        for g, ks in groups.items():
            b = np.array([math.floor(math.log1p(distance(k, g)) * 1024) for k in ks])
            reach = np.sort(b)[math.ceil(len(ks) * q.SUPPORT) - 1]
            x = np.array([vectors[k] for k, v in zip(ks, b) if v <= reach]) / q.SCALE
            own[g] = (len(x), x.mean(0), (x.T @ x) / len(x) - np.outer(x.mean(0), x.mean(0)))
        whole = own[q.ALL]
        est = {g: ((n * m + 20 * whole[1]) / (n + 20), (n * s + 20 * whole[2]) / (n + 20) * q.CONSISTENCY + floor) for g, (n, m, s) in own.items()}
    return [(base[k], not base[k][1] and distance(k, (r[2], r[3])) <= q.CUTOFF) for k, r in enumerate(rows)]


def test_query_agrees_with_numpy(spark):
    import __spark_entry__ as entry

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table("documents")]
    want = {r[0]: b for r, b in zip(rows, brute(rows))}
    got = entry.queries()["op9_quality_rules"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed), r.kept) == want[r.doc_id]


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000)) + " a b c d e f g h" * 3
    texts = [None, "", " \n\t", "x", "a b c d e f g h " * 2, "é😀 " * 8, long, "one two\n" * 40, "$$$ ### " * 30, "a\x85b a\xa0b\x0bc"]
    rows = [(i, t, l, s) for i, t in enumerate(texts) for l, s in ((None, None), ("en", "s"))] + [(7, "plain words " * 15, "en", "s")] * 3
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, lang string, source string, distance string, x0 int")
    got = q.score_rules(docs).collect()
    assert sorted((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((i, *counts(t), counts(t)[0] < 20 or 100 * counts(t)[4] > 30 * counts(t)[0]) for i, t, _, _ in rows)
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert q.score_rules(docs.limit(0)).count() == 0 and q.keep_good(docs.limit(0)).count() == 0


def test_outliers_go_and_clean_texts_stay(spark):
    rng = np.random.default_rng(3)
    clean = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(30, 200))) for _ in range(150)]
    noisy = [" ".join("".join(rng.choice(list("#*$%"), 6)) for _ in range(60)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + noisy)], "doc_id long, text string, lang string, source string")
    got = {r.id: r.kept for r in q.score_rules(docs).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, 170))


def test_quantile():
    assert q.CUTOFF == pytest.approx(33.377, abs=0.01) and q.CONSISTENCY == pytest.approx(1.486, abs=0.01)
