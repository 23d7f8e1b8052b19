import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import SF, table, words
from leakaudit.llm import katz


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


class Model:
    """The same model with dictionaries of words."""

    def __init__(self, texts):
        self.c, self.r, self.h = Counter(), Counter(), Counter()
        for t in texts:
            w = [*words(t, True), None]
            self.c.update(w)
            self.r.update(zip(["<s>", *w], w))
            self.h.update(["<s>", *w[:-1]])
        self.n = sum(self.c.values())
        self.d1 = katz.discounts(Counter(self.c.values()))
        self.d2 = katz.discounts(Counter(self.r.values()))
        seen = defaultdict(list)
        for (h, w), r in self.r.items():
            seen[h].append((w, r))
        self.unknown = 1 - sum(self.word(w) for w in self.c) if self.n else 1.0
        self.a = {h: (1 - sum(self.pair(h, w) for w, _ in ws)) / (1 - sum(self.word(w) for w, _ in ws)) for h, ws in seen.items()}

    def word(self, w):
        c = self.c[w]
        return self.d1[min(c, katz.TOP + 1)] * c / self.n if c else self.unknown

    def pair(self, h, w):
        r = self.r[h, w]
        return self.d2[min(r, katz.TOP + 1)] * r / self.h[h]

    def p(self, h, w):
        if self.r[h, w]:
            return self.pair(h, w)
        return self.a[h] * self.word(w) if self.h[h] else self.word(w)

    def row(self, t):
        w = [*words(t, True), None]
        score = sum(math.log10(self.p(h, x)) for h, x in zip(["<s>", *w], w))
        base = sum(math.log10((self.c[x] + 0.1) / (self.n + 0.1 * (len(self.c) + 1))) for x in w)
        return len(w), sum(x in self.c for x in w), self.n, base, score


def check(got, rows):
    model = Model([t for i, t in rows if not held(i)])
    want = sorted(((str(i), held(i), *model.row(t)) for i, t in rows), key=lambda r: (r[0], r[2], r[6]))
    have = sorted(((str(r[0]), *r[1:]) for r in got), key=lambda r: (r[0], r[2], r[6]))
    assert [r[:5] for r in have] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in have], [r[5:] for r in want], rtol=1e-9, atol=1e-9)
    return model


def score(frame):
    return katz.score_texts(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)


def test_query(spark):
    import __spark_entry__ as entry

    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    got = entry.queries()["op3_katz"](spark, SF).collect()
    model = check(got, rows)
    for h in list(model.h)[:30]:  # every context's probabilities sum to 1
        assert sum(model.p(h, w) for w in model.c) + model.p(h, "never seen") == pytest.approx(1)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_many_buckets_and_slices(spark, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 3000)
    monkeypatch.setattr(katz, "SLICE", 20000)
    rows = [(r["doc_id"], r["text"]) for r in table("documents")] + [(1000 + i, "the the pair " * 400) for i in range(20)]
    check(score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A a\x0bA"), (5, "b\xa0c"), (6, "w " * 30000), (7, "new words"), (7, "new words"), (None, "a never"), (9, "x y"), (10, "a b")]
    rows += [(i, "a b c") for i in range(20, 60)]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    check(score(frame).collect(), rows)
    assert score(frame.limit(0)).count() == 0
    only = [r for r in rows if held(r[0])]
    assert only and all(r.score == 0 and r.train_tokens == 0 for r in score(spark.createDataFrame(only, "doc_id long, text string")).collect())


def test_discounts():
    d = katz.discounts({1: 1000, 2: 300, 3: 140, 4: 80, 5: 50, 6: 35})
    assert all(0 < x < 1 for x in d[1:]) and d[1] < d[2] < d[3]
    assert list(katz.discounts({})[1:3]) == [0.5, 0.75]


def test_stored_pair_counts(spark):
    rows = [(i, t) for i, t in enumerate(["a b a b", "b a", None, "a b c"] * 5)]
    frame = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "false AS held_out", "monotonically_increasing_id() AS row")
    words = katz._count_words(frame, 4)
    model, often = katz._word_model(words, 3)
    stored = katz.pair_counts(katz._found_pairs(frame, model, often, 3)).collect()
    assert Counter(r.n for r in stored) == Counter(Model([t for _, t in rows]).r.values())
    assert sum(r.n for r in words.collect()) == model.total == Model([t for _, t in rows]).n
