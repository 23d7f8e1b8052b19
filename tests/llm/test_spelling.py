import random
import re
import zlib
from collections import Counter

import numpy as np
from brute import SF, UPPER, table

from leakaudit.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(docs):
    found = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return found


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(counted):
    kept = {w: n for w, n in counted.items() if n >= 5}
    near = {w: [x for x in kept if one_edit(w, x)] for w in kept}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-kept[x], x), default=None)
        form[w] = best if best and kept[best] >= 5 * kept[w] else None
    out = []
    for w, n in kept.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), kept[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def crowded():
    """Words that share long beginnings and ends, with runs of one letter that an insertion may fall anywhere into."""
    rng = random.Random(6)
    words = {"prefix" + "".join(rng.choice("abz") for _ in range(rng.randint(0, 4))) for _ in range(200)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) + "suffix" for _ in range(40)}
    words |= {"a" * n for n in range(6, 12)} | {"a" * n + "b" + "a" * m for n in range(1, 6) for m in range(1, 6)}
    words |= {"éclairé", "eclairé", "éclaire", "éclairés", "ÿÿÿÿÿÿ", "ÿÿÿÿÿÿÿ", "àààààà"}
    return [(w, 5 * 7 ** rng.randint(0, 3)) for w in sorted(words) if len(w) >= 6]


def test_scan_finds_all_pairs():
    rng = random.Random(1)
    for m in (6, 7, 9):
        for _ in range(20):
            words = sorted({"".join(rng.choice("abé") for _ in range(m + rng.randint(0, 1))) for _ in range(50)})
            want = {(i, j) for i, a in enumerate(words) if len(a) == m for j, b in enumerate(words) if one_edit(a, b)}
            assert set(spelling.scan(words, m)) == want
    assert list(spelling.scan([], 6)) == list(spelling.scan(["abcdef"], 6)) == list(spelling.scan(["abcdefg"], 6)) == []


def test_checksums_go_on():
    data = np.frombuffer("hello wörldabc".encode(), np.uint8)
    seeds = np.array([zlib.crc32(x) for x in (b"1:", b"", b"-77:")], np.uint32)
    got = spelling.checksums(data, np.array([0, 6, 12]), np.array([5, 6, 0]), seeds).tolist()
    assert got == [zlib.crc32(b"1:hello"), zlib.crc32("wörld".encode()), zlib.crc32(b"-77:")]


def test_query(spark):
    import __spark_entry__ as entry

    want = brute(counts([(r["doc_id"], r["text"]) for r in table("documents")]))
    got = rows(entry.queries()["op12_spelling_variants"](spark, SF))
    assert got == want and any(r[1] for r in got)


def test_crowded_lists_are_split(spark):
    words = spark.createDataFrame(crowded(), "word string, n long").repartition(3)
    want = brute(dict(crowded()))
    assert any(r[2] != (r[1] or r[0]) for r in want)  # forms of forms
    assert rows(spelling.variants_of(words)) == want
    for crowd in (20, 1):
        assert rows(spelling.variants_of(words, crowd)) == want


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "Naïveté NAÏVETÉ naïveté naïvete " * 5), (3, "éclairs-eclairs_éclair×s÷ " * 30), (3, "éclairs-eclairs_éclair×s÷ " * 30)]
    docs += [(4, "x" * 300_000), (5, ("y" * 5000 + " ") * 6), (6, "ends with letters"), (7, "and begins"), (-8, "łatwość fiancée " * 5), (9, "¿¿abcdefÃ̀ " * 6)]
    docs += [(1000 + i, "documents documentz dokuments" if i % 3 else "documents") for i in range(400)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, word string").repartition(4)
    want = brute(counts(docs))
    assert len(want) > 10
    assert rows(spelling.variants(frame)) == want
    assert spelling.variants(frame.limit(0)).count() == 0
