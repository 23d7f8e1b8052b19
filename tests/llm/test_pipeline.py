import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from brute import SF, components, repeated_bytes, sha, table, targets, words
from leakaudit.llm import suffix_dedup
from test_quality_rules import brute as rules


def mixed(rows):
    """(id, text) as often as the mix takes them; sources of up to 2048 documents."""
    by = defaultdict(list)
    for i, text, source in rows:
        key = hashlib.md5(f"7|{'null' if i is None else i}|{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        by[source].append((key, len(words(text)), i, text))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(x[1] for x in by[s]) for s in by}
    want = targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    out = []
    for s, docs in by.items():
        whole = math.floor(want[s] / sizes[s]) if sizes[s] else 0
        left, upto, more = want[s] - whole * sizes[s], 0, set()
        rest = sorted(docs)
        if left > 0:
            while rest and upto + rest[0][1] <= left:
                upto += rest[0][1]
                more.add(rest.pop(0)[0])
            gap = left - upto
            near = [(abs(n - gap), key) for key, n, _, _ in rest if abs(n - gap) < gap]
            if near:
                more.add(min(near)[1])
        for key, _, i, text in docs:
            out += [(i, text)] * (whole + (key in more))
    return out


def brute(rows):
    """rows: (id, text, lang, source)."""
    rows = [r for r, (_, kept) in zip(rows, rules(rows)) if kept]
    smallest = components([(r[0], r[1]) for r in rows], 5)
    rows = [r for r in rows if smallest[r[0]] == r[0]]
    data = [r[1].encode() for r in rows]
    cut = [suffix_dedup._remove(d, runs).decode("utf-8", "ignore") for d, runs in zip(data, repeated_bytes(data, 200))]
    out = mixed([(r[0], t, r[3]) for r, t in zip(rows, cut)])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = []
    for i, text in out:
        ids = library.encode(text, add_special_tokens=False).ids
        found.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode())))
    return Counter(found)


def test_run_as_by_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table("documents")]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == brute(rows)


def test_stages_take_odd_tables(spark):
    """Nulls, repeated rows, extra columns of clashing names, no rows."""
    good = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "s", 200, 1.0, "k") for i in range(6)]
    odd = [(None, None, None, None, None, None, None), (9, "", "en", None, 0, None, "k"), good[0], good[0], (3, "long " + "word " * 20000, None, "s", 5, 1.0, "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, target double, `row` string"
    frame = spark.createDataFrame(good + odd, schema)
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            assert docs is frame and out.count() > 0 or docs is not frame and out.count() == 0, name
