import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from brute import sha, table
from leakaudit.llm import bpe

NAME = "byte_bpe_50k.json"
ODD = [None, "", " ", "\n\n \t x", "a<|endoftext|>b <|endoftext|>", "é" * 300, "ab" * 5000, "日本語 и العربية 🙂🙂", "don't we'll I'M", "0123 456", "\x00\x01", "x" * 20000 + " end"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def test_same_ids_and_text_as_the_library(library):
    codec = bpe.codec(NAME)
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + [r["text"] for r in table("documents")[:60]] + ["".join(rng.choice("ab \n'sé1.") for _ in range(200)) for _ in range(50)]
    for text in texts:
        ids = np.frombuffer(codec.encode(text), np.uint32)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_root_is_leftmost_lowest():
    tree = bpe.SegmentTree([5, 3, 9, 3 << 3])
    assert tree.tree[1] == 3
    tree.put(1, bpe.NO_PAIR)
    assert tree.tree[1] == 5


def test_bytes_that_are_no_text(library):
    codec = bpe.codec(NAME)
    ids = [codec.first[0xE6], codec.first[0x41]]
    assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(1, "", "x"), (None, "same", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.id if r.id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, NAME).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i is not None else -1, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert got == sorted(want)
    assert bpe.round_trip(docs.limit(0), NAME).count() == 0
    assert bpe.encode(docs, NAME, ids="tokens").where("doc_id = 9").first()["ids"] == "x"


def test_query(spark, library):
    import __spark_entry__ as entry
    from brute import SF

    want = {}
    for r in table("documents"):
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r["text"].encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entry.queries()["op8_bpe"](spark, SF).collect()}
    assert got == want
