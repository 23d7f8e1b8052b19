import hashlib
import random
import zlib

from brute import SF, table, words

from leakaudit.llm import turn_trie

EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(rows):
    name = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    convs = {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, name(r or "", t or ""), r or "", t or ""))
    convs = {c: [x[3:] for x in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 4
        base = convs.get(c - c % 20, []) if c is not None else []
        out[c] = base[:h] + own[h:]
    return out


def brute(convs):
    """Every prefix with its members, straight from the definition."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    least = lambda cs: min((c for c in cs if c is not None), default=None)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in cs if c is not None and len(convs[c]) == len(p)))
        saved = sum((len(members[q]) - 1) * len(words(q[-1][1])) for q in under if q)
        out.append((least(cs), len(p), least(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), sum(q not in kids for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd():
    rng = random.Random(2)
    out = []
    for c in range(-30, 120):
        shared = rng.choice([[], ["hi"], ["hi"], ["hi", "what a b"], ["hi", "what a b", "c c"]])
        own = [rng.choice(["x", "y z", "", None, "é 😀", "long " * 20]) for _ in range(rng.randint(0, 3))]
        out += [(c, n if n else None, rng.choice(["user", None]) if n > 2 else "user", t) for n, t in enumerate(shared + own)]
    out += [(500 + i, n, "user", t) for i in range(40) for n, t in enumerate(["hi", "copies", "of", "one"])]
    out += [(20_000, n, None, None) for n in range(60)] + [(20_001, n, None, None) for n in range(40)]
    out += [(None, 0, "user", "hi"), (None, 1, "user", "nobody"), (700, 1, "user", "tie"), (700, 1, "user", "eit"), (700, 1, "user", "tie"), (2**62, 0, "user", "big")]
    return out


def test_node_layouts():
    rng = random.Random(1)
    tree, keys = turn_trie.RadixTree(), {}
    layouts = set()
    for i in range(4000):
        key = bytes(rng.choice([rng.randrange(256), 7]) for _ in range(rng.choice([0, 2, 4, 4, 6])))
        tree.insert(key, i)
        keys[key] = i
    found, stack = {}, [(tree.root, b"")]
    while stack:
        node, read = stack.pop()
        read += node.path
        layouts.add((type(node).__name__, getattr(node, "room", 0)))
        if node.end >= 0:
            found[read] = node.end
        stack += [(node.get(b), read + bytes([b])) for b in range(256) if node.get(b) is not None]
        assert len(node.branches()) == sum(node.get(b) is not None for b in range(256))
    assert found == keys
    assert layouts == {("Sparse", 4), ("Sparse", 16), ("Indexed", 0), ("Full", 0)}
    one = turn_trie.RadixTree()
    for n, key in enumerate([b"abcdef", b"abcxyz", b"abc"]):
        one.insert(key, n)
    assert one.root.path == b"abc" and one.root.end == 2 and {k.path for k in one.root.branches()} == {b"ef", b"yz"}


def test_query(spark):
    import __spark_entry__ as entry

    want = brute(rebuilt([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")]))
    assert rows(entry.queries()["op13_prefix_trie"](spark, SF)) == want


def test_odd_rows(spark):
    turns = spark.createDataFrame([(*r, 1, "x") for r in odd()], "conv_id long, turn long, role string, text string, id int, path string").repartition(5)
    want = brute(rebuilt(odd()))
    convs = turn_trie.rebuilt(turns, every=20, most=3)
    assert rows(turn_trie.prefix_trie(convs)) == want
    for block_turns in (150, 12, 1):  # nodes shared by several ranges
        assert rows(turn_trie.prefix_trie(convs, block_turns)) == want
    assert turn_trie.prefix_trie(turn_trie.rebuilt(turns.limit(0), every=20, most=3)).count() == 0


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "PIECE_BYTES", 64)
    turns = spark.createDataFrame([(i, 0, "user", "same") for i in range(3000)], "conv_id long, turn long, role string, text string").repartition(4)
    got = rows(turn_trie.prefix_trie(turn_trie.sequences(turns)))
    ends = hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    assert got == [(0, 0, None, 3000, 1, 1, 2999, EMPTY), (0, 1, 0, 3000, 0, 1, 2999, ends)]
