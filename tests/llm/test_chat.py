from brute import SF, table
from leakaudit.llm import chat


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def spans(turns):
    out, at = [], 0
    for r, t in turns:
        size = len(render([(r, t)]))
        if r == "assistant":
            out.append((at + len(f"<|im_start|>{r}\n"), at + size))
        at += size
    return out


def brute(rows):
    convs = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
        convs.setdefault(c, []).append((r or "", t or ""))
    out = {}
    for c, turns in convs.items():
        block = sorted(x for x in convs if x // 64 == c // 64)
        donor = block[(block.index(c) + 1) % len(block)]
        reply = [t for t in convs[donor] if t[0] == "assistant"][-1:]
        last = max([i + 1 for i, t in enumerate(turns) if t[0] == "assistant"], default=0)
        chosen, rejected = (turns[:last], turns[: last - 1] + reply) if last else (turns, turns)
        k = 0
        while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
            k += 1
        a, b = chosen[k:], rejected[k:]
        out[c] = (donor, k, render(chosen[:k]), render(a), render(b), spans(a), spans(b), bool(spans(a) and spans(b) and render(a) != render(b)))
    return out


def test_query(spark):
    import __spark_entry__ as entry

    flat = lambda s: ",".join(f"{a}-{b}" for a, b in s)
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")]
    want = {c: (*v[:5], flat(v[5]), flat(v[6]), v[7]) for c, v in brute(rows).items()}
    got = {r.id: tuple(r)[1:] for r in entry.queries()["op10_preference"](spark, SF).collect()}
    assert got == want and any(v[7] for v in want.values())


def test_odd_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (2, 0, "user", None), (2, 1, None, "é😀"), (3, 0, "assistant", "only"), (4, 1, "assistant", "b"), (4, 0, "user", "hi"), (4, 1, "assistant", "a"), (64, 0, "user", "x" * 300000), (64, 5, "assistant", "")]
    rows += [(1, 1, "assistant", "a")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, prompt int")
    made = chat.preference(chat.answered_by_others(chat.conversations(turns)))
    pair = lambda s: [(x.begin, x.end) for x in s]
    got = {r.id: (r.donor, r.prompt_turns, r.prompt, r.chosen_text, r.rejected_text, pair(r.chosen_spans), pair(r.rejected_spans), r.usable) for r in made.collect()}
    assert got == brute(rows)
    assert chat.preference(chat.answered_by_others(chat.conversations(turns.limit(0)))).count() == 0
    nameless = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert chat.preference(chat.answered_by_others(chat.conversations(nameless))).collect()[0].usable is False


def test_given_pairs(spark):
    turn = "struct<role:string,text:string>"
    pairs = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b"), ("user", "c")]), (2, [("user", "q")], [])], f"pair long, chosen array<{turn}>, rejected array<{turn}>")
    one, two = sorted(chat.preference(pairs).collect())
    assert (one.prompt_turns, one.prompt, one.usable) == (1, render([("user", "q")]), True)
    assert one.rejected_text[one.rejected_spans[0].begin : one.rejected_spans[0].end] == "b<|im_end|>\n"
    assert (two.prompt_turns, two.rejected_text, two.usable) == (0, "", False)
