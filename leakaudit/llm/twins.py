"""DuckDB SQL for the results that SQL can express, written from the contracts.

None for op3 (sums of logarithms differ in the last digits), op4 and op8 (too slow or not
expressible), op6 and op7 (fitted), op9 (its verdict is iterative): these are tested against brute force.
"""

from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size,
         md5('7|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (
  SELECT *, total * (10 // weight) AS ratio,
         sum(3 * total) OVER q - 3 * total AS used, sum(weight) OVER q - weight AS gone,
         sum(total) OVER () AS budget, sum(weight) OVER () AS weights
  FROM w WINDOW q AS (ORDER BY total * (10 // weight), rk ROWS UNBOUNDED PRECEDING)),
f AS (SELECT budget - used AS free, weights - gone AS open FROM o WHERE 3 * total * (weights - gone) >= weight * (budget - used) ORDER BY ratio, rk LIMIT 1),
t AS (
  SELECT source, n, total, CASE WHEN free IS NULL THEN (3 * total)::DOUBLE ELSE least((3 * total)::DOUBLE, (weight * free)::DOUBLE / open::DOUBLE) END AS target
  FROM w LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (
  SELECT *, target - epochs * total AS left_over,
         (n > 2048)::INT + (n > 32768)::INT + (n > 524288)::INT + (n > 8388608)::INT AS digits FROM e),
k AS (SELECT d.*, c.source IS NULL AS nosource, c.left_over, c.digits, substr(d.key, 1, c.digits) AS rng FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source WHERE left_over > 0),
r AS (SELECT source, rng, left_over, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY rng) - sum(size) AS before FROM k GROUP BY source, rng, left_over),
cut AS (SELECT source, rng, left_over - before AS room FROM r WHERE before <= left_over AND left_over < before + size),
i AS (
  SELECT k.source, k.rng, k.key, cut.room, sum(k.size) AS size, sum(sum(k.size)) OVER (PARTITION BY k.source ORDER BY k.key) AS upto
  FROM k JOIN cut ON k.source IS NOT DISTINCT FROM cut.source AND k.rng = cut.rng GROUP BY k.source, k.rng, k.key, cut.room),
g AS (SELECT *, room - coalesce(max(CASE WHEN upto <= room THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM i),
x AS (
  SELECT source, rng, max(CASE WHEN upto <= room THEN key END) AS last_key,
         (SELECT h.key FROM g h WHERE h.source IS NOT DISTINCT FROM g.source AND h.upto > h.room AND abs(h.size - h.gap) < h.gap ORDER BY abs(h.size - h.gap), h.key LIMIT 1) AS extra
  FROM g GROUP BY source, rng)
SELECT d.doc_id, d.size, c.total AS source_size, c.target,
       (d.size * (c.epochs + (d.key <= coalesce(x.last_key, x.rng, '') OR d.key = coalesce(x.extra, ''))::INT))::BIGINT AS taken,
       (c.epochs + (d.key <= coalesce(x.last_key, x.rng, '') OR d.key = coalesce(x.extra, ''))::INT)::INTEGER AS times
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

OP2 = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM t),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM j JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, l.y FROM reach JOIN l ON reach.r = l.x),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _base32(hex_: str) -> str:
    """The 160 bits of a hexadecimal digest, five at a time."""
    letters = []
    for g in range(8):
        v = f"('0x' || substr({hex_}, {5 * g + 1}, 5))::BIGINT"
        letters += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({v} >> {shift}) & 31), 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(letters)


OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_base32("h")} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS complete
FROM f
"""

OP10 = """
WITH t AS (
  SELECT conv_id AS id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rn
  FROM conversations),
c AS (SELECT id, count(*) AS n, coalesce(max(CASE WHEN role = 'assistant' THEN rn END), 0) AS last FROM t GROUP BY id),
a AS (SELECT c.*, t.text AS reply, c.id // 64 AS block FROM c LEFT JOIN t ON t.id = c.id AND t.rn = c.last),
b AS (
  SELECT *, coalesce(lead(id) OVER q, first(id) OVER q) AS donor FROM a WINDOW q AS (PARTITION BY block ORDER BY id)),
g AS (
  SELECT b.*, o.reply AS given, CASE WHEN b.last = 0 THEN b.n WHEN o.reply = b.reply THEN b.last ELSE b.last - 1 END AS prompt_turns
  FROM b JOIN a o ON o.id = b.donor),
m AS (
  SELECT g.id, coalesce(string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.rn), '') AS prompt
  FROM g LEFT JOIN t ON t.id = g.id AND t.rn <= g.prompt_turns GROUP BY g.id),
u AS (SELECT g.*, m.prompt, last > 0 AND prompt_turns = last - 1 AS parts FROM g JOIN m USING (id))
SELECT id, donor, prompt_turns::INTEGER AS prompt_turns, prompt,
       CASE WHEN parts THEN '<|im_start|>assistant' || chr(10) || reply || '<|im_end|>' || chr(10) ELSE '' END AS chosen_text,
       CASE WHEN parts AND given IS NOT NULL THEN '<|im_start|>assistant' || chr(10) || given || '<|im_end|>' || chr(10) ELSE '' END AS rejected_text,
       CASE WHEN parts THEN '22-' || (33 + length(reply)) ELSE '' END AS chosen_spans,
       CASE WHEN parts AND given IS NOT NULL THEN '22-' || (33 + length(given)) ELSE '' END AS rejected_spans,
       parts AND given IS NOT NULL AS usable
FROM u
"""

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH d AS (SELECT doc_id, {LOWERED.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


# CRC-32 of a list of bytes, by the table t.steps of the steps of each byte.
CRC_STEPS = "(SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps)"


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], {bytes_}), lambda a, b: xor(a >> 8, t.steps[1 + (xor(a, b) & 255)])), 4294967295)"


_LATIN = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))"

OP12 = f"""
WITH RECURSIVE t AS {CRC_STEPS},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]{{6,}}')) AS run FROM documents),
each AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
h AS (SELECT run, n, {_crc(_LATIN.format("id || ':' || run"))} AS h FROM each, t),
kept AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM p),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON v.word = c.head || c.tail
  UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON v.word = c.head || c.tail),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
first AS (SELECT b.word, b.n_near, b.top, min(near.other) AS other FROM best b JOIN near ON near.word = b.word AND near.other_n = b.top GROUP BY ALL),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * v.n THEN other END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n FROM v LEFT JOIN first USING (word)),
walk(word, here, next) AS (SELECT word, word, form FROM f UNION ALL SELECT walk.word, walk.next, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT f.word, f.form, walk.here AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""

OP13 = f"""
WITH RECURSIVE t AS {CRC_STEPS},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations),
convs AS (SELECT conv_id AS id, ({_crc("list_transform(string_split(coalesce(conv_id::VARCHAR, ''), ''), lambda c: unicode(c)::BIGINT)")} % 4) AS h FROM (SELECT DISTINCT conv_id FROM conversations), t),
own AS (
  SELECT id, 0 AS part, k, role, text FROM convs JOIN turns ON turns.conv_id = id - (id % 20 + 20) % 20 AND k <= h
  UNION ALL SELECT id, 1, k, role, text FROM convs JOIN turns ON turns.conv_id IS NOT DISTINCT FROM id AND k > h),
numbered AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, k) AS d, sha256(length(role) || ':' || role || text) AS turn,
         len(regexp_extract_all(text, {WORD})) AS words FROM own),
walk(id, d, path, parent, words) AS (
  SELECT id, 0, '', NULL::VARCHAR, 0 FROM convs
  UNION ALL SELECT w.id, n.d::INTEGER, sha256(w.path || n.turn), w.path, n.words::INTEGER FROM walk w JOIN numbered n ON n.id IS NOT DISTINCT FROM w.id AND n.d = w.d + 1),
sizes AS (SELECT id, max(d) AS last FROM walk GROUP BY id),
nodes AS (
  SELECT path, any_value(parent) AS parent, any_value(words) AS words, d, min(w.id) AS first, count(*) AS n,
         sha256(coalesce(string_agg(w.id::VARCHAR, ',' ORDER BY w.id) FILTER (d = last), '')) AS ends_sha256
  FROM walk w JOIN sizes s ON s.id IS NOT DISTINCT FROM w.id GROUP BY path, d),
kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
up(path, above, leaf, saved) AS (
  SELECT n.path, n.path, kids.n IS NULL, (n.n - 1) * n.words FROM nodes n LEFT JOIN kids ON kids.parent = n.path
  UNION ALL SELECT up.path, n.parent, up.leaf, up.saved FROM up JOIN nodes n ON n.path = up.above WHERE n.parent IS NOT NULL),
sums AS (SELECT above, sum(leaf::INTEGER)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY above)
SELECT n.first AS conv_id, n.d::BIGINT AS depth, p.first AS parent_conv_id, n.n AS n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums ON sums.above = n.path LEFT JOIN kids ON kids.parent = n.path LEFT JOIN nodes p ON p.path = n.parent
"""


def statements() -> dict[str, str]:
    return {"op1_mixing": OP1, "op2_near_dedup": OP2, "op5_warc": OP5, "op10_preference": OP10, "op11_exact_dedup": OP11, "op12_spelling_variants": OP12, "op13_prefix_trie": OP13}
