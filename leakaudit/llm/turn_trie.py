"""The trie of conversation prefixes, by adaptive radix trees over fixed-width turn identifiers.

1. A turn's identifier is the first 16 bytes of the SHA-256 of its role and text, read big-endian; a conversation's key is
   the identifiers of its turns one behind the other. Conversations of equal keys become one row with a count.
2. The keys are cut into ranges of at most about ``BLOCK_TURNS`` turns, whatever they share: a first turn that a third of all conversations
   have is spread over a third of the ranges. Each range becomes a radix tree: nodes hold 4, 16, 48 or 256 branches and change
   their layout as they fill, and bytes without a branch are kept as one path. Only depths at the end of a turn give
   trie nodes; sums run from the leaves up.
3. What a range shares with its neighbours is the prefix at either edge, known from the edges' keys. A node belongs to the first range that
   has it; there it counts as a child and once for what it saves, so all other sums of a shared node just add up by prefix.
4. The members that end at a node are hashed in order: sorted in ranges, joined to pieces, and the pieces of one node streamed
   through the hash. This is the one step that is serial in the size of a group, in constant memory.

Defined results: turns of one number are ordered by identifier, repeated rows are turns of their own; null roles and texts are empty; a
null conversation id is one conversation, of which no other takes turns; it counts as a member, is never the smallest beside another and is not listed
among the ends; a conversation without turns ends at the root; an empty table gives an empty result, without a root; other columns
take no part; memory per task follows the longest conversation, 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakaudit.llm.common import materialise, n_words, parts

WIDTH = 16
BLOCK_TURNS = 200_000
PIECE_BYTES = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- radix tree


class Sparse:
    """Up to 4, then 16 branches: their bytes in order, and the nodes beside them."""

    __slots__ = ("path", "end", "bytes", "kids", "room")

    def __init__(self, path: bytes, end: int = -1):
        self.path, self.end, self.bytes, self.kids, self.room = path, end, bytearray(), [], 4

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid):
        """The node that now has the branch: itself, or a roomier one."""
        at = self.bytes.find(byte)
        if at >= 0:
            self.kids[at] = kid
            return self
        if len(self.kids) == self.room:
            if self.room == 16:
                return Indexed(self).put(byte, kid)
            self.room = 16
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def branches(self) -> list:
        return self.kids


class Indexed:
    """Up to 48 branches: a byte's place among them, 0 for none."""

    __slots__ = ("path", "end", "places", "kids")

    def __init__(self, fuller: Sparse):
        self.path, self.end, self.places, self.kids = fuller.path, fuller.end, bytearray(256), list(fuller.kids)
        for place, byte in enumerate(fuller.bytes, 1):
            self.places[byte] = place

    def get(self, byte: int):
        place = self.places[byte]
        return self.kids[place - 1] if place else None

    def put(self, byte: int, kid):
        place = self.places[byte]
        if place:
            self.kids[place - 1] = kid
        elif len(self.kids) == 48:
            return Full(self).put(byte, kid)
        else:
            self.kids.append(kid)
            self.places[byte] = len(self.kids)
        return self

    def branches(self) -> list:
        return self.kids


class Full:
    """A node for each byte."""

    __slots__ = ("path", "end", "kids")

    def __init__(self, fuller: Indexed):
        self.path, self.end, self.kids = fuller.path, fuller.end, [fuller.get(b) for b in range(256)]

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def branches(self) -> list:
        return [kid for kid in self.kids if kid is not None]


class RadixTree:
    """Keys, each with the number it was given."""

    def __init__(self) -> None:
        self.root = None

    def insert(self, key: bytes, number: int) -> None:
        if self.root is None:
            self.root = Sparse(key, number)
            return
        above, byte, node, at = None, 0, self.root, 0

        def replace(new) -> None:
            if above is None:
                self.root = new
            else:
                above.put(byte, new)

        while True:
            path = node.path
            if not key.startswith(path, at):  # the path is cut where the key leaves it
                k = 0
                while at + k < len(key) and key[at + k] == path[k]:
                    k += 1
                upper = Sparse(path[:k])
                node.path = path[k + 1 :]
                upper.put(path[k], node)
                replace(upper)
                node, at = upper, at + k
            else:
                at += len(path)
            if at == len(key):
                node.end = number
                return
            kid = node.get(key[at])
            if kid is None:
                grown = node.put(key[at], Sparse(key[at + 1 :], number))
                if grown is not node:
                    replace(grown)
                return
            above, byte, node, at = node, key[at], kid, at + 1

    def upwards(self) -> Iterator[tuple[object, int, int]]:
        """(node, bytes read before it, bytes read at its end), children before parents."""
        order, stack = [], [(self.root, 0)] if self.root is not None else []
        while stack:
            node, top = stack.pop()
            bottom = top + len(node.path)
            order.append((node, top, bottom))
            stack += [(kid, bottom + 1) for kid in node.branches()]
        return reversed(order)


COLUMNS = "block int, shared boolean, mark binary, id {id}, depth long, parent_id {id}, parent_mark binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def trie_nodes(keys: list[bytes], words: list[list[int]], counts: list[int], firsts: list, ends: list[str], before: int, after: int, width: int = WIDTH) -> list[list]:
    """The rows of COLUMNS after ``block`` for one range of ordered keys. Its first key shares
    ``before`` turns with the last of the range before, its last key ``after`` turns with the first of the next; -1 where there is none."""
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    last = len(keys) - 1

    def marks(key: bytes, depth: int) -> list[bytes]:
        own = hashlib.sha256()
        out = [own.digest()]
        for d in range(depth):
            own.update(key[d * width : (d + 1) * width])
            out.append(own.digest())
        return out

    left, right = marks(keys[0], before), marks(keys[-1], after)
    made: list[list] = []
    below: dict[int, tuple] = {}
    for node, top, bottom in tree.upwards():
        n, first, leaves, saved, kids, low, high = 0, None, 0, 0, 0, last + 1, -1
        waiting: list[int] = []  # nodes whose parent is not known yet
        for kid in node.branches():
            n_, first_, leaves_, saved_, kids_, low_, high_, waiting_ = below.pop(id(kid))
            n, leaves, saved, kids, low, high = n + n_, leaves + leaves_, saved + saved_, kids + kids_, min(low, low_), max(high, high_)
            first = first_ if first is None else first if first_ is None else min(first, first_)
            if len(waiting) < len(waiting_):
                waiting, waiting_ = waiting_, waiting
            waiting.extend(waiting_)
        if node.end >= 0:
            i = node.end
            n, low, high = n + counts[i], min(low, i), max(high, i)
            first = firsts[i] if first is None else first if firsts[i] is None else min(first, firsts[i])
        at = bottom - bottom % width
        while at >= top and (at > 0 or top == 0):
            depth = at // width
            foreign, goes_on = low == 0 and depth <= before, high == last and depth <= after
            shared = foreign or goes_on
            said = words[low][depth - 1] if depth else 0
            leaves = 1 if not kids and not shared else leaves
            saved += (n if foreign else n - 1) * said
            mark = (left if foreign else right)[depth] if shared else None
            for k in waiting:
                made[k][4], made[k][5] = (None, mark) if shared else (first, None)
            waiting = [len(made)]
            made.append([shared, mark, first, depth, None, None, n, kids, leaves, saved, ends[node.end] if at == bottom and node.end >= 0 else None])
            kids = 0 if foreign else 1
            at -= width
        below[id(node)] = (n, first, leaves, saved, kids, low, high, waiting)
    return made


# ---------------------------------------------------------------- tables


def sequences(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns in order, as arrays of (name, words)."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    name = F.substring(F.unhex(F.sha2(F.concat(F.char_length(by), F.lit(":"), by, said), 256)), 1, WIDTH)
    rows = conversations.select(F.col(key).alias("id"), F.struct(F.col(turn).alias("turn"), name.alias("name"), n_words(said).cast("int").alias("words")).alias("t"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("id", F.transform("ts", lambda t: F.struct(t["name"], t["words"])).alias("turns"))


def rebuilt(conversations: DataFrame, every: int, most: int, **columns) -> DataFrame:
    """(id, turns): the first h turns of the conversation at the multiple of ``every`` at or before the id, then the own ones
    after the first h; h is the id's checksum modulo ``most`` + 1."""
    own = sequences(conversations, **columns)
    h = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % (most + 1)
    heads = own.where(F.col("id") % every == 0).select(F.col("id").alias("of"), F.slice("turns", F.lit(1), F.lit(most)).alias("head"))
    both = own.withColumn("h", h.cast("int")).join(heads, F.col("id") - F.pmod("id", F.lit(every)) == F.col("of"), "left")
    nothing = F.slice("turns", F.lit(1), F.lit(0))
    turns = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), nothing), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return both.select("id", turns.alias("turns"))


def _ends(listed: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of each key's ids in order, joined by commas."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, size, out = None, [], 0, []

        def close() -> None:
            out.append((key, own[0], ",".join(map(str, own))))

        for batch in batches:
            for k, i in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist()):
                if own and (k != key or size > PIECE_BYTES):
                    close()
                    own, size = [], 0
                key = k
                own.append(i)
                size += 8
            yield told(out)
            out = []
        if own:
            close()
        yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        cells = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cells[0], pa.binary()), pa.array(cells[1], kind), pa.array(cells[2], pa.string())], names=["key", "at", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            out = []
            for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
                if k == key:
                    own.update(b",")
                else:
                    if own is not None:
                        out.append((key, own.hexdigest()))
                    key, own = k, hashlib.sha256()
                own.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["key", "ends"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([own.hexdigest()], pa.string())], names=["key", "ends"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = listed.schema["id"].dataType
    kind = to_arrow_type(id_type)
    ids = listed.where("id is not null").select("key", "id")
    pieces = ids.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(pack, ids.select("key").schema.add("at", id_type).add("piece", "string"))
    return pieces.repartition("key").sortWithinPartitions("key", "at").mapInArrow(digest, "key binary, ends string")


def _shared_turns(a: str, b: str) -> F.Column:
    """How many turns two paths begin with alike; -1 where one is missing."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differs.isNull(), -1).when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def prefix_trie(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(id, depth, parent_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per prefix of the
    conversations (id, turns)."""
    names = F.transform("turns", lambda t: t["name"])
    key = F.unhex(F.sha2(F.array_join(F.transform(names, F.hex), ""), 256))
    listed = materialise(convs.select("id", key.alias("key"), names.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")), "paths")
    distinct = listed.groupBy("key", "path", "words").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    whole = materialise(distinct.join(_ends(listed), "key", "left").drop("key"), "sequences")
    turns = whole.agg(F.sum(F.size("path") + 1)).first()[0]
    if not turns:
        blocks = whole.withColumn("block", F.lit(0))
    else:
        blocks = whole.repartitionByRange(max(-(-turns // block_turns), parts(whole.sparkSession)), "path").withColumn("block", F.spark_partition_id())
    blocks = materialise(blocks, "blocks")
    in_order = Window.orderBy("block")
    edges = blocks.groupBy("block").agg(F.min("path").alias("lowest"), F.max("path").alias("highest"))
    edges = edges.withColumns({"previous": F.lag("highest").over(in_order), "next": F.lead("lowest").over(in_order)})
    edges = edges.select("block", _shared_turns("previous", "lowest").alias("before"), _shared_turns("highest", "next").alias("after"))

    id_type = whole.schema["id"].dataType.simpleString()
    columns = COLUMNS.format(id=id_type)

    def build(table: pa.Table) -> pa.Table:
        keys = [b"".join(p) for p in table.column("path").to_pylist()]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        ordered = lambda c: [v[i] for v in [table.column(c).to_pylist()] for i in order]
        block, before, after = (table.column(c)[0].as_py() for c in ("block", "before", "after"))
        made = trie_nodes([keys[i] for i in order], ordered("words"), ordered("n"), ordered("id"), ordered("ends"), before, after)
        own = table.schema.field("id").type
        kinds = [pa.bool_(), pa.binary(), own, pa.int64(), own, pa.binary(), *[pa.int64()] * 4, pa.string()]
        cells = [pa.array([block] * len(made), pa.int32()), *[pa.array([m[j] for m in made], kind) for j, kind in enumerate(kinds)]]
        return pa.table(cells, names=names_)

    names_ = [c.split()[0] for c in columns.split(", ")]
    nodes = materialise(blocks.join(edges, "block").groupBy("block").applyInArrow(build, columns), "nodes")

    shared = nodes.where("shared")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = materialise(shared.groupBy("mark").agg(F.min("id").alias("id"), F.max("depth").alias("depth"), F.max("parent_mark").alias("parent_mark"), *sums, F.max("ends").alias("ends")), "shared")
    named = merged.select(F.col("mark").alias("parent_mark"), F.col("id").alias("named"))
    # a range's nodes find a shared parent among the range's own copies of it: at most one range's rows to a key
    copies = shared.select("block", F.col("mark").alias("parent_mark")).join(named, "parent_mark")
    plain = nodes.where("not shared").join(copies, ["block", "parent_mark"], "left").withColumn("parent_id", F.coalesce("named", "parent_id"))
    upper = merged.join(named, "parent_mark", "left").withColumn("parent_id", F.col("named"))
    out = ["id", "depth", "parent_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")]
    return plain.select(*out).unionByName(upper.select(*out))
