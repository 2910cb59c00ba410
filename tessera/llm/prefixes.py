"""Conversation prefix trie by an external mergesort that knows common prefixes.

A turn becomes a symbol of fixed width: the length of its text and 128 bits of a hash of role and text; a conversation becomes the
bytes of its symbols, so byte order is an order of turns and texts are never sorted or moved. Equal conversations are
one row with their number and least id. These rows, now all distinct, are dealt by ranges of the order. A task sorts what it gets
into runs of bounded bytes; a run holds, for each sequence, how many turns it shares with the one before (LCP) and the rest. A
loser tree merges the runs: of two heads the one that shares more with the last winner goes first, and only heads that
share as much are compared, from there on. The merged stream drives a stack, the open path: a sequence that shares d turns
with the one before finishes all nodes below depth d, and each hands its sums to its parent.

Nodes on the path of a task's first or last sequence may go on in its neighbours, so they stay open: the task returns these two paths with
the sums of what it has finished below them. They are at most two rows a task and are sorted and merged in the same way, with
fewer tasks, until one is left and finishes them. Tasks grow in number with the data and hold no more than TASK bytes of sequences
each; one conversation's symbols (20 bytes a turn) and open path are held whole, however long it is, its texts never.

Defined results: a null role or text is empty; turns come in their order, null first, equal ones by length and hash; rows without a conv_id
are of no conversation and are left out; repeated rows are turns as any other; texts of any length are one turn; an empty table gives no
nodes, not even the root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, join_by_key
from tessera.llm.variants import CRC_TABLE, crc_sql

#: Bytes of a symbol: the length of the text, then a hash.
LENGTH, SYMBOL = 4, 20
#: Bytes of sequences that a task sorts, and that a run holds; ROW more for each row.
TASK, RUN, ROW = 64 << 20, 4 << 20, 200
#: Ids in a piece of a list of ids.
PIECE = 1 << 16
#: What a node has gathered: conversations and the least of them, children, leaves and saved characters below it, key of the conversations that end in it.
SUMS = "n long, least long, children long, leaves long, saved long, ends binary"
#: A finished node has its key and its parent's; an open path its sequence and the sums of its last nodes.
MADE = f"seq binary, sums array<struct<{SUMS}>>, key binary, parent binary, depth long, symbol binary, {SUMS}"
NONE = (1 << 63) - 1


def symbol(role: Column, text: Column) -> Column:
    """A turn's symbol in hex, so that symbols can be joined to one text."""
    role, text = (F.coalesce(x.cast("string"), F.lit("")) for x in (role, text))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.lpad(F.hex(F.char_length(text)), 2 * LENGTH, "0"), F.substring(F.sha2(whole, 256), 1, 2 * (SYMBOL - LENGTH)))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id and symbols, in order, of each conversation of conversations(conv_id, turn, role, text)."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", symbol(F.col("role"), F.col("text")).alias("symbol"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "symbol"))).alias("turns")).select("conv_id", F.col("turns.symbol").alias("symbols"))


def rebuilt(own: DataFrame, *, group: int = 100, most: int = 6) -> DataFrame:
    """paths(conv_id, symbols) whose first h turns are those of the group's first conversation, h = crc32(conv_id) % most."""
    base, h = F.col("conv_id") - F.col("conv_id") % group, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("symbols", 1, most - 1).alias("_head"))
    both = own.withColumn("_base", base).withColumn("_h", h).join(heads, "_base", "left")
    first = F.slice(F.coalesce("_head", F.array().cast("array<string>")), F.lit(1), F.col("_h"))
    return both.select("conv_id", F.concat(first, F.slice("symbols", F.col("_h") + 1, F.greatest(F.size("symbols"), F.lit(1)))).alias("symbols"))


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many symbols a and b begin with alike, at least at."""
    n, step = min(len(a), len(b)) // SYMBOL, 1
    while at < n:
        to = min(n, at + step)
        if a[at * SYMBOL : to * SYMBOL] == b[at * SYMBOL : to * SYMBOL]:
            at, step = to, 2 * step
        elif to == at + 1:
            break
        else:
            step = (to - at) // 2
    return at


def run_of(rows: list[tuple[bytes, list]]) -> list[tuple[int, bytes, list]]:
    """Rows in order: how much each shares with the one before, the rest of its sequence, and its sums."""
    rows.sort(key=lambda r: r[0])
    out, before = [], b""
    for seq, sums in rows:
        out.append((n := shared(before, seq, 0), seq[n * SYMBOL :], sums))
        before = seq
    return out


class Merge:
    """A loser tree over runs. head: each run's next row as (shared with the last winner, sequence, sums), or None at its end."""

    def __init__(self, runs: list[list[tuple[int, bytes, list]]]):
        self.left = [iter(r) for r in runs]
        self.head: list[list | None] = [None] * len(runs)
        for k in range(len(runs)):
            self.forward(k, b"")
        self.losers = [-1] * len(runs)
        self.winner = self.begin(1) if runs else -1

    def forward(self, k: int, before: bytes) -> None:
        row = next(self.left[k], None)
        self.head[k] = row and [row[0], before[: row[0] * SYMBOL] + row[1], row[2]]

    def first(self, a: int, b: int) -> bool:
        """Whether run a's head goes before b's. The one that doesn't then has what it shares with the other."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None
        if x[0] != y[0]:
            return x[0] > y[0]
        n = shared(x[1], y[1], x[0])
        at = slice(n * SYMBOL, (n + 1) * SYMBOL)
        wins = x[1][at] <= y[1][at]
        (y if wins else x)[0] = n
        return wins

    def begin(self, node: int) -> int:
        """Plays the matches below a node of the tree, whose leaves are the runs; its winner."""
        k = len(self.left)
        if node >= k:
            return node - k
        a, b = self.begin(2 * node), self.begin(2 * node + 1)
        wins = self.first(a, b)
        self.losers[node] = b if wins else a
        return a if wins else b

    def __iter__(self) -> Iterator[list]:
        k = len(self.left)
        while k and (row := self.head[self.winner]) is not None:
            yield row
            now = self.winner
            self.forward(now, row[1])
            node = (now + k) // 2
            while node:  # only the winner's own matches are played again
                if not self.first(now, self.losers[node]):
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


class Node:
    __slots__ = ("children", "ends", "key", "least", "leaves", "n", "parent", "saved", "symbol")

    def __init__(self, parent: bytes | None, symbol: bytes):
        self.parent, self.symbol = parent, symbol
        self.key = hashlib.blake2b((parent or b"") + symbol, digest_size=16).digest()
        self.n, self.least, self.children, self.leaves, self.saved, self.ends = 0, NONE, 0, 0, 0, None

    def add(self, s: dict) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + s["n"], self.children + s["children"], self.leaves + s["leaves"], self.saved + s["saved"]
        self.least = min(self.least, NONE if s["least"] is None else s["least"])
        self.ends = self.ends or s["ends"]

    def sums(self) -> dict:
        return {"n": self.n, "least": self.least, "children": self.children, "leaves": self.leaves, "saved": self.saved, "ends": self.ends}


def nodes_of(rows: Iterator[list], last: bool) -> Iterator[dict]:
    """Finished nodes of rows in order and, unless last is set, the first and the last path, open, with what is finished below them."""
    path: list[Node] = []
    first, open_, begun, seq = b"", 0, [], b""  # open_: so many of path's nodes are also the first path's

    def finish() -> dict | None:
        nonlocal open_
        node, depth = path.pop(), len(path)
        if depth < open_ and not last:
            open_ = depth
            begun.append(node.sums())
            return None
        node.leaves += not node.children
        node.saved += (node.n - 1) * int.from_bytes(node.symbol[:LENGTH], "big")
        if path:
            path[-1].add(node.sums() | {"children": 1, "ends": None})
        return {"key": node.key, "parent": node.parent, "depth": depth, "symbol": node.symbol} | node.sums()

    for common, seq, sums in rows:
        while len(path) > common + 1:
            if out := finish():
                yield out
        start = not path
        for d in range(len(path), len(seq) // SYMBOL + 1):
            path.append(Node(path[-1].key if path else None, seq[(d - 1) * SYMBOL : d * SYMBOL] if d else b""))
        if start:
            first, open_ = seq, len(path)
        for node, s in zip(reversed(path), reversed(sums), strict=False):
            node.add(s)
    if last:
        while path:
            yield finish()
    elif path:
        yield {"seq": seq, "sums": [x.sums() for x in path]}
        if begun:
            yield {"seq": first, "sums": begun[::-1]}


def merge(batches: Iterator[pa.RecordBatch], last: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A task: runs of the rows (seq, sums) that it gets, their merge, and its nodes."""
    runs, rows, size = [], [], 0
    for b in batches:
        for seq, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows.append((seq, sums))
            size += len(seq) + ROW * len(sums)
            if size > RUN:
                runs.append(run_of(rows))
                rows, size = [], 0
    if rows:
        runs.append(run_of(rows))
    made: list[dict] = []
    for out in nodes_of(iter(Merge(runs)), last):
        made.append(out)
        if len(made) >= 10_000:
            yield pa.RecordBatch.from_pylist(made, schema)
            made = []
    if made:
        yield pa.RecordBatch.from_pylist(made, schema)


def arrow_schema() -> pa.Schema:
    one = [("n", pa.int64()), ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.binary())]
    return pa.schema([("seq", pa.binary()), ("sums", pa.list_(pa.struct(one))), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("symbol", pa.binary()), *one])


def classes(ws: Workspace, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (conv_id, ends: key of the whole sequence) and, for each key, its sequence as seq and its sums, as merge reads them."""
    hexed = of.select("conv_id", F.unhex(F.array_join("symbols", "")).alias("seq"))
    all_ = ws.keep(hexed.select("conv_id", "seq", F.unhex(F.substring(F.sha2("seq", 256), 1, 32)).alias("ends")), "sequences")
    some = all_.groupBy("ends").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    zero = F.lit(0).cast("long")
    sums = F.array(F.struct("n", "least", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends")).alias("sums")
    rows = some.join(all_.select(F.col("conv_id").alias("least"), "seq"), "least").select("seq", sums)
    return all_.select("conv_id", "ends"), ws.keep(rows, "classes")


def prefix_trie(of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of paths(conv_id, symbols), conv_ids distinct: conv_id, the least member; depth; parent_conv_id; symbol (bytes) of the last turn; n_convs, n_children,
    n_leaves, saved; ends, a key of the members that end in the node, else null. And members: conv_id and ends.
    """
    ws = Workspace(of.sparkSession, "trie")
    members, rows = classes(ws, of)
    cores, done = of.sparkSession.sparkContext.defaultParallelism, []
    bytes_, count = rows.agg(F.coalesce(F.sum(F.length("seq") + F.size("sums") * ROW), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(cores, -(-bytes_ // TASK)) if count else 1
    while True:
        last = parts <= 1
        dealt = (rows.repartition(1) if last else rows.repartitionByRange(parts, "seq")).select("seq", "sums")
        made = ws.keep(dealt.mapInArrow(partial(merge, last=last, schema=arrow_schema()), MADE), "nodes")
        done.append(made.where("key IS NOT NULL").drop("seq", "sums"))
        if last:
            break
        rows = made.where("key IS NULL").select("seq", "sums")
        bytes_, count = rows.agg(F.coalesce(F.sum(F.length("seq") + F.size("sums") * ROW), F.lit(0)), F.count(F.lit(1))).first()
        parts = min(-(-bytes_ // TASK), count // 8)  # two rows a task come back, so each round has a quarter of the tasks at most
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    parents = nodes.where("children > 0").select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"), F.col("children").alias("_n"))
    below = join_by_key(nodes.where("parent IS NOT NULL"), parents, ["parent"], "_n", nodes.count())
    every = below.unionByName(nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    named = F.col("least").alias("conv_id"), "depth", "parent_conv_id", "symbol", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), "saved", "ends"
    return every.select(*named), members


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes of prefix_trie with the role and text of their last turn (null: the root), found by symbol."""
    turns = conversations.select(F.unhex(symbol(F.col("role"), F.col("text"))).alias("symbol"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return nodes.join(turns.dropDuplicates(["symbol"]), "symbol", "left")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (ends, conv_id) in order: ends, the first id and the ids of at most PIECE rows, comma-joined."""
    key, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=["ends", "first", "ids"])

    for b in batches:
        for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == PIECE):
                yield piece()
                ids = []
            key = k
            ids.append(i)
    if ids:
        yield piece()


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces (ends, ids) in order: ends and the SHA-256 of all its ids, comma-joined. One piece is held at a time."""
    key, state = None, None
    names = ["ends", "sha"]
    for b in batches:
        keys, shas = [], []
        for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    keys.append(key)
                    shas.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=names)


def id_hashes(members: DataFrame) -> DataFrame:
    """ends and sha: lowercase hex SHA-256 of the conv_ids of members(conv_id, ends) with that key, ascending, comma-joined.

    Ids of one key may be dealt over several tasks, by ranges; their pieces, PIECE ids each, then meet in order.
    """
    dealt = members.select("ends", "conv_id").repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id")
    some = dealt.mapInArrow(pieces, "ends binary, first long, ids string")
    return some.repartition("ends").sortWithinPartitions("ends", "first").select("ends", "ids").mapInArrow(hashed, "ends binary, sha string")


def digest(nodes: DataFrame, members: DataFrame) -> DataFrame:
    named = nodes.join(id_hashes(members), "ends", "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


SQL = rf"""
WITH crc AS ({CRC_TABLE}),
t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS sym FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(sym ORDER BY turn NULLS FIRST, n, sym) AS s, list(n ORDER BY turn NULLS FIRST, n, sym) AS n FROM t GROUP BY conv_id),
h AS (SELECT conv_id, s, n, {crc_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} % 6 AS h FROM own, crc),
c AS (SELECT a.conv_id, list_concat(coalesce(b.s, [])[1:h], a.s[h + 1:]) AS s, list_concat(coalesce(b.n, [])[1:h], a.n[h + 1:]) AS n FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
x AS (SELECT conv_id, s, n, unnest(range(len(s) + 1)) AS depth FROM c),
node AS (SELECT array_to_string(s[1:depth], '') AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(n[depth]), 0) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '')) AS ends_sha256 FROM x GROUP BY p, depth),
kids AS (SELECT left(p, 64 * (depth::INT - 1)) AS p, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
every AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.p = node.p AND kids.depth = node.depth),
up AS (SELECT p, depth, n_children, (n_convs - 1) * chars AS saved, unnest(range(depth + 1)) AS d FROM every),
total AS (SELECT left(p, 64 * d::INT) AS p, d AS depth, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL)
SELECT e.conv_id, e.depth::BIGINT AS depth, f.conv_id AS parent_conv_id, e.n_convs::BIGINT AS n_convs, e.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, e.ends_sha256
FROM every e JOIN total ON total.p = e.p AND total.depth = e.depth LEFT JOIN every f ON f.depth = e.depth - 1 AND f.p = left(e.p, 64 * (e.depth::INT - 1))
"""
