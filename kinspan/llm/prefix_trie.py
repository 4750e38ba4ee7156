"""Conversations as a trie of their turns, by a merge sort that carries longest common prefixes.

Sequences of turns are dealt out by ranges of their order, in which a prefix stands before what it begins and copies stand
by id, so that neither a hot first turn nor a hot conversation is one task's. In each range batches become sorted runs in
which every sequence knows how many turns it shares with the one before; a loser tree merges the runs, and turns known to be
shared are not compared again. The merged stream opens and closes nodes on a stack. Nodes of the first and the last path of
a range may go on in its neighbours: they leave as parts, which are summed by node; all others leave finished.

A turn is known by 128 bits of the SHA-256 of its role and text: with 10^12 different turns two of them agree with a chance
of 10^-15. A sequence is one row of some 20 bytes a turn; a range holds about TURNS turns.

Edges: rows without conv_id belong to no conversation and are left out; null role or text is empty; turns are ordered by
turn, nulls first, ties by the turn's hash; repeated rows are turns of their own; other columns are ignored; an empty table
has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.llm.common import drop, staged

#: Bytes of a turn's key; sequences of a run; turns of a range, with its sequences; ids in a row of ends.
KEY, RUN, TURNS, ENDS = 16, 4096, 300_000, 4096
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_WALK = f"kind string, key binary, parent_key binary, {NODE}, size long, task int, branch int"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes): each conversation's turns in order, as hashes and as code points of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY))
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn", key.alias("key"), F.length(text).alias("size"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    turns = F.sort_array(F.collect_list("turn"))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.size").alias("sizes"))


def with_shared_start(seqs: DataFrame, leader: Column, n: Column, most: int) -> DataFrame:
    """Replaces the first n (up to most) turns of each sequence by those of the sequence with the id leader, if there is one."""
    starts = seqs.where(F.col("conv_id") == leader).select(
        F.col("conv_id").alias("_leader"), F.slice("keys", 1, most).alias("_keys"), F.slice("sizes", 1, most).alias("_sizes")
    )
    rows = seqs.withColumns({"_n": n.cast("int"), "_of": leader}).join(starts, F.col("_of") == F.col("_leader"), "left")

    def put(own: str, start: str) -> Column:
        rest = F.slice(own, F.col("_n") + 1, F.greatest(F.size(own), F.lit(1)))
        return F.when(F.col(start).isNull(), rest).otherwise(F.concat(F.slice(start, F.lit(1), F.col("_n")), rest))

    return rows.select("conv_id", put("keys", "_keys").alias("keys"), put("sizes", "_sizes").alias("sizes"))


# ---- runs and their merge -----------------------------------------------------------------------------------------


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that two paths share, of which `at` are known."""
    most = min(len(a), len(b)) // KEY
    if a[at * KEY : most * KEY] == b[at * KEY : most * KEY]:
        return most
    while a[at * KEY : (at + 1) * KEY] == b[at * KEY : (at + 1) * KEY]:
        at += 1
    return at


def sorted_run(rows: Iterable[tuple]) -> list[list]:
    """Rows (path, id, sizes) in order, each after the number of turns it shares with the one before."""
    out, before = [], b""
    for path, conv, sizes in sorted(rows, key=lambda r: r[:2]):
        out.append([shared(before, path), path, conv, sizes])
        before = path
    return out


class LoserTree:
    """Merges runs. All contenders know the turns that they share with the last winner, so turns are compared only beyond."""

    def __init__(self, runs: list[list[list]]):
        self.runs = [iter(r) for r in runs]
        self.front = [next(r, None) for r in self.runs]
        self.losers = [0] * len(runs)

    def _play(self, i: int, j: int) -> tuple[int, int]:
        a, b = self.front[i], self.front[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if a[0] != b[0]:
            return (i, j) if a[0] > b[0] else (j, i)
        at = shared(a[1], b[1], a[0])
        x, y = a[1][at * KEY : (at + 1) * KEY], b[1][at * KEY : (at + 1) * KEY]
        won, lost = (i, j) if (x, a[2]) < (y, b[2]) else (j, i)
        self.front[lost][0] = at
        return won, lost

    def _first(self, node: int) -> int:
        if node >= len(self.runs):
            return node - len(self.runs)
        won, self.losers[node] = self._play(self._first(2 * node), self._first(2 * node + 1))
        return won

    def __iter__(self) -> Iterator[list]:
        won = self._first(1) if self.runs else 0
        while self.runs and self.front[won] is not None:
            yield self.front[won]
            self.front[won] = next(self.runs[won], None)
            node = (won + len(self.runs)) // 2
            while node:
                won, self.losers[node] = self._play(won, self.losers[node])
                node //= 2


# ---- nodes on a stack ---------------------------------------------------------------------------------------------


class Open:
    """A node that later sequences may still pass through. Sums are of finished nodes below it."""

    __slots__ = ("conv", "n", "children", "leaves", "saved", "size", "ends", "waiting", "first")

    def __init__(self, size: int, first: bool):
        self.size, self.first, self.conv, self.ends, self.waiting = size, first, None, array("q"), []
        self.n = self.children = self.leaves = self.saved = 0

    def take(self, below: Open) -> None:
        self.conv = below.conv if self.conv is None else min(self.conv, below.conv)
        self.n, self.leaves, self.saved = self.n + below.n, self.leaves + below.leaves, self.saved + below.saved


def path_key(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: depth * KEY]).digest()[:KEY]


def walk(merged: Iterable[list], task: int) -> Iterator[dict]:
    """Nodes of a range as rows of _WALK; merged: (turns shared with the one before, path, id, sizes) in order."""
    stack, path, opened = [Open(0, True)], b"", False

    def part(depth: int, branch: int) -> Iterator[dict]:
        x, key = stack[depth], path_key(path, depth)
        yield {
            "kind": "part", "key": key, "parent_key": path_key(path, depth - 1) if depth else None, "conv_id": x.conv, "depth": depth, "size": x.size,
            "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "task": task, "branch": branch,
        }
        for row in x.waiting:
            yield row | {"kind": "edge", "parent_key": key}
        for i in range(0, len(x.ends), ENDS):
            yield {"kind": "ends", "key": key, "conv_id": x.ends[i], "ends_sha256": ",".join(map(str, x.ends[i : i + ENDS]))}

    def close() -> Iterator[dict]:
        depth = len(stack) - 1
        x, above = stack[depth], stack[depth - 1]
        if x.first:
            yield from part(depth, 1)
        else:
            x.leaves, x.saved = x.leaves or 1, x.saved + (x.n - 1) * x.size
            for row in x.waiting:
                yield row | {"kind": "node", "parent_conv_id": x.conv}
            row = {
                "conv_id": x.conv, "depth": depth, "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved,
                "ends_sha256": hashlib.sha256(",".join(map(str, x.ends)).encode()).hexdigest(),
            }
            above.children += 1
            if above.first:  # is a part in any case
                yield row | {"kind": "edge", "parent_key": path_key(path, depth - 1)}
            else:
                above.waiting.append(row)
        above.take(x)
        stack.pop()

    for at, path_next, conv, sizes in merged:
        while len(stack) - 1 > at:
            yield from close()
        path = path_next
        for depth in range(at, len(sizes)):
            stack.append(Open(sizes[depth], not opened))
        opened, top = True, stack[-1]
        top.conv, top.n = conv if top.conv is None else min(top.conv, conv), top.n + 1
        top.ends.append(conv)
    while opened and stack:
        depth = len(stack) - 1
        yield from part(depth, 0 if stack[depth].first else 2)
        if depth:
            stack[depth - 1].take(stack[depth])
        stack.pop()


def _walk_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = []
    for b in batches:
        for i in range(0, b.num_rows, RUN):
            x = b.slice(i, RUN).to_pydict()
            runs.append(sorted_run((b"".join(k), c, array("i", s)) for c, k, s in zip(x["conv_id"], x["keys"], x["sizes"])))
    names, rows = [c.split()[0] for c in _WALK.split(", ")], []
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _WALK.split(", ")])
    for row in walk(LoserTree(runs), TaskContext.get().partitionId()):
        rows.append(row)
        if len(rows) == RUN:
            yield pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema)


# ---- parts of nodes -----------------------------------------------------------------------------------------------


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a key, whose chunks of ids come in order: whatever their number, only a chunk is held."""
    key, state, done = None, None, []
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    for b in batches:
        for k, text in zip(b.column("key").to_pylist(), b.column("ends_sha256").to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], schema=schema)
            done = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


def _joined(walked: DataFrame) -> DataFrame:
    """Whole nodes from their parts. A range has two paths of parts at most, so these tables are small beside the sequences."""
    parts = walked.where("kind = 'part'")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = parts.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.min("conv_id").alias("conv_id"), F.min("task").alias("owner"), *sums
    )
    below = whole.where("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    whole = whole.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")

    # A node's own saving and its being a leaf are counted in the first range that it is in; its ancestors are there too, on
    # the same path: sums from the deepest up. Branch 0 is what the two paths share, above both.
    own = whole.select("key", "owner", ((F.col("n_convs") - 1) * F.col("size")).alias("saving"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    up = parts.select("key", "task", "branch", "depth").join(own, "key")
    deepest = F.col("depth").desc()
    for c in ("saving", "leaf"):
        mine = F.when(F.col("owner") == F.col("task"), F.col(c)).otherwise(0)
        every, branch = (F.sum(mine).over(Window.partitionBy(*by).orderBy(deepest)) for by in (("task",), ("task", "branch")))
        up = up.withColumn(f"{c}_sum", F.when(F.col("branch") == 0, every).otherwise(branch))
    up = up.groupBy("key").agg(F.sum("saving_sum").alias("savings"), F.sum("leaf_sum").alias("leaves"))

    ends = walked.where("kind = 'ends'").select("key", "conv_id", "ends_sha256").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = ends.mapInArrow(_hash_ends, "key binary, ends_sha256 string")
    above = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nodes = whole.join(up, "key").join(ends, "key", "left").join(above, "parent_key", "left")
    none = hashlib.sha256(b"").hexdigest()
    nodes = nodes.withColumns(
        {"n_leaves": F.col("n_leaves") + F.col("leaves"), "saved_tokens": F.col("saved_tokens") + F.col("savings"), "ends_sha256": F.coalesce("ends_sha256", F.lit(none))}
    )
    edges = walked.where("kind = 'edge'").drop("parent_conv_id").join(above, "parent_key")
    names = [c.split()[0] for c in NODE.split(", ")]
    return walked.where("kind = 'node'").select(*names).unionByName(edges.select(*names)).unionByName(nodes.select(*names))


def trie(seqs: DataFrame) -> DataFrame:
    """A row of NODE for each distinct beginning of the sequences (conv_id, keys, sizes); ids are distinct and not null.

    conv_id is the smallest id of the sequences that begin so (n_convs), depth its turns, parent_conv_id that of the node one
    turn shorter. n_leaves and saved_tokens are sums over the node and all below it: nodes that nothing continues, and
    (n_convs - 1) times the size of the last turn. ends_sha256 is of the ids that end here, ascending, joined by commas.
    """
    rows = staged(seqs, "trie-sequences")
    total = rows.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TURNS))
    walked = staged(rows.repartitionByRange(n, "keys", "conv_id").mapInArrow(_walk_ranges, _WALK), "trie-nodes")
    drop(rows)
    return _joined(walked)
