"""The prefix trie of conversations by an LCP-aware external mergesort.

A conversation is a path of turns; a turn stands in it by 16 bytes of digest (of role and text) and the bytes of its text,
so texts never move. Tasks sort blocks of paths into runs, and each path of a run carries its LCP, the turns it shares
with the one before it. The runs are written out and dealt by range of (path, id), so equal paths, however many, spread
over tasks. In each range a loser tree merges the runs: of two paths the one that shares more with the last output comes
first, and only if both share as much are turns compared, from there on. The merged stream runs over a stack of the open
path; a node is finished, and emitted, when a path without it comes.

Nodes that reach over the edge of a range (both neighbours share them) come out in parts, whose sums add up: how many
turns the ranges beside share, and how long the path before is, tell every task which nodes it opened, so that none is
counted twice, and whether one that it closes had children before. Parts meet by a digest of their path.

Defined cases: turns go by number, null first, equal numbers by role and then by digest; rows that repeat are turns of
their own; null roles and texts are empty; rows of a null conv_id belong to no conversation and are left out; a
conversation without turns ends at the root; an empty table has no nodes; further columns are not looked at. Two turns are
the same when 128 bits of their SHA-256 are. A conversation's digests (24 bytes a turn) are one row; so is, in a task's
memory, the path that is open."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sottovoce.llm.common import discard, materialise, prepare, skew_join, table

#: Bytes of a turn in a path: 16 of its digest, 8 of its text's size.
STEP = 24
#: Bytes of paths in a run, paths in one at most, and bytes of paths in a range.
RUN_BYTES, RUN_PATHS, RANGE_BYTES = 8 << 20, 50_000, 16 << 20
#: Ids of conversations that end at one node, in a row.
ENDS = 8192

_RUN = "path binary, conv_id long, run long, place int, lcp int"
_NODE = "kind int, key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, carried long, once long, ends_sha256 string, ids binary, part int, place int"
#: What a row of _NODE is: a node; a node whose parent comes in parts; a part of a node; ids that end at a node in parts.
WHOLE, ORPHAN, PART, IDS = range(4)


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """How many turns two paths share, of which `at` are known to be. Steps double as long as they are equal, and halve where not."""
    n, step = min(len(a), len(b)) // STEP, 1
    while at < n:
        end = min(at + step, n)
        if a[at * STEP : end * STEP] == b[at * STEP : end * STEP]:
            at, step = end, step * 2
        elif end - at == 1:
            break
        else:
            step = (end - at) // 2
    return at


def sorted_run(paths: list[tuple[bytes, int]]) -> list[tuple[bytes, int, int]]:
    """The (path, id) pairs in order, each with its LCP."""
    out, before = [], b""
    for path, i in sorted(paths):
        out.append((path, i, shared(before, path)))
        before = path
    return out


def merged(runs: list[list[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """All (path, id, LCP) of sorted runs in order, by a tree of losers. The LCP of the first of a run is taken as 0; those that come out refer to the output before."""
    heads = [iter(r) for r in runs]
    k = len(runs)

    def fetch(r: int, first: bool = False) -> list | None:
        item = next(heads[r], None)
        return None if item is None else [item[0], item[1], 0 if first else item[2]]

    front = [fetch(r, first=True) for r in range(k)]

    def beats(x: int, y: int) -> bool:
        """Whether run x's head comes before y's; the loser's LCP is set against the winner."""
        a, b = front[x], front[y]
        if a is None or b is None:
            return b is None
        if a[2] != b[2]:  # the one that shares less with the last output shares as much with the other
            return a[2] > b[2]
        at = shared(a[0], b[0], a[2])
        less = (a[0][at * STEP : (at + 1) * STEP], a[1]) <= (b[0][at * STEP : (at + 1) * STEP], b[1])
        (b if less else a)[2] = at
        return less

    tree = [-1] * max(k, 1)  # tree[1:]: the loser at each inner node

    def settle(node: int) -> int:
        """The winner below a node; sets the losers."""
        if node >= k:
            return node - k
        x, y = settle(2 * node), settle(2 * node + 1)
        win, lose = (x, y) if beats(x, y) else (y, x)
        tree[node] = lose
        return win

    win = settle(1) if k else -1
    while k and front[win] is not None:
        yield tuple(front[win])
        front[win] = fetch(win)
        node = (win + k) // 2
        while node:
            if beats(tree[node], win):
                win, tree[node] = tree[node], win
            node //= 2


class _Open:
    """A node of the open path."""

    __slots__ = ("children", "conv", "goes_on", "grown", "ids", "key", "leaves", "n", "on_last", "once", "own", "sha", "sized", "start")

    def __init__(self, conv: int, sized: int) -> None:
        self.conv, self.sized = conv, sized
        self.start, self.goes_on, self.grown, self.on_last, self.key = True, False, False, True, None
        self.n = self.children = self.leaves = self.own = self.once = 0
        self.ids: list[int] = []
        self.sha = None


def stream_nodes(stream: Iterator[tuple[bytes, int, int]], part: int = 0, last: bytes = b"", before: int = -1, grown_to: int = 0, after: int = -1) -> Iterator[tuple]:
    """Rows of _NODE for the sorted paths of a range, of which `last` is the last: `before` and `after` are the turns that its first and last path share
    with the ranges beside (-1: there is none), `grown_to` the length of the path before its first."""
    edge = max(before, after)  # nodes this deep may come in parts
    stack: list[_Open] = []
    waiting: list[list[tuple]] = []  # by depth: finished children of the open node, until its smallest id is known
    blocks: dict[bytes, int] = {}

    def ids_of(node: _Open, depth: int) -> tuple:
        blocks[node.key] = blocks.get(node.key, -1) + 1
        packed = b"".join(i.to_bytes(8, "little", signed=True) for i in node.ids)
        node.ids = []
        return (IDS, node.key, None, None, depth, None, None, None, None, None, None, None, packed, part, blocks[node.key])

    def ends_at(node: _Open, depth: int, i: int) -> Iterator[tuple]:
        if node.goes_on or not node.start:
            node.ids.append(i)
            if len(node.ids) >= ENDS:
                yield ids_of(node, depth)
        else:
            node.sha = node.sha or hashlib.sha256()
            node.sha.update(f",{i}".encode() if node.ids else str(i).encode())
            node.ids = [i]

    def close() -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        below = waiting.pop()
        if not node.goes_on:  # its last path is here
            node.leaves += not (node.children or node.grown)
        node.own += node.n * node.sized
        node.once += node.start * node.sized
        if stack:
            up = stack[-1]
            up.n, up.leaves, up.own, up.once, up.conv = up.n + node.n, up.leaves + node.leaves, up.own + node.own, up.once + node.once, min(up.conv, node.conv)
            up.children += node.start
        if node.goes_on or not node.start:
            if node.ids:
                yield ids_of(node, depth)
            yield (PART, node.key, stack[-1].key if stack else None, node.conv, depth, None, node.n, node.children, node.leaves, node.own, node.once, None, None, part, 0)
            yield from below  # their parent comes in parts: what they need is its key
            return
        for row in below:
            yield (WHOLE, None, None, *row[3:5], node.conv, *row[6:])
        sha = (node.sha or hashlib.sha256()).hexdigest()
        row = (ORPHAN, stack[-1].key if stack else None, None, node.conv, depth, None, node.n, node.children, node.leaves, node.own, node.once, sha, None, None, None)
        if stack:
            waiting[-1].append(row)
        else:
            yield (WHOLE, *row[1:])

    def open_(path: bytes, i: int, first: bool) -> None:
        depth, up = len(stack), stack[-1] if stack else None
        turn = path[(depth - 1) * STEP : depth * STEP] if depth else b""
        node = _Open(i, int.from_bytes(turn[16:], "big"))
        if depth <= edge:
            node.key = hashlib.blake2b((up.key if up else b"") + turn, digest_size=16).digest()
            node.on_last = not up or (up.on_last and turn == last[(depth - 1) * STEP : depth * STEP])
            node.goes_on = node.on_last and depth <= after
            if first and depth <= before:
                node.start, node.grown = False, depth < grown_to
        stack.append(node)
        waiting.append([])

    first = True
    for path, i, same in stream:
        turns = len(path) // STEP
        while len(stack) > same + 1:
            yield from close()
        while len(stack) <= turns:
            open_(path, i, first)
        first = False
        top = stack[-1]
        top.n, top.conv = top.n + 1, min(top.conv, i)
        yield from ends_at(top, turns, i)
    while stack:
        yield from close()


def paths(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: conv_id and turns, the array of its turns in order, each as hex of its digest and the size of its text."""
    role, text = (F.coalesce(turns[c], F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    step = F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    one = F.struct(turns[turn_col].isNotNull().alias("numbered"), turns[turn_col].alias("turn"), role.alias("role"), step.alias("step"))
    rows = turns.select(turns[id_col].cast("long").alias("conv_id"), one.alias("t")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["step"]).alias("turns"))


def packed(turns: Column) -> Column:
    """The path of an array of turns (see paths)."""
    return F.unhex(F.array_join(turns, ""))


def _runs(listed: DataFrame, most: int) -> DataFrame:
    """The paths of (path, conv_id) in sorted runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sottovoce.llm import trie

        number = TaskContext.get().partitionId() << 32

        def out(held: list[tuple[bytes, int]]) -> pa.RecordBatch:
            ps, ids, lcps = zip(*trie.sorted_run(held), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ps, pa.binary()), pa.array(ids, pa.int64()), pa.array([number] * len(ps), pa.int64()), pa.array(range(len(ps)), pa.int32()), pa.array(lcps, pa.int32())], ["path", "conv_id", "run", "place", "lcp"])

        held, size = [], 0
        for batch in batches:
            for path, i in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                held.append((path, i))
                size += len(path)
                if size >= trie.RUN_BYTES or len(held) >= most:
                    yield out(held)
                    held, size, number = [], 0, number + 1
        if held:
            yield out(held)

    return listed.select("path", "conv_id").mapInArrow(run, _RUN)


def _edges(ranged: DataFrame) -> dict[int, tuple[int, int, int]]:
    """For each range: the turns its first path shares with the range before, the length of the last path there, and the turns its last path shares with the range after. As many entries as ranges."""
    ends = ranged.groupBy("range").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    w = W.orderBy("range")

    @F.pandas_udf("int")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        from sottovoce.llm import trie

        return pd.Series([-1 if x is None or y is None else trie.shared(x, y) for x, y in zip(a, b, strict=True)])

    beside = ends.select("range", "first", "last", F.lag("last").over(w).alias("left"), F.lead("first").over(w).alias("right"))
    found = beside.select("range", same("left", "first").alias("before"), F.coalesce(F.length("left") / STEP, F.lit(0)).cast("int").alias("grown"), same("last", "right").alias("after"))
    return {r["range"]: (r["before"], r["grown"], r["after"]) for r in found.collect()}


def trie(listed: DataFrame, ranges: int | None = None, run_paths: int = RUN_PATHS) -> DataFrame:
    """The nodes of conversations given as rows (conv_id, path): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (bytes that a shared prefix saves, summed over the subtree), ends_sha256."""
    spark = listed.sparkSession
    prepare(spark)
    runs = materialise(_runs(listed, run_paths), "runs")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = runs.agg(F.sum(F.length("path") + 16)).head()[0] or 0
    ranges = ranges or max(tasks, -(-size // RANGE_BYTES))
    ranged = materialise(runs.repartitionByRange(ranges, "path", "conv_id").withColumn("range", F.spark_partition_id()), "ranged")
    discard(runs)
    edges = _edges(ranged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sottovoce.llm import trie

        schema = pa.schema([(f.split(" ")[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.split(" ")[1]]) for f in trie._NODE.split(", ")])

        def nodes(number: int, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
            rows = []
            runs = [held[r] for r in sorted(held)]
            for row in trie.stream_nodes(trie.merged(runs), number, max(r[-1][0] for r in runs), *edges[number]):
                rows.append(row)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        now, held = None, {}
        for batch in batches:
            for number, r, path, i, lcp in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "path", "conv_id", "lcp")), strict=True):
                if number != now:
                    if held:
                        yield from nodes(now, held)
                    now, held = number, {}
                held.setdefault(r, []).append((path, i, lcp))
        if held:
            yield from nodes(now, held)

    ordered = ranged.repartition(ranges, "range").sortWithinPartitions("range", "run", "place")
    rows = materialise(ordered.mapInArrow(run, _NODE), "nodes")
    discard(ranged)
    saved = (F.col("carried") - F.col("once")).alias("saved_tokens")
    counts = ["n_convs", "n_children", "n_leaves"]
    whole = rows.where(F.col("kind") == WHOLE).select("conv_id", "depth", "parent_conv_id", *counts, saved, "ends_sha256")
    parts = rows.where(F.col("kind") == PART).groupBy("key", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in [*counts, "carried", "once"]])
    parts = materialise(parts.join(_ends(rows), "key", "left"), "parts")
    of = parts.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256().hexdigest()
    nodes = parts.select("parent", "conv_id", "depth", *counts, saved, F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    orphans = rows.where(F.col("kind") == ORPHAN).select(F.col("key").alias("parent"), "conv_id", "depth", *counts, saved, "ends_sha256")
    return whole.unionByName(skew_join(nodes.unionByName(orphans), of, "parent", "left").drop("parent"))


def _ends(rows: DataFrame) -> DataFrame:
    """key and ends_sha256 of the nodes in parts where conversations end: a node's ids stream, in order, through one digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: bytes, sha) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

        now = sha = None
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                said = ",".join(str(int.from_bytes(ids[k : k + 8], "little", signed=True)) for k in range(0, len(ids), 8)).encode()
                if key != now:
                    if sha:
                        yield out(now, sha)
                    now, sha = key, hashlib.sha256(said)
                else:
                    sha.update(b"," + said)
        if sha:
            yield out(now, sha)

    blocks = rows.where(F.col("kind") == IDS).select("key", "part", "place", "ids")
    return blocks.repartition("key").sortWithinPartitions("key", "part", "place").mapInArrow(run, "key binary, ends_sha256 string")


def rebuilt(listed: DataFrame) -> DataFrame:
    """The contract's conversations of paths(): conv_id and path. Conversation c begins with the first h turns of c - c % 5 and goes on with its own after the first h; h is crc32 of c in decimal, modulo 9."""
    base = listed.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 8).alias("_head"))  # at most five conversations begin with it
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    joined = listed.join(base, F.col("conv_id") - F.col("conv_id") % 5 == F.col("_base"), "left")
    head = F.slice(F.coalesce("_head", F.array().cast("array<string>")), F.lit(1), h)
    return joined.select("conv_id", packed(F.concat(head, F.slice("turns", h + 1, F.size("turns")))).alias("path"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = materialise(paths(table(spark, sf_dir, "conversations")), "turns")
    return trie(rebuilt(listed))


def op13_sql() -> str:
    return """
WITH o AS (SELECT conv_id, list(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || ':' || strlen(coalesce(text, '')) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT conv_id, l, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS c FROM o),
h AS (SELECT conv_id, l, xor(c, 4294967295) % 9 AS h FROM k),
s AS (SELECT h.conv_id, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) AS s FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM s),
n AS (SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = d), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
c AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE string_split(n.p[d], ':')[2]::BIGINT END AS own FROM n LEFT JOIN c USING (p)),
a AS (SELECT unnest(list_transform(range(0, d + 1), lambda j: p[1:j])) AS p, n_children, own FROM f),
t AS (SELECT p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM a GROUP BY p)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
  CAST(t.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN t ON t.p = f.p LEFT JOIN n u ON f.d > 0 AND u.p = f.p[1:f.d - 1]
"""
