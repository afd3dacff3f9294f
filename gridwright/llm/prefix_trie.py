"""Conversations as a trie of turns: what they share from their first turn on.

A turn is known by SHA-256 of its role and text from the first step on, so texts never cross a shuffle. Conversations
that agree in all turns become one path with a count, their ids hashed in order. Paths are dealt out by their first turn;
each task builds the tries of its first turns from dictionaries and goes through them in postorder with a stack of its
own. A first turn that too many paths share is split by the next turn where they part, again and again; the nodes above
such a split are few and are put together from what is below them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as S

LIMIT = 2000  # paths that a task's tries have, about
BLOB = 1 << 20  # bytes of ids that are hashed, or passed on, at once
NONE = hashlib.sha256(b"").hexdigest()
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
STATS = ("conv_id", "n_convs", "n_leaves", "saved_tokens")


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as structs of digest and length. A conversation is one row of some 80 bytes a
    turn. Turns of equal number are put in the order of their digests; rows without conv_id go.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"),
        F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("t")
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("path"))


def rebuilt(convs: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """Each conversation with its first h turns taken from conversation conv_id - conv_id % block (all, if it has fewer;
    none, if there is none), h being the CRC-32 of its id in decimal modulo most + 1.
    """
    lead = F.col("conv_id") - F.col("conv_id") % block
    heads = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("lead"), F.slice("path", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    rows = convs.withColumns({"lead": lead, "h": h}).join(heads, "lead", "left")
    own = F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", F.array().cast(rows.schema["path"].dataType)), F.lit(1), F.col("h")), own).alias("path"))


def endings(rows: DataFrame) -> DataFrame:
    """key, n (rows), least (smallest id) and ends (SHA-256 of the ids in decimal, ascending, comma-joined) of each key;
    rows: key, conv_id, which is never repeated.

    Rows are dealt by ranges of key and id, so a key that a third of all rows share is spread over many tasks; each of
    them passes on its ids as text, and what is left for one task is hashing that text as a stream.
    """
    S.ship(rows.sparkSession)
    parts = S.tasks_for(rows)
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, ids, size, whole = None, [], 0, False  # whole: all ids of this key are in ids, as far as it has come

        def close(ended: bool) -> None:
            text = ",".join(map(str, ids)).encode()
            out.append((key, len(ids), ids[0], hashlib.sha256(text).hexdigest(), None) if whole and ended else (key, len(ids), ids[0], None, text))

        for b in batches:
            for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
                if k != key or size > BLOB:
                    if ids:
                        close(k != key)
                    whole = key is not None and k != key  # not the first of the task, which may have begun before it
                    key, ids, size = k, [], 0
                ids.append(c)
                size += 20
            if len(out) > 5000:
                yield S.batch(schema, *zip(*out))
                out.clear()
        if ids:
            close(False)
        if out:
            yield S.batch(schema, *zip(*out))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, least, sha = None, 0, None, None
        for b in batches:
            done = []
            for r in b.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        done.append((key, n, least, sha.hexdigest(), None))
                    key, n, least, sha = r["key"], 0, r["least"], hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(r["ids"])
                n += r["n"]
            if done:
                yield S.batch(schema, *zip(*done))
        if key is not None:
            yield S.batch(schema, [key], [n], [least], [sha.hexdigest()], [None])

    kinds = "key string, n long, least long, ends string, ids binary"
    runs = S.stored(rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(run, kinds), "endings")
    pieces = runs.where(F.col("ends").isNull()).repartition("key").sortWithinPartitions("key", "least").mapInArrow(join, kinds)
    return runs.where(F.col("ends").isNotNull()).unionByName(pieces).drop("ids")


class Trie:
    """Nodes by number, each with a dictionary of its children; the parent of a node has a smaller number."""

    def __init__(self, depth: int):
        self.depth = depth  # of its top
        self.children: list[dict[str, int]] = [{}]
        self.conv, self.n, self.size, self.level, self.ends = [math.inf], [0], [0], [depth], [NONE]

    def insert(self, digests: list[str], sizes: list[int], conv: int, n: int, ends: str) -> None:
        """A path from the top on; digests[0] is the top's own."""
        at = 0
        self.size[0] = sizes[0]
        self._count(at, conv, n)
        for digest, size in zip(digests[1:], sizes[1:]):
            below = self.children[at].get(digest)
            if below is None:
                below = self.children[at][digest] = len(self.children)
                self.children.append({})
                for column, value in ((self.conv, math.inf), (self.n, 0), (self.size, size), (self.level, self.level[at] + 1), (self.ends, NONE)):
                    column.append(value)
            at = below
            self._count(at, conv, n)
        self.ends[at] = ends

    def _count(self, at: int, conv: int, n: int) -> None:
        self.n[at] += n
        self.conv[at] = min(self.conv[at], conv)

    def nodes(self) -> Iterator[tuple]:
        """Every node after its subtree: depth, conv, the parent's conv (top: None), n, children, leaves, saved, ends."""
        leaves, saved = [0] * len(self.n), [0] * len(self.n)
        stack = [(0, None, iter(self.children[0].values()))]
        while stack:
            at, up, rest = stack[-1]
            below = next(rest, None)
            if below is not None:
                stack.append((below, at, iter(self.children[below].values())))
                continue
            stack.pop()
            leaves[at] = leaves[at] or 1
            saved[at] += (self.n[at] - 1) * self.size[at]
            if up is not None:
                leaves[up] += leaves[at]
                saved[up] += saved[at]
            yield self.level[at], self.conv[at], None if up is None else self.conv[up], self.n[at], len(self.children[at]), leaves[at], saved[at], self.ends[at]


def grown(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries whose paths a bucket holds; `key` and `up` are given for a trie's top only."""
    tries: dict[str, tuple[str, Trie]] = {}
    for key, up, depth, conv, n, ends, digests, sizes in zip(*(pdf[c].tolist() for c in ("key", "up", "depth", "conv_id", "n", "ends", "digests", "sizes"))):
        if key not in tries:
            tries[key] = up, Trie(depth)
        tries[key][1].insert(list(digests), [int(x) for x in sizes], conv, n, ends)
    rows = []
    for key, (up, trie) in tries.items():
        rows += [(key if node[2] is None else None, up if node[2] is None else None, *node) for node in trie.nodes()]
    out = pd.DataFrame(rows, columns=["key", "up", *(c.split()[0] for c in NODE.split(", "))])
    return out.astype({"parent_conv_id": "Int64"})


def shared(lo: Column, hi: Column) -> Column:
    """How many turns from the first on two paths share."""
    short = F.least(F.size(lo), F.size(hi))
    differ = F.array_position(F.zip_with(F.slice(lo, F.lit(1), short), F.slice(hi, F.lit(1), short), lambda a, b: a["digest"] != b["digest"]), True)
    return F.when(differ > 0, differ - 1).otherwise(short).cast("int")


def tops(big: DataFrame, below: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes above splits: `below` are the stats of the next nodes by key of the node they hang from, `ends` the paths
    that end where the split is.
    """
    sums = below.groupBy("up").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("below"), F.sum("count").alias("n_children")
    )
    own = ends.select(F.col("key"), F.col("conv_id").alias("own"), F.col("n").alias("own_n"), "ends")
    rows = big.join(sums.withColumnRenamed("up", "key"), "key", "left").join(own, "key", "left")
    n = F.coalesce("n_convs", F.lit(0)) + F.coalesce("own_n", F.lit(0))
    sizes = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.where(n > 0).select(
        "key", "up", "depth", "sizes", F.least("conv_id", "own").alias("conv_id"), n.alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        (F.coalesce("below", F.lit(0)) + (n - 1) * sizes).alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends")
    )


def chain(found: DataFrame) -> DataFrame:
    """The nodes of each row of tops, from its first (which hangs from `up`) to the one where its paths part."""
    rows = found.select("*", F.posexplode_outer("sizes").alias("i", "size"))
    last = F.coalesce(F.col("i") == F.size("sizes") - 1, F.lit(True))
    above = F.aggregate(F.slice("sizes", F.lit(1), F.coalesce("i", F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        F.when(
            F.coalesce("i", F.lit(0)) == 0, F.col("up")
        ).alias("up"), (
            F.col("depth") + F.coalesce("i", F.lit(0))
        ).cast("long").alias("depth"), "conv_id", F.when(F.col("i") > 0, F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved_tokens") - (F.col("n_convs") - 1) * above).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(NONE).alias("ends_sha256"))


def trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of conversations (conv_id, never repeated, and path; see conversations): a row for each node.

    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's; the root has none), n_convs, n_children,
    n_leaves, saved_tokens (of its subtree: each node's members but one, times its last text's length), ends_sha256 (of
    the members that end there). No conversations: no rows, not even a root.

    A task's tries have about `limit` paths. A group over it is split where its paths part, so a long start that all
    share takes one round; a round takes a few small jobs, and there are as many as splits of groups over the limit
    follow one another.
    """
    key = F.sha2(F.array_join(F.transform("path", lambda t: t["digest"]), ""), 256)
    keyed = S.stored(convs.select("conv_id", "path", key.alias("key")), "conversations")
    found = endings(keyed.select("key", "conv_id"))
    paths = S.stored(found.join(keyed.select(F.col("conv_id").alias("least"), "path"), "least").select(F.col("least").alias("conv_id"), "n", "ends", "path"), "paths")

    def next_turn(rows: DataFrame) -> DataFrame:
        """Rows whose top is `depth` turns deep, one turn deeper."""
        rows = rows.where(F.size("path") > F.col("depth")).withColumns({"up": F.col("key"), "depth": F.col("depth") + 1})
        return rows.withColumn("key", F.sha2(F.concat("up", F.element_at("path", F.col("depth"))["digest"]), 256))

    start = paths.withColumns({"key": F.lit(""), "depth": F.lit(0), "up": F.lit(None).cast("string")})
    top = start.sparkSession.createDataFrame([("", None, 0, [])], "key string, up string, depth int, sizes array<long>")
    levels = [(top, start.where(F.size("path") == 0))]
    level, final = next_turn(start), []
    while True:
        large = S.stored(level.groupBy("key").agg(F.count("*").alias("paths")).where(F.col("paths") > limit).select("key"), "large")
        if large.isEmpty():
            break
        final.append(level.join(large, "key", "left_anti"))
        over = level.join(large, "key", "left_semi")
        ends = over.groupBy("key", "up", "depth").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
        split = shared(F.col("lo"), F.col("hi"))
        big = S.stored(ends.select("key", "up", "depth", split.alias("split"), F.transform(F.slice("lo", F.col("depth"), split - F.col("depth") + 1), lambda t: t["size"]).alias("sizes")), "splits")
        below = S.stored(over.drop("depth").join(big.select("key", F.col("split").alias("depth")), "key"), "level")
        levels.append((big.drop("split"), below.where(F.size("path") == F.col("depth"))))
        level = next_turn(below)
    final = reduce(DataFrame.unionByName, [*final, level])

    buckets = max(1, math.ceil(paths.count() / limit))
    tail = F.slice("path", F.col("depth"), F.size("path"))
    given = final.select(
        F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "up", "depth", "conv_id", "n", "ends",
        F.transform(tail, lambda t: t["digest"]).alias("digests"), F.transform(tail, lambda t: t["size"]).alias("sizes")
    )
    nodes = S.stored(given.groupBy("bucket").applyInPandas(grown, "key string, up string, " + NODE), "nodes")

    hung = nodes.where(F.col("up").isNotNull())
    stats = [F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in STATS[1:]), F.count("*").alias("count")]
    below, found = S.stored(hung.groupBy("up").agg(*stats), "below"), []
    for big, ended in reversed(levels):
        rows = S.stored(tops(big, below, ended), "tops")
        below = below.unionByName(rows.where(F.col("up").isNotNull()).select("up", *STATS, F.lit(1).cast("long").alias("count")))
        found.append(rows)
    found = reduce(DataFrame.unionByName, found)
    above = nodes.select("up", *(c.split()[0] for c in NODE.split(", "))).unionByName(chain(found))
    names = found.select(F.col("key").alias("up"), F.col("conv_id").alias("above"))
    whole = above.where(F.col("up").isNull()).withColumn("above", F.lit(None).cast("long")).unionByName(above.where(F.col("up").isNotNull()).join(names, "up", "left"))
    return whole.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of rebuilt conversations, from their turns (conv_id, turn, role, text; others are ignored).

    Turns are put in order with null first; null roles and texts are empty; rows without conv_id go; turns of equal
    number are put in the order of their digests. See rebuilt and trie.
    """
    S.ship(turns.sparkSession)
    convs = S.stored(conversations(turns), "turns")
    return trie(rebuilt(convs), limit)
