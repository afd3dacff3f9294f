"""Connected components of a graph of long integers, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Forest:
    """Union by smallest, of values seen so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _contract(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Replace the links of each part of a partition by links to the smallest member that the part knows: at most one a
    member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def out() -> pa.RecordBatch:
            members = list(forest.parent)
            return S.batch(PAIR, members, [forest.find(x) for x in members])

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                forest.link(x, y)
            if len(forest.parent) > most:
                yield out()
                forest = Forest()
        if forest.parent:
            yield out()

    return df.mapInArrow(run, "a long, b long")


def components(links: DataFrame, stop: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of every node in links (a, b); nodes without links don't occur.

    Each round hangs every node below the smallest node among its neighbours (large star: its larger neighbours too;
    small star: its smaller ones), so chains shrink by half and stars stay. Groups are summed by min, never gathered,
    and joins of hot centres can be split. Rounds are written to the shared folder; it ends when a round changes
    nothing.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Links are told apart before they are contracted: a stage then has one Python step, and one worker for each task.
    pairs = S.stored(_contract(pairs.distinct()).distinct(), "links")
    was = None
    for _ in range(stop):
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.unionAll(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = S.stored(small.unionAll(small_least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).head())
        if now == was or now[0] == 0:
            break
        was = now
    else:
        raise RuntimeError("components didn't settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of rows sorted by key, cut only between keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key)
        last = keys[b.num_rows - 1].as_py()
        cut = int(np.searchsorted(keys.to_numpy(zero_copy_only=False), last, "left"))
        if cut or (held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != last):
            held.append(b.slice(0, cut))
            yield pa.Table.from_batches([h for h in held if h.num_rows] or [b.slice(0, 0)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def bounded_runs(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of rows sorted by key, and whether their keys are whole. Of a key with over `most` rows some at a time come,
    and nothing else with them, so no more are held.
    """
    held: list[pa.RecordBatch] = []
    last, over = None, None  # the key of what is held; one that had too many
    for b in batches:
        keys = b.column(key).to_numpy(zero_copy_only=False)
        if over is not None and len(keys) and keys[0] == over:
            cut = int(np.searchsorted(keys, over, "right"))
            yield pa.Table.from_batches([b.slice(0, cut)]), False
            b, keys = b.slice(cut), keys[cut:]
        if not len(keys):
            continue
        over, cut = None, int(np.searchsorted(keys, keys[-1], "left"))
        if cut or held and last != keys[-1]:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]), True
            held = []
        held.append(b.slice(cut))
        last = keys[-1]
        if sum(h.num_rows for h in held) > most:
            yield pa.Table.from_batches(held), False
            held, over = [], last
    if held:
        yield pa.Table.from_batches(held), True
