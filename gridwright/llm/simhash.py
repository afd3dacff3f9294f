"""SimHash fingerprints of documents and their near-duplicate groups, candidates filtered by pigeonring chains.

The 64 bits stand on a ring of five segments. If two fingerprints differ in at most t bits, some segment starts a chain
whose first l segments differ together in at most l * t / 5 bits, for every l (the pigeonring principle). For t = 4 that
is 0, 1, 2, 3, 4: the first segment is equal, the second differs in at most one bit. So each fingerprint is filed once
for every bit of a second segment, under both segments with that bit cleared: 64 keys of about 25 bits, and any two that
begin such a chain meet. Where they meet the chain is followed to its third and fourth segment before the full distance
is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from . import graph

SEGMENTS = (13, 13, 13, 13, 12)
STARTS = tuple(sum(SEGMENTS[:i]) for i in range(5))
CROWD, BLOCK = 4096, 2048  # fingerprints of a key that one task compares, and of a block of more
MEETING = pa.schema([(c, pa.int64()) for c in ("a", "b", "key", "fp", "id")])
MARKED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of so many words, lower-cased in A-Z and joined by a space; of all words, if there are fewer.
    """
    ws = words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(ws) - size + 1)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:k].tolist(), ends[-k:].tolist())), np.uint64, k)


def fingerprint(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero if there are none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = np.ascontiguousarray(h[i : i + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed integer) of each document."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield S.batch(MARKED, b.column("doc_id"), [fingerprint(shingle_hashes(t.as_py(), size)) for t in b.column("text")])

    return S.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _chain(fp: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The ring turned so that segment i stands in the lowest bits, the next above it."""
    turn = np.array(STARTS, np.uint64)[i]
    return np.where(turn == 0, fp, (fp >> turn) | (fp << (np.uint64(64) - np.where(turn == 0, np.uint64(1), turn))))


def ring_keys(fp: Column) -> Column:
    """The 64 keys of a fingerprint: the chain and the cleared bit above the two segments."""
    out = []
    for i in range(5):
        first, second, turn = SEGMENTS[i], SEGMENTS[(i + 1) % 5], STARTS[i]
        turned = fp if turn == 0 else F.shiftrightunsigned(fp, turn).bitwiseOR(F.shiftleft(fp, 64 - turn))
        low = turned.bitwiseAND(F.lit((1 << first + second) - 1))
        for bit in range(second):
            out.append(low.bitwiseAND(F.lit(~(1 << first + bit))) + F.lit((i << 4 | bit) << 26))
    return F.array(*out)


def chained(a: np.ndarray, b: np.ndarray, key: np.ndarray, most: int = 4) -> np.ndarray:
    """Which pairs keep within the budgets of the chain that their key begins, and then within the full distance."""
    chain, bit = (key >> 30).astype(np.int64), (key >> 26) & 15
    diff = _chain(a ^ b, chain)
    ok = np.ones(len(a), bool)
    reach = np.zeros(len(a), np.int64)
    widths = np.array(SEGMENTS)
    for length in range(1, 5):
        reach += widths[(chain + length - 1) % 5]
        ok &= np.bitwise_count(diff & ((np.uint64(1) << reach.astype(np.uint64)) - np.uint64(1))) <= length * most // 5
        if length == 2:  # equal in the second segment: they meet at each of its bits and count at the first
            second = (diff >> widths[chain].astype(np.uint64)) & ((np.uint64(1) << widths[(chain + 1) % 5].astype(np.uint64)) - np.uint64(1))
            ok &= (second != 0) | (bit == 0)
    return ok & (np.bitwise_count(diff) <= most)


def links_of(table: pa.Table, most: int = 4, small: int = 8, by: str = "key") -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows (key, fp, id) of each value of `by`, of those pairs that pass the chain that the key begins
    and then the full distance: all of small groups, a spanning forest of larger ones. No group makes more links than it
    has members, but for a few in small ones.
    """
    group = table.column(by).to_numpy()
    key, fp, ids = (table.column(c).to_numpy() for c in ("key", "fp", "id"))
    fp = fp.view(np.uint64)
    starts = graph.runs(group)
    sizes = np.diff(starts)
    a, b = [], []
    for off in range(1, small):
        if not (sizes > off).any():
            break
        at = np.flatnonzero(group[off:] == group[:-off])
        at = at[np.repeat(sizes, sizes)[at] <= small]
        at = at[chained(fp[at], fp[at + off], key[at], most)]
        a.append(ids[at])
        b.append(ids[at + off])
    for s in np.flatnonzero(sizes > small).tolist():
        span = slice(int(starts[s]), int(starts[s + 1]))
        g, gid, same = fp[span], ids[span], key[span]
        label = np.arange(len(g))
        for i in range(len(g) - 1):
            near = np.flatnonzero(chained(g[i + 1 :], g[i], same[i + 1 :], most)) + i + 1
            others = label[near] != label[i]
            if others.any():
                near = near[others]
                _, first = np.unique(label[near], return_index=True)
                a.append(np.full(len(first), gid[i]))
                b.append(gid[near[first]])
                label[np.isin(label, label[near])] = label[i]
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))


def hamming_links(fps: DataFrame, most: int = 4) -> DataFrame:
    """Links (a, b) that join all ids of fps (fp, id), one row for each different fp, that a chain of fingerprints at
    distances of at most 4 joins; a table.

    A key's fingerprints are compared by one task, if they are CROWD or fewer. More are cut into blocks by their ids, and
    each two blocks meet in a group of their own.
    """
    if not 0 <= most <= 4:
        raise ValueError("the segments hold for distances of at most 4")
    rows = fps.select(F.explode(ring_keys(F.col("fp"))).alias("key"), "fp", "id").repartition("key").sortWithinPartitions("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, whole in graph.bounded_runs(batches, "key", CROWD):
            if whole:
                a, b = links_of(t, most)
                if len(a):
                    yield S.batch(MEETING, a, b, *[pa.nulls(len(a), pa.int64())] * 3)
            else:
                none = pa.nulls(t.num_rows, pa.int64())
                yield S.batch(MEETING, none, none, *(t.column(c).combine_chunks() for c in ("key", "fp", "id")))

    met = S.stored(rows.mapInArrow(meet, "a long, b long, key long, fp long, id long"), "met")
    links, over = met.where("a is not null").select("a", "b"), met.where("a is null").select("key", "fp", "id")
    if over.isEmpty():
        return links
    blocks = over.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    over = over.join(blocks.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    over = over.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    over = over.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "key", "fp", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in graph.whole_runs(batches, "group"):
            a, b = links_of(t, most, by="group")
            if len(a):
                yield S.batch(graph.PAIR, a, b)

    more = over.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long")
    return links.unionByName(S.stored(more, "links"))


def grouped(docs: DataFrame, size: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each document (doc_id, text).

    Fingerprints link at `most` or fewer differing bits; component_id is the smallest doc_id reachable, the document's
    own included. Documents without words (null, empty or white space) have fingerprint zero and link like any others.
    Equal fingerprints are one node, so copies make no pairs. A row comes out for each row, repeated doc_ids included; a
    null doc_id gets its group's id, or null if the whole group has none.
    """
    marked = S.stored(fingerprints(docs, size), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).select("fp", F.col("fp").alias("id"), "doc_id")
    nodes = S.stored(nodes, "nodes")
    parts = graph.components(hamming_links(nodes.select("fp", "id"), most))
    labelled = nodes.join(parts, F.col("id") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("component", "id").alias("component"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = S.stored(labelled.join(least, "component").select("fp", "component_id"), "labels")
    return marked.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = 4, most: int = 4) -> DataFrame:
    """The documents, one of each group: the one with the smallest doc_id. All rows with that id stay, and so do rows
    whose doc_id is null.
    """
    keep = grouped(docs, size, most).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(keep, docs["doc_id"] == keep["kept_id"], "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
