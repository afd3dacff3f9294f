"""Benchmark decontamination: documents that hold a passage close to a benchmark item.

Every window of a document as long as an item (in words) is compared by a 64-bit SimHash of its word shingles. Items'
fingerprints are filed by four blocks of 16 bits; a fingerprint within the radius agrees with an item's in some block up
to radius / 4 bits, so looking up all values that close in each block finds every item within the radius. Pairs found
are verified by the exact weighted similarity of their shingle counts: sum of minima over sum of maxima.

A window that is similar enough to an item shares a shingle with it, so only windows that hold a shingle of an item of
their length get a fingerprint: nothing is lost by that, and most documents have none.

Items are held by every task. Their number is checked first; beyond ITEMS_AT_ONCE they are taken in blocks, one pass
over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared as S

ITEMS_AT_ONCE, BYTES_AT_ONCE = 50_000, 32_000_000  # of items that a task holds
RADIUS = 20
BLOCKS = 4
HIT = pa.schema([("doc_id", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("similarity", pa.float64()), ("n_words", pa.int64())])


def lowered(text: str | None) -> np.ndarray:
    """Hashes of a text's words in lower case (A-Z)."""
    return S.hashed_words(text, lower=True)[0]


def signs(h: np.ndarray) -> np.ndarray:
    """The bits of hashes as +1 and -1."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def masks(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most so many set."""
    every = np.arange(1 << bits, dtype=np.uint32)
    return every[np.bitwise_count(every) <= most]


def weighted(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of two multisets' counts."""
    u, ca = np.unique(a, return_counts=True)
    v, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    shared = np.minimum(ca[i], cb[j]).sum()
    return float(shared / (len(a) + len(b) - shared))


class Items:
    """Items of one shingle size: their shingles, lengths, fingerprints and the blocks these are filed under."""

    def __init__(self, ids: list[int], words: list[np.ndarray], size: int, radius: int):
        self.ids, self.size, self.radius = ids, size, radius
        self.length = np.array([len(w) for w in words])
        self.shingles = [S.windows(w, size) for w in words]
        every = np.concatenate(self.shingles)
        order = np.argsort(every, kind="stable")
        self.known, first = np.unique(every[order], return_index=True)
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in self.shingles])[order]
        # The lengths of the items that have a shingle.
        self.lengths_of = [np.unique(self.length[o]) for o in np.split(owner, first[1:])]
        self.prints = np.array([packed(signs(s).sum(0)[None])[0] for s in self.shingles])
        self.near = masks(16, radius // BLOCKS).astype(np.int64)
        self.filed = []
        for k in range(BLOCKS):
            value = (self.prints >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            known, first = np.unique(value[order], return_index=True)
            self.filed.append((order, known, np.append(first, len(order))))

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs whose fingerprints are within the radius.

        In each block the filed values close to the window's are found by trying all close values, or by going through
        the filed ones where those are fewer.
        """
        pairs = []
        for k, (order, known, start) in enumerate(self.filed):
            block = (prints >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64)
            for i in range(0, len(prints), 64):
                if len(known) <= len(self.near):
                    w, slot = np.nonzero(np.bitwise_count(block[i : i + 64, None] ^ known[None]) <= self.radius // BLOCKS)
                else:
                    value = block[i : i + 64, None] ^ self.near[None]
                    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                    w, hit = np.nonzero(known[at] == value)
                    slot = at[w, hit]
                counts = start[slot + 1] - start[slot]
                item = order[np.repeat(start[slot], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
                pairs.append(np.stack([np.repeat(w, counts) + i, item]))
        found = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), int)
        ok = np.bitwise_count(prints[found[0]] ^ self.prints[found[1]]) <= self.radius
        return found[0][ok], found[1][ok]

    def matches(self, h: np.ndarray, least: float) -> dict[int, tuple[float, int]]:
        """Item number to (similarity, first word) of its best window in a text's word hashes."""
        n = len(h)
        g = S.windows(h, self.size)
        if not len(g):
            return {}
        slot = np.searchsorted(self.known, g)
        hit = np.flatnonzero(self.known[np.minimum(slot, len(self.known) - 1)] == g)
        if not len(hit):
            return {}
        starts: dict[int, list[np.ndarray]] = {}
        for p in hit.tolist():
            for length in self.lengths_of[slot[p]].tolist():
                # Windows of this length that hold the shingle; a shorter text is one window.
                starts.setdefault(length, []).append(np.arange(max(0, p + self.size - length), min(p, max(0, n - length)) + 1) if length < n else np.zeros(1, int))
        out: dict[int, tuple[float, int]] = {}
        for length, parts in starts.items():
            at = np.unique(np.concatenate(parts))
            m = min(length, n) - self.size + 1  # shingles in a window
            for i in range(0, len(at), 8192):
                a = at[i : i + 8192]
                low = int(a[0])
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(g[low : a[-1] + m]), axis=0, dtype=np.int32)])
                w, item = self.lookup(packed(sums[a - low + m] - sums[a - low]))
                right = self.length[item] == length
                for x, t in zip(a[w[right]].tolist(), item[right].tolist()):
                    s = weighted(g[x : x + m], self.shingles[t])
                    if s >= least and s > out.get(t, (0.0, 0))[0]:
                        out[t] = s, x
        return out


def prepared(benchmark: DataFrame, size: int, radius: int) -> Iterator[list[Items]]:
    """The items (item_id, text), by blocks that a task may hold, in number and in bytes. Items without an id or words
    match nothing; ones of fewer words than a shingle are one shingle; rows that repeat an id are items of that id.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    n, size_ = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    blocks = max(-(-n // ITEMS_AT_ONCE), -(-size_ // BYTES_AT_ONCE)) if n else 0
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect() if blocks > 1 else rows.collect()
        by: dict[int, tuple[list, list]] = {}
        for r in sorted(part, key=lambda r: (r.item_id, r.text)):
            if len(w := lowered(r.text)):
                ids, words = by.setdefault(min(size, len(w)), ([], []))
                ids.append(r.item_id)
                words.append(w)
        yield [Items(ids, words, k, radius) for k, (ids, words) in sorted(by.items())]


def searched(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_ids (ascending, of the items it holds a passage close to), similarity (largest, or null), n_words of
    each document (doc_id, text). A null text has no words. One row comes out for each row; nothing is shuffled: where
    items come in several blocks, the same rows go through one after the other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_ids array<long>, similarity double, n_words long"

    def scan(docs: DataFrame, blocks: list[Items], last: bool) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            texts, n = b.column("text").to_pylist(), b.num_rows
            before = zip(b.column("item_ids").to_pylist(), b.column("similarity").to_pylist()) if "item_ids" in b.schema.names else zip([[]] * n, [None] * n)
            for k, (ids, most), h in zip(b.column("doc_id").to_pylist(), before, (x[0] for x in S.hashed_texts(texts, lower=True))):
                found = {items.ids[i]: s for items in held.value for i, (s, _) in items.matches(h, least).items()}
                rows.append((k, sorted({*ids, *found}), max([*found.values(), *([] if most is None else [most])], default=None), len(h)))
            if rows:
                out = S.batch(HIT, *zip(*rows))
                yield out if last else out.append_column("text", pa.array(texts, pa.string()))

        return S.map_arrow(docs, run, schema if last else schema + ", text string")

    parts = list(prepared(benchmark, size, radius)) or [[]]
    for i, blocks in enumerate(parts):
        docs = scan(docs, blocks, i == len(parts) - 1)
    return docs


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The documents that hold no passage close to an item; columns as they come. Null and empty texts stay, each row is
    judged by itself, and all stay if there are no items.
    """
    schema = docs.schema
    parts = list(prepared(benchmark, size, radius))
    for blocks in parts:
        held = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(b: pa.RecordBatch, held=held) -> Iterator[pa.RecordBatch]:
            clean = [not any(items.matches(h, least) for items in held.value) for h, _ in S.hashed_texts(b.column("text").to_pylist(), lower=True)]
            yield b.filter(pa.array(clean, pa.bool_()))

        docs = S.map_arrow(docs, run, T.StructType(schema.fields))
    return docs


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (comma-joined, ascending), similarity (rounded to 6 places; 0 if clean)
    of each document, a row for each row; a null text is clean, and so are all if there are no items.
    """
    out = searched(docs, benchmark)
    return out.select(
        "doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"),
        F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",").alias("item_ids"),
        F.coalesce(F.round("similarity", 6), F.lit(0.0)).alias("similarity")
    )
