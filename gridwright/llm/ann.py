"""Nearest neighbours by inner product: an inverted file of coarse centroids whose vectors are kept as they are.

Every different vector is filed in the list of its nearest centroid. A query looks into the lists whose centroids
promise most; how far it goes, is measured: the true neighbours of PILOT queries are found among all vectors, by the very
rule of the result (copies one by one, ties to smaller ids), and queries go as far as holds a share RECALL of those, and
a share LEAST for all but a share FEW of the queries, so no kind of query pays for the others. How far is a number of
lists, or a distance from the list that promises most, whichever costs less. So where near neighbours lie anywhere, all
lists are looked into, and where they lie together, few are.

Vectors are compared with those of their length: lists hold one length, and each length that many vectors have has
centroids and pilot queries of its own.

In a list nothing is lost: float32 products of scaled vectors, which have a known error, tell which vectors may be among
a query's best, and those are scored with the original vectors in double precision.

Equal vectors are one entry with its smallest ids, as many as a result can show, so a vector that many rows share makes
no long list and ties come out by id. Centroids are learned from some SAMPLE vectors, those whose hashes are lowest;
every vector is filed. Queries and filed vectors meet in blocks, as a product of partitions that reads the filed table
for each part of the queries: what is shuffled and stored grows with the table, not with the lists that are looked into.
"""

from __future__ import annotations

import collections
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared as S

SAMPLE = 20_000
PILOT = 512
RECALL = 0.95
LEAST = 0.8
FEW = 0.01
ONE_LIST = 2000  # up to so many different vectors of a length, there is one list
TOLD = 100  # fewer pilot queries than this don't stand for others
BLOCK = 8192  # filed vectors, and queries, in a row of the product
PARTS = 12  # of the filed table: each gives its best for a query
CELLS = 1 << 19  # products that are held at once
BYTES = 4 << 20  # of vectors in a row
VECTOR = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("vec", pa.binary()), ("dim", pa.int32())])
FILED = pa.schema([("lists", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("entries", pa.binary()), ("vecs", pa.binary())])
ASKED = pa.schema([("block", pa.binary()), ("asked", pa.list_(pa.int32())), ("keys", pa.binary()), ("queries", pa.binary())])
FOUND = pa.schema([("block", pa.binary()), ("keys", pa.binary()), ("entries", pa.binary()), ("scores", pa.binary())])
BEST = pa.schema([("key", pa.binary()), ("entries", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
SPOTS = pa.schema([("dim", pa.int32()), ("query", pa.int32()), ("own", pa.int64()), ("entry", pa.int64()), ("list", pa.int32()), ("score", pa.float64())])
KEY = 16  # bytes of a vector's hash
NONE = np.iinfo(np.int64).max  # an entry that isn't there
MOST = np.finfo(np.float64).max


def kind_of(vectors: DataFrame) -> str:
    """How components are kept: those of float columns as they are, others as doubles."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, key (128 bits of hash), vec (its components as bytes), dim of the vectors that take part: not null, not
    zero, only finite components, a vec_id.
    """
    kind = kind_of(vectors)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = b.column("vec")
        flat, ends = column.values, column.offsets.to_numpy()
        bad = np.zeros(len(flat) + 1, np.int64)
        x = (flat.fill_null(0) if flat.null_count else flat).to_numpy(zero_copy_only=False).astype(kind) + 0.0  # no -0.0
        wrong = ~np.isfinite(x)
        if flat.null_count:
            wrong |= flat.is_null().to_numpy(zero_copy_only=False)
        np.cumsum(wrong, out=bad[1:])
        some = np.concatenate([[0], np.cumsum(x != 0)])
        a, e = ends[:-1], ends[1:]
        good = (bad[e] == bad[a]) & (some[e] > some[a])
        for c in (column, b.column("vec_id")):
            good &= c.is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(good)
        if len(rows):
            raw, w = x.astype(kind, copy=False).tobytes(), np.dtype(kind).itemsize
            vecs = [raw[i * w : j * w] for i, j in zip(a[rows].tolist(), e[rows].tolist())]
            ids = b.column("vec_id").take(pa.array(rows))
            yield S.batch(VECTOR, ids, [xxhash.xxh3_128_digest(v) for v in vecs], vecs, (e - a)[rows].astype(np.int32))

    return S.map_arrow(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")), run, "vec_id long, key binary, vec binary, dim int")


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of about unit length in double precision, and the powers of two that they were divided by."""
    x = x.astype(np.float64)
    power = np.exp2(np.frexp(np.abs(x).max(1))[1].astype(np.float64).clip(-1000, 1000))
    x = x / power[:, None]
    more = np.exp2(np.frexp(np.sqrt((x**2).sum(1)))[1].astype(np.float64))
    return x / more[:, None], power * more


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres**2).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (x[i : i + 4096] @ centres.T - half).argmax(1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from different rows; a centre that loses all its rows starts again at a row."""
    x = np.unique(x, axis=0) if len(x) < 4 * k else x
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


class Index:
    """Coarse centroids of vectors of one length, the spread and the sample's share of their lists, and how a query
    chooses lists: by the product with the centroid and so many spreads, the first ones or those not far from the first.
    """

    def __init__(self, coarse: np.ndarray, spread: np.ndarray, share: np.ndarray, unit: float):
        self.coarse, self.spread, self.share, self.unit = coarse, spread, share, unit
        self.first = 0  # the number of its first list
        self.spreads, self.by_gap, self.far = 0.0, False, np.inf

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, seed: int = 5) -> Index:
        unit = float(np.abs(x).max())
        x = (x.astype(np.float64) / unit).astype(np.float32)
        coarse = kmeans(x, lists, 8, np.random.default_rng(seed))
        own = nearest(x, coarse)
        rest, count = ((x - coarse[own]) ** 2).mean(1), np.bincount(own, minlength=len(coarse))
        return cls(coarse, np.sqrt(np.bincount(own, rest, len(coarse)) / np.maximum(count, 1)).astype(np.float32), count / len(x), unit)

    def own(self, x: np.ndarray) -> np.ndarray:
        big = 1e15  # beyond the sample's largest component; keeps squares finite
        return self.first + nearest((x.astype(np.float64) / self.unit).clip(-big, big).astype(np.float32), self.coarse)

    def need(self, q: np.ndarray, spreads: float, by_gap: bool) -> np.ndarray:
        """How far queries (rows) must go to look into lists (columns)."""
        q = scaled(q)[0].astype(np.float32)
        s = q @ self.coarse.T + spreads * np.sqrt((q**2).sum(1))[:, None] * self.spread
        return s.max(1)[:, None] - s if by_gap else (-s).argsort(1).argsort(1)

    def probes(self, q: np.ndarray) -> np.ndarray:
        """Which lists (columns) queries (rows) look into."""
        out = np.ones((len(q), len(self.coarse)), bool)
        if self.far < np.inf:
            for i in range(0, len(q), 1024):
                out[i : i + 1024] = self.need(q[i : i + 1024], self.spreads, self.by_gap) <= self.far
        return out

    def settle(self, q: np.ndarray, groups: list[np.ndarray], query: np.ndarray, which: np.ndarray) -> None:
        """Set how queries choose, from pilot queries (rows of q) and the lists that hold their true neighbours. What is
        asked of the recall holds in each group (numbers of pilot queries, any number of times).
        """
        order = np.argsort(query, kind="stable")
        query, which = query[order], which[order] - self.first
        met, starts, counts = np.unique(query, return_index=True, return_counts=True)
        best = float(self.share.sum())
        for spreads in (0.0, 2.0, 4.0):
            for by_gap in (False, True):
                need = self.need(q, spreads, by_gap)
                pairs, far = np.split(need[query, which], starts[1:]), 0.0
                # What each query needs for a share LEAST of its own.
                own = np.array([np.sort(p)[int(np.ceil(LEAST * n)) - 1] for p, n in zip(pairs, counts)])
                for group in groups:
                    times = np.bincount(group, minlength=len(q))[met]
                    if times.any():
                        all_ = np.quantile(np.concatenate([np.tile(p, t) for p, t in zip(pairs, times)]), RECALL, method="higher")
                        far = max(far, float(all_), float(np.quantile(np.repeat(own, times), 1 - FEW, method="higher")))
                cost = float(((need <= far) @ self.share).mean())
                if cost < best:
                    best, self.spreads, self.by_gap, self.far = cost, spreads, by_gap, far


def own_lists(held: dict[int, Index], raw: list, kind: str) -> np.ndarray:
    """The list of each vector (its bytes): of lengths without an index, the length below zero."""
    dims = np.array([len(v) for v in raw]) // np.dtype(kind).itemsize
    out = -dims
    for dim in np.unique(dims).tolist():
        if dim in held:
            rows = np.flatnonzero(dims == dim)
            out[rows] = held[dim].own(np.frombuffer(b"".join(raw[i] for i in rows.tolist()), kind).reshape(-1, dim))
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :keep]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision. Where sums on the way overflow they are taken of scaled rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        x = x.astype(np.float64)
        out = np.einsum("ij,ij->i", q, x)
        bad = np.flatnonzero(~np.isfinite(out))
        if len(bad):
            (a, p), (b, r) = scaled(q[bad]), scaled(x[bad])
            out[bad] = np.ldexp(np.einsum("ij,ij->i", a, b), np.frexp(p)[1] + np.frexp(r)[1] - 2)
    return out


class Room:
    """Room for the products of one part of a list at a time."""

    def __init__(self):
        self.products, self.hits = np.empty(CELLS, np.float32), np.zeros(CELLS + 8, bool)


class Asking:
    """A block of queries and the best that each has met. Without an index they look into everything."""

    def __init__(self, index: Index | None, keep: int, keys: bytes, q: np.ndarray, room: Room):
        self.keep, self.keys, self.q, self.room = keep, keys, q.astype(np.float64), room
        unit, self.size = scaled(q)
        self.unit = unit.astype(np.float32)
        self.first, self.probes = (index.first, index.probes(q).T.copy()) if index else (0, None)
        self.ids, self.scores = np.full((len(q), keep), NONE), np.full((len(q), keep), -np.inf)
        self.least = np.full(len(q), -np.inf)  # the last of each row of scores, over the query's size
        # Rows are shorter than 1: products differ from the true ones by less than this, rounding of both included.
        self.error = (q.shape[1] + 8) * 2.0**-23
        self.lost = q.shape[1] * 2.0**-1074  # what scores lose where they underflow
        self.new, self.waiting = [], 0  # rows, entries, scores that aren't merged yet

    def meet(self, which: int, entries: np.ndarray, x: np.ndarray, unit: np.ndarray, size: float) -> None:
        """Look into a part of a list: its vectors x, and the same divided by `size`, none longer than 1."""
        rows = np.flatnonzero(self.probes[which - self.first]) if self.probes is not None else np.arange(len(self.q))
        step = max(1, CELLS // len(entries))
        for i in range(0, len(rows), step):
            self._some(rows[i : i + step], entries, x, unit, size)

    def _some(self, rows: np.ndarray, entries: np.ndarray, x: np.ndarray, unit: np.ndarray, size: float) -> None:
        n, keep, cells = len(entries), self.keep, len(rows) * len(entries)
        s = np.matmul(self.unit[rows], unit.T, out=self.room.products[:cells].reshape(len(rows), n))
        with np.errstate(over="ignore", invalid="ignore"):
            least = self.least[rows] / size - 2 * self.error
        fresh = np.flatnonzero(np.isneginf(least))
        if len(fresh) and n > keep:
            # Scores that overflow are equal, and so are ones that underflow.
            with np.errstate(over="ignore"):
                cap, lost = (x / self.size[rows[fresh]] / size for x in (MOST, self.lost))
            least[fresh] = np.minimum(np.partition(s[fresh], n - keep, axis=1)[:, n - keep], cap) - lost - 4 * self.error
        np.greater_equal(s, np.nan_to_num(least, nan=-np.inf, posinf=np.inf, neginf=-np.inf).astype(np.float32)[:, None], out=self.room.hits[:cells].reshape(s.shape))
        words = -(-cells // 8)
        self.room.hits[cells : words * 8] = False
        flat = self.room.hits[: words * 8].reshape(-1, 8)  # eight at a time
        word = np.flatnonzero(flat.view(np.uint64).ravel())
        if not len(word):
            return
        a, b = np.nonzero(flat[word])
        row, col = np.divmod(word[a] * 8 + b, n)
        row = rows[row]
        score = np.empty(len(row))
        for i in range(0, len(row), 8192):
            score[i : i + 8192] = products(self.q[row[i : i + 8192]], x[col[i : i + 8192]])
        better = score >= self.scores[row, -1]
        self.new.append((row[better], entries[col[better]], score[better]))
        self.waiting += len(self.new[-1][0])
        if self.waiting > max(8 * len(self.q), 1 << 12):
            self.settle()

    def settle(self) -> None:
        """Merge what waits."""
        if not self.waiting:
            return
        row, ids, score = (np.concatenate(x) for x in zip(*self.new))
        self.new, self.waiting = [], 0
        order = np.argsort(row, kind="stable")
        if len(row) and np.bincount(row).max() > 4 * self.keep:
            order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        counts = np.diff(first, append=len(row))
        met, most = row[first], int(min(4 * self.keep, counts.max()))
        place = np.arange(len(row)) - np.repeat(first, counts)
        held = place < most  # all, or the best come first
        more, worth = np.full((len(met), most), NONE), np.full((len(met), most), -np.inf)
        at = np.repeat(np.arange(len(met)), counts)[held], place[held]
        more[at], worth[at] = ids[held], score[held]
        self.ids[met], self.scores[met] = best_of(np.concatenate([self.ids[met], more], 1), np.concatenate([self.scores[met], worth], 1), self.keep)
        with np.errstate(over="ignore", invalid="ignore"):
            self.least[met] = (np.minimum(self.scores[met, -1], MOST) - self.lost) / self.size[met]


def parts_of(b: pa.RecordBatch, kind: str) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """Of each row of filed vectors: its number, [(list, from, to)], entries, vectors."""
    for i in range(b.num_rows):
        lists, sizes = b.column("lists")[i].values.to_pylist(), b.column("sizes")[i].values.to_pylist()
        ends = np.cumsum(sizes).tolist()
        entries = np.frombuffer(b.column("entries")[i].as_buffer(), "<i8")
        x = np.frombuffer(b.column("vecs")[i].as_buffer(), kind).reshape(len(entries), -1)
        yield i, [(g, e - n, e) for g, n, e in zip(lists, sizes, ends)], entries, x


def scaled_part(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors in single precision, divided by a power of two so that none is longer than 1, and that power."""
    unit, size = scaled(x)
    whole = size.max()
    return (unit * (size / whole)[:, None]).astype(np.float32), whole


def blocks(vecs: list, end: bool) -> list[tuple[int, int]]:
    """Ranges of vectors (bytes, by length) that make rows of the product: each of one length, bounded in number and
    bytes. The last one waits for more vectors, unless this is the end.
    """
    out, start = [], 0
    for i in range(1, len(vecs) + 1):
        size = len(vecs[start])
        if i == len(vecs) or len(vecs[i]) != size or i - start >= max(1, min(BLOCK, BYTES // size)):
            if i < len(vecs) or end:
                out.append((start, i))
            start = i if i < len(vecs) else start
    return out


def packed(df: DataFrame, columns: tuple[str, ...], pack: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """Rows that come by length of their vectors (the last of the columns), packed by `blocks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[] for _ in columns]

        def out(end: bool) -> Iterator[pa.RecordBatch]:
            done = 0
            for a, e in blocks(held[-1], end):
                yield pack(*(x[a:e] for x in held))
                done = e
            for x in held:
                del x[:done]

        for b in batches:
            for c, x in zip(columns, held):
                x += b.column(c).to_pylist()
            yield from out(False)
        yield from out(True)

    return df.mapInArrow(run, schema)


def filed_blocks(df: DataFrame) -> DataFrame:
    """Rows (list, entry, vec) that come by list, packed."""

    def pack(lists: list, entries: list, vecs: list) -> pa.RecordBatch:
        x = np.array(lists)
        starts = np.flatnonzero(np.diff(x, prepend=x[0] - 1))
        return S.batch(FILED, [x[starts].tolist()], [np.diff(starts, append=len(x)).tolist()], [np.array(entries, "<i8").tobytes()], [b"".join(vecs)])

    return packed(df, ("list", "entry", "vec"), pack, "lists array<int>, sizes array<int>, entries binary, vecs binary")


def spots(filed: DataFrame, copies: DataFrame, pilots: dict[int, tuple[np.ndarray, np.ndarray]], top: int, kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For a few queries of each length (ids, vectors) the lists of their true neighbours, among all that is filed:
    numbers of queries, lists.
    """
    held = filed.sparkSession.sparkContext.broadcast(pilots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, open_, where = Room(), {}, {}
        for b in batches:
            for _, parts, entries, x in parts_of(b, kind):
                dim = x.shape[1]
                if dim not in held.value:
                    continue
                if dim not in open_:
                    open_[dim], where[dim] = Asking(None, top + 1, b"", held.value[dim][1], room), {}
                asking, lists = open_[dim], np.repeat([g for g, _, _ in parts], [e - a for _, a, e in parts])
                asking.meet(0, entries, x, *scaled_part(x))
                asking.settle()
                now = np.isin(entries, asking.ids)
                where[dim].update(zip(entries[now].tolist(), lists[now].tolist()))
        for dim, asking in open_.items():
            query, place = np.nonzero(asking.ids != NONE)
            ids = asking.ids[query, place]
            lists = np.array([where[dim][i] for i in ids.tolist()], np.int32)
            yield S.batch(SPOTS, np.full(len(query), dim, np.int32), query.astype(np.int32), held.value[dim][0][query], ids, lists, asking.scores[query, place])

    def first(df: DataFrame, n: int, by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("dim", "query").orderBy(F.desc("score"), by))
        return df.withColumn("place", place).where(F.col("place") <= n).drop("place")

    near = first(filed.mapInArrow(run, "dim int, query int, own long, entry long, list int, score double"), top + 1, "entry")
    near = S.stored(near, "spots")
    some = copies.join(F.broadcast(near.select("entry").distinct()), "entry", "left_semi")
    ids = F.explode(F.coalesce("ids", F.array("entry"))).alias("vec_id")
    near = near.join(some, "entry", "left").select("dim", "query", "own", "list", "score", ids).where(F.col("vec_id") != F.col("own"))
    rows = first(near, top, "vec_id").select("dim", "query", "list").collect()
    out = {}
    for dim in pilots:
        mine = [(r["query"], r["list"]) for r in rows if r["dim"] == dim]
        out[dim] = tuple(np.array(mine, np.int64).reshape(-1, 2).T)
    return out


def merged(df: DataFrame, keep: int) -> DataFrame:
    """The best of each query from what the parts of the filed table gave: key, entries, scores."""

    def out(keys: bytes, ids: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(ids), 2000):
            some = ids[i : i + 2000] != NONE
            names = [keys[k * KEY : (k + 1) * KEY] for k in range(i, min(len(ids), i + 2000))]
            yield S.batch(BEST, names, [x[m] for x, m in zip(ids[i : i + 2000], some)], [x[m] for x, m in zip(scores[i : i + 2000], some)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = keys = ids = scores = None
        for b in batches:
            for name, names, i, s in zip(*(b.column(c) for c in ("block", "keys", "entries", "scores"))):
                more, worth = np.frombuffer(i.as_buffer(), "<i8").reshape(-1, keep), np.frombuffer(s.as_buffer(), "<f8").reshape(-1, keep)
                if name.as_py() != block:
                    if block is not None:
                        yield from out(keys, ids, scores)
                    block, keys, ids, scores = name.as_py(), names.as_py(), more, worth
                else:
                    ids, scores = best_of(np.concatenate([ids, more], 1), np.concatenate([scores, worth], 1), keep)
        if block is not None:
            yield from out(keys, ids, scores)

    return df.repartition("block").sortWithinPartitions("block").mapInArrow(run, "key binary, entries array<long>, scores array<double>")


def search(vectors: DataFrame, every: int = 20, top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` its `top` nearest other rows by inner
    product, ties to the smaller id.

    `vectors` has vec_id and embedding. Vectors that are null, zero, or hold null or non-finite components take no part;
    the neighbours of a vector are of its length. With few vectors of a length there is one list and all of them are
    looked at. Rows that repeat a vec_id count one by one; none is a neighbour of its own id.
    """
    spark, keep = vectors.sparkSession, top + 1
    kind = kind_of(vectors)
    rows = usable(vectors)
    size = np.dtype(kind).itemsize

    def lowest(df: DataFrame, share: float, most: int, *by: str) -> list:
        """About a share of the rows, those whose hashes are lowest."""
        low = df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
        return low.orderBy(F.xxhash64(*by), *by).limit(most).collect()

    # Lengths that many vectors have get lists by centroids; each of the others is one list.
    different = F.approx_count_distinct("key", 0.02).alias("different")
    lengths = {r["dim"]: r["different"] for r in rows.groupBy("dim").agg(different).where(F.col("different") > ONE_LIST).collect()}
    indexes, lists = {}, 0
    if lengths:
        common = rows.where(F.col("dim").isin(list(lengths))).groupBy("key").agg(F.first("vec").alias("vec"))
        sample = collections.defaultdict(list)
        for r in lowest(common, SAMPLE / sum(lengths.values()), SAMPLE * 5 // 4, "key"):
            sample[len(r["vec"]) // size].append(r["vec"])
        for dim, vecs in sorted(sample.items()):
            count = min(1024, int(lengths[dim] ** 0.5), len(vecs) // 8)
            if count > 1:
                indexes[dim] = Index.fit(np.frombuffer(b"".join(vecs), kind).reshape(-1, dim), count)
                indexes[dim].first, lists = lists, lists + len(indexes[dim].coarse)
    held = spark.sparkContext.broadcast(indexes)

    def own(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if b.num_rows:
            numbers = own_lists(held.value, b.column("vec").to_pylist(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *b.columns], names=["list", *b.schema.names])

    # Equal vectors: one entry, named by its smallest id. Tasks put theirs together before they are dealt, and lists are
    # dealt in four, so one that holds much of the table is not one task's.
    entries = rows.groupBy("key").agg(F.min("vec_id").alias("entry"), F.first("vec").alias("vec")).select("entry", "vec")
    coded = S.map_arrow(entries, own, "list int, entry long, vec binary").withColumn("salt", F.pmod(F.xxhash64("entry"), F.lit(4)))
    deals = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = coded.repartition(deals, "list", "salt").sortWithinPartitions("list", "salt").drop("salt")
    filed = S.stored(filed_blocks(dealt), "filed")
    filed = filed.coalesce(min(PARTS, max(1, filed.rdd.getNumPartitions())))

    # The smallest ids of a vector that more rows share, one more than a result shows: a query may be among them.
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    copies = rows.select("key", "vec_id").withColumn("place", place).where(F.col("place") <= keep).groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    copies = S.stored(copies.where(F.size("ids") > 1).select(F.col("ids")[0].alias("entry"), "ids"), "copies")

    queries = usable(vectors.where(F.col("vec_id").cast("long") % every == 0))
    queries = S.stored(queries.select(F.col("vec_id").alias("query_id"), "key", "vec"), "queries")
    sizes = queries.select("query_id", "key").distinct().groupBy("key").agg(F.count("*").alias("n"))
    different = queries.groupBy("key").agg(F.min("query_id").alias("query_id"), F.first("vec").alias("vec"))
    count, much = different.agg(F.count("*"), F.coalesce(F.sum(F.length("vec")), F.lit(0))).first()
    if indexes and count:
        # A sample of different queries and, where queries are copies of each other, one of their rows.
        total = queries.count()
        drawn = [lowest(different, PILOT / count, 2 * PILOT, "key")]
        if total > count:
            drawn.append(lowest(queries, PILOT / total, 2 * PILOT, "query_id", "key"))
        every_one = all(len(d) == n for d, n in zip(drawn, (count, total)))
        pilots, groups = {}, {}
        for dim in indexes:
            mine = [[r for r in d if len(r["vec"]) == dim * size] for d in drawn]
            first = {r["key"]: r for d in mine for r in d}
            if every_one and first or len(mine[0]) >= TOLD:
                number = {k: i for i, k in enumerate(first)}
                groups[dim] = [np.array([number[r["key"]] for r in d], np.int64) for d in mine]
                pilots[dim] = np.array([r["query_id"] for r in first.values()]), np.stack([np.frombuffer(r["vec"], kind) for r in first.values()])
        for dim, (query, which) in (spots(filed, copies, pilots, top, kind) if pilots else {}).items():
            indexes[dim].settle(pilots[dim][1], groups[dim], query, which)
        held = spark.sparkContext.broadcast(indexes)

    def pack(keys: list, vecs: list) -> pa.RecordBatch:
        data, dim = b"".join(vecs), len(vecs[0]) // size
        index = held.value.get(dim)
        asked = index.first + np.flatnonzero(index.probes(np.frombuffer(data, kind).reshape(-1, dim)).any(0)) if index else np.array([-dim])
        return S.batch(ASKED, [keys[0]], [asked.tolist()], [b"".join(keys)], [data])

    tasks = max(1, -(-count // BLOCK), -(-much // BYTES))
    near = S.map_arrow(different.select("key", "vec"), own, "list int, key binary, vec binary").repartitionByRange(tasks, "list", "key").sortWithinPartitions("list", "key")
    asking = S.stored(packed(near, ("key", "vec"), pack, "block binary, asked array<int>, keys binary, queries binary"), "asking")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, open_ = Room(), {}
        for b in batches:
            for i, parts, entries, x in parts_of(b, kind):
                name = b.column("block")[i].as_py()
                if name not in open_:
                    q = np.frombuffer(b.column("queries")[i].as_py(), kind).reshape(-1, x.shape[1])
                    open_[name] = Asking(held.value.get(x.shape[1]), keep, b.column("keys")[i].as_py(), q, room)
                unit, whole = scaled_part(x)
                for g, a, e in parts:
                    open_[name].meet(g, entries[a:e], x[a:e], unit[a:e], whole)
        for name, a in open_.items():
            a.settle()
            yield S.batch(FOUND, [name], [a.keys], [a.ids.astype("<i8").tobytes()], [a.scores.astype("<f8").tobytes()])

    S.ship(spark)
    met = filed.hint("shuffle_replicate_nl").join(asking.repartition(tasks), F.arrays_overlap("lists", "asked"))
    found = met.select("lists", "sizes", "entries", "vecs", "block", "keys", "queries").mapInArrow(scan, "block binary, keys binary, entries binary, scores binary")
    best = S.stored(merged(found, keep), "best")

    pairs = best.select("key", F.explode(F.arrays_zip("entries", "scores")).alias("x")).select("key", F.col("x.entries").alias("entry"), F.col("x.scores").alias("score"))
    ids = F.explode(F.coalesce("ids", F.array("entry"))).alias("vec_id")
    ordered = pairs.join(copies, "entry", "left").select("key", "score", ids).groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    groups = S.stored(ordered.select("key", F.slice("near", 1, keep).alias("near")).join(sizes, "key"), "near")
    asked = S.join_groups(queries.select("query_id", "key").distinct(), groups, ["key"], "n")
    ranked = asked.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)).alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
