"""Near-duplicate lines by a segment-partition edit join.

Two lines within t edits: cut the shorter or equally long one into t + 1 segments; at least one segment stands unchanged
in the other, and only a few places of it need be tried (those that leave enough edits for either side). So each line is
filed under its own segments, with its length and the segment's number, and asks, for every length from its own down to
t less, for the substrings at those places. Lines that meet are first held against each other by a parity sketch of
their character pairs (an edit changes at most four of its bits), then by a banded bit-parallel edit distance over their
texts.

A line files and asks for thirty entries at three edits, so these are what costs: keys are hashed for a whole batch of
lines at once, and entries (a key, a line's hash, its sketch: 18 bytes) travel packed, many for each row, by buckets of
keys. The number of buckets follows from the number of lines, so that a bucket is small enough to be sorted in memory.

Under a key that many lines share, first only a spanning forest of the close ones is verified, each line to the closest.
The members of all other close pairs are kept; once components are known, their texts are brought to the key's group and
pairs that aren't joined yet are verified where they meet, large groups by pairs of blocks. So large groups of near
copies make no more rows than they have members, and no link between different lines is lost.

Lines are known by hashes until texts are compared: texts of lines that met are fetched by a filter over the hashes.
Links make classes; of each class the first line of the corpus stays.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from . import graph

PACK = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])
MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("line", pa.int64()), ("sketch", pa.int64()), ("role", pa.int32())])
LINE = pa.schema([("line", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32())])
TEXT = pa.schema([("line", pa.int64()), ("text", pa.string())])
BUCKET = 1 << 20  # entries that a bucket has on average at most
FLUSH = 1 << 19  # entries that a task holds before it packs them
SKETCH = 48
MASK = (1 << SKETCH) - 1
FILES, ASKS = 1, 2
BLOCK = 2048  # members of a block of a large group
CROWD = 4096  # lines under a key up to which one task makes their forest
MOST_HELD = 96 << 20  # bytes of a bucket that a task holds; a bucket has some 18 MB on average


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most so large: bit-parallel over a band of diagonals, after equal ends are cut
    off.
    """
    if abs(len(a) - len(b)) > most:
        return False
    k = len(os.path.commonprefix((a, b)))
    a, b = a[k:], b[k:]
    k = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) < len(b):
        a, b = b, a
    if not b or len(a) <= most:
        return len(a) <= most
    # Rows are a's characters, columns b's. Bit r of column j's band is row j - most + r.
    width = 2 * most + 1
    full, places = (1 << width) - 1, {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down = full ^ ((1 << most) - 1), 0  # where the column before rises or falls by one
    score = most
    for j, c in enumerate(b):
        p, shift = places.get(c, 0), j - most
        match = (p >> shift if shift >= 0 else p << -shift) & full
        diagonal = (((match & up) + up) ^ up | match | down) & full
        rise, fall = (down | ~(diagonal | up)) & full, diagonal & up
        last = len(a) - 1 - shift  # the bit of a's last row
        if last >= width - 1:
            score += not diagonal >> (width - 1) & 1
        elif last >= 0:
            score += (rise >> last & 1) - (fall >> last & 1)
        up, down = (fall | ~(diagonal >> 1 | rise)) & full, diagonal >> 1 & rise
    # Rows below the band in the last column can't be within the distance.
    return len(a) - len(b) <= most and score <= most


def within_all(left: list[str], right: list[str], most: int, chunk: int = 1 << 20) -> np.ndarray:
    """`within` for many pairs at once: the same bands, a column of every pair in each step. Pairs that can't come back
    go early.
    """
    swap = [(y, x) if len(x) < len(y) else (x, y) for x, y in zip(left, right)]
    la, lb = (np.array([len(p[k]) for p in swap], np.int64) for k in (0, 1))
    out = la <= most
    order = np.flatnonzero(~out & (la - lb <= most))
    order = order[np.argsort(la[order], kind="stable")]
    width, at = 2 * most + 1, 0
    full = np.int32((1 << width) - 1)
    while at < len(order):
        end = at + max(1, int(np.searchsorted((np.arange(len(order) - at) + 1) * la[order[at:]], chunk, "right")))
        rows, at = order[at:end], end
        if len(rows) < 8:
            out[rows] = [within(*swap[i], most) for i in rows.tolist()]
            continue
        a, b = np.full((len(rows), int(la[rows].max()) + width), -1, np.int32), np.full((len(rows), int(lb[rows].max())), -2, np.int32)
        for k, i in enumerate(rows.tolist()):
            for held, text, start in ((a, swap[i][0], most), (b, swap[i][1], 0)):
                held[k, start : start + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<i4")
        a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        n, m = la[rows], lb[rows]
        up, down, score = (np.full(len(rows), v, np.int32) for v in (full ^ np.int32((1 << most) - 1), 0, most))
        for j in range(len(b)):
            match = np.zeros(len(rows), np.int32)
            for r in range(width):
                match |= (a[j + r] == b[j]).astype(np.int32) << np.int32(r)
            diagonal = (((match & up) + up) ^ up | match | down) & full
            rise, fall = (down | ~(diagonal | up)) & full, diagonal & up
            last = n - 1 - j + most
            edge = np.clip(last, 0, width - 1).astype(np.int32)
            step = np.where(last >= width - 1, 1 - (diagonal >> np.int32(width - 1) & 1), np.where(last >= 0, (rise >> edge & 1) - (fall >> edge & 1), 0))
            on = j < m
            score = np.where(on, score + step, score).astype(np.int32)
            up, down = np.where(on, (fall | ~(diagonal >> 1 | rise)) & full, up), np.where(on, diagonal >> 1 & rise, down)
            if j % 32 == 31:
                stay = score - np.bitwise_count(up) <= most
                if stay.mean() < 0.7:
                    rows, n, m, up, down, score = (x[stay] for x in (rows, n, m, up, down, score))
                    a, b = a[:, stay], b[:, stay]
                    if not len(rows):
                        break
        out[rows] = score <= most
    return out


def cuts(length: int, most: int) -> list[tuple[int, int]]:
    """Begin and end of the segments of a line: as even as can be, longer ones last."""
    n, base, longer = most + 1, length // (most + 1), length % (most + 1)
    sizes = [base + (i >= n - longer) for i in range(n)]
    return [(sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(n)]


def places(own: int, length: int, most: int) -> list[tuple[int, int, int]]:
    """(segment, begin, end) of the substrings a line asks for among lines of a length, its own or less."""
    out, more = [], own - length
    for i, (a, b) in enumerate(cuts(length, most)):
        low = max(0, a - i, a + more - (most - i))
        high = min(own - (b - a), a + i, a + more + (most - i))
        out += [(i, p, p + b - a) for p in range(low, high + 1)]
    return out


_PLANS: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}


def plan(own: int, most: int) -> tuple[np.ndarray, ...]:
    """What a line of a length files and asks for: begins, ends, and numbers that stand for the filed line's length and
    the segment; the first most + 1 are filed.
    """
    if (own, most) not in _PLANS:
        if len(_PLANS) > 20_000:
            _PLANS.clear()
        rows = [(a, b, own, i) for i, (a, b) in enumerate(cuts(own, most))]
        rows += [(a, b, n, i) for n in range(max(most + 1, own - most), own + 1) for i, a, b in places(own, n, most)]
        begin, end, n, i = np.array(rows, np.int64).T
        _PLANS[own, most] = begin, end, S.mix((n * (most + 1) + i).astype(np.uint64))
    return _PLANS[own, most]


def points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of lines in a row, and the lines' lengths."""
    return np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64), np.fromiter(map(len, lines), np.int64, len(lines))


def sketches(c: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SKETCH parities of each line's character pairs."""
    pair = (S.mix(c[:-1] << np.uint64(32) | c[1:]) >> np.uint64(32)) * np.uint64(SKETCH) >> np.uint64(32)
    own = np.repeat(np.arange(len(sizes)), sizes)
    inside = own[1:] == own[:-1]
    counts = np.bincount(own[:-1][inside] * 64 + pair[inside].astype(np.int64), minlength=64 * len(sizes))
    return np.packbits((counts & 1).astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()


def counts_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each line has characters of 32 kinds, and pairs of them of 64 kinds. An edit changes two of the first
    counts by one, or four of the second.
    """
    c, sizes = points(lines)
    own = np.repeat(np.arange(len(sizes)), sizes)
    inside = own[1:] == own[:-1]
    pair = (S.mix(c[:-1] << np.uint64(32) | c[1:]) >> np.uint64(58)).astype(np.int64)
    one = np.bincount(own * 32 + (S.mix(c) >> np.uint64(59)).astype(np.int64), minlength=32 * len(sizes))
    two = np.bincount(own[:-1][inside] * 64 + pair[inside], minlength=64 * len(sizes))
    return one.reshape(-1, 32).astype(np.int32), two.reshape(-1, 64).astype(np.int32)


def entries(lines: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, line hashes, sketches and roles of all that lines file and ask for. Keys are polynomials of a substring's
    characters modulo 2**64, mixed with its length and place: a collision only proposes a pair.
    """
    c, sizes = points(lines)
    up, down = S._powers(S.CHARACTERS, len(c) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    plans = [plan(n, most) for n in sizes.tolist()]
    counts = np.fromiter((len(p[0]) for p in plans), np.int64, len(plans))
    begin, end, salt = (np.concatenate([p[k] for p in plans]) for k in range(3))
    base = np.repeat(np.cumsum(sizes) - sizes, counts)
    begin, end = begin + base, end + base
    key = S.mix((sums[end] - sums[begin]) * down[begin] + salt)
    place = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)
    return key, np.repeat(names(lines), counts), np.repeat(sketches(c, sizes), counts), np.where(place <= most, FILES, ASKS)


def packed(key: np.ndarray, line: np.ndarray, sketch: np.ndarray, role: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket: 32 bits of the keys, the last of which tells the role, then the hashes, then the sketches.
    """
    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    short = ((key & np.uint64(0xFFFFFFFE)) | (role == ASKS).astype(np.uint64)).astype("<u4")[order]
    line, low, high = line[order].astype("<u8"), (sketch & np.uint64(0xFFFFFFFF)).astype("<u4")[order], (sketch >> np.uint64(32)).astype("<u2")[order]
    cut = graph.runs(bucket[order])
    rows = [b"".join(x[i:j].tobytes() for x in (short, line, low, high)) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
    return S.batch(PACK, bucket[order][cut[:-1]], rows)


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of 31 bits, line hashes, sketches and roles of a bucket's rows, sorted by key and line; each line once in a
    role under a key.
    """
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for r in rows:
        n, at = len(r) // 18, 0
        for k, kind in enumerate(("<u4", "<u8", "<u4", "<u2")):
            parts[k].append(np.frombuffer(r, kind, n, at))
            at += n * parts[k][-1].itemsize
    short, line, low, high = (np.concatenate(p) for p in parts)
    order = np.lexsort((line, short))
    short, line = short[order], line[order]
    once = np.ones(len(short), bool)
    once[1:] = (short[1:] != short[:-1]) | (line[1:] != line[:-1])
    order, short, line = order[once], short[once], line[once]
    # Roles of a line under one key come together: the last bit of the key sorts within it.
    return short >> np.uint32(1), line, low[order].astype(np.uint64) | high[order].astype(np.uint64) << np.uint64(32), np.where(short & 1, ASKS, FILES)


def lines_of(text: str | None, least: int, short: bool = False) -> list[tuple[int, str]]:
    """(place, line) of the lines that are long enough to be compared; short: and of shorter ones that aren't blank."""
    return [(i, x) for i, x in enumerate(text.split("\n")) if len(x) >= least or short and x.strip()] if text else []


def names(lines: list[str], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode(), seed) for x in lines), np.uint64, len(lines))


def forest(line: np.ndarray, sketch: np.ndarray, asks: np.ndarray, files: np.ndarray, most: int) -> tuple[list, list, np.ndarray]:
    """Of a group's lines: links (a, b) between close ones that a spanning forest needs, each to the closest of another
    tree, and which lines have close pairs that it leaves out.
    """
    a, b, left, label = [], [], np.zeros(len(line), bool), np.arange(len(line))
    right = np.flatnonzero(files)
    for q in np.flatnonzero(asks).tolist():
        apart = np.bitwise_count(sketch[right] ^ sketch[q])
        close = (apart <= 4 * most) & (right != q)
        near, apart = right[close], apart[close]
        if not len(near):
            continue
        other = label[near] != label[q]
        taken = near[other][np.lexsort((apart[other], label[near[other]]))]
        taken = taken[np.concatenate([[True], label[taken][1:] != label[taken][:-1]])] if len(taken) else taken
        rest = near[~np.isin(near, taken)]
        left[rest] = True
        left[q] |= len(rest) > 0
        a += [line[q]] * len(taken)
        b += line[taken].tolist()
        label[np.isin(label, label[taken])] = label[q]
    return a, b, left


def met(key: np.ndarray, line: np.ndarray, sketch: np.ndarray, role: np.ndarray, most: int, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) between lines that meet under a key and whose sketches are close, and which entries belong to pairs
    that were left out: all of a key that more than `crowd` lines share.
    """
    starts = graph.runs(key)
    sizes = np.diff(starts)
    left = np.zeros(len(key), bool)
    first = starts[:-1][sizes == 2]
    ok = (role[first] != role[first + 1]) & (line[first] != line[first + 1]) & (np.bitwise_count(sketch[first] ^ sketch[first + 1]) <= 4 * most)
    a, b = [line[first[ok]]], [line[first[ok] + 1]]
    roles = np.bitwise_or.reduceat(role, starts[:-1]) if len(key) else role
    for s in np.flatnonzero((sizes > 2) & (roles == FILES | ASKS)).tolist():
        i, j = int(starts[s]), int(starts[s + 1])
        one, at, back = np.unique(line[i:j], return_index=True, return_inverse=True)
        if len(one) < 2:
            continue
        if len(one) > crowd:
            left[i:j] = True
            continue
        asks, files = (np.bincount(back, role[i:j] == r, len(one)) > 0 for r in (ASKS, FILES))
        x, y, more = forest(one, sketch[i:j][at], asks, files, most)
        a.append(np.array(x, np.uint64))
        b.append(np.array(y, np.uint64))
        left[i:j] = more[back]
    return np.concatenate(a), np.concatenate(b), left


class Filter:
    """A filter of bits over rows, some 16 bits a row, at least 128 KB and at most 32 MB. It never misses a row; where
    there are too many rows for its size it lets more others through.
    """

    def __init__(self, bits: bytes):
        self.held = np.frombuffer(bits, np.uint8)
        self.mask = np.int64(len(bits) * 8 - 1)

    def passes(self, *hashes: np.ndarray) -> np.ndarray:
        """Of rows' hashes, those that may be in it."""
        at = [h & self.mask for h in hashes]
        return np.logical_and.reduce([self.held[p >> 3] >> (p & 7).astype(np.uint8) & 1 for p in at]).astype(bool)


def filter_of(df: DataFrame, *hashes: Column) -> Filter | None:
    """A filter over rows by hashes; None if there are no rows."""
    n = df.count()
    if not n:
        return None
    size = 1 << min(28, max(20, (16 * n - 1).bit_length()))
    part_bits = min(size, 1 << 19)
    bits = df.select(F.explode(F.array(*(h.bitwiseAND(F.lit(size - 1)) for h in hashes))).alias("bit")).distinct()

    def pack(t):
        bit = t.column("bit").to_numpy()
        part = np.zeros(part_bits // 8, np.uint8)
        np.bitwise_or.at(part, bit % part_bits >> 3, (1 << (bit & 7)).astype(np.uint8))
        return pa.table({"part": [int(bit[0]) // part_bits], "bits": [part.tobytes()]})

    out = bytearray(size // 8)
    for p in bits.withColumn("part", F.expr(f"bit div {part_bits}")).groupBy("part").applyInArrow(pack, "part long, bits binary").collect():
        out[p.part * part_bits // 8 : (p.part + 1) * part_bits // 8] = p.bits
    return Filter(bytes(out))


def line_spots(line: Column) -> list[Column]:
    """A line's hash is even already: two parts of it serve."""
    return [line, F.shiftright(line, 28)]


def spots_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h, h >> 28


def id_spots(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(i)) for i in (1, 2)]


def many_lines(docs: DataFrame) -> int:
    """No fewer than there are lines: newlines, and one for each text."""
    n = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)).head()[0]
    return int(n or 0)


def candidates(docs: DataFrame, most: int, least: int) -> DataFrame:
    """What lines that meet have to say, as a table: links (a, b) of a forest; and, with null a, the entries (key, line,
    sketch, role) of pairs that it left out.
    """
    counted = most + 1 + sum(len(places(1000, 1000 - d, most)) for d in range(most + 1))
    buckets = max(1, -(-many_lines(docs) * counted // BUCKET))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for b in batches:
            for i, j in S.by_bytes(texts := b.column("text").to_pylist(), 1_000_000):
                if lines := list({x for t in texts[i:j] for _, x in lines_of(t, least)}):
                    held.append(entries(lines, most))
                    n += len(held[-1][0])
                if n >= FLUSH:
                    yield packed(*(np.concatenate(x) for x in zip(*held)), buckets)
                    held, n = [], 0
        if held:
            yield packed(*(np.concatenate(x) for x in zip(*held)), buckets)

    def told(bucket: int, rows: list[bytes], whole: bool) -> pa.RecordBatch:
        """Of a bucket, or of a part of one, whose pairs are all left to blocks."""
        key, line, sketch, role = unpacked(rows)
        none = np.empty(0, np.uint64)
        a, b, left = met(key, line, sketch, role, most, CROWD) if whole else (none, none, np.ones(len(key), bool))
        pairs = [*S.signed(np.minimum(a, b)).tolist(), *[None] * int(left.sum())], [*S.signed(np.maximum(a, b)).tolist(), *[None] * int(left.sum())]
        none = [None] * len(a)
        rest = ((np.int64(bucket) << 31 | key[left].astype(np.int64)), S.signed(line[left]), sketch[left].astype(np.int64), role[left])
        return S.batch(MET, *pairs, *(none + x.tolist() for x in rest))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, rows, size, whole = None, [], 0, True
        for b in batches:
            for bucket, row in zip(b.column("bucket").to_pylist(), b.column("entries")):
                if bucket != which:
                    if rows:
                        yield told(which, rows, whole)
                    which, rows, size, whole = bucket, [], 0, True
                rows.append(row.as_py())
                size += len(rows[-1])
                if size > MOST_HELD:  # a key that very many lines share: nothing of this bucket is looked at here
                    whole = False
                    yield told(which, rows, whole)
                    rows, size = [], 0
        if rows:
            yield told(which, rows, whole)

    S.ship(docs.sparkSession)
    rows = docs.select("text").mapInArrow(file, "bucket int, entries binary").repartition("bucket").sortWithinPartitions("bucket")
    return S.stored(rows.mapInArrow(meet, "a long, b long, key long, line long, sketch long, role int"), "met")


def texts_of(lines: DataFrame, docs: DataFrame, least: int) -> DataFrame | None:
    """line, text of line hashes (a column `line`, different ones), a table; None if there are none. Only texts of these
    lines are moved, but for a few that pass the filter.
    """
    bits = filter_of(lines, *line_spots(F.col("line")))
    if bits is None:
        return None
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def fetch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j in S.by_bytes(texts := b.column("text").to_pylist(), 1_000_000):
            lines = list({x for t in texts[i:j] for _, x in lines_of(t, least)})
            if lines:
                h = S.signed(names(lines))
                ok = held.value.passes(*spots_of(h))
                yield S.batch(TEXT, h[ok], [x for x, o in zip(lines, ok.tolist()) if o])

    texts = S.map_arrow(docs.select("text"), fetch, "line long, text string")
    return S.stored(texts.groupBy("line").agg(F.min("text").alias("text")), "texts")


def verified(pairs: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Those of pairs (a, b) of line hashes, a table, whose lines (line, text) are within the distance."""
    both = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def verify(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield b.select(["a", "b"]).filter(pa.array(within_all(b.column("left").to_pylist(), b.column("right").to_pylist(), most)))

    return S.stored(S.map_arrow(both, verify, "a long, b long"), "near")


def rest_of(found: DataFrame, parts: DataFrame, texts: DataFrame, most: int) -> DataFrame | None:
    """Links (a, b) between lines within the distance that the forest left out and whose lines aren't in one component
    yet; None if it left nothing out.

    A group of up to BLOCK lines is one task's. A larger one is cut into blocks by the lines' hashes and each two blocks
    meet in a group of their own, so no task holds more than two.
    """
    rows = found.where("key is not null").select("key", "line", "sketch", "role")
    if not rows.take(1):
        return None
    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(blocks.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("group", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select("group", "line", "sketch", "role")
    rows = rows.join(parts, F.col("line") == F.col("node"), "left").withColumn("part", F.coalesce("component", "line")).join(texts, "line")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, tried = graph.Forest(), set()
        held: list[tuple] = []  # pairs to be verified: their hashes, components and texts

        def tell() -> Iterator[pa.RecordBatch]:
            some = [h for h in held if joined.find(h[2]) != joined.find(h[3])]
            held.clear()
            good = [h for h, ok in zip(some, within_all([h[4] for h in some], [h[5] for h in some], most)) if ok]
            for h in good:
                joined.link(h[2], h[3])
            if good:
                yield S.batch(graph.PAIR, [h[0] for h in good], [h[1] for h in good])

        for t in graph.whole_runs(batches, "group"):
            key, line, sketch, role, part = (t.column(c).to_numpy() for c in ("group", "line", "sketch", "role", "part"))
            starts = graph.runs(key)
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if len({joined.find(x) for x in set(part[i:j].tolist())}) < 2:
                    continue
                one, at, back = np.unique(line[i:j], return_index=True, return_inverse=True)
                asks, files = (np.bincount(back, role[i:j] == r, len(one)) > 0 for r in (ASKS, FILES))
                text, print_, label = t.column("text").slice(i, j - i).take(pa.array(at)).to_pylist(), sketch[i:j][at], part[i:j][at]
                right, (single, double) = np.flatnonzero(files), counts_of(text)
                ids, own = one.tolist(), label.tolist()
                for q in np.flatnonzero(asks).tolist():
                    near = right[(np.bitwise_count(print_[right] ^ print_[q]) <= 4 * most) & (label[right] != label[q])]
                    near = near[np.abs(single[near] - single[q]).sum(1) <= 2 * most]
                    near = near[np.abs(double[near] - double[q]).sum(1) <= 4 * most]
                    for r in near.tolist():
                        pair = min(ids[q], ids[r]), max(ids[q], ids[r])
                        if pair not in tried:
                            tried.add(pair)
                            held.append((*pair, own[q], own[r], text[q], text[r]))
                    if len(held) >= 4096:
                        yield from tell()
                if len(tried) > 1_000_000:
                    tried.clear()
                if len(joined.parent) > 1_000_000:
                    joined = graph.Forest()
        yield from tell()

    dealt = rows.select("group", "line", "sketch", "role", "part", "text").repartition("group").sortWithinPartitions("group")
    return S.stored(dealt.mapInArrow(meet, "a long, b long").distinct(), "near")


def classes(docs: DataFrame, most: int, least: int) -> DataFrame:
    """node, component of the hashes of lines that are within the distance of another line, or linked to one by such
    steps.
    """
    found = candidates(docs, most, least)
    pairs = S.stored(found.where("a is not null").select("a", "b").distinct(), "pairs")
    # One pass over the documents fetches the texts of all lines that met.
    texts = texts_of(found.select(F.explode(F.array_compact(F.array("a", "b", "line"))).alias("line")).distinct(), docs, least)
    near = verified(pairs, texts, most) if texts is not None else pairs
    parts = graph.components(near)
    more = rest_of(found, parts, texts, most) if texts is not None else None
    return graph.components(near.unionAll(more)) if more is not None and more.take(1) else parts


def later_lines(docs: DataFrame, most: int = 1, least: int = 20, short: bool = False) -> DataFrame:
    """line_doc_id and line_row (of a document: doc_id, text, row), gone (places of its lines that go), near (how many
    of them are no exact copies of their class's first line), stays_in (the documents that hold those first lines).
    """

    def number(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j in S.by_bytes(texts := b.column("text").to_pylist(), 1_000_000):
            found = [(k, r, at, x) for k, r, t in zip(b.column("doc_id")[i:j].to_pylist(), b.column("row")[i:j].to_pylist(), texts[i:j]) for at, x in lines_of(t, least, short)]
            if found:
                ids, rows, at, lines = zip(*found)
                yield S.batch(LINE, S.signed(names(lines)), S.signed(names(lines, 1)), list(ids), list(rows), list(at))

    parts = classes(docs, most, least) if most else None
    # Rows that agree in doc_id and text are one document.
    lines = S.map_arrow(docs, number, "line long, check long, doc_id long, row long, at int")
    joined = lines.join(parts, F.col("line") == F.col("node"), "left") if parts is not None else lines.withColumn("component", F.lit(None).cast("long"))
    lines = S.stored(
        joined.select(
            F.coalesce("component", "line").alias("class"), F.when(F.col("component").isNull(), F.col("check")).otherwise(0).alias("check"), "line",
            "doc_id", "row", "at"
        ),
        "lines"
    )
    first = lines.groupBy("class", "check").agg(F.min(F.struct("doc_id", "row", "at", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = S.join_groups(lines, first, ["class", "check"], "n").where("struct(doc_id, row, at) > struct(first.doc_id, first.row, first.at)")
    near = F.size(F.collect_set(F.when(F.col("line") != F.col("first.line"), F.col("at")))).cast("long")
    found = later.groupBy("doc_id", "row").agg(F.collect_set("at").alias("gone"), near.alias("near"), F.sort_array(F.collect_set("first.doc_id")).alias("stays_in"))
    return found.withColumnsRenamed({"doc_id": "line_doc_id", "row": "line_row"})


def with_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, a hash of the text that tells rows of one doc_id apart; rows without a doc_id or a text go.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.where("doc_id is not null and text is not null").withColumn("row", F.xxhash64("text"))


def without(text: str, gone: set[int]) -> str:
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def deduplicated(docs: DataFrame, most: int = 1, least: int = 20, drop_emptied: bool = False, drop_blank: bool = False, short: bool = False) -> DataFrame:
    """The documents (doc_id, text and any others) without the lines that are within `most` edits of a line that stands
    earlier in the corpus, or linked to one by such steps.

    Lines end at newlines. Lines of fewer than `least` characters stay and aren't compared: small edits make other lines
    of them. With short, those that aren't blank go where they exactly repeat an earlier line. Earlier means by doc_id
    and then by place. Null texts and rows with a null doc_id stay as they are, and their lines count for no others.
    Rows that repeat a doc_id come out as often as they came in: such with the same text are one document, others are
    documents of their own whose order is fixed by a hash of their texts. A document whose lines all go keeps an empty
    text. With drop_blank, documents that lose lines and have no line left but blank ones go. With drop_emptied,
    documents that lose all of their compared lines go, whatever short lines they have left, though no earlier one may
    have those.
    """
    gone = later_lines(with_rows(docs), most, least, short).select("line_doc_id", "line_row", "gone")
    kept = docs.schema
    renamed = {c: f"{c}__line_dedup" for c in gone.columns}
    gone = gone.withColumnsRenamed(renamed)
    key, row, places_ = renamed.values()
    rows = docs.join(gone, (docs["doc_id"] == gone[key]) & (F.xxhash64(docs["text"]) == gone[row]), "left").drop(key, row)

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pairs = list(zip(b.column("text").to_pylist(), b.column(places_).to_pylist()))
        out = [t if g is None or t is None else without(t, set(g)) for t, g in pairs]
        b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string())).select(kept.names)
        stay = [g is None or t is None or not (drop_emptied and len(g) == len(lines_of(t, least, short)) or drop_blank and not new.strip()) for (t, g), new in zip(pairs, out)]
        yield b if all(stay) else b.filter(pa.array(stay, pa.bool_()))

    return S.map_arrow(rows, cut, kept)


DIGEST = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_lines", pa.int64()), ("kept_sha256", pa.string()), ("held", pa.string())])
RESULT = "doc_id long, n_lines long, n_removed long, n_near long, kept_sha256 string, stays_in string"


def digest(docs: DataFrame, most: int = 1, least: int = 20, short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near (removed lines that are no exact copies of the line that stays), kept_sha256
    of each document's text without the removed lines, stays_in (doc_ids of the lines that stay for the removed ones,
    ascending, comma-joined). A row for each row, as in deduplicated; a null text has no lines. Only texts that lose
    lines are dealt.
    """
    rows = with_rows(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row"))
    gone = S.stored(later_lines(rows, most, least, short), "later")
    bits = filter_of(gone, *id_spots(F.col("line_doc_id")))
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def count(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, some = b.column("text").to_pylist(), [False] * b.num_rows
        if held.value is not None:
            some = held.value.passes(b.column("p").to_numpy(), b.column("q").to_numpy()).tolist()
        lines = [0 if t is None else t.count("\n") + 1 for t in texts]
        yield S.batch(DIGEST, b.column("doc_id"), b.column("row"), lines, [sha256((t or "").encode()).hexdigest() for t in texts], [t if x else None for t, x in zip(texts, some)])

    spots = [c.alias(n) for c, n in zip(id_spots(F.col("doc_id")), "pq")]
    every = S.map_arrow(docs.select("doc_id", "text", "row", *spots), count, "doc_id long, row long, n_lines long, kept_sha256 string, held string")
    if bits is None:
        return every.select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_near"), "kept_sha256", F.lit("").alias("stays_in"))
    met_ = every.join(gone.hint("merge"), (F.col("doc_id") == F.col("line_doc_id")) & (F.col("row") == F.col("line_row")), "left")

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        gone, prints = b.column("gone").to_pylist(), b.column("kept_sha256").to_pylist()
        prints = [p if g is None else sha256(without(t, set(g)).encode()).hexdigest() for t, g, p in zip(b.column("held").to_pylist(), gone, prints)]
        less, stays = [len(g or ()) for g in gone], [",".join(map(str, x or ())) for x in b.column("stays_in").to_pylist()]
        near = b.column("near").fill_null(0)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_lines"), pa.array(less, pa.int64()), near, pa.array(prints, pa.string()), pa.array(stays, pa.string())],
            names=["doc_id", "n_lines", "n_removed", "n_near", "kept_sha256", "stays_in"]
        )

    return S.map_arrow(met_.select("doc_id", "n_lines", "kept_sha256", "held", "gone", "near", "stays_in"), cut, RESULT)
