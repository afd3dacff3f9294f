"""Passages that repeat across documents, found by level-wise doubling of windows.

The first level looks at short windows, the next at windows up to twice as long, and only where both halves are
repeated: a window can't occur twice unless its parts do. Levels go on to the length asked for, or, to measure the
longest repeats, until no candidates survive.

The first level needn't file every position. Of the short windows in a full-length one, the one with the smallest hash
stands for it; two equal full-length windows have the same. Filing only those keeps a quarter of the positions and loses
no repeat. Words have two hashes of 64 bits, windows one from each: by both together, 128 bits, a window decides a
removal. A text is dealt once to meet its repeated short windows; only documents that have some go further.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

FILED = pa.schema([("h", pa.int64()), ("doc_id", pa.int64())])
AT = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32())])
STATED = pa.schema([*FILED, ("state", pa.int8())])
AT_ONCE = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("doc_id", pa.int64()), ("state", pa.int8())])
OPEN, KNOWN = 0, 1
NOBODY = -(1 << 63)  # stands for documents of another task; no document has this id
LATER = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("g", pa.int64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("copy", pa.binary()), ("own_text", pa.string())])
KEPT = pa.schema([("doc_id", pa.int64()), ("copy", pa.binary()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
OTHER = 0xC2B2AE3D27D4EB4F  # base of the second hash of windows


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of so many hashes."""
    out, done = h, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def named(hg: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window, from the words' two."""
    return S.windows(hg[0], length), S.windows(hg[1], length, OTHER)


def filed(h: np.ndarray, short: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For word hashes: the hash that stands for each full-length window, and those that are filed, each once."""
    marks = least_of(S.windows(h, short), length - short + 1) if len(h) >= length else np.empty(0, np.uint64)
    return marks, np.unique(marks)


def gathered(parts: Iterator[tuple[np.ndarray, ...]], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of a task, as columns, some at a time."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= most:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def settled(h: np.ndarray, d: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (h, document) and what a task knows of them: KNOWN, if h stands in several of its documents and texts. For
    other tasks' documents one row of such an h goes on as OPEN, under NOBODY; all other rows are OPEN.
    """
    order = np.lexsort((d, h))
    h, d, text = h[order], d[order], text[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    several = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
    several &= np.minimum.reduceat(text, starts) != np.maximum.reduceat(text, starts)
    state = np.empty(len(h), np.int8)  # in the order that the rows came in, by documents, which packs better
    state[order] = np.where(np.repeat(several, np.diff(np.append(starts, len(h)))), KNOWN, OPEN)
    again, back = h[starts[several]], np.argsort(order)
    return np.concatenate([h[back], again]), np.concatenate([d[back], np.full(len(again), NOBODY)]), np.concatenate([state, np.full(len(again), OPEN, np.int8)])


def repeated(rows: DataFrame) -> DataFrame:
    """The rows (h, doc_id) whose h occurs in several documents: a pass over rows (h, doc_id, state) sorted by h and
    doc_id that holds one row. Rows that are KNOWN to repeat pass through and are dealt by document, so an h that a
    third of all documents share is a row from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None  # the row before
        told = True  # whether it has been given out
        for b in batches:
            h, d, state = (b.column(c).to_numpy() for c in ("h", "doc_id", "state"))
            known = state == KNOWN
            if known.any():
                yield S.batch(FILED, h[known], d[known])
            h, d = h[~known], d[~known]
            if not len(h):
                continue
            if last is not None:
                h, d = np.concatenate([[last[0]], h]), np.concatenate([[last[1]], d])
            same = (h[1:] == h[:-1]) & (d[1:] != d[:-1])
            keep = np.zeros(len(h), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and told:
                keep[0] = False
            told = bool(keep[-1])
            # The last row waits for its follower unless it is already known to repeat.
            last = int(h[-1]), int(d[-1])
            keep &= d != NOBODY
            if keep.any():
                yield S.batch(FILED, h[keep], d[keep])

    dealt = rows.repartition(F.when(F.col("state") == KNOWN, F.xxhash64("doc_id")).otherwise(F.col("h"))).sortWithinPartitions("h", "doc_id")
    return dealt.mapInArrow(run, "h long, doc_id long")


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of these places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def found_pairs(h: np.ndarray, g: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) stand among the pairs (h, g), which are sorted."""
    low = np.searchsorted(h, a, "left")
    out = np.zeros(len(a), bool)
    go = np.arange(len(a))
    while len(go):  # more than one round only where first hashes agree
        go = go[(low[go] < len(h))]
        go = go[h[low[go]] == a[go]]
        out[go] |= g[low[go]] == b[go]
        go = go[~out[go]]
        low[go] += 1
    return out


def candidates(docs: DataFrame, length: int, short: int, gone: DataFrame | None = None, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """The first level and the step to full length: the documents (doc_id, text, marks) that have repeated short
    windows, but for those in gone (gone_id), and their windows (h, g, doc_id, at) that contain one: two hashes, and the
    first word's place. once: each different window of a document once, and in place of the place a state: KNOWN, if a
    smaller document of the same task has the window, so that of a window one row a task remains to be looked at.
    """

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                for i, j in S.by_bytes(texts := b.column("text").to_pylist()):
                    for k, (h, _) in zip(b.column("doc_id")[i:j].to_pylist(), S.hashed_texts(texts[i:j])):
                        if k is not None and len(h) >= length:
                            own = filed(h, short, length)[1]
                            yield S.signed(own), np.full(len(own), k, np.int64), np.full(len(own), xxhash.xxh3_64_intdigest(h.tobytes()), np.uint64)

        for columns in gathered(marks()):
            yield S.batch(STATED, *settled(*columns))

    S.ship(docs.sparkSession)
    levels = docs.mapInArrow(file, "h long, doc_id long, state byte")
    if gone is not None:
        levels = levels.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
    marks = repeated(levels).groupBy("doc_id").agg(F.collect_set("h").alias("marks")).withColumnRenamed("doc_id", "marked_id")
    near = S.stored(docs.join(marks, F.col("doc_id") == F.col("marked_id")).select("doc_id", "text", "marks"), "candidates")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                for i, j in S.by_bytes(texts := b.column("text").to_pylist(), 1_000_000):
                    for k, hg, m in zip(b.column("doc_id")[i:j].to_pylist(), S.hashed_texts(texts[i:j]), b.column("marks")[i:j]):
                        at = np.flatnonzero(np.isin(filed(hg[0], short, length)[0], m.values.to_numpy().view(np.uint64)))
                        wide = named(hg, length)
                        if once:
                            at = at[S.distinct(wide[0][at], wide[1][at])]
                        yield S.signed(wide[0][at]), S.signed(wide[1][at]), np.full(len(at), k, np.int64), at.astype(np.int32)

        for h, g, d, at in gathered(windows(), 1 << 19):
            if not once:
                yield S.batch(AT, h, g, d, at)
                continue
            order = np.lexsort((d, g, h))
            a, b, c = h[order], g[order], d[order]
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            state = np.empty(len(h), np.int8)
            state[order] = np.where(c > np.repeat(c[starts], np.diff(np.append(starts, len(c)))), KNOWN, OPEN)
            yield S.batch(AT_ONCE, h, g, d, state)

    return near, near.mapInArrow(extend, "h long, g long, doc_id long, " + ("state byte" if once else "at int"))


def repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id and longest: the longest of length, 2 * length, 4 * length, ... at which a window of the document stands
    in another document too; documents without any don't occur.

    A window of twice the length is named by the names of its halves, so no level but the first reads a text. Only
    windows that repeat go to the next level; it ends when none are left.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, rows = candidates(docs, length, (length + 1) // 2)
    found = None
    while True:
        groups = rows.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "g")
        rows = S.stored(rows.join(groups, ["h", "g"], "left_semi"), "level")
        if not rows.take(1):
            break
        level = rows.select("doc_id", F.lit(length).alias("longest")).distinct()
        found = level if found is None else found.unionAll(level)
        after = rows.select("doc_id", (F.col("at") - length).alias("at"), F.col("h").alias("h2"), F.col("g").alias("g2"))
        rows = rows.join(after, ["doc_id", "at"]).select(F.xxhash64("h", "h2").alias("h"), F.xxhash64("g", "g2", F.lit(1)).alias("g"), "doc_id", "at")
        length *= 2
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, longest int")
    return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))


def deduplicated(docs: DataFrame, length: int = 13, short: int | None = None, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text, if asked for) of each document (doc_id, text).

    A word is removed if a window of `length` words covers it whose words also start in a document with a smaller
    doc_id. Windows are judged on the input. Null texts have no words; null ids are left as they are and make nothing
    else go. Rows that repeat a doc_id are one document for what is earlier, but each is cut by its own text and comes
    out once; nothing of them goes because of another row of that id.
    """
    short = short or (length + 1) // 2
    if not 0 < short <= length <= 2 * short:
        raise ValueError("a level is at most twice as long as the one before")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession

    def digest(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for k, t in zip(b.column("doc_id"), b.column("text")):
            ws = S.words(t.as_py())
            kept = b" ".join(ws)
            name = sha256(kept)
            rows.append((k.as_py(), len(ws), name.hexdigest(), name.digest()[:16] if len(ws) >= length else None, t.as_py() if text else None))
        if rows:
            yield S.batch(DIGEST, *zip(*rows))

    # Documents with the same words as an earlier one lose every word; only the first of each goes on.
    every = S.stored(S.map_arrow(docs, digest, "doc_id long, n_words long, kept_sha256 string, copy binary, own_text string"), "digests")
    named_rows = every.where("copy is not null and doc_id is not null").select("doc_id", "copy")
    first = named_rows.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    gone = S.stored(S.join_groups(named_rows, first, ["copy"], "copies").where("doc_id > first").groupBy("doc_id", "copy").agg(F.count(F.lit(1)).alias("n")), "copies")
    # Of ids that stand in several rows, those go no further whose rows are all copies.
    whole = every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").join(gone.groupBy("doc_id").agg(F.sum("n").alias("n")), "doc_id").where("rows > n").select("doc_id")
    only = gone.join(whole, "doc_id", "left_anti").select(F.col("doc_id").alias("gone_id")).distinct()

    near, rows = candidates(docs, length, short, only, once=True)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by window and document, those after the window's first document; and those known to be."""
        h0 = g0 = d0 = None
        for b in batches:
            h, g, d, state = (b.column(c).to_numpy() for c in ("h", "g", "doc_id", "state"))
            known = state == KNOWN
            if known.any():
                yield S.batch(LATER, d[known], h[known], g[known])
            h, g, d = h[~known], g[~known], d[~known]
            if not len(h):
                continue
            new = np.concatenate([[h[0] != h0 or g[0] != g0], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            run = np.cumsum(new)
            firsts = np.concatenate([[d0 if d0 is not None else 0], d[new]])[run]
            keep = d > firsts
            h0, g0, d0 = int(h[-1]), int(g[-1]), int(firsts[-1])
            if keep.any():
                yield S.batch(LATER, d[keep], h[keep], g[keep])

    dealt = rows.repartition(F.when(F.col("state") == KNOWN, F.xxhash64("doc_id")).otherwise(F.xxhash64("h", "g"))).sortWithinPartitions("h", "g", "doc_id")
    hits = dealt.mapInArrow(later, "doc_id long, h long, g long").groupBy("doc_id").agg(F.collect_set(F.struct("h", "g")).alias("windows")).withColumnRenamed("doc_id", "hit_id")

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for k, t, going in zip(b.column("doc_id"), b.column("text"), b.column("windows")):
            ws = S.words(t.as_py())
            wide = named(S.hashed_words(t.as_py()), length)
            h, g = (going.values.field(c).to_numpy().view(np.uint64) for c in ("h", "g"))
            # The pairs that go are different, so a window's place among them by its first hash is checked by its
            # second.
            order = np.lexsort((g, h))
            starts = np.flatnonzero(np.isin(wide[0], h))
            starts = starts[found_pairs(h[order], g[order], wide[0][starts], wide[1][starts])]
            out = covered(starts, length, len(ws))
            kept = b" ".join(w for w, o in zip(ws, out.tolist()) if not o)
            rows.append((k.as_py(), sha256(b" ".join(ws)).digest()[:16], int(out.sum()), sha256(kept).hexdigest(), kept.decode() if text else None))
        if rows:
            yield S.batch(KEPT, *zip(*rows))

    changed = S.map_arrow(near.drop("marks").join(hits, F.col("doc_id") == F.col("hit_id")).drop("hit_id"), cut, "doc_id long, copy binary, n_removed long, kept_sha256 string, kept_text string")
    empty = sha256(b"").hexdigest()
    changed = changed.unionByName(gone.select("doc_id", "copy", F.lit(None).cast("long").alias("n_removed"), F.lit(empty).alias("kept_sha256"), F.lit("").alias("kept_text")))
    # One row for each different text of an id: rows come out as often as they came in.
    changed = changed.groupBy("doc_id", "copy").agg(F.max(F.struct(F.coalesce("n_removed", F.lit(-1)).alias("n"), "kept_sha256", "kept_text")).alias("r"))
    changed = changed.select(
        F.col("doc_id").alias("changed_id"), F.col("copy").alias("changed_copy"), F.when(F.col("r.n") >= 0, F.col("r.n")).alias("less"),
        F.col("r.kept_sha256").alias("new_sha256"), "r.kept_text"
    )
    out = every.join(changed, (F.col("doc_id") == F.col("changed_id")) & (F.col("copy") == F.col("changed_copy")), "left")
    out = out.select(
        "doc_id", "copy", "n_words", F.when(F.col("changed_id").isNull(), 0).otherwise(F.coalesce("less", "n_words")).alias("n_removed"),
        F.coalesce("new_sha256", "kept_sha256").alias("kept_sha256"), F.coalesce("kept_text", "own_text").alias("kept_text")
    )
    return out.drop("copy", "kept_text") if not text else out.drop("copy")
