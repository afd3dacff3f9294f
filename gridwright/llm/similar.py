"""Near-duplicate documents by exact similarity of their shingle sets, found by prefixes of the sets.

Two sets of similarity s or more share a shingle among the first n - ceil(s * n) + 1 of each, in any order that is the
same for all. The order is rare shingles first, so shingles that many documents hold seldom stand in a prefix. How often
one occurs is counted in a table of fixed size: shingles that fall on one count only make the order worse. Where sets
meet their sizes and places must allow the overlap; then the sets themselves are compared. SimHash links, verified in
the same way, come first: sets that they join already make no pairs, so large groups of near copies stay small.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from . import graph, line_dedup, simhash

CELLS, PARTS = 1 << 20, 64
FEW = 64  # sets under one key whose pairs are listed; more meet in blocks
BLOCK = 256
OFTEN = 4096  # documents on a count, and 16 times the mean count, over which its shingles go to blocks at once
MARKED = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("fp", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
ROW = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])
MEETING = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("part", pa.int64())])
SET = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])


def sets(texts: list, size: int) -> Iterator[np.ndarray]:
    """The different hashes of each text's runs of so many words, lower-cased in A-Z, ascending; of all words, if there
    are fewer.
    """
    for i, j in S.by_bytes(texts):
        for h, _ in S.hashed_texts(texts[i:j], lower=True):
            yield np.unique(S.windows(h, min(size, len(h)))) if len(h) else np.empty(0, np.uint64)


def name(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def similarity(a: np.ndarray, b: np.ndarray) -> Fraction:
    """Of two sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return Fraction(both, len(a) + len(b) - both) if len(a) + len(b) else Fraction(1)


def prefix(shingles: np.ndarray, counts: np.ndarray, least: Fraction) -> np.ndarray:
    """The rarest shingles, as many as any set of that similarity must share one of."""
    order = np.lexsort((shingles, counts[(shingles & np.uint64(CELLS - 1)).astype(np.int64)]))
    n = len(shingles)
    return shingles[order[: n - -(-n * least.numerator // least.denominator) + 1]] if n else shingles


def met(ids: np.ndarray, n: np.ndarray, at: np.ndarray, part: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different sets that share a key and whose sizes and places allow the similarity; none of sets
    that are joined already.
    """
    p, q = least.numerator, least.denominator
    size, place = n.astype(np.int64), at.astype(np.int64)
    a, b = [], []
    for k in range(len(ids) - 1):
        m, left = size[k + 1 :], np.minimum(size[k] - place[k], size[k + 1 :] - place[k + 1 :])
        ok = (part[k + 1 :] != part[k]) & (np.minimum(m, size[k]) * q >= p * np.maximum(m, size[k])) & (left * (p + q) >= p * (m + size[k]))
        near = np.flatnonzero(ok) + k + 1
        a.append(np.full(len(near), k))
        b.append(near)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))


def marked(docs: DataFrame, size: int) -> DataFrame:
    """A table: doc_id, id (the name of its set) and fp (its SimHash) of each document; and, with a null id, counts: how
    many documents' shingles fall on each of CELLS counts, in PARTS pieces from each task.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CELLS, np.int64)
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            for i, j in S.by_bytes(texts):
                found = []
                for x in sets(texts[i:j], size):
                    np.add.at(out, (x & np.uint64(CELLS - 1)).astype(np.int64), 1)
                    found.append((name(x), simhash.fingerprint(x)))
                none = [None] * len(found)
                yield S.batch(MARKED, ids.slice(i, j - i), S.signed(np.array([x for x, _ in found], np.uint64)), [x for _, x in found], none, none)
        none = [None] * PARTS
        yield S.batch(MARKED, none, none, none, list(range(PARTS)), [x.tobytes() for x in np.split(out, PARTS)])

    return S.stored(docs.mapInArrow(mark, "doc_id long, id long, fp long, part int, counts binary"), "marked")


def counted(rows: DataFrame) -> np.ndarray:
    """The sums of tasks' counts (part, counts). A task adds them up one after another and holds one piece."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for b in batches:
            for k, raw in zip(b.column("part").to_pylist(), b.column("counts")):
                if k != part:
                    if part is not None:
                        yield S.batch(schema, [part], [total.tobytes()])
                    part, total = k, np.zeros(CELLS // PARTS, np.int64)
                total += np.frombuffer(raw.as_buffer(), np.int64)
        if part is not None:
            yield S.batch(schema, [part], [total.tobytes()])

    out = np.zeros((PARTS, CELLS // PARTS), np.int64)
    for r in rows.repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(add, "part int, counts binary").collect():
        out[r.part] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def sets_of(ids: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame | None:
    """id, shingles of set names (a column `id`, different ones), a table; None if there are none. Of the documents only
    those are hashed again that stand for one of these sets, but for a few that pass the filter.
    """
    wanted = S.stored(ids.join(nodes.select("id", "doc_id"), "id"), "wanted")
    bits = line_dedup.filter_of(wanted, *line_dedup.id_spots(F.col("doc_id")))
    if bits is None:
        return None
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def fetch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = b.filter(pa.array(held.value.passes(b.column("p").to_numpy(), b.column("q").to_numpy())))
        texts = rows.column("text").to_pylist()
        for i, j in S.by_bytes(texts):
            found = list(sets(texts[i:j], size))
            yield S.batch(SET, S.signed(np.array([name(x) for x in found], np.uint64)), [x.tobytes() for x in found])

    spots = [c.alias(n) for c, n in zip(line_dedup.id_spots(F.col("doc_id")), "pq")]
    own = S.map_arrow(docs.select("text", *spots), fetch, "id long, shingles binary")
    return S.stored(own.join(wanted.select("id").hint("shuffle_hash"), "id", "left_semi").groupBy("id").agg(F.min("shingles").alias("shingles")), "sets")


def verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Those of pairs (a, b) of set names whose sets (id, shingles) are that similar."""
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def verify(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ok = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= least for x, y in zip(b.column("left"), b.column("right"))]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return S.map_arrow(both, verify, "a long, b long")


def meetings(rows: DataFrame, least: Fraction) -> DataFrame:
    """A table: pairs (a, b) of sets that meet under a key of few sets; and, with null a, the rows of keys of more than
    FEW, which aren't gathered here, and those that are marked as of such keys (at is -1 less the place), which aren't
    even dealt by key.
    """

    names = ("key", "id", "n", "at", "part")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = [np.empty(0, np.int64)] * 5  # rows of the last key, which may go on
        many = None  # a key that has too many

        def over(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(rows[0]):
                none = pa.nulls(len(rows[0]), pa.int64())
                yield S.batch(MEETING, none, none, *rows)

        def tell(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Of whole runs of keys."""
            starts, pairs, many = graph.runs(rows[0]), [], np.zeros(len(rows[0]), bool)
            for s in np.flatnonzero(np.diff(starts) > 1).tolist():
                i, j = int(starts[s]), int(starts[s + 1])
                ids, first = np.unique(rows[1][i:j], return_index=True)
                if len(ids) > FEW:
                    many[i:j] = True
                    continue
                a, b = met(ids, *(x[i:j][first] for x in rows[2:]), least)
                pairs.append(np.stack([ids[a], ids[b]]))
            if pairs and (both := np.concatenate(pairs, axis=1)).shape[1]:
                none = [pa.nulls(both.shape[1], f.type) for f in list(MEETING)[2:]]
                yield S.batch(MEETING, both[0], both[1], *none)
            yield from over([x[many] for x in rows])

        for b in batches:
            every = [b.column(c).to_numpy() for c in names]
            often = every[3] < 0
            yield from over([np.where(often, -1 - x, x)[often] if k == 3 else x[often] for k, x in enumerate(every)])
            rows = [np.concatenate([x, y[~often]]) for x, y in zip(open_, every)]
            if not len(rows[0]):
                continue
            if many is not None:
                cut = int(np.argmax(rows[0] != many)) if (rows[0] != many).any() else len(rows[0])
                yield from over([x[:cut] for x in rows])
                rows = [x[cut:] for x in rows]
                if not len(rows[0]):
                    open_ = rows
                    continue
                many = None
            cut = int(graph.runs(rows[0])[-2])
            yield from tell([x[:cut] for x in rows])
            open_ = [x[cut:] for x in rows]
            if len(open_[0]) > 64 * FEW:
                yield from over(open_)
                open_, many = [x[:0] for x in open_], int(open_[0][0])
        yield from tell(open_)

    dealt = rows.select(*names).repartition(F.when(F.col("at") < 0, F.xxhash64("id")).otherwise(F.col("key"))).sortWithinPartitions("key")
    return S.stored(dealt.mapInArrow(meet, "a long, b long, key long, id long, n int, at int, part long"), "met")


def in_blocks(rows: DataFrame, fetch, least: Fraction) -> DataFrame | None:
    """Links (a, b) between similar sets that share a key of many sets (key, id, n, at, part) and aren't joined yet, as
    many as join them in their task; None if there are no such keys. fetch(ids) gives the sets.

    A key's sets are cut into blocks by their names and each two blocks meet in a group of their own, where the sets are
    compared at once: no task holds more than two blocks, and no more links come out than sets went in.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("part").alias("low"), F.max("part").alias("high"))
    sizes = S.stored(sizes.where("low < high").select("key", "blocks"), "large")
    if sizes.isEmpty():
        return None
    rows = S.stored(rows.join(sizes.hint("merge"), "key").dropDuplicates(["key", "id"]), "rows")
    own = fetch(rows.select("id").distinct())
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("group", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select("group", "id", "n", "at", "part")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = graph.Forest()
        for t in graph.whole_runs(batches, "group"):
            group, ids, n, at, part = (t.column(c).to_numpy() for c in ("group", "id", "n", "at", "part"))
            starts, found = graph.runs(group), []
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                label = np.array([joined.find(x) for x in part[i:j].tolist()], np.int64)
                own, raw = part[i:j].tolist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles").slice(i, j - i)]
                for x, y in zip(*(z.tolist() for z in met(ids[i:j], n[i:j], at[i:j], label, least))):
                    if joined.find(own[x]) != joined.find(own[y]) and similarity(raw[x], raw[y]) >= least:
                        joined.link(own[x], own[y])
                        found.append((int(ids[i + x]), int(ids[i + y])))
            if found:
                yield S.batch(graph.PAIR, [min(p) for p in found], [max(p) for p in found])
            if len(joined.parent) > 1_000_000:
                joined = graph.Forest()

    dealt = rows.join(own, "id").select("group", "id", "n", "at", "part", "shingles").repartition("group").sortWithinPartitions("group")
    return S.stored(dealt.mapInArrow(meet, "a long, b long").distinct(), "near")


def grouped(docs: DataFrame, size: int = 5, least: str = "0.8") -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable by pairs of that similarity, its own included) of each
    document (doc_id, text). Documents without words are one group. Rows that repeat a doc_id come out once each, and
    join what their texts join; rows without a doc_id link others, and are in the group of what they link.

    Every text is read and hashed twice, to mark it and to file its prefix; only sets that meet are read once more.
    """
    least = Fraction(least)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    S.ship(docs.sparkSession)
    found = marked(docs, size)
    own = found.where("part is null").select("doc_id", "id", "fp")
    # A row without a doc_id has the filter's hash of a null, as it has in the documents.
    nodes = S.stored(own.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp")), "nodes")
    prints = S.stored(nodes.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    same = nodes.join(prints.toDF("fp", "b"), "fp").select(F.col("id").alias("a"), "b").where("a <> b")

    def fetch(ids: DataFrame) -> DataFrame | None:
        return sets_of(ids, nodes, docs, size)

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = S.stored(pairs.distinct(), "pairs")
        some = fetch(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        return pairs if some is None else S.stored(verified(pairs, some, least), "near")

    near = checked(simhash.hamming_links(prints).unionAll(same))
    parts = graph.components(near)
    labels = S.stored(nodes.join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("part")), "labels")
    cells = counted(found.where("part is not null").select("part", "counts"))
    counts, most = docs.sparkSession.sparkContext.broadcast(cells), max(OFTEN, 16 * cells.mean())

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()  # sets that this task has filed
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in S.by_bytes(texts, 1_000_000):
                keys, ids, sizes, at = [], [], [], []
                for x in sets(texts[i:j], size):
                    if (own := name(x)) in told:
                        continue
                    told.add(own)
                    keys.append(p := prefix(x, counts.value, least))
                    ids.append(np.full(len(p), own, np.uint64))
                    sizes.append(np.full(len(p), len(x), np.int32))
                    at.append(np.arange(len(p), dtype=np.int32))
                if len(told) > 200_000:
                    told.clear()
                if keys:
                    key = np.concatenate(keys)
                    often = counts.value[(key & np.uint64(CELLS - 1)).astype(np.int64)] > most
                    place = np.concatenate(at)
                    yield S.batch(ROW, S.signed(key), S.signed(np.concatenate(ids)), np.concatenate(sizes), np.where(often, -1 - place, place))

    filed = docs.select("text").mapInArrow(file, "key long, id long, n int, at int")
    rows = meetings(filed.join(labels.hint("merge"), "id"), least)
    far = checked(rows.where("a is not null").select("a", "b"))
    more = in_blocks(rows.where("a is null").select("key", "id", "n", "at", "part"), fetch, least)
    links = near.unionAll(far) if more is None else near.unionAll(far).unionAll(more)
    parts = graph.components(links)
    labelled = S.stored(nodes.join(parts, F.col("id") == F.col("node"), "left").select("id", "doc_id", F.coalesce("component", "id").alias("component")), "labels")
    least_ids = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return own.join(labelled.join(least_ids, "component").select("id", "component_id"), "id").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, least: str = "0.8") -> DataFrame:
    """The documents, one of each group: the one with the smallest doc_id. All rows with that id stay, and so do rows
    whose doc_id is null.
    """
    keep = grouped(docs, size, least).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(keep, docs["doc_id"] == keep["kept_id"], "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
