"""What the training-data operators share: tables, the shared folder, words and their hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library from the folder the driver has it in."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
        # One thread for tokenizers; freed memory of Python workers goes back to the system.
        for k, v in {
            "TOKENIZERS_PARALLELISM": "false", "ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576",
            "MALLOC_TRIM_THRESHOLD_": "4194304"
        }.items():
            env.setdefault(k, v)
    # Texts vary in length: batches for Python are bounded by bytes, not only by rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of the input."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or the checkpoint directory that the
    session was given.

    Where neither is set, a local master (tests) gets a temporary folder of its own; on a cluster that is a ValueError,
    as no machine's own folder is seen by the others.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"gridwright-{os.getpid()}")
        sc.setCheckpointDir(found)
    if "://" not in found:  # a path of the default file system, which readers outside Spark must know too
        path = sc._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
        found = found.replace(":/", ":///", 1) if "://" not in found else found
    return found.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: list[list[str]] = []  # paths that were given out, for each kept_for that is open


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


def stored_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, and its path. Shuffle files of the job that writes it go when it ends:
    what follows reads the table.
    """
    spark = df.sparkSession
    path, was = fresh(spark, what), spark.conf.get(CLEANUP, None)
    if was is not None:  # else this Spark has no such setting
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is not None:
            spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, and what follows doesn't compute them again."""
    return stored_at(df, what)[0]


@contextmanager
def kept_for(spark: SparkSession) -> Iterator[list[str]]:
    """Gives a list of the tables and folders that are made inside; what it holds at the end is deleted. Results that are
    read later must be written and taken from the list.
    """
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)
        for path in made:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tasks_for(rows: DataFrame) -> int:
    """How many tasks to deal rows of a table to: as many as read it, and no fewer than the session's shuffles have, so
    that a task's share doesn't grow with the table.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Join rows with groups, one for each of their keys, whose column `size` counts the group's rows.

    A key of a large group would send all its rows to one task. Groups of over a ten-thousandth of all rows are
    broadcast: there are fewer than 10,000 of them whatever the data. The rest is dealt by key, never broadcast. Rows
    without a group go.
    """
    least = max(1000, rows.count() // 10_000)
    held = groups.where(F.col(size) > least).drop(size)
    other = [F.col(c).alias(f"large_{c}") for c in keys]
    same = [rows[c] == F.col(f"large_{c}") for c in keys]
    names = held.select(*other)
    cold = rows.join(F.broadcast(names), same, "left_anti").join(groups.where(F.col(size) <= least).drop(size).hint("merge"), keys)
    return rows.join(F.broadcast(held), keys).unionByName(cold)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow by batch; fn yields any number of batches for each."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from fn(b)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sampled(rows: DataFrame, keys: DataFrame) -> list:
    """The rows (doc_id, text, and any others) of a bounded sample of (doc_id, row), row being a hash of the text; one
    of equal rows.
    """
    picked = rows.withColumn("row", F.xxhash64("text")).join(F.broadcast(keys), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    return sorted(picked.collect(), key=lambda r: (r.doc_id, r.row))


def by_bytes(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about so many characters, one text at least: bounds what is in memory."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > most:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def words(text: str | None) -> list[bytes]:
    """The runs of bytes outside x20 and x09-x0D; null has none."""
    return text.encode().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


CHARACTERS = 0xA0761D6478BD642F  # base of polynomials over characters


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; base is odd."""
    up, down = _POWERS.get(base, (None, None))
    if up is None or len(up) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (base, inverse))
        if size <= 1 << 21:
            _POWERS[base] = up, down
    return up[:n], down[:n]


def windows(h: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each run of so many words from the words' hashes: a polynomial of them modulo 2**64, mixed."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(base, len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    return mix((sums[length:] - sums[:n]) * down[:n])


GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
LANE = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)  # masks of so many low bytes
LONG = 64  # longer ranges of bytes are hashed one by one


def spans_hash(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each range of bytes, 128 bits that tell ranges apart.

    Each 8 bytes of a range are mixed into its two states before the next are added, so unlike in a polynomial no
    pattern of letters cancels out. Ranges of more than LONG bytes get XXH3's 128 bits.
    """
    size = ends - starts
    n = size.astype(np.uint64)
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))
    lane = lanes[starts] & LANE[np.minimum(size, 8)]
    h = mix(lane ^ n * np.uint64(0x9E3779B97F4A7C15))
    g = mix((lane ^ np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xFF51AFD7ED558CCD) + n)
    for at in range(8, LONG, 8):
        rows = np.flatnonzero(size > at)
        if not len(rows):
            break
        lane = lanes[starts[rows] + at] & LANE[np.minimum(size[rows] - at, 8)]
        h[rows] = mix(h[rows] ^ lane)
        g[rows] = mix((g[rows] + lane) * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(1))
    for i in np.flatnonzero(size > LONG).tolist():
        whole = xxhash.xxh3_128_intdigest(padded[starts[i] : ends[i]].tobytes())
        h[i], g[i] = whole & 0xFFFFFFFFFFFFFFFF, whole >> 64
    return h, g


def distinct(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The place of the first of each different pair of hashes."""
    order = np.lexsort((g, h))
    first = np.ones(len(order), bool)
    first[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    return order[first]


def hashed_words(text: str | None, lower: bool = False, piece: int = 1 << 19) -> np.ndarray:
    """The two hashes of each of a text's words (a row of each), from its bytes at once; lower: of a text with A-Z in
    lower case.
    """
    raw = text.encode() if text else b""
    raw = raw.lower() if lower else raw
    out, begin = [np.empty((2, 0), np.uint64)], 0
    while begin < len(raw):
        end = len(raw)
        if end - begin > piece:  # cut between words
            cut = next((k for k in range(begin + piece, min(end, begin + 2 * piece)) if GAP[raw[k]]), None)
            end = cut if cut is not None else end
        b = np.frombuffer(raw, np.uint8, end - begin, begin)
        edge = np.flatnonzero(np.diff(GAP[b], prepend=True, append=True))
        out.append(np.stack(spans_hash(b, edge[::2], edge[1::2])))
        begin = end
    return np.concatenate(out, axis=1) if len(out) > 2 else out[-1]


def hashed_texts(texts: list, lower: bool = False, group: int = 1 << 17) -> Iterator[np.ndarray]:
    """hashed_words of each text; short ones are hashed many at once."""
    i = 0
    while i < len(texts):
        raws: list[bytes] = []
        size = 0
        while i < len(texts) and size < group:
            raws.append((texts[i] or "").encode())
            size += len(raws[-1]) + 1
            i += 1
        if len(raws) == 1:
            yield hashed_words(texts[i - 1], lower)
            continue
        raw = b"\n".join(raws)
        b = np.frombuffer(raw.lower() if lower else raw, np.uint8)
        edge = np.flatnonzero(np.diff(GAP[b], prepend=True, append=True))
        h = np.stack(spans_hash(b, edge[::2], edge[1::2]))
        ends = np.searchsorted(edge[::2], np.cumsum([len(r) + 1 for r in raws])).tolist()
        yield from (h[:, a:e] for a, e in zip([0, *ends], ends))


class Parts:
    """Ids of text parts, found by 128-bit hashes in an open table of arrays; the ids stand in one pool, so those of a
    batch are gathered at once. Far smaller than a dictionary of objects.
    """

    def __init__(self, kind: str, most: int):
        self.kind, self.most = np.dtype(kind), most
        self.mask = (1 << (2 * most - 1).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = (np.zeros(self.mask + 1, np.uint64) for _ in range(2))  # a key of 0: free
        self.entry = np.zeros(self.mask + 1, np.int32)
        self.offset, self.length, self.entries = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.pool, self.used = np.zeros(1 << 18, self.kind), 0

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The entries of pairs of hashes (h is never 0), -1 where there is none."""
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        held = self.keys[slot]
        same = (held == h) & (self.checks[slot] == g)
        out = np.where(same, self.entry[slot], -1)
        go = np.flatnonzero(~same & (held != 0))
        while len(go):
            slot[go] = (slot[go] + 1) & self.mask
            held = self.keys[slot[go]]
            same = (held == h[go]) & (self.checks[slot[go]] == g[go])
            out[go[same]] = self.entry[slot[go[same]]]
            go = go[~same & (held != 0)]
        return out

    def insert(self, h: np.ndarray, g: np.ndarray, entry: np.ndarray) -> None:
        """File different pairs of hashes that aren't in the table."""
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of several for one slot the last stays
            self.checks[slot[free]] = g[free]
            mine = free & (self.keys[slot] == h) & (self.checks[slot] == g)
            self.entry[slot[mine]] = entry[mine]
            h, g, slot, entry = h[~mine], g[~mine], (slot[~mine] + 1) & self.mask, entry[~mine]

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Append ids to the pool, as entries of these lengths; returns their numbers."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.entries + len(lengths) > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        self.pool[self.used : self.used + len(ids)] = ids
        at = np.arange(self.entries, self.entries + len(lengths))
        self.offset[at], self.length[at] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)
        self.entries += len(lengths)
        return at

    def gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries in a row, and where each one's end."""
        sizes = self.length[entry].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.offset[entry] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
