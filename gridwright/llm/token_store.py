"""Token ids as binary shards: one concatenated id array and Elias-Fano coded document boundaries.

A shard file holds, in this order: the ids (unsigned, little endian, 2 or 4 bytes each) of its documents one after
another; the documents' keys as 64-bit integers; the low bits and the high bits of the boundaries; select samples of the
high bits; a JSON footer, its length as 4 bytes and the magic. Boundaries are the running totals of ids, n numbers up to
u: each keeps floor(log2(u/n)) low bits as they are, and its high part in unary, about 2 + log2(u/n) bits a document, so
there is no table of 64-bit offsets. select(i) starts at the sample before i and scans a few bytes.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

MAGIC = b"GWEF0001"
SAMPLE = 256  # a select sample for each so many documents
PIECE = 1 << 13
ROLL = 256 << 20  # a shard ends at so many bytes of ids,
MOST = 4 << 20  # or so many documents


class EliasFano:
    """A sequence that never falls, of n numbers from 0 to top."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        places = np.arange(width, dtype=np.uint64)
        # Bits are spread out for a few thousand numbers at a time, a multiple of 8, so each piece ends with a whole
        # byte.
        pieces = [np.packbits(((values[i : i + PIECE, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, PIECE)]
        low = np.concatenate(pieces) if pieces else np.empty(0, np.uint8)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) // 8 + 1) if n else 0, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return cls(n, width, low, high, ones[::SAMPLE].astype(np.uint32 if not n or ones[-1] < 1 << 32 else np.uint64))

    def lows(self, i: int, j: int) -> np.ndarray:
        a, b = i * self.width, j * self.width
        bits = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a]
        return bits.reshape(j - i, self.width).astype(np.uint64) @ (np.uint64(1) << np.arange(self.width, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th number."""
        return int(self.range(i, i + 1)[0])

    def range(self, i: int, j: int) -> np.ndarray:
        """The numbers from the i-th up to the j-th."""
        if i >= j:
            return np.empty(0, np.uint64)
        start = int(self.samples[i // SAMPLE])
        last = (j - 1) // SAMPLE + 1
        stop = int(self.samples[last]) + 1 if last < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[start >> 3 : (stop + 7) >> 3], bitorder="little")
        bits[: start & 7] = 0
        ones = np.flatnonzero(bits)[i % SAMPLE :][: j - i] + (start >> 3) * 8
        return ((ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.width)) | self.lows(i, j)


def write_shard(sink, documents: Iterator[tuple[int | None, bytes]], item: int, roll: int = ROLL, most: int = MOST) -> dict:
    """Write documents (key, ids as bytes) in the order given, until the shard is full; returns how many documents and
    ids it has. Ids are streamed; of a document only its key and its count are held, 16 bytes.
    """
    keys, counts, nulls, size = array("q"), array("q"), 0, 0
    for key, ids in documents:
        sink.write(ids)
        nulls += key is None
        keys.append(0 if key is None else key)
        counts.append(len(ids) // item)
        size += len(ids)
        if size >= roll or len(keys) >= most:
            break
    ends = EliasFano.of(np.cumsum(np.frombuffer(counts, np.int64)).astype(np.uint64))
    parts = [np.frombuffer(keys, "<i8"), ends.low, ends.high, ends.samples]
    for p in parts:
        sink.write(p.tobytes())
    foot = json.dumps({"n": ends.n, "ids": size // item, "item": item, "nulls": nulls, "width": ends.width, "sizes": [p.nbytes for p in parts], "sample": parts[3].dtype.str}).encode()
    sink.write(foot + struct.pack("<I", len(foot)) + MAGIC)
    return {"n": ends.n, "ids": size // item}


class Shard:
    """Reads a shard; source is a seekable binary file."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 12)
        length, magic = struct.unpack("<I8s", source.read(12))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(size - 12 - length)
        f = self.foot = json.loads(source.read(length))
        source.seek(size - 12 - length - sum(f["sizes"]))
        raw = [source.read(k) for k in f["sizes"]]
        self.keys = np.frombuffer(raw[0], "<i8")
        self.ends = EliasFano(f["n"], f["width"], np.frombuffer(raw[1], np.uint8), np.frombuffer(raw[2], np.uint8), np.frombuffer(raw[3], f["sample"]))

    def __len__(self) -> int:
        return self.foot["n"]

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i's ids begin and end in the shard's id array."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, start: int, stop: int) -> np.ndarray:
        item = self.foot["item"]
        self.source.seek(start * item)
        return np.frombuffer(self.source.read((stop - start) * item), f"<u{item}")

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, where its ids begin in the shard, ids) of every document, about `most` ids in memory at once."""
        i, begin = 0, 0
        while i < len(self):
            ends = self.ends.range(i, min(len(self), i + 4096)).astype(np.int64)
            k = max(1, int(np.searchsorted(ends, begin + most, "right")))
            ends = ends[:k]
            ids, at = self.ids(begin, int(ends[-1])), begin
            for j, end in enumerate(ends.tolist()):
                yield (None if i + j < self.foot["nulls"] else int(self.keys[i + j])), at, ids[at - begin : end - begin]
                at = end
            i, begin = i + k, at


class WordTokens:
    """Ids of a byte-level BPE file of the tokenizers library.

    Its pre-tokenizer never joins what stands before a single space with what follows: a text is its first part and then
    parts that begin with a space, each encoded by itself, and the library need encode each different part only once
    (parts are told apart by 128-bit hashes). Where white space stands on both sides of a space, or two spaces together,
    its rule looks across them; such texts go to the library whole, and so do texts that hold an added token.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.item = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.item}")
        self.opens = np.array([(t := self.library.id_to_token(i)) is not None and t.startswith("Ġ") for i in range(self.library.get_vocab_size())])
        self.spaced = re.compile(r"[^\S ] [^\S ]").search
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        self.parts = S.Parts(self.kind, most)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, h: np.ndarray, g: np.ndarray, parts: list[str]) -> None:
        """Encode new parts, each given without its space. Those that begin with no white space go to the library many
        in a text: each begins at an id that begins with a space. The rest go one by one.
        """
        plain = [i for i, p in enumerate(parts) if p and not p[0].isspace()]
        rest = [i for i, p in enumerate(parts) if not p or p[0].isspace()]
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            ids = self.whole([" " + " ".join(parts[i] for i in some)])[0]
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some):
                self.parts.insert(h[some], g[some], self.parts.add(ids, np.diff(np.append(starts, len(ids)))))
            else:
                rest += some
        if rest:
            lists = self.whole([" " + parts[i] for i in rest])
            self.parts.insert(h[rest], g[rest], self.parts.add(np.concatenate(lists), np.array([len(x) for x in lists])))

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        table = self.parts
        if table.entries > table.most:
            table.clear()
        alone = ["  " in t or self.spaced(t) is not None or self.added(t) is not None for t in texts]
        raw = b" ".join(b"" if x else t.encode() for t, x in zip(texts, alone))
        b = np.frombuffer(raw, np.uint8)
        gaps = np.flatnonzero(b == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(b))
        counts = np.array([1 if x else t.count(" ") + 1 for t, x in zip(texts, alone)])
        firsts = np.cumsum(counts) - counts
        h, g = S.spans_hash(b, starts, ends)
        h[h == 0] = 1
        entry = table.find(h, g)
        lost = entry < 0
        lost[firsts] = False
        if lost.any():
            at = np.flatnonzero(lost)
            at = at[S.distinct(h[at], g[at])]
            self.learn(h[at], g[at], [raw[i:j].decode() for i, j in zip(starts[at].tolist(), ends[at].tolist())])
            entry[lost] = table.find(h[lost], g[lost])
        kept = table.entries, table.used
        # First parts have no space before them, and texts that stand alone are all first part: entries for this batch
        # only.
        lists = self.whole([t if x else t.partition(" ")[0] for t, x in zip(texts, alone)])
        entry[firsts] = table.add(np.concatenate(lists), np.array([len(x) for x in lists], np.int32))
        ids, ends = table.gather(entry)
        table.entries, table.used = kept
        stops = ends[firsts + counts - 1].tolist()
        return [ids[i:j] for i, j in zip([0, *stops], stops)]


_TOKENIZERS: dict[str, WordTokens] = {}


def tokens(path: str) -> WordTokens:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokens(path)
    return _TOKENIZERS[path]


SHARD = pa.schema([("path", pa.string()), ("part", pa.int32()), ("place", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", roll: int = ROLL) -> list:
    """Encode every text and write the ids, each document's followed by end_id, as shards in ascending order of the key.

    Null texts are empty; null keys come first; rows of one key keep no particular order; added tokens in a text are
    found as the library finds them. Texts are dealt by ranges of the key and sorted before they are encoded; a task
    writes shards of bounded size one after the other, so what a worker holds doesn't grow with its range. It writes
    under names of its own, and only the names that successful tasks return count, so a lost or repeated task leaves
    nothing behind that is read. Returns the shards in order, one small row for each: path, n_docs, n_ids, base (ids
    before it).
    """
    spark = docs.sparkSession
    S.ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(parts, F.asc_nulls_first("key")).sortWithinPartitions(F.asc_nulls_first("key"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pafs.FileSystem.from_uri(folder)
        encoder, part = tokens(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{encoder.item}").tobytes()

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for b in batches:
                texts, keys = b.column("text").to_pylist(), b.column("key").to_pylist()
                for i, j in S.by_bytes(texts, 500_000):
                    for k, ids in zip(keys[i:j], encoder.of([t or "" for t in texts[i:j]])):
                        yield k, ids.tobytes() + end

        stream, place = documents(), 0
        while (first := next(stream, None)) is not None:
            path = f"{base}/{uuid.uuid4().hex}.gwt"
            with where.open_output_stream(path, compression=None, buffer_size=1 << 20) as sink:
                made = write_shard(sink, itertools.chain([first], stream), encoder.item, roll)
            yield S.batch(SHARD, [path], [part], [place], [made["n"]], [made["ids"]])
            place += 1

    where, base = pafs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    # Ranges ascend with the number of their partition.
    shards = sorted(dealt.mapInArrow(write, "path string, part int, place int, n_docs long, n_ids long").collect(), key=lambda r: (r.part, r.place))
    out, total = [], 0
    for r in shards:
        out.append((r.path, r.n_docs, r.n_ids, total))
        total += r.n_ids
    return out


def read_tokens(spark, folder: str, shards: list) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers). A task for each shard; ids are read in pieces.
    """
    S.ship(spark)
    listed = spark.createDataFrame(shards, "path string, n_docs long, n_ids long, base long").repartition(max(1, len(shards)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                rows = []
                with where.open_input_file(r["path"]) as source:
                    for key, at, ids in Shard(source, source.size()).documents():
                        rows.append((key, r["base"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield S.batch(READ, *zip(*rows))
                            rows = []
                if rows:
                    yield S.batch(READ, *zip(*rows))

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write documents (doc_id, text) as token shards in the shared folder and read them back; no rows for an empty
    table.
    """
    folder = S.fresh(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, tokenizer, end_id))
