"""WARC archives: a writer that stores each payload once, and a Python data source that reads them.

An archive is a row of gzip members, one for each record, as WARC readers expect. Each member's gzip header carries its
compressed length in an extra field (subfield "sl"), so a reader can inflate a record's first bytes, read its headers
and, where the record isn't wanted, go to the next member without inflating the payload. Members without that field are
inflated to their end.

The data source plans one partition for each file, or several small files; it takes equality and IN filters on
record_type and equality, IN and prefix filters on target_uri from Spark, tests them on a record's headers, and inflates
and decodes a payload only if the record passes and the query reads the columns `payload` or `payload_ok`.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from . import _shared as S

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LISTED = "_archives.json"  # the names of a folder's archives that count
HEAD = 4096  # inflated at first; more follows while headers go on

SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("warc_date", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_ok", T.BooleanType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that knows its own compressed length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    """A header value in one line."""
    return " ".join(value.split()) if any(c in value for c in "\r\n") else value


def record(kind: str, ident: str, uri: str | None, payload: bytes, payload_digest: str, size: int, date: str, refers_to: str | None = None) -> bytes:
    """A response or revisit record. Both hold the HTTP head with the full payload's length; only a response holds the
    payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_clean(uri)}"] if uri else []
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}"]
    lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def deduplicated(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """key, url, payload, digest, refers_to of pages (page_id, url, html).

    Of the rows whose payloads are equal and of at least so many bytes, the one with the largest page_id is the response
    and the others refer to it. A null html is an empty payload; rows that repeat a page_id with the same payload are
    all responses; a null page_id is smaller than any other, and rows that have only null ids are all responses.
    Payloads are compared by SHA-1 and length. Only digests are grouped and joined; the payloads are dealt once, by
    page_id, which no group of copies makes uneven.
    """
    # The digest as a column of Spark; base 32 follows where records are written.
    marked = pages.select(F.col("page_id").cast("long").alias("key"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    small = marked.select("key", F.sha1("payload").alias("sha1"), F.length("payload").alias("size"))
    groups = small.where(F.col("size") >= smallest).groupBy("sha1", "size").agg(F.max("key").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and top is not null")
    # A payload that many pages share, the empty one say, is no task's alone.
    later = S.join_groups(small.where(F.col("size") >= smallest), groups, ["sha1", "size"], "copies").where("key < top").select("key", "sha1", "top").distinct()
    later = later.withColumnsRenamed({"key": "later_key", "sha1": "later_sha1"})
    rows = marked.withColumn("sha1", F.sha1("payload"))
    joined = rows.where("key is not null").join(later, (F.col("key") == F.col("later_key")) & (F.col("sha1") == F.col("later_sha1")), "left")
    lost = rows.where("key is null").join(groups.select(F.col("sha1").alias("later_sha1"), "top"), F.col("sha1") == F.col("later_sha1"), "left")
    return joined.select("key", "url", "payload", "sha1", F.col("top").alias("refers_to")).unionByName(lost.select("key", "url", "payload", "sha1", F.col("top").alias("refers_to")))


def ident(key: int | None) -> str:
    return f"urn:page:{key}" if key is not None else f"urn:uuid:{uuid.uuid4()}"


def write_archives(pages: DataFrame, folder: str, smallest: int = 0, roll: int = 256 << 20, date: str = "2024-01-01T00:00:00Z") -> list[str]:
    """Write pages as archives in the folder; returns the files. A task rolls to a new file at so many bytes. Files of
    lost or repeated tasks may be left in the folder; a list beside the archives names those that count, and the reader
    takes no others.
    """
    S.ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pafs.FileSystem.from_uri(folder)
        sink, names = None, []
        for b in batches:
            for key, url, payload, sha1, top in zip(*(b.column(c) for c in ("key", "url", "payload", "sha1", "refers_to"))):
                if sink is None:
                    names.append(f"{base}/{uuid.uuid4().hex}.warc.gz")
                    sink = where.open_output_stream(names[-1], compression=None, buffer_size=1 << 20)
                data = payload.as_py()
                top = top.as_py()
                sink.write(
                    member(
                        record(
                            "response" if top is None else "revisit", ident(key.as_py()), url.as_py(), data,
                            base64.b32encode(bytes.fromhex(sha1.as_py())).decode(), len(data), date, None if top is None else ident(top)
                        )
                    )
                )
                if sink.tell() >= roll:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        if names:
            yield pa.RecordBatch.from_pydict({"path": names})

    where, base = pafs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    names = sorted(r.path for r in deduplicated(pages, smallest).mapInArrow(write, "path string").collect())
    with where.open_output_stream(f"{base}/{LISTED}") as sink:
        sink.write(json.dumps([n.rsplit("/", 1)[1] for n in names]).encode())
    return names


def headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return out


class _Source:
    """Reads a file forward in pieces, and can jump."""

    def __init__(self, file, size: int, piece: int = 1 << 20):
        self.file, self.size, self.piece, self.base, self.held = file, size, piece, 0, b""

    def at(self, offset: int, least: int) -> bytes:
        """Bytes from an offset on, at least so many unless the file ends."""
        if not self.base <= offset <= offset + least <= self.base + len(self.held):
            self.file.seek(offset)
            self.base, self.held = offset, self.file.read(max(self.piece, least))
        return self.held[offset - self.base :] if offset > self.base else self.held


def records(file, size: int, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], dict[str, str], bytes | None, int]]:
    """(record headers, HTTP headers, payload or None, bytes of payload decoded) of the records for which
    wanted(headers) holds.
    """
    source, offset = _Source(file, size), 0
    while offset < size:
        raw = source.at(offset, 4096)
        plain = raw[:2] != b"\x1f\x8b"
        length = None
        if not plain and raw[3] & 4:
            (n,) = struct.unpack_from("<H", raw, 10)
            k = 12
            while k < 12 + n:
                tag, m = raw[k : k + 2], struct.unpack_from("<H", raw, k + 2)[0]
                if tag == b"sl":
                    length = struct.unpack_from("<I", raw, k + 4)[0]
                k += 4 + m
        if plain:
            head, z, taken = raw, None, 0
        else:
            z = zlib.decompressobj(31)
            head, taken = z.decompress(raw[:HEAD], HEAD), min(HEAD, len(raw))
        while (cut := head.find(b"\r\n\r\n")) < 0:
            more = source.at(offset + taken, 1 << 16)[: 1 << 16] if z else source.at(offset, 2 * len(head))
            if not more or (not z and len(more) == len(head)):
                raise ValueError("a record's headers don't end")
            head, taken = (head + z.decompress(z.unconsumed_tail + more), taken + len(more)) if z else (more, 0)
        h = headers(head[:cut])
        block, total = int(h.get("content-length", 0)), cut + 8 + int(h.get("content-length", 0))
        ok = wanted(h)
        body = None
        if ok or (z and length is None):
            # The HTTP head stands at the block's start; the payload is inflated only if asked for, or to find the
            # member's end.
            need = total if payloads and ok or length is None else min(total, cut + 4 + 1024)
            while len(head) < need and z:
                part = z.decompress(z.unconsumed_tail, need - len(head)) if z.unconsumed_tail else b""
                if not part:
                    more = source.at(offset + taken, 1)[: 1 << 18]
                    if not more:
                        break
                    part, taken = z.decompress(more, need - len(head)), taken + len(more)
                head += part
            if not z:
                head = source.at(offset, total)[:total]
            body = head[cut + 4 : cut + 4 + block]
        if z and length is None:
            while not z.eof:
                more = z.unconsumed_tail or source.at(offset + taken, 1)[: 1 << 18]
                if not more:
                    break
                taken += 0 if z.unconsumed_tail else len(more)
                z.decompress(more)
            length = taken - len(z.unused_data)
        offset += length if z else total
        if ok:
            end = body.find(b"\r\n\r\n") if body[:5] == b"HTTP/" else -4
            yield h, headers(body[:end]) if end >= 0 else {}, body[end + 4 :] if payloads else None, block


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.folder, self.each = options["path"], int(options.get("bytesPerPartition", 32 << 20))
        self.columns = schema.names
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = {("record_type",): "warc-type", ("target_uri",): "warc-target-uri"}
        for f in filters:
            name = names.get(getattr(f, "attribute", None))
            if name and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((name, "starts" if isinstance(f, StringStartsWith) else "in", tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        where, base = pafs.FileSystem.from_uri(self.folder)
        out, size = [], 0
        found = sorted(where.get_file_info(pafs.FileSelector(base)), key=lambda f: f.path)
        listed = None
        if any(f.base_name == LISTED for f in found):
            with where.open_input_file(f"{base}/{LISTED}") as source:
                listed = set(json.loads(source.read()))
        for f in found:
            if f.is_file and f.path.endswith((".warc", ".warc.gz")) and (listed is None or f.base_name in listed):
                if not out or size + f.size > self.each:
                    out, size = [*out, Files([])], 0
                out[-1].paths.append(f.path)
                size += f.size
        return out

    def wanted(self, h: dict[str, str]) -> bool:
        return all((v := h.get(name)) is not None and (v in values if how == "in" else v.startswith(values[0])) for name, how, values in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = pafs.FileSystem.from_uri(self.folder)
        payloads = bool({"payload", "payload_ok"}.intersection(self.columns))
        rows, held = [], 0
        schema = pa.schema([(c, {"payload": pa.binary(), "payload_bytes": pa.int64(), "payload_ok": pa.bool_()}.get(c, pa.string())) for c in self.columns])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{c: r.get(c) for c in self.columns} for r in rows], schema=schema)

        for path in partition.paths if partition else ():  # Spark reads once without a partition if there are none
            with where.open_input_file(path) as file:
                for h, http, payload, block in records(file, file.size(), self.wanted, payloads):
                    said = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    full = payload is not None and h.get("warc-type") == "response"
                    rows.append(
                        {
                            "record_id": h.get("warc-record-id", "").strip("<>"), "record_type": h.get("warc-type"),
                            "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"), "payload_digest": said,
                            "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None,
                            "payload_bytes": int(http.get("content-length", block)),
                            "payload_ok": digest(payload) == said if full and "payload_ok" in self.columns else None,
                            "payload": payload if full else None
                        }
                    )
                    held += len(payload or b"") + 200
                    if held > 8 << 20:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()


class WarcSource(DataSource):
    """spark.read.format("warc").schema(columns wanted).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options, schema)


def read_archives(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The records of a folder's archives; the columns wanted decide what is decoded."""
    S.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(T.StructType([f for f in SCHEMA if not columns or f.name in columns])).load(folder)


def archived(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) to archives and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. No rows for an empty table.
    """
    spark = pages.sparkSession
    folder = S.fresh(spark, "warc")
    write_archives(pages, folder, smallest)
    read = read_archives(spark, folder, "record_id", "record_type", "payload_digest", "refers_to", "payload_bytes").where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.when(F.col(c).startswith("urn:page:"), F.substring(c, 10, 30).cast("long"))
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
