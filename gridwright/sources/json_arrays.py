"""One JSON document as many partitions: the elements of a list in it, or the members of an object, from byte ranges.

Where a range begins, a byte may stand in a string or outside. A first job scans all ranges at once and tells, for both
cases, what a range does to the depth of brackets; a running total over the ranges then gives each one's true beginning,
and the second job cuts the elements out. An element belongs to the range in which the comma or bracket before it
stands, and is read on past the range's end. Nothing of the document passes through the driver but a few numbers a
range, and no element is parsed here.

The document is a file, or a folder of files that make one document: in the order that its file SEGMENTS gives, or else
of their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import located, read_text, ship

BLOCK = 4 << 20  # bytes that a task looks at at once
SPACE = b" \t\n\r"  # fixed values: JSON's white space
STEP = np.zeros(256, np.int64)
STEP[[*b"[{"]], STEP[[*b"]}"]] = 1, -1
MARK = STEP != 0
MARK[[*b",:"]] = True
SEGMENTS = "_segments.json"
NEVER = 1 << 60  # the least depth behind no bracket at all
FOUND = pa.schema([("offset", pa.int64()), ("element", pa.string())])
SCANNED = "offset long, quotes long, step long, least long, step_inside long, least_inside long"


class Document:
    """The bytes of files one after another."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files
        self.size = sum(n for _, n in files)

    @classmethod
    def at(cls, place: str) -> Document:
        """FileNotFoundError if there is nothing; files whose names begin with _ or a dot are none of it."""
        from pyarrow import fs

        where, path = located(place)
        info = where.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(place)
        if info.type == fs.FileType.File:
            return cls([(place, info.size)])
        if where.get_file_info(f"{path}/{SEGMENTS}").is_file:
            return cls([(f"{place.rstrip('/')}/{name}", size) for name, size in json.loads(read_text(f"{place}/{SEGMENTS}"))])
        found = sorted((f for f in where.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "_."), key=lambda f: f.base_name)
        return cls([(f"{place.rstrip('/')}/{f.base_name}", f.size) for f in found])

    def read(self, start: int, end: int) -> bytes:
        out, base = [], 0
        for place, size in self.files:
            if start < base + size and end > base:
                where, path = located(place)
                with where.open_input_file(path) as f:
                    out.append(f.read_at(min(end, base + size) - max(start, base), max(start, base) - base))
            base += size
        return b"".join(out)

    def blocks(self, start: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
        for at in range(start, self.size if end is None else end, BLOCK):
            yield at, self.read(at, min(at + BLOCK, self.size if end is None else end))

    def escaped(self, at: int) -> bool:
        """Whether an odd run of backslashes ends just before a place."""
        run, back = 0, at
        while back:
            before = self.read(max(0, back - 64), back)
            own = len(before) - len(before.rstrip(b"\\"))
            run, back = run + own, back - own
            if own < len(before):
                break
        return run % 2 == 1

    def first(self, start: int = 0) -> tuple[int, bytes]:
        """Where the first byte that isn't white space stands, and that byte; the end and nothing if there is none."""
        for at, raw in self.blocks(start):
            if rest := raw.lstrip(SPACE):
                return at + len(raw) - len(rest), rest[:1]
        return self.size, b""


def marks(raw: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places of brackets, commas and colons; whether an odd number of quotes precedes each; the places of quotes; and
    whether the bytes end in an odd run of backslashes. escaped: whether they follow one.
    """
    b = np.frombuffer(raw, np.uint8)
    quotes = np.flatnonzero(b == 34)
    slashes = np.flatnonzero(b == 92)
    runs = slashes[np.diff(slashes, prepend=-2) > 1] if len(slashes) else slashes
    behind = quotes[(quotes > 0) & (b[quotes - 1] == 92)] if len(slashes) else quotes[:0]
    if len(behind):
        run = runs[np.searchsorted(runs, behind) - 1]
        quotes = np.setdiff1d(quotes, behind[(behind - run + (escaped & (run == 0))) % 2 == 1], assume_unique=True)
    if escaped and len(quotes) and quotes[0] == 0:
        quotes = quotes[1:]
    place = np.flatnonzero(MARK[b])
    left = len(b) - (len(raw.rstrip(b"\\")))
    return place, np.searchsorted(quotes, place) % 2 == 1, quotes, (left + (escaped and left == len(b))) % 2 == 1


@dataclass
class Range(InputPartition):
    start: int
    end: int
    inside: bool = False  # whether it begins in a string
    depth: int = 0  # brackets that are open where it begins
    opens: bool = False  # whether the list's own bracket is its first byte

    def __init__(self, start, end, inside=False, depth=0, opens=False):
        self.start, self.end, self.inside, self.depth, self.opens = start, end, inside, depth, opens


def scan(doc: Document, r: Range) -> tuple:
    """What a range does: quotes in it, change of the depth and its least behind a bracket, if it begins outside a string
    and if inside.
    """
    escaped, quotes, step, least = doc.escaped(r.start), 0, [0, 0], [NEVER, NEVER]
    for _, raw in doc.blocks(r.start, r.end):
        place, odd, found, escaped = marks(raw, escaped)
        b = np.frombuffer(raw, np.uint8)
        for inside in (0, 1):
            moves = STEP[b[place[odd == ((inside + quotes) % 2 == 1)]]]
            if len(moves):
                depths = step[inside] + np.cumsum(moves)
                step[inside], least[inside] = int(depths[-1]), min(least[inside], int(depths.min()))
        quotes += len(found)
    return r.start, quotes, step[0], least[0], step[1], least[1]


def separators(doc: Document, r: Range) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """From a range's beginning to the document's end, by blocks: where the block begins, its bytes, the places in it of
    marks outside strings, and the depth behind each.
    """
    inside, depth, escaped = r.inside, r.depth, doc.escaped(r.start)
    for at, raw in doc.blocks(r.start):
        place, odd, quotes, escaped = marks(raw, escaped)
        place = place[odd == inside]
        depths = depth + np.cumsum(STEP[np.frombuffer(raw, np.uint8)[place]])
        yield at, raw, place, depths
        depth = int(depths[-1]) if len(depths) else depth
        inside ^= len(quotes) % 2 == 1


def lists(doc: Document, r: Range, keys: list[str]) -> Iterator[tuple[int, str]]:
    """Of a range of an object, where lists under these keys begin, and (as "key:1") whether they end in the range too."""
    held = None
    for at, raw, place, depths in separators(doc, r):
        for k in place[depths == 1].tolist():
            c = raw[k : k + 1]
            if at + k >= r.end:
                break
            if held is not None and c == b"]":
                yield held[0], held[1] + ":1"
                held = None
            if c == b":":
                before = doc.read(max(0, at + k - 4096), at + k).rstrip(SPACE)
                name = next((x for x in keys if before.endswith(f'"{x}"'.encode()) and not before[: -len(x) - 2].endswith(b"\\")), None)
                if name is not None:
                    opening, first = doc.first(at + k + 1)
                    if first == b"[":
                        held = opening, name
        if at + len(raw) >= r.end:
            break
    if held is not None:
        yield held[0], held[1] + ":0"


def cut(doc: Document, r: Range, level: int, closing: bytes) -> Iterator[tuple[int, bytes]]:
    """The elements of a range: place and bytes of each. ValueError if one is blank, if the list ends with another
    bracket, or if a list that is the whole document has something behind it.
    """
    begin, lead, parts, n = None, b"", [], 0
    for at, raw, place, depths in separators(doc, r):
        used = 0
        which = (depths == level) & (np.frombuffer(raw, np.uint8)[place] == 44) | (depths == level - 1) & (STEP[np.frombuffer(raw, np.uint8)[place]] == -1)
        hits = place[which].tolist()
        if r.opens and at == r.start:
            hits = [0, *(h for h in hits if h > 0)]
        for k in hits:
            c = raw[k : k + 1]
            ends = c not in b",[{"
            if begin is not None:
                element = b"".join([*parts, raw[used:k]])
                n += 1
                if element.strip(SPACE):
                    yield begin, element
                elif not (ends and lead in (b"[", b"{")):
                    raise ValueError(f"nothing before byte {at + k}")
            parts, used, begin, lead = [], k + 1, None, c
            if ends:
                if c != closing:
                    raise ValueError(f"{c.decode()} at byte {at + k}")
                if level == 1 and doc.first(at + k + 1)[1]:
                    raise ValueError(f"more after the end at byte {at + k}")
                return
            if at + k >= r.end:
                return
            begin = at + k + 1
        if begin is not None:
            parts.append(raw[used:])
        elif at + len(raw) >= r.end:
            return
    if begin is not None:
        raise ValueError("the list doesn't end")


class ElementsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.plan = json.loads(options["plan"])

    def partitions(self) -> list[Range]:
        return [Range(*r) for r in self.plan["ranges"]]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        doc, mode = Document([tuple(f) for f in self.plan["files"]]), self.plan["mode"]
        if mode == "scan":
            yield scan(doc, r)
            return
        if mode == "find":
            yield from lists(doc, r, self.plan["keys"])
            return
        rows, size = [], 0
        for at, raw in cut(doc, r, self.plan["level"], self.plan["closing"].encode()):
            rows.append((at, raw.decode()))
            size += len(raw)
            if size >= BLOCK or len(rows) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)


class JsonElements(DataSource):
    """spark.read.format("json_elements"): what elements() plans and reads."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return SCANNED if json.loads(self.options["plan"])["mode"] == "scan" else "offset long, element string"

    def reader(self, schema) -> ElementsReader:
        return ElementsReader(self.options)


def elements(spark: SparkSession, place: str, kinds: str = "[", keys: tuple[str, ...] = (), size: int | None = None) -> DataFrame:
    """offset and element (its text) of a document's elements.

    kinds: what the document may be, "[" for a list, "{" for an object, of which the members come ("key": value). With
    keys, an object gives the elements of the list under the first of these keys that has one. Another kind of document,
    or one whose brackets and strings don't close, raises ValueError; a missing one FileNotFoundError. A task has about
    `size` bytes (spark.sql.files.maxPartitionBytes, if not given) and the rest of its last element.
    """
    ship(spark)
    spark.dataSource.register(JsonElements)
    doc = Document.at(place)
    opening, kind = doc.first()
    if kind.decode("latin-1") not in [*kinds, *("{" if keys else "")] or not kind:
        raise ValueError(f"{place}: neither of {kinds} begins it")
    each = size or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()

    def run(mode: str, ranges: list[Range], **more) -> DataFrame:
        plan = {"mode": mode, "files": doc.files, "ranges": [[r.start, r.end, r.inside, r.depth, r.opens] for r in ranges], **more}
        return spark.read.format("json_elements").option("plan", json.dumps(plan)).load()

    ranges = [Range(at, min(at + each, doc.size)) for at in range(0, doc.size, each)]
    inside, depth, least = False, 0, {}
    for r, found in zip(ranges, sorted(run("scan", ranges).collect())):
        r.inside, r.depth = inside, depth
        step, low = (found.step_inside, found.least_inside) if inside else (found.step, found.least)
        least[r.start] = depth + low
        depth, inside = depth + step, inside ^ (found.quotes % 2 == 1)
    if inside or depth or min(least.values()) < 0:
        raise ValueError(f"{place}: strings or brackets that don't close")
    level, closed = 1, None
    if kind == b"{" and keys:
        places = run("find", ranges, keys=list(keys)).collect()
        names = {name: (at, end == "1") for at, (name, _, end) in sorted((r.offset, r.element.rpartition(":")) for r in places)}
        name = next((k for k in keys if k in names), None)
        if name is None:
            raise ValueError(f"{place}: no list under {' or '.join(keys)}")
        level, (opening, closed), kind = 2, names[name], b"["
    wanted = []
    for r in ranges:
        if r.end <= opening:
            continue
        wanted.append(Range(opening, r.end, False, level - 1, True) if r.start <= opening else r)
        if closed if r.start <= opening and closed is not None else least[r.start] < level:
            break
    return run("read", wanted, level=level, closing={b"[": "]", b"{": "}"}[kind])
