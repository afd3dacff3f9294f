"""Writers: data as Parquet or JSON lines by Spark, small artifacts as stable JSON by the driver."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .json_arrays import SEGMENTS, Document
from .shared import fresh, located, ship, write_text


def stable(data: object) -> str:
    """Sorted keys, two spaces, a newline at the end: equal data are equal bytes."""
    return json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write_json(path: str | Path, data: object) -> None:
    """Stable JSON at a path or URI."""
    write_text(path, stable(data))


def write_list(rows: DataFrame, folder: str, element: str, order: str, head: str = "[\n", separator: str = ",\n", tail: str = "\n]\n") -> int:
    """A JSON document in segments: the texts of a column as elements, in the order of another; returns how many.

    Rows are dealt by ranges of their order and each task writes one segment. What stands between segments is a small
    file of its own, and _segments.json, written last, names all of them in order, so a repeated task leaves nothing
    that counts and no element passes through the driver. json_arrays reads such a folder as one document; joined()
    makes a file of it.
    """
    ship(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col(order).alias("o"), F.col(element).alias("e")).repartitionByRange(parts, "o").sortWithinPartitions("o")
    where, base = located(folder)
    where.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, root = located(folder)
        name, n, size = f"segment-{uuid.uuid4().hex}", 0, 0
        sink = None
        for b in batches:
            if not b.num_rows:
                continue
            sink = sink or there.open_output_stream(f"{root}/{name}", compression=None)
            raw = (separator if n else "").encode() + separator.join(b.column("e").to_pylist()).encode()
            sink.write(raw)
            n, size = n + b.num_rows, size + len(raw)
        if sink:
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "n": pa.array([n], pa.int64()), "size": pa.array([size], pa.int64())})

    done = sorted(dealt.mapInArrow(write, "part int, name string, n long, size long").collect(), key=lambda r: r.part)
    small = {"head": head, "separator": separator, "tail": tail}
    for name, text in small.items():
        write_text(f"{folder}/{name}", text)
    names = [("head", len(head.encode()))]
    for r in done:
        names += [("separator", len(separator.encode()))] * (len(names) > 1) + [(r.name, r.size)]
    write_text(f"{folder}/{SEGMENTS}", json.dumps([*names, ("tail", len(tail.encode()))]))
    return sum(r.n for r in done)


def joined(folder: str, path: str) -> None:
    """The document of a folder of segments as one file, a block of bytes at a time."""
    where, base = located(path)
    where.create_dir(os.path.dirname(base), recursive=True)
    with where.open_output_stream(base, compression=None) as sink:
        for _, raw in Document.at(folder).blocks(0):
            sink.write(raw)


def write_manifest(ids: DataFrame, path: str, kind: str, pinning: dict, seed: int | None = None) -> int:
    """A split manifest of page ids (a column page_id), byte for byte that of manifest(); returns how many it has. The
    ids are sorted and written by Spark.
    """
    whole = stable(manifest(kind, [], pinning, seed))
    folder = fresh(ids.sparkSession, "manifest")
    text = F.udf(lambda x: "    " + json.dumps(x, ensure_ascii=False), "string", useArrow=True)
    head, tail = whole.split('"page_ids": []')
    rows = ids.select("page_id", text("page_id").alias("element"))
    n = write_list(rows, folder, "element", "page_id", f'{head}"page_ids": [\n', ",\n", f"\n  ]{tail}")
    if n:
        joined(folder, path)
    else:
        write_text(path, whole)
    return n


def write_log(log: DataFrame, path: str) -> None:
    """Rows as JSON lines in place of what is there; an empty log is still a readable folder."""
    log.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_pages(pages: DataFrame, path: str, *by: str) -> None:
    """Outputs and their sidecar columns as one Parquet table, partitioned by system and pass."""
    pages.write.mode("overwrite").partitionBy(*by).parquet(path)


def export_pages(pages: DataFrame, folder: str) -> None:
    """raw/{page_id}.md and pages/{page_id}.json of each row (raw_text and the sidecar's columns) below a folder that
    the tasks share, a path or a URI, whatever letters its name holds. A task that is run again writes the same files.
    """
    ship(pages.sparkSession)
    where, base = located(folder)
    for d in ("raw", "pages"):
        where.create_dir(f"{base}/{d}", recursive=True)

    def write(rows) -> None:
        there, root = located(folder)
        for r in rows:
            row = r.asDict(recursive=True)
            text = row.pop("raw_text")
            for path, data in ((f"raw/{r.page_id}.md", text or ""), (f"pages/{r.page_id}.json", json.dumps(row | {"raw_output_path": f"raw/{r.page_id}.md"}, indent=2, sort_keys=True) + "\n")):
                with there.open_output_stream(f"{root}/{path}", compression=None) as sink:
                    sink.write(data.encode())

    pages.foreachPartition(write)


def manifest(kind: str, page_ids: list[str], pinning: dict, seed: int | None = None) -> dict:
    return {"manifest_kind": kind, "schema_version": 1, "generated_with_seed": seed, "pinning": pinning, "page_ids": sorted(page_ids)}


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    return "".join(f"| {x} |\n" for x in (" | ".join(columns), " | ".join("---" for _ in columns))) + markdown_rows(rows, columns)


def markdown_rows(rows: list[dict], columns: list[str]) -> str:
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "".join("| " + " | ".join(shown(r.get(c)) for c in columns) + " |\n" for r in rows)
