"""The model boundary: adapters by name, and the deterministic stub."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pixels
from ..functions.text import token_count
from ..sources.shared import ship


@dataclass(frozen=True)
class Model:
    name: str
    adapter_kind: str
    model_id: str = ""
    notes: str = ""


@dataclass(frozen=True)
class Budget:
    name: str
    max_tiles: int

    def __post_init__(self):
        if self.max_tiles <= 0:
            raise ValueError(f"{self.name}: max_tiles must be positive")


@dataclass(frozen=True)
class Prompt:
    id: str
    version: int = 1
    description: str = ""
    template: str = ""


def stub_text(page_id: Column, model: str, budget: str, prompt: str, width: Column, height: Column) -> Column:
    """A heading and one table of five rows and two columns."""
    row = lambda a, b: F.concat(F.lit("  <tr><td>"), a, F.lit("</td><td>"), b, F.lit("</td></tr>\n"))
    head = F.lit("\n\n<table>\n  <tr><th>column_a</th><th>column_b</th></tr>\n")
    return F.concat(
        F.lit("# "), page_id, head, row(page_id, F.lit(model)), row(F.lit(budget), F.lit(prompt)), row(F.lit("image_w"), width.cast("string")),
        row(F.lit("image_h"), height.cast("string")), F.lit("</table>\n")
    )


Adapter = Callable[[DataFrame, Model, Budget, Prompt], DataFrame]


def stub(pages: DataFrame, model: Model, budget: Budget, prompt: Prompt) -> DataFrame:
    """Adds raw_text, output_tokens, runtime_ms, started_at, finished_at to pages (page_id, width, height). No model
    runs and no row leaves Spark.
    """
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    out = pages.withColumn("raw_text", stub_text(F.col("page_id"), model.name, budget.name, prompt.id, F.col("width"), F.col("height")))
    return out.withColumn("output_tokens", token_count(F.col("raw_text"))).withColumn("runtime_ms", F.lit(0.0)).withColumn("started_at", now).withColumn("finished_at", now)


ADAPTERS: dict[str, Adapter] = {"stub": stub}


def register(kind: str, adapter: Adapter) -> None:
    """Add an adapter: a function from pages to pages with outputs, such as a mapInArrow that keeps its model in the
    worker.
    """
    ADAPTERS[kind] = adapter


Predict = Callable[[list[dict], Budget, Prompt], list[str]]  # pages as rows -> their texts

_LOADED: dict[tuple[str, str, str], Predict] = {}  # of a Python worker


@dataclass(frozen=True)
class InWorkers:
    """An adapter whose model lives in the Python workers.

    load(model) gives the model's function; a worker calls it once and keeps it for all its batches and tasks. Pages go
    to it in batches of at most `most_tiles` tiles by the budget's grid for each page's size, and one page at least. With
    a profile, the stage runs on executors with the resources it asks for. Runs store what comes back before it
    branches, so a task that is run again later reads texts and infers nothing.
    """

    load: Callable[[Model], Predict]
    most_tiles: int = 64
    profile: ResourceProfile | None = None

    def __call__(self, pages: DataFrame, model: Model, budget: Budget, prompt: Prompt) -> DataFrame:
        load, most = self.load, self.most_tiles
        schema = T.StructType(
            [
                *pages.schema.fields, T.StructField("raw_text", T.StringType()), T.StructField("runtime_ms", T.DoubleType()),
                T.StructField("started_at", T.StringType()), T.StructField("finished_at", T.StringType())
            ]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = (model.name, model.adapter_kind, model.model_id)
            for b in batches:
                rows = b.to_pylist()
                tiles = [math.prod(pixels.grid(r["width"], r["height"], budget.max_tiles)) for r in rows]
                i = 0
                while i < len(rows):
                    if key not in _LOADED:
                        _LOADED[key] = load(model)
                    j, used = i + 1, tiles[i]
                    while j < len(rows) and used + tiles[j] <= most:
                        used, j = used + tiles[j], j + 1
                    began = datetime.now(UTC)
                    texts = _LOADED[key](rows[i:j], budget, prompt)
                    ended = datetime.now(UTC)
                    each = (ended - began).total_seconds() * 1000 / (j - i)
                    new = [texts, [each] * (j - i), [began.isoformat()] * (j - i), [ended.isoformat()] * (j - i)]
                    yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, *map(pa.array, new)], names=schema.names)
                    i = j

        ship(pages.sparkSession)
        return pages.mapInArrow(run, schema, profile=self.profile).withColumn("output_tokens", token_count(F.col("raw_text")))


def brightness(model: Model) -> Predict:
    """A small model of numbers: a table of the tiles' mean brightness, by the tiles' rows and columns, from a column
    `content` of PNG files.
    """

    def predict(pages: list[dict], budget: Budget, prompt: Prompt) -> list[str]:
        out = []
        for page in pages:
            columns, rows, tiles = pixels.tiles(pixels.decode(page["content"]), budget.max_tiles, 16)
            means = np.rint(tiles.mean(axis=(1, 2, 3))).astype(int).reshape(rows, columns).tolist()
            table = "".join("<tr>" + "".join(f"<td>{x}</td>" for x in row) + "</tr>" for row in means)
            out.append(f"# {page['page_id']}\n\n<table>{table}</table>\n")
        return out

    return predict


register("brightness", InWorkers(brightness))


def infer(pages: DataFrame, model: Model, budget: Budget, prompt: Prompt) -> DataFrame:
    if model.adapter_kind not in ADAPTERS:
        raise ValueError(f"no adapter {model.adapter_kind!r}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[model.adapter_kind](pages, model, budget, prompt)
