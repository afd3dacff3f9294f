"""Freeze the universe: English table pages, the hard ones among them, and the seeded split, as four manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dataset import HardTableRule, english_table_pages, hard_table_pages, seeded_split
from ..sources.shared import stored
from ..sources.sinks import write_manifest


def universe(records: DataFrame, rule: HardTableRule, calibration_size: int, eval_size: int | None, seed: int) -> DataFrame:
    """kind and page_id of the members of the four manifests."""
    pages = english_table_pages(records)
    split = seeded_split(pages, calibration_size, eval_size, seed)
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "page_id")
    return kind(pages, "eval_universe").unionAll(kind(hard_table_pages(pages, rule), "hard_subset")).unionAll(split.where("split <> 'unused'").select("split", "page_id"))


def write_manifests(members: DataFrame, folder: str, pinning: dict, seed: int) -> dict[str, int]:
    """The manifests as byte-stable JSON; returns how many pages each has. Members are computed once, and sorted and
    written by Spark.
    """
    rows, out = stored(members, "members"), {}
    for kind in ("eval_universe", "hard_subset", "calibration", "held_out_eval"):
        name = kind if kind in ("eval_universe", "hard_subset") else f"{kind}_split"
        ids = rows.where(F.col("kind") == kind).select("page_id")
        out[kind] = write_manifest(ids, f"{folder}/{name}.json", name, pinning, seed if name.endswith("split") else None)
    return out
