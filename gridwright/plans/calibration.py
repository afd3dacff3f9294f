"""Calibration: sweep budgets, pick a pair near the target cost, match fixed budgets to what it measured, freeze."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import summary, verify
from ..sources.sinks import write_json
from .inference import Budget, Model, Prompt, infer
from .runners import stored_once


@dataclass(frozen=True)
class Settings:
    lows: tuple[int, ...]
    highs: tuple[int, ...]
    fixed: tuple[int, ...]
    target: float
    tolerance: float = 0.1
    cost_unit: str = "max_tiles"

    def __post_init__(self):
        if self.cost_unit != "max_tiles":
            raise ValueError("cost_unit must be max_tiles")
        for n in (*self.lows, *self.highs, *self.fixed, self.target):
            summary.positive(n)


def sweep_adaptive(pages: DataFrame, model: Model, prompt: Prompt, s: Settings, store=None) -> DataFrame:
    """low, high, sample_size, mean_output_tokens, reparse_rate, cost_tiles of every pair with high not below low.

    The first pass depends on low alone and the second on high, so each is inferred once for each setting and pairs are
    joined: at most |low| + |high| inferences for a page, not twice |low| * |high|. The second passes run only on pages
    that some first pass sends on. That holds for deterministic adapters. store(df) writes and rereads the first passes,
    which are used twice.
    """
    spark = pages.sparkSession
    firsts = [
        verify.verified(infer(pages, model, Budget(f"low_{n}", n), prompt)).select(
            F.lit(n).alias("low"), "page_id", F.col("output_tokens").alias("first"), (F.col("verifier_decision") == "REPARSE").alias("reparse")
        ) for n in s.lows
    ]
    every = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionAll(every(parts[1:]))
    first = stored_once(every(firsts), store)
    again = pages.join(first.where("reparse").select("page_id").distinct(), "page_id", "left_semi")
    seconds = [infer(again, model, Budget(f"high_{n}", n), prompt).select(F.lit(n).alias("high"), "page_id", F.col("output_tokens").alias("second")) for n in s.highs]
    grid = summary.budget_grid(spark.createDataFrame([(n,) for n in s.lows], "low int"), spark.createDataFrame([(n,) for n in s.highs], "high int"))
    rows = first.join(F.broadcast(grid), "low").join(every(seconds), ["high", "page_id"], "left")
    kept = F.when(F.col("reparse") & F.col("second").isNotNull(), F.col("second")).otherwise(F.col("first"))
    counted = rows.groupBy("low", "high").agg(
        F.count(F.lit(1)).alias("n"), summary.mean(kept).alias("tok"), summary.mean(F.col("reparse").cast("int")).alias("rate"),
        summary.mean(F.col("low") + F.when(F.col("reparse"), F.col("high")).otherwise(0)).alias("cost")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return grid.join(counted, ["low", "high"], "left").select(
        "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("sample_size"), zero("tok").alias("mean_output_tokens"),
        zero("rate").alias("reparse_rate"), zero("cost").alias("cost_tiles")
    )


def sweep_fixed(pages: DataFrame, model: Model, prompt: Prompt, s: Settings) -> DataFrame:
    """max_tiles, sample_size, mean_output_tokens, cost_tiles of every candidate."""
    out = None
    for n in s.fixed:
        part = infer(pages, model, Budget(f"fixed_{n}", n), prompt).agg(F.count(F.lit(1)).alias("sample_size"), summary.mean(F.col("output_tokens")).alias("mean_output_tokens")).select(
            F.lit(n).alias("max_tiles"), "sample_size", "mean_output_tokens", F.lit(summary.positive(n)).alias("cost_tiles")
        )
        out = part if out is None else out.unionAll(part)
    return out


def calibrate(pages: DataFrame, small: Model, large: Model, prompt: Prompt, s: Settings) -> dict:
    """The frozen budgets, from one sweep of each kind."""
    return chosen(sweep_adaptive(pages, small, prompt, s), {m.name: sweep_fixed(pages, m, prompt, s) for m in (small, large)}, small, large, s)


def chosen(adaptive: DataFrame, fixed_points: dict[str, DataFrame], small: Model, large: Model, s: Settings) -> dict:
    """The frozen budgets from the sweeps' points. Fixed budgets are matched to the pair's measured cost, not to the
    target.
    """
    pair = summary.one_row(summary.select_pair(adaptive, s.target), "budget pair")
    pick = {k: summary.one_row(summary.select_fixed(fixed_points[m.name], pair.measured, s.tolerance), "fixed budget") for k, m in (("2b", small), ("8b", large))}
    budget = lambda name, n, m: {"name": name, "max_tiles": int(n), "model_name": m.name, "adapter_kind": m.adapter_kind}
    fixed = lambda r: {"target": r.target, "measured": r.measured, "max_tiles": int(r.max_tiles), "within_tolerance": r.within_tolerance}
    return {
        "schema_version": 1,
        "pinning": {"cost_unit": s.cost_unit, "matched_cost_tolerance": s.tolerance},
        "budgets": {
            "B_low": budget("B_low", pair.low, small), "B_high": budget("B_high", pair.high, small),
            "B_fix_2B": budget("B_fix_2B", pick["2b"].max_tiles, small), "B_fix_8B": budget("B_fix_8B", pick["8b"].max_tiles, large)
        },
        "selection": {"adaptive": {"target": pair.target, "measured": pair.measured, "low": int(pair.low), "high": int(pair.high)}, "fixed_2b": fixed(pick["2b"]), "fixed_8b": fixed(pick["8b"])},
    }


def told(frozen: dict) -> str:
    """What was chosen, in lines to read."""
    sel, out = frozen["selection"], []
    a = sel["adaptive"]
    out.append(f"adaptive: low {a['low']}, high {a['high']} tiles; {a['measured']:.4f} tiles a page measured, {a['target']:.4f} wanted")
    for k in ("fixed_2b", "fixed_8b"):
        f = sel[k]
        out.append(f"{k}: {f['max_tiles']} tiles; {f['measured']:.4f} measured, {f['target']:.4f} wanted, " + ("within" if f["within_tolerance"] else "outside") + " the tolerance")
    return "\n".join(out)


def check_frozen(frozen: dict) -> dict:
    if frozen.get("schema_version") != 1:
        raise ValueError("schema_version must be 1")
    if frozen.get("pinning", {}).get("cost_unit") != "max_tiles":
        raise ValueError("cost_unit must be max_tiles")
    return frozen


def freeze(path: str, frozen: dict) -> None:
    write_json(path, check_frozen(frozen))
