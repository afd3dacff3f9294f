"""Runs of one system over pages: single pass, and two passes gated by the verifier or by seeded draws.

A page is inferred at most twice. The second pass is a filter, an inference over what is left, and a left join back: in
a conditional expression Spark would call a model for every row. First passes are written before they branch, so they
aren't computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import verify
from ..sources.shared import stored
from .inference import Budget, Model, Prompt, infer

OUT = ("raw_text", "output_tokens", "runtime_ms", "started_at", "finished_at")


PASSES = ("first_pass", "reparse", "final")


def stored_once(df: DataFrame, store=None) -> DataFrame:
    """The rows written and reread, so that what uses them twice doesn't infer twice: by store, else as a table in the
    session's shared folder. The session's settings stay as they are.
    """
    return store(df) if store else stored(df, "first-pass")


def single_pass(pages: DataFrame, model: Model, budget: Budget, prompt: Prompt, run_id: str, split: str) -> DataFrame:
    """A log row for each page, with raw_text."""
    out = infer(pages, model, budget, prompt)
    return out.select(
        F.lit(run_id).alias("run_id"), "page_id", F.lit(split).alias("split"), F.lit(model.name).alias("model_name"),
        F.lit(budget.name).alias("budget_name"), F.lit(prompt.id).alias("prompt_id"), "runtime_ms",
        F.col("output_tokens").alias("output_token_count"), F.concat(F.lit("raw/"), "page_id", F.lit(".md")).alias("raw_output_path"), "started_at",
        "finished_at", F.lit("ok").alias("status"), "raw_text"
    )


def two_pass(
    pages: DataFrame, model: Model, low: Budget, high: Budget, prompt: Prompt, run_id: str, split: str, route: Column | None = None,
    extra: dict[str, object] | None = None, store=None
) -> DataFrame:
    """A log row for each page, with raw_text: the second pass's where it ran, even if it is worse; and first_pass_text,
    reparse_text (null without a second pass) and tables, what the verifier found in the first pass. `route` decides the
    second pass, by default the verifier; store(df) writes and rereads the first pass.
    """
    first = verify.verified(infer(pages, model, low, prompt)).drop("grids")
    first = first.withColumn("reparse_triggered", verify.should_reparse() if route is None else route)
    first = stored_once(first, store)
    again = infer(first.where("reparse_triggered").select(*pages.columns), model, high, prompt).select(F.col("page_id").alias("again_id"), *(F.col(c).alias(f"again_{c}") for c in OUT))
    out = first.join(again, F.col("page_id") == F.col("again_id"), "left")
    second = F.col("reparse_triggered")
    place = lambda kind: F.concat(F.lit(f"{kind}/raw/"), "page_id", F.lit(".md"))
    return out.select(
        F.lit(run_id).alias("run_id"), F.lit(split).alias("split"), "page_id", F.lit(model.name).alias("model_name"), F.lit(prompt.id).alias("prompt_id"), F.lit(low.name).alias("budget_low"), F.lit(high.name).alias("budget_high"),
        "reparse_triggered", "verifier_decision", "verifier_failure_codes", "predicted_table_count", F.col("output_tokens").alias("first_pass_output_tokens"), F.col("again_output_tokens").alias("reparse_output_tokens"),
        F.col("runtime_ms").alias("first_pass_runtime_ms"), F.lit(0.0).alias("verifier_runtime_ms"), F.col("again_runtime_ms").alias("reparse_runtime_ms"), (
            F.col("runtime_ms") + F.coalesce("again_runtime_ms", F.lit(0.0))
        ).alias("total_runtime_ms"),
        place("first_pass").alias("first_pass_raw_path"), F.when(second, place("reparse")).alias("reparse_raw_path"), place("final").alias("final_raw_path"), F.when(second, "reparse").otherwise("first_pass").alias("final_output_source"), F.lit("ok").alias("status"),
        F.coalesce("again_raw_text", "raw_text").alias("raw_text"), F.col("raw_text").alias("first_pass_text"), F.col("again_raw_text").alias("reparse_text"), "tables", *(
            F.lit(v).alias(k) for k, v in (extra or {}).items()
        ),
    )


TEXTS = ("raw_text", "first_pass_text", "reparse_text", "tables")  # of a run's rows, what its log leaves out


def artifacts(out: DataFrame) -> dict[str, DataFrame]:
    """Of a run's rows, those of each folder of page files: page_id, raw_text and the sidecar's columns. A single pass
    has one folder, a gated run one for each pass and one for what is kept, which has the verifier's findings too.
    """
    if "first_pass_text" not in out.columns:
        return {"": out}
    meta = [c for c in ("run_id", "split", "page_id", "model_name", "prompt_id") if c in out.columns]
    place = lambda kind: F.lit(f"{kind}/").alias("folder")
    one = out.select(
        *meta, place("first_pass"), F.col("budget_low").alias("budget_name"), F.col("first_pass_output_tokens").alias("output_token_count"),
        F.col("first_pass_runtime_ms").alias("runtime_ms"), F.col("first_pass_text").alias("raw_text")
    )
    two = out.where("reparse_triggered").select(
        *meta, place("reparse"), F.col("budget_high").alias("budget_name"), F.col("reparse_output_tokens").alias("output_token_count"),
        F.col("reparse_runtime_ms").alias("runtime_ms"), F.col("reparse_text").alias("raw_text")
    )
    return {"first_pass": one, "reparse": two, "final": out.drop("first_pass_text", "reparse_text")}


def adaptive(pages, model, low, high, prompt, run_id, split, store=None) -> DataFrame:
    return two_pass(pages, model, low, high, prompt, run_id, split, store=store)


def adaptive_random(pages, model, low, high, prompt, run_id, split, seed: int, probability: float, store=None) -> DataFrame:
    """The verifier is logged but draws decide."""
    extra = {"random_seed": seed, "random_probability": float(probability), "policy": "random"}
    return two_pass(pages, model, low, high, prompt, run_id, split, verify.random_reparse(F.col("page_id"), seed, probability), extra, store)
