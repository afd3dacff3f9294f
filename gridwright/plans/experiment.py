"""All systems over the held-out pages, each with its own failures, and the run manifest."""

from __future__ import annotations

import subprocess
import traceback
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators.summary import reparse_probability
from ..sources.shared import literal
from . import runners
from .inference import Budget, Model, Prompt

# Families in their order.
FAMILIES = ("adaptive_2b", "fixed_2b_low", "fixed_2b_matched", "random_2b", "fixed_8b_matched")
SKIPPED = "skipped_stub_8b"


@dataclass(frozen=True)
class Spec:
    system_id: str
    family: str
    runner: str
    seed: int | None = None


def specs(seeds: Iterable[int]) -> list[Spec]:
    """Adaptive, the two small fixed ones, random by seed, the large fixed one."""
    if not (seeds := list(seeds)):
        raise ValueError("random_2b needs a seed")
    runner = {"adaptive_2b": "adaptive", "random_2b": "adaptive_random"}
    return [Spec(f if s is None else f"{f}_seed{s}", f, runner.get(f, "single_pass"), s) for f in FAMILIES for s in (seeds if f == "random_2b" else [None])]


def filtered(every: list[Spec], wanted: Iterable[str] | None) -> list[Spec]:
    """By family or system_id; a name that is neither raises ValueError."""
    if not wanted:
        return every
    names = set(wanted)
    if unknown := names.difference(*({s.family, s.system_id} for s in every)):
        raise ValueError(f"unknown systems: {sorted(unknown)}")
    return [s for s in every if names & {s.family, s.system_id}]


def specs_frame(spark: SparkSession, every: list[Spec]) -> DataFrame:
    return spark.createDataFrame([(i, s.system_id, s.family, s.runner, s.seed) for i, s in enumerate(every)], schemas.SPEC)


def frozen_budget(frozen: dict, name: str) -> Budget:
    b = frozen["budgets"][name]
    return Budget(b["name"], b["max_tiles"])


def frozen_model(frozen: dict, name: str, registry: dict[str, Model]) -> Model:
    """The registered model of a frozen budget; another adapter than the frozen one raises ValueError."""
    b = frozen["budgets"][name]
    if b["model_name"] not in registry:
        raise KeyError(f"{b['model_name']}: registered are {sorted(registry)}")
    m = registry[b["model_name"]]
    if m.adapter_kind != b["adapter_kind"]:
        raise ValueError(f"{m.name}: frozen for {b['adapter_kind']}, registered as {m.adapter_kind}")
    return m


def git_head(folder: str) -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, timeout=2, check=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def run_system(
    spec: Spec, pages: DataFrame, frozen: dict, registry: dict[str, Model], prompt: Prompt, write: Callable[[str, DataFrame], str], run_id: str,
    split: str, allow_stub_8b: bool = False, store=None
) -> dict:
    """One system's entry of the manifest: run, written and counted. An error makes a failed entry, with its traceback."""
    sel = frozen["selection"]["adaptive"]
    entry = {"system_id": spec.system_id, "family": spec.family, "runner": spec.runner, "status": "ok", "seed": spec.seed, "notes": []}
    try:
        if spec.runner == "single_pass":
            name = {"fixed_2b_low": "B_low", "fixed_2b_matched": "B_fix_2B", "fixed_8b_matched": "B_fix_8B"}[spec.family]
            model, budget = frozen_model(frozen, name, registry), frozen_budget(frozen, name)
            entry |= {"model_name": model.name, "adapter_kind": model.adapter_kind, "budget_name": budget.name, "budget_max_tiles": budget.max_tiles}
            if spec.family == "fixed_8b_matched" and model.adapter_kind == "stub" and not allow_stub_8b:
                return entry | {"status": SKIPPED, "reason": "the large model is a stub"}
            log = runners.single_pass(pages, model, budget, prompt, run_id, split)
        else:
            model, low, high = frozen_model(frozen, "B_low", registry), frozen_budget(frozen, "B_low"), frozen_budget(frozen, "B_high")
            entry |= {
                "model_name": model.name, "adapter_kind": model.adapter_kind, "budget_low_name": low.name, "budget_low_max_tiles": low.max_tiles,
                "budget_high_name": high.name, "budget_high_max_tiles": high.max_tiles
            }
            if spec.runner == "adaptive":
                log = runners.adaptive(pages, model, low, high, prompt, run_id, split, store)
            else:
                p, degenerate = reparse_probability(sel["measured"], sel["low"], sel["high"])
                entry |= {"random_probability": p, "random_probability_source": "calibration_selection"}
                entry["notes"] = ["probability is 0: every seed decides alike"] if degenerate else []
                log = runners.adaptive_random(pages, model, low, high, prompt, run_id, split, spec.seed, p, store)
        entry["output_dir"] = write(spec.system_id, log)
        done = pages.sparkSession.read.schema(schemas.ANY_LOG).json(literal(entry["output_dir"])).selectExpr("count(1) n", "count_if(reparse_triggered) r").head()
        return entry | {"pages_processed": done.n, "reparse_count": done.r if spec.runner != "single_pass" else None}
    except Exception:  # a system's failure is a row of the manifest
        return entry | {"status": "failed", "error": traceback.format_exc()}


def run_all(
    pages: DataFrame, frozen: dict, registry: dict[str, Model], prompt: Prompt, seeds: Iterable[int], write: Callable[[str, DataFrame], str],
    run_id: str = "run", split: str = "held_out_eval", families: Iterable[str] | None = None, allow_stub_8b: bool = False, store=None,
    at_once: int = 3
) -> list[dict]:
    """Run the systems, `at_once` of them side by side, and return the manifest's entries in the systems' order.

    write(system_id, log) stores a log and returns its place. Each system has a thread whose jobs carry a tag and run in
    a scheduler pool of its own, so that with the fair scheduler none waits for all of another's tasks. An error in one
    system makes a failed entry, cancels what it has left running, and leaves the others alone. The large system on a
    stub adapter is skipped unless allowed.
    """
    sc, run = pages.sparkSession.sparkContext, uuid.uuid4().hex

    def one(spec: Spec) -> dict:
        tag = f"{run}-{spec.system_id}"
        before = sc.getLocalProperty("spark.scheduler.pool")
        sc.addJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", spec.system_id)
        try:
            entry = run_system(spec, pages, frozen, registry, prompt, write, run_id, split, allow_stub_8b, store)
        finally:
            sc.removeJobTag(tag)
            sc.setLocalProperty("spark.scheduler.pool", before)
        if entry["status"] == "failed":
            sc.cancelJobsWithTag(tag)
        return entry

    wanted = filtered(specs(seeds), families)
    start = inheritable_thread_target(pages.sparkSession)(one)
    with ThreadPoolExecutor(max(1, at_once)) as threads:
        return [f.result() for f in [threads.submit(start, s) for s in wanted]]
