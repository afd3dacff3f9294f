"""Analysis of a run: results, costs, reparse slices, the page matrix and the audit's eleven checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import html
from ..operators import summary
from .experiment import FAMILIES

OK, WARN, FAIL = "ok", "warn", "fail"
CHECKS = (
    "phase1_splits_disjoint", "phase6_manifest_sha_matches_held_out", "phase6_manifest_sha_matches_frozen", "phase6_entries_complete",
    "phase6_entries_match_disk", "phase6_log_pages_match_held_out", "frozen_artifact_unchanged_by_phase6", "verifier_decision_codes_known",
    "prompt_id_pinned", "random_baseline_seeds_distinct", "accuracy_status"
)


def results(entries: DataFrame, log: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """A row for each manifest entry: the log's figures for ok systems, zeros and nulls for others; scores join by
    system_id.
    """
    known = (*schemas.ADAPTIVE_RUNNERS, schemas.SINGLE_PASS_RUNNER)
    if bad := entries.where(~F.col("runner").isin(*known)).select("runner").take(1):
        raise ValueError(f"unknown runner {bad[0].runner!r}")
    adaptive = F.col("runner").isin(*schemas.ADAPTIVE_RUNNERS)
    systems = entries.where("status = 'ok'").select(
        "system_id", adaptive.alias("adaptive"), F.col("budget_low_max_tiles").alias("low"), F.col("budget_high_max_tiles").alias("high"),
        F.col("budget_max_tiles").alias("tiles")
    )
    found = summary.summaries(log, systems).drop("adaptive", "low", "high", "tiles")
    codes = summary.as_maps(summary.code_histogram(log), "code", "verifier_failure_codes")
    tables = summary.as_maps(summary.histogram(log, F.col("predicted_table_count"), "predicted_table_count"), "predicted_table_count", "predicted_table_count_hist")
    out = entries.select(
        "system_id", "family", "runner", "status", "pages_processed", "seed", "random_probability", F.array_join("notes", "; ").alias("note"),
        F.coalesce("error", "reason").alias("why")
    )
    for part in (found, codes, tables, *([scores] if scores is not None else [])):
        out = out.join(part, "system_id", "left")
    ok, gated = F.col("status") == "ok", F.col("runner").isin(*schemas.ADAPTIVE_RUNNERS)
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    # A count of 0 pages gives way to the log's own number of rows.
    out = out.withColumns(
        {
            "sample_size": zero("sample_size", 0), "mean_runtime_ms": zero("mean_runtime_ms", 0.0), "p95_runtime_ms": zero("p95_runtime_ms", 0.0),
            "mean_output_tokens": zero("mean_output_tokens", 0.0), "cost_tiles": zero("cost_tiles", 0.0)
        }
    )
    out = out.withColumn("pages_processed", F.when(ok, F.coalesce(F.nullif("pages_processed", F.lit(0)), "sample_size")).otherwise(0))
    for c, kind in (("verifier_failure_codes", "map<string,bigint>"), ("predicted_table_count_hist", "map<int,bigint>")):
        out = out.withColumn(c, F.when(ok & gated, F.coalesce(c, F.create_map().cast(kind))))
    return out.withColumn("note", F.when(ok, F.nullif("note", F.lit(""))).otherwise(F.col("why"))).drop("why")


def reparse_slices(entries: DataFrame, log: DataFrame) -> DataFrame:
    """system_id, reparse_count, reparse_rate and histograms of decisions and codes of each gated system, whatever its
    status.
    """
    own = entries.where(F.col("runner").isin(*schemas.ADAPTIVE_RUNNERS)).select("system_id")
    rows = log.join(F.broadcast(own), "system_id")
    flag = F.coalesce("reparse_triggered", F.lit(False))
    counts = rows.groupBy("system_id").agg(F.count_if(flag).alias("reparse_count"), F.avg(flag.cast("int")).alias("reparse_rate"))
    decisions = summary.as_maps(summary.histogram(rows, F.col("verifier_decision"), "decision"), "decision", "decision_histogram")
    codes = summary.as_maps(summary.code_histogram(rows), "code", "code_histogram")
    out = own.join(counts, "system_id", "left").join(decisions, "system_id", "left").join(codes, "system_id", "left")
    none = F.create_map().cast("map<string,bigint>")
    return out.select(
        "system_id", F.coalesce("reparse_count", F.lit(0)).alias("reparse_count"), F.coalesce("reparse_rate", F.lit(0.0)).alias("reparse_rate"),
        F.coalesce("decision_histogram", none).alias("decision_histogram"), F.coalesce("code_histogram", none).alias("code_histogram")
    )


def leaks(log: DataFrame, held_out: DataFrame) -> DataFrame:
    """system_id and page_id of logged pages that aren't held out."""
    return log.select("system_id", "page_id").where("page_id is not null").distinct().join(held_out.select("page_id"), "page_id", "left_anti")


def accuracy_status(frozen: dict) -> str:
    return "not_applicable_stub_adapters" if any(b["adapter_kind"] == "stub" for b in frozen["budgets"].values()) else "scorer_not_bundled"


def evidence(log: DataFrame, held_out: DataFrame, prompt_id: str) -> DataFrame:
    """What the audit needs of each system's log, from one pass over it: rows; leak, the first logged page that isn't
    held out; strange, how many rows have an unknown code; drift, the first page in the log's order under another prompt;
    and n and decisions, a count and a hash that tell sequences of decisions apart.
    """
    held = held_out.select("page_id").distinct().withColumn("held", F.lit(True))
    rows = log.join(held, "page_id", "left")
    known = F.array(*map(F.lit, html.CODES))
    codes = F.coalesce("verifier_failure_codes", F.array().cast("array<string>"))
    other = ~F.col("prompt_id").eqNullSafe(F.lit(prompt_id))
    return rows.groupBy("system_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("held").isNull(), F.col("page_id"))).alias("leak"), F.count_if(F.size(F.array_except(codes, known)) > 0).alias("strange"),
        F.min(F.when(other, F.struct("line_no", "page_id")))["page_id"].alias("drift"), F.count_if(other).alias("drifts"), *summary.decision_hash())


def audit(entries: DataFrame, log: DataFrame, calibration: DataFrame, held_out: DataFrame, header: dict, shas: dict, frozen: dict, identical_acknowledged: bool = False) -> list[dict]:
    """name, status, detail of the checks, in their order.

    entries has system_id, ord and the manifest's columns; log has system_id, line_no; header holds seeds, prompt_id,
    held_out_sha256, frozen_sha256; shas the files' present ones. The log is read once, for a row a system, and the splits
    once; names of offenders are looked up only where a check fails, at most ten of each.
    """
    some = lambda df, *cols: [tuple(r) for r in df.select(*cols).orderBy(*cols).take(10)]
    out: list[tuple[str, str]] = []
    side = lambda df, c, h: df.select("page_id", F.lit(c).alias("c"), F.lit(h).alias("h"))
    pages = side(calibration, 1, 0).unionAll(side(held_out, 0, 1)).groupBy("page_id").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))
    split = pages.agg(F.count_if((F.col("c") > 0) & (F.col("h") > 0)).alias("both"), F.count_if(F.col("c") != F.col("h")).alias("differ")).head()
    if not split.both:
        out.append((OK, "calibration and held-out pages are disjoint"))
    elif identical_acknowledged and not split.differ:
        out.append((WARN, "the splits are identical, as acknowledged"))
    else:
        out.append((FAIL, f"pages in both splits: {[p for p, in some(pages.where('c > 0 and h > 0'), 'page_id')]}"))
    same = {k: header[f"{k}_sha256"] == shas[k] for k in ("held_out", "frozen")}
    out.append((OK, "held-out manifest unchanged") if same["held_out"] else (FAIL, "the held-out manifest has changed since the run"))
    out.append((OK, "frozen budgets match") if same["frozen"] else (FAIL, "the frozen budgets aren't those of the run"))
    listed = sorted(entries.select("ord", "system_id", "family", "runner", "status", "seed", "output_dir", "pages_processed").collect(), key=lambda r: r.ord)
    found = {r.system_id: r for r in evidence(log, held_out, header["prompt_id"]).collect()}
    missing = [f for f in FAMILIES if f not in {r.family for r in listed}] + [f"seed {s}" for s in header["seeds"] if s not in {r.seed for r in listed}]
    out.append((FAIL, f"missing: {missing}") if missing else (OK, "all families and seeds are there"))
    ok = [r for r in listed if r.status == "ok"]
    rows = lambda r: found[r.system_id].rows if r.system_id in found else 0
    wrong = sorted(r.system_id for r in ok if r.output_dir is None or (r.pages_processed is not None and r.pages_processed != rows(r)))[:10]
    out.append((FAIL, f"entries and logs differ: {wrong}") if wrong else (OK, "entries match their logs"))
    logged = [found[r.system_id] for r in ok if r.system_id in found]
    lost = next((r for r in logged if r.leak is not None), None)
    out.append((FAIL, f"{lost.system_id}: {lost.leak} isn't held out") if lost else (OK, "logged pages are held out"))
    out.append((OK, "frozen budgets unchanged") if same["frozen"] else (FAIL, "the frozen budgets were changed"))
    gated = [r.system_id for r in listed if r.runner in schemas.ADAPTIVE_RUNNERS]
    if any(found[s].strange for s in gated if s in found):
        strange = some(log.where(F.col("system_id").isin(gated)).select(F.explode("verifier_failure_codes").alias("code")).where(~F.col("code").isin(*html.CODES)).distinct(), "code")
        out.append((FAIL, f"unknown codes: {[c for c, in strange]}"))
    else:
        out.append((OK, "codes are known"))
    drift = sorted((r.system_id, r.drift) for r in logged if r.drifts)[:10]
    out.append((FAIL, f"other prompts: {drift}") if drift else (OK, "the prompt is pinned"))
    seeds = [r for r in ok if r.family == "random_2b"]
    distinct = len({(found[r.system_id].n, found[r.system_id].decisions) for r in seeds if r.system_id in found})
    n = len(seeds)
    out.append((WARN, f"{n} random seeds can't differ") if n < 2 else (WARN, "all random seeds decide alike") if distinct <= 1 else (OK, f"{distinct} different sequences of decisions"))
    status = accuracy_status(frozen)
    out.append((WARN if status.startswith("not") else OK, status))
    return [{"name": c, "status": s, "detail": d} for c, (s, d) in zip(CHECKS, out)]


def any_failed(checks: Iterable[dict]) -> bool:
    return any(c["status"] == FAIL for c in checks)
