"""Whole phases from configurations to artifacts: what the command line calls."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import dataset, summary, verify
from ..sources import json_tables, sinks
from ..sources.shared import exists, literal, located, read_text
from . import analysis, calibration, config, experiment, freeze, runners
from .inference import Prompt

NO_IMAGE = (8, 8)  # the size pages get that come without an image root


def pages_for(spark: SparkSession, manifest: str, records: str, image_root: str | None, content: bool = False) -> DataFrame:
    """page_id, width, height, ord of a manifest's pages, and with `content` the images' bytes. Ids without a record raise KeyError, records without an image
    FileNotFoundError. Sizes come from the PNG header.
    """
    ids = json_tables.split_page_ids(spark, manifest)
    rows = json_tables.page_records(spark, records)
    if lost := [r.page_id for r in ids.join(rows, "page_id", "left_anti").select("page_id").take(20)]:
        raise KeyError(f"no records of {lost}")
    pages = ids.join(rows, "page_id")
    if not image_root:
        return pages.select("page_id", F.lit(NO_IMAGE[0]).alias("width"), F.lit(NO_IMAGE[1]).alias("height"), "ord")
    side = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return json_tables.images(spark, pages, image_root).select("page_id", side(17).alias("width"), side(21).alias("height"), "ord", *["content"] * content)


def _inputs(spark: SparkSession, c: dict, part: str = "inputs") -> DataFrame:
    return pages_for(spark, config.get(c, f"{part}.manifest_path"), config.get(c, f"{part}.records_path"), config.get(c, f"{part}.image_root"), bool(config.get(c, f"{part}.image_content", False)))


def _store(root: str):
    def store(df: DataFrame) -> DataFrame:
        path = f"{root}/_first_pass/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.parquet(literal(path))

    return store


def _write(out: DataFrame, folder: str, page_files: bool = True) -> int:
    """Page outputs as Parquet, then from what was written, so that nothing is inferred twice: the log, its rows
    numbered in the order of page ids, which is that of manifests; and a text and a sidecar for each page and pass,
    unless page_files is off.
    """
    sinks.write_pages(out, f"{folder}/outputs")
    done = out.sparkSession.read.parquet(literal(f"{folder}/outputs"))
    log = dataset.dense_places(done.drop(*runners.TEXTS), "page_id").withColumnRenamed("place", "line_no")
    sinks.write_log(log.orderBy("line_no"), f"{folder}/logs")
    if page_files:
        for place, rows in runners.artifacts(done).items():
            sinks.export_pages(rows, f"{folder}/{place}".rstrip("/"))
    return done.count()


def run_single(spark: SparkSession, path: str) -> int:
    c = config.load("single", path)
    model = config.named(config.models(config.get(c, "model.config_path")), config.get(c, "model.name"))
    budget = config.named(config.budgets(config.get(c, "budget.config_path")), config.get(c, "budget.name"))
    out = runners.single_pass(_inputs(spark, c), model, budget, config.prompt(config.get(c, "prompt.config_path")), c["run_id"], config.get(c, "inputs.split_name"))
    return _write(out, config.get(c, "output.dir"), config.get(c, "output.page_files", True))


def run_adaptive(spark: SparkSession, path: str, seed: int | None = None, probability: float = 0.5) -> int:
    """A gated run; with a seed, one whose second passes are drawn with that probability."""
    c = config.load("adaptive", path)
    model = config.named(config.models(config.get(c, "model.config_path")), config.get(c, "model.name"))
    table = config.budgets(config.get(c, "budget.config_path"))
    low, high = (config.named(table, config.get(c, f"budget.{k}_name")) for k in ("low", "high"))
    folder = config.get(c, "output.dir")
    given = (_inputs(spark, c).drop("ord"), model, low, high, config.prompt(config.get(c, "prompt.config_path")), c["run_id"], config.get(c, "inputs.split_name"))
    out = runners.adaptive(*given, store=_store(folder)) if seed is None else runners.adaptive_random(*given, seed, probability, _store(folder))
    return _write(out, folder, config.get(c, "output.page_files", True))


def run_calibration(spark: SparkSession, path: str) -> dict:
    """Sweeps, their summaries as JSON lines tagged by kind, and the frozen budgets."""
    c = config.load("calibration", path)
    models, prompt, pages = config.models(c["model_config_path"]), config.prompt(c["prompt_config_path"]), _inputs(spark, c, "split").drop("ord")
    s = config.settings(c)
    small, large = (config.named(models, config.get(c, f"models.{k}")) for k in ("adaptive", "fixed_8b"))
    # One sweep of each: its points, as many as there are settings, are both written and chosen from.
    few = lambda df: spark.createDataFrame(df.collect(), df.schema)
    adaptive = few(calibration.sweep_adaptive(pages, small, prompt, s, _store(config.get(c, "output.sweep_summaries_path") + "_work")))
    fixed = {m.name: few(calibration.sweep_fixed(pages, m, prompt, s)) for m in (small, large)}
    pairs = adaptive.withColumn("kind", F.lit("adaptive"))
    for name, points in fixed.items():
        pairs = pairs.unionByName(points.withColumns({"kind": F.lit("fixed"), "model_name": F.lit(name)}), allowMissingColumns=True)
    sinks.write_log(pairs, config.get(c, "output.sweep_summaries_path"))
    frozen = calibration.chosen(adaptive, fixed, small, large, s) | {"run_id": c["run_id"], "generated_at": datetime.now(UTC).isoformat()}
    frozen["pinning"] |= {
        "calibration_split_manifest": config.get(c, "split.manifest_path"),
        "calibration_split_sha256": json_tables.sha256(spark, config.get(c, "split.manifest_path")), "calibration_config_path": str(path)
    }
    calibration.freeze(config.get(c, "output.frozen_budgets_path"), frozen)
    return frozen


def run_experiment(spark: SparkSession, path: str, families: list[str] | None = None, allow_stub_8b: bool = False) -> list[dict]:
    """All systems and the run manifest; a system's failure is a row of it."""
    c = config.load("experiment", path)
    root, frozen = config.get(c, "output.root"), calibration.check_frozen(json.loads(read_text(c["frozen_budgets_path"])))
    prompt: Prompt = config.prompt(config.get(c, "prompt.config_path"))
    sel = frozen["selection"]["adaptive"]
    rate, degenerate = summary.reparse_probability(sel["measured"], sel["low"], sel["high"])

    def write(system: str, out: DataFrame) -> str:
        _write(out, f"{root}/{system}", config.get(c, "output.page_files", True))
        return f"{root}/{system}/logs"

    pages = _inputs(spark, c).drop("ord")
    entries = experiment.run_all(
        pages, frozen, config.models(config.get(c, "model.config_path")), prompt, config.seeds(c), write, c["run_set_id"],
        config.get(c, "inputs.split_name"), families, allow_stub_8b, _store(root)
    )
    held = config.get(c, "inputs.manifest_path")
    header = {
        "run_set_id": c["run_set_id"], "generated_at": datetime.now(UTC).isoformat(), "held_out_manifest_path": held,
        "held_out_manifest_sha256": json_tables.sha256(spark, held), "frozen_budgets_path": c["frozen_budgets_path"],
        "frozen_budgets_sha256": json_tables.sha256(spark, c["frozen_budgets_path"]), "prompt_id": prompt.id, "prompt_version": prompt.version,
        "git_head": experiment.git_head("."), "calibration_reparse_rate": rate, "calibration_reparse_rate_degenerate": degenerate,
        "random_seeds": config.seeds(c)
    }
    sinks.write_json(f"{root}/manifest.json", {"schema_version": 1, "header": header, "entries": entries})
    return entries


def run_manifest(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A run manifest's header, and its entries as rows with their order (ord); another schema version raises
    ValueError. Values are coerced to the columns' types, nulls kept; empty output folders are null.
    """
    data = json.loads(read_text(path))
    if data.get("schema_version") != 1:
        raise ValueError(f"{path}: schema_version must be 1")
    turn = {"int": int, "double": float, "string": str, "array<string>": lambda v: [str(x) for x in v]}
    fields = [f.split() for f in schemas.ENTRY.split(", ")]

    def value(entry: dict, name: str, kind: str) -> object:
        v = entry.get(name)
        if name == "notes":
            v = v or []
        return None if v is None or (name == "output_dir" and v == "") else turn[kind](v)

    rows = [[i, *(value(e, *f) for f in fields)] for i, e in enumerate(data["entries"])]
    return data["header"], spark.createDataFrame(rows, "ord int, " + schemas.ENTRY)


SCORE_COLUMNS = ("page_id", "cell_f1", "precision", "recall", "text_similarity", "gold_cells", "pred_cells", "pred_parse_error", "gold_missing")


def run_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """page_id and raw_text of a run: from its sidecars and texts, or where it has no page files from its table of
    outputs. FileNotFoundError without either.
    """
    try:
        return json_tables.sidecars(spark, folder).select("page_id", "raw_text")
    except FileNotFoundError:
        if not exists(f"{folder}/outputs"):
            raise
        return spark.read.parquet(literal(f"{folder}/outputs")).select("page_id", "raw_text")


def score_run(spark: SparkSession, outputs: DataFrame, gold: DataFrame, folder: str) -> dict:
    """Page scores as Parquet, their macro means as JSON, both as Markdown, by page id; returns the means. A page whose
    text is missing scores like one without tables.
    """
    scores = verify.scored(outputs.select("page_id", "raw_text"), gold).drop("raw_text")
    scores.write.mode("overwrite").parquet(f"{folder}/page_scores")
    done = spark.read.parquet(literal(f"{folder}/page_scores"))
    m = verify.macros(done).head().asDict()
    sinks.write_json(f"{folder}/page_scores.json", {"summary": m})
    where, path = located(f"{folder}/scores.md")
    with where.open_output_stream(path, compression=None) as sink:
        sink.write(("# Scores\n\n" + sinks.markdown_table([m], list(m)) + "\n## Pages\n\n" + sinks.markdown_table([], list(SCORE_COLUMNS))).encode())
        for r in done.select(*SCORE_COLUMNS).orderBy("page_id").toLocalIterator():  # a partition of rows at a time
            sink.write(sinks.markdown_rows([r.asDict()], list(SCORE_COLUMNS)).encode())
    return m


def score_summaries(spark: SparkSession, root: str, systems: list[str]) -> DataFrame:
    """system_id and macro figures of the systems whose score file is there; one without its figures raises ValueError.
    """
    rows = []
    for s in systems:
        at = f"{root}/score_phase6_{s}/page_scores.json"
        if exists(at):
            data = json.loads(read_text(at))
            m = data.get("summary") if isinstance(data, dict) else None
            try:
                rows.append((s, float(m["macro_cell_f1"]), float(m["macro_text_similarity"]), int(m["pages_with_parse_error"]), int(m["pages_with_gold"])))
            except (KeyError, TypeError) as e:
                raise ValueError(f"{at}: no summary with {e}") from e
    return spark.createDataFrame(rows, "system_id string, macro_cell_f1 double, macro_text_similarity double, pages_with_parse_error long, pages_with_gold long")


def analyse(spark: SparkSession, path: str) -> dict:
    """Results, costs, escalations, the page matrix and the audit, as artifacts; returns the audit's checks and the
    statuses.
    """
    c = config.load("analysis", path)
    i, root = c["inputs"], config.get(c, "output.root")
    header, entries = run_manifest(spark, i["phase6_manifest_path"])
    frozen = calibration.check_frozen(json.loads(read_text(i["frozen_budgets_path"])))
    held, cal = (json_tables.split_page_ids(spark, i[k]) for k in ("held_out_split_path", "calibration_split_path"))
    folders = [(r.system_id, r.output_dir) for r in entries.where("output_dir is not null").select("system_id", "output_dir").collect()]
    log = json_tables.log_rows(spark, dict(folders))
    systems = [r.system_id for r in entries.select("system_id").collect()]
    scores = score_summaries(spark, i["scoring_summaries_root"], systems) if i.get("scoring_summaries_root") else None
    results = analysis.results(entries, log, scores)
    named = entries.select(
        "system_id", "budget_name", F.col("budget_low_max_tiles").alias("low"), F.col("budget_high_max_tiles").alias("high"),
        F.col("budget_max_tiles").alias("tiles"), F.col("runner").isin(*schemas.ADAPTIVE_RUNNERS).alias("adaptive")
    )
    targets = summary.Targets({"B_fix_2B": frozen["selection"]["fixed_2b"]["target"], "B_fix_8B": frozen["selection"]["fixed_8b"]["target"]})
    costs = summary.cost_summary(results.select("system_id", "cost_tiles").join(named, "system_id"), targets)
    small = {"results": results, "cost_summary": costs, "reparse_summary": analysis.reparse_slices(entries, log)}
    for name, df in small.items():
        sinks.write_json(f"{root}/{name}.json", [r.asDict(recursive=True) for r in df.orderBy("system_id").collect()])
    summary.page_matrix(held, log, entries).write.mode("overwrite").json(f"{root}/page_matrix")
    shas = {"held_out": json_tables.sha256(spark, i["held_out_split_path"]), "frozen": json_tables.sha256(spark, i["frozen_budgets_path"])}
    checks = analysis.audit(
        entries, log, cal, held,
        {
            "held_out_sha256": header["held_out_manifest_sha256"], "frozen_sha256": header["frozen_budgets_sha256"], "seeds": header["random_seeds"],
            "prompt_id": header["prompt_id"]
        },
        shas, frozen, bool(i.get("splits_are_identical_acknowledged", False))
    )
    out = {"any_failed": analysis.any_failed(checks), "any_warned": any(x["status"] == analysis.WARN for x in checks), "checks": checks}
    sinks.write_json(f"{root}/audit.json", out)
    sinks.write_json(f"{root}/analysis_manifest.json", {"accuracy_status": analysis.accuracy_status(frozen), "frozen_budgets_sha256": shas["frozen"], "systems": systems})
    return out


def run_freeze(spark: SparkSession, path: str) -> dict[str, int]:
    c = config.load("freeze", path)
    records = json_tables.page_records(spark, config.get(c, "input.records_path"))
    size = config.get(c, "split.eval_size", None)
    members = freeze.universe(records, config.rule(c), int(config.get(c, "split.calibration_size")), None if size is None else int(size), int(config.get(c, "split.seed")))
    return freeze.write_manifests(members, config.get(c, "output.manifests_dir"), c["pinning"], int(config.get(c, "split.seed")))


def select_fixture(spark: SparkSession, annotations: str, folder: str, limit: int, min_non_empty_cells: int = 0) -> int:
    """Page records and gold of selected annotation pages, as JSON."""
    pages = dataset.select_annotations(json_tables.annotations(spark, annotations), limit, min_non_empty_cells).collect()
    record = lambda r: {
        "page_id": r.page_id, "image_path": r.image_filename, "language": "en", "contains_table": True, "is_english_table_page": True,
        "row_count": r.row_count, "col_count": r.col_count, "has_merged_cells": r.has_merged_cells, "has_nested_headers": r.has_nested_headers
    }
    sinks.write_json(f"{folder}/page_records.json", [record(r) for r in pages])
    sinks.write_json(f"{folder}/ground_truth.json", {r.page_id: r.table_html for r in pages})
    return len(pages)
