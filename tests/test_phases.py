"""Phases from configuration files to artifacts, by the command line's functions."""

import json
import struct

import pytest
import yaml

from gridwright import cli
from gridwright.plans import config, drivers


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")

    def put(name, data):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps(data) if name.endswith(".json") else yaml.safe_dump(data))
        return str(p)

    pages = [
        {
            "page_id": f"page_{i:04d}", "image_path": f"images/page_{i:04d}.png", "language": "en", "contains_table": True,
            "is_english_table_page": True, "row_count": 25 if i == 1 else 2
        } for i in range(1, 15)
    ]
    (root / "images").mkdir()
    for p in pages:
        (root / p["image_path"]).write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\2\0\0\0")
    records = put("records.json", pages)
    put(
        "freeze.yaml",
        {
            "pinning": {"dataset_name": "d"}, "input": {"records_path": records}, "subsets": {"hard_table_rule": {"min_row_count": 20}},
            "split": {"seed": 1337, "calibration_size": 5, "eval_size": None}, "output": {"manifests_dir": str(root / "splits")}
        }
    )
    models = put("models.yaml", {"models": {n: {"adapter_kind": "stub"} for n in ("m2", "m8")}})
    budgets = put("budgets.yaml", {"budgets": {"low": {"max_tiles": 4}, "high": {"max_tiles": 12}}})
    prompt = put("prompt.yaml", {"id": "p1", "version": 1, "template": "parse"})
    cal, held = (str(root / f"splits/{k}_split.json") for k in ("calibration", "held_out_eval"))
    inputs = {"split_name": "s", "manifest_path": cal, "records_path": records, "image_root": str(root)}
    put(
        "single.yaml",
        {
            "run_id": "r", "inputs": inputs, "model": {"config_path": models, "name": "m2"}, "budget": {"config_path": budgets, "name": "low"},
            "prompt": {"config_path": prompt}, "output": {"dir": str(root / "single")}
        }
    )
    put(
        "adaptive.yaml",
        {
            "run_id": "r", "inputs": inputs, "model": {"config_path": models, "name": "m2"},
            "budget": {"config_path": budgets, "low_name": "low", "high_name": "high"}, "prompt": {"config_path": prompt},
            "output": {"dir": str(root / "adaptive")}
        }
    )
    fixed = [4, 6, 8, 10, 12]
    put(
        "calibration.yaml",
        {
            "run_id": "c", "split": inputs, "prompt_config_path": prompt, "model_config_path": models,
            "candidates": {"low_max_tiles": [2, 4, 6], "high_max_tiles": [8, 12, 16], "fixed_2b_max_tiles": fixed, "fixed_8b_max_tiles": fixed},
            "target_adaptive_cost_tiles": 6.0, "matched_cost_tolerance": 0.1, "models": {"adaptive": "m2", "fixed_2b": "m2", "fixed_8b": "m8"},
            "output": {"sweep_summaries_path": str(root / "sweep"), "frozen_budgets_path": str(root / "frozen.json")}
        }
    )
    put(
        "experiment.yaml",
        {
            "run_set_id": "e", "frozen_budgets_path": str(root / "frozen.json"), "inputs": inputs | {"manifest_path": held},
            "model": {"config_path": models}, "prompt": {"config_path": prompt}, "output": {"root": str(root / "runs")},
            "random_escalation": {"seeds": [0, 1]}
        }
    )
    put(
        "analysis.yaml",
        {
            "inputs": {
                "phase6_manifest_path": str(root / "runs/manifest.json"), "frozen_budgets_path": str(root / "frozen.json"),
                "held_out_split_path": held, "calibration_split_path": cal, "scoring_summaries_root": str(root)
            },
            "output": {"root": str(root / "analysis")}
        }
    )
    return root


def test_all_phases(spark, project, capsys):
    assert cli.main(["freeze", f"{project}/freeze.yaml"]) == 0
    split = json.loads((project / "splits/calibration_split.json").read_text())
    assert split["page_ids"] == [f"page_{i:04d}" for i in (1, 2, 5, 7, 13)] and json.loads((project / "splits/hard_subset.json").read_text())["page_ids"] == ["page_0001"]
    assert cli.main(["single", f"{project}/single.yaml"]) == cli.main(["adaptive", f"{project}/adaptive.yaml"]) == 0
    rows = spark.read.parquet(f"{project}/single/outputs").collect()
    assert len(rows) == 5 and {r.output_token_count for r in rows} == {9} and "<td>640</td>" in rows[0].raw_text
    assert cli.main(["random", f"{project}/adaptive.yaml", "--seed", "3", "--probability", "1"]) == 0
    assert {(r.reparse_triggered, r.random_seed) for r in spark.read.parquet(f"{project}/adaptive/outputs").collect()} == {(True, 3)}
    assert cli.main(["calibrate", f"{project}/calibration.yaml"]) == 0
    assert "adaptive: low 6, high 8 tiles; 6.0000" in capsys.readouterr().out
    frozen = json.loads((project / "frozen.json").read_text())
    assert [frozen["budgets"][k]["max_tiles"] for k in ("B_low", "B_high", "B_fix_2B", "B_fix_8B")] == [6, 8, 6, 6]
    assert spark.read.json(f"{project}/sweep").groupBy("kind").count().count() == 2
    assert cli.main(["experiment", f"{project}/experiment.yaml"]) == 0
    header, entries = drivers.run_manifest(spark, f"{project}/runs/manifest.json")
    assert [r.status for r in entries.orderBy("ord").collect()] == ["ok"] * 5 + ["skipped_stub_8b"] and header["calibration_reparse_rate_degenerate"]
    gold = project / "gold.json"
    gold.write_text(json.dumps({r.page_id: r.raw_text for r in rows}))
    assert cli.main(["score", f"{project}/single", str(gold), f"{project}/score_phase6_fixed_2b_low"]) == 0
    assert json.loads((project / "score_phase6_fixed_2b_low/page_scores.json").read_text())["summary"]["macro_cell_f1"] == 1.0
    assert cli.main(["analyse", f"{project}/analysis.yaml"]) == 0
    checks = {c["name"]: c["status"] for c in json.loads((project / "analysis/audit.json").read_text())["checks"]}
    assert set(checks.values()) == {"ok", "warn"} and len(checks) == 11
    results = {r["system_id"]: r for r in json.loads((project / "analysis/results.json").read_text())}
    assert results["fixed_2b_low"]["macro_cell_f1"] == 1.0 and results["adaptive_2b"]["cost_tiles"] == 6.0 and results["fixed_8b_matched"]["sample_size"] == 0
    assert spark.read.json(f"{project}/analysis/page_matrix").count() == 9
    (project / "frozen.json").write_text(json.dumps(frozen | {"run_id": "changed"}))
    assert cli.main(["analyse", f"{project}/analysis.yaml"]) == 1


def test_bad_configurations(tmp_path, spark):
    def put(data):
        (tmp_path / "c.yaml").write_text(yaml.safe_dump(data))
        return tmp_path / "c.yaml"

    for load, data in (
        (config.budgets, {"budgets": {"low": {"max_tiles": 0}}}), (config.budgets, {"budgets": [1]}), (config.models, {"models": {"m": {}}}),
        (config.prompt, {"id": "x", "version": 1, "template": " "}), (config.read, [1]), (lambda p: config.load("single", p), {"run_id": "r"})
    ):
        with pytest.raises(ValueError):
            load(put(data))
    with pytest.raises(KeyError):
        config.named({"a": 1}, "b")
    (tmp_path / "m.json").write_text('{"schema_version": 2}')
    with pytest.raises(ValueError):
        drivers.run_manifest(spark, str(tmp_path / "m.json"))
    (tmp_path / "m.json").write_text(
        json.dumps(
            {
                "schema_version": 1, "header": {},
                "entries": [
                    {
                        "system_id": "s", "family": "f", "runner": "adaptive", "status": "ok", "output_dir": "", "seed": "4", "random_probability": 1,
                        "notes": None
                    },
                    {"system_id": "t", "seed": None}
                ]
            }
        )
    )
    first, second = drivers.run_manifest(spark, str(tmp_path / "m.json"))[1].orderBy("ord").collect()
    assert (first.output_dir, first.seed, first.random_probability, first.notes) == (None, 4, 1.0, []) and (second.seed, second.family) == (None, None)
    (tmp_path / "score_phase6_s").mkdir()
    (tmp_path / "score_phase6_s" / "page_scores.json").write_text("{}")
    with pytest.raises(ValueError):
        drivers.score_summaries(spark, str(tmp_path), ["s"])


def test_missing_pages_and_images(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"page_id": "a", "image_path": "a.png", "language": "en", "contains_table": True, "is_english_table_page": True}]))
    (tmp_path / "m.json").write_text(json.dumps({"page_ids": ["a", "b"]}))
    with pytest.raises(KeyError, match="b"):
        drivers.pages_for(spark, str(tmp_path / "m.json"), str(tmp_path / "r.json"), None)
    (tmp_path / "m.json").write_text(json.dumps({"page_ids": ["a"]}))
    assert drivers.pages_for(spark, str(tmp_path / "m.json"), str(tmp_path / "r.json"), None).head().width == 8
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "x.png").write_bytes(b"x")
    with pytest.raises(FileNotFoundError):
        drivers.pages_for(spark, str(tmp_path / "m.json"), str(tmp_path / "r.json"), str(tmp_path / "img"))


def test_describe(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"page": {"no": 3}}, {"page": {"no": 1}, "boxes": [[1], []]}]}))
    assert cli.main(["describe", str(tmp_path / "a.json")]) == 0
    told = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [(r["path"], r["kind"], r["n"]) for r in told] == [
        ("$", "OBJECT", 2), ("$.boxes", "ARRAY", 1), ("$.boxes[]", "ARRAY", 2), ("$.boxes[][]", "BIGINT", 1), ("$.page", "OBJECT", 2),
        ("$.page.no", "BIGINT", 2)
    ]
    assert told[-1]["example"] == "1" and told[1]["most_length"] == 2


def test_select_fixture(spark, tmp_path):
    entry = {"page_info": {"image_path": "x/a.png", "language": "english"}, "layout_dets": [{"category_type": "table", "html": "<table><tr><td>1</td></tr></table>"}]}
    (tmp_path / "a.json").write_text(json.dumps([entry, entry | {"page_info": {"image_path": "b.png", "language": "zh"}}]))
    assert drivers.select_fixture(spark, str(tmp_path / "a.json"), str(tmp_path), 5) == 1
    assert json.loads((tmp_path / "ground_truth.json").read_text()) == {"a": "<table><tr><td>1</td></tr></table>"}
