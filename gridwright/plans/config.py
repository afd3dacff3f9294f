"""YAML configurations: plain mappings with the keys that a run needs. A missing or odd key raises ValueError, an
unknown name KeyError.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

import yaml

from ..operators.dataset import HardTableRule
from .calibration import Settings
from .inference import Budget, Model, Prompt

# The keys of each kind of configuration, by dots.
INPUTS = ("inputs.split_name", "inputs.manifest_path", "inputs.records_path", "inputs.image_root")
KINDS = {
    "single": ("run_id", *INPUTS, "model.config_path", "model.name", "budget.config_path", "budget.name", "prompt.config_path", "output.dir"),
    "adaptive": ("run_id", *INPUTS, "model.config_path", "model.name", "budget.config_path", "budget.low_name", "budget.high_name", "prompt.config_path", "output.dir"),
    "calibration": (
        "run_id", "split.manifest_path", "split.records_path", "split.image_root", "prompt_config_path", "model_config_path",
        "candidates.low_max_tiles", "candidates.high_max_tiles", "candidates.fixed_2b_max_tiles", "target_adaptive_cost_tiles",
        "matched_cost_tolerance", "models.adaptive", "models.fixed_2b", "models.fixed_8b", "output.sweep_summaries_path", "output.frozen_budgets_path"
    ),
    "experiment": ("run_set_id", "frozen_budgets_path", *INPUTS, "model.config_path", "prompt.config_path", "output.root", "random_escalation.seeds"),
    "analysis": ("inputs.phase6_manifest_path", "inputs.frozen_budgets_path", "inputs.held_out_split_path", "inputs.calibration_split_path", "output.root"),
    "freeze": ("pinning", "input.records_path", "subsets.hard_table_rule", "split.seed", "split.calibration_size", "output.manifests_dir"),
}


def read(path: str | Path) -> dict:
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ValueError(f"{path}: not a mapping")
    return data


def get(data: dict, dotted: str, default: object = ...) -> object:
    node: object = data
    for k in dotted.split("."):
        if not isinstance(node, dict) or k not in node:
            if default is ...:
                raise ValueError(f"missing key {dotted}")
            return default
        node = node[k]
    return node


def load(kind: str, path: str | Path) -> dict:
    data = read(path)
    for k in KINDS[kind]:
        get(data, k)
    return data


def named(table: dict, name: str) -> object:
    if name not in table:
        raise KeyError(f"{name}: there are {sorted(table)}")
    return table[name]


def budgets(path: str | Path) -> dict[str, Budget]:
    found = get(read(path), "budgets")
    if not isinstance(found, dict) or not all(isinstance(b, dict) and isinstance(b.get("max_tiles"), int) for b in found.values()):
        raise ValueError(f"{path}: budgets are mappings with max_tiles")
    return {k: Budget(k, b["max_tiles"]) for k, b in found.items()}


def models(path: str | Path) -> dict[str, Model]:
    found = get(read(path), "models")
    if not isinstance(found, dict) or not all(isinstance(m, dict) and m.get("adapter_kind") for m in found.values()):
        raise ValueError(f"{path}: models are mappings with adapter_kind")
    return {k: Model(k, m["adapter_kind"], str(m.get("model_id", "")), str(m.get("notes", ""))) for k, m in found.items()}


def prompt(path: str | Path) -> Prompt:
    data = read(path)
    try:
        out = Prompt(str(get(data, "id")), int(get(data, "version")), str(get(data, "description", "")), str(get(data, "template")))
    except TypeError as e:
        raise ValueError(f"{path}: {e}") from e
    if not out.id or not out.template.strip():
        raise ValueError(f"{path}: id and template can't be empty")
    return out


def _tiles(data: dict, key: str) -> tuple[int, ...]:
    values = get(data, key)
    if not isinstance(values, list) or not values or not all(isinstance(v, int) and v > 0 for v in values):
        raise ValueError(f"{key}: a list of positive numbers")
    return tuple(values)


def settings(data: dict, fixed: str = "candidates.fixed_2b_max_tiles") -> Settings:
    return Settings(
        _tiles(data, "candidates.low_max_tiles"), _tiles(data, "candidates.high_max_tiles"), _tiles(data, fixed),
        float(get(data, "target_adaptive_cost_tiles")), float(get(data, "matched_cost_tolerance"))
    )


def rule(data: dict) -> HardTableRule:
    return HardTableRule.from_mapping(get(data, "subsets.hard_table_rule"))


def seeds(data: dict) -> list[int]:
    values = get(data, "random_escalation.seeds")
    if not isinstance(values, Iterable) or isinstance(values, str) or not list(values):
        raise ValueError("random_escalation.seeds: a list of seeds")
    return [int(v) for v in values]
