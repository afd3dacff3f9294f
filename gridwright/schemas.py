"""Schemas of the entities."""

from __future__ import annotations

PAGE_RECORD = "page_id string, image_path string, language string, contains_table boolean, is_english_table_page boolean, row_count int, col_count int, has_merged_cells boolean, has_nested_headers boolean"
SINGLE_LOG = "run_id string, page_id string, split string, model_name string, budget_name string, prompt_id string, runtime_ms double, output_token_count long, raw_output_path string, started_at string, finished_at string, status string"
ADAPTIVE_LOG = "run_id string, split string, page_id string, model_name string, prompt_id string, budget_low string, budget_high string, reparse_triggered boolean, verifier_decision string, verifier_failure_codes array<string>, predicted_table_count int, first_pass_output_tokens long, reparse_output_tokens long, first_pass_runtime_ms double, verifier_runtime_ms double, reparse_runtime_ms double, total_runtime_ms double, first_pass_raw_path string, reparse_raw_path string, final_raw_path string, final_output_source string, status string"
RANDOM_LOG = ADAPTIVE_LOG + ", random_seed int, random_probability double, policy string"
ANY_LOG = RANDOM_LOG + ", runtime_ms double, output_token_count long, budget_name string, raw_output_path string, started_at string, finished_at string"
ENTRY = "system_id string, family string, runner string, status string, output_dir string, pages_processed int, reparse_count int, model_name string, adapter_kind string, budget_low_name string, budget_low_max_tiles int, budget_high_name string, budget_high_max_tiles int, budget_name string, budget_max_tiles int, seed int, random_probability double, random_probability_source string, started_at string, finished_at string, error string, reason string, notes array<string>"
SPEC = "ord int, system_id string, family string, runner string, seed int"

ADAPTIVE_RUNNERS = ("adaptive", "adaptive_random")
SINGLE_PASS_RUNNER = "single_pass"
