"""The corpus pipeline, where the driver looks for it; its stages are in gridwright.llm.pipeline."""

from __future__ import annotations

from gridwright.llm.pipeline import STAGES, benchmark, language, lines, near_duplicates, pieces, run

ORACLE_SQL = None  # no stage can be told in SQL; tests hold each against a brute-force version

__all__ = ["ORACLE_SQL", "STAGES", "benchmark", "language", "lines", "near_duplicates", "pieces", "run"]
